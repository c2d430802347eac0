"""Word and Excel files written by hand, uploads, and structured search with all its points."""

import zipfile

import pytest

from saltern.operators import warehouse
from saltern.plans import intent, ranking
from saltern.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def word(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')


def paragraph(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=%s/></w:pPr>' % repr(style).replace(chr(39), chr(34)) if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def excel(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {X} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {X}><si><t>Ingredient</t></si><si><t>wt%</t></si></sst>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {X}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>")


def cell(ref, value, kind="inlineStr"):
    return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>' if kind == "inlineStr" else f'<c r="{ref}"{f" t=%s" % chr(34) + kind + chr(34) if kind else ""}><v>{value}</v></c>'


def test_word_sections(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Water</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>70</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    word(folder / "My Book.docx", paragraph("Shampoos", "H1") + paragraph("A baby shampoo is mild and holds   little surfactant, as skin is thin, and it foams.") + paragraph("Creams", "H1") + paragraph("Creams are emulsions of oil and of water in many parts.") + table)
    word(folder / "~$lock.docx", paragraph("never read, as it is a lock file of the editor"))
    (folder / "broken.docx").write_bytes(b"no archive")
    out = office.docx_pages(spark, str(folder)).orderBy("pdf_page").collect()
    assert [r["doc_id"] for r in out] == ["my_book"] * 2
    assert out[0]["text"].startswith("# Shampoos\n\nA baby shampoo is mild and holds little") and out[1]["text"].startswith("# Creams")
    assert "[TABLE]\nWater | 70\n[/TABLE]" in out[1]["text"]


def test_excel_pages_and_upload(spark, tmp_path):
    folder = tmp_path / "sheets"
    folder.mkdir()
    rows = [cell("A1", "Inventory of March"), "", cell("A3", 0, "s") + cell("B3", "Qty") + cell("C3", "SKU")]
    rows += [cell("A4", "Water") + cell("B4", "70", "") + cell("C4", "W1"), cell("A5", "Glycerin") + cell("C5", "G1"), cell("A6", "Total") + cell("B6", "7.50", "")]
    excel(folder / "Stock A.xlsx", {"Stock": rows, "Long": [cell(f"A{k}", "x" * 1000) for k in range(1, 20)]})
    pages = office.xlsx_pages(spark, str(folder)).orderBy("pdf_page").collect()
    assert [r["pdf_page"] for r in pages] == [1, 2, 3] and pages[0]["text"].startswith("# Stock\n[TABLE]\nInventory of March\nIngredient | Qty | SKU\nWater | 70 | W1\nGlycerin | | G1\nTotal | 7.5")
    assert len(pages[1]["text"]) == office.PAGE
    up = office.upload(spark, str(folder / "Stock A.xlsx"))
    assert [tuple(r)[1:] for r in up.orderBy("pos").collect()] == [("Water", "W1", "70"), ("Glycerin", "G1", None), ("Total", None, "7.5")]
    assert {r["key"]: r["qty"] for r in warehouse.merge_upload(up).collect()} == {"water": 70.0, "glycerin": None}
    csv = tmp_path / "stock.csv"
    csv.write_text("code,material,stock\nA,Wax,3\n")
    assert [tuple(r)[1:] for r in office.upload(spark, str(csv)).collect()] == [("Wax", "A", "3")]


ROWS = [
    ("a", "Tube-Dispensed Hand Cream", ["cream"], "d", "text", ["water", "stearic acid"]),
    ("b", "Hand and Nail Cream", ["cream"], "d", "text", ["water", "glycerin", "wax"]),
    ("c", "Baby Cream", ["cream"], "d", "a vitamin e cream for babies", ["water", "vitamin e"]),
    ("e", "Plain Lotion", ["lotion"], "d", "see the Silk Veil Night Cream of the next page", ["water", "oil"]),
]


@pytest.fixture
def recipes(spark):
    lines = [(i, n, t, d, s, [{"raw_name": x, "normalized_name": x} for x in names], names) for i, n, t, d, s, names in ROWS]
    return spark.createDataFrame(lines, "id string, name string, product_types array<string>, doc_id string, source_text string, ingredients array<struct<raw_name:string,normalized_name:string>>, names array<string>")


def test_hand_cream_points_and_tiers(recipes):
    got = {r["id"]: r["breakdown"] for r in ranking.scored(recipes, ["cream"], question="give me a hand cream").collect()}
    assert got["a"]["hand_cream_title"] == 25 and got["a"]["name_bonus"] == 18 and got["b"]["hand_cream_title"] == 10 and got["c"]["hand_cream_title"] == -20 and got["c"]["name_bonus"] == -15
    plain = ranking.scored(recipes, ["cream"], question="a cream").first()["breakdown"]
    assert {x["modifier_match"] for x in got.values()} == {30.0} and plain["modifier_match"] == 0 and "hand_cream_title" not in plain
    assert [r["id"] for r in ranking.structured_search(recipes, ["cream"], question="give me a hand cream").collect()][:2] == ["a", "b"]
    assert {r["breakdown"]["modifier_match"] for r in ranking.scored(recipes, ["cream"], question="hand cream for baby").collect()} == {30.0}


def test_titles_and_ingredients(recipes):
    got = {r["id"]: r["breakdown"]["named_formula"] for r in ranking.scored(recipes, [], titles=["Silk Veil Night Cream"]).collect()}
    assert got == {"a": -18.0, "b": -18.0, "c": -18.0, "e": 28.0}
    found = ranking.structured_search(recipes, ["cream"], required=["vitamin e"])
    assert found.first()["id"] == "c" and ranking.route_hint(found, required=["vitamin e"]) == "direct"
    assert ranking.route_hint(ranking.structured_search(recipes, ["cream"], required=["retinol"]), required=["retinol"]) == "fallback"
    dandruff = ranking.tiers(["anti_dandruff", "shampoo"])
    assert len(dandruff) == 1 and len(ranking.tiers(["cream"], ["x"], ["y"], "a hand cream")) == 2


def test_type_rewriting():
    assert intent.type_filter(["anti_dandruff", "shampoo"]) == ["anti_dandruff"]
