from saltern.plans import answers as A


def test_signals():
    s = A.signals("Compare the Baby Shampoo and the Anti-Acne Cream")
    assert {x.lower() for x in s.compare} == {"baby shampoo", "anti-acne cream"}
    assert A.signals("Give me the Moisturizing Facial Lotion recipe").named == ("Moisturizing Facial Lotion",)
    assert set(A.signals("which recipe contains glycerin and sorbitol?").required) == {"glycerin", "sorbitol"}
    assert A.signals(None) == A.Signals()


def test_batch_and_vectors(spark):
    q = spark.createDataFrame([(1, "Compare Baby Shampoo with Hand Cream"), (2, None)], "id long, text string")
    out = {r["id"]: r for r in A.with_signals(q).collect()}
    assert len(out[1]["compare"]) == 2 and out[2]["compare"] == []
    v = A.embedded(q).orderBy("id").collect()
    assert abs(sum(x * x for x in v[0]["embedding"]) - 1) < 1e-5 and len(v[1]["embedding"]) == 64


def test_templates():
    items = [{"raw_name": "Water", "amount": None, "unit": "qs"}, {"raw_name": "Wax", "amount": 2.5, "unit": "%"}]
    text = A.lookup_answer("Cream", items, ["Heat", "Mix"], 4)
    assert "| Water | q.s. |" in text and "| Wax | 2.5 % |" in text and text.endswith("2. Mix")
    assert "Only in B: wax" in A.compare_answer("A", "B", [{"key": "wax", "side": "right"}])
    assert A.prompt("q", [{"doc_id": "d", "pdf_page": 1, "text": "t"}], [{"role": "user", "text": "x"}]).splitlines()[1] == "[1] d p.1: t"
