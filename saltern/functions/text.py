"""Text functions as column expressions: normalisation, identity, tokens, tags and detectors.

Patterns that oracles check stay in the common subset of Java's and RE2's regular expressions.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\r\x0b\x0c"

# Canonical names of ingredients by lower-cased spelling.
ALIASES = {
    "sulfochem ea-2": "sodium laureth sulfate",
    "sulfochem als": "ammonium lauryl sulfate",
    "sulfochem b-209": "sodium laureth sulfate",
    "sles": "sodium laureth sulfate",
    "sls": "sodium lauryl sulfate",
    "sodium lauryl sulfate": "sodium lauryl sulfate",
    "sodium laureth sulfate": "sodium laureth sulfate",
    "capb": "cocamidopropyl betaine",
    "cocamidopropyl betaine": "cocamidopropyl betaine",
    "veegum": "magnesium aluminum silicate",
    "methocel fym": "hydroxypropyl methylcellulose",
    "methocel f4m": "hydroxypropyl methylcellulose",
    "methocel f4 m": "hydroxypropyl methylcellulose",
    "methyl paraben": "methylparaben",
    "methylparaben": "methylparaben",
    "triethanolamine": "triethanolamine",
    "tea": "triethanolamine",
    "carbomer": "carbomer",
    "carbopol": "carbomer",
    "glycerin": "glycerin",
    "glycerine": "glycerin",
    "propylene glycol": "propylene glycol",
    "purified water": "water",
    "puri fi ed water": "water",
    "deionized water": "water",
    "aqua": "water",
    "fragrance": "fragrance",
    "parfum": "fragrance",
}

# Tags of product types by pattern, in the order in which tags are listed.
PRODUCT_TAGS = [
    ("baby", r"(?i)\bbaby\b"),
    ("anti_dandruff", r"(?i)\banti[-\s]?dandruff\b|\bantidandruff\b"),
    ("shampoo", r"(?i)\bshampoo\b|\bsham[d]?oo\b"),
    ("conditioner", r"(?i)\bcondition(er|ing)\b|\bleave[-\s]?in\b"),
    ("cream", r"(?i)\b(hand\s+)?cream\b|\bhand\s+cream\b|\bgel\s+cream\b"),
    ("lotion", r"(?i)\blotion\b"),
    ("soap", r"(?i)\b(soap|soaD|hand\s+cleaner)\b"),
    ("sunscreen", r"(?i)\bsunscreen\b|\bsolar\s+protection\b|\bsuntan\b|\bspf\b"),
    ("makeup", r"(?i)\bmake[-\s]?up\b|\blipstick\b|\blip\s+balm\b"),
    ("deodorant", r"(?i)\bdeodorant\b|\bantiperspirant\b"),
    ("cleanser", r"(?i)\bcleanser\b|\bfacial\s+wash\b|\bcleansing\b"),
    ("toner", r"(?i)\btoner\b"),
    ("gel", r"(?i)\bgel\b|\bshower\s+(?:gel|bath)\b"),
]

#: Of each tag's pattern, lower-cased pieces of which every match holds one.
TAG_WORDS = {
    "baby": ["baby"], "anti_dandruff": ["dandruff"], "shampoo": ["sham"], "conditioner": ["condition", "leave"], "cream": ["cream"], "lotion": ["lotion"], "soap": ["soa", "cleaner"],
    "sunscreen": ["sunscreen", "solar", "suntan", "spf"], "makeup": ["make", "lipstick", "lip"], "deodorant": ["deodorant", "antiperspirant"], "cleanser": ["cleans", "facial"], "toner": ["toner"], "gel": ["gel", "shower"],
}

# The signs of a formula in a chunk.
FORMULA_SIGNS = {
    "keyword": r"(?i)\b(ingredient|ingredients|inqredient|raw materials|formula|formulation|procedure|parts|recipe|wt\.?|w/w)\b",
    "wtb": r"(?i)\bwt[b$s%]?\b",
    "part_line": r"(?m)^\s*[A-Z]\s+[A-Za-z]",
    "percent": r"\d[\d.,]*\s*%",
    "wtg": r"(?i)\bwtg\b",
    "qs": r"(?i)\bq\.?\s*s\.?\b",
    "part": r"(?i)\bPart\s+[A-Z]\b",
    "weight": r"\b\d+\.\d{2}\b",
    "context": r"(?i)\b(surfactant|anionic|amphoteric|emulsif|preservative|water)\b",
    "recipe": r"(?i)\bRecipe\s*:",
}

TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?|[%]"
ARABIC = "[\\u0600-\\u06FF]"


def squeeze(text: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.regexp_replace(F.btrim(text, F.lit(SPACES)), r"[ \t\n\r\x0B\f]+", " ")


def page_text(text: Column) -> Column:
    """Blanks squeezed, at most one empty line between paragraphs, trimmed."""
    out = F.regexp_replace(text, "[ \\t\\u00A0]+", " ")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(SPACES))


def has_arabic(text: Column) -> Column:
    return F.coalesce(text.rlike(ARABIC), F.lit(False))


def ingredient_name(raw: Column) -> Column:
    """The canonical name; Arabic names have none here ("")."""
    key = F.lower(squeeze(raw))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when(has_arabic(raw), "").otherwise(F.coalesce(F.try_element_at(names, key), key))


def canonical_key(raw: Column) -> Column:
    """The canonical name, or the trimmed lower-case text where there is none."""
    name = ingredient_name(raw)
    return F.when(name != "", name).otherwise(F.lower(F.btrim(raw, F.lit(SPACES))))


# Letters that Arabic keys fold, and what they become.
ARABIC_FOLDS = ("أإآىةؤئـ", "ااايهوي")


def arabic_key(text: Column) -> Column:
    return F.translate(squeeze(text), *ARABIC_FOLDS)


def text_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(F.btrim(text, F.lit(SPACES))), r"[ \t\n\r\x0B\f]+", " ").cast("binary"), 256)


def slug(name: Column) -> Column:
    """A document's id: its file name's stem in lower case, other characters as underscores."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.btrim(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "_"), F.lit("_"))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def product_tags(text: Column) -> Column:
    """array<string> of the tags whose pattern the text has.

    Patterns run only on texts with one of the pattern's words (`TAG_WORDS`), which is a plain search."""
    low = F.lower(text)
    has = lambda t: reduce(or_, [low.contains(w) for w in TAG_WORDS[t]])
    return F.array_compact(F.array(*[F.when(has(t) & text.rlike(p), F.lit(t)) for t, p in PRODUCT_TAGS]))


def is_formula(text: Column) -> Column:
    """Whether a chunk holds a formula."""
    has = {k: text.rlike(p) for k, p in FORMULA_SIGNS.items()}
    percent = text.contains("%")
    clauses = [
        percent & has["keyword"],
        (has["wtg"] | has["wtb"]) & (has["weight"] | has["part"]),
        has["part"] & has["weight"],
        has["recipe"] & has["part_line"],
        has["qs"] & has["weight"] & (has["keyword"] | has["recipe"]),
        has["percent"] & has["context"],
        percent & has["part"],
    ]
    out = clauses[0]
    for c in clauses[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def chunk_type(text: Column, formula: Column) -> Column:
    return F.when(text.contains("[TABLE]"), "table").when(formula, "formula").otherwise("prose")


def is_teaser(text: Column) -> Column:
    """An announcement of a formula without any of its figures."""
    figures = F.lower(text).contains("wtg") | text.rlike(r"\d+\.\d{2}") | text.rlike(r"\d\s*%") | text.rlike(r"(?i)\bPart\s+[A-Z]\b")
    return text.rlike(r"(?i)\bstarting\s+(formula|formulation)\b") & ~figures & (F.char_length(text) < 800)


# Signs of a garbled name, their points.
NAME_SIGNS = [
    (r"\|", 3),
    (r"[ \t]\d+[ \t]+\d+[ \t]*$", 2),
    (r"(?i)^(wt[ \t]*[%$8]?|w/w|q\.?[ \t]*s\.?|\d+(\.\d+)?)$", 3),
    (r"(?i)[bcdfghjklmnpqrstvwxz]{5,}", 1),
    (r"(?i)q[^u \t\d]", 1),
    (r"[a-z][A-Z][a-z]", 1),
]


def name_points(name: Column) -> Column:
    """Points of suspicion that a name is garbled; from 1 on it is reported."""
    own = F.btrim(name, F.lit(SPACES))
    points = F.lit(0)
    for pattern, value in NAME_SIGNS:
        points = points + F.when(own.rlike(pattern), value).otherwise(0)
    solid = F.regexp_replace(own, r"\s", "")
    letters = F.char_length(F.regexp_replace(solid, r"[^\p{L}]", "")) / F.greatest(F.char_length(solid), F.lit(1))
    points = points + F.when((F.char_length(own) >= 3) & (letters < 0.55), 2).otherwise(0)
    words = F.regexp_extract_all(own, F.lit("[A-Za-z]+"), 0)
    dry = F.exists(words, lambda w: (F.char_length(w) >= 3) & (w != F.upper(w)) & ~w.rlike("(?i)[aeiouy]"))
    return points + F.when(dry, 1).otherwise(0)


def fold_ocr(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces: for comparison of names."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def quote_in(quote: Column, text: Column, head: int = 40) -> Column:
    """Whether a text has a quote, or its first ``head`` characters, whatever the spacing and case."""
    q, t = F.lower(squeeze(quote)), F.lower(squeeze(text))
    return (q != "") & (t.contains(q) | ((F.char_length(q) > head) & t.contains(F.substring(q, 1, head))))


def percentages(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), 1), lambda x: x.cast("double"))


def bounded(x: Column, digits: int) -> Column:
    """Rounding that gives the same double in every engine."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


# How a page's number is printed.
PRINTED = [r"^\s*(\d{1,4})\s*$", r"(?i)(?:page|p\.)\s*(\d{1,4})", r"-\s*(\d{1,4})\s*-", r"^\s*(\d{1,4})\s*/\s*\d{1,4}\s*$"]


def printed_page(text: Column, margin: float = 0.08) -> Column:
    """The number printed on a page: the most frequent one of the short lines in its head and foot
    (``margin`` of its lines, at least one, at either end); of equally frequent ones the smallest."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")
    reach = F.greatest(F.lit(1), F.floor(F.size(lines) * margin).cast("int"))
    band = F.concat(F.slice(lines, 1, reach), F.slice(lines, F.greatest(F.size(lines) - reach + 1, F.lit(1)), reach))
    band = F.filter(F.when(F.size(lines) > 2 * reach, band).otherwise(lines), lambda x: F.char_length(x) <= 30)
    number_in = lambda p: lambda x: F.regexp_extract(x, p, 1)
    numbers = F.concat(*[F.transform(band, number_in(p)) for p in PRINTED])
    numbers = F.filter(F.transform(numbers, lambda x: F.nullif(x, F.lit("")).cast("int")), lambda n: n.between(1, 9999))
    counted = F.transform(F.array_distinct(numbers), lambda n: F.struct((-F.size(F.filter(numbers, lambda m: m == n))).alias("k"), n.alias("n")))
    return F.array_min(counted)["n"]
