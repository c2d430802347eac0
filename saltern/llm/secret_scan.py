"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong spans stand alone: ``assign`` (a credential word, a sign and a value), ``access`` (a cloud
access key id) and ``hex`` (a long hexadecimal run). Weak parts do not: ``id`` (a user or client
name that is assigned), ``secret`` (a mixed run of 32 characters or more), ``endpoint`` (a URL, a
host with a port or an address). Weak parts are reported only when complementary parts co-occur:
an identifier (``access`` or ``id``) and a secret (``assign``, ``hex`` or ``secret``) of one scope
are linked, however far apart, and an endpoint of that scope belongs to them. A scope is a block
of text without a blank line.

Of each text only the lengths of matches and of the gaps between them are kept; running sums over
them give positions, and a running count of blank lines gives scopes, so a text with very many
spans costs no more than sorting them. The join is an equi-join on row and scope with the scopes
that hold both: rows grow with the spans, never with their pairs. The spans of one text come back
as an array, which is as large as the text at most.

Spans are ``kind:start:end`` in code points, the end exclusive. A null text counts as empty; an
empty text has no spans. Repeated rows, null ids and other columns (dropped, but for the id) are
fine: rows are told apart by a number given when the spans are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.llm.common import written

# The patterns by kind, in the order in which spans of one start are listed, and the
# least length of the group that must hold.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
WEAK = {
    "id": (r"""(?i)(client_?id|access_?key_?id|key_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    "secret": (r"[A-Za-z0-9+/=_-]{32,}", 0, 32),
    "endpoint": (r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+|[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+:[0-9]{2,5}""", 0, 6),
}
#: The same matches with the length in the pattern, so that most texts are passed over at once.
_QUICK = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}
BREAK = r"\n[\x20\t\r]*\n"
#: Reach in the query's SQL, which is fixed; the scan itself links whole scopes.
WINDOW = 400
KINDS = [*BASE, *WEAK]
SPANS = "array<struct<start:long,rank:int,end:long,kind:string>>"


PART = "array<struct<gap:long,len:long,good:boolean>>"


def _parts(text: Column, pattern: str, group: int = 0, good: Callable[[Column], Column] | None = None) -> Column:
    """For each match the length of the gap before it, its own length, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
    parts = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"))
    size = lambda x: F.char_length(x).cast("long")
    each = lambda x: F.struct(size(x["gap"]).alias("gap"), size(x["m"]).alias("len"), (good(x["v"]) if good else F.lit(True)).alias("good"))
    return F.when(text.rlike(pattern), F.transform(parts, each).cast(PART))


def _kind(text: Column, kind: str) -> Column:
    pattern, group, least = (BASE | WEAK)[kind]
    if kind == "secret":
        good = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    else:
        good = lambda v: F.char_length(v) >= least
    return _parts(text, _QUICK.get(kind, pattern), group, good)


def link(parts: DataFrame) -> DataFrame:
    """Weak parts that are linked. ``parts``: row, scope, start, end, rank, kind."""
    ids, secrets = F.col("kind").isin("access", "id"), F.col("kind").isin("assign", "hex", "secret")
    whole = parts.groupBy("row", "scope").agg(F.bool_or(ids).alias("ids"), F.bool_or(secrets).alias("secrets")).filter("ids AND secrets")
    return parts.filter(F.col("kind").isin(*WEAK)).join(whole.select("row", "scope"), ["row", "scope"], "left_semi")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the id, ``base`` and ``linked``: arrays of struct<start, rank, end, kind>."""
    text_ = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))
    rows = rows.select("id", "t", *[_kind(text_, k).alias(k) for k in BASE])
    good = lambda k: F.coalesce(F.exists(k, lambda x: x["good"]), F.lit(False))
    maybe = (good("access") | text_.rlike(WEAK["id"][0])) & (good("assign") | good("hex") | text_.rlike(WEAK["secret"][0]))
    rows = rows.withColumn("maybe", maybe)  # a column, so that its patterns run once
    weak = {k: F.when(F.col("maybe"), _kind(text_, k)) for k in WEAK}
    every = {k: F.col(k) for k in BASE} | weak | {"break": F.when(F.col("maybe"), _parts(text_, BREAK))}
    found = F.array_compact(F.array(*[F.when(at.isNotNull(), F.struct(F.lit(rank).alias("rank"), at.alias("at"))) for rank, at in enumerate(every.values())]))
    found = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "maybe", found.alias("found")), "secret-spans")

    parts = found.select("row", "maybe", F.explode("found").alias("f")).select("row", "maybe", "f.rank", F.posexplode("f.at").alias("pos", "x"))
    upto = F.sum(F.col("x.gap") + F.col("x.len")).over(Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("end", upto).filter("x.good").select("row", "maybe", "rank", (F.col("end") - F.col("x.len")).alias("start"), "end")
    blank = F.col("rank") == len(KINDS)
    before = F.count_if(blank).over(Window.partitionBy("row").orderBy("start", blank).rowsBetween(Window.unboundedPreceding, 0))
    kinds = F.array(*map(F.lit, [*KINDS, "break"]))
    parts = parts.withColumns({"scope": before, "kind": F.element_at(kinds, F.col("rank") + 1)}).filter(~blank)
    parts = written(parts, "secret-parts")
    spans = parts.filter(F.col("rank") < len(BASE)).select("row", F.struct("start", "rank", "end", "kind").alias("s"), F.lit(False).alias("weak"))
    spans = spans.unionByName(link(parts.filter("maybe")).select("row", F.struct("start", "rank", "end", "kind").alias("s"), F.lit(True).alias("weak")))
    pick = lambda weak: F.array_sort(F.collect_list(F.when(F.col("weak") == weak, F.col("s"))))
    spans = spans.groupBy("row").agg(pick(False).alias("base"), pick(True).alias("linked"))
    none = F.array().cast(SPANS)
    return found.select("row", "id").join(spans, "row", "left").select("id", F.coalesce("base", none).alias("base"), F.coalesce("linked", none).alias("linked"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, by start and then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
