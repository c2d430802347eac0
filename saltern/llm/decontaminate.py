"""Benchmark decontamination: training documents are scanned for the word n-grams of test items.

Texts are lower-cased (A-Z only) and cut into words, runs of letters, digits and characters beyond
ASCII. A window is ``n`` consecutive words of an item; an item of fewer words is one window. Of any
window of L words in a document, just one word with an index divisible by s = ceil(L / 2) is the
first of L - s + 1 words that the window has whole. So documents are looked at in steps of s words:
the hash of the words from there on is looked up in a set of the hashes of all such parts of all
windows, which is broadcast. What is found is verified: the s windows around it are joined with
the test windows as whole strings. So only verified windows and one row a document are shuffled, by
the document's locator, and no text is.

Windows are broadcast ``BROADCAST_BYTES`` at a time: a larger benchmark is cut into blocks by hash,
each of which scans the documents. Of items with one window in common, a hit carries the list of
their ids, made once a window.

Defined results: a null or empty text has no words and no hits; null and empty items have no
windows. An item without an id taints documents but is not listed; items that share an id are one.
Repeated documents each get a row. Other columns come back as they were, whatever their names.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import drop_written, written
from saltern.llm.exact_dedup import located, position, spot

WINDOW = 10
#: Windows' bytes up to which they are broadcast at once.
BROADCAST_BYTES = 32 << 20

#: What identifies a document's rows, and its id.
OWN = ["spot", "row", "id", "n_words"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A character of a word, and one between words.
WORD, OTHER = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    """A-Z in lower case; by the faster `lower` where no other character has a case to lose."""
    others = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(others) == others, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}++"), F.lit(0))


def _starts(count: Column, step: int = 1) -> Column:
    """0, step, 2 * step and so on, below count."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _stride(length):
    """The step, of a length as a number or a column."""
    return (length + 1) // 2 if isinstance(length, int) else F.shiftright(length + 1, 1)


def windows(items: DataFrame, n: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """``hash``, ``window``, ``length`` and the sorted ``items`` (ids as strings) of each distinct window."""
    rows = items.select(F.col(f"`{key}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    own = F.transform(_starts(F.size("words") - length + 1), lambda k: F.array_join(F.slice("words", k + 1, length), " "))
    rows = rows.select("item", length.alias("length"), F.explode(F.array_distinct(own)).alias("window"))
    rows = rows.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.select(F.xxhash64("window").alias("hash"), "window", "length", "items")


def _looks(length: int) -> Column:
    """The places at which a document is looked at for windows of ``length`` words, each with the
    words of all windows that it stands for."""
    step = _stride(length)
    before = lambda at: F.least(at, F.lit(step - 1))
    return F.transform(_starts(F.size("words") - (length - step), step), lambda at: F.struct(F.lit(length).alias("length"), at.alias("at"), F.slice("words", at - before(at) + 1, before(at) + length).alias("part")))


def _parts(found: DataFrame) -> DataFrame:
    """``hash`` of each part of a window by which the window is found."""
    split = F.split("window", " ")
    step = _stride(F.col("length"))
    own = F.transform(F.sequence(F.lit(0), step - 1), lambda k: F.xxhash64("length", F.slice(split, k + 1, F.col("length") - step + 1)))
    return found.select(F.explode(own).alias("hash")).distinct()


def _scan(rows: DataFrame, found: DataFrame, lengths: list[int], documents: bool) -> DataFrame:
    """Windows of ``rows`` that ``found`` has: `OWN`, pos, length, items. With ``documents``, a row for
    each document too, whose pos is -1."""
    looks = [_looks(n) for n in lengths]
    if documents:
        looks.append(F.array(F.struct(F.lit(0).alias("length"), F.lit(-1).alias("at"), F.array().cast("array<string>").alias("part"))))
    if not looks:
        looks = [F.array().cast("array<struct<length:int,at:int,part:array<string>>>")]
    rows = rows.withColumn("words", words(F.col("text"))).withColumn("n_words", F.size("words"))
    rows = rows.select(*OWN, F.explode(F.concat(*looks)).alias("x")).select(*OWN, "x.length", "x.at", "x.part")
    step = _stride(F.col("length"))
    before = F.least(F.col("at"), step - 1)
    rows = rows.withColumn("hash", F.when(F.col("at") >= 0, F.xxhash64("length", F.slice("part", before + 1, F.col("length") - step + 1))))
    parts = _parts(found).withColumn("known", F.lit(True))
    rows = rows.join(F.broadcast(parts), "hash", "left").filter("known OR at = -1")
    whole = F.transform(F.sequence(F.lit(0), before), lambda k: F.struct((F.col("at") - k).alias("pos"), F.array_join(F.slice("part", before - k + 1, F.col("length")), " ").alias("window")))
    whole = F.when(F.col("at") >= 0, whole).otherwise(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("window"))))
    rows = rows.select(*OWN, F.explode(whole).alias("w")).select(*OWN, "w.pos", "w.window")
    return rows.join(F.broadcast(found.select("window", "length", "items")), "window", "left").filter("length IS NOT NULL OR pos = -1").drop("window")


def _hits(rows: DataFrame, items: DataFrame, n: int, item_key: str, item_text: str) -> tuple[DataFrame, list[DataFrame]]:
    """`OWN`, ``hit`` (sorted indices of hit words) and ``items`` of ``rows`` (spot, row, id, text)."""
    found = written(windows(items, n, item_key, item_text), "leak-windows")
    size = found.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 64), F.lit(0)).alias("bytes"), F.collect_set("length").alias("lengths")).first()
    lengths = sorted(size["lengths"])  # at most n of them
    blocks = max(1, -(-size["bytes"] // BROADCAST_BYTES))
    parts = [_scan(rows, found.filter(F.pmod("hash", F.lit(blocks)) == k) if blocks > 1 else found, lengths, k == 0) for k in range(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    hit = F.when(F.col("pos") >= 0, F.struct("pos", "length"))
    every = every.groupBy("spot", "row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.collect_list(hit).alias("at"), F.collect_set("items").alias("items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["length"] - 1)))))
    return every.select(*OWN, covered.alias("hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")), [found]


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document: ``id``, ``n_words``, ``hit`` (indices of the words within an item's window)
    and ``items`` (sorted ids, as strings, of the items with such windows)."""
    rows = located(docs)
    own = rows.select(spot().alias("spot"), F.col("saltern_at.row").alias("row"), F.col(position(docs.columns, key)).alias("id"), F.col(position(docs.columns, text)).alias("text"))
    return _hits(own, items, n, item_key, item_text)[0].drop("spot", "row")


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", n: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without documents that have hits (``remove="documents"``), or with hit words, each up to
    the next word, taken out of their texts (``remove="spans"``). Other texts are left as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    rows, body = located(docs), position(docs.columns, text)
    rows = rows.withColumns({"spot": spot(), "row": F.col("saltern_at.row")})
    hits, tables = _hits(rows.select("spot", "row", F.lit(0).alias("id"), F.col(body).alias("text")), items, n, item_key, item_text)
    hits = written(hits.filter(F.size("hit") > 0).select("spot", "row", "hit"), "leak-hits")
    drop_written(*tables)
    columns = lambda df: df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
    if remove == "documents":
        return columns(rows.join(hits, ["spot", "row"], "left_anti"))
    rows = rows.join(hits, ["spot", "row"], "left")
    head = F.regexp_extract(body, f"^{OTHER}*", 0)
    pieces = F.regexp_extract_all(body, F.lit(f"({WORD}+{OTHER}*)"), F.lit(1))
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("hit"))
    clean = F.concat(head, F.array_join(F.transform(left, lambda k: F.get(pieces, k)), ""))
    return columns(rows.withColumn(body, F.when(F.col("hit").isNull(), F.col(body)).otherwise(clean)))
