"""Exact deduplication with stateful streaming.

Each row arrives as (locator, id, digest, length); the locator is the file and row index that hold
its text. A streaming aggregation keyed by digest keeps, in a RocksDB state store without expiry,
the number of rows and the stable row: most code points, then smallest id, then first locator.
The state lives on the executors' disks and in the shared folder, so a later run with the same
``state_dir`` takes up only the new arrivals: rows whose locators have not arrived yet. So a run
that failed, before or after its arrivals were written, is simply tried again. (Input that is not
read from files gets locators of its own in each run, and so arrives anew.) On hits, that is digests with more than one row, the
rows' whole normalised texts are read again through their locators and the smallest and largest
text of each digest are compared byte by byte; as both are pre-aggregated before the shuffle, a hot
group sends one row a task. Rows of a digest with different texts are grouped by their texts.

Texts are equal when identical without the characters `[\\x20\\x09-\\x0D]`; a null text counts as
empty. Null ids come after all others. Of repeated rows, one is kept. Input columns other than id
and text are not looked at: inputs are renamed by position, so columns of any name, also
``_metadata``, names with a dot and repeated names, come back as they were. Everything is DataFrame
operations.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.llm.common import delete, drop_written, exists, new_path, written
from saltern.sources.shared import disk_state

#: A micro-batch takes up so many arrival files at most.
FILES_PER_TRIGGER = 10_000
#: Rows of hit groups (about 400 bytes each, so 40 MB) up to which their locators are broadcast to
#: the second scan; with more, the scan's rows are shuffled to them instead.
BROADCAST_ROWS = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def position(columns: list[str], name: str) -> str:
    """The name that `located` gives the column ``name``."""
    same = [k for k, c in enumerate(columns) if c == name] or [k for k, c in enumerate(columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name} among {columns}")
    return f"c{same[0]}"


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed by position, c0 and so on, and its rows' locators as a struct
    ``saltern_at``; rows without one are written first."""
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = lambda df: df.withColumn("saltern_at", F.struct(*[df.metadataColumn("_metadata")[x].alias(y) for x, y in (("file_path", "file"), ("row_index", "row"))]))
    try:
        return at(rows)
    except AnalysisException:
        return at(written(rows, "dedup-input"))


def spot(at: str = "saltern_at") -> Column:
    """A locator as one number; the row index tells the rare equal ones apart."""
    return F.xxhash64(f"{at}.file", f"{at}.row")


def without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` of `located`, under their own names ``columns``, without those whose locators ``gone.at`` has."""
    gone = written(gone.select(spot("at").alias("saltern_spot"), F.col("at.row").alias("saltern_row")), "dedup-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    rows = rows.withColumns({"saltern_spot": spot(), "saltern_row": F.col("saltern_at.row")})
    return rows.join(gone, ["saltern_spot", "saltern_row"], "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def _stream(spark: SparkSession, arrivals: str, schema, state_dir: str) -> DataFrame:
    """Take the new arrivals up into the RocksDB state; the state as a table."""
    with disk_state(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(arrivals)
        best = F.min(F.struct((-F.col("points")).alias("rank"), F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("at").alias("at")))
        query = (
            stream.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best"))
            .writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{state_dir}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(f"{state_dir}/state")
        names = [f.name for f in state.schema["value"].dataType.fields]
        state = state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{names[0]}`").alias("n"), F.col(f"value.`{names[1]}`").alias("best"))
        return written(state, "dedup-state")  # read from the store once


def _hit_texts(rows: DataFrame, arrivals: DataFrame, state: DataFrame) -> DataFrame:
    """Locator, id, digest and normalised text of every row whose digest has several."""
    hits = arrivals.join(state.filter("n > 1").select("digest"), "digest", "left_semi").select("at", "digest")
    texts = rows.select(F.col("saltern_at").alias("at"), "id", "text")
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return texts.join(hits, "at").select("at", "id", "digest", F.coalesce(F.col("text"), F.lit("")).alias("text"), normalised(F.col("text")).alias("own"))


def _decide(rows: DataFrame, digest, state_dir: str, reread) -> DataFrame:
    """``rows``: saltern_at, id, text. ``reread`` gives such rows of the files that earlier arrivals name."""
    spark = rows.sparkSession
    own, points = normalised(F.col("text")), F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    new = rows.select(F.col("saltern_at").alias("at"), "id", digest(own).alias("digest"), points.alias("points"))
    if exists(spark, f"{state_dir}/arrivals"):  # a row arrives once, however often a run is tried again
        known = spark.read.schema(new.schema).parquet(f"{state_dir}/arrivals").select(F.col("at").alias("known"))
        new = new.join(known, spot("at").eqNullSafe(spot("known")) & (F.col("at") == F.col("known")), "left_anti")
    new.write.mode("append").parquet(f"{state_dir}/arrivals")
    arrivals = spark.read.schema(new.schema).parquet(f"{state_dir}/arrivals")
    state = _stream(spark, f"{state_dir}/arrivals", new.schema, state_dir)

    files = arrivals.select("at.file").distinct().join(rows.select("saltern_at.file").distinct(), "file", "left_anti")
    if earlier := [r["file"] for r in files.collect()]:  # as many as the scan's own file listing holds
        rows = rows.unionByName(reread([unquote(f) for f in earlier]))  # locators name files as URLs do
    hits = _hit_texts(rows, arrivals, state)
    bounds = hits.groupBy("digest").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    differing = written(bounds.filter("low <> high").select("digest"), "dedup-differing")

    kept = (F.col("at") == F.col("best.at")).alias("kept")
    final = ["at", "id", "digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), kept]
    out = arrivals.join(state, "digest").select(*final)
    if differing.isEmpty():
        drop_written(differing)
        return out
    apart = written(hits.join(differing, "digest", "left_semi"), "dedup-apart")
    best = F.min(F.struct((-F.char_length("text")).alias("rank"), F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("at").alias("at")))
    by_text = apart.groupBy("own").agg(F.count("*").alias("n"), best.alias("best"))
    return out.join(differing, "digest", "left_anti").unionByName(apart.join(by_text, "own").select(*final))


def _columns(rows: DataFrame, columns: list[str], key: str, text: str) -> DataFrame:
    return rows.select("saltern_at", F.col(position(columns, key)).alias("id"), F.col(position(columns, text)).alias("text"))


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, state_dir: str | None = None) -> DataFrame:
    """One row for each row that has arrived: ``at`` (locator), ``id``, ``digest``, ``keep_id``,
    ``group_size`` and ``kept``. ``digest`` maps the normalised text to a string. With the
    ``state_dir`` of earlier runs, their rows count too."""
    spark = docs.sparkSession
    own = lambda df: _columns(located(df), df.columns, key, text)
    return _decide(own(docs), digest, state_dir or new_path(spark, "dedup"), lambda files: own(spark.read.parquet(*files)))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """``docs`` without the rows that are copies of the one that stays."""
    rows, state_dir = located(docs), new_path(docs.sparkSession, "dedup")
    found = _decide(_columns(rows, docs.columns, key, text), digest, state_dir, None)
    out = without(rows, found.filter(~F.col("kept")), docs.columns)
    delete(docs.sparkSession, state_dir)  # the decisions are written by now
    return out
