"""Calls of an outside model by content: each prompt is sent once to a model, and what it said is kept.

A reply is stored under the SHA-256 of the model's name and the prompt, so equal prompts of any table and any
run share one call. `CallTable.run` sends only prompts without a stored reply, in batches, from the tasks that
hold them, and commits replies and failures as one numbered segment. A batch that raises, or gives another
number of replies, becomes rows with its error and leaves other batches as they are; a reply that is null is a
failure too. Failures are tried again by the next run, up to ``tries`` times if that is given.

A task that is lost runs again and sends its batches again (the stored result is one all the same); a run that
dies before its commit has stored nothing. Of two runs at once the second commit fails, and its replies with it.
Null prompts are never sent and have no reply; empty ones are prompts like others. A run without a prompt to send
makes no commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.sources.commits import commit, latest
from saltern.sources.shared import new_path


def _sent(call: Callable[[list[str]], Sequence], batch: int, schema: pa.Schema):
    """(key, prompt) to (key, reply, error), one call for each ``batch`` prompts."""

    def rows(keys: list[str], prompts: list[str]) -> pa.RecordBatch:
        try:
            replies = list(call(prompts))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            got = pa.array(replies, schema.field("reply").type)
            errors = [None if r is not None else "no reply" for r in replies]
        except Exception as e:  # whatever the model's client raises: the row says it, and is tried again
            got, errors = pa.nulls(len(keys), schema.field("reply").type), [f"{type(e).__name__}: {e}"] * len(keys)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), got, pa.array(errors, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prompts = [], []
        for b in batches:
            keys += b.column("key").to_pylist()
            prompts += b.column("prompt").to_pylist()
            while len(keys) >= batch:
                yield rows(keys[:batch], prompts[:batch])
                keys, prompts = keys[batch:], prompts[batch:]
        if keys:
            yield rows(keys, prompts)

    return run


class CallTable:
    """Replies of one model in a folder of the shared file system. ``reply``: their Spark type."""

    def __init__(self, spark: SparkSession, path: str, model: str, reply: str = "string"):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.schema = f"key string, reply {reply}, error string"

    def key(self, prompt: Column) -> Column:
        """Null for a null prompt."""
        return F.sha2(F.concat(F.lit(f"{self.model}\0"), prompt), 256)

    def _stored(self) -> tuple[int, dict, DataFrame]:
        number, state = latest(self.spark, self.path)
        state = state or {"segments": []}
        paths = [f"{self.path}/{s}" for s in state["segments"]]
        return number, state, self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replies(self) -> DataFrame:
        """(key, reply) of prompts that have been answered."""
        return self._stored()[2].filter("error IS NULL").select("key", "reply")

    def failures(self) -> DataFrame:
        """(key, tries, error) of prompts without a reply, with one of their errors."""
        rows = self._stored()[2]
        return rows.groupBy("key").agg(F.count("*").alias("tries"), F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("good")).filter("good = 0").drop("good")

    def run(self, prompts: DataFrame, call: Callable[[list[str]], Sequence], batch: int = 32, prompt: str = "prompt", parallel: int = 8, tries: int | None = None) -> None:
        """Send what has no reply. ``call``: prompts of a batch to as many replies; ``parallel``: tasks that send at once."""
        number, state, stored = self._stored()
        own = prompts.select(F.col(f"`{prompt}`").cast("string").alias("prompt")).filter("prompt IS NOT NULL").select(self.key(F.col("prompt")).alias("key"), "prompt").dropDuplicates(["key"])
        own = own.join(stored.filter("error IS NULL").select("key"), "key", "left_anti")
        if tries is not None:
            own = own.join(self.failures().filter(F.col("tries") >= tries).select("key"), "key", "left_anti")
        name = new_path(self.spark, "calls").rpartition("/")[2]
        arrow = self.spark.createDataFrame([], self.schema).toArrow().schema
        own.repartition(parallel, "key").mapInArrow(_sent(call, batch, arrow), self.schema).write.parquet(f"{self.path}/{name}")
        if not self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").isEmpty():
            commit(self.spark, self.path, number + 1, {"segments": [*state["segments"], name]})

    def answered(self, rows: DataFrame, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
        """Rows with the stored replies to their prompts, null where there is none."""
        key = "saltern_call_key"
        known = self.replies().select(F.col("key").alias(key), F.col("reply").alias(reply))
        return rows.withColumn(key, self.key(F.col(f"`{prompt}`").cast("string"))).join(known, key, "left").drop(key)
