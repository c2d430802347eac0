"""A store of recipes whose parent and child tables change together.

Recipes and their lines lie in buckets by the hash of the recipe's id. A change reads only the buckets of the
ids that it touches and writes these anew, parents and children in one segment; one numbered commit then
names, for each bucket, the segment that holds it. So a reader sees a recipe with its old lines or with
its new ones, a writer that dies shows nothing, of two writers at once one fails, and buckets that a
change does not touch keep their files.

Further child tables (for example validation findings) are named with their schemas and change with
their recipe in the same way. `patch` changes columns of recipes and gives the changed recipes alone, with
their lines, to a validator, whose rows replace the recipes' rows in a child table in the same commit.

Defined results: recipes without an id and children without a recipe in the same upsert are left out; of
recipes of one id in one upsert the smallest row stays, with all children given for the id. An upsert replaces
all children of its recipes in all child tables; a recipe that comes without children has none. Changes to
recipes that the store does not have do nothing. An upsert without rows makes no commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.operators.catalog import patch as patched
from saltern.sources.commits import commit, latest
from saltern.sources.shared import drop_written, new_path, written

BUCKET, SEGMENT = "saltern_bucket", "saltern_segment"
PARENT = "recipes"


class RecipeStore:
    """``schema``: columns of recipes, with ``id``; ``children``: name to schema, each with ``formulation_id`` of the
    id's type. ``buckets`` holds for a new store; an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, children: dict[str, str], buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {PARENT: schema} | children
        self.buckets = (latest(spark, self.path)[1] or {"buckets": buckets})["buckets"]

    def _state(self) -> tuple[int, dict]:
        number, state = latest(self.spark, self.path)
        return number, state or {"buckets": self.buckets, "held": {}}

    def _key(self, name: str) -> str:
        return "id" if name == PARENT else "formulation_id"

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = state["held"] if buckets is None else {str(b): state["held"][str(b)] for b in buckets if str(b) in state["held"]}
        paths = [f"{self.path}/{name}/{SEGMENT}={s}/{BUCKET}={b}" for b, v in wanted.items() for s in [v["segment"]] if name in v["tables"]]
        schema = f"{self.schemas[name]}, {SEGMENT} string, {BUCKET} int"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.drop(SEGMENT, BUCKET)

    def _cast(self, name: str, rows: DataFrame) -> DataFrame:
        kind = self.spark.createDataFrame([], self.schemas[name]).schema
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind.fields])

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket("id")).distinct().collect()]  # at most ``buckets`` rows

    def _put(self, number: int, state: dict, buckets: list[int], tables: dict[str, DataFrame]) -> None:
        """Write the buckets anew as one segment, and commit."""
        segment = new_path(self.spark, "s").rpartition("/")[2]
        held = {b: v for b, v in state["held"].items() if int(b) not in set(buckets)}
        for name, rows in tables.items():
            where = f"{self.path}/{name}/{SEGMENT}={segment}"
            rows = rows.withColumn(BUCKET, self._bucket(self._key(name)))
            rows.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(where)
            written_ = self.spark.read.schema(f"{self.schemas[name]}, {BUCKET} int").parquet(where)
            for r in written_.groupBy(BUCKET).count().collect():
                held.setdefault(str(r[BUCKET]), {"segment": segment, "tables": {}})["tables"][name] = r["count"]
        commit(self.spark, self.path, number + 1, state | {"held": held})

    def upsert(self, recipes: DataFrame, **children: DataFrame) -> None:
        """Put recipes with their children in place of what the store has for their ids."""
        unknown = set(children) - set(self.schemas)
        if unknown:
            raise ValueError(f"no such child tables: {sorted(unknown)}")
        number, state = self._state()
        own = self._cast(PARENT, recipes).filter("id IS NOT NULL")
        rest = [c for c in own.columns if c != "id"]
        own = own.groupBy("id").agg(F.min(F.struct(*rest)).alias("row_")).select("id", "row_.*").select(*own.columns)
        own = written(own, "store-recipes")
        touched = self._touched(own)
        if not touched:
            drop_written(own)
            return
        keys = own.select("id")
        tables = {PARENT: self._read(PARENT, state, touched).join(keys, "id", "left_anti").unionByName(own)}
        for name in self.schemas:
            if name != PARENT:
                ids = keys.withColumnRenamed("id", "formulation_id")
                tables[name] = self._read(name, state, touched).join(ids, "formulation_id", "left_anti")
                if name in children:
                    tables[name] = tables[name].unionByName(self._cast(name, children[name]).join(ids, "formulation_id", "left_semi"))
        self._put(number, state, touched, tables)
        drop_written(own)

    def delete(self, keys: DataFrame) -> None:
        """Take recipes of ``keys`` (id) out, with all their children."""
        number, state = self._state()
        keys = self.read().join(keys.select("id").distinct(), "id", "left_semi").select("id")
        keys = written(keys, "store-keys")
        touched = self._touched(keys)
        if touched:
            tables = {}
            for name in self.schemas:
                ids = keys.withColumnRenamed("id", self._key(name))
                tables[name] = self._read(name, state, touched).join(ids, self._key(name), "left_anti")
            self._put(number, state, touched, tables)
        drop_written(keys)

    def patch(self, changes: DataFrame, validate: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = None, into: str | None = None) -> None:
        """Put the non-null values of ``changes`` (id and columns of recipes; an id once) in place of the
        recipes' own. ``validate`` takes the changed recipes and their children, and gives the rows of the child
        table ``into`` that replace theirs."""
        number, state = self._state()
        changes = changes.filter("id IS NOT NULL").dropDuplicates(["id"])
        changes = written(changes.join(self.read(), "id", "left_semi"), "store-changes")
        touched = self._touched(changes)
        if not touched:
            drop_written(changes)
            return
        keys = changes.select("id")
        ids = keys.withColumnRenamed("id", "formulation_id")
        before = {name: self._read(name, state, touched) for name in self.schemas}
        tables = before | {PARENT: self._cast(PARENT, patched(before[PARENT], changes, "id"))}
        if validate is not None:
            new = validate(tables[PARENT].join(keys, "id", "left_semi"), {name: rows.join(ids, "formulation_id", "left_semi") for name, rows in before.items() if name != PARENT})
            tables[into] = before[into].join(ids, "formulation_id", "left_anti").unionByName(self._cast(into, new))
        self._put(number, state, touched, tables)
        drop_written(changes)

    def clear(self) -> None:
        number, state = self._state()
        commit(self.spark, self.path, number + 1, state | {"held": {}})

    def read(self, name: str = PARENT) -> DataFrame:
        """All rows of a table, as of the last commit."""
        return self._read(name, self._state()[1])

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables as of one commit."""
        state = self._state()[1]
        return {name: self._read(name, state) for name in self.schemas}

    def get(self, keys: DataFrame) -> dict[str, DataFrame]:
        """Recipes of ``keys`` (id) and their children; only their buckets are read."""
        state, keys = self._state()[1], keys.select("id").distinct()
        touched = self._touched(keys)
        return {name: self._read(name, state, touched).join(keys.withColumnRenamed("id", self._key(name)), self._key(name), "left_semi") for name in self.schemas}

    def count(self) -> int:
        return sum(v["tables"].get(PARENT, 0) for v in self._state()[1]["held"].values())
