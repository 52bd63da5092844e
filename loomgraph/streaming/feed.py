"""Change feed, debounce and incremental maintenance.

A file stream reports new paths only, an edit in place isn't reported.  So the feed polls the tree's
(path, modification time) and emits what differs from the snapshot before, by a Python data source.
"""

from __future__ import annotations

import fnmatch
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..session import shared_dir

CHANGE_SCHEMA = "path string, mtime double, deleted boolean"


class TreeReader(SimpleDataSourceStreamReader):
    """Offsets hold the last snapshot, so that a restarted query goes on from its checkpoint."""

    def __init__(self, options: dict):
        self.root, self.exclude = options["path"], [p for p in options.get("exclude", "").split(",") if p]

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _files(self) -> dict[str, float]:
        out = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                full = os.path.join(folder, name)
                rel = os.path.relpath(full, self.root).replace(os.sep, "/")
                if not any(fnmatch.fnmatch(rel, p) or fnmatch.fnmatch("/" + rel, p) for p in self.exclude):
                    try:
                        out[rel] = os.stat(full).st_mtime
                    except OSError:
                        continue
        return out

    @staticmethod
    def _changes(old: dict[str, float], new: dict[str, float]):
        rows = [(p, t, False) for p, t in sorted(new.items()) if old.get(p) != t]
        return rows + [(p, None, True) for p in sorted(set(old) - set(new))]

    def read(self, start: dict):
        now = self._files()
        return iter(self._changes(start["files"], now)), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._changes(start["files"], end["files"]))


class TreeSource(DataSource):
    """`spark.readStream.format("source_tree").option("path", folder)`; register it first."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return CHANGE_SCHEMA

    def simpleStreamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def change_feed(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("source_tree").option("path", root).option("exclude", ",".join(exclude)).load()


def debounce(changes: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """(key, started, changes, paths): bursts of changes in which no pause is as long as the gap.  On a
    stream the caller sets a watermark on ts first."""
    out = changes.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("changes"), F.approx_count_distinct("path").alias("paths") if changes.isStreaming else F.size(F.collect_set("path")).cast("long").alias("paths"))
    return out.select("key", F.col("w.start").alias("started"), "changes", "paths")


def merge_latest(current: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key; ties go to the row of the largest hash, so that a batch that is run again keeps the same."""
    both = current.unionByName(batch)
    tie = F.xxhash64(*(c for c, kind in both.dtypes if "map<" not in kind))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), tie.desc()))
    return both.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def upsert_stream(stream: DataFrame, folder: str, keys: list[str], order: str, on_update=None):
    """Starts a query that keeps the latest row of each key in folder/v<batch>.  Each version is the whole table, made
    from the version before; a batch that is run again writes its own version again.  The current one is that of the last batch."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        previous = f"{folder}/v{number - 1}"
        merged = merge_latest(spark.read.parquet(previous) if number else batch.limit(0), batch, keys, order)
        merged.write.mode("overwrite").parquet(f"{folder}/v{number}")
        if on_update:
            on_update(batch, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def replay_upsert(table: DataFrame, keys: list[str], order: str, batches: int) -> DataFrame:
    """Plays a table through upsert_stream in files of rising order; the last version."""
    spark = table.sparkSession
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/replay-{uuid.uuid4().hex}"
    table.repartitionByRange(batches, order).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    last = []
    query = upsert_stream(stream, f"{folder}/out", keys, order, lambda _, number: last.append(number))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{folder}/out/v{max(last)}") if last else table.limit(0)
