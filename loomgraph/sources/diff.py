"""Changed line ranges from a unified diff."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HUNK_SCHEMA = "file_path string, rng_start int, rng_end int"


def hunks(lines: DataFrame) -> DataFrame:
    """(file_path, rng_start, rng_end) from (diff, line_no, value): the lines of one or more diffs without
    context.  A hunk that only deletes has no range."""
    w = Window.partitionBy("diff").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("file_path", F.last(F.when(F.col("value").startswith("+++ b/"), F.substring("value", 7, 1 << 20)), ignorenulls=True).over(w))
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start, count = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    found = named.where(F.col("value").rlike(pattern) & F.col("file_path").isNotNull()).select("file_path", start.cast("int").alias("rng_start"), F.when(count == "", 1).otherwise(F.try_to_number(count, F.lit("999999999")).cast("int")).alias("n"))
    return found.where("n > 0").select("file_path", "rng_start", (F.col("rng_start") + F.col("n") - 1).alias("rng_end"))


def git_diff(spark: SparkSession, root: str, ref: str, timeout: int = 30) -> DataFrame:
    """Changed ranges of a working tree against a commit; none where git fails."""
    if ref.startswith("-"):
        raise ValueError("a ref can't begin with a dash")
    try:
        done = subprocess.run(["git", "diff", "--unified=0", "--no-color", ref], cwd=root, capture_output=True, text=True, timeout=timeout)
        text = done.stdout if done.returncode == 0 else ""
    except (OSError, subprocess.TimeoutExpired):
        text = ""
    rows = [(0, i, line) for i, line in enumerate(text.splitlines())]
    return hunks(spark.createDataFrame(rows, "diff int, line_no int, value string"))
