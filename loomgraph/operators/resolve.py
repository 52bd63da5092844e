"""Reference resolution and read/write inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .lookup import without_builtins

MAX_BROADCAST_MODELS = 20_000


def exact(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edge_id, target_id): targets that are a qualified name; the last of equal names."""
    names = symbols.groupBy(F.col("qualified_name").alias("target_name")).agg(F.max("id").alias("target_id"))
    return edges.select("edge_id", "target_name").join(names, "target_name").select("edge_id", "target_id", F.lit(1.0).alias("confidence"))


def ranked(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edge_id, target_id, confidence) by short name: the only candidate 0.9, else the first of the
    source's file 0.9, else the first 0.7.

    A name's candidates are reduced before the join to the first one, to how many they are and to the first
    of each file, so that a name with many symbols doesn't multiply the edges."""
    named = symbols.groupBy("name").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    local = symbols.groupBy(F.col("name").alias("l_name"), F.col("file_path").alias("l_file")).agg(F.min("id").alias("local_id"))
    source = symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("s_file"))
    e = edges.select("edge_id", "source_id", C.last_part(F.col("target_name")).alias("short")).join(source, "source_id", "left")
    e = e.join(named, e.short == named.name).join(local, (e.short == local.l_name) & (e.s_file == local.l_file), "left")
    sure = (F.col("n") == 1) | F.col("local_id").isNotNull()
    return e.select("edge_id", F.coalesce(F.when(F.col("n") > 1, F.col("local_id")), F.col("first_id")).alias("target_id"), F.when(sure, 0.9).otherwise(0.7).alias("confidence"))


def suffix(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edge_id, target_id): the first symbol whose qualified name ends with '.' and the target.  The
    suffixes of a name are exploded, which makes it an equi join."""
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    s = symbols.where(F.col("qualified_name").contains(".")).select("id", F.explode(tails).alias("target_name")).groupBy("target_name").agg(F.min("id").alias("target_id"))
    return edges.select("edge_id", "target_name").join(s, "target_name").select("edge_id", "target_id", F.lit(0.8).alias("confidence"))


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """All edges with target_id and confidence: builtins stay open, then exact, ranked and suffix in this
    order; what is left open has 0.5.  Always from scratch: earlier results play no part."""
    open_ = edges.drop("target_id", "confidence")
    tried = without_builtins(open_)
    found = exact(tried, symbols).withColumn("tier", F.lit(1)).unionByName(ranked(tried, symbols).withColumn("tier", F.lit(2))).unionByName(suffix(tried, symbols).withColumn("tier", F.lit(3)))
    best = found.groupBy("edge_id").agg(F.min(F.struct("tier", "target_id", "confidence")).alias("b")).select("edge_id", "b.target_id", "b.confidence")
    return open_.join(best, "edge_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def infer_access(symbols: DataFrame, data_models: DataFrame, strict: bool = False) -> DataFrame:
    """(source_id, target_id, target_name, edge_type, confidence): reads and writes between functions and
    data models, guessed from names and signatures; writes first.  Models of one name are one, the last."""
    fns = symbols.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("source_id"), "name", "signature")
    m = data_models.join(symbols, data_models.symbol_id == symbols.id).groupBy(F.col("name").alias("target_name")).agg(F.max("symbol_id").alias("target_id"))
    if m.count() <= MAX_BROADCAST_MODELS:  # else Spark decides how to run the theta join
        m = F.broadcast(m)
    w = C.writes_model(F.col("name"), F.col("signature"), F.col("target_name"), strict)
    r = C.reads_model(F.col("name"), F.col("signature"), F.col("target_name"), strict)
    return fns.join(m, w | r).select("source_id", "target_id", "target_name", F.when(w, "writes").otherwise("reads").alias("edge_type"), F.lit(0.8).alias("confidence"))
