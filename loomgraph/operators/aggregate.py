"""Grouped statistics of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def stats(symbols: DataFrame, edges: DataFrame, data_models: DataFrame) -> DataFrame:
    """One row: symbols, edges, unresolved edges and data models."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("target_id").isNull()).alias("unresolved"))
    return one(symbols, "symbols").crossJoin(e).crossJoin(one(data_models, "data_models"))


def by_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "id", "name"))), lambda x: x["name"]), ",").alias("names"))


def module_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts for each module (first folder of the file) of its nodes and of the edges from them."""
    module = C.module_key(F.col("file_path")).alias("module")
    count = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    n = nodes.groupBy(module).agg(
        F.count(F.lit(1)).alias("total"), count(F.col("is_entry_point"), "entries"), *(count(F.col("kind") == k, a) for k, a in (("class", "classes"), ("function", "functions"), ("method", "methods"))),
        count(F.col("framework").isNotNull(), "models"),
    )
    s = nodes.select(F.col("id").alias("source_id"), module)
    e = edges.join(s, "source_id").groupBy("module").agg(*(count(F.col("edge_type") == k, k) for k in ("reads", "writes", "calls")))
    return n.join(e, "module", "left").select("module", "total", "entries", "classes", "functions", "methods", "models", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("reads", "writes", "calls")))


def verb_counts(symbols: DataFrame) -> DataFrame:
    """For each module how many functions have a CRUD verb among the words of their name."""
    fns = symbols.where(F.col("kind").isin("function", "method")).select(C.module_key(F.col("file_path")).alias("module"), F.explode(C.name_words(F.col("name"))).alias("verb"))
    return fns.where(F.col("verb").isin(*C.CRUD_VERBS)).groupBy("module", "verb").agg(F.count(F.lit(1)).alias("functions"))


def top_verbs(verbs: DataFrame, k: int = 3) -> DataFrame:
    """Sum of each module's k most frequent verbs."""
    w = Window.partitionBy("module").orderBy(F.desc("functions"), "verb")
    return verbs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).groupBy("module").agg(F.sum("functions").alias("crud"))


def narratives(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, narrative): what a module is for, by the first rule that holds."""
    p = module_profile(nodes, edges).join(top_verbs(verb_counts(nodes)), "module", "left").withColumn("crud", F.coalesce("crud", F.lit(0)))
    total, entries, classes, low = F.col("total"), F.col("entries"), F.col("classes"), F.lower("module")
    text = None
    for label, parts in C.MODULE_LABELS:
        value = C.summary(F.lit(label), total, entries, classes)
        hit = low.rlike("|".join(parts.split()))
        text = F.when(hit, value) if text is None else text.when(hit, value)
    access = F.col("reads") + F.col("writes")
    text = (
        text.when((F.col("crud") > 0) & (F.col("crud") > (F.col("functions") + F.col("methods")) * 0.3), C.summary(F.lit("data access layer (CRUD operations)"), total, entries, classes))
        .when((access > F.col("calls") * 0.5) & (access > 2), C.summary(F.lit("data processing (heavy read/write)"), total, entries, classes))
        .when((entries > total * 0.3) & (entries >= 2), C.summary(F.lit("API endpoint handlers"), total, entries, classes))
        .when(F.col("models") > total * 0.3, C.summary(F.lit("data model definitions"), total, entries, F.col("models")))
        .when(classes > F.col("functions"), F.format_string("Object-oriented module with %d classes and %d methods.", "classes", "methods"))
        .when(F.col("functions") > 0, F.format_string("Module with %d functions and %d classes.", "functions", "classes"))
    )
    return p.select("module", text.alias("narrative")).where("narrative is not null")


def simple_digraph(view: DataFrame) -> DataFrame:
    """Distinct (src, dst) of an edge view with both ends named."""
    return view.select(F.col("source_qualified_name").alias("src"), F.col("target_qualified_name").alias("dst")).where("src <> '' and dst <> ''").distinct()


def weighted_digraph(edges: DataFrame) -> DataFrame:
    """Resolved edges with parallel ones added up."""
    return edges.where("target_id is not null").groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.sum("confidence").alias("weight"))


def out_weights(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("src").agg(F.sum("weight").alias("out_weight"))


def external_targets(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Node names: all qualified names and the raw text of targets that aren't one."""
    own = symbols.select(F.col("qualified_name").alias("node"), F.col("kind"))
    foreign = edges.where("target_id is null").select(F.col("target_name").alias("node")).distinct().join(own, "node", "left_anti").withColumn("kind", F.lit("external"))
    return own.unionByName(foreign).distinct()


def nth_largest(counts: DataFrame, column: str, share: float) -> DataFrame:
    """One row: the value at place min(max(1, floor(share * n)), n - 1), from 0, of the values in falling
    order.  Values are counted first, so that the sort is over distinct values."""
    values = counts.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = values.agg(F.sum("c").alias("n"))
    upto = values.withColumn("upto", F.sum("c").over(Window.orderBy(F.desc("v"))))
    place = F.least(F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("n") - 1)
    return upto.crossJoin(F.broadcast(total)).where(F.col("upto") > place).agg(F.max("v").alias("threshold"))
