"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of a fixed number of characters.  The distinct blocks are sorted
and replaced by their rank, a positive integer name; then adjacent names are paired, the distinct pairs
are sorted and named in turn, and so on until each document has one name.  Equal names mean
equal texts and the reverse: contents are compared, never only hashes of them.

Only distinct blocks are ranked, and copies are folded before they are shuffled: blocks are grouped by a 64-bit hash,
and a group's least and greatest content are kept.  If the two are equal, all of the group's blocks are, and the hash
stands for the content from there on; where they differ, the hash has collided and its blocks are told apart by
content.  Names go back to the documents by a join on the hash, so text moves once, and of many copies of a
block one for each task.

Order of names: blocks and pairs are ordered by (64-bit hash, content).  Ranges of the hash are
the ranges of the sort, so no sample is needed to place them and they are of even size.  A rank doesn't depend on the number of
partitions.

Defined results: a null text has a null identity, is nobody's copy and is kept.  Empty texts are
equal to each other.  Rows with the same text and the same or a null doc_id are copies like
others: one row of each text is kept, that of the smallest doc_id (nulls last), and of rows that agree in both that of
the smallest hash of its other columns (maps aside).  Texts are compared whole, whatever their length.  No rows in, no
rows out.  Further columns, whatever their names, are kept as they are by `drop_exact_copies` and ignored by `exact_dedup`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, checkpoint, documents, partitions

BLOCK_CHARS = 4096
RID, POS, N, PID, NAME, TXT, H = (OWN + x for x in ("rid", "pos", "n", "pid", "name", "text", "h"))


def _ranked(distinct: DataFrame, order: list[str], base: int) -> tuple[DataFrame, int]:
    """Names distinct rows by their rank in the order of (H, *order), from base + 1 on.  Returns them with their names and the
    largest name."""
    ranges = 8 * partitions(distinct)
    step = (1 << 64) // ranges + 1
    # the top 31 bits of the hash, as a range number
    pid = (F.shiftrightunsigned(H, 33) / F.lit(float(step >> 33) + 1)).cast("int")
    named = checkpoint(distinct.withColumn(PID, pid).withColumn(NAME, F.row_number().over(Window.partitionBy(PID).orderBy(H, *order)).cast("long")))
    # one row for each range: their number is that of the partitions, not of the rows
    tops = [(r[0], r[1]) for r in named.groupBy(PID).agg(F.max(NAME)).collect()]
    offsets, top = [], base
    for p, m in sorted(tops):
        offsets.append((p, top))
        top += m
    off = F.broadcast(distinct.sparkSession.createDataFrame(offsets, f"{PID} int, {OWN}off long"))
    return named.join(off, PID).select(H, *order, (F.col(NAME) + F.col(OWN + "off")).alias(NAME)), top


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """(__lg_rid, __lg_id, __lg_h, __lg_name) for each row whose text isn't null; __lg_name is the
    identity of its text, __lg_h a hash of the text for joining back."""
    ident, text = OWN + "id", F.col(text_col).cast("string")
    cut = F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0)))
    keep = [RID, ident, OWN + "th", N, POS]
    blocks = (
        docs.where(F.col(text_col).isNotNull())
        .select(F.monotonically_increasing_id().alias(RID), F.col(id_col).alias(ident), F.xxhash64(text).alias(OWN + "th"), cut.alias(OWN + "b"))
        .select(RID, ident, OWN + "th", F.size(OWN + "b").alias(N), F.posexplode(OWN + "b").alias(POS, TXT))
        .withColumn(H, block_hash(TXT))
    )
    seen = checkpoint(blocks.groupBy(H).agg(F.min(TXT).alias("lo"), F.max(TXT).alias("hi")).select(H, (F.col("lo") == F.col("hi")).alias("same")))
    distinct = seen.where("same").select(H, F.lit(None).cast("string").alias(TXT))
    clash = seen.where("not same").select(F.col(H).alias(OWN + "c"))
    if clash.isEmpty():
        rows = blocks.select(*keep, H, F.lit(None).cast("string").alias(TXT))
    else:  # only these blocks carry their content on
        distinct = distinct.unionByName(blocks.join(clash, F.col(H) == F.col(OWN + "c"), "left_semi").select(H, TXT).distinct())
        rows = blocks.join(clash, F.col(H) == F.col(OWN + "c"), "left").select(*keep, H, F.when(F.col(OWN + "c").isNotNull(), F.col(TXT)).alias(TXT))
    rows = checkpoint(rows)  # row numbers are given once
    names, top = _ranked(distinct, [TXT], 0)
    names = names.withColumnsRenamed({H: OWN + "nh", TXT: OWN + "nt"})
    level = checkpoint(rows.join(names, (F.col(H) == F.col(OWN + "nh")) & F.col(TXT).eqNullSafe(F.col(OWN + "nt"))).select(*keep, NAME))
    done = level.where(F.col(N) == 1)
    longest = level.agg(F.max(N)).head()[0] or 1
    left, right = OWN + "l", OWN + "r"
    while longest > 1:
        half = F.floor(F.col(POS) / 2).cast("int")
        pairs = (
            level.where(F.col(N) > 1)
            .groupBy(RID, ident, OWN + "th", N, half.alias(POS))
            .agg(F.max(F.when(F.col(POS) % 2 == 0, F.col(NAME))).alias(left), F.coalesce(F.max(F.when(F.col(POS) % 2 == 1, F.col(NAME))), F.lit(0)).alias(right))
            .withColumn(N, F.ceil(F.col(N) / 2).cast("int"))
        )
        names, top = _ranked(pairs.select(left, right).distinct().withColumn(H, F.xxhash64(left, right)), [left, right], top)
        level = checkpoint(pairs.join(names, [left, right]).select(*keep, NAME))
        done = done.unionByName(level.where(F.col(N) == 1))
        longest = (longest + 1) // 2
    return done.select(RID, ident, F.col(OWN + "th").alias(H), NAME)


def _stays(named: DataFrame) -> DataFrame:
    """(__lg_name, __lg_stay): the first row of each text as (no id, id, row)."""
    ident = OWN + "id"
    return named.groupBy(NAME).agg(F.min(F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col(RID).alias("rid"))).alias(OWN + "stay"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document: doc_id, identity (null for a null text), keep_doc_id (the doc_id
    whose row stays for this text) and keep."""
    stay = F.col(OWN + "stay")
    named = identities(docs, id_col, text_col, block)
    out = named.join(_stays(named), NAME).select(F.col(OWN + "id").alias("doc_id"), F.col(NAME).alias("identity"), stay["id"].alias("keep_doc_id"), (F.col(RID) == stay["rid"]).alias("keep"))
    nulls = docs.where(F.col(text_col).isNull()).select(F.col(id_col).alias("doc_id"), F.lit(None).cast("long").alias("identity"), F.col(id_col).alias("keep_doc_id"), F.lit(True).alias("keep"))
    return out.unionByName(nulls)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_CHARS) -> DataFrame:
    """The documents without exact copies, with their columns."""
    ident, key = OWN + "id", [OWN + "k", OWN + "nk", H]
    named = identities(docs, id_col, text_col, block)
    text_key = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(key[0]), F.col(c).isNull().alias(key[1])]
    rows = checkpoint(named.join(_stays(named), NAME).select(*text_key(ident), H, (F.col(RID) == F.col(OWN + "stay")["rid"]).alias(OWN + "first"), F.col(ident).eqNullSafe(F.col(OWN + "stay")["id"]).alias(OWN + "own")))
    kept = rows.where(OWN + "first").select(*key)
    again = rows.where(F.col(OWN + "own") & ~F.col(OWN + "first")).select(*key).distinct()  # rows that repeat both doc_id and text of one that stays
    keyed = docs.where(F.col(text_col).isNotNull()).select("*", *text_key(id_col), F.xxhash64(F.col(text_col).cast("string")).alias(H))
    out = keyed.join(kept, key, "left_semi")
    if not again.isEmpty():
        plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        once, first = out.join(again, key, "left_anti"), F.xxhash64(*plain)
        several = out.join(again, key, "left_semi").withColumn(OWN + "rn", F.row_number().over(Window.partitionBy(*key).orderBy(first))).where(F.col(OWN + "rn") == 1).drop(OWN + "rn")
        out = once.unionByName(several)
    return out.drop(*key).unionByName(docs.where(F.col(text_col).isNull()))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the document that stays for its text.  The identity itself is a rank among hashes, which says nothing to a
    reader, so the text is named after the document that stays ("n17"; as text, since numbers in the result are doc_ids)."""
    found = exact_dedup(documents(spark, sf_dir))
    name = F.when(F.col("identity").isNotNull(), F.concat(F.lit("n"), F.col("keep_doc_id")))
    return found.select("doc_id", name.alias("text_name"), "keep_doc_id", "keep")


ORACLE_SQL = """
SELECT doc_id,
  CASE WHEN text IS NOT NULL THEN 'n' || CAST(min(doc_id) OVER (PARTITION BY text) AS VARCHAR) END AS text_name,
  CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_doc_id,
  text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS keep
FROM documents
"""
