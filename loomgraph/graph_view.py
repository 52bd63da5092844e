"""A property graph over the driver's relational tables.

Parts are symbols, consecutive lines of an order are edges.  The order of an order's lines is a computed
ordinal, as (l_orderkey, l_linenumber) isn't unique.  GRAPH_SQL is the same view as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C

_LANGUAGES = ("python", "typescript", "go", "java", "rust", "ruby")
_BASES = ("BaseModel", "Base", "ApplicationRecord", "Object")
_DECORATORS = ("@dataclass(frozen=True)", "@Entity", "derive(Serialize)", "@app.route(x)", "@cached")
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_discount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], number):
    out = F.when(number == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(number == k, v)
    return out


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(F.col("p_type") == "PROMO", "class").when(F.col("p_type") == "STANDARD", "interface").when(F.col("p_type") == "ECONOMY", "method").otherwise("function")
    name = F.col("p_name")
    return p.select(
        key.alias("id"), name.alias("name"), F.concat_ws(".", "p_brand", "p_type", "p_name").alias("qualified_name"), kind.alias("kind"), F.col("p_brand").alias("file_path"),
        key.cast("int").alias("line_start"), (key + F.col("p_size")).cast("int").alias("line_end"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("(x: "), name, F.lit(")"))).otherwise(F.concat(F.lit("() -> "), name)).alias("signature"),
        _pick(_LANGUAGES, key % 6).alias("language"), F.array(_pick(_BASES, key % 4)).alias("bases"), F.array(_pick(_DECORATORS, key % 5)).alias("decorators"),
        (F.col("p_size") == 1).alias("is_entry_point"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).cast("long")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_discount", line.alias("ln"), F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).alias("to"), F.lead("l_discount").over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).alias("to_discount"))
    near = li.where((F.col("l_quantity") >= 40) & F.col("to").isNotNull())
    named = near.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("to"), "p_name"), "to")
    return named.select(
        (F.col("l_orderkey") * 1000 + F.col("ln")).alias("edge_id"), F.col("l_partkey").alias("source_id"), F.col("p_name").alias("target_name"),
        F.when(F.col("to") % 17 != 0, F.col("to")).alias("target_id"),
        F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "reads").otherwise("writes").alias("edge_type"),
        F.when(F.col("to_discount") >= 0.05, 0.9).otherwise(0.7).alias("confidence"),
    )


def data_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    found = s.select(F.col("id").alias("symbol_id"), C.framework(F.col("language"), F.col("kind"), F.col("bases"), F.col("decorators")).alias("framework"))
    return found.where("framework is not null")


def _case(values: tuple[str, ...], number: str) -> str:
    return "case " + number + " " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


GRAPH_SQL = f"""
with recursive sym as (
  select p_partkey id, p_name as name, p_brand || '.' || p_type || '.' || p_name qualified_name,
    case p_type when 'PROMO' then 'class' when 'STANDARD' then 'interface' when 'ECONOMY' then 'method' else 'function' end kind,
    p_brand file_path, p_partkey line_start, p_partkey + p_size line_end,
    case when p_size % 2 = 0 then '(x: ' || p_name || ')' else '() -> ' || p_name end signature,
    {_case(_LANGUAGES, "p_partkey % 6")} "language", {_case(_BASES, "p_partkey % 4")} base, {_case(_DECORATORS, "p_partkey % 5")} decorator,
    p_size = 1 is_entry_point
  from part
), li as (
  select l_orderkey, l_partkey, l_quantity, l_returnflag, l_discount,
    row_number() over (partition by l_orderkey order by {", ".join(_ORDER)}) ln
  from lineitem
), edg as (
  select a.l_orderkey * 1000 + a.ln edge_id, a.l_partkey source_id, p.p_name target_name,
    case when b.l_partkey % 17 = 0 then null else b.l_partkey end target_id,
    case a.l_returnflag when 'A' then 'calls' when 'N' then 'reads' else 'writes' end edge_type,
    case when b.l_discount >= 0.05 then 0.9 else 0.7 end confidence
  from li a join li b on a.l_orderkey = b.l_orderkey and b.ln = a.ln + 1 join part p on p.p_partkey = b.l_partkey
  where a.l_quantity >= 40
), dm as (
  select * from (
    select id symbol_id, case when kind = 'interface' then 'typescript_interface' when kind <> 'class' then null
      when "language" = 'python' and base = 'BaseModel' then 'pydantic'
      when "language" = 'python' and decorator like '@dataclass%' then 'dataclass'
      when "language" = 'python' and base = 'Base' then 'sqlalchemy'
      when "language" = 'go' then 'go_struct'
      when "language" = 'java' and decorator = '@Entity' then 'jpa'
      when "language" = 'rust' and decorator like 'derive%' then 'rust_serde'
      when "language" = 'ruby' and base = 'ApplicationRecord' then 'active_record' end framework
    from sym) where framework is not null
)
"""
