"""Schemas of the stored tables; nested lists are arrays, never JSON text."""

from __future__ import annotations

from pyspark.sql import types as T

FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("optional", T.BooleanType())])
IMPORT = T.StructType([T.StructField("module", T.StringType()), T.StructField("name", T.StringType())])

FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("ext", T.StringType()),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

EXTRACTED = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("qualified_name", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("signature", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("file_mtime", T.DoubleType()),
    T.StructField("is_entry_point", T.BooleanType()),
    T.StructField("is_exported", T.BooleanType()),
    T.StructField("decorators", T.ArrayType(T.StringType())),
    T.StructField("bases", T.ArrayType(T.StringType())),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("implements", T.ArrayType(T.StringType())),
    T.StructField("imports", T.ArrayType(IMPORT)),
    T.StructField("fields", T.ArrayType(FIELD)),
])

SYMBOLS = T.StructType([T.StructField("id", T.LongType(), False), *EXTRACTED.fields])

EDGES = T.StructType([
    T.StructField("edge_id", T.LongType(), False),
    T.StructField("source_id", T.LongType(), False),
    T.StructField("target_id", T.LongType()),
    T.StructField("target_name", T.StringType(), False),
    T.StructField("edge_type", T.StringType(), False),
    T.StructField("confidence", T.DoubleType()),
])

DATA_MODELS = T.StructType([T.StructField("symbol_id", T.LongType(), False), T.StructField("framework", T.StringType()), T.StructField("fields", T.ArrayType(FIELD))])

EDGE_TYPES = ("calls", "reads", "writes", "imports", "extends", "implements")
KINDS = ("function", "method", "class", "interface")
