"""Source trees as DataFrames, and configuration."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

#: Suffix -> language of the extractors.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".go": "go", ".java": "java", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".rb": "ruby",
}

#: Suffixes that the regular-expression extractor leaves out.
NO_CODE = frozenset(
    """.a .adoc .cfg .class .css .csv .dll .env .eot .exe .gif .gz .html .ico .ini .jpeg .jpg .json .lock .md .o .pdf .png .pyc .pyo .rst .so .sql
    .sum .svg .tar .textile .toml .ttf .txt .woff .woff2 .xml .yaml .yml .zip""".split()
)

EXCLUDES = [f"**/{d}/**" for d in (".git", ".mypy_cache", ".pytest_cache", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "venv")] + [f"**/*{s}" for s in (".md", ".min.css", ".min.js", ".rst", ".txt")]


@dataclass
class Config:
    """Settings; `load` reads [tool.loomgraph] of pyproject.toml, then .loomgraph.toml over it."""

    max_tokens: int = 1000
    output_format: str = "markdown"
    exclude_patterns: list[str] = field(default_factory=lambda: list(EXCLUDES))
    fallback_parser: bool = True
    tier: str = "auto"

    @classmethod
    def load(cls, root: str) -> Config:
        values: dict = {}
        for name, keys in (("pyproject.toml", ("tool", "loomgraph")), (".loomgraph.toml", ())):
            path = os.path.join(root, name)
            if os.path.isfile(path):
                with open(path, "rb") as f:
                    section = tomllib.load(f)
                for k in keys:
                    section = section.get(k, {})
                values |= section
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


def project_root(path: str, marks: tuple[str, ...] = (".git", "pyproject.toml", "package.json", "Cargo.toml", "go.mod")) -> str:
    """The nearest folder upwards that has one of the marks, else the path itself."""
    at = os.path.abspath(path)
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in marks):
            return at
        if os.path.dirname(at) == at:
            return os.path.abspath(path)
        at = os.path.dirname(at)


def tier(files: int, fixed: str = "auto") -> int:
    return int(fixed) if fixed in ("1", "2", "3") else 1 if files < 1000 else 2 if files < 10_000 else 3


def source_files(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, ext, mtime, length, content, route): files of a tree that an extractor takes, with paths
    relative to the root.  Excluded paths are dropped before contents are read."""
    config = config or Config()
    full = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*/", "/")
    rel = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)
    files = full.select(rel.alias("path"), F.unix_millis("modificationTime").cast("double").alias("ms"), "length", "content").withColumn("ext", C.extension(F.col("path")))
    parsed, other = F.col("ext").isin(*LANGUAGES), ~F.col("ext").isin(*NO_CODE) & F.lit(config.fallback_parser)
    routed = files.withColumn("route", F.when(parsed, "parser").when(other, "fallback"))
    return routed.where(F.col("route").isNotNull() & ~C.glob_excluded(F.col("path"), config.exclude_patterns)).select("path", "ext", (F.col("ms") / 1000).alias("mtime"), "length", "content", "route")
