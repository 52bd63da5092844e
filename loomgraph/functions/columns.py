"""Scalar functions as columns; all stay in the JVM."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_SUFFIXES = r"\.(?:py|tsx?|jsx?|mjs|cjs|go|java|rs|rb|c|h|cc|cpp|cxx|hpp|hxx)$"
CRUD_VERBS = "create delete fetch get insert list load patch put read remove save set store update upsert".split()

#: Name parts that give a module away, tried in this order.
MODULE_LABELS = (
    ("HTTP API / request handling", "api controller endpoint handler resource rest route router view"),
    ("data access / persistence", "dao database db migration model orm query repo repository schema store"),
    ("authentication / authorization", "acl auth credential jwt login logout oauth password permission role session token"),
    ("test suite", "assert fake fixture mock spec stub test"),
    ("configuration", "config constants defaults env options settings"),
    ("CLI interface", "arg cli click command flag option parse typer"),
    ("shared utilities", "common helper helpers lib shared tools util utils"),
)

ENTRY_MARKS = (
    "route", "@get", "@post", "@put", "@delete", "@patch", ".get(", ".post(", ".put(", ".delete(", ".patch(", "command", "cli",
    "getmapping", "postmapping", "putmapping", "deletemapping", "requestmapping", "restcontroller",
    "#[get(", "#[post(", "#[put(", "#[delete(", "actix", "rocket", "tokio::main",
)


def last_part(name: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(name, r"\."), -1)


def class_part(name: Column) -> Column:
    """The part before the last one, if there are at least three."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-2)))


def contains_folded(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())


def arrow(confidence: Column) -> Column:
    return F.when(F.coalesce(confidence, F.lit(1.0)) >= 0.9, "→").otherwise("?→")


def effective_confidence(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence == 0), 1.0).otherwise(confidence)


def boosted(pagerank: Column, entry: Column) -> Column:
    return pagerank + F.when(entry, 0.1).otherwise(0.0)


def signature_line(text: Column, width: int = 120) -> Column:
    """White space collapsed; a longer text is cut at its last space and marked."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.regexp_replace(F.substring(flat, 1, width), " [^ ]*$", ""), F.lit(" ..."))).otherwise(flat)


def module_of_path(path: Column) -> Column:
    """Dotted module of a relative path: code suffix and a last index or __init__ are dropped."""
    bare = F.regexp_replace(path, CODE_SUFFIXES, "")
    return F.regexp_replace(F.regexp_replace(bare, "/", "."), r"\.(?:index|__init__)$", "")


def module_key(path: Column) -> Column:
    """First folder, or the file's stem at the top."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.regexp_replace(path, r"(?<=.)\.[^.]*$", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def xml_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def capitalise(text: Column) -> Column:
    """First letter upper, all others lower (also those of abbreviations)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def padded(text: Column, width: int) -> Column:
    """Right-padded, a longer text in full."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def digest16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def identifiers(text: Column) -> Column:
    """Names of a base-class list: split at commas and space, without what is no identifier."""
    return F.filter(F.split(text, r"[,\s]+"), lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))


def name_words(name: Column) -> Column:
    """The set of words of a lower-cased name."""
    return F.array_distinct(F.split(F.lower(name), "_"))


def glob_regex(patterns: list[str]) -> str:
    """One Java regular expression for path globs where * crosses slashes.  A path is tried with and
    without a slash before it."""
    return "|".join("(?:" + re.sub(r"\\[zZ]$", "", fnmatch.translate(p)) + ")" for p in patterns)


def glob_excluded(path: Column, patterns: list[str]) -> Column:
    rx = f"^(?:{glob_regex(patterns)})$"
    return path.rlike(rx) | F.concat(F.lit("/"), path).rlike(rx)


def entry_point(name: Column, decorators: Column) -> Column:
    mark = "|".join(re.escape(m) for m in ENTRY_MARKS)
    return F.coalesce(F.exists(decorators, lambda d: F.lower(d).rlike(mark)), F.lit(False)) | (name == "main")


def _any(array: Column, names: str) -> Column:
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, names.split()))), F.lit(False))


def framework(language: Column, kind: Column, bases: Column, decorators: Column) -> Column:
    """Data-model framework of a class or interface, or null; the first rule that holds."""
    heads = F.transform(decorators, lambda d: F.trim(F.substring_index(F.ltrim(F.regexp_replace(d, "^@+", "")), "(", 1)))
    derives = F.coalesce(F.exists(decorators, lambda d: d.contains("derive") & d.rlike("Deserialize|FromRow|Insertable|Queryable|Serialize")), F.lit(False))
    return (
        F.when(kind == "interface", "typescript_interface")
        .when(kind != "class", None)
        .when((language == "python") & _any(bases, "BaseModel BaseSettings GenericModel RootModel SQLModel"), "pydantic")
        .when((language == "python") & _any(heads, "attr.attrs attr.s attrs.define dataclass"), "dataclass")
        .when((language == "python") & _any(bases, "Base DeclarativeBase DeclarativeBaseNoMeta Model"), "sqlalchemy")
        .when(language == "go", "go_struct")
        .when((language == "java") & _any(heads, "Data Document Entity Table Value"), "jpa")
        .when((language == "rust") & derives, "rust_serde")
        .when((language == "ruby") & _any(bases, "ActiveRecord::Base ApplicationRecord Dry::Struct Sequel::Model"), "active_record")
    )


def writes_model(name: Column, signature: Column, model: Column, strict: bool = False) -> Column:
    """Returns the model, or is named like something that makes one and mentions it."""
    sig, low, m = F.coalesce(signature, F.lit("")), F.lower(name), F.lower(model)
    made = sig.contains(F.concat(F.lit("-> "), model)) | F.lower(sig).contains(F.concat(F.lit("-> list["), model))
    verb = low.rlike("add|build|create|insert|make|new|save") & (low.contains(m) | F.lower(sig).contains(m))
    return (made | verb) & (_whole_word(sig, name, model) if strict else F.lit(True))


def reads_model(name: Column, signature: Column, model: Column, strict: bool = False) -> Column:
    """Takes the model, or is named like something that gets one and mentions it."""
    sig, low, m = F.coalesce(signature, F.lit("")), F.lower(name), F.lower(model)
    taken = sig.contains(F.concat(F.lit(": "), model)) | F.lower(sig).contains(F.concat(F.lit(": list["), model))
    verb = low.rlike("fetch|find|get|list|load|parse|read") & (low.contains(m) | F.lower(sig).contains(m))
    return (taken | verb) & (_whole_word(sig, name, model) if strict else F.lit(True))


def _whole_word(signature: Column, name: Column, model: Column) -> Column:
    """The model stands in the signature as a word, or is a word of the snake-case name."""
    words = F.split(signature, r"[^A-Za-z0-9_]+")
    return F.array_contains(words, model) | F.concat(F.lit("_"), F.lower(name), F.lit("_")).contains(F.concat(F.lit("_"), F.lower(model), F.lit("_")))


def summary(label: Column, total: Column, entries: Column, classes: Column) -> Column:
    some = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    return F.concat(capitalise(label), F.lit(" ("), F.concat_ws(", ", some(entries, " entry points"), some(classes, " classes"), F.concat(total.cast("string"), F.lit(" symbols total"))), F.lit(")."))
