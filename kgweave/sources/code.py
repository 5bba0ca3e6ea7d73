"""Declarations and imports of code without a grammar library: by lines for TypeScript, JavaScript, Go and Rust, by keys for JSON.

Each language is a short list of line forms; they run as regular expressions inside the scan, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions import text as X
from kgweave.sources.extract import NODE_COLUMNS, _edge, _node

LANGUAGES = {"ts": "script", "tsx": "script", "js": "script", "jsx": "script", "go": "go", "rs": "rust", "json": "json"}
#: language -> [(kind, form)]; a form's first group is the name. The first form that fits a line decides.
FORMS = {
    "script": (
        ("Import", r"""^import .*from ['"]([^'"]+)['"]"""), ("Import", r"""^import ['"]([^'"]+)['"]"""), ("Import", r"""^(?:const|let|var) .*= require\(['"]([^'"]+)['"]\)"""),
        ("Class", r"^(?:export )?(?:default )?(?:abstract )?class ([A-Za-z_$][A-Za-z0-9_$]*)"), ("Interface", r"^(?:export )?interface ([A-Za-z_$][A-Za-z0-9_$]*)"), ("Enum", r"^(?:export )?(?:const )?enum ([A-Za-z_$][A-Za-z0-9_$]*)"),
        ("TypeAlias", r"^(?:export )?type ([A-Za-z_$][A-Za-z0-9_$]*)"), ("Function", r"^(?:export )?(?:default )?(?:async )?function\*? ?([A-Za-z_$][A-Za-z0-9_$]*)"),
        ("Variable", r"^(?:export )?(?:const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*)"),
    ),
    "go": (
        ("Import", r"""^(?:import )?\s*(?:[a-z_.]+ )?"([A-Za-z0-9_./-]+)"$"""), ("Module", r"^package ([a-z_][A-Za-z0-9_]*)"), ("Method", r"^func \([^)]*\) ([A-Za-z_][A-Za-z0-9_]*)"), ("Function", r"^func ([A-Za-z_][A-Za-z0-9_]*)"),
        ("Interface", r"^type ([A-Za-z_][A-Za-z0-9_]*) interface"), ("Class", r"^type ([A-Za-z_][A-Za-z0-9_]*)"), ("Variable", r"^(?:var|const) ([A-Za-z_][A-Za-z0-9_]*)"),
    ),
    "rust": (
        ("Import", r"^(?:pub )?use ([A-Za-z0-9_:]+)"), ("Module", r"^(?:pub )?mod ([a-z_][A-Za-z0-9_]*)"), ("Function", r"^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?(?:unsafe )?fn ([a-z_][A-Za-z0-9_]*)"),
        ("Struct", r"^(?:pub(?:\([a-z]+\))? )?struct ([A-Za-z_][A-Za-z0-9_]*)"), ("Enum", r"^(?:pub(?:\([a-z]+\))? )?enum ([A-Za-z_][A-Za-z0-9_]*)"), ("Interface", r"^(?:pub(?:\([a-z]+\))? )?trait ([A-Za-z_][A-Za-z0-9_]*)"),
        ("Class", r"^impl(?:<[^>]*>)? ([A-Za-z_][A-Za-z0-9_]*)"), ("Variable", r"^(?:pub(?:\([a-z]+\))? )?(?:const|static) ([A-Z_][A-Z0-9_]*)"),
    ),
    "json": (("Key", r"""^\s*"([^"]+)"\s*:"""),),
}


def _first(forms, of) -> Column:
    out = F.lit(None).cast("string")
    for kind, form in reversed(forms):
        out = F.when(F.col("text").rlike(form), of(kind, form)).otherwise(out)
    return out


def code_declarations(files: DataFrame) -> DataFrame:
    """path, line, kind, name of every declaring or importing line of files (path, content) in a known language.

    Null contents and other suffixes give no rows; repeated rows count once.
    """
    language = F.coalesce(*(F.when(F.col("path").endswith(f".{e}"), lang) for e, lang in LANGUAGES.items()))
    lines = files.select("path", "content").where("content is not null").distinct().withColumn("lang", language).where("lang is not null").select("path", "lang", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    pick = lambda of: F.coalesce(*(F.when(F.col("lang") == lang, _first(forms, of)) for lang, forms in FORMS.items()))
    rows = lines.select("path", (F.col("at") + 1).alias("line"), pick(lambda kind, form: F.lit(kind)).alias("kind"), pick(lambda kind, form: F.regexp_extract("text", form, 1)).alias("name"))
    return rows.where("name <> ''")


def _ids() -> Column:
    p = F.col("path")
    return F.when(F.col("kind") == "Import", F.concat(X.dir_hash(p), F.lit("_"), X.stem(p), F.lit("_import_"), F.col("name"))).otherwise(X.symbol_id(p, F.col("name")))


def code_nodes(files: DataFrame) -> DataFrame:
    """One node a declared or imported name of a file: its first line."""
    p = F.col("path")
    found = code_declarations(files).select(*_node(_ids(), F.col("name"), "code", p, F.col("line"), F.col("kind")))
    return found.groupBy("id").agg(F.min_by(F.struct(*[c for c in NODE_COLUMNS if c != "id"]), F.substring("source_location", 2, 12).cast("int")).alias("x")).select("id", "x.*")


def code_edges(files: DataFrame) -> DataFrame:
    """From each file to what it imports (imports) and declares (contains)."""
    p = F.col("path")
    rows = code_declarations(files).withColumn("id", _ids())
    one = rows.groupBy("path", "id", (F.col("kind") == "Import").alias("imported")).agg(F.min("line").alias("line"))
    a = one.where("not imported").select(*_edge(X.stub_id(p), F.col("id"), "contains", "EXTRACTED", 1.0, p, F.col("line")))
    return a.unionByName(one.where("imported").select(*_edge(X.stub_id(p), F.col("id"), "imports", "EXTRACTED", 1.0, p, F.col("line"))))
