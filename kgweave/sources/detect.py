"""File detection: scan, categories, ignore patterns, sensitive names, routing, caches and manifests."""

from __future__ import annotations

import fnmatch
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.functions.text import basename
from kgweave.schema import MANIFEST

# Which suffixes belong to which category.
CATEGORIES = {
    "code": ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "c", "cpp", "h", "hpp", "rb", "cs", "kt", "kts", "scala", "php", "swift", "lua", "zig", "hs", "lhs", "ex", "exs", "m", "mm", "jl", "vue", "svelte", "dart", "ps1", "nix", "json"),
    "document": ("md", "txt", "rst", "adoc", "org", "text", "raml"),
    "paper": ("pdf",),
    "image": ("png", "jpg", "jpeg", "webp", "gif"),
    "video": ("mp4", "mov", "mkv", "webm", "avi", "m4v", "mp3", "wav", "m4a", "ogg"),
}
# Directories that are never scanned (the tool's own output folder is set by the caller).
IGNORED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "dist", "dist-newstyle", "build", ".stack-work", ".opencode", ".tmp", ".obsidian", ".github")
# Names and directories of sensitive files.
SENSITIVE_NAMES = (
    ".env", ".env.local", ".env.production", ".env.staging", ".pem", ".key", ".p12", ".pfx", ".netrc", ".npmrc", ".pypirc", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa", "credentials", "secrets", "secret_key",
    "service-account", "service_account", ".aws/credentials", ".gnupg", "ssh_config", ".ssh/config", ".docker/config.json", ".kube/config",
)
SENSITIVE_DIRS = (".gnupg", ".ssh")
# How suffixes are read: by a parser, by symbols of a language server (Haskell: by lines), or as documents.
EXTRACTORS = {
    "ts": "parser", "tsx": "parser", "js": "parser", "jsx": "parser", "hs": "lines", "lhs": "lines", "go": "symbols", "rs": "symbols", "py": "symbols", "pyw": "symbols", "c": "symbols", "cpp": "symbols", "h": "symbols",
    "hpp": "symbols", "nix": "symbols", "rb": "symbols", "java": "symbols", "json": "parser", "md": "document", "rst": "document", "adoc": "document",
}
# Language servers for suffixes.
SERVERS = {
    "ts": "typescript-language-server", "tsx": "typescript-language-server", "js": "typescript-language-server", "jsx": "typescript-language-server", "py": "pyright-langserver", "go": "gopls", "rs": "rust-analyzer",
    "c": "clangd", "cpp": "clangd", "h": "clangd", "hpp": "clangd", "java": "jdtls", "cs": "omnisharp", "rb": "solargraph", "hs": "haskell-language-server", "lhs": "haskell-language-server", "php": "phpactor",
    "swift": "sourcekit-lsp", "kt": "kotlin-language-server", "kts": "kotlin-language-server", "scala": "metals", "lua": "lua-language-server", "zig": "zls", "ex": "elixir-ls", "exs": "elixir-ls", "dart": "dart",
    "vue": "vue-language-server", "svelte": "svelte-language-server", "nix": "nixd",
}
LARGE_CORPUS = 200


def extension(path: str | Column = "path") -> Column:
    """The suffix after the base name's last dot, '' without one; case counts."""
    return F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1)


def _lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def scan(spark: SparkSession, root: str, categories: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """path, ext, category, n_bytes, mtime of the files below ``root``; the contents are not read. A missing root has no files."""
    if "://" not in root and not Path(root).exists():
        return spark.createDataFrame([], "path string, ext string, category string, n_bytes bigint, mtime timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("mtime"))
    return categorise(rows.where(~in_ignored_dir()), categories).select("path", "ext", "category", "n_bytes", "mtime")


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """path, content of whole text files."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.input_file_name(), "^file:(//)?", "").alias("path"), F.col("value").alias("content"))


def in_ignored_dir(path: str = "path", more: tuple[str, ...] = ()) -> Column:
    """Whether a folder of the path is one that is never scanned; ``more`` adds the caller's own, such as the output folder."""
    parts = F.split(F.col(path), "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(*IGNORED_DIRS, *more))


def categorise(files: DataFrame, categories: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row for each category that lists the file's suffix; files of none are left out."""
    cats = categories or CATEGORIES
    of: dict[str, list[str]] = {}
    for cat, exts in cats.items():
        for e in exts:
            of.setdefault(e, []).append(cat)
    table = F.create_map(*[x for e, cs in of.items() for x in (F.lit(e), F.array(*map(F.lit, cs)))])
    ext = extension()
    return files.drop("category", "ext").withColumn("ext", ext).withColumn("category", F.explode(table[F.col("ext")]))


def category_counts(files: DataFrame) -> DataFrame:
    return categorise(files.select("path").distinct()).groupBy("category").agg(F.count(F.lit(1)).alias("n_files"))


def corpus_warning(n_files: int) -> str | None:
    return f"Large corpus: {n_files} files" if n_files > LARGE_CORPUS else "No files found" if n_files == 0 else None


def parse_ignore(text: str) -> list[tuple[str, str]]:
    """(kind, pattern): prefix 'a/', suffix '*.x', glob with other stars, exact; comments and blanks aside."""
    out = []
    for line in (x.strip() for x in text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.endswith("/") and "*" not in line:
            out.append(("prefix", line))
        elif line.startswith("*") and "*" not in line[1:] and "?" not in line:
            out.append(("suffix", line[1:]))
        elif "*" in line or "?" in line:
            out.append(("glob", line))
        else:
            out.append(("exact", line))
    return out


def ignored(patterns: list[tuple[str, str]], path: str = "path") -> Column:
    c, out = F.col(path), F.lit(False)
    for kind, p in patterns:
        if kind == "prefix":
            hit = c.startswith(p) | c.contains("/" + p)
        elif kind == "suffix":
            hit = c.endswith(p)
        elif kind == "glob":
            hit = c.rlike(fnmatch.translate(p).replace("(?s:", "(?s)(?:").replace("\\Z", "$").replace("\\z", "$"))
        else:
            hit = (c == p) | (basename(c) == p)
        out = out | hit
    return out


def sensitive(path: str = "path") -> Column:
    """Names that suggest secrets: a pattern within the base name, or a sensitive directory within the directory part."""
    name, folder = basename(path), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    out = F.lit(False)
    for p in SENSITIVE_NAMES:
        out = out | name.contains(p)
    for p in SENSITIVE_DIRS:
        out = out | folder.contains(p)
    return out


def route(files: DataFrame) -> DataFrame:
    """Adds ``extractor`` (parser, symbols, lines, document or stub) and ``server``."""
    return files.withColumn("extractor", F.coalesce(_lookup(EXTRACTORS)[extension()], F.lit("stub"))).withColumn("server", _lookup(SERVERS)[extension()])


def server_groups(files: DataFrame) -> DataFrame:
    """server, n_files of the routed code files."""
    return route(files.select("path").distinct()).where("server is not null").groupBy("server").agg(F.count(F.lit(1)).alias("n_files"))


def server_files(files: DataFrame) -> DataFrame:
    """server, path: the distinct code files that each server is to read, in long form, so that no group is one row."""
    return route(files.select("path").distinct()).where("server is not null").select("server", "path")


def installed_servers() -> dict[str, bool]:
    """server -> whether its command is found on this machine."""
    return {s: shutil.which(s) is not None for s in sorted(set(SERVERS.values()))}


def language_for(path: str | Column = "path") -> Column:
    """The language id of a path's suffix (its server's name for it), null without one."""
    return F.when(_lookup(SERVERS)[extension(path)].isNotNull(), extension(path))


def content_key(path: str = "path", content: str = "content") -> Column:
    return F.sha2(F.concat(F.col(path), F.lit("\0"), F.coalesce(content, F.lit(""))), 256)


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses): files whose key is in ``cache.key``, and the others."""
    keyed = files.withColumn("key", content_key())
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti").drop("key")


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, change (added, modified, removed) of a scan against a manifest of path and hash."""
    now = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("now"))
    both = now.join(manifest.select("path", F.col("hash").alias("was")), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "modified")
    return both.select("path", kind.alias("change")).where("change is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; one that is not there has no rows."""
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(path, multiLine=False)


def merge_config(defaults: dict, user: dict) -> dict:
    """Sections lsp, language_ids and extractors are merged by key (the user wins), all others replaced as a whole."""
    out = dict(defaults)
    for k, v in (user or {}).items():
        out[k] = {**defaults.get(k, {}), **v} if k in ("lsp", "language_ids", "extractors") and isinstance(v, dict) else v
    return out


FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])
