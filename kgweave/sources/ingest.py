"""What comes from outside the scanned tree: addresses as notes to be filled, office files, a server's answer about itself."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions import text as X

# The file suffix for each type of address.
SUFFIXES = {"pdf": ".pdf", "image": ".png"}
# Capability -> where it stands in a group of the answer, and where on the top level.
CAPABILITIES = {
    "document_symbol": ("textDocument", "documentSymbolProvider", "documentSymbolProvider"), "references": ("textDocument", "referencesProvider", "referencesProvider"),
    "call_hierarchy": ("textDocument", "callHierarchyProvider", "callHierarchyProvider"), "definition": ("textDocument", "definitionProvider", "definitionProvider"),
    "workspace_symbol": ("workspace", "symbolProvider", "workspaceSymbolProvider"),
}


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def url_notes(urls: DataFrame) -> DataFrame:
    """url, type, file, content: a note with frontmatter for each distinct valid address.

    ``urls`` has url and, where known, captured_at, author, contributor; of several rows of one address the least stands.
    """
    for c in ("captured_at", "author", "contributor"):
        if c not in urls.columns:
            urls = urls.withColumn(c, F.lit(None).cast("string"))
    one = urls.where(X.valid_url("url")).groupBy("url").agg(F.min(F.struct("captured_at", "author", "contributor")).alias("x")).select("url", "x.*", X.url_type("url").alias("type"))
    name = F.coalesce(*(F.when(F.col("type") == t, X.url_filename("url", s)) for t, s in SUFFIXES.items()), X.url_filename("url"))
    field = lambda c: F.coalesce(_quoted(F.col(c)), F.lit("null"))
    content = F.concat(
        F.lit("---\nsource_url: "), _quoted(F.col("url")), F.lit("\ncaptured_at: "), _quoted(F.coalesce("captured_at", F.lit(""))), F.lit("\nauthor: "), field("author"), F.lit("\ncontributor: "), field("contributor"), F.lit("\n---\n")
    )
    return one.select("url", "type", name.alias("file"), content.alias("content"))


def write_new(notes: DataFrame, root: str) -> list[str]:
    """Write (file, content) below a local folder; files that are there stay as they are. The written names."""
    done = []
    for r in notes.select("file", "content").toLocalIterator():
        at = Path(root) / r[0]
        if not at.exists():
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(r[1])
            done.append(r[0])
    return sorted(done)


def office_notes(paths: DataFrame) -> DataFrame:
    """path, content: the placeholder note of each Word or Excel file."""
    kind = F.when(F.lower("path").endswith(".docx"), "Word document").when(F.lower("path").endswith(".xlsx"), "Excel workbook")
    return paths.select("path").distinct().withColumn("kind", kind).where("kind is not null").select("path", F.concat(F.lit("# "), X.basename("path"), F.lit("\n\n"), F.col("kind"), F.lit(", not converted.\n")).alias("content"))


def capabilities(responses: DataFrame) -> DataFrame:
    """server, capability, enabled of initialize responses (server, response as JSON).

    A group's entry comes before the top level's. true, an object or a number enables; on the top level a number must not
    be 0. A response without capabilities, or no JSON, enables nothing.
    """
    caps = "$.result.capabilities"
    out = []
    for name, (group, sub, flat) in CAPABILITIES.items():
        inner, outer = F.get_json_object("response", f"{caps}.{group}.{sub}"), F.get_json_object("response", f"{caps}.{flat}")
        number = r"^-?[0-9.eE+]+$"
        top = F.coalesce((outer == "true") | outer.startswith("{") | (outer.rlike(number) & (outer.cast("double") != 0)), F.lit(False))
        known = inner.isin("true", "false") | inner.startswith("{") | inner.rlike(number)
        out.append(F.struct(F.lit(name).alias("capability"), F.when(F.coalesce(known, F.lit(False)), inner != "false").otherwise(top).alias("enabled")))
    return responses.select("server", F.explode(F.array(*out)).alias("c")).select("server", "c.*")
