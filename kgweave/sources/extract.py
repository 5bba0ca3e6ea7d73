"""Extraction of nodes and edges: documents, code by lines or parser, language-server symbols, stubs."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.functions import text as X

# The protocol's kinds of symbols, from 1.
SYMBOL_KINDS = ("File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable", "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter")
EDGE_COLUMNS = ("source", "target", "relation", "confidence", "confidence_score", "source_file", "source_location", "weight")
NODE_COLUMNS = ("id", "label", "file_type", "source_file", "source_location", "line_end", "kind", "signature")


def _node(id_: Column, label: Column, file_type: str, path: Column, line: Column | None, kind: Column, line_end: Column | None = None, signature: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    return [
        id_.alias("id"), label.alias("label"), F.lit(file_type).alias("file_type"), path.alias("source_file"), (F.concat(F.lit("L"), line.cast("string")) if line is not None else null).alias("source_location"),
        (line_end if line_end is not None else F.lit(None)).cast("int").alias("line_end"), kind.alias("kind"), (signature if signature is not None else null).alias("signature"),
    ]


def _edge(source: Column, target: Column, relation: str, confidence: str, score: float, path: Column, line: Column | None = None) -> list[Column]:
    where = F.concat(F.lit("L"), line.cast("string")) if line is not None else F.lit(None).cast("string")
    return [source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(score).alias("confidence_score"), path.alias("source_file"), where.alias("source_location"), F.lit(1.0).alias("weight")]


def stub_nodes(files: DataFrame) -> DataFrame:
    """One node a file."""
    p = F.col("path")
    return files.select("path").distinct().select(*_node(X.stub_id(p), X.basename(p), "code", p, None, F.lit("File")))


def doc_id(path: Column) -> Column:
    return F.concat_ws("_", X.dir_hash(path), F.lit("doc"), X.stem(path))


def clean_title(title: Column) -> Column:
    return F.regexp_replace(title, r"[^\p{L}\p{N}]", "")


def document_nodes(files: DataFrame) -> DataFrame:
    """Nodes of document files, their headings of levels 1-4, and their tags."""
    p = F.col("path")
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content")).distinct()
    file_nodes = rows.select(*_node(doc_id(p), X.basename(p), "document", p, None, F.lit("File")))
    heads = rows.select("path", F.explode(X.headers("content")).alias("h"))
    head_nodes = heads.select(*_node(F.concat(X.dir_hash(p), F.lit("_h"), F.col("h.level").cast("string"), F.lit("_"), clean_title(F.col("h.title"))), F.col("h.title"), "document", p, F.col("h.line"), F.lit("Header")))
    tag_rows = rows.select("path", F.explode(X.tags("content")).alias("tag"))
    tag_nodes = tag_rows.select(*_node(F.concat(X.dir_hash(p), F.lit("_tag_"), F.col("tag")), F.concat(F.lit("#"), "tag"), "document", p, None, F.lit("Tag")))
    return file_nodes.unionByName(head_nodes).unionByName(tag_nodes).distinct()


def document_edges(files: DataFrame) -> DataFrame:
    """file contains heading, file references tag, file references link target (its raw text)."""
    p = F.col("path")
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content")).distinct()
    heads = rows.select("path", F.explode(X.headers("content")).alias("h"))
    a = heads.select(*_edge(doc_id(p), F.concat(X.dir_hash(p), F.lit("_h"), F.col("h.level").cast("string"), F.lit("_"), clean_title(F.col("h.title"))), "contains", "EXTRACTED", 1.0, p, F.col("h.line")))
    tag_rows = rows.select("path", F.explode(X.tags("content")).alias("tag"))
    b = tag_rows.select(*_edge(doc_id(p), F.concat(X.dir_hash(p), F.lit("_tag_"), F.col("tag")), "references", "EXTRACTED", 1.0, p))
    links = rows.select("path", F.explode(X.wiki_links("content")).alias("link")).where("link <> ''")
    c = links.select(*_edge(doc_id(p), F.col("link"), "references", "INFERRED", 0.8, p))
    return a.unionByName(b).unionByName(c).distinct()


_MODULE, _IMPORT, _DECL = r"^module +([A-Z][\w.]*)", r"^import +(?:safe +)?(?:qualified +)?([A-Z][\w.]*)", r"^(?:(data|newtype|type|class|instance) +([A-Z]\w*)|([a-z_][\w']*) *::)"


def haskell_lines(files: DataFrame) -> DataFrame:
    """path, line, part (module, import, declaration), name, kind: what single lines declare."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("at", "text"))
    name = lambda pattern, g: F.regexp_extract("text", pattern, g)
    decl = F.when(name(_DECL, 2) != "", name(_DECL, 2)).otherwise(name(_DECL, 3))
    part = F.when(name(_MODULE, 1) != "", "module").when(name(_IMPORT, 1) != "", "import").when(decl != "", "declaration")
    kind = F.when(part == "module", "Module").when(part == "import", "Import").when(name(_DECL, 3) != "", "Function").when(name(_DECL, 1) == "class", "Interface").otherwise("Class")
    value = F.when(part == "module", name(_MODULE, 1)).when(part == "import", name(_IMPORT, 1)).otherwise(decl)
    return lines.select("path", (F.col("at") + 1).alias("line"), part.alias("part"), value.alias("name"), kind.alias("kind")).where("part is not null")


def haskell_nodes(files: DataFrame) -> DataFrame:
    p = F.col("path")
    rows = haskell_lines(files).distinct()
    id_ = F.when(F.col("part") == "import", F.concat(X.dir_hash(p), F.lit("_"), X.stem(p), F.lit("_import_"), F.col("name"))).otherwise(X.symbol_id(p, F.col("name")))
    found = rows.select(*_node(id_, F.col("name"), "code", p, F.col("line"), F.col("kind")))
    # the first of equal names stands, as a signature comes before its other lines
    return found.groupBy("id").agg(F.min_by(F.struct(*[c for c in NODE_COLUMNS if c != "id"]), F.substring("source_location", 2, 12).cast("int")).alias("x")).select("id", "x.*")


def haskell_edges(files: DataFrame) -> DataFrame:
    """From each file's module (or the file, without one) to its imports and declarations: relation imports, AMBIGUOUS at 0.7."""
    p = F.col("path")
    rows = haskell_lines(files).distinct()
    modules = rows.where("part = 'module'").groupBy("path").agg(F.min_by("name", "line").alias("module"))
    at = rows.where("part <> 'module'").join(modules, "path", "left")
    source = F.when(F.col("module").isNotNull(), X.symbol_id(p, F.col("module"))).otherwise(X.stub_id(p))
    target = F.when(F.col("part") == "import", F.concat(X.dir_hash(p), F.lit("_"), X.stem(p), F.lit("_import_"), F.col("name"))).otherwise(X.symbol_id(p, F.col("name")))
    return at.select(*_edge(source, target, "imports", "AMBIGUOUS", 0.7, p, F.col("line"))).dropDuplicates(["source", "target"])


_SYMBOL_SCHEMA = "path string, name string, kind int, start_line int, start_char int, end_line int, end_char int, seq int"


def flatten_symbols(responses: DataFrame) -> DataFrame:
    """path, name, kind, start and end positions, seq: the symbols of documentSymbol responses (path, response as JSON), children included.

    Nameless symbols are skipped but descended into; both forms of the response (nested, flat with a location) are read;
    a response that is no JSON has no symbols.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for path, response in zip(pdf["path"], pdf["response"]):
                try:
                    stack = list(reversed(json.loads(response) or []))
                except (TypeError, ValueError):
                    continue
                k = 0
                while stack:
                    s = stack.pop()
                    if not isinstance(s, dict):
                        continue
                    r = s.get("range") or (s.get("location") or {}).get("range") or {}
                    a, b = r.get("start") or {}, r.get("end") or {}
                    if s.get("name"):
                        out.append((path, s["name"], s.get("kind"), a.get("line"), a.get("character"), b.get("line"), b.get("character"), k))
                        k += 1
                    stack.extend(reversed(s.get("children") or []))
            frame = pd.DataFrame(out, columns=["path", "name", "kind", "start_line", "start_char", "end_line", "end_char", "seq"])
            yield frame.astype({c: "Int32" for c in ("kind", "start_line", "start_char", "end_line", "end_char", "seq")})

    return responses.select("path", "response").mapInPandas(run, _SYMBOL_SCHEMA)


def workspace_symbols(responses: DataFrame) -> DataFrame:
    """uri grouped form of workspace/symbol: path (without file://), name, kind, of named symbols."""
    item = "array<struct<name:string,kind:int,location:struct<uri:string>>>"
    rows = responses.select(F.explode(F.from_json("response", item)).alias("s")).where("s.name is not null and s.name <> ''")
    return rows.select(F.regexp_replace("s.location.uri", "^file://", "").alias("path"), F.col("s.name").alias("name"), F.col("s.kind").alias("kind"))


def symbol_kind(c: str = "kind") -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SYMBOL_KINDS)), F.col(c) - 1), F.lit("Unknown"))


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    p = F.col("path")
    return symbols.select(*_node(X.symbol_id(p, F.col("name")), X.safe_name("name"), "code", p, F.col("start_line"), symbol_kind(), F.col("end_line"))).dropDuplicates(["id"])


def symbol_edges(symbols: DataFrame) -> DataFrame:
    """contains: file to symbol, and the innermost symbol whose range holds another's to that one (a range join within the file)."""
    p = F.col("path")
    files = symbols.select(*_edge(X.stub_id(p), X.symbol_id(p, F.col("name")), "contains", "EXTRACTED", 1.0, p, F.col("start_line")))
    at = lambda line, char: F.col(line) * 10000 + F.col(char)
    s = symbols.select("path", "name", "seq", at("start_line", "start_char").alias("a"), at("end_line", "end_char").alias("b"), "start_line")
    outer = s.select("path", F.col("name").alias("parent"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    inner = s.join(outer, "path").where("pa < a and b <= pb")
    best = inner.groupBy("path", "seq", "name", "start_line").agg(F.max_by("parent", "pa").alias("parent"))
    nested = best.select(*_edge(X.symbol_id(p, F.col("parent")), X.symbol_id(p, F.col("name")), "contains", "EXTRACTED", 1.0, p, F.col("start_line")))
    return files.unionByName(nested).dropDuplicates(["source", "target"])


def python_definitions(files: DataFrame) -> DataFrame:
    """path, name, kind, line, line_end, parent, label: definitions of Python sources in preorder, by the standard parser.

    ``label`` is the definition's text, cut at 200 characters with '...'. A file that does not parse has none (a stub stands for it).
    """

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                stack = [(n, None) for n in reversed(tree.body)]
                while stack:
                    node, parent = stack.pop()
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        kind = "Class" if isinstance(node, ast.ClassDef) else "Method" if parent else "Function"
                        text = ast.get_source_segment(content, node) or node.name
                        out.append((path, node.name, kind, node.lineno, node.end_lineno, parent, text if len(text) <= 200 else text[:200] + "..."))
                        parent = node.name
                    stack.extend((c, parent) for c in reversed(list(ast.iter_child_nodes(node))))
            yield pd.DataFrame(out, columns=["path", "name", "kind", "line", "line_end", "parent", "label"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, kind string, line int, line_end int, parent string, label string")


def conversation_files(texts: DataFrame) -> DataFrame:
    """id, question, summary, timestamp, tokens_used of memory files (path, content) with a frontmatter block."""
    field = lambda name: F.regexp_extract("content", rf'(?m)^{name}: *"?([^"\n]*)"?', 1)
    body = F.trim(F.regexp_extract("content", r"(?s)^---\n.*?\n---\n(.*)$", 1))
    return texts.where(F.col("content").startswith("---")).select(field("id").alias("id"), field("question").alias("question"), body.alias("summary"), field("timestamp").alias("timestamp"), F.expr("try_cast(regexp_extract(content, '(?m)^tokens_used: *([0-9]+)', 1) as int)").alias("tokens_used"))
