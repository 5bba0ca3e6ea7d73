"""What is kept between runs: caches, manifests, checkpoints, saved answers and conversations."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.operators.graph import Graph
from kgweave.schema import CONVERSATION
from kgweave.sinks.export import conversation_note
from kgweave.sources.detect import content_key
from kgweave.sources.graph_json import write_graph_json


def cache_rows(files: DataFrame, found: DataFrame, by: str = "source_file") -> DataFrame:
    """key, path, n_rows, rows (JSON objects, sorted): what was found in each file, under the file's content key."""
    held = found.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("path")).agg(F.sort_array(F.collect_list(F.to_json(F.struct(*[c for c in found.columns if c != by])))).alias("rows"))
    return files.select("path", content_key().alias("key")).distinct().join(held, "path").select("key", "path", F.size("rows").alias("n_rows"), "rows")


def write_cache(rows: DataFrame, path: str) -> None:
    """Append to the cache table; Spark's commit makes each write whole or nothing."""
    rows.write.mode("append").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """path, hash: one row a file, of its latest content by hash of equal ones."""
    return files.where("path is not null").select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash")).groupBy("path").agg(F.max("hash").alias("hash"))


def write_manifest(files: DataFrame, path: str) -> None:
    manifest(files).write.mode("overwrite").json(path)


def write_checkpoint(graph: Graph, communities: DataFrame, path: str) -> None:
    """The graph document without analysis, marked as a checkpoint; ``clear_checkpoint`` removes it at the end of a run."""
    write_graph_json(graph, communities, path)
    text = Path(path).read_text()
    Path(path).write_text('{"checkpoint": true,' + text[1:])


def clear_checkpoint(path: str) -> None:
    Path(path).unlink(missing_ok=True)


def saved_answer(question: str, answer: str, kind: str, sources: list[str], stamp: str) -> tuple[str, str]:
    """(file, content) of a note that a later scan reads again."""
    q = lambda s: '"' + s + '"'
    head = ["---", f"question: {q(question)}", f"answer_type: {kind}", "source_nodes: [" + ", ".join(map(q, sources)) + "]", f"captured_at: {q(stamp)}", "---"]
    return f"memory/qa_{stamp}.md", "\n".join([*head, "", f"# Q: {question}", "", answer, ""])


def save_answer(root: str, question: str, answer: str, kind: str, sources: list[str], stamp: str) -> str:
    name, content = saved_answer(question, answer, kind, sources, stamp)
    at = Path(root) / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(content)
    return name


def save_conversations(conversations: DataFrame, root: str) -> list[str]:
    """One memory note a conversation below a local folder, each written whole; and a table of their rows."""
    names = []
    for r in conversation_note(conversations).toLocalIterator():
        at = Path(root) / r["file"]
        at.parent.mkdir(parents=True, exist_ok=True)
        tmp = at.with_suffix(".tmp")
        tmp.write_text(r["content"])
        os.replace(tmp, at)
        names.append(r["file"])
    conversations.write.mode("append").parquet(f"{root}/conversations.parquet")
    return sorted(names)


def stored_conversations(spark: SparkSession, root: str) -> DataFrame:
    """The table that ``save_conversations`` writes; none before the first."""
    at = f"{root}/conversations.parquet"
    if "://" not in root and not Path(at).exists():
        return spark.createDataFrame([], CONVERSATION)
    return spark.read.schema(CONVERSATION).parquet(at).distinct()


def parse_labels(response: str) -> dict[int, str]:
    """community_id -> label of a chat completion, or of its text: a JSON object, in a code block or bare; anything else has none."""
    try:
        body = json.loads(response)
        if isinstance(body, dict) and "choices" in body:
            response = body["choices"][0]["message"]["content"]
    except (ValueError, KeyError, IndexError, TypeError):
        pass
    text = response.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return {int(k): v for k, v in found.items() if isinstance(v, str) and k.lstrip("-").isdigit()} if isinstance(found, dict) else {}
