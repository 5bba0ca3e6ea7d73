"""Schemas, enumerations and their codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _i, _d = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


NODE = _struct(
    ("id", _s, False), ("label", _s, False), ("file_type", _s, False), ("source_file", _s, False), ("source_location", _s, True), ("line_end", _i, True), ("kind", _s, True),
    ("signature", _s, True), ("source_url", _s, True), ("captured_at", _s, True), ("author", _s, True), ("contributor", _s, True),
)
EDGE = _struct(
    ("source", _s, False), ("target", _s, False), ("relation", _s, False), ("confidence", _s, False), ("confidence_score", _d, False), ("source_file", _s, False),
    ("source_location", _s, True), ("weight", _d, False),
)
HYPEREDGE = _struct(("id", _s, False), ("label", _s, False), ("nodes", T.ArrayType(_s), False), ("relation", _s, False), ("confidence", _s, False), ("confidence_score", _d, False), ("source_file", _s, False))
COMMUNITY = _struct(("community_id", _i, False), ("node_id", _s, False), ("pos", _i, False))
COHESION = _struct(("community_id", _i, False), ("score", _d, False))
CONVERSATION = _struct(("id", _s, False), ("question", _s, True), ("summary", _s, True), ("timestamp", _s, True), ("relevant_nodes", T.ArrayType(_s), True), ("tokens_used", _i, True))
GOD_NODE = _struct(("id", _s, False), ("label", _s, True), ("edges", T.LongType(), True))
GRAPH_JSON = _struct(
    ("nodes", T.ArrayType(NODE), True), ("edges", T.ArrayType(EDGE), True), ("communities", T.MapType(_s, T.ArrayType(_s)), True), ("cohesion", T.MapType(_s, _d), True),
    ("god_nodes", T.ArrayType(GOD_NODE), True), ("community_labels", T.MapType(_s, _s), True),
)
MANIFEST = _struct(("path", _s, False), ("mtime", T.LongType(), True), ("hash", _s, True))
COST_RUN = _struct(("date", _s, False), ("input_tokens", T.LongType(), False), ("output_tokens", T.LongType(), False), ("files", T.LongType(), True))

# The names stored in graph documents.
FILE_TYPES = ("code", "document", "paper", "image", "video")
RELATIONS = (
    "calls", "implements", "references", "cites", "conceptually_related_to", "shares_data_with", "semantically_similar_to", "rationale_for", "imports", "imports_from", "contains", "method",
    "extends", "overrides", "depends_on",
)
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
CONFIDENCE_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.2}
CONVERSATION_RELATIONS = ("discusses", "relates_to", "follow_up_from")
CHAT_COMMUNITY = 0


def clean(c: str | Column) -> Column:
    """A stored name in its canonical form: no outer blanks, lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def confidence_rank(c: str = "confidence") -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(CONFIDENCES):
        out = F.when(F.col(c) == name, F.lit(k)).otherwise(out)
    return out


def confidence_score(c: str = "confidence") -> Column:
    out = F.lit(None).cast("double")
    for name, score in CONFIDENCE_SCORES.items():
        out = F.when(F.col(c) == name, F.lit(score)).otherwise(out)
    return out


def bad_values(edges: DataFrame) -> DataFrame:
    """column, value, n of relation and confidence values that no enumeration has."""
    parts = [
        edges.where(~F.coalesce(F.col(c).isin(*known), F.lit(False))).groupBy(F.lit(c).alias("column"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        for c, known in (("relation", RELATIONS), ("confidence", CONFIDENCES))
    ]
    return parts[0].unionByName(parts[1])


def checked(edges: DataFrame) -> DataFrame:
    """The edges; reading a row with an unknown relation or confidence fails (the reader's fail-fast mode)."""
    ok = F.col("relation").isin(*RELATIONS) & F.col("confidence").isin(*CONFIDENCES)
    return edges.withColumn("relation", F.when(F.coalesce(ok, F.lit(False)), F.col("relation")).otherwise(F.raise_error(F.concat(F.lit("unknown relation or confidence: "), F.coalesce("relation", F.lit("null"))))))
