"""Surprising connections, suggested questions, community labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.text import capitalize, code_category, words
from kgweave.operators.graph import Graph, assigned, cohesion, degrees, described_nodes, top_per_group
from kgweave.runtime import heavy_keys, join_unique
from kgweave.schema import confidence_rank

STRUCTURAL = ("imports", "imports_from", "contains", "method")
# Words that say nothing in a label.
STOP_WORDS = tuple((
    "the a an is are was were be been have has had do does did will would can could may might shall should of in to for with on at from by and or not no but if then else this that these those it its as into through during "
    "before after which who what when where how why all each every both few more most other some such than too very also just about up out over only "
    "class module function def type data new get set make create return import void null true false const let var pub fn func self super init main error result ok err some none just test spec mock stub helper util utils "
    "config settings options params args default base abstract interface impl handler manager builder factory adapter info detail item entry record value list map set array vec pair run exec call apply compute process "
    "start stop begin end open close add remove update delete insert append "
    "node edge graph community cluster group source target weight score index"
).split())


def _ends(graph: Graph, communities: DataFrame) -> DataFrame:
    """The edges with both ends' facts; ids without a node are unknown code without a file."""
    n = described_nodes(graph).select("id", "label", "source_file", "is_file", "is_concept")
    of = assigned(communities).withColumnRenamed("node_id", "id")
    facts = n.join(of, "id", "full_outer")
    out = graph.edges.select("source", "target", "relation", "confidence", "confidence_score")
    for p, end in (("s", "source"), ("t", "target")):
        side = facts.select(F.col("id").alias(end), *(F.col(c).alias(f"{p}_{c}") for c in ("label", "source_file", "is_file", "is_concept", "community_id")))
        out = join_unique(out, side, end, "left", graph.hubs)
        out = out.withColumn(f"{p}_label", F.coalesce(f"{p}_label", F.lit("unknown"))).withColumn(f"{p}_source_file", F.coalesce(f"{p}_source_file", F.lit("")))
        out = out.withColumn(f"{p}_is_file", F.coalesce(f"{p}_is_file", F.lit(False))).withColumn(f"{p}_is_concept", F.coalesce(f"{p}_is_concept", F.lit(True)))
    return out


def confidence_bonus() -> Column:
    return F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)


def surprise_score() -> Column:
    """Confidence bonus, 2 for another kind of file, 1 for another known community, and 1.5 bonuses (rounded to even) for similarity."""
    bonus = confidence_bonus()
    score = bonus + F.when(code_category("s_source_file") != code_category("t_source_file"), 2).otherwise(0)
    score = score + F.coalesce(F.when(F.col("s_community_id") != F.col("t_community_id"), 1).otherwise(0), F.lit(0))
    return score + F.when(F.col("relation") == "semantically_similar_to", F.bround(F.lit(1.5) * bonus).cast("int")).otherwise(0)


def surprise_reasons() -> Column:
    parts = F.array_compact(F.array(
        F.when(F.col("confidence") == "INFERRED", "inferred connection"),
        F.when(code_category("s_source_file") != code_category("t_source_file"), "crosses file types"),
        F.when(F.col("s_community_id") != F.col("t_community_id"), "bridges separate communities"),
        F.when(F.col("relation") == "semantically_similar_to", "semantically similar concepts"),
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("cross-file semantic connection"))


def cross_file_surprises(graph: Graph, communities: DataFrame, top: int | None = 5) -> DataFrame:
    rows = _ends(graph, communities).where((F.col("s_source_file") != "") & (F.col("t_source_file") != "") & (F.col("s_source_file") != F.col("t_source_file")))
    rows = rows.where(~F.col("relation").isin(*STRUCTURAL) & ~F.col("s_is_concept") & ~F.col("t_is_concept"))
    out = rows.select("source", "target", "relation", "confidence", surprise_score().alias("score"), surprise_reasons().alias("reason"))
    return out if top is None else out.orderBy(F.col("score").desc(), "source", "target").limit(top)


def cross_community_surprises(graph: Graph, communities: DataFrame, top: int | None = 5) -> DataFrame:
    """The first edge of each ordered pair of communities, the least certain first; an unassigned end differs from any community."""
    rows = _ends(graph, communities).where(~F.col("s_community_id").eqNullSafe(F.col("t_community_id")) & ~F.col("s_is_file") & ~F.col("t_is_file") & ~F.col("relation").isin(*STRUCTURAL))
    keyed = rows.select(F.coalesce("s_community_id", F.lit(-1)).alias("from_community"), F.coalesce("t_community_id", F.lit(-1)).alias("to_community"), confidence_rank().alias("rank"), "source", "target", "relation", "confidence")
    first = keyed.groupBy("from_community", "to_community").agg(F.min(F.struct((-F.col("rank")).alias("r"), "source", "target", "relation", "confidence")).alias("x"))
    out = first.select("from_community", "to_community", "x.source", "x.target", "x.relation", "x.confidence", (-F.col("x.r")).alias("rank"))
    return out if top is None else out.orderBy(F.col("rank").desc(), "source", "target").limit(top)


def surprising_connections(graph: Graph, communities: DataFrame, top: int = 5) -> DataFrame:
    """Cross-file where the nodes come from several files, else cross-community: source, target, relation, confidence."""
    several = graph.nodes.where(F.col("source_file") != "").select("source_file").distinct().limit(2).count() > 1
    rows = cross_file_surprises(graph, communities, top) if several else cross_community_surprises(graph, communities, top)
    return rows.select("source", "target", "relation", "confidence")


def inverse_degree(degree: str = "degree") -> Column:
    return F.lit(1.0) / F.greatest(F.lit(1), F.col(degree))


def suggested_questions(graph: Graph, communities: DataFrame, top: int = 7) -> DataFrame:
    """ord, kind, subject, question: three ambiguous edges, three bridge-like nodes, then communities of little cohesion."""
    labels = graph.nodes.select("id", "label")
    amb = graph.edges.where("confidence = 'AMBIGUOUS'").orderBy("source", "target").limit(3)
    amb = amb.join(labels.withColumnsRenamed({"id": "source", "label": "sl"}), "source", "left").join(labels.withColumnsRenamed({"id": "target", "label": "tl"}), "target", "left")
    q1 = amb.select(F.lit(1).alias("ord"), F.lit("ambiguous_edge").alias("kind"), F.concat("source", F.lit("->"), "target").alias("subject"), F.concat(F.lit("What is the exact relationship between `"), F.coalesce("sl", F.lit("unknown")), F.lit("` and `"), F.coalesce("tl", F.lit("unknown")), F.lit("`?")).alias("question"))
    d = described_nodes(graph).where("not is_file").withColumn("b", inverse_degree()).orderBy(F.col("b").desc(), "id").limit(3)
    q2 = d.select(F.lit(2).alias("ord"), F.lit("bridge_node").alias("kind"), F.col("id").alias("subject"), F.concat(F.lit("Why does `"), "label", F.lit("` connect across communities?")).alias("question"))
    low = cohesion(graph, communities).where("size >= 5 and score < 0.15")
    q3 = low.orderBy("community_id").limit(top).select(F.lit(3).alias("ord"), F.lit("low_cohesion").alias("kind"), F.col("community_id").cast("string").alias("subject"), F.concat(F.lit("Should `Community "), F.col("community_id").cast("string"), F.lit("` be split into smaller, more focused modules?")).alias("question"))
    return q1.unionByName(q2).unionByName(q3).orderBy("ord", "subject").limit(top)


def label_terms(graph: Graph, communities: DataFrame) -> DataFrame:
    """community_id, word, tf, df: words of member labels weighted by degree over the community's mean, and their communities."""
    named = communities.select("community_id", "node_id").distinct().join(graph.nodes.select(F.col("id").alias("node_id"), "label"), "node_id").join(degrees(graph).withColumnRenamed("id", "node_id"), "node_id", "left").na.fill(0, ["degree"])
    mean = named.groupBy("community_id").agg(F.avg("degree").alias("mean"))
    w = join_unique(named, mean, "community_id", "inner", heavy_keys(named, "community_id")).select("community_id", F.greatest(F.lit(1.0), F.col("degree") / F.greatest(F.lit(1.0), F.col("mean"))).alias("w"), F.explode(words(F.lower("label"))).alias("word"))
    w = w.where((F.length("word") > 1) & ~F.col("word").isin(*STOP_WORDS))
    tf = w.groupBy("community_id", "word").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return join_unique(tf, df, "word", "inner", heavy_keys(tf, "word")).select("community_id", "word", "tf", "df")


def simple_labels(graph: Graph, communities: DataFrame) -> DataFrame:
    """community_id, label: the three most frequent words of the members' labels, ties by word, else 'Unnamed Community'."""
    named = communities.select("community_id", "node_id").distinct().join(graph.nodes.select(F.col("id").alias("node_id"), "label"), "node_id")
    w = named.select("community_id", F.explode(words(F.lower("label"))).alias("word")).where((F.length("word") > 1) & ~F.col("word").isin(*STOP_WORDS))
    top = top_per_group(w.groupBy("community_id", "word").agg(F.count(F.lit(1)).alias("n")), ["community_id"], [F.col("n").desc(), F.col("word").asc()], 3)
    label = top.groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "word"))), lambda x: capitalize(x["word"])), " ").alias("label"))
    return communities.select("community_id").distinct().join(label, "community_id", "left").select("community_id", F.coalesce("label", F.lit("Unnamed Community")).alias("label"))


def community_labels(graph: Graph, communities: DataFrame) -> DataFrame:
    """community_id, label: the three words of the highest tf * ln(communities / df), else 'Unnamed Community'."""
    n = communities.select("community_id").distinct().count()
    scored = label_terms(graph, communities).withColumn("score", F.round(F.col("tf") * F.log(F.lit(float(max(n, 1))) / F.col("df")), 9))
    top = top_per_group(scored, ["community_id"], [F.col("score").desc(), F.col("word").asc()], 3)
    named = top.groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "word"))), lambda x: capitalize(x["word"])), " ").alias("label"))
    return communities.select("community_id").distinct().join(named, "community_id", "left").select("community_id", F.coalesce("label", F.lit("Unnamed Community")).alias("label"))


def label_prompt(graph: Graph, communities: DataFrame, members: int = 10) -> DataFrame:
    """community_id, prompt: cohesion, size and the best connected labels, as text for a labelling model."""
    named = communities.join(graph.nodes.select(F.col("id").alias("node_id"), "label"), "node_id").join(degrees(graph).withColumnRenamed("id", "node_id"), "node_id", "left").na.fill(0, ["degree"])
    best = top_per_group(named.select("community_id", "node_id", "label", "degree"), ["community_id"], [F.col("degree").desc(), F.col("node_id").asc()], members)
    text = best.groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "label"))), lambda x: F.concat(F.lit("- "), x["label"])), "\n").alias("list"))
    c = cohesion(graph, communities)
    return c.join(text, "community_id").select("community_id", F.concat(F.lit("Community "), F.col("community_id").cast("string"), F.lit(" ("), F.col("size").cast("string"), F.lit(" nodes, cohesion "), F.format_number("score", 3), F.lit("):\n"), "list").alias("prompt"))
