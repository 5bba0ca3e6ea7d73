"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.llm import credentials, distinctive, language, leakage, packing, pairs, provenance
from kgweave.runtime import table


def _p1_pairs(spark, d):
    scores = distinctive.term_scores(table(spark, d, "nodes"), rare_df=3, min_length=6)
    return distinctive.shared_rare_terms(scores.where("df <= 3"))


def p1_found(spark, d):
    return _p1_pairs(spark, d).select("node_a", "node_b")


def p1_pairs(spark, d):
    return _p1_pairs(spark, d).select("node_a", "node_b", "terms", F.round("weight", 6).alias("weight"))


def p1_scores(spark, d):
    s = distinctive.term_scores(table(spark, d, "nodes"))
    return s.select("rec_key", "term", "tf", "df", F.round("score", 6).alias("score"))


def p2_found(spark, d):
    found = credentials.all_credentials(table(spark, d, "nodes"), table(spark, d, "files"))
    return found.select("field_name", "rec_key").distinct()


def p2_redacted(spark, d):
    return credentials.all_credentials(table(spark, d, "nodes"), table(spark, d, "files")).distinct()


def p5_found(spark, d):
    kinds = provenance.provenance(table(spark, d, "files"))
    return kinds.where("kind <> 'hand_written'").select(F.col("path").alias("source_file")).distinct()


def p5_kinds(spark, d):
    return provenance.provenance(table(spark, d, "files"))


def p6_found(spark, d):
    model = language.fit(table(spark, d, "documents"))
    return pairs.broken_pairs(table(spark, d, "conversations"), model).select("conv_id", "defect")


def p7_containers(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p7_fill(spark, d):
    windows = table(spark, d, "context_windows")
    return packing.fill_report(packing.pack(table(spark, d, "documents"), windows), windows)


def p7_invariants(spark, d):
    """What must hold of any packing: every document has its place for each size, no container is over its capacity, no
    document is cut that fits one, and no token is lost."""
    docs, windows = table(spark, d, "documents"), table(spark, d, "context_windows")
    placed = packing.pack(docs, windows)
    caps = windows.where("capacity_tokens > 0").select("window_id", F.col("capacity_tokens").alias("cap"))
    boxes = placed.where("container <> '-'").groupBy("window_id", "container").agg(F.sum("n_tokens").alias("t")).join(caps, "window_id")
    over = boxes.groupBy("window_id").agg(F.count_if(F.col("t") > F.col("cap")).alias("overfull"))
    each = placed.groupBy("window_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("t")).join(caps, "window_id").join(packing.token_counts(docs), "doc_id")
    docs_of = each.groupBy("window_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("cap"))).alias("cut"), F.count_if(F.col("t") != F.col("n_tokens")).alias("lost"))
    return docs_of.join(over, "window_id").select("window_id", "documents", "overfull", "cut", "lost")


def p8_found(spark, d):
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_matches(spark, d):
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    docs = table(spark, d, "documents")
    return language.relabelled(language.label_segments(docs, language.fit(docs)))


def p9_segments(spark, d):
    docs = table(spark, d, "documents")
    return language.label_segments(docs, language.fit(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_scores, p2_found, p2_redacted, p5_found, p5_kinds, p6_found, p7_containers, p7_fill, p7_invariants, p8_found, p8_matches, p9_found, p9_segments)}

_WORDS = r"""
words AS (
  SELECT id AS rec_key, lower(unnest(regexp_extract_all(regexp_replace(label, '([a-z])([A-Z])', '\1 \2', 'g'), '[A-Za-z]+'))) AS term
  FROM nodes WHERE id IS NOT NULL),
tf AS (SELECT rec_key, term, count(*) AS tf FROM words GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY ALL),
ln AS (SELECT rec_key, sum(tf) AS n FROM tf GROUP BY ALL),
tot AS (SELECT sum(cf) AS total FROM st)
"""

ORACLE = {
    "p1_found": f"""WITH {_WORDS}, r AS (SELECT t.rec_key, t.term FROM tf t JOIN st s USING (term) WHERE s.df <= 3 AND length(t.term) >= 6)
        SELECT DISTINCT a.rec_key AS node_a, b.rec_key AS node_b FROM r a JOIN r b USING (term) WHERE a.rec_key < b.rec_key""",
    "p1_pairs": f"""WITH {_WORDS}, x AS (
          SELECT t.rec_key, t.term, s.cf / total AS pc, (t.tf + {distinctive.MU} * (s.cf / total)) / (ln.n + {distinctive.MU}) AS pr
          FROM tf t JOIN st s USING (term) JOIN ln USING (rec_key) CROSS JOIN tot WHERE s.df BETWEEN 2 AND 3 AND length(t.term) >= 6),
        r AS (SELECT rec_key, term, pr * ln(pr / pc) AS score FROM x)
        SELECT a.rec_key AS node_a, b.rec_key AS node_b, count(*) AS terms, round(sum(a.score + b.score), 6) AS weight FROM r a JOIN r b USING (term) WHERE a.rec_key < b.rec_key GROUP BY ALL""",
    "p7_invariants": "SELECT window_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS cut, 0::BIGINT AS lost FROM context_windows WHERE capacity_tokens > 0",
    "p1_scores": f"""WITH {_WORDS}, x AS (
          SELECT t.rec_key, t.term, t.tf, s.df, s.cf / total AS pc, (t.tf + {distinctive.MU} * (s.cf / total)) / (ln.n + {distinctive.MU}) AS pr
          FROM tf t JOIN st s USING (term) JOIN ln USING (rec_key) CROSS JOIN tot WHERE s.df >= {distinctive.MIN_DF})
        SELECT rec_key, term, tf, df, round(pr * ln(pr / pc), 6) AS score FROM x""",
}
