"""How distinctive a term is per record: smoothed language-model divergence.

A term's score is its contribution to the relative entropy between the record's Dirichlet-smoothed term distribution and
the collection's: ``p(t|r) * ln(p(t|r) / p(t|C))`` with ``p(t|r) = (tf + mu * p(t|C)) / (|r| + mu)``. Common terms have a
ratio near 1 and count little, rare ones much; terms of fewer than ``min_df`` records tie nothing together and are left
out (of the scores, not of the counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.runtime import heavy_keys, join_unique

MU = 50.0
MIN_DF = 2


def label_words(c: Column) -> Column:
    """Runs of letters A-Z, split where a small letter meets a capital, in lower case."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), F.lit("([A-Za-z]+)")), F.lower)


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """rec_key, term, tf over all rows of a record."""
    words = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("rec_key"), F.explode(label_words(F.col(text))).alias("term"))
    return words.groupBy("rec_key", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_scores(rows: DataFrame, key: str = "id", text: str = "label", mu: float = MU, min_df: int = MIN_DF, rare_df: int | None = None, min_length: int = 1) -> DataFrame:
    """rec_key, term, tf, df, cf, record_length, score for every term of every record in at least ``min_df`` records.

    With ``rare_df`` only terms as characteristic as rare ones stay: the score must reach ``least``, which the term would have
    here if it were as frequent in the collection as the most frequent term of ``rare_df`` records or fewer. The score falls
    as the collection's count grows, so every term of ``rare_df`` records passes, in any collection. ``min_length`` keeps
    only longer terms of the result; every count is over all terms and rows.
    Rows of one key are one record. Null keys are left out; null and empty texts have no terms; repeated rows count
    again, as they do in the collection. Extra columns are ignored; an empty table gives no rows.
    """
    tf = term_counts(rows, key, text)
    lengths = tf.groupBy("rec_key").agg(F.sum("tf").alias("record_length"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    total, edge = stats.agg(F.sum("cf"), F.max(F.when(F.col("df") <= (rare_df or 0), F.col("cf")))).first()
    kept = stats.where((F.col("df") >= min_df) & (F.length("term") >= min_length))
    if rare_df is not None:
        kept = kept.where(F.col("cf") <= (edge or 0))  # what is more frequent scores less than ``least`` everywhere
    # a term of so few occurrences cannot be heavy
    heavy = heavy_keys(tf, "term") if rare_df is None else []
    scored = join_unique(tf, kept, "term", "inner", heavy).join(lengths, "rec_key")

    def divergence(cf: Column) -> Column:
        pc = cf / F.lit(float(max(total or 0, 1)))
        pr = (F.col("tf") + F.lit(mu) * pc) / (F.col("record_length") + F.lit(mu))
        return pr * F.log(pr / pc)

    out = scored.select("rec_key", "term", "tf", "df", "cf", "record_length", divergence(F.col("cf")).alias("score"), divergence(F.lit(edge or 1)).alias("least"))
    return out.drop("least") if rare_df is None else out.where(F.col("score") >= F.col("least") - 1e-12).drop("least")


def shared_rare_terms(scores: DataFrame) -> DataFrame:
    """node_a, node_b, terms, weight: pairs of records that share a term, and the scores that both have for the shared terms.

    For scores of terms in few records, which bounds the pairs of a term.
    """
    lists = scores.groupBy("term").agg(F.sort_array(F.collect_list(F.struct(F.col("rec_key").alias("node"), "score"))).alias("held"))
    left = lists.select("held", F.posexplode("held").alias("at", "a"))
    pairs = left.select("a", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("b"))
    return pairs.groupBy(F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b")).agg(F.count(F.lit(1)).alias("terms"), F.sum(F.col("a.score") + F.col("b.score")).alias("weight"))
