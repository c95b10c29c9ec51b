"""Ranking of candidates, ground truth, reciprocal rank; correlation of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_k(scored: DataFrame, query: list[str], score: str, tie: str, k: int = 5) -> DataFrame:
    """The k best rows of each query, with their rank; ties by `tie`."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*query).orderBy(F.desc(score), tie))).filter(F.col("rank") <= k)


def ground_truth(labels: DataFrame, order: str = "label_id") -> DataFrame:
    """(paper, key, true_id), all three not blank; the last record of a key counts."""
    ok = labels.filter((F.trim("paper") != "") & (F.trim("key") != "") & (F.trim("true_id") != ""))
    return ok.groupBy("paper", "key").agg(F.max_by("true_id", order).alias("true_id"))


def reciprocal_rank(ranked: DataFrame, truth: DataFrame, query: list[str], denominator: str = "labelled") -> DataFrame:
    """(query, rr): 1 / rank of the true candidate, 0 if it is not ranked. `all`: queries without truth count as 0."""
    hit = ranked.join(truth, query).filter(F.col("cand_id") == F.col("true_id")).groupBy(*query).agg((1.0 / F.min("rank")).alias("rr"))
    base = truth.select(*query).distinct() if denominator == "labelled" else ranked.select(*query).distinct().union(truth.select(*query)).distinct()
    return base.join(hit, query, "left").select(*query, F.coalesce("rr", F.lit(0.0)).alias("rr"))


def _corr(a: str, b: str) -> Column:
    """Pearson's correlation; null where a side does not vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, corr) of each feature with the label, in one pass."""
    row = df.agg(*[_corr(f, label).alias(f) for f in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.col(f), 6).alias("corr")) for f in features])).alias("x")).select("x.*")


def collinear(df: DataFrame, features: list[str], above: float = 0.85) -> DataFrame:
    """(feature_a, feature_b, corr) of all pairs of features whose correlation exceeds `above`."""
    df = df.select(*features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    x = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.round(F.col(f"c{i}"), 6).alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(x).alias("x")).select("x.*").filter(F.abs("corr") > above)


#: The features that are left after those that say the same are taken out.
SELECTED = ["feat_title_tfidf_cosine", "feat_title_len_diff", "feat_auth_jaccard", "feat_year_match", "feat_id_match", "feat_first_auth_match"]
