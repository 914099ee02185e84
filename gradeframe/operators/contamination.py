"""Log-probability statistics: LM loss, Min-K%, ROC AUC."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gradeframe.functions.scores import MIN_K, min_k_stat
from gradeframe.plans.ordered import before, block_count, quantile_bounds, with_bound_block


def mean_loss(responses: DataFrame) -> DataFrame:
    """Unweighted mean over sequences."""
    return responses.agg(F.avg("lm_loss").alias("avg_loss"))


def labelled_union(parts: Sequence[tuple[DataFrame, int | None]]) -> DataFrame:
    """Datasets with their group label (0 if none), pooled."""
    tagged = [df.withColumn("group_label", F.lit(label or 0)) for df, label in parts]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def min_k(responses: DataFrame, ks: Sequence[float] = MIN_K) -> DataFrame:
    """One row per sequence and k with a statistic; sequences too short for a k have no row."""
    rows = responses.withColumn("_sorted", F.sort_array("token_logprobs"))
    stats = F.array(
        *[
            F.struct(F.lit(float(k)).alias("k"), min_k_stat(F.col("_sorted"), k).alias("stat"))
            for k in ks
        ]
    )
    out = rows.select("uuid", "group_label", F.explode(stats).alias("s"))
    return out.select("uuid", "group_label", "s.k", "s.stat").where(F.col("stat").isNotNull())


def roc_auc(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null with a single class.

    Rows shrink to distinct scores first. Each group's scores are cut into blocks at approximate
    quantiles; a block needs only its own rows (positives times negatives below, within the block)
    and is then one row, combined along the group's few blocks. Any cut gives the same result.
    """
    by, blocks = list(by), blocks or block_count(df)
    group = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(1))
    positive = F.col(label).cast("boolean")
    hist = base.groupBy(*group, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg")
    )
    # The totals are taken here too: with all of its columns in use on both sides, the histogram
    # is shuffled once and reused.
    cuts = hist.groupBy(*group).agg(
        F.array_distinct(quantile_bounds(F.col("_score"), blocks)).alias("_cuts"),
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
    )
    if by:
        cut = hist.join(cuts, by)
    else:
        whole = cuts.select(F.struct("_cuts", "n_pos", "n_neg")).scalar()
        cut = hist.withColumn("_c", whole).select(*hist.columns, "_c.*")
    cut = with_bound_block(cut, "_score", "_cuts", blocks)
    totals = ["n_pos", "n_neg"]
    cut = cut.select(*group, *totals, "_block", "_score", "_pos", "_neg")
    below = F.coalesce(F.sum("_neg").over(before([*group, "_block"], ["_score"])), F.lit(0))
    inner = cut.withColumn("_u", F.col("_pos") * (below + F.col("_neg") / 2))
    parts = inner.groupBy(*group, *totals, "_block").agg(
        F.sum("_u").alias("_u"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
    )
    lower = F.coalesce(F.sum("_neg").over(before(group, ["_block"])), F.lit(0))
    joined = parts.withColumn("_u", F.col("_u") + F.col("_pos") * lower)
    out = joined.groupBy(*group, *totals).agg(F.sum("_u").alias("_u"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.select(*by, F.try_divide(F.col("_u"), pairs).alias("auc"), "n_pos", "n_neg")


def min_k_auc(responses: DataFrame, ks: Sequence[float] = MIN_K) -> DataFrame:
    """Contamination AUC per k. The statistic is negated: a lower loss means a member."""
    name = F.concat(F.lit("min_k_prob_"), F.col("k").cast("string"))
    stats = min_k(responses, ks).select(
        name.alias("metric"), (-F.col("stat")).alias("score"), "group_label"
    )
    return roc_auc(stats, "score", "group_label", ["metric"])
