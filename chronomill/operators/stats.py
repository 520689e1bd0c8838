"""Evaluation statistics as mergeable aggregates: rates, confusion, agreement, intervals, pooling, samples.

All of them combine before the shuffle, so a hot group costs no more than others. Ratios over nothing are 0.0,
or null with ``null_on_zero``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomill.common import col


def ratio(a: Column, b: Column, null_on_zero: bool = False) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if null_on_zero else F.coalesce(r, F.lit(0.0))


def success_rates(df: DataFrame, by: list[str], passed: Column, stale: Column, latency: Column) -> DataFrame:
    """Total, passed, success rate, stale count and rate, mean latency; null flags count as false."""
    g = df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(passed).alias("n_passed"), F.count_if(stale).alias("n_stale"), F.avg(latency).alias("_l")
    )
    return g.select(
        *by, "total", "n_passed", F.round(ratio(F.col("n_passed"), F.col("total")), 4).alias("tsr"), "n_stale",
        F.round(ratio(F.col("n_stale"), F.col("total")), 4).alias("stale_rate"), F.round("_l", 2).alias("avg_latency_ms"),
    )


def confusion(df: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """TP, TN, FP, FN and abstentions (null prediction); the positive class is ``true``. Null truth is left out."""
    t, p = truth, predicted
    return df.where(t.isNotNull()).groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(p.isNull()).alias("abstained")
    )


def quality(c: DataFrame) -> DataFrame:
    """Coverage, accuracies, precision, recall, F1 and both false-invalidation rates from a confusion table.

    Truth and prediction mean *stale*: a false positive is a valid record taken for stale.
    """
    tp, tn, fp, fn, ab = (F.col(x) for x in ("tp", "tn", "fp", "fn", "abstained"))
    decided = tp + tn + fp + fn
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    rates = {
        "coverage": ratio(decided, decided + ab),
        "accuracy_decided": ratio(tp + tn, decided),
        "accuracy_overall": ratio(tp + tn, decided + ab),
        "precision": p,
        "recall": r,
        "f1": ratio(2 * p * r, p + r),
        "false_invalidation_rate": ratio(fp, fp + tn),
        "stale_exposure_rate": ratio(fn, fn + tp),
        "valid_recall": ratio(tn, fp + tn),
    }
    return c.select("*", *[F.round(v, 6).alias(k) for k, v in rates.items()])


def validity(df: DataFrame, valid: Column, active: Column) -> DataFrame:
    """Ten counts and rates of a validity mechanism: what it kept and dropped against what was valid."""
    g = df.agg(
        F.count("*").alias("total_samples"),
        F.count_if(valid).alias("total_valid"),
        F.count_if(~valid).alias("total_stale"),
        F.count_if(active).alias("total_active"),
        F.count_if(valid & ~active).alias("false_invalidations"),
        F.count_if(valid & active).alias("_kept"),
        F.count_if(~valid & active).alias("stale_exposures"),
        F.count_if(~valid & ~active).alias("_dropped"),
    )
    rate = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6)
    return g.select(
        "total_samples", "total_valid", "total_stale", "total_active", "false_invalidations",
        rate("false_invalidations", "total_valid").alias("false_invalidation_rate"), rate("_kept", "total_valid").alias("valid_recall"),
        "stale_exposures", rate("stale_exposures", "total_stale").alias("stale_exposure_rate"), rate("_dropped", "total_stale").alias("stale_recall"),
    )


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed agreement and Cohen's kappa of two label columns; one where chance agreement is certain."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("_n"))
    both = pairs.select(F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col(a).alias("l")), F.struct(F.lit("b").alias("s"), F.col(b).alias("l")))).alias("x"), "_n")
    margins = both.groupBy("x.l").agg(F.sum(F.when(F.col("x.s") == "a", F.col("_n")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("x.s") == "b", F.col("_n")).otherwise(0)).alias("_b"))
    zero = F.lit(0).cast("bigint")
    chance = margins.select(zero.alias("n"), zero.alias("_same"), (F.col("_a").cast("double") * F.col("_b")).alias("_ab"))
    seen = pairs.select(F.col("_n").alias("n"), F.when(F.col(a) == F.col(b), F.col("_n")).otherwise(zero).alias("_same"), F.lit(0.0).alias("_ab"))
    po, pe = F.col("_same") / F.col("n"), F.col("_ab") / (F.col("n").cast("double") * F.col("n"))
    return seen.unionByName(chance).agg(*[F.sum(c).alias(c) for c in ("n", "_same", "_ab")]).select(
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round(F.coalesce(po, F.lit(0.0)), 6).alias("agreement"),
        F.round(F.when(pe >= 1.0, 1.0).otherwise(F.coalesce((po - pe) / (1.0 - pe), F.lit(0.0))), 6).alias("kappa"),
    )


# Cumulative probabilities of a Poisson variable with mean one, for 0, 1, 2, … copies.
_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def bootstrap_interval(df: DataFrame, key: str, value: str, resamples: int = 2000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean and percentile interval of a bootstrap over rows, each row drawn a Poisson number of times.

    The copies of a row in a resample follow from a hash of both, so any engine and partitioning gives the same
    interval, and resamples are sums that combine before the shuffle: no row is joined or moved.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("_r").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = sum(F.when(u >= p, 1).otherwise(0) for p in _POISSON)
    drawn = df.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_r")).withColumn("_c", copies)
    means = drawn.groupBy("_r").agg((F.sum(F.col("_c") * F.col("_v")) / F.sum("_c")).alias("_m"))
    return means.agg(F.round(F.percentile("_m", F.lit(low)), 4).alias("ci_low"), F.round(F.percentile("_m", F.lit(high)), 4).alias("ci_high"), F.round(F.avg("_m"), 4).alias("resampled_mean"))


def pooled(df: DataFrame, matched_required: str, matched_optional: str, required: str, optional: str, claims: str) -> DataFrame:
    """Precision, recall, F1 and optional discovery over summed counts (micro average)."""
    g = df.agg(*[F.sum(c).alias(c) for c in (matched_required, matched_optional, required, optional, claims)])
    p, r = ratio(F.col(matched_required) + F.col(matched_optional), F.col(claims)), ratio(F.col(matched_required), F.col(required))
    return g.select(
        "*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), F.round(ratio(F.col(matched_optional), F.col(optional)), 6).alias("optional_discovery"),
    )


def pooled_ratio(c: str | Column) -> tuple[Column, Column, Column]:
    """Summed numerator, denominator and percentage (one decimal) of texts like '1/3'; others count nothing."""
    part = lambda i: F.regexp_extract(col(c), r"^\s*(\d+)\s*/\s*(\d+)\s*$", i).try_cast("bigint")
    a, b = F.coalesce(F.sum(part(1)), F.lit(0)), F.coalesce(F.sum(part(2)), F.lit(0))
    return a, b, F.round(100 * ratio(a, b), 1)


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share of each value, largest first."""
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the counted values, not over rows
    return g.withColumn("pct", F.round(100 * F.col("n") / total, 2)).orderBy(F.desc("n"), F.asc_nulls_first(label))


def capped(df: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group in a total order. The limit is applied per partition before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= cap)


def capped_by_label(df: DataFrame, by: list[str], label: str, caps: dict[str, int], order: list[Column], total: int) -> DataFrame:
    """At most ``caps[label]`` rows of each label in each group, and of these the first ``total`` in order of group and rows.

    Labels without a cap give no row.
    """
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
    placed = df.where(F.col(label).isin(*caps)).withColumn("place", F.row_number().over(Window.partitionBy(*by, label).orderBy(*order)))
    return placed.where(F.col("place") <= cap[F.col(label)]).orderBy(*by, *order).limit(total)
