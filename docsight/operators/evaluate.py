"""Evaluation: attempts, verdicts, composites, intervals, agreement, answers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .retrieve import first_rows


def roll_up(attempts: DataFrame, case: str) -> DataFrame:
    """(case, n, passed, verdict) from attempts with ``ok`` (true, false, null: pending) and ``error``.

    exec_error if every attempt failed to run, pending if any is undecided, else pass, fail or unstable.
    """
    grouped = attempts.groupBy(case).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ok")).alias("passed"),
        F.bool_and("error").alias("all_error"),
        F.bool_or(F.col("ok").isNull() & ~F.col("error")).alias("waiting"),
        F.bool_and("ok").alias("all_ok"),
        F.bool_or("ok").alias("any_ok"),
    )
    verdict = (
        F.when(F.col("all_error"), "exec_error").when(F.col("waiting"), "pending").when(F.col("all_ok"), "pass").when(~F.col("any_ok"), "fail").otherwise("unstable")
    )
    return grouped.select(case, "n", "passed", verdict.alias("verdict"))


def _poisson(most: int = 7) -> list[int]:
    """Upper bounds, out of 2 ** 32, of the draws that give 0, 1, ... times at mean 1."""
    out, total, p = [], 0.0, math.exp(-1)
    for k in range(1, most + 1):
        total += p
        out.append(round(total * 2**32))
        p /= k
    return out


POISSON = _poisson()


def composite(rows: DataFrame, weight: str, rate: str) -> DataFrame:
    """Weighted mean over positive weights; null without any."""
    return rows.filter(F.col(weight) > 0).agg(F.round(F.sum(F.col(weight) * F.col(rate)) / F.sum(weight), 6).alias("score"))


def bootstrap(rows: DataFrame, case: str, weight: str, rate: str, resamples: int = 2000) -> DataFrame:
    """(low, high): order statistics 2.5 % and 97.5 % of the weighted composite over resampled cases.

    In each resample a case counts as often as a Poisson draw of mean 1 says,
    fixed by the MD5 of its id and the resample's number.  Rows are summed
    once a case before they are drawn, and resamples before any shuffle.
    """
    cases = rows.filter(F.col(weight) > 0).groupBy(case).agg(F.sum(F.col(weight) * F.col(rate)).alias("v"), F.sum(weight).alias("w"))
    u = F.conv(F.left(F.md5(F.concat_ws(":", F.col(case).cast("string"), F.col("b").cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long")
    times = F.lit(0)
    for bound in POISSON:
        times = times + (u >= bound).cast("int")
    drawn = cases.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("n", times)
    means = drawn.groupBy("b").agg((F.sum(F.col("n") * F.col("v")) / F.sum(F.col("n") * F.col("w"))).alias("m"))
    ranked = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # one number for each resample
    return ranked.select(
        F.round(F.element_at("m", F.lit(int(resamples * 0.025) + 1)), 6).alias("low"), F.round(F.element_at("m", F.lit(int(resamples * 0.975) + 1)), 6).alias("high")
    )


def percentile_by_index(rows: DataFrame, group: str, value: str, share: float = 0.9) -> DataFrame:
    """(group, item): the item at floor(share * n) of a group's sorted values, unlike an interpolated percentile.

    Equal values are counted before they are put in order.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(group).orderBy(value)
    cum = counts.withColumn("cum", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    return cum.groupBy(group).agg(F.min(F.when(F.col("cum") > F.least(F.floor(F.col("all") * share), F.col("all") - 1), F.col(value))).alias("item"))


def answer_scores(pairs: DataFrame) -> DataFrame:
    """Adds em, contains and f1 of ``pred`` against ``gold`` (token multisets of normalised answers)."""
    n = pairs.withColumn("p", tx.qa_normalized(F.col("pred"))).withColumn("g", tx.qa_normalized(F.col("gold")))
    pt, gt = F.filter(F.split("p", " "), lambda x: x != ""), F.filter(F.split("g", " "), lambda x: x != "")
    common = F.aggregate(
        F.array_distinct(gt),
        F.lit(0),
        lambda s, t: s + F.least(F.size(F.filter(pt, lambda x: x == t)), F.size(F.filter(gt, lambda x: x == t))),
    )
    f1 = F.when((F.size(pt) + F.size(gt)) > 0, 2 * common / (F.size(pt) + F.size(gt))).otherwise(0.0)
    return n.select(*pairs.columns, (F.col("p") == F.col("g")).alias("em"), ((F.col("g") != "") & F.col("p").contains(F.col("g"))).alias("contains"), F.round(f1, 4).alias("f1"))


def pairwise_agreement(labels: DataFrame) -> DataFrame:
    """(run_a, run_b, shared, agree, mean_diff) of runs (run, key, value) on their common keys."""
    a = labels.select(F.col("run").alias("run_a"), "key", F.col("value").alias("va"))
    b = labels.select(F.col("run").alias("run_b"), "key", F.col("value").alias("vb"))
    return a.join(b, "key").filter("run_a < run_b").groupBy("run_a", "run_b").agg(
        F.count(F.lit(1)).alias("shared"), F.round(F.avg((F.col("va") == F.col("vb")).cast("int")), 6).alias("agree"), F.round(F.avg(F.abs(F.col("va") - F.col("vb"))), 6).alias("mean_diff")
    )


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn = 1").drop("rn")


def stratified_budget(rows: DataFrame, stratum: str, size: str, quota: int, key: str) -> DataFrame:
    """Rows of each stratum in a fixed random order while the sum before a row is below the quota.

    The order is cut where the sum reaches the quota, which ``quota`` rows
    of some size do; the cut then filters all rows.  Null sizes count as none.
    """
    order = F.struct(F.md5(F.col(key).cast("string").cast("binary")).alias("h"), F.col(key).alias("k"))
    sized = rows.filter(F.col(size) > 0).select(F.col(stratum).alias("__s"), order.alias("__o"), F.col(size).alias("__n"))
    by = Window.partitionBy("__s").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    cum = first_rows(sized, ["__s"], ["__o"], max(quota, 1)).withColumn("cum", F.sum("__n").over(by))
    cuts = cum.filter(F.col("cum") >= quota).groupBy("__s").agg(F.min("__o").alias("__cut"))
    both = rows.withColumn("__o", order).join(cuts, F.col(stratum).eqNullSafe(F.col("__s")), "left")
    return both.filter(F.col("__cut").isNull() | (F.col("__o") <= F.col("__cut"))).select(*rows.columns)
