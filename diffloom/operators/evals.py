"""Evaluation of scores against labels: confusion, reliability, threshold search, logistic fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diffloom.functions.scalars import round_to, sigmoid


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def pairs(labels: DataFrame, scores: DataFrame, *keys: str) -> DataFrame:
    """``labels`` with the best score of their key: ``p_eff`` is 0 where there is none."""
    best = scores.groupBy(*keys).agg(F.max("p_eff").alias("p_eff"))
    return labels.join(best, list(keys), "left").withColumn("p_eff", F.coalesce("p_eff", F.lit(0.0)))


def unlabelled(scores: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """Scores whose key has no label."""
    return scores.join(labels.select(*keys).distinct(), list(keys), "left_anti")


def confusion(threshold: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn, precision, recall, f1, fpr of (positive, p_eff); a ratio over nothing is 0."""
    hit, pos = F.col("p_eff") >= threshold, F.col("positive")
    tp, fp, fn, tn = F.count_if(hit & pos), F.count_if(hit & ~pos), F.count_if(~hit & pos), F.count_if(~hit & ~pos)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        round_to(_ratio(tp, tp + fp)).alias("precision"), round_to(_ratio(tp, tp + fn)).alias("recall"),
        round_to(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), round_to(_ratio(fp, fp + tn)).alias("fpr"),
    ]


def grouped_confusion(scored: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Confusion overall and by each of ``keys`` in one pass (grouping sets); the other keys are null."""
    sets = [[], *([F.col(k)] for k in keys)]
    return scored.groupingSets(sets, *keys).agg(*confusion(F.lit(threshold)))


def reliability(scored: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, n, mean_p, rate): bins by double edges i / bins, the last closed; empty bins have their midpoint and 0."""
    width = 1.0 / bins
    spark = scored.sparkSession
    edges = spark.createDataFrame([(i, i * width, (i + 1) * width if i + 1 < bins else 1.0) for i in range(bins)], "bin int, lo double, hi double")
    p = F.col("p_eff")
    place = F.coalesce(*(F.when((p >= i * width) & (p < (i + 1) * width), F.lit(i)) for i in range(bins - 1)), F.lit(bins - 1))
    per = scored.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_eff").alias("m"), F.avg(F.col("positive").cast("double")).alias("r"))
    return edges.join(F.broadcast(per), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), round_to(F.coalesce("m", (F.col("lo") + F.col("hi")) / 2)).alias("mean_p"), round_to(F.coalesce("r", F.lit(0.0))).alias("rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece): the weighted distance of rate and mean over the bins."""
    return bins.agg(round_to(_ratio(F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))), F.sum("n"))).alias("ece"))


def summary(scored: DataFrame, threshold: float) -> tuple[float, float]:
    """(F1, calibration error) of scores against labels: two numbers, whatever the size; (0, 0) without rows."""
    return scored.agg(*confusion(F.lit(threshold))).first()["f1"], calibration_error(reliability(scored)).first()["ece"]


def adopted(old: tuple[float, float], new: tuple[float, float]) -> bool:
    """Whether the new (F1, calibration error) is to be adopted: F1 not lower and the error strictly lower."""
    return new[0] + 1e-9 >= old[0] and new[1] < old[1]


def threshold_grid(scored: DataFrame, low: int = 50, high: int = 95, step: int = 5) -> DataFrame:
    """(threshold, confusion..): every threshold of the grid over all rows.

    Scores are counted once by the highest threshold they reach, so the rows don't multiply by the grid's size.
    """
    grid = [t / 100 for t in range(low, high + 1, step)]
    reached = sum((F.when(F.col("p_eff") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    counts = scored.groupBy(reached.alias("k")).agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    thresholds = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(x).alias("threshold")) for i, x in enumerate(grid)))
    both = counts.select("pos", "neg", "k", F.explode(thresholds).alias("t")).select("pos", "neg", "k", "t.*")
    at = F.col("k") >= F.col("i")
    s = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    tp, fp, fn, tn = s("pos", at), s("neg", at), s("pos", ~at), s("neg", ~at)
    return both.groupBy("threshold").agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        round_to(_ratio(tp, tp + fp)).alias("precision"), round_to(_ratio(tp, tp + fn)).alias("recall"), round_to(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def proposals(grid: DataFrame) -> DataFrame:
    """(profile, threshold): the balanced, chill and assertive choice from a threshold grid."""
    balanced = F.max_by("threshold", F.struct("f1", "precision", "threshold"))
    chill = F.max_by("threshold", F.when(F.col("precision") >= 0.9, F.struct("precision", "recall", "threshold")))
    assertive = F.max_by("threshold", F.when(F.col("precision") >= 0.5, F.struct("recall", "f1", -F.col("threshold"))))
    row = grid.agg(balanced.alias("b"), chill.alias("c"), assertive.alias("a"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("profile"), F.coalesce(c, F.col("b")).alias("threshold")) for n, c in (("balanced", F.col("b")), ("chill", F.col("c")), ("assertive", F.col("a")))))).alias("x")).select("x.*")


def logistic_fit(rows: DataFrame, main: str, guard: str, label: str, steps: int = 25, ridge: float = 1e-4) -> tuple[float, float, float]:
    """(bias, main, guard) by Newton's method: each step is one aggregate of nine sums; only sums reach the driver."""
    w = (0.0, 1.0, -1.0)
    x = (F.lit(1.0), F.col(main), F.col(guard))
    for _ in range(steps):
        p = sigmoid(F.lit(w[0]) + F.lit(w[1]) * x[1] + F.lit(w[2]) * x[2])
        weight = F.greatest(p * (1 - p), F.lit(1e-4))
        miss = F.col(label).cast("double") - p
        s = rows.agg(*(F.sum(miss * x[i]).alias(f"g{i}") for i in range(3)), *(F.sum(weight * x[i] * x[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3))).first()
        if s["g0"] is None:
            return w
        h = [[s[f"h{min(i, j)}{max(i, j)}"] + (ridge if i == j else 0) for j in range(3)] for i in range(3)]
        w = tuple(a + d for a, d in zip(w, _solve(h, [s[f"g{i}"] for i in range(3)])))
    return w


def _solve(h: list[list[float]], g: list[float]) -> list[float]:
    import numpy as np

    return np.linalg.solve(np.array(h), np.array(g)).tolist()
