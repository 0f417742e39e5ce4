"""Evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion(pred: DataFrame, truth: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Tp, fp and fn of two sets of ``keys`` (by group if ``by``)."""
    p, t = pred.select(*keys).distinct().withColumn("p", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = p.join(t, keys, "full")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    aggs = [count(F.col("p").isNotNull() & F.col("t").isNotNull(), "tp"), count(F.col("t").isNull(), "fp"), count(F.col("p").isNull(), "fn")]
    return both.groupBy(*by).agg(*aggs) if by else both.agg(*aggs)


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of tp, fp, fn, with 0 for empty denominators."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def sweep(scores: DataFrame, truth: DataFrame, alphas: list[float], ks: list[int], task: str = "task", item: str = "item") -> DataFrame:
    """Micro-averaged metrics of every (alpha, k): items above alpha among a task's k best, in one query."""
    from pyspark.sql import Window as W

    spark = scores.sparkSession
    grid = spark.createDataFrame([(i, a, k) for i, (a, k) in enumerate((a, k) for a in alphas for k in ks)], "g long, alpha double, k long")
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy(task).orderBy(F.desc("score"), item))).where(F.col("rank") <= max(ks))
    chosen = ranked.join(F.broadcast(grid), (F.col("rank") <= F.col("k")) & (F.col("score") > F.col("alpha")))
    real = truth.select(task, item).distinct()
    hit = chosen.join(real.withColumn("t", F.lit(1)), [task, item], "left")
    per = hit.groupBy("g").agg(F.count("t").alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"))
    total = real.agg(F.count("*").alias("all"))
    out = grid.join(per, "g", "left").join(F.broadcast(total), F.lit(True)).fillna(0, ["tp", "fp"])
    return prf(out.withColumn("fn", F.col("all") - F.col("tp"))).select("g", "alpha", "k", "tp", "fp", "fn", "precision", "recall", "f1")


def best_setting(swept: DataFrame) -> DataFrame:
    """The setting of the largest F1 above 0, the first in grid order."""
    return swept.where("f1 > 0").orderBy(F.desc("f1"), "g").limit(1)


def box_scores(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """E5: relaxed and strict accuracy over all ground truth, and the mean overlap of the pairs."""
    total = truth.agg(F.count("*").alias("n"))
    sums = matches.agg(F.count(F.when(F.col("gt_in_pred"), 1)).alias("relaxed"), F.count(F.when(F.col("gt_in_pred") & F.col("pred_in_gt"), 1)).alias("strict"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))
    return sums.join(total, F.lit(True)).select(ratio(F.col("relaxed"), F.col("n")).alias("relaxed"), ratio(F.col("strict"), F.col("n")).alias("strict"), "mean_iou")


def consistency(children1: DataFrame, children2: DataFrame, regions: DataFrame, places: DataFrame) -> DataFrame:
    """The mean, over associated regions, of the share of child places whose associate lies in the associated region.

    ``children`` are (region, place), ``regions`` and ``places`` (id1, id2).
    """
    c1 = children1.join(regions, F.col("region") == F.col("id1")).select("region", "place", F.col("id2").alias("region2"))
    c1 = c1.join(places.select(F.col("id1").alias("place"), F.col("id2").alias("place2")), "place", "left")
    hit = c1.join(children2.select(F.col("region").alias("region2"), F.col("place").alias("place2"), F.lit(1).alias("in")), ["region2", "place2"], "left")
    return hit.groupBy("region").agg(ratio(F.count("in"), F.count("*")).alias("share")).agg(F.avg("share").alias("consistency"))


def node_ratio(counts: DataFrame) -> DataFrame:
    """(a, b, ratio) of the node counts of every two scenes."""
    a, b = counts.toDF("a", "na"), counts.toDF("b", "nb")
    return a.join(F.broadcast(b), F.lit(True)).select("a", "b", (F.col("na") / F.col("nb")).alias("ratio"))


def top_share(scores: DataFrame, task: str, share: float = 0.9) -> DataFrame:
    """Rows whose score exceeds ``share`` of their task's largest."""
    from pyspark.sql import Window as W

    return scores.withColumn("_max", F.max("score").over(W.partitionBy(task))).where(F.col("score") > share * F.col("_max")).drop("_max")


def box_precision(matches: DataFrame, found: DataFrame) -> DataFrame:
    """Relaxed and strict share of found boxes that match; 0 where nothing was found."""
    total = found.agg(F.count("*").alias("n"))
    sums = matches.agg(F.count(F.when(F.col("gt_in_pred"), 1)).alias("r"), F.count(F.when(F.col("gt_in_pred") & F.col("pred_in_gt"), 1)).alias("s"))
    return sums.join(total, F.lit(True)).select(ratio(F.col("r"), F.col("n")).alias("relaxed"), ratio(F.col("s"), F.col("n")).alias("strict"))


def field_totals(judged: DataFrame, truth: DataFrame, share: float = 0.9) -> DataFrame:
    """Accuracy over each task's first N (its ground truth) objects, precision over its top share, and F1.

    ``judged`` is (task, object, score, correct), ``truth`` (task, n).
    """
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("task").orderBy(F.desc("score"), "object"))
    first = judged.withColumn("_r", rank).join(truth, "task").where(F.col("_r") <= F.col("n"))
    hits = first.agg(F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("hits"))
    wanted = truth.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wanted"))
    top = top_share(judged, "task", share).agg(F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("good"), F.count("*").alias("taken"))
    out = hits.join(wanted, F.lit(True)).join(top, F.lit(True)).select(ratio(F.col("hits"), F.col("wanted")).alias("accuracy"), ratio(F.col("good"), F.col("taken")).alias("precision"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("accuracy")))


def growth(runs: DataFrame, area: Column) -> DataFrame:
    """Size and node count of each run against its length and area."""
    return runs.select("dataset", "cameras", "length", area.alias("area"), "size_mb", "n_nodes", ratio(F.col("size_mb"), F.col("length")).alias("mb_per_length"), ratio(F.col("n_nodes"), area).alias("nodes_per_area"))
