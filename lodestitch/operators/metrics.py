"""Scores of predictions by S1 entity, sweeps, recall of candidates, and statistics of score and feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sweep's thresholds.
THRESHOLDS = [
    0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.96, 0.97, 0.98, 0.99,
    0.991, 0.992, 0.993, 0.994, 0.995, 0.996, 0.997, 0.998, 0.999, 0.9995, 0.9999, 0.99991, 0.99993, 0.99995, 0.99997, 0.99999,
]
BETA = 0.5
#: Ranges of the scores that `rank_auc` counts by first.
AUC_SLOTS = 4096


def f_beta(n_pred: Column | str, n_true: Column | str, n_hit: Column | str, beta: float = BETA) -> Column:
    """1 where nothing is predicted and nothing true; 0 without a hit; else the F-measure of precision and recall."""
    p, t, h = (F.col(x) if isinstance(x, str) else x for x in (n_pred, n_true, n_hit))
    b = beta * beta
    precision, recall = h / F.nullif(p, F.lit(0)), h / F.nullif(t, F.lit(0))
    return F.when((p == 0) & (t == 0), 1.0).when(h == 0, 0.0).otherwise((1 + b) * precision * recall / (b * precision + recall))


def by_s1(s1: DataFrame, predicted: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("target_source", "target_id")) -> DataFrame:
    """(s1_id, n_pred, n_true, n_hit) for every row of `s1`; both sides are sets of (s1_id, *keys)."""
    on = ["s1_id", *keys]
    p, t = predicted.select(*on).distinct().withColumn("p", F.lit(1)), truth.select(*on).distinct().withColumn("t", F.lit(1))
    both = p.join(t, on, "full").groupBy("s1_id").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("n_hit"))
    return s1.select("s1_id").distinct().join(both, "s1_id", "left").fillna(0, ["n_pred", "n_true", "n_hit"])


def macro_f05(counts: DataFrame) -> DataFrame:
    return counts.agg(F.avg(f_beta("n_pred", "n_true", "n_hit")).alias("macro_f05"))


METRICS = {
    "macro_f05": lambda: F.avg("f05"),
    "macro_precision": lambda: F.avg(F.when(F.col("n_pred") > 0, F.col("n_hit") / F.nullif("n_pred", F.lit(0)))),
    "macro_recall": lambda: F.avg(F.when(F.col("n_true") > 0, F.col("n_hit") / F.nullif("n_true", F.lit(0)))),
    "micro_precision": lambda: F.try_divide(F.sum("n_hit"), F.sum("n_pred")),
    "micro_recall": lambda: F.try_divide(F.sum("n_hit"), F.sum("n_true")),
    "s1_with_prediction": lambda: F.count_if(F.col("n_pred") > 0),
    "no_match_s1_predicted": lambda: F.count_if((F.col("n_true") == 0) & (F.col("n_pred") > 0)),
    "avg_predicted": lambda: F.avg("n_pred"),
    "f05_singletons": lambda: F.avg(F.when(F.col("n_true") == 0, F.col("f05"))),
    "f05_matched": lambda: F.avg(F.when(F.col("n_true") > 0, F.col("f05"))),
    "fp": lambda: F.sum(F.col("n_pred") - F.col("n_hit")),
    "fn": lambda: F.sum(F.col("n_true") - F.col("n_hit")),
}


def s1_metrics(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return counts.withColumn("f05", f_beta("n_pred", "n_true", "n_hit")).groupBy(*by).agg(*(make().alias(name) for name, make in METRICS.items()))


def threshold_sweep(scored: DataFrame, n_true: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Metrics by threshold; `scored` has s1_id, score and label, `n_true` (s1_id, n_true) every S1.

    A row reaches a prefix of the ascending thresholds, so it is expanded to those alone, and S1s without any row at a
    threshold come back by a join with the small table of thresholds.
    """
    grid = F.array(*(F.lit(t) for t in sorted(thresholds or THRESHOLDS)))
    rows = scored.select("s1_id", "label", F.explode(F.filter(grid, lambda t: t <= F.col("score"))).alias("threshold"))
    hits = rows.groupBy("s1_id", "threshold").agg(F.count("*").alias("n_pred"), F.sum("label").alias("n_hit"))
    every = n_true.withColumn("threshold", F.explode(grid))
    counts = every.join(hits, ["s1_id", "threshold"], "left").fillna(0, ["n_pred", "n_hit"])
    return s1_metrics(counts, ("threshold",))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the largest macro F0.5, the smallest of several."""
    return sweep.orderBy(F.desc("macro_f05"), "threshold").limit(1).select("threshold", "macro_f05")


def oracle_gain(rows: DataFrame, n_true: DataFrame, which: Column) -> DataFrame:
    """How much macro F0.5 would gain if the rows of `which` were decided as labelled; rows have s1_id, label, predicted."""
    right = F.when(which, F.col("label")).otherwise(F.col("predicted"))
    agg = rows.groupBy("s1_id").agg(
        F.sum("predicted").alias("p0"), F.sum(F.col("predicted") * F.col("label")).alias("h0"), F.sum(right).alias("p1"), F.sum(right * F.col("label")).alias("h1")
    )
    both = n_true.join(agg, "s1_id", "left").fillna(0, ["p0", "h0", "p1", "h1"])
    return both.agg((F.avg(f_beta("p1", "n_true", "h1")) - F.avg(f_beta("p0", "n_true", "h0"))).alias("gain"))


def channel_recall(truth: DataFrame, merged: DataFrame, bits: dict[str, int]) -> DataFrame:
    """(channel, true_pairs, found, recall) for each channel and their union."""
    keys = ["s1_id", "target_source", "target_id"]
    hit = truth.select(*keys).join(merged.select(*keys, "mask"), keys, "left")
    names = F.array(*(F.struct(F.lit(n).alias("channel"), F.lit(b).alias("bit")) for n, b in {**bits, "union": sum(bits.values())}.items()))
    rows = hit.select(F.coalesce("mask", F.lit(0)).alias("mask"), F.explode(names).alias("c"))
    found = F.count_if(F.col("mask").bitwiseAND(F.col("c.bit")) != 0)
    return rows.groupBy(F.col("c.channel").alias("channel")).agg(F.count("*").alias("true_pairs"), found.alias("found"), (found / F.count("*")).alias("recall"))


def candidate_counts(s1: DataFrame, merged: DataFrame) -> DataFrame:
    """Pairs, and their mean, median and largest number by S1, those without any included; and the share of S1s with some."""
    n = s1.select("s1_id").distinct().join(merged.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").fillna(0, ["n"])
    return n.agg(F.sum("n").alias("pairs"), F.avg("n").alias("avg_pairs"), F.percentile("n", F.lit(0.5)).alias("median_pairs"), F.max("n").alias("max_pairs"), F.avg((F.col("n") > 0).cast("int")).alias("coverage"))


def quantiles(rows: DataFrame, column: str, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.percentile(column, F.lit(q)).alias(f"q{round(100 * q)}") for q in at))


def rank_auc(rows: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """The probability that a positive row scores above a negative one, ties as half; NULL if either class is empty.

    Counts by distinct score are summed from below, by ranges first, so no task needs all distinct scores.
    """
    n = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    # sums from below in two steps: over AUC_SLOTS ranges of the scores, then inside each range
    span = n.groupBy(*by).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    joined = n.join(F.broadcast(span), list(by)) if by else n.crossJoin(F.broadcast(span))  # one row a group
    place = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * AUC_SLOTS)).otherwise(0)
    n = joined.withColumn("__slot", F.least(place, F.lit(AUC_SLOTS - 1))).drop("__lo", "__hi")
    slots = n.groupBy(*by, "__slot").agg(F.sum("n").alias("__n"))
    ahead = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*by, "__slot").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    n = n.join(slots, [*by, "__slot"]).withColumn("below", F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    pairs = F.sum("p") * F.sum("n")
    return n.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), pairs).alias("auc"))


def score_summary(rows: DataFrame) -> DataFrame:
    """By S1: candidates, best and second score (0 for a single one), margin, predictions."""
    by = Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_source", "target_id")
    r = rows.withColumn("r", F.row_number().over(by))
    second = F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0))
    return r.groupBy("s1_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), second.alias("second"), (F.max("score") - second).alias("margin"), F.sum("predicted").alias("n_predicted"))


def class_means(rows: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """(feature, label, mean, missing_rate), one pass over the columns."""
    long = rows.select(label, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([label], columns, "feature", "value")
    return long.groupBy("feature", label).agg(F.avg("value").alias("mean"), F.avg(F.isnull("value").cast("int")).alias("missing_rate"))


def correlations(rows: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(a, b, r): Pearson correlations of pairs of columns over the rows where both are known, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = rows.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))
    return got.select(F.explode(cells).alias("x")).select("x.*").where(F.abs("r") >= least)


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    got = rows.agg(*(F.count_distinct(c).alias(c) for c in columns))
    return got.unpivot([], columns, "feature", "n_values").where("n_values <= 1")


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two columns with margins, which have NULL for the column summed over."""
    return rows.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def value_share(rows: DataFrame, column: str) -> DataFrame:
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def bucket(column: str, edges: list[float], right_closed: bool = False) -> Column:
    """Label of the bucket [lo, hi) (or (lo, hi]) that holds the value; 'missing' for NULL, 'outside' beyond the edges."""
    c, out = F.col(column), F.when(F.col(column).isNull(), "missing")
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = (c > lo) & (c <= hi) if right_closed else (c >= lo) & (c < hi)
        out = out.when(inside, f"{lo:g}-{hi:g}")
    return out.otherwise("outside")


def ladder(rules: list[tuple[str, Column]], other: str = "other") -> Column:
    """The name of the first rule that holds; unknown counts as no."""
    out = None
    for name, rule in rules:
        rule = F.coalesce(rule, F.lit(False))
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise(other) if out is not None else F.lit(other)
