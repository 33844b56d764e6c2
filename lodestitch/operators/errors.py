"""Error analysis: flags and ladders of false positives, buckets of false negatives, relations of scripts, reasons of misses.

Rows have label, predicted and the pair features; a condition on an unknown value doesn't hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics

c = F.col


def best_name() -> Column:
    """The better of the names' ratios as they are and transliterated; one that is unknown doesn't count."""
    return F.greatest("name_ratio", "translit_name_ratio")


def holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


# Labels, limits and order of the rules below.


def false_positive_rules() -> list[tuple[str, Column]]:
    """Categories of false positives by what the pair has in common, first one that holds; rows have cross_script too."""
    near, conflict = c("address_token_set_ratio") >= 0.9, c("address_number_set_jaccard") < 1
    weak = ~holds(c("address_token_set_ratio") >= 0.75)
    return [
        ("transliteration collision (cross-script)", c("cross_script") & (c("translit_skeleton_ratio") >= 0.7) & (c("name_ratio") < 0.5)),
        ("skeleton collision (Latin, spelling differs)", ~c("cross_script") & (c("translit_skeleton_ratio") >= 0.8) & (best_name() < 0.7)),
        ("near-duplicate record: name & address ≥0.9, numbers agree", (best_name() >= 0.9) & near & ~holds(conflict)),
        ("address near-duplicate, numbers conflict", near & conflict),
        ("same/near name, weak or missing address — common name (freq > 5)", (best_name() >= 0.9) & weak & (c("target_name_frequency") > 5)),
        ("same/near name, weak or missing address — rare name (freq ≤ 5)", (best_name() >= 0.9) & weak),
        ("same/near address, different name", near & (best_name() < 0.9)),
        ("house+city collision, weak name & address", (c("house_city_match") == 1) & (best_name() < 0.9) & (c("address_token_set_ratio") < 0.9)),
        ("partial evidence on both name and address", (best_name() >= 0.7) & (c("address_token_set_ratio") >= 0.75)),
    ]


def primary_rules() -> list[tuple[str, Column]]:
    """The main category of a false positive, first one that holds."""
    conflict = c("address_number_set_jaccard") < 1
    return [
        ("identical name + identical address", (c("name_exact") == 1) & (c("address_ratio") == 1)),
        ("identical name + numeric mismatch", (c("name_exact") == 1) & conflict),
        ("near-identical name + numeric mismatch", (best_name() >= 0.9) & conflict),
        ("identical/near name, numbers agree", best_name() >= 0.9),
        ("different city", c("city_match") == 0),
        ("house_city-only", (c("house_city_hit") == 1) & (c("n_channels") == 1)),
    ]


def flags() -> list[tuple[str, Column]]:
    """Ten properties of a false positive, any number of which may hold."""
    same, same_address, conflict = holds(c("name_exact") == 1), holds(c("address_ratio") == 1), holds(c("address_number_set_jaccard") < 1)
    return [
        ("identical name", same),
        ("near-identical name (≥0.90, not identical)", ~same & holds(best_name() >= 0.9)),
        ("identical address", same_address),
        ("near-identical address (≥0.90, not identical)", ~same_address & holds(c("address_ratio") >= 0.9)),
        ("house+city agree", holds(c("house_city_match") == 1)),
        ("address numeric mismatch (number-set Jaccard < 1)", conflict),
        ("identical name + numeric mismatch", same & conflict),
        ("identical name AND identical address", same & same_address),
        ("different city (city_match = 0)", holds(c("city_match") == 0)),
        ("house_city-only candidate", holds((c("house_city_hit") == 1) & (c("n_channels") == 1))),
    ]


_SIMILAR = [0, 0.5, 0.75, 0.9, 1.0, 1.01], ["<0.50", "0.50-0.75", "0.75-0.90", "0.90-<1", "1.0"]
CHANNEL_SHORT = {"exact_name_hit": "exact", "name_char_hit": "name", "address_char_hit": "address", "house_city_hit": "house_city"}


def labelled(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the range [edge, next edge) that holds the value; 'missing' without a value."""
    out = F.when(value.isNull(), "missing")
    for lo, hi, name in zip(edges, edges[1:], labels, strict=False):
        out = out.when((value >= lo) & (value < hi), name)
    return out


def miss_breakdowns() -> dict[str, Column]:
    """How false negatives are dealt in buckets: name of the breakdown and the bucket."""
    flag = lambda x: F.when(c(x) == 1, "1").when(c(x) == 0, "0").otherwise("missing")
    return {
        "score": labelled(c("score"), [0, 0.1, 0.5, 0.9, 0.99, 1.01], ["<0.10", "0.10-0.50", "0.50-0.90", "0.90-0.99", "0.99-<thr"]),
        "best name ratio (orig/translit)": labelled(best_name(), *_SIMILAR),
        "address ratio": labelled(c("address_ratio"), *_SIMILAR),
        "address number-set Jaccard": labelled(c("address_number_set_jaccard"), *_SIMILAR),
        "name_char_rank": labelled(c("name_char_rank"), [0, 1, 5, 20, 50, 100], ["0", "1-4", "5-19", "20-49", "50-99"]),
        "address_char_rank": labelled(c("address_char_rank"), [0, 1, 5, 10, 25], ["0", "1-4", "5-9", "10-24"]),
        "n_channels": c("n_channels").cast("int").cast("string"),
        "missing name/address": F.when(c("target_address_missing") == 1, "target address missing").when(c("target_name_missing") == 1, "target name missing").when(c("s1_address_missing") == 1, "S1 address missing").otherwise("none missing"),
        "house_number_match": flag("house_number_match"), "city_match": flag("city_match"), "house_city_match": flag("house_city_match"),
    }


def channel_label(columns: dict[str, str] = CHANNEL_SHORT) -> Column:
    """The short names of the channels that found a pair, joined by +; 'none' without any."""
    joined = F.concat_ws("+", *(F.when(c(x) == 1, short) for x, short in columns.items()))
    return F.when(joined == "", "none").otherwise(joined)


def _gains(rows: DataFrame, n_true: DataFrame, parts: Column) -> DataFrame:
    """(part, n, oracle_gain): the rows of each part of `parts` (an array of names), and how much macro F0.5 gains if they are
    decided as labelled. Only S1s with such a row change, so all parts are worked out in one pass over theirs."""
    own = rows.groupBy("s1_id").agg(F.sum("predicted").alias("n_pred"), F.sum(c("predicted") * c("label")).alias("n_hit"))
    base = n_true.join(own, "s1_id", "left").fillna(0, ["n_pred", "n_hit"])
    total = n_true.agg(F.count("*").alias("s1s"))
    hit = rows.select("s1_id", "label", "predicted", F.explode(parts).alias("part"))
    # deciding a row as labelled changes the S1's predictions and hits by this
    change = hit.groupBy("part", "s1_id").agg(F.count("*").alias("rows"), F.sum(c("label") - c("predicted")).alias("dp"), F.sum(c("label") - c("label") * c("predicted")).alias("dh"))
    both = change.join(base, "s1_id")
    gain = metrics.f_beta(c("n_pred") + c("dp"), c("n_true"), c("n_hit") + c("dh")) - metrics.f_beta("n_pred", "n_true", "n_hit")
    return both.groupBy("part").agg(F.sum("rows").alias("n"), F.sum(gain).alias("gained")).crossJoin(F.broadcast(total)).select("part", "n", (c("gained") / c("s1s")).alias("oracle_gain"))


def _share(parts: DataFrame, of: DataFrame) -> DataFrame:
    return parts.crossJoin(F.broadcast(of.agg(F.count("*").alias("total")))).select("part", "n", (c("n") / c("total")).alias("pct"), "oracle_gain")


def false_positive_report(rows: DataFrame, n_true: DataFrame) -> DataFrame:
    """(kind, part, n, pct, oracle_gain) of false positives by flag, main category and the S1's context."""
    wrong = (c("predicted") == 1) & (c("label") == 0)
    own = Window.partitionBy("s1_id")
    rows = rows.join(n_true.select("s1_id", c("n_true").alias("__t")), "s1_id", "left").withColumn("__h", F.max(c("predicted") * c("label")).over(own))
    where = F.when(F.coalesce("__t", F.lit(0)) == 0, "S1 has no true match (singleton)").when(c("__h") == 1, "extra prediction next to a correct one").otherwise("S1 has matches, none predicted correctly")
    named = lambda kind, x: F.concat(F.lit(f"{kind}|"), x)
    parts = [F.when(x, F.lit(f"flag|{n}")) for n, x in flags()] + [named("category", metrics.ladder(primary_rules())), named("context", where)]
    parts = F.filter(F.array(*parts), lambda x: x.isNotNull())
    got = _gains(rows, n_true, F.when(wrong, parts).otherwise(F.array().cast("array<string>")))
    split = F.split_part("part", F.lit("|"), F.lit(1)).alias("kind")
    return _share(got, rows.where(wrong)).select(split, F.expr("substring(part, instr(part, '|') + 1)").alias("part"), "n", "pct", "oracle_gain")


def false_negative_report(rows: DataFrame, n_true: DataFrame) -> DataFrame:
    """(kind, part, n, pct, oracle_gain) of false negatives among the candidates by bucket, context and rank in their S1."""
    lost = (c("predicted") == 0) & (c("label") == 1)
    own = Window.partitionBy("s1_id")
    rank = F.row_number().over(own.orderBy(F.desc("score"), "target_source", "target_id"))
    rows = rows.withColumn("__p", F.max("predicted").over(own)).withColumn("__r", rank)
    where = F.when(c("__p") == 1, "S1 has other predictions").otherwise("S1 has no predictions")
    ranks = labelled(c("__r"), [1, 2, 4, 11, 1e9], ["1 (top of S1)", "2-3", "4-10", ">10"])
    parts = F.array(*(F.concat(F.lit(f"{k}|"), x) for k, x in {**miss_breakdowns(), "context": where, "rank in S1": ranks}.items()))
    parts = F.filter(parts, lambda x: x.isNotNull())
    got = _gains(rows, n_true, F.when(lost, parts).otherwise(F.array().cast("array<string>")))
    split = F.split_part("part", F.lit("|"), F.lit(1)).alias("kind")
    return _share(got, rows.where(lost)).select(split, F.expr("substring(part, instr(part, '|') + 1)").alias("part"), "n", "pct", "oracle_gain")


def script_relation(a_kind: Column, b_kind: Column, different: Column) -> Column:
    """How two names' scripts relate, of the kinds that `functions.text.script_profile` gives."""
    return (
        F.when((a_kind == "latin") & (b_kind == "latin"), "both Latin")
        .when((a_kind == "non-latin") & (b_kind == "non-latin") & ~different, "same non-Latin script")
        .when((a_kind == "latin") & (b_kind == "non-latin"), "Latin S1 -> non-Latin target")
        .when((a_kind == "non-latin") & (b_kind == "latin"), "non-Latin S1 -> Latin target")
        .when((a_kind == "mixed") | (b_kind == "mixed"), "mixed-script name")
        .otherwise("other (different non-Latin / no letters)")
    )


def translit_effect() -> Column:
    delta = c("translit_name_ratio") - c("name_ratio")
    return F.when(delta > 0.05, "helps").when(delta < -0.05, "worse").otherwise("no change")


def name_miss_report(rows: DataFrame, by: str = "script_relation") -> DataFrame:
    """Missed true pairs (label 1, not predicted) whose names are unlike (ratio under 0.5), by the relation of their scripts."""
    low = rows.where((c("label") == 1) & (c("predicted") == 0) & (c("name_ratio") < 0.5)).withColumn("__e", translit_effect())
    share = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    got = low.groupBy(by).agg(
        F.count("*").alias("count"), F.count_if(best_name() < 0.5).alias("best_below_0_5"), F.avg("name_ratio").alias("mean_name_ratio"), F.avg("translit_name_ratio").alias("mean_translit_ratio"),
        share(c("__e") == "helps").alias("translit_helps"), share(c("__e") == "worse").alias("translit_worse"), F.avg("address_token_set_ratio").alias("mean_address_token_set"),
        F.avg("target_address_missing").alias("target_address_missing"),
    )
    return got.crossJoin(F.broadcast(low.agg(F.count("*").alias("__n")))).withColumn("pct", c("count") / c("__n")).drop("__n")


#: A name ratio from which a missed name counts as similar, and under which as dissimilar.
SIMILAR_RATIO, DISSIMILAR_RATIO = 0.75, 0.50


def miss_reason(true_score: str = "true_score", full_cosine: str = "full_cosine", name_ratio: str = "name_ratio") -> Column:
    """Why a true pair is not among the most similar ones of its query."""
    pruned = (c(full_cosine) >= 0.5) & (c(true_score) < 0.5 * c(full_cosine))
    return (
        F.when(c(true_score) <= 0, "not reachable (no shared indexed n-gram)")
        .when(pruned, "index pruning (full cosine high, indexed score low)")
        .when(c(name_ratio) >= SIMILAR_RATIO, "crowded out (name ratio ≥ 0.75)")
        .when(c(name_ratio) < DISSIMILAR_RATIO, "dissimilar name (name ratio < 0.50)")
        .otherwise("partly similar (0.50 ≤ ratio < 0.75)")
    )


def unlike_category(a_raw: str, a_norm: str, a_latin: str, a_script: str, b_raw: str, b_norm: str, b_latin: str, b_script: str) -> Column:
    """Why the names of a true pair have nothing in common; scripts are the dominant ones of the normalised names."""
    return (
        F.when(c(b_raw).isNull(), "unjoined_target")
        .when((F.coalesce(a_norm, F.lit("")) == "") | (F.coalesce(b_norm, F.lit("")) == ""), "missing_name")
        .when(T.is_noisy(a_raw, a_norm) | T.is_noisy(b_raw, b_norm), "noisy_corrupted")
        .when(c(a_script) != c(b_script), "different_script")
        .when(T.is_abbreviation(a_latin, b_latin) | T.is_abbreviation(b_latin, a_latin), "abbreviation")
        .when((F.length(a_latin) <= 3) | (F.length(b_latin) <= 3), "other")
        .otherwise("translation_or_different")
    )


def decision_segments() -> list[tuple[str, Column]]:
    """Nine segments of decided rows; rows have target_script (a kind), n_true, and n_base (their S1's base predictions)."""
    return [
        ("Latin -> Latin", c("target_script") == "latin"),
        ("Latin -> Indian-script", c("target_script") == "non-latin"),
        ("cross-script & address token-set >= 0.75", (c("target_script") != "latin") & (c("address_token_set_ratio") >= 0.75)),
        ("rare target name (frequency 1)", c("target_name_frequency") == 1),
        ("target address missing", c("target_address_missing") == 1),
        ("conflicting address numbers", c("address_number_set_jaccard") < 1),
        ("single-prediction S1 (base)", c("n_base") == 1),
        ("multi-prediction S1 (base)", c("n_base") >= 2),
        ("S1 with no true match", c("n_true") == 0),
    ]


def examples(rows: DataFrame, threshold: float, n: int = 10, low: float = 0.10) -> DataFrame:
    """(kind, s1_id, target_source, target_id, score): the lowest scored true pairs under `low`, the highest scored false ones
    from `threshold` on."""
    keys = ("s1_id", "target_source", "target_id", "score")
    true = rows.where((c("label") == 1) & (c("score") < low)).orderBy("score", *keys[:3]).limit(n)
    false = rows.where((c("label") == 0) & (c("score") >= threshold)).orderBy(F.desc("score"), *keys[:3]).limit(n)
    parts = [x.select(F.lit(kind).alias("kind"), *keys) for kind, x in (("true, low score", true), ("false, high score", false))]
    return reduce(DataFrame.unionByName, parts)


def aligned(scores: DataFrame, features: DataFrame, keys: tuple[str, ...] = ("s1_id", "target_source", "target_id")) -> DataFrame:
    """Score rows with the features of the same keys; a key on one side only, or twice on one, is an error."""
    one = lambda rows, name: rows.withColumn(name, F.lit(1))
    both = one(scores, "__a").join(one(features, "__b"), list(keys), "full")
    n = F.count("*").over(Window.partitionBy(*keys))
    ok = F.when(c("__a").isNull() | c("__b").isNull(), F.raise_error(F.lit("score and feature rows are not aligned")).cast("boolean"))
    return both.withColumn("__n", n).where(ok.when(c("__n") > 1, F.raise_error(F.lit("rows are not one to one")).cast("boolean")).otherwise(True)).drop("__a", "__b", "__n")


def separability(rows: DataFrame, cross: str = "cross_script") -> DataFrame:
    """Candidates with unlike names (ratio under 0.5) that agree transliterated (0.5 or more), by script and transliterated ratio."""
    low = rows.where((c("name_ratio") < 0.5) & (c("translit_name_ratio") >= 0.5))
    scripts = F.when(c(cross), "cross-script").otherwise("same script").alias("scripts")
    level = labelled(c("translit_name_ratio"), [0.5, 0.6, 0.7, 0.8, 1.01], ["0.5-0.6", "0.6-0.7", "0.7-0.8", ">=0.8"]).alias("translit_bucket")
    got = low.groupBy(scripts, level).agg(
        F.count("*").alias("candidates"), F.sum("label").alias("positives"), F.sum("predicted").alias("currently_predicted"),
        F.count_if((c("label") == 1) & (c("predicted") == 0)).alias("missed_positives"), F.count_if((c("label") == 0) & (c("predicted") == 1)).alias("false_positives"),
    )
    return got.withColumn("positive_rate", c("positives") / c("candidates"))

