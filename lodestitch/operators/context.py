"""Context of a pair among its S1's candidates, decision rules, and the second stage's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score levels, the level called high, and the evidence compared with the top candidate's.
LEVELS = (0.9, 0.95, 0.98, 0.99, 0.991)
HIGH = 0.99
EVIDENCE = ("address_token_set_ratio", "name_ratio", "address_number_set_jaccard", "translit_skeleton_ratio", "target_name_frequency")
SECOND_STAGE_FLOOR, SECOND_STAGE_THRESHOLD = 0.5, 0.65


def context_features(rows: DataFrame, evidence: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """`rows` (s1_id, target_source, target_id, score and evidence) with 24 columns about the S1's other candidates."""
    own = Window.partitionBy("s1_id")
    order = own.orderBy(F.desc("score"), "target_source", "target_id")
    count = lambda c: F.sum(c.cast("int")).over(own)
    rank = F.col("candidate_score_rank")
    first = lambda c: F.max(F.when(rank == 1, c)).over(own)
    high = F.col("score") >= HIGH
    rows = rows.withColumn("candidate_score_rank", F.row_number().over(order)).withColumn("s1_candidate_count", F.count("*").over(own))
    new = {f"s1_count_ge_{level:g}": count(F.col("score") >= level) for level in LEVELS}
    new |= {
        "candidate_score_percentile": 1 - (rank - 1) / F.col("s1_candidate_count"),
        "is_top": (rank == 1).cast("int"),
        "s1_top_score": first(F.col("score")),
        "s1_second_score": F.coalesce(F.max(F.when(rank == 2, F.col("score"))).over(own), F.lit(0.0)),
        "s1_high_s2_count": count(high & (F.col("target_source") == 2)),
        "s1_high_s3_count": count(high & (F.col("target_source") == 3)),
        "top_is_s3": (first(F.col("target_source")) == 3).cast("int"),
    }
    for c in evidence:
        seen = F.log1p(c) if c == "target_name_frequency" else F.col(c)
        new[f"diff_top_{c}"] = seen - first(seen)
    rows = rows.withColumns(new)
    return rows.withColumns({
        "s1_score_margin": F.col("s1_top_score") - F.col("s1_second_score"),
        "candidate_score_minus_top": F.col("score") - F.col("s1_top_score"),
        "candidate_score_minus_second": F.col("score") - F.col("s1_second_score"),
        "other_source_high_count": F.when(F.col("target_source") == 2, F.col("s1_high_s3_count")).otherwise(F.col("s1_high_s2_count")),
        "other_candidates_high_count": F.col(f"`s1_count_ge_{HIGH:g}`") - high.cast("int"),
    })


def contradiction() -> Column:
    """An address that speaks against the pair: another house number, numbers that differ, or no address; unknown is no."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return no(F.col("house_number_match") == 0) | no(F.col("address_number_set_jaccard") < 1) | no(F.col("target_address_missing") == 1)


def decide_threshold(t: float) -> Column:
    return F.col("score") >= t


def decide_single_stricter(t: float, t_single: float, contradiction_only: bool = False) -> Column:
    """`t` for all; an S1's only candidate that reaches it needs `t_single` (with `contradiction_only`, if contradicted)."""
    over = F.col("score") >= t
    lone = F.sum(over.cast("int")).over(Window.partitionBy("s1_id")) == 1
    if contradiction_only:
        lone = lone & contradiction()
    return over & ~(lone & (F.col("score") < t_single))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.ln(p / (1 - p))


def design(rows: DataFrame, evidence: tuple[str, ...] = EVIDENCE) -> tuple[DataFrame, list[str]]:
    """The second stage's 22 inputs, of rows with context, and their names."""
    c = F.col
    new = {
        "logit_score": logit(c("score")), "logit_top": logit(c("s1_top_score")), "logit_second": logit(F.greatest(c("s1_second_score"), F.lit(1e-7))),
        "logit_minus_top": logit(c("score")) - logit(c("s1_top_score")), "x_is_top": c("is_top"), "x_rank": F.least(c("candidate_score_rank"), F.lit(20)),
        "log_s1_candidate_count": F.log1p("s1_candidate_count"), **{f"log_count_ge_{x:g}".replace(".", "_"): F.log1p(c(f"`s1_count_ge_{x:g}`")) for x in (0.95, 0.99, 0.991)},
        "x_other_candidates_high": F.log1p("other_candidates_high_count"), "x_other_source_high": F.log1p("other_source_high_count"), "x_top_is_s3": c("top_is_s3"),
        "candidate_is_s3": (c("target_source") == 3).cast("int"), **{f"x_diff_{e}": c(f"diff_top_{e}") for e in evidence},
        "log_target_name_frequency": F.log1p("target_name_frequency"), "x_target_address_missing": c("target_address_missing"), "address_contradiction": contradiction().cast("int"),
    }
    return rows.withColumns(new), list(new)
