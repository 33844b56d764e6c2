"""Command line: python -m lodestitch convert | normalise | train | link | validate (each with --help)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocking, diagnostics, features, metrics, models
from .plans import pipeline
from .session import build
from .sources import tables


def _entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(path)
    return rows.where("source = 1"), rows.where("source > 1")


def convert(spark: SparkSession, o: argparse.Namespace) -> None:
    """A TSV of entities as Parquet."""
    print("written" if tables.convert(spark, o.tsv, o.parquet) else "already there")


def normalise(spark: SparkSession, o: argparse.Namespace) -> None:
    """Raw entities of the three sources as one table of normalised ones, by source and country."""
    parts = [tables.normalise(tables.load_entities(spark, path), k) for k, path in enumerate((o.s1, o.s2, o.s3), 1) if path]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    tables.write_partitioned(rows, o.out, ["source", "country"])


def train(spark: SparkSession, o: argparse.Namespace) -> None:
    """Fit the first and second stage on labelled pairs; the threshold of the best macro F0.5 is printed."""
    a, b = (tables.stored(x, "entities") for x in pipeline.prepare(*_entities(spark, o.entities)))
    truth = tables.explode_truth(tables.load_truth(spark, o.truth))
    rows = pipeline.pair_features(pipeline.candidate_pairs(a, b), a, b)
    rows = tables.stored(features.with_labels(rows, truth), "labelled")
    params = models.TreeParams(rounds=o.rounds)
    models.fit_trees(rows, None, params).save(f"{o.out}/first", spark)
    scored = models.out_of_fold(rows, None, o.folds, params)
    models.second_stage(scored).save(f"{o.out}/second", spark)
    n = a.select(F.col("id").alias("s1_id")).join(truth.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").fillna(0)
    print("threshold %g, macro F0.5 %.4f" % models.choose(scored, n))


def link(spark: SparkSession, o: argparse.Namespace) -> None:
    """All stages from normalised entities to the two output files; finished stages are kept."""
    s1, targets = _entities(spark, o.entities)
    config = pipeline.Config(channels=tuple(o.channels.split(",")) if o.channels else tuple(blocking.BITS), prefilter=not o.no_prefilter)
    second = models.Matcher.load(f"{o.models}/second", spark) if o.second else None
    got = pipeline.run(spark, s1, targets, o.out, models.Matcher.load(f"{o.models}/first", spark), second, config, threshold=o.threshold)
    got["decisions"].groupBy("target_source").agg(F.count("*").alias("pairs"), F.sum("predicted").alias("predicted")).show()


def validate(spark: SparkSession, o: argparse.Namespace) -> None:
    """Rules that a run's candidates must meet, their recall with --truth; the exit code is 1 if a rule is broken."""
    run = o.run.rstrip("/")
    pairs, a, b = (spark.read.parquet(f"{run}/{x}") for x in ("candidates", "source1", "targets"))
    broken = diagnostics.validate(pairs, a, b).where("n_bad > 0").orderBy("rule").collect()
    for r in broken:
        print(f"{r['n_bad']:>12}  {r['rule']}")
    if o.truth:
        metrics.channel_recall(tables.explode_truth(tables.load_truth(spark, o.truth)), pairs, blocking.BITS).show(20, False)
    if broken:
        raise SystemExit(1)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestitch", description=__doc__)
    p.add_argument("--master", default="local[*]")
    p.add_argument("--partitions", type=int)
    sub = p.add_subparsers(dest="command", required=True)
    wanted = {
        convert: ("tsv", "parquet"), normalise: ("--s1", "--s2", "--s3", "out"), train: ("entities", "truth", "out"),
        link: ("entities", "models", "out", "--channels"), validate: ("run", "--truth"),
    }
    for f, names in wanted.items():
        s = sub.add_parser(f.__name__, help=f.__doc__)
        for n in names:
            s.add_argument(n)
        s.set_defaults(run_command=f)
    sub.choices["train"].add_argument("--rounds", type=int, default=60)
    sub.choices["train"].add_argument("--folds", type=int, default=5)
    sub.choices["link"].add_argument("--threshold", type=float, default=0.991, help="score from which a pair is decided, without the second stage")
    sub.choices["link"].add_argument("--second", action="store_true", help="decide by the second stage")
    sub.choices["link"].add_argument("--no-prefilter", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(args)
    o.run_command(spark or build(o.master, o.partitions), o)


if __name__ == "__main__":
    main()
