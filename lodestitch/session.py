"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def build(master: str = "local[*]", partitions: int | None = None, app: str = "lodestitch", **conf: str) -> SparkSession:
    """A session with AQE on and UTC time; `partitions` sets the shuffle partitions, else Spark's default stays."""
    b = SparkSession.builder.master(master).appName(app)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return link_workers(spark)


def link_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it isn't installed (on a cluster, ship it with --py-files)."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    return link_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def at_once(spark: SparkSession, *jobs: Callable) -> list:
    """What the jobs return, each run in a thread of its own: stages of few tasks leave cores free, and so does planning."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; unset, a temporary one, on a local master only."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lodestitch-")
