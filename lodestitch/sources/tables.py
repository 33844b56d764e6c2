"""Readers and writers: TSV entities and truth, the normalised cache, candidate and output tables, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import scratch_dir

#: Columns of the entity and truth files, and the sources' codes.
ENTITY_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
SOURCE_CODES = {"S1": 1, "S2": 2, "S3": 3}
ENV = "LODESTITCH_DATASET"


def dataset_dir(default: str = "dataset") -> str:
    """The folder of the data: the environment's, if it isn't empty."""
    return os.environ.get(ENV) or default


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _tsv(spark: SparkSession, path: str, columns: tuple[str, ...], exact: bool) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    head = spark.read.text(path).limit(1).collect()
    found = tuple(head[0][0].split("\t")) if head else ()
    if found != columns if exact else set(found) != set(columns):
        raise ValueError(f"{path}: columns {found}, expected {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in found])
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=False, mode="FAILFAST")
    return rows.na.fill("").select(*columns)


def load_entities(spark: SparkSession, path: str, usecols: list[str] | None = None, nrows: int | None = None) -> DataFrame:
    """All strings; an empty field is ''. Unknown or missing columns are an error, and so is a row number under 1."""
    if nrows is not None and nrows <= 0:
        raise ValueError("nrows must be positive")
    if usecols and (odd := set(usecols) - set(ENTITY_COLUMNS)):
        raise ValueError(f"unknown columns {sorted(odd)}")
    rows = _tsv(spark, path, ENTITY_COLUMNS, False)
    rows = rows.select(*usecols) if usecols else rows
    return rows.limit(nrows) if nrows else rows


def load_truth(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    if nrows is not None and nrows <= 0:
        raise ValueError("nrows must be positive")
    rows = _tsv(spark, path, TRUTH_COLUMNS, True)
    return rows.limit(nrows) if nrows else rows


def summarize_entities(rows: DataFrame) -> DataFrame:
    """(column, n_rows, n_blank)."""
    blank = [F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c) for c in rows.columns]
    got = rows.agg(F.count("*").alias("n_rows"), *blank)
    return got.unpivot(["n_rows"], rows.columns, "column", "n_blank").select("column", "n_rows", "n_blank")


def summarize_truth(truth: DataFrame, ids: str = "matched_entity_ids") -> DataFrame:
    """Count, mean, smallest, quartiles and largest of the lists' lengths; an empty list counts as length 1, as splitting gives."""
    n = truth.select(F.size(F.split(ids, ",")).alias("n"))
    quart = [F.percentile("n", F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return n.agg(F.count("*").alias("n_rows"), F.avg("n").alias("mean"), F.min("n").alias("least"), *quart, F.max("n").alias("most"))


def strip_prefix(entity_id: Column | str) -> Column:
    """The number of an id such as S2-681."""
    return F.substring(entity_id, 4, 100).cast("long")


def source_code(entity_id: Column | str) -> Column:
    """2 or 3 by the id's prefix; another prefix is an error."""
    prefix = F.substring(entity_id, 1, 3)
    return F.when(prefix == "S2-", 2).when(prefix == "S3-", 3).otherwise(F.raise_error(F.concat(F.lit("unknown source: "), entity_id)).cast("int"))


def explode_truth(truth: DataFrame) -> DataFrame:
    """(s1_id, target_source, target_id) of the comma lists."""
    one = truth.select(strip_prefix("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("e")).select("s1_id", F.trim("e").alias("e")).where("e <> ''")
    return one.select("s1_id", source_code(F.col("e")).alias("target_source"), strip_prefix(F.col("e")).alias("target_id"))


def normalise(entities: DataFrame, source: int) -> DataFrame:
    """(source, id, country, norm_name, norm_address) of raw entities."""
    return entities.select(
        F.lit(source).alias("source"), strip_prefix("entity_id").alias("id"), X.normalize_country("country").alias("country"),
        X.normalize_business_name("business_name").alias("norm_name"), X.normalize_address("business_address").alias("norm_address"),
    )


def convert(spark: SparkSession, tsv: str, parquet: str) -> bool:
    """A TSV as zstd Parquet, unless it is there already; Spark's commit makes it whole or absent."""
    if exists(spark, f"{parquet}/_SUCCESS"):
        return False
    load_entities(spark, tsv).write.mode("overwrite").option("compression", "zstd").parquet(parquet)
    return True


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition; only partitions that `rows` has are replaced, so finished ones survive a rerun."""
    rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load_partition(spark: SparkSession, path: str, source: int | None = None, country: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of one source and country, by partition pruning, sorted by id."""
    rows = spark.read.parquet(path)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if country is not None:
        rows = rows.where(F.col("country") == country)
    rows = rows.orderBy("id")
    return rows.select(*columns) if columns else rows


def countries(entities: DataFrame) -> DataFrame:
    return entities.select("country").distinct().orderBy("country")


def lookup(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """The entities whose id is in `ids`."""
    return entities.join(ids.select("id").distinct(), "id", "left_semi")


def require_all(keys: DataFrame, entities: DataFrame, on: str = "id") -> DataFrame:
    """`keys` with the entities' columns; an id that no entity has is an error."""
    found = keys.join(entities.withColumn("__there", F.lit(True)), on, "left")
    ok = F.coalesce("__there", F.raise_error(F.concat(F.lit("no entity "), F.col(on).cast("string"))).cast("boolean"))
    return found.where(ok).drop("__there")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written once to the folder that all executors share and read again, so that what reads them often doesn't work
    them out anew and lost executors don't matter."""
    path = f"{scratch_dir(rows.sparkSession)}/lodestitch-{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def id_lists(s1: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, list) with a row for every S1; ids by source and number, comma-joined, '' without any."""
    one = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("target_source", "target_id"))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat(F.lit("S"), e["target_source"].cast("string"), F.lit("-"), e["target_id"].cast("string"))), ",")
    return s1.select("s1_id", *(c for c in s1.columns if c == "country")).join(one, "s1_id", "left").select(F.concat(F.lit("S1-"), F.col("s1_id").cast("string")).alias("source1_entity_id"), F.coalesce(text, F.lit("")).alias(name), *(c for c in s1.columns if c == "country"), "s1_id")


def write_lists(lists: DataFrame, path: str) -> None:
    """One TSV file `path` with a header, in the order of country and S1.

    The lines are written in parts by range, without one task for all; the parts are then joined byte by byte into a file
    beside `path`, which takes its place in one step. A file that is there already is replaced.
    """
    spark = lists.sparkSession
    order = [c for c in ("country", "s1_id") if c in lists.columns]
    names = [c for c in lists.columns if c not in order]
    parts = f"{path}.parts"
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
    lists.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.mode("overwrite").text(parts)
    fs, folder = _hadoop(spark, parts)
    target, new = (_hadoop(spark, x)[1] for x in (path, f"{path}.new"))
    out = fs.create(new, True)
    out.write(bytearray(("\t".join(names) + "\n").encode()))
    files = sorted(x.getPath().toString() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    for name in files:
        got = fs.open(_hadoop(spark, name)[1])
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(got, out, 1 << 20, False)
        got.close()
    out.close()
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(new, target)
    fs.delete(folder, True)


def content_hash(rows: DataFrame) -> DataFrame:
    """(n_rows, hash) that doesn't depend on the rows' order."""
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*(F.col(c).cast("string") for c in sorted(rows.columns)))), F.lit(0)).alias("hash"))


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    """The same columns and types and the same rows as often; NULLs are equal."""
    return a.dtypes == b.dtypes and not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def write_manifest(spark: SparkSession, path: str, what: dict) -> None:
    """A JSON file beside the tables; one with other content there is an error."""
    text = json.dumps(what, sort_keys=True, indent=1)
    if exists(spark, path):
        if "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).strip() != text.strip():
            raise ValueError(f"{path} holds another configuration")
        return
    fs, p = _hadoop(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def config_hash(what: dict) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()
