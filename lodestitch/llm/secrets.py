"""Secret scans with DataFrame functions alone: patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The base patterns, the lengths their matches need, and the order of kinds at one start.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LENGTH = 6

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: A candidate of the Markov models: a whole run of the alphabet's characters of LEAST or more, or a part of it of as many.
LEAST = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

#: Labelled sample of ordinary identifiers and words (label 0); the random strings (label 1) are made by `random_sample`.
ORDINARY = """
get_user_name set_default_value max_retry_count http_request_handler is_valid_address parse_configuration_file
connection_timeout_seconds read_next_line write_output_stream current_working_directory number_of_partitions
createTemporaryFile initializeComponent onButtonClicked componentDidMount getElementById addEventListener
applicationContext abstractFactoryBean defaultSerializer transactionManager responseEntityBuilder toLowerCase
MAX_BUFFER_SIZE DEFAULT_ENCODING ENVIRONMENT_VARIABLE RUNTIME_EXCEPTION LAST_MODIFIED_DATE CONTENT_LENGTH
internationalization misunderstanding responsibilities characteristically straightforwardness counterproductive
nevertheless notwithstanding interchangeable environmental undergraduate transformation representative recommendation
gouvernement développement particulièrement environnement administration naturellement quelquechose aujourdhui
geschwindigkeit verantwortung unternehmen wissenschaftlich entwicklung selbstverständlich straßenverkehr gesellschaft
administración desarrollo conocimiento especialmente universidad responsabilidad aproximadamente inmediatamente
usr/local/share/documentation src/main/resources/templates home/user/projects/website var/log/application/server
index_page_header_image monday-morning-meeting-notes frequently-asked-questions terms-and-conditions-of-service
the of and to in is that it for was on are as with his they at be this have from or one had by word but not what all
were we when your can said there use an each which she do how their if will up other about out many then them these so
some her would make like him into time has look two more write go see number no way could people my than first water
been call who oil its now find long down day did get come made may part over new sound take only little work know place
years live me back give most very after things our just name good sentence man think say great where help through much
before line right too means old any same tell boy follow came want show also around form three small set put end does
another well large must big even such because turn here why ask went men read need land different home us move try kind
hand picture again change off play spell air away animal house point page letter mother answer found study still learn
should america world high every near add food between own below country plant last school father keep tree never start
""".split()

#: A candidate is a secret from so many nats of log-likelihood ratio a character.
NATS_A_CHARACTER = 0.55
#: A part of a run ends where its summed ratio over the threshold has fallen by so many nats.
DROP = 6.0
RANDOM_STRINGS = 600
BACKOFF = 5.0


def random_sample(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """`n` strings of label 1: digests written in base 64 and in hexadecimal."""
    digest = F.sha2(F.concat(F.lit("lodestitch|"), F.col("id").cast("string")), 256)
    return spark.range(n).select(
        F.lit(1).alias("label"), F.when(F.col("id") % 4 == 0, digest).otherwise(F.base64(F.unhex(digest))).alias("sample")
    )


def train(spark: SparkSession, labelled: DataFrame | None = None) -> list[float]:
    """The log-likelihood ratios ln P(b|a, random) - ln P(b|a, ordinary) of all pairs of the alphabet, in its order.

    `labelled` has label (1 random, 0 ordinary) and sample. Each model's pairs are smoothed by its single characters,
    which weigh as BACKOFF more pairs after each character; those are smoothed by adding a half. What is collected has a
    row for each label and pair of the alphabet at most.
    """
    if labelled is None:
        ordinary = spark.range(1).select(F.lit(0).alias("label"), F.explode(F.array(*map(F.lit, ORDINARY))).alias("sample"))
        labelled = random_sample(spark).union(ordinary)
    n = len(ALPHABET)
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring("sample", i, F.lit(1)))
    pairs = labelled.where(F.length("sample") >= 2).select("label", "sample", F.explode(F.sequence(F.lit(1), F.length("sample") - 1)).alias("i"))
    pairs = pairs.select("label", at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b")).where("a > 0 and b > 0")
    count = {(r["label"], r["a"], r["b"]): r["count"] for r in pairs.groupBy("label", "a", "b").count().collect()}
    every = range(1, n + 1)
    after = {(y, a): sum(count.get((y, a, b), 0) for b in every) for y in (0, 1) for a in every}
    single = {(y, b): sum(count.get((y, a, b), 0) for a in every) for y in (0, 1) for b in every}
    share = {(y, b): (single[y, b] + 0.5) / (sum(single[y, x] for x in every) + 0.5 * n) for y in (0, 1) for b in every}
    p = lambda y, a, b: (count.get((y, a, b), 0) + BACKOFF * share[y, b]) / (after[y, a] + BACKOFF)
    return [math.log(p(1, a, b) / p(0, a, b)) for a in every for b in every]


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """Arrays of the matches' starts, ends (code points) and the group's texts: what lies between is what split leaves."""
    match, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    each = F.transform(F.arrays_zip(match.alias("m"), F.slice(between, 1, F.size(match)).alias("gap"), part.alias("g")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"), x["g"].alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,g:string>>").alias("out"))
    return F.aggregate(
        each, start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end"), x["g"].alias("g")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _sum_ratio(token: Column, table: Column, less: float = 0.0) -> Column:
    """The sum of the pairs' log-likelihood ratios, each less by `less`; 0 for fewer than two characters."""
    n = len(ALPHABET)
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    pairs = F.when(F.length(token) > 1, F.sequence(F.lit(1), F.length(token) - 1)).otherwise(F.array().cast("array<int>"))
    each = F.transform(pairs, lambda i: F.element_at(table, ((at(i) - 1) * n + at(i + 1)).cast("int")))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x - less)


def _mean_ratio(token: Column, table: Column) -> Column:
    return _sum_ratio(token, table) / (F.length(token) - 1)


def _parts(token: Column, table: Column, threshold: float) -> Column:
    """Starts and ends of the parts of a run that are secrets by themselves, in order; parts don't overlap.

    A piece is a stretch of letters and digits with the separators before it. From left to right, pieces are joined as
    long as the sum of (ratio - threshold) over what is joined stays positive, so its mean is over the threshold; a
    joined stretch of LEAST characters or more counts up to its highest sum, and ends where the sum has fallen by DROP.
    An = before a letter or digit always separates.
    """
    piece = F.regexp_extract_all(token, F.lit("[+/_=-]+[A-Za-z0-9]*|[A-Za-z0-9]+"), F.lit(0))

    def measured(x: Column) -> Column:
        bare = F.regexp_replace(x, "^[+/_=-]+", "")
        return F.struct(
            F.length(x).alias("n"), (F.length(x) - F.length(bare)).alias("lead"), x.rlike("=[+/_=-]*[A-Za-z0-9]").alias("hard"),
            _sum_ratio(x, table, threshold).alias("joined"), _sum_ratio(bare, table, threshold).alias("alone"),
        )

    none = F.array().cast("array<struct<start:int,end:int>>")
    found = lambda a: F.when(a["to"] > 0, F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["to"].alias("end"))))).otherwise(a["out"])
    state = lambda at, begin, total, start, end, best, out: F.struct(at.alias("at"), begin.alias("begin"), total.alias("total"), start.alias("from"), end.alias("to"), best.alias("best"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        end, total = a["at"] + x["n"], a["total"] + x["joined"]
        anew = x["hard"] | (total < x["alone"]) | ((a["to"] > 0) & (total < a["best"] - DROP))
        begin, total = F.when(anew, a["at"] + x["lead"]).otherwise(a["begin"]), F.when(anew, x["alone"]).otherwise(total)
        to, best = F.when(anew, 0).otherwise(a["to"]), F.when(anew, 0.0).otherwise(a["best"])
        more = (end - begin >= LEAST) & (total >= best)
        return state(end, begin, total, F.when(more, begin).otherwise(a["from"]), F.when(more, end).otherwise(to), F.when(more, total).otherwise(best), F.when(anew, found(a)).otherwise(a["out"]))

    start = state(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0.0), none)
    return F.aggregate(F.transform(piece, measured), start, step, found)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, model: list[float], threshold: float = NATS_A_CHARACTER) -> Column:
    """All spans of a text as structs (start, kind, end), by start and kind; kind is a place in KINDS, end is exclusive.

    Base kinds are what the fixed patterns match. `markov` is a candidate run whose mean log-likelihood ratio reaches
    `threshold`, or else each part of the run that does (see `_parts`), if no base span overlaps it. A null text has none.
    """
    none = F.array().cast(SPANS)
    as_kind = lambda found, k: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    only = lambda pattern, found: F.when(text.rlike(pattern), found).otherwise(none)
    assign = only(ASSIGN, as_kind(F.filter(_found(text, ASSIGN, 2), lambda x: F.length(x["g"]) >= ASSIGN_LENGTH), 0))
    access = F.when(text.contains("AKIA"), as_kind(_found(text, ACCESS), 1)).otherwise(none)
    hexes = only(HEX, as_kind(_found(text, HEX), 2))
    base = F.concat(assign, access, hexes)
    table = F.array(*map(F.lit, model))
    whole = lambda x: F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))
    parts = lambda x: F.transform(_parts(x["g"], table, threshold), lambda p: F.struct((x["start"] + p["start"]).alias("start"), (x["start"] + p["end"]).alias("end")))
    runs = F.transform(_found(text, CANDIDATE), lambda x: F.when(_mean_ratio(x["g"], table) >= threshold, whole(x)).otherwise(parts(x)))
    markov = only(CANDIDATE, as_kind(F.flatten(runs), 3))
    return base, markov


def scan(docs: DataFrame, model: list[float] | None = None, text_col: str = "text", into: str = "secret_spans") -> DataFrame:
    """`docs` with `into`: its spans as an array of structs (start, kind, end), sorted by start, kind and end.

    Null and empty texts have none. Other columns stay; one named `into` is replaced. Rows that repeat are kept.
    """
    model = train(docs.sparkSession) if model is None else model
    base, markov = spans(F.coalesce(F.col(text_col), F.lit("")), model)
    base_, markov_ = fresh("base_spans", [*docs.columns, into]), fresh("markov_spans", [*docs.columns, into])
    free = F.filter(F.col(markov_), lambda m: ~F.exists(F.col(base_), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    rows = docs.withColumn(base_, base).withColumn(markov_, markov)
    return rows.withColumn(into, F.array_sort(F.concat(base_, free)).cast(SPANS)).drop(base_, markov_)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), model).select("doc_id", F.col("secret_spans").alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), n(3))


def redact(docs: DataFrame, model: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret in `text` replaced by `mark` (overlapping spans by one) and `n_chars` counted anew. No row goes."""
    found = fresh("spans", docs.columns)
    rows = scan(docs, model, into=found)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut_out = F.aggregate(
        found, start,
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size(found) > 0, cut_out).otherwise(text)
    rows = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
