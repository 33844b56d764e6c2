"""The named queries of the linkage operators, and their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import similarity as S
from ..functions import text as T
from ..functions import words as W
from ..operators import blocking, contents, context, diagnostics, errors, features, metrics, models, splits
from ..session import at_once, scratch_dir, table
from ..sources import tables
from ..streaming import link
from . import pipeline, views

FLAGSHIP = "macro_f05"
QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


r6 = lambda c, name: F.round(c, 6).alias(name)
E_ = f"WITH e AS ({views.ENTITIES}), a AS (SELECT * FROM e WHERE source = 1), t AS (SELECT * FROM e WHERE source > 1)"
EV = f"WITH s AS ({views.SCORED})"
TRUTH = "truth AS (SELECT a.id AS s1_id, a.country, t.source AS target_source, t.id AS target_id FROM a JOIN t USING (truth_key))"
TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
PLAIN = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}\p{{M}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
NUMBERS = r"list_transform(regexp_extract_all({0}, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)"
quoted = lambda words: ", ".join(f"'{w}'" for w in words)

# --- text -------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({PLAIN.format('text')}) AS norm_md5, CAST(length({PLAIN.format('text')}) AS BIGINT) AS n FROM documents")
def norm_text(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("n"))
    return n.select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").cast("long").alias("n"))


_LEGAL = "(?:" + "|".join(W.LEGAL_WORDS) + ")"


@query(f"{E_} SELECT id, regexp_replace(regexp_replace('sa co ' || norm_name || ' private ltd', '^(?:{_LEGAL}(?: |$))+', ''), '(?:(?:^| ){_LEGAL})+$', '') AS name FROM e")
def norm_name_suffix(spark, sf_dir):
    return views.entities(spark, sf_dir).select("id", T.strip_legal(F.concat(F.lit("sa co "), "norm_name", F.lit(" private ltd"))).alias("name"))


@query(f"{E_} SELECT id, array_to_string(list_sort({TOKENS.format('norm_name')}), ' ') AS k FROM e")
def token_sort_key(spark, sf_dir):
    return views.entities(spark, sf_dir).select("id", T.sorted_tokens("norm_name").alias("k"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter({TOKENS.format('lower(text)')}, lambda x: x NOT IN ({quoted(W.STOP_WORDS)})), ' ')) AS m FROM documents")
def stopword_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_stop_words(F.lower("text"))).alias("m"))


def _skeleton_sql(x: str) -> str:
    for old, new in W.DIGRAPHS:
        x = f"replace({x}, '{old}', '{new}')"
    x = f"regexp_replace({x}, '[aeiouy]', '', 'g')"
    for c in "bcdfghjklmnpqrstvwxz0123456789":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


@query(f"{E_} SELECT id, CASE WHEN length(regexp_replace(k, '[^a-z]', '', 'g')) >= 2 THEN k ELSE '' END AS k FROM (SELECT id, array_to_string(list_filter(list_transform({TOKENS.format('norm_name')}, lambda w: CASE WHEN regexp_matches(w, '{W.SKELETON_LEGAL}') OR regexp_matches(w, '{W.SKELETON_SHORT}') THEN '' ELSE {_skeleton_sql('w')} END), lambda y: y <> ''), ' ') AS k FROM e)")
def skeleton(spark, sf_dir):
    return T.add_skeleton(views.entities(spark, sf_dir)).select("id", F.col("skeleton").alias("k"))


@query()
def transliterate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.transliterate("text")).alias("latin_md5"), T.script_profile("text").alias("p"), T.dominant_script("text").alias("script")).select("doc_id", "latin_md5", "p.*", F.col("script").alias("first"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[ऀ-෿]') AS indic, CAST(length(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g')) AS BIGINT) AS letters FROM documents")
def letter_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_indic("text").alias("indic"), F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("letters"))


_SHORT = """SELECT lower(concat(n_name, ' ', r_name)) AS long, CASE n_nationkey % 4 WHEN 0 THEN concat(lower(substr(n_name, 1, 1)), ' ', lower(substr(r_name, 1, 1))) WHEN 1 THEN '123 a 4'
 WHEN 2 THEN concat(lower(n_name), '�') ELSE lower(n_name) END AS short FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query(f"""SELECT long, short, length(replace(short, ' ', '')) >= 2 AND replace(short, ' ', '') = array_to_string(list_transform(string_split(long, ' '), lambda x: x[1]), '') AS hit,
 contains(short, '�') OR length(regexp_replace(short, '[^a-z]', '', 'g')) < greatest(2, length(replace(short, ' ', '')) // 2) AS noisy FROM ({_SHORT})""")
def abbreviation_noise(spark, sf_dir):
    sql = _SHORT.replace("FROM nation JOIN region", "FROM {n} JOIN {r}")
    rows = spark.sql(sql, n=table(spark, sf_dir, "nation"), r=table(spark, sf_dir, "region"))
    return rows.select("long", "short", T.is_abbreviation("short", "long").alias("hit"), T.is_noisy("short", "short").alias("noisy"))


# --- addresses --------------------------------------------------------------------------------------------------------

_HOUSE = f"coalesce(ltrim(regexp_replace(list_filter({TOKENS.format('norm_address')}, lambda x: regexp_matches(x, '[0-9]'))[1], '[^0-9]', '', 'g'), '0'), '')"
_PLACE = f"coalesce(list_position(list_transform({TOKENS.format('norm_address')}, lambda x: regexp_matches(x, '[0-9]')), true), 0)"
_POSTAL = f"coalesce(list_filter({TOKENS.format('norm_address')}, lambda x, i: length(x) = CASE country WHEN 'us' THEN 5 ELSE 6 END AND regexp_matches(x, '^[0-9]+$') AND i <> {_PLACE})[-1], '')"
_LEXICON = """lexicon AS (SELECT country, token, count(*) AS n FROM (
  SELECT country, unnest(CASE country WHEN 'us' THEN regexp_extract_all(norm_address, '(\\S+) (?:il|or)(?: |$)', 1) ELSE regexp_extract_all(norm_address, '(\\S+) (?:tamil nadu|goa)(?: |$)', 1) END) AS token FROM a)
  WHERE NOT regexp_matches(token, '[0-9]') AND length(token) >= 3 GROUP BY ALL HAVING count(*) >= 25)"""
_CITY = "coalesce((SELECT max_by(token, i) FROM (SELECT unnest(string_split(norm_address, ' ')) AS token, unnest(range(100)) AS i) q JOIN lexicon USING (token) WHERE lexicon.country = e.country), '')"
_KEYS = f"""{E_}, {_LEXICON}, w AS (SELECT id, country, unnest(string_split(norm_address, ' ')) AS token, generate_subscripts(string_split(norm_address, ' '), 1) AS i FROM e),
 c AS (SELECT id, max_by(w.token, i) AS city FROM w JOIN lexicon USING (country, token) GROUP BY id),
 k AS (SELECT e.*, {_HOUSE} AS house, {_POSTAL} AS postal, coalesce(c.city, '') AS city FROM e LEFT JOIN c USING (id)),
 kk AS (SELECT *, CASE WHEN house <> '' AND city <> '' THEN house || '|' || city ELSE '' END AS house_city FROM k)"""


@query(f"{E_} SELECT id, array_to_string({NUMBERS.format('norm_address')}, ',') AS numbers, {_HOUSE} AS house, {_POSTAL} AS postal FROM e")
def address_numbers(spark, sf_dir):
    return views.entities(spark, sf_dir).select("id", F.array_join(A.numbers("norm_address"), ",").alias("numbers"), A.house_number("norm_address").alias("house"), A.postal_code("norm_address", "country").alias("postal"))


@query(f"{E_}, {_LEXICON} SELECT country, token, CAST(n AS BIGINT) AS n FROM lexicon")
def city_lexicon(spark, sf_dir):
    return A.learn_city_lexicon(views.sides(spark, sf_dir)[0])


def _keyed(spark, sf_dir):
    rows = views.entities(spark, sf_dir)
    return A.with_keys(rows, A.learn_city_lexicon(rows.where("source = 1")))


@query(f"{_KEYS} SELECT id, house, postal, city, house_city FROM kk")
def address_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("id", "house", "postal", "city", "house_city")


@query(f"{E_} SELECT id, trim(regexp_replace(' ' || norm_address || ' ', CASE country WHEN 'us' THEN ' (?:il|or) ' ELSE ' (?:tamil nadu|goa) ' END, ' ', 'g')) AS rest FROM e")
def strip_states(spark, sf_dir):
    rest = F.when(F.col("country") == "us", A.without_states("norm_address", "us")).otherwise(A.without_states("norm_address", "india"))
    return views.entities(spark, sf_dir).select("id", rest.alias("rest"))


# --- sources and truth ------------------------------------------------------------------------------------------------

_LISTS = f"""{E_}, {TRUTH}, l AS (SELECT 'S1-' || a.id AS source1_entity_id, coalesce(string_agg('S' || target_source || '-' || target_id, ',' ORDER BY target_source, target_id), '') AS matched_entity_ids
 FROM a LEFT JOIN truth ON a.id = s1_id GROUP BY a.id)"""


def _lists(spark, sf_dir):
    s1 = views.sides(spark, sf_dir)[0].select(F.col("id").alias("s1_id"))
    return tables.id_lists(s1, views.truth(spark, sf_dir)).drop("s1_id")


@query(f"{_LISTS} SELECT * FROM l")
def output_lists(spark, sf_dir):
    return _lists(spark, sf_dir)


@query(f"{E_}, {TRUTH} SELECT s1_id, target_source, target_id FROM truth")
def truth_explode(spark, sf_dir):
    return tables.explode_truth(_lists(spark, sf_dir))


@query(f"{E_} SELECT 'norm_name' AS \"column\", count(*) AS n_rows, count(*) FILTER (trim(norm_name) = '') AS n_blank FROM e UNION ALL SELECT 'norm_address', count(*), count(*) FILTER (trim(norm_address) = '') FROM e UNION ALL SELECT 'country', count(*), count(*) FILTER (trim(country) = '') FROM e")
def blank_summary(spark, sf_dir):
    return tables.summarize_entities(views.entities(spark, sf_dir).select("norm_name", "norm_address", "country"))


@query(f"{_LISTS} SELECT count(*) AS n_rows, avg(n) AS mean, min(n) AS least, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS most FROM (SELECT len(string_split(matched_entity_ids, ',')) AS n FROM l)")
def match_len_summary(spark, sf_dir):
    return tables.summarize_truth(_lists(spark, sf_dir))


@query(f"{E_} SELECT DISTINCT country FROM e")
def distinct_countries(spark, sf_dir):
    return tables.countries(views.entities(spark, sf_dir))


@query(f"{E_} SELECT id, norm_name FROM e WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def id_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("id"))
    return tables.lookup(views.entities(spark, sf_dir), ids).select("id", "norm_name")


@query()
def content_hash(spark, sf_dir):
    return tables.content_hash(table(spark, sf_dir, "orders"))


# --- blocking ---------------------------------------------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY s1_id, target_source ORDER BY target_id) - 1"


def _equal_sql(key: str, cap: int | None, frm: str = "e") -> str:
    small = f"AND (SELECT count(*) FROM {frm} z WHERE z.source = t.source AND z.country = t.country AND z.{key} = t.{key}) <= {cap}" if cap else ""
    return f"SELECT a.id AS s1_id, t.source AS target_source, t.id AS target_id FROM {frm} a JOIN {frm} t ON a.source = 1 AND t.source > 1 AND a.country = t.country AND a.{key} = t.{key} AND a.{key} <> '' {small}"


def _ranked_sql(inner: str) -> str:
    return f"SELECT s1_id, target_source, target_id, 1.0e0 AS score, {_RANK} AS rank FROM ({inner})"


@query(f"{E_} {_ranked_sql(_equal_sql('norm_name', None))}")
def join_exact_name(spark, sf_dir):
    return blocking.exact_name(*views.sides(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


_SORTED = f"{E_}, m AS (SELECT *, array_to_string(list_sort({TOKENS.format('norm_name')}), ' ') AS k FROM e)"


@query(f"{_SORTED} {_ranked_sql(_equal_sql('k', 20, 'm'))}")
def join_token_sort(spark, sf_dir):
    return blocking.sorted_name(*views.sides(spark, sf_dir), 20).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_KEYS} {_ranked_sql(_equal_sql('house_city', 12, 'kk'))}")
def join_house_city(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    return blocking.equal_key(rows.where("source = 1"), rows.where("source > 1"), "house_city", 12).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_KEYS} {_ranked_sql(_equal_sql('postal', 12, 'kk'))}")
def join_postal(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    return blocking.equal_key(rows.where("source = 1"), rows.where("source > 1"), "postal", 12).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{E_}, w AS (SELECT DISTINCT id, source, country, unnest({TOKENS.format('norm_name')}) AS token FROM e), f AS (SELECT source, country, token, count(*) AS n FROM w WHERE source > 1 GROUP BY ALL HAVING count(*) <= 400),
 c AS (SELECT w.id AS s1_id, f.source, w.country, w.token FROM w JOIN f ON w.source = 1 AND w.country = f.country AND w.token = f.token QUALIFY row_number() OVER (PARTITION BY w.id, f.source ORDER BY f.n, w.token) <= 2)
 SELECT DISTINCT c.s1_id, c.source AS target_source, w.id AS target_id FROM c JOIN w ON c.source = w.source AND c.country = w.country AND c.token = w.token""")
def token_index_rare(spark, sf_dir):
    return blocking.rare_tokens(*views.sides(spark, sf_dir), max_frequency=400, max_tokens=2)


def _tfidf_sql(col: str, k: int, pool: int | None, max_df: int | None, renorm: bool = False) -> str:
    cap = f"WHERE df <= {max_df}" if max_df else ""
    unit = lambda x: f"SELECT source, country, id, gram, df, w / sqrt(sum(w * w) OVER (PARTITION BY source, country, id)) AS w FROM {x}"
    head = f"""{E_}, g0 AS (SELECT id, source, country, unnest(list_transform({TOKENS.format(f'lower({col})')}, lambda x: ' ' || x || ' ')) AS w FROM e),
 g AS (SELECT DISTINCT id, source, country, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS gram FROM g0),
 n AS (SELECT source, country, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT source, country, gram, count(*) AS df FROM g WHERE source > 1 GROUP BY ALL),
 tw AS ({unit('(SELECT g.*, d.df, ln((1 + n.n) / (1 + d.df)) + 1 AS w FROM g JOIN d USING (source, country, gram) JOIN n USING (source, country))')}),
 qw AS ({unit('(SELECT n.source, g.country, g.id, g.gram, coalesce(d.df, 0) AS df, ln((1 + n.n) / (1 + coalesce(d.df, 0))) + 1 AS w FROM g JOIN n ON g.source = 1 AND g.country = n.country LEFT JOIN d ON d.source = n.source AND d.country = g.country AND d.gram = g.gram)')}),
 tp AS ({unit(f'(SELECT * FROM tw {cap})') if renorm else f'SELECT * FROM tw {cap}'}), qp AS ({unit(f'(SELECT * FROM qw {cap})') if renorm else f'SELECT * FROM qw {cap}'}),
 p AS (SELECT q.source, q.country, q.id AS q, x.id AS t, round(sum(q.w * x.w), 9) AS pruned FROM qp q JOIN tp x USING (source, country, gram) GROUP BY ALL HAVING sum(q.w * x.w) > 0)"""
    if pool is None:
        return f"{head} SELECT q AS s1_id, source AS target_source, t AS target_id, round(pruned, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY source, country, q ORDER BY pruned DESC, t) <= {k}"
    return f"""{head}, h AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source, country, q ORDER BY pruned DESC, t) <= {pool}),
 r AS (SELECT h.source, h.country, h.q, h.t, h.pruned, round(sum(qw.w * tw.w), 9) AS score FROM h JOIN qw ON qw.source = h.source AND qw.country = h.country AND qw.id = h.q JOIN tw ON tw.source = h.source AND tw.country = h.country AND tw.id = h.t AND tw.gram = qw.gram GROUP BY ALL)
 SELECT q AS s1_id, source AS target_source, t AS target_id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY source, country, q ORDER BY score DESC, pruned DESC, t) <= {k}"""


def _tfidf(spark, sf_dir, col, k, pool, max_df, renorm=False):
    out = blocking.tfidf_topk(*views.sides(spark, sf_dir), col, k, pool, max_df, renormalize=renorm)
    return out.select("s1_id", "target_source", "target_id", r6(F.col("score"), "score"))


@query(_tfidf_sql("norm_name", 5, 20, None))
def tfidf_topk_name(spark, sf_dir):
    return _tfidf(spark, sf_dir, "norm_name", 5, 20, None)


@query(_tfidf_sql("norm_address", 5, None, None))
def tfidf_topk_address(spark, sf_dir):
    return _tfidf(spark, sf_dir, "norm_address", 5, None, None)


@query(_tfidf_sql("norm_name", 5, None, 300, True))
def tfidf_renorm(spark, sf_dir):
    return _tfidf(spark, sf_dir, "norm_name", 5, None, 300, True)


_EQUI = {"exact_name": ("norm_name", None), "house_city": ("house_city", 12), "postal_code": ("postal", 12), "name_token_sort": ("k", 20)}
_MERGE = f"""{_KEYS}, kkk AS (SELECT *, array_to_string(list_sort({TOKENS.format('norm_name')}), ' ') AS k FROM kk),
 u AS ({' UNION ALL '.join(f"SELECT *, {blocking.BITS[n]} AS bit FROM ({_equal_sql(key, cap, 'kkk')})" for n, (key, cap) in _EQUI.items())}),
 m0 AS (SELECT s1_id, target_source, target_id, bit_or(bit) AS mask FROM u GROUP BY ALL),
 m AS (SELECT s1_id, target_source, target_id, CASE WHEN mask & 15 <> 0 THEN mask & 15 ELSE mask END AS mask FROM m0)"""


def _merged(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    a, t = rows.where("source = 1"), rows.where("source > 1")
    found = {n: blocking.equal_key(a, t, T.sorted_tokens("norm_name") if n == "name_token_sort" else key, cap) for n, (key, cap) in _EQUI.items()}
    empty = found["exact_name"].limit(0)
    return blocking.merge({**found, "name_char": empty, "address_char": empty, "translit_name": empty})


@query(f"{_MERGE} SELECT s1_id, target_source, target_id, CAST(mask AS BIGINT) AS mask, mask & 8 <> 0 AS house_city_hit, mask & 32 <> 0 AS postal_code_hit, mask & 64 <> 0 AS name_token_sort_hit FROM m")
def merge_candidates_mask(spark, sf_dir):
    return _merged(spark, sf_dir).select("s1_id", "target_source", "target_id", F.col("mask").cast("long").alias("mask"), "house_city_hit", "postal_code_hit", "name_token_sort_hit")


@query(f"{E_} SELECT a.id FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.country = a.country AND t.norm_name = a.norm_name AND a.norm_name <> '')")
def unmatched_anti(spark, sf_dir):
    a, t = views.sides(spark, sf_dir)
    hit = blocking.exact_name(a, t).select(F.col("s1_id").alias("id"))
    return a.select("id").join(hit, "id", "left_anti")


@query(f"{_MERGE} SELECT 'all' AS seg, CAST(count(*) AS BIGINT) AS n FROM m WHERE s1_id IN (SELECT id FROM a ORDER BY CAST('0x' || substr(md5('42|' || id), 1, 8) AS BIGINT), id LIMIT 100)")
def semi_join_sample(spark, sf_dir):
    ids = splits.sample(views.sides(spark, sf_dir)[0].select(F.col("id").alias("s1_id")), 100)
    return _merged(spark, sf_dir).join(ids, "s1_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("all").alias("seg"), "n")


@query(f"{E_}, x AS ({_equal_sql('norm_name', None)}) SELECT s1_id, target_source, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL")
def candidates_per_s1(spark, sf_dir):
    return blocking.exact_name(*views.sides(spark, sf_dir)).groupBy("s1_id", "target_source").agg(F.count("*").alias("n"))


@query(f"""{E_}, w AS (SELECT id, source, country, unnest(list_transform({TOKENS.format('norm_name')}, lambda x: ' ' || x || ' ')) AS w FROM e), g AS (SELECT DISTINCT id, source, country, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS gram FROM w),
 d AS (SELECT source, country, gram, count(*) AS df FROM g WHERE source > 1 GROUP BY ALL) SELECT g.id AS s1_id, d.source, CAST(sum(df) AS BIGINT) AS postings FROM g JOIN d ON g.source = 1 AND g.country = d.country AND g.gram = d.gram GROUP BY ALL""")
def postings_per_query(spark, sf_dir):
    return blocking.postings_per_query(*views.sides(spark, sf_dir))


@query()
def char_2_5_gram_knn(spark, sf_dir):
    out = blocking.tfidf_topk(*views.sides(spark, sf_dir), "norm_name", 20, None, None, sizes=(2, 5), binary=False, min_df=2)
    return out.select("s1_id", "target_source", "target_id", r6(F.col("score"), "score"), "rank")


@query(f"{E_} {_equal_sql('norm_name', None)}")
def stream_exact_links(spark, sf_dir):
    customers = spark.readStream.schema(table(spark, sf_dir, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    new = views.of(customers, table(spark, sf_dir, "nation")).where("source = 1")
    at = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = link.exact_links(new, views.sides(spark, sf_dir)[1]).select("s1_id", "target_source", "target_id")
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


# --- the blocking queries whole -----------------------------------------------------------------------------------------
# As above with the operators' own values (blocking.DEFAULTS, rare_tokens) and all seven channels. No twins: too slow in SQL.


def _whole(spark, sf_dir):
    """Both sides with all that channels and pairs take, worked out once."""
    return tuple(tables.stored(rows, "entities") for rows in pipeline.prepare(*views.sides(spark, sf_dir)))


def _whole_channel(spark, sf_dir, name):
    # names and addresses are as they are given: searches need nothing that is derived from an entity
    given = views.sides(spark, sf_dir) if name in ("name_char", "address_char") else _whole(spark, sf_dir)
    return blocking.channels(*given, (name,))[name].withColumn("rank", F.col("rank").cast("long"))


@query()
def join_token_sort_whole(spark, sf_dir):
    return _whole_channel(spark, sf_dir, "name_token_sort")


@query()
def join_house_city_whole(spark, sf_dir):
    return _whole_channel(spark, sf_dir, "house_city")


@query()
def join_postal_whole(spark, sf_dir):
    return _whole_channel(spark, sf_dir, "postal_code")


@query()
def token_index_rare_whole(spark, sf_dir):
    return blocking.rare_tokens(*views.sides(spark, sf_dir))


@query()
def tfidf_topk_name_whole(spark, sf_dir):
    return _whole_channel(spark, sf_dir, "name_char").select("s1_id", "target_source", "target_id", r6(F.col("score"), "score"))


@query()
def tfidf_topk_address_whole(spark, sf_dir):
    return _whole_channel(spark, sf_dir, "address_char").select("s1_id", "target_source", "target_id", r6(F.col("score"), "score"))


def _whole_once(spark, sf_dir):
    """As `_whole`, with one S1 of all that differ in their ids alone and the lists of those that it stands for; then one
    target of such, and which one stands for each."""
    s1, targets = (x.drop("truth_key") for x in views.sides(spark, sf_dir))  # no channel or feature takes it
    (one, lists), (kept, many) = blocking.copies(s1), blocking.copies(features.name_frequency(targets))
    store = lambda x, what: lambda: tables.stored(x, what)
    # stored before anything is derived, else the filters and projections of what is derived come before copies are told apart;
    # the lexicon counts all, and so do frequencies
    lexicon, one, kept, lists = at_once(spark, store(A.learn_city_lexicon(s1), "lexicon"), store(one, "one"), store(kept, "one"), store(lists, "copies"))
    dealt = lambda x: x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    a, t = at_once(spark, *(store(features.derived(A.with_keys(dealt(x), lexicon)), "entities") for x in (one, kept)))
    of = many.select(F.col("s1_id").alias("of"), F.explode("ids").alias("target_id"))
    every = of.join(t.withColumnRenamed("id", "of"), "of").select(F.col("target_id").alias("id"), *(c for c in t.columns if c != "id"), "of")
    every = tables.stored(every, "targets")
    same = every.select(F.col("source").alias("target_source"), F.col("id").alias("target_id"), "of")
    return a, every.drop("of"), lists, t, same


@query()
def merge_candidates_mask_whole(spark, sf_dir):
    a, t, lists, _, _ = _whole_once(spark, sf_dir)
    merged = blocking.given_out(blocking.merge(blocking.channels(a, t, ranked=False)).select(*blocking.PAIR, "mask", "house_city_hit", "postal_code_hit", "name_token_sort_hit"), lists)
    return merged.select("s1_id", "target_source", "target_id", F.col("mask").cast("long").alias("mask"), "house_city_hit", "postal_code_hit", "name_token_sort_hit")


# --- similarities and features ----------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    config = pipeline.Config(channels=("exact_name", "house_city", "postal_code", "name_token_sort"), max_block=12)
    a, t = pipeline.prepare(*views.sides(spark, sf_dir), config)
    found = blocking.channels(a, t, config.channels, max_block=12)
    empty = found["exact_name"].limit(0)
    pairs = blocking.merge({**found, "name_char": empty, "address_char": empty, "translit_name": empty}).join(a.select(F.col("id").alias("s1_id"), "country"), "s1_id")
    return features.pair_table(pairs, a, t)


def _whole_pairs(spark, sf_dir):
    """Pairs of one S1 of all that differ in their ids alone, and the lists to give them out by."""
    a, t, lists, one, same = _whole_once(spark, sf_dir)
    return features.pair_table(pipeline.candidate_pairs(a, t), a, one, same), lists


_PAIR_SQL = f"{_MERGE}, pr AS (SELECT m.*, x.norm_name AS an, y.norm_name AS bn, x.norm_address AS aa, y.norm_address AS ba FROM m JOIN e x ON x.id = s1_id JOIN e y ON y.id = target_id)"
_JAC = "CASE WHEN {0} <> '' AND {1} <> '' THEN round(len(list_intersect({2}, {3})) / len(list_distinct(list_concat({2}, {3}))), 6) END"


@query(f"""WITH tok AS ({_PAIR_SQL} SELECT s1_id, target_source, target_id, an, bn, aa, ba, list_distinct({TOKENS.format('an')}) AS x, list_distinct({TOKENS.format('bn')}) AS y, {NUMBERS.format('aa')} AS p, {NUMBERS.format('ba')} AS q FROM pr)
 SELECT s1_id, target_source, target_id, {_JAC.format('an', 'bn', 'x', 'y')} AS name_jaccard, CASE WHEN an <> '' AND bn <> '' THEN CAST(an = bn AS INT) END AS name_exact,
 CASE WHEN len(p) > 0 AND len(q) > 0 THEN round(len(list_distinct(list_intersect(p, q))) / len(list_distinct(list_concat(p, q))), 6) END AS number_jaccard,
 CASE WHEN aa <> '' AND ba <> '' THEN CAST(abs(len(p) - len(q)) AS INT) END AS count_diff, CASE WHEN len(p) > 1 AND len(q) > 1 THEN CAST(p[2:] = q[2:] AS INT) END AS secondary FROM tok""")
def pair_number_features(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    return rows.select(
        "s1_id", "target_source", "target_id", r6(S.token_jaccard("a_norm_name", "b_norm_name"), "name_jaccard"), S.exact_match("a_norm_name", "b_norm_name").alias("name_exact"),
        r6(S.number_jaccard("a_numbers", "b_numbers"), "number_jaccard"), S.number_count_diff("a_numbers", "b_numbers", "a_norm_address", "b_norm_address").alias("count_diff"),
        S.secondary_match("a_numbers", "b_numbers").alias("secondary"),
    )


@query()
def pair_scores(spark, sf_dir):
    rows, lists = _whole_pairs(spark, sf_dir)
    s = S.pair_scores("a_norm_name", "b_norm_name")
    rows = rows.select("s1_id", "target_source", "target_id", s.alias("s"), r6(S.number_sequence("a_numbers", "b_numbers"), "number_sequence")).select("s1_id", "target_source", "target_id", *(r6(F.col(f"s.{n}"), n) for n in S.SCORERS), "number_sequence")
    return blocking.given_out(rows, lists)


@query()
def prefilter_keep(spark, sf_dir):
    return contents.kept(*_whole_once(spark, sf_dir))


@query()
def pair_features(spark, sf_dir):
    a, t, lists, one, same = _whole_once(spark, sf_dir)
    pairs = contents.Compared(contents.candidates(a, t, one, same), a, one, same, True)
    return contents.table(pairs.described(tables.stored(pairs.prefiltered(), "kept")), same, lists)


@query(f"{E_} SELECT id, CASE WHEN norm_name <> '' THEN count(*) OVER (PARTITION BY source, country, norm_name) END AS name_frequency, CASE WHEN norm_name <> '' THEN round(1 / count(*) OVER (PARTITION BY source, country, norm_name), 6) END AS rarity FROM e")
def name_frequency(spark, sf_dir):
    return features.name_frequency(views.entities(spark, sf_dir)).select("id", "name_frequency", r6(features.rarity("name_frequency"), "rarity"))


# --- context and decisions --------------------------------------------------------------------------------------------

_CTX = f"""{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_source, target_id) AS rk, count(*) OVER (PARTITION BY s1_id) AS n FROM s),
 c AS (SELECT *, max(CASE WHEN rk = 1 THEN score END) OVER p AS top, coalesce(max(CASE WHEN rk = 2 THEN score END) OVER p, 0) AS second, sum(CASE WHEN score >= 0.99 THEN 1 ELSE 0 END) OVER p AS high,
  sum(CASE WHEN score >= 0.99 AND target_source = 2 THEN 1 ELSE 0 END) OVER p AS h2, sum(CASE WHEN score >= 0.99 AND target_source = 3 THEN 1 ELSE 0 END) OVER p AS h3, sum(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END) OVER p AS c90,
  max(CASE WHEN rk = 1 THEN target_source END) OVER p AS ts, max(CASE WHEN rk = 1 THEN name_ratio END) OVER p AS tn, max(CASE WHEN rk = 1 THEN ln(1 + target_name_frequency) END) OVER p AS tf, max(CASE WHEN rk = 1 THEN address_token_set_ratio END) OVER p AS ta
  FROM r WINDOW p AS (PARTITION BY s1_id))"""


@query(f"""{_CTX} SELECT s1_id, target_id, n AS s1_candidate_count, rk AS rank, round(1 - (rk - 1) / n, 6) AS pct, round(top, 6) AS top, round(second, 6) AS second, round(top - second, 6) AS margin, round(score - top, 6) AS minus_top, CAST(c90 AS BIGINT) AS n_ge_90,
 CAST(h2 AS BIGINT) AS h2, CAST(h3 AS BIGINT) AS h3, CAST(CASE WHEN target_source = 2 THEN h3 ELSE h2 END AS BIGINT) AS other_source, CAST(high - CASE WHEN score >= 0.99 THEN 1 ELSE 0 END AS BIGINT) AS other_high, CAST(ts = 3 AS INT) AS top_is_s3, round(name_ratio - tn, 6) AS dn, round(ln(1 + target_name_frequency) - tf, 6) AS df, round(address_token_set_ratio - ta, 6) AS da FROM c""")
def context_features(spark, sf_dir):
    c = context.context_features(views.scored(spark, sf_dir))
    return c.select(
        "s1_id", "target_id", "s1_candidate_count", F.col("candidate_score_rank").cast("long").alias("rank"), r6(F.col("candidate_score_percentile"), "pct"), r6(F.col("s1_top_score"), "top"), r6(F.col("s1_second_score"), "second"),
        r6(F.col("s1_score_margin"), "margin"), r6(F.col("candidate_score_minus_top"), "minus_top"), F.col("`s1_count_ge_0.9`").alias("n_ge_90"), F.col("s1_high_s2_count").alias("h2"), F.col("s1_high_s3_count").alias("h3"),
        F.col("other_source_high_count").alias("other_source"), F.col("other_candidates_high_count").alias("other_high"), "top_is_s3", r6(F.col("diff_top_name_ratio"), "dn"), r6(F.col("diff_top_target_name_frequency"), "df"), r6(F.col("diff_top_address_token_set_ratio"), "da"),
    )


_CONTRA = "(coalesce(house_number_match = 0, false) OR coalesce(address_number_set_jaccard < 1, false) OR target_address_missing = 1)"
_LONE = "sum(CASE WHEN score >= 0.997 THEN 1 ELSE 0 END) OVER (PARTITION BY s1_id) = 1"


@query(f"{EV} SELECT target_id, score >= 0.997 AS t, score >= 0.997 AND NOT ({_LONE} AND score < 0.9985) AS stricter, score >= 0.997 AND NOT ({_LONE} AND {_CONTRA} AND score < 0.9985) AS only, {_CONTRA} AS against FROM s")
def decision_rules(spark, sf_dir):
    return views.scored(spark, sf_dir).select("target_id", context.decide_threshold(0.997).alias("t"), context.decide_single_stricter(0.997, 0.9985).alias("stricter"), context.decide_single_stricter(0.997, 0.9985, True).alias("only"), context.contradiction().alias("against"))


@query(f"{EV} SELECT target_id, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT target_id, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM s)")
def clipped_logit(spark, sf_dir):
    return views.scored(spark, sf_dir).select("target_id", r6(context.logit(F.col("score")), "logit"))


# --- metrics ----------------------------------------------------------------------------------------------------------

_COUNTS = f"""{E_}, {TRUTH}, pred AS ({_equal_sql('norm_name', None)}), p AS (SELECT s1_id, count(*) AS np FROM pred GROUP BY ALL), tr AS (SELECT s1_id, count(*) AS nt FROM truth GROUP BY ALL),
 hh AS (SELECT s1_id, count(*) AS nh FROM pred JOIN truth USING (s1_id, target_source, target_id) GROUP BY ALL),
 k AS (SELECT id AS s1_id, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(nh, 0) AS nh FROM a LEFT JOIN p ON p.s1_id = id LEFT JOIN tr ON tr.s1_id = id LEFT JOIN hh ON hh.s1_id = id)"""
_F = "CASE WHEN {0} = 0 AND {1} = 0 THEN 1.0e0 WHEN {2} = 0 THEN 0.0e0 ELSE 1.25e0 * ({2} / {0}) * ({2} / {1}) / (0.25e0 * ({2} / {0}) + {2} / {1}) END"
_METRICS = f"""round(avg({{f}}), 6) AS macro_f05, round(avg(CASE WHEN np > 0 THEN nh / np END), 6) AS macro_precision, round(avg(CASE WHEN nt > 0 THEN nh / nt END), 6) AS macro_recall, round(sum(nh) / sum(np), 6) AS micro_precision, round(sum(nh) / sum(nt), 6) AS micro_recall,
 count(*) FILTER (np > 0) AS s1_with_prediction, CAST(sum(np - nh) AS BIGINT) AS fp, CAST(sum(nt - nh) AS BIGINT) AS fn"""


def _counts(spark, sf_dir):
    a, t = views.sides(spark, sf_dir)
    return metrics.by_s1(a.select(F.col("id").alias("s1_id")), blocking.exact_name(a, t), views.truth(spark, sf_dir))


@query(f"{_COUNTS} SELECT round(avg({_F.format('np', 'nt', 'nh')}), 6) AS macro_f05 FROM k")
def macro_f05(spark, sf_dir):
    return metrics.macro_f05(_counts(spark, sf_dir)).select(r6(F.col("macro_f05"), "macro_f05"))


def _shown(rows, *keys):
    return rows.select(*keys, *(r6(F.col(c), c) for c in ("macro_f05", "macro_precision", "macro_recall", "micro_precision", "micro_recall")), "s1_with_prediction", F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"))


@query(f"{_COUNTS} SELECT {_METRICS.format(f=_F.format('np', 'nt', 'nh'))} FROM k")
def s1_metrics(spark, sf_dir):
    return _shown(metrics.s1_metrics(_counts(spark, sf_dir)))


_GRID = metrics.THRESHOLDS
_SWEEP = f"""{EV}, g AS (SELECT unnest([{', '.join(f'{x}e0' for x in _GRID)}]) AS threshold), nt AS (SELECT s1_id, sum(label) AS nt FROM s GROUP BY ALL),
 k AS (SELECT threshold, nt.s1_id, nt, coalesce(np, 0) AS np, coalesce(nh, 0) AS nh FROM g CROSS JOIN nt LEFT JOIN (SELECT threshold, s1_id, count(*) AS np, sum(label) AS nh FROM s JOIN g ON score >= threshold GROUP BY ALL) x USING (threshold, s1_id))"""


def _sweep(spark, sf_dir):
    rows = views.scored(spark, sf_dir)
    return metrics.threshold_sweep(rows, rows.groupBy("s1_id").agg(F.sum("label").alias("n_true")), _GRID)


@query(f"{_SWEEP} SELECT threshold, {_METRICS.format(f=_F.format('np', 'nt', 'nh'))} FROM k GROUP BY threshold")
def threshold_sweep(spark, sf_dir):
    return _shown(_sweep(spark, sf_dir), "threshold")


@query(f"{_SWEEP} SELECT threshold, round(f, 6) AS macro_f05 FROM (SELECT threshold, avg({_F.format('np', 'nt', 'nh')}) AS f FROM k GROUP BY threshold) ORDER BY f DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(_sweep(spark, sf_dir)).select("threshold", r6(F.col("macro_f05"), "macro_f05"))


@query(f"""{EV}, r AS (SELECT s1_id, label, CASE WHEN score >= 0.995 THEN 1 ELSE 0 END AS p0, CASE WHEN event_type = 'click' THEN label ELSE CASE WHEN score >= 0.995 THEN 1 ELSE 0 END END AS p1 FROM s),
 k AS (SELECT s1_id, sum(label) AS nt, sum(p0) AS n0, sum(p0 * label) AS h0, sum(p1) AS n1, sum(p1 * label) AS h1 FROM r GROUP BY ALL) SELECT round(avg({_F.format('n1', 'nt', 'h1')}) - avg({_F.format('n0', 'nt', 'h0')}), 6) AS gain FROM k""")
def oracle_gain(spark, sf_dir):
    rows = views.scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.995).cast("int"))
    n = rows.groupBy("s1_id").agg(F.sum("label").alias("n_true"))
    return metrics.oracle_gain(rows, n, F.col("event_type") == "click").select(r6(F.col("gain"), "gain"))


_CHANNELS = {n: blocking.BITS[n] for n in _EQUI}


@query(f"{_MERGE}, {TRUTH}, x AS (SELECT coalesce(mask, 0) AS mask FROM truth LEFT JOIN m USING (s1_id, target_source, target_id)), cn AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {b})" for n, b in {**_CHANNELS, 'union': sum(_CHANNELS.values())}.items())}) v(channel, bit)) SELECT channel, count(*) AS true_pairs, count(*) FILTER (mask & bit <> 0) AS found, round(count(*) FILTER (mask & bit <> 0) / count(*), 6) AS recall FROM x CROSS JOIN cn GROUP BY channel")
def channel_recall(spark, sf_dir):
    return metrics.channel_recall(views.truth(spark, sf_dir), _merged(spark, sf_dir), _CHANNELS).withColumn("recall", F.round("recall", 6))


@query(f"{_MERGE}, n AS (SELECT a.id, count(m.s1_id) AS n FROM a LEFT JOIN m ON m.s1_id = a.id GROUP BY a.id) SELECT CAST(sum(n) AS BIGINT) AS pairs, round(avg(n), 6) AS avg_pairs, quantile_cont(n, 0.5) AS median_pairs, max(n) AS max_pairs, round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 6) AS coverage FROM n")
def candidate_counts(spark, sf_dir):
    s1 = views.sides(spark, sf_dir)[0].select(F.col("id").alias("s1_id"))
    c = metrics.candidate_counts(s1, _merged(spark, sf_dir))
    return c.select(F.col("pairs").cast("long").alias("pairs"), r6(F.col("avg_pairs"), "avg_pairs"), "median_pairs", "max_pairs", r6(F.col("coverage"), "coverage"))


@query(f"{_MERGE}, {TRUTH}, x AS (SELECT truth.country, coalesce(mask, 0) AS mask FROM truth LEFT JOIN m USING (s1_id, target_source, target_id)) SELECT country, count(*) AS true_pairs, count(*) FILTER (mask & 1 <> 0) AS found, count(*) FILTER (mask & 1 = 0 AND mask & 8 <> 0) AS gained, round(count(*) FILTER (mask & 1 <> 0) / count(*), 6) AS recall, round(count(*) FILTER (mask & 9 <> 0) / count(*), 6) AS recall_after FROM x GROUP BY country")
def incremental_recall(spark, sf_dir):
    m = _merged(spark, sf_dir)
    has = lambda n: m.where(F.col("mask").bitwiseAND(blocking.BITS[n]) != 0)
    out = diagnostics.incremental_recall(views.truth(spark, sf_dir), has("exact_name"), has("house_city"))
    return out.withColumn("recall", F.round("recall", 6)).withColumn("recall_after", F.round("recall_after", 6))


@query(f"{_MERGE}, {TRUTH} SELECT CASE WHEN mask & 1 <> 0 AND mask & 8 <> 0 THEN 'D' WHEN mask & 1 <> 0 THEN 'A' WHEN mask & 8 <> 0 THEN 'B' ELSE 'C' END AS class, count(*) AS n FROM truth LEFT JOIN m USING (s1_id, target_source, target_id) GROUP BY ALL")
def overlap_classes(spark, sf_dir):
    return diagnostics.overlap_classes(views.truth(spark, sf_dir), _merged(spark, sf_dir), "exact_name", "house_city")


@query("SELECT event_type, lang, count(*) AS n, grouping(event_type, lang) AS level FROM (SELECT event_type, CASE user_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS lang FROM events) GROUP BY CUBE (event_type, lang)")
def crosstab_margins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 3 == 0, "x").when(F.col("user_id") % 3 == 1, "y").otherwise("z").alias("lang"))
    return metrics.crosstab(rows, "event_type", "lang")


@query("SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.99) AS q99 FROM events GROUP BY event_type")
def quantiles(spark, sf_dir):
    return metrics.quantiles(table(spark, sf_dir, "events"), "value", [0.25, 0.5, 0.99], ("event_type",))


_COLS = ["score", "address_token_set_ratio", "name_ratio", "address_number_set_jaccard"]


@query(f"{EV} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, label, round(avg({c}), 6) AS mean, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS missing_rate FROM s GROUP BY label" for c in _COLS))
def feature_class_means(spark, sf_dir):
    return metrics.class_means(views.scored(spark, sf_dir), _COLS).withColumn("mean", F.round("mean", 6)).withColumn("missing_rate", F.round("missing_rate", 6))


@query(f"{EV} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM s" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def corr_matrix(spark, sf_dir):
    return metrics.correlations(views.scored(spark, sf_dir), _COLS).withColumn("r", F.round("r", 6))


@query(f"{EV}, c AS (SELECT target_source, score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY target_source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT target_source, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b GROUP BY target_source")
def rank_auc(spark, sf_dir):
    return metrics.rank_auc(views.scored(spark, sf_dir), by=("target_source",)).withColumn("auc", F.round("auc", 6))


@query(f"{_CTX} SELECT s1_id, count(*) AS n, round(max(top), 6) AS top, round(max(second), 6) AS second, round(max(top - second), 6) AS margin, count(*) FILTER (score >= 0.995) AS n_predicted FROM c GROUP BY s1_id")
def score_summary(spark, sf_dir):
    rows = metrics.score_summary(views.scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.995).cast("int")))
    return rows.select("s1_id", "n", *(r6(F.col(c), c) for c in ("top", "second", "margin")), "n_predicted")


@query(f"{EV} SELECT CASE WHEN address_token_set_ratio IS NULL THEN 'missing' WHEN address_token_set_ratio < 0.3 THEN '0-0.3' WHEN address_token_set_ratio < 0.7 THEN '0.3-0.7' ELSE '0.7-1.01' END AS bucket, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM s GROUP BY ALL")
def bucket_breakdown(spark, sf_dir):
    rows = views.scored(spark, sf_dir).withColumn("bucket", metrics.bucket("address_token_set_ratio", [0, 0.3, 0.7, 1.01]))
    return metrics.value_share(rows, "bucket").select("bucket", "n", r6(100 * F.col("share"), "pct"))


_BEST = "greatest(name_ratio, translit_name_ratio)"
_NEAR, _CONFLICT, _WEAK = "address_token_set_ratio >= 0.9", "address_number_set_jaccard < 1", "NOT coalesce(address_token_set_ratio >= 0.75, false)"
# The categories' names, limits and order.
_FP_SQL = f"""CASE WHEN cross_script AND translit_skeleton_ratio >= 0.7 AND name_ratio < 0.5 THEN 'transliteration collision (cross-script)'
 WHEN NOT cross_script AND translit_skeleton_ratio >= 0.8 AND {_BEST} < 0.7 THEN 'skeleton collision (Latin, spelling differs)'
 WHEN {_BEST} >= 0.9 AND {_NEAR} AND NOT coalesce({_CONFLICT}, false) THEN 'near-duplicate record: name & address ≥0.9, numbers agree'
 WHEN {_NEAR} AND {_CONFLICT} THEN 'address near-duplicate, numbers conflict'
 WHEN {_BEST} >= 0.9 AND {_WEAK} AND target_name_frequency > 5 THEN 'same/near name, weak or missing address — common name (freq > 5)'
 WHEN {_BEST} >= 0.9 AND {_WEAK} THEN 'same/near name, weak or missing address — rare name (freq ≤ 5)'
 WHEN {_NEAR} AND {_BEST} < 0.9 THEN 'same/near address, different name'
 WHEN house_city_match = 1 AND {_BEST} < 0.9 AND address_token_set_ratio < 0.9 THEN 'house+city collision, weak name & address'
 WHEN {_BEST} >= 0.7 AND address_token_set_ratio >= 0.75 THEN 'partial evidence on both name and address' ELSE 'other' END"""


@query(f"{EV}, c AS (SELECT {_FP_SQL} AS category FROM s) SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY ALL")
def primary_category(spark, sf_dir):
    return diagnostics.categories(views.scored(spark, sf_dir)).withColumn("share", F.round("share", 6))


def _decided(spark, sf_dir):
    rows = views.scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.995).cast("int"))
    return rows, rows.groupBy("s1_id").agg(F.sum("label").alias("n_true"))


_DECIDED = f"""{EV}, d AS (SELECT *, CASE WHEN score >= 0.995 THEN 1 ELSE 0 END AS p FROM s), base AS (SELECT s1_id, sum(label) AS nt, sum(p) AS np, sum(p * label) AS nh FROM d GROUP BY s1_id),
 w AS (SELECT d.*, nt, max(p * label) OVER (PARTITION BY s1_id) AS any_hit, max(p) OVER (PARTITION BY s1_id) AS any_p, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_source, target_id) AS rk FROM d JOIN base USING (s1_id))"""


def _report_sql(parts: str, which: str) -> str:
    """Each part's rows decided as labelled, and the mean F0.5 over all S1s then, less the mean as it is."""
    return f"""{_DECIDED}, x AS (SELECT s1_id, label, p, unnest({parts}) AS part FROM w WHERE {which}), y AS (SELECT * FROM x WHERE part IS NOT NULL),
 fixed AS (SELECT part, s1_id, sum(label - p) AS dp, sum(label - label * p) AS dh FROM y GROUP BY ALL), names AS (SELECT part, count(*) AS n FROM y GROUP BY part),
 k AS (SELECT names.part, nt, np, nh, np + coalesce(dp, 0) AS np2, nh + coalesce(dh, 0) AS nh2 FROM names CROSS JOIN base LEFT JOIN fixed ON fixed.part = names.part AND fixed.s1_id = base.s1_id),
 g AS (SELECT part, avg({_F.format('np2', 'nt', 'nh2')}) - avg({_F.format('np', 'nt', 'nh')}) AS gain FROM k GROUP BY part)
 SELECT split_part(part, '|', 1) AS kind, substr(part, instr(part, '|') + 1) AS part, n, round(n / (SELECT count(*) FROM w WHERE {which}), 6) AS pct, round(gain, 6) AS oracle_gain FROM names JOIN g USING (part)"""


def _rounded(report):
    return report.withColumn("pct", F.round("pct", 6)).withColumn("oracle_gain", F.round("oracle_gain", 6))


# The flags', categories' and contexts' names.
_FP_PARTS = f"""[CASE WHEN name_exact = 1 THEN 'flag|identical name' END, CASE WHEN name_exact = 0 AND {_BEST} >= 0.9 THEN 'flag|near-identical name (≥0.90, not identical)' END,
 CASE WHEN address_ratio = 1 THEN 'flag|identical address' END, CASE WHEN address_ratio <> 1 AND address_ratio >= 0.9 THEN 'flag|near-identical address (≥0.90, not identical)' END,
 CASE WHEN house_city_match = 1 THEN 'flag|house+city agree' END, CASE WHEN {_CONFLICT} THEN 'flag|address numeric mismatch (number-set Jaccard < 1)' END,
 CASE WHEN name_exact = 1 AND {_CONFLICT} THEN 'flag|identical name + numeric mismatch' END, CASE WHEN name_exact = 1 AND address_ratio = 1 THEN 'flag|identical name AND identical address' END,
 CASE WHEN city_match = 0 THEN 'flag|different city (city_match = 0)' END, CASE WHEN house_city_hit = 1 AND n_channels = 1 THEN 'flag|house_city-only candidate' END,
 'category|' || CASE WHEN name_exact = 1 AND address_ratio = 1 THEN 'identical name + identical address' WHEN name_exact = 1 AND {_CONFLICT} THEN 'identical name + numeric mismatch'
  WHEN {_BEST} >= 0.9 AND {_CONFLICT} THEN 'near-identical name + numeric mismatch' WHEN {_BEST} >= 0.9 THEN 'identical/near name, numbers agree' WHEN city_match = 0 THEN 'different city'
  WHEN house_city_hit = 1 AND n_channels = 1 THEN 'house_city-only' ELSE 'other' END,
 'context|' || CASE WHEN nt = 0 THEN 'S1 has no true match (singleton)' WHEN any_hit = 1 THEN 'extra prediction next to a correct one' ELSE 'S1 has matches, none predicted correctly' END]"""


@query(_report_sql(_FP_PARTS, "p = 1 AND label = 0"))
def false_positive_report(spark, sf_dir):
    return _rounded(errors.false_positive_report(*_decided(spark, sf_dir)))


def _bucket_sql(kind: str, x: str, edges: list, labels: list[str]) -> str:
    whens = " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN '{kind}|{n}'" for lo, hi, n in zip(edges, edges[1:], labels, strict=False))
    return f"CASE WHEN {x} IS NULL THEN '{kind}|missing' {whens} END"


_SIM = ([0, 0.5, 0.75, 0.9, 1.0, 1.01], ["<0.50", "0.50-0.75", "0.75-0.90", "0.90-<1", "1.0"])
_FN_PARTS = "[" + ", ".join([
    _bucket_sql("score", "score", [0, 0.1, 0.5, 0.9, 0.99, 1.01], ["<0.10", "0.10-0.50", "0.50-0.90", "0.90-0.99", "0.99-<thr"]),
    _bucket_sql("best name ratio (orig/translit)", _BEST, *_SIM), _bucket_sql("address ratio", "address_ratio", *_SIM), _bucket_sql("address number-set Jaccard", "address_number_set_jaccard", *_SIM),
    _bucket_sql("name_char_rank", "name_char_rank", [0, 1, 5, 20, 50, 100], ["0", "1-4", "5-19", "20-49", "50-99"]), _bucket_sql("address_char_rank", "address_char_rank", [0, 1, 5, 10, 25], ["0", "1-4", "5-9", "10-24"]),
    "'n_channels|' || n_channels", "'missing name/address|' || CASE WHEN target_address_missing = 1 THEN 'target address missing' WHEN target_name_missing = 1 THEN 'target name missing' WHEN s1_address_missing = 1 THEN 'S1 address missing' ELSE 'none missing' END",
    *(f"'{x}|' || coalesce(CAST({x} AS VARCHAR), 'missing')" for x in ("house_number_match", "city_match", "house_city_match")),
    "'context|' || CASE WHEN any_p = 1 THEN 'S1 has other predictions' ELSE 'S1 has no predictions' END", _bucket_sql("rank in S1", "rk", [1, 2, 4, 11, 1000000000], ["1 (top of S1)", "2-3", "4-10", ">10"]),
]) + "]"


@query(_report_sql(_FN_PARTS, "p = 0 AND label = 1"))
def false_negative_report(spark, sf_dir):
    return _rounded(errors.false_negative_report(*_decided(spark, sf_dir)))


_RELATION = """CASE WHEN s1_script = 'latin' AND target_script = 'latin' THEN 'both Latin' WHEN s1_script = 'non-latin' AND target_script = 'non-latin' AND NOT other_scripts THEN 'same non-Latin script'
 WHEN s1_script = 'latin' AND target_script = 'non-latin' THEN 'Latin S1 -> non-Latin target' WHEN s1_script = 'non-latin' AND target_script = 'latin' THEN 'non-Latin S1 -> Latin target'
 WHEN s1_script = 'mixed' OR target_script = 'mixed' THEN 'mixed-script name' ELSE 'other (different non-Latin / no letters)' END"""


@query(f"""{_DECIDED}, low AS (SELECT *, {_RELATION} AS script_relation FROM d WHERE label = 1 AND p = 0 AND name_ratio < 0.5)
 SELECT script_relation, count(*) AS n, count(*) FILTER ({_BEST} < 0.5) AS best_below, round(avg(name_ratio), 6) AS mean_name, round(avg(translit_name_ratio), 6) AS mean_translit,
 round(avg(CASE WHEN translit_name_ratio - name_ratio > 0.05 THEN 1 ELSE 0 END), 6) AS helps, round(avg(CASE WHEN translit_name_ratio - name_ratio < -0.05 THEN 1 ELSE 0 END), 6) AS worse,
 round(avg(address_token_set_ratio), 6) AS mean_address, round(avg(target_address_missing), 6) AS address_missing, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM low GROUP BY script_relation""")
def name_miss_report(spark, sf_dir):
    rows, _ = _decided(spark, sf_dir)
    got = errors.name_miss_report(rows.withColumn("script_relation", errors.script_relation(F.col("s1_script"), F.col("target_script"), F.col("other_scripts"))))
    return got.select("script_relation", F.col("count").alias("n"), F.col("best_below_0_5").alias("best_below"), *(r6(F.col(a), b) for a, b in (
        ("mean_name_ratio", "mean_name"), ("mean_translit_ratio", "mean_translit"), ("translit_helps", "helps"), ("translit_worse", "worse"), ("mean_address_token_set", "mean_address"), ("target_address_missing", "address_missing"), ("pct", "pct"))))


@query(f"""{_DECIDED} SELECT CASE WHEN cross_script THEN 'cross-script' ELSE 'same script' END AS scripts, CASE WHEN translit_name_ratio < 0.6 THEN '0.5-0.6' WHEN translit_name_ratio < 0.7 THEN '0.6-0.7' WHEN translit_name_ratio < 0.8 THEN '0.7-0.8' ELSE '>=0.8' END AS translit_bucket,
 count(*) AS candidates, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(p) AS BIGINT) AS currently_predicted, count(*) FILTER (label = 1 AND p = 0) AS missed_positives, count(*) FILTER (label = 0 AND p = 1) AS false_positives, round(avg(label), 6) AS positive_rate
 FROM d WHERE name_ratio < 0.5 AND translit_name_ratio >= 0.5 GROUP BY ALL""")
def script_separability(spark, sf_dir):
    return errors.separability(_decided(spark, sf_dir)[0]).withColumn("positive_rate", F.round("positive_rate", 6))


@query("""SELECT doc_id, CASE WHEN ts <= 0 THEN 'not reachable (no shared indexed n-gram)' WHEN fc >= 0.5 AND ts < 0.5 * fc THEN 'index pruning (full cosine high, indexed score low)' WHEN nr >= 0.75 THEN 'crowded out (name ratio ≥ 0.75)'
 WHEN nr < 0.5 THEN 'dissimilar name (name ratio < 0.50)' ELSE 'partly similar (0.50 ≤ ratio < 0.75)' END AS reason FROM (SELECT doc_id, doc_id % 11 / 10.0e0 AS ts, doc_id % 7 / 6.0e0 AS fc, doc_id % 13 / 12.0e0 AS nr FROM documents)""")
def miss_reasons(spark, sf_dir):
    part = lambda m, name: (F.col("doc_id") % m / float(m - 1)).alias(name)
    rows = table(spark, sf_dir, "documents").select("doc_id", part(11, "true_score"), part(7, "full_cosine"), part(13, "name_ratio"))
    return rows.select("doc_id", errors.miss_reason().alias("reason"))


_UNLIKE = """SELECT n_nationkey AS k, lower(concat(n_name, ' ', r_name)) AS a, CASE n_nationkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '12 34 5' WHEN 3 THEN 'भारत टेक' WHEN 4 THEN concat(lower(substr(n_name, 1, 1)), lower(substr(r_name, 1, 1)))
 WHEN 5 THEN 'abc' ELSE 'entirely other' END AS b FROM nation JOIN region ON n_regionkey = r_regionkey"""
_INITIALS = "length(replace({0}, ' ', '')) >= 2 AND contains({1}, ' ') AND replace({0}, ' ', '') = array_to_string(list_transform(string_split({1}, ' '), lambda x: x[1]), '')"


@query(rf"""SELECT k, CASE WHEN b IS NULL THEN 'unjoined_target' WHEN b = '' THEN 'missing_name' WHEN length(regexp_replace(b, '[^\p{{L}}]', '', 'g')) < greatest(2, length(replace(b, ' ', '')) // 2) THEN 'noisy_corrupted' WHEN regexp_matches(b, '[ऀ-ॿ]') THEN 'different_script'
 WHEN {_INITIALS.format('b', 'a')} OR {_INITIALS.format('a', 'b')} THEN 'abbreviation' WHEN length(a) <= 3 OR length(b) <= 3 THEN 'other' ELSE 'translation_or_different' END AS category FROM ({_UNLIKE})""")
def unlike_names(spark, sf_dir):
    rows = spark.sql(_UNLIKE.replace("FROM nation JOIN region", "FROM {n} JOIN {r}"), n=table(spark, sf_dir, "nation"), r=table(spark, sf_dir, "region"))
    rows = rows.withColumns({"as": T.dominant_script("a"), "bs": T.dominant_script("b"), "al": T.transliterate("a"), "bl": T.transliterate("b")})
    return rows.select("k", errors.unlike_category("a", "a", "al", "as", "b", "b", "bl", "bs").alias("category"))


@query(f"""{_DECIDED}, e AS (SELECT d.*, nt, sum(p) OVER (PARTITION BY s1_id) AS nb FROM d JOIN base USING (s1_id)), x AS (SELECT label, p, unnest([CASE WHEN target_script = 'latin' THEN 'Latin -> Latin' END, CASE WHEN target_script = 'non-latin' THEN 'Latin -> Indian-script' END,
 CASE WHEN target_script <> 'latin' AND address_token_set_ratio >= 0.75 THEN 'cross-script & address token-set >= 0.75' END, CASE WHEN target_name_frequency = 1 THEN 'rare target name (frequency 1)' END, CASE WHEN target_address_missing = 1 THEN 'target address missing' END,
 CASE WHEN {_CONFLICT} THEN 'conflicting address numbers' END, CASE WHEN nb = 1 THEN 'single-prediction S1 (base)' END, CASE WHEN nb >= 2 THEN 'multi-prediction S1 (base)' END, CASE WHEN nt = 0 THEN 'S1 with no true match' END]) AS segment FROM e)
 SELECT segment, CAST(sum(label * p) AS BIGINT) AS tp, CAST(sum((1 - label) * p) AS BIGINT) AS fp, CAST(sum(label * (1 - p)) AS BIGINT) AS fn, round(sum(label * p) / nullif(sum(p), 0), 6) AS precision, round(sum(label * p) / nullif(sum(label), 0), 6) AS recall FROM x WHERE segment IS NOT NULL GROUP BY segment""")
def decision_segments(spark, sf_dir):
    from pyspark.sql import Window

    rows, n = _decided(spark, sf_dir)
    rows = rows.join(n, "s1_id").withColumn("n_base", F.sum("predicted").over(Window.partitionBy("s1_id")))
    out = diagnostics.segments(rows, errors.decision_segments())
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(f"""{EV} SELECT * FROM (SELECT 'true, low score' AS kind, s1_id, target_source, target_id, round(score, 6) AS score FROM s WHERE label = 1 AND score < 0.1 ORDER BY s.score, s1_id, target_source, target_id LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'false, high score', s1_id, target_source, target_id, round(score, 6) FROM s WHERE label = 0 AND score >= 0.991 ORDER BY s.score DESC, s1_id, target_source, target_id LIMIT 10)""")
def example_pairs(spark, sf_dir):
    return errors.examples(views.scored(spark, sf_dir), 0.991).withColumn("score", F.round("score", 6))


@query(f"{EV} SELECT s1_id, target_source, target_id, round(score, 6) AS score, round(name_ratio, 6) AS name_ratio FROM s")
def aligned_scores(spark, sf_dir):
    keys = ["s1_id", "target_source", "target_id"]
    rows = views.scored(spark, sf_dir)
    return errors.aligned(rows.select(*keys, r6(F.col("score"), "score")), rows.select(*keys, r6(F.col("name_ratio"), "name_ratio")))


@query(f"{EV} SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY ALL")
def value_share(spark, sf_dir):
    return metrics.value_share(views.scored(spark, sf_dir), "event_type").withColumn("share", F.round("share", 6))


# --- sorts, sets, splits ----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def topk_global(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(f"{EV} SELECT s1_id, target_id FROM s QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) <= 3")
def topk_per_group(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id")
    return views.scored(spark, sf_dir).withColumn("r", F.row_number().over(by)).where("r <= 3").select("s1_id", "target_id")


def _set(op: str) -> str:
    return f"{_KEYS}, u AS ({_equal_sql('norm_name', None)}), v AS ({_equal_sql('postal', 12, 'kk')}) SELECT * FROM u {op} SELECT * FROM v"


def _two(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    a, t = rows.where("source = 1"), rows.where("source > 1")
    keys = ["s1_id", "target_source", "target_id"]
    return blocking.exact_name(a, t).select(*keys), blocking.equal_key(a, t, "postal", 12).select(*keys)


@query(_set("UNION"))
def set_union(spark, sf_dir):
    u, v = _two(spark, sf_dir)
    return u.union(v).distinct()


@query(_set("INTERSECT"))
def set_intersect(spark, sf_dir):
    u, v = _two(spark, sf_dir)
    return u.intersect(v)


@query(_set("EXCEPT"))
def set_except(spark, sf_dir):
    u, v = _two(spark, sf_dir)
    return u.subtract(v)


_H = "CAST('0x' || substr(md5('42|' || {0}), 1, 8) AS BIGINT)"


@query(f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_H.format('o_orderkey')}, o_orderkey) <= CAST(floor(count(*) OVER () * 0.2) AS BIGINT) THEN 1 ELSE 0 END AS split FROM orders")
def split_md5(spark, sf_dir):
    return splits.split(table(spark, sf_dir, "orders").select("o_orderkey"), 0.2, 42, "o_orderkey")


@query(f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_H.format('o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def folds_md5(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "orders").select("o_orderkey"), 5, 42, "o_orderkey")


# Candidate pairs with faults put in by id: repeated and unknown pairs, another country's, and wrong masks.
_FAULTY = """SELECT s1_id, target_source, target_id, CASE WHEN s1_id % 5 = 0 THEN 0 WHEN s1_id % 7 = 0 THEN mask | 32 WHEN s1_id % 11 = 0 THEN mask & ~1 WHEN s1_id % 13 = 0 THEN mask | 1 WHEN s1_id % 17 = 0 THEN mask | 8
  ELSE mask END AS mask FROM m UNION ALL SELECT s1_id, target_source, target_id, mask FROM m WHERE s1_id % 3 = 0 UNION ALL SELECT s1_id, target_source, target_id + 100000000, mask FROM m WHERE s1_id % 19 = 0
 UNION ALL SELECT s1_id, 2, 0 + (SELECT min(id) FROM e WHERE source = 2 AND country = 'us'), 4 FROM m WHERE s1_id % 23 = 0"""


@query(f"""{_MERGE}, f AS ({_FAULTY}), j AS (SELECT f.*, x.country AS ca, y.country AS cb, x.norm_name AS na, y.norm_name AS nb, x.house_city AS ha, y.house_city AS hb,
  row_number() OVER (PARTITION BY s1_id, target_source, target_id ORDER BY mask) AS copies FROM f LEFT JOIN kk x ON x.source = 1 AND x.id = f.s1_id LEFT JOIN kk y ON y.source = f.target_source AND y.id = f.target_id),
 exact AS ({_equal_sql('norm_name', None, 'kk')}), houses AS ({_equal_sql('house_city', 12, 'kk')})
 SELECT 'unknown entity' AS rule, count(*) FILTER (ca IS NULL OR cb IS NULL) AS n_bad FROM j UNION ALL SELECT 'other country', count(*) FILTER (ca <> cb) FROM j UNION ALL SELECT 'exact name differs', count(*) FILTER (mask & 1 <> 0 AND (na <> nb OR na = '')) FROM j
 UNION ALL SELECT 'house and city differ', count(*) FILTER (mask & 8 <> 0 AND (ha <> hb OR ha = '')) FROM j UNION ALL SELECT 'augmented core pair', count(*) FILTER (mask & 15 <> 0 AND mask & 112 <> 0) FROM j
 UNION ALL SELECT 'no channel', count(*) FILTER (mask = 0) FROM j UNION ALL SELECT 'unknown channel', 0 UNION ALL SELECT 'duplicate pair', count(*) FILTER (copies > 1) FROM j
 UNION ALL SELECT 'exact name missed', count(*) FROM exact WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.s1_id = exact.s1_id AND f.target_source = exact.target_source AND f.target_id = exact.target_id AND f.mask & 1 <> 0)
 UNION ALL SELECT 'house and city missed', count(*) FROM houses WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.s1_id = houses.s1_id AND f.target_source = houses.target_source AND f.target_id = houses.target_id AND f.mask & 8 <> 0)""")
def validate_candidates(spark, sf_dir):
    rows = tables.stored(_keyed(spark, sf_dir), "entities")
    merged = tables.stored(_merged(spark, sf_dir), "merged")
    faulty = spark.sql(_FAULTY.replace("FROM m", "FROM {m}").replace("FROM e", "FROM {e}"), m=merged, e=rows)
    ranks = {f"{n}_rank": F.lit(None).cast("int") for n in diagnostics.RANKED} | {x: F.lit(None).cast("double") for x in diagnostics.RANKED.values() if x}
    out = diagnostics.validate(faulty.withColumns(ranks), rows.where("source = 1"), rows.where("source > 1"), max_block=12)
    return out.where(~F.col("rule").contains(":"))  # the ranked channels' rules are tested on ranks


# --- models -----------------------------------------------------------------------------------------------------------

_SMALL = models.TreeParams(rounds=8, depth=3)
_INPUTS = ["address_token_set_ratio", "name_ratio", "address_number_set_jaccard", "translit_skeleton_ratio", "house_number_match"]


@query()
def gbt_score(spark, sf_dir):
    rows = views.scored(spark, sf_dir).drop("score")
    return models.fit_trees(rows, _INPUTS, _SMALL).score(rows).select("s1_id", "target_id", "label", r6(F.col("score"), "score"))


@query()
def oof_scores(spark, sf_dir):
    rows = views.scored(spark, sf_dir).drop("score")
    return models.out_of_fold(rows, _INPUTS, 3, _SMALL).select("s1_id", "target_id", "label", "fold", r6(F.col("score"), "score"))


@query()
def second_stage(spark, sf_dir):
    rows = views.scored(spark, sf_dir)
    model = models.second_stage(rows, "logistic")
    return models.apply_second_stage(model, rows).select("s1_id", "target_id", r6(F.col("second_stage_prob"), "second_stage_prob"), "predicted")


@query(f"""{EV}, r AS (SELECT s1_id, label, score, {_CONTRA} AS against FROM s), nt AS (SELECT s1_id, sum(label) AS nt FROM s GROUP BY s1_id),
 g AS (SELECT t, single, "only" FROM (SELECT unnest([{', '.join(f'{x}e0' for x in models.RULE_THRESHOLDS)}]) AS t) CROSS JOIN (SELECT unnest([{', '.join(f'{x}e0' for x in models.RULE_SINGLES)}]) AS single) CROSS JOIN (SELECT unnest([false, true]) AS "only") WHERE single > t),
 o AS (SELECT t, single, "only", s1_id, count(*) AS n, sum(label) AS h, max(score) AS top, bool_or(against) AS against FROM r JOIN g ON score >= t GROUP BY ALL),
 q AS (SELECT t, single, "only", s1_id, CASE WHEN n = 1 AND top < single AND (NOT "only" OR against) THEN 0 ELSE n END AS np, CASE WHEN n = 1 AND top < single AND (NOT "only" OR against) THEN 0 ELSE h END AS nh FROM o),
 k AS (SELECT g.*, nt, coalesce(np, 0) AS np, coalesce(nh, 0) AS nh FROM g CROSS JOIN nt LEFT JOIN q ON q.t = g.t AND q.single = g.single AND q."only" = g."only" AND q.s1_id = nt.s1_id)
 SELECT t, single, "only", round(avg({_F.format('np', 'nt', 'nh')}), 6) AS macro_f05 FROM k GROUP BY ALL""")
def rule_grid(spark, sf_dir):
    rows = views.scored(spark, sf_dir)
    n = rows.groupBy("s1_id").agg(F.sum("label").alias("n_true"))
    out: DataFrame = models.choose_rule(rows, n)
    return out.select("t", "single", "only", r6(F.col("macro_f05"), "macro_f05"))
