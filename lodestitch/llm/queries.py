"""Named queries of the corpus operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, langid, licenses, line_dedup, neardup_text, neardup_vectors, packing, pieces, secrets, substrings


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_text.near_duplicates(table(spark, sf_dir, "documents"))


def op7_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_neardup, op2_license_scan, op3_substring_dedup, op4_best_fit_packing, op5_language_id, op6_minhash_neardup, op7_piece_dropout, op8_line_dedup, op9_secret_scan, op10_ann,
    )
}

_REACH = """,
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), comp AS (SELECT a AS id, least(a, min(b)) AS c FROM reach GROUP BY a)"""

#: Twins where SQL can express the contract. Not: 2 and 9 (fuzzy and learned spans), 4, 5 and 7 (tokenizers, a classifier), 10
#: (approximate). Those are tested against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_neardup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93){_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.id = vec_id""",
    "op3_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM m GROUP BY g), c AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT m.doc_id, m.i, unnest(range(13)) AS k FROM m JOIN f USING (g) WHERE first < m.doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d)
SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(c.i) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY d.doc_id""",
    "op6_minhash_neardup": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
 GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*)))""" + _REACH + """
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = doc_id""",
    "op8_line_dedup": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key AS hot FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN h ON key = hot GROUP BY doc_id""",
}
