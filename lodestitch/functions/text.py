"""Text normalisation as column expressions; Arrow UDFs only for NFKC, transliteration and scripts, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import words as W


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(ST.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def safe_text(x) -> Column:
    """NULL as ''."""
    return F.coalesce(_col(x).cast("string"), F.lit(""))


def normalize_unicode(x) -> Column:
    return _nfkc(safe_text(x))


def plain_text(x) -> Column:
    """Lower case; anything but letters, numbers, marks and white space as a blank; blanks collapsed and stripped."""
    kept = F.regexp_replace(F.lower(safe_text(x)), r"(?U)[^\p{L}\p{N}\p{M}\s]", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def normalize_text(x) -> Column:
    return plain_text(normalize_unicode(x))


normalize_address = normalize_country = normalize_text


def strip_legal(x) -> Column:
    """Legal-form words dropped at both ends, as long as there are any; may leave ''."""
    word = "(?:" + "|".join(W.LEGAL_WORDS) + ")"
    head = F.regexp_replace(_col(x), f"^(?:{word}(?: |$))+", "")
    return F.regexp_replace(head, f"(?:(?:^| ){word})+$", "")


def normalize_business_name(x, remove_suffixes: bool = True) -> Column:
    out = normalize_text(x)
    return strip_legal(out) if remove_suffixes else out


def tokens(x) -> Column:
    return F.filter(F.split(safe_text(x), r"\s+"), lambda t: t != "")


def sorted_tokens(x) -> Column:
    """The tokens in code-point order, repeats kept, joined by blanks."""
    return F.array_join(F.array_sort(tokens(x)), " ")


def without_stop_words(x) -> Column:
    stop = F.array(*map(F.lit, W.STOP_WORDS))
    return F.array_join(F.filter(tokens(x), lambda t: ~F.array_contains(stop, t)), " ")


def _latin(text: str) -> str:
    out = []
    for c in text:
        code = ord(c)
        if code < 128:
            out.append(c)
        elif 0x0900 <= code < 0x0D80:
            if 0x0D7A <= code <= 0x0D7F:  # consonants without a vowel
                out.append(("nn", "n", "rr", "l", "ll", "k")[code - 0x0D7A])
            elif 0x66 <= code % 0x80 <= 0x6F:
                out.append(str(code % 0x80 - 0x66))
            elif code % 0x80 == 0x70 and code < 0x0A00:
                out.append("")
            else:
                out.append(W.INDIC.get(code % 0x80, ""))
        elif c in "‌‍":
            continue
        elif c.lower() in W.LATIN:
            out.append(W.LATIN[c.lower()])
        else:
            out.append("".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)))
    return "".join(out).lower().strip()


@F.pandas_udf(ST.StringType())
def _transliterate(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "" if not x else _latin(x))


def transliterate(x) -> Column:
    """Latin letters without marks, Indic scripts by the layout that their blocks share; other scripts stay."""
    return _transliterate(safe_text(x))


def skeleton_of_latin(x) -> Column:
    """Consonants of a transliterated name, token by token; '' with fewer than two letters."""
    t = tokens(F.lower(safe_text(x)))

    def consonants(token: Column) -> Column:
        for old, new in W.DIGRAPHS:
            token = F.replace(token, F.lit(old), F.lit(new))
        return F.regexp_replace(F.regexp_replace(token, "[aeiouy]", ""), r"(.)\1+", "$1")

    def each(token: Column, i: Column) -> Column:
        after_short = (token == "li") & F.coalesce(F.get(t, i - 1).rlike(W.SKELETON_SHORT), F.lit(False))
        return F.when(token.rlike(W.SKELETON_LEGAL) | token.rlike(W.SKELETON_SHORT) | after_short, F.lit("")).otherwise(consonants(token))

    out = F.array_join(F.filter(F.transform(t, each), lambda c: c != ""), " ")
    return F.when(F.length(F.regexp_replace(out, r"[^\p{L}]", "")) >= 2, out).otherwise(F.lit(""))


def add_skeleton(rows: DataFrame, name: str = "norm_name", latin: str = "latin", into: str = "skeleton") -> DataFrame:
    """`rows` with the transliterated name and its skeleton (in two steps: a Python function can't stand in a lambda)."""
    return rows.withColumn(latin, transliterate(name)).withColumn(into, skeleton_of_latin(latin))


def _scripts(x: str | None) -> list[tuple[str, int]]:
    found = Counter((unicodedata.name(c, "UNKNOWN").split(" ")[0]) for c in x or "" if c.isalpha())
    return found.most_common()


@F.pandas_udf(ST.StructType([ST.StructField("script", ST.StringType()), ST.StructField("kind", ST.StringType())]))
def _script_profile(s: pd.Series) -> pd.DataFrame:
    out = []
    for x in s:
        found = _scripts(x)
        if not found:
            out.append(("NONE", "none"))
            continue
        total, (first, n) = sum(k for _, k in found), found[0]
        second = total - n and found[1][1] / total >= 0.2
        out.append((f"{first}+{found[1][0]}" if second else first, "mixed" if second else "latin" if first == "LATIN" else "non-latin"))
    return pd.DataFrame(out, columns=["script", "kind"])


def script_profile(x) -> Column:
    """Struct of the dominant script (with the second one from a fifth of the letters) and none, latin, non-latin or mixed."""
    return _script_profile(safe_text(x))


@F.pandas_udf(ST.StringType())
def _dominant(s: pd.Series) -> pd.Series:
    return s.map(lambda x: next((k for k, _ in _scripts(x)), ""))


def dominant_script(x) -> Column:
    return _dominant(safe_text(x))


def has_indic(x) -> Column:
    return safe_text(x).rlike("[ऀ-෿]")


def is_abbreviation(short, long) -> Column:
    """Whether `short` without blanks is the initials of two or more tokens of `long`."""
    s, t = F.replace(safe_text(short), F.lit(" "), F.lit("")), tokens(long)
    return (F.length(s) >= 2) & (F.size(t) >= 2) & (s == F.array_join(F.transform(t, lambda w: F.substring(w, 1, 1)), ""))


def is_noisy(raw, norm) -> Column:
    """A replacement character, or fewer letters than half of what isn't blank (two at least)."""
    dense = F.length(F.replace(safe_text(norm), F.lit(" "), F.lit("")))
    letters = F.regexp_count(safe_text(norm), F.lit(r"\p{L}"))
    return safe_text(raw).contains("�") | (letters < F.greatest(F.lit(2), F.floor(dense / 2)))


def register(spark) -> None:
    """The Arrow functions for SQL."""
    spark.udf.register("nfkc", _nfkc)
    spark.udf.register("transliterate", _transliterate)
    spark.udf.register("dominant_script", _dominant)
