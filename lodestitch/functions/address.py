"""Keys and numbers of normalised addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .text import _col, safe_text, tokens

DIGIT = r"\p{Nd}"


def is_supported(country) -> Column:
    return _col(country).isin(*W.STATES)


def state_phrases(country: str) -> list[str]:
    """Codes and names of a country's states, those of most words first."""
    table = W.STATES.get(country, {})
    names = {*table, *table.values(), *(W.MORE_STATE_NAMES if table else ())}
    return sorted(names, key=lambda x: (-len(x.split()), x))


def _phrase_pattern(phrases: list[str]) -> str:
    return "(?:" + "|".join(phrases) + ")"


def without_states(address, country: str) -> Column:
    """The address's text without state phrases, the longest at each place first."""
    if not (phrases := state_phrases(country)):
        return F.array_join(tokens(address), " ")
    spaced = F.concat(F.lit(" "), F.array_join(tokens(address), "  "), F.lit(" "))
    wide = [p.replace(" ", "  ") for p in phrases]
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, f" {_phrase_pattern(wide)} ", " "), " +", " "))


def house_place(address) -> Column:
    """Place (from 1) of the first token with a digit; 0 if there is none."""
    return F.array_position(F.transform(tokens(address), lambda t: t.rlike(DIGIT)), True).cast("int")


def house_number(address) -> Column:
    """Digits of the first token that has any, without leading zeros; '' if none are left."""
    first = F.get(F.filter(tokens(address), lambda t: t.rlike(DIGIT)), F.lit(0))
    return F.coalesce(F.regexp_replace(F.regexp_replace(first, r"[^\p{Nd}]", ""), "^0+", ""), F.lit(""))


def postal_code(address, country) -> Column:
    """The last token of as many digits as the country's codes have, other than the house number's; '' if there is none."""
    table = F.create_map(*(F.lit(x) for pair in W.POSTAL_DIGITS.items() for x in pair))
    size = F.coalesce(F.element_at(table, _col(country)), F.lit(-1))
    house = house_place(address)
    found = F.filter(tokens(address), lambda t, i: (F.length(t) == size) & t.rlike(f"^{DIGIT}+$") & (i + 1 != house))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.lit(""))


def numbers(address) -> Column:
    """All runs of digits in order, without leading zeros ('0' for zeros alone)."""
    runs = F.regexp_extract_all(safe_text(address), F.lit(f"({DIGIT}+)"), F.lit(1))
    return F.transform(runs, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0")))


def city(address, country: str, lexicon: list[str]) -> Column:
    """The rightmost token of the lexicon once states are removed; '' if there is none or the country isn't supported."""
    if not lexicon or country not in W.STATES:
        return F.lit("")
    known = F.array(*map(F.lit, sorted(lexicon)))
    found = F.filter(tokens(without_states(address, country)), lambda t: F.array_contains(known, t))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.lit(""))


def learn_city_lexicon(entities: DataFrame, min_count: int = 25, address: str = "norm_address", country: str = "country") -> DataFrame:
    """(country, token, n): tokens right before a state, without digits, of three letters or more, frequent and not generic.

    Where reference addresses write codes only those count as states, elsewhere only names.
    """
    parts = []
    for c in W.STATES:
        phrases = sorted({*W.STATES[c]} if c in W.STATES_AS_CODES else {*W.STATES[c].values()}, key=lambda x: (-len(x.split()), x))
        wide = _phrase_pattern([p.replace(" ", "  ") for p in phrases])
        rows = entities.where(F.col(country) == c).select(F.concat(F.lit(" "), F.array_join(tokens(address), "  "), F.lit(" ")).alias("a"))
        # states become a mark of their own; the token before a mark is the last one that stays
        marked = F.regexp_replace("a", f" {wide} ", " \u0001 ")
        before = F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace(marked, " +", "  ")), F.lit("  ([^ \u0001]+)  (?=\u0001)"), F.lit(1))
        parts.append(rows.select(F.lit(c).alias("country"), F.explode(before).alias("token")))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    keep = ~F.col("token").rlike(DIGIT) & (F.length("token") >= 3) & ~F.col("token").isin(*W.NOT_CITIES)
    return found.where(keep).groupBy("country", "token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def with_keys(entities: DataFrame, lexicon: DataFrame, address: str = "norm_address", country: str = "country") -> DataFrame:
    """`entities` with house, postal, city and house_city ('' where there is none).

    `lexicon` has country and token. Tokens of the different addresses meet it in a join, so it may be of any size; an
    address's rightmost token that is in it counts, and comes back by the address itself.
    """
    stripped = F.array_join(tokens(address), " ")
    for c in W.STATES:
        stripped = F.when(F.col(country) == c, without_states(address, c)).otherwise(stripped)
    rows = entities.withColumn("__c", F.col(country)).withColumn("__a", stripped)
    places = rows.where(F.col("__c").isin(*W.STATES)).select("__c", "__a").distinct()
    seen = places.select("__c", "__a", F.posexplode(F.split("__a", " ")).alias("__i", "token"))
    hit = seen.join(lexicon.select(F.col("country").alias("__c"), "token").distinct(), ["__c", "token"]).groupBy("__c", "__a").agg(F.max_by("token", "__i").alias("__city"))
    keyed = rows.join(hit, ["__c", "__a"], "left").select(*(F.col(f"`{x}`") for x in entities.columns), F.coalesce("__city", F.lit("")).alias("city"))
    keyed = keyed.withColumn("house", house_number(address)).withColumn("postal", postal_code(address, country))
    both = (F.col("house") != "") & (F.col("city") != "")
    return keyed.withColumn("house_city", F.when(both, F.concat_ws("|", "house", "city")).otherwise(F.lit("")))
