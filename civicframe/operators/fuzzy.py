"""Inexact gazetteer look-up: an inverted index over address words, checked by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import top_k_per_key
from .joins import spread_join


def words_of(key: Column | str) -> Column:
    """Distinct words of a normalized address."""
    return F.array_distinct(F.split(key, " "))


def word_weights(keys: DataFrame, key: str = "__key") -> DataFrame:
    """``word, weight`` of the words in a table of distinct addresses: rare words weigh more, as whole thousandths."""
    words = keys.select(F.explode(words_of(key)).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("__df"))
    rows = keys.agg(F.count(F.lit(1))).scalar()
    weight = F.round(1000 * F.log1p(rows / F.col("__df"))).cast("long")
    return counted.select("word", weight.alias("weight"))


def _total(weighted: Column) -> Column:
    return F.aggregate(weighted, F.lit(0).cast("long"), lambda t, w: t + w["weight"])


def _needed_words(weighted: Column, share: int) -> Column:
    """The heaviest words, without which what is left weighs less than ``share`` percent of all.

    A place that holds ``share`` percent holds one of them, so only these are looked up, and words that
    most addresses have are not among them unless they decide.
    """
    whole = _total(weighted)

    def needed(_: Column, at: Column) -> Column:
        rest = F.slice(weighted, at + 1, F.size(weighted))
        return _total(rest) * 100 >= whole * share

    return F.filter(weighted, needed)


def near_places(
    asked: DataFrame,
    places: DataFrame,
    k: int,
    edits: int,
    share: int,
    tie: str = "place_id",
    weights: DataFrame | None = None,
) -> DataFrame:
    """Up to ``k`` places for each address text in ``asked``, best first; columns ``__key``, ``__places``.

    ``asked`` holds normalized texts in ``__key``, repeated ones and missing ones as they come; ``places``
    is what ``places_by_key`` gives with the same ``k``. A place fits when the words that it shares weigh at least
    ``share`` percent of the asked words that any place has, and its address is ``edits`` or
    fewer edits away, in either case of letters. Fewer edits come first, then more shared weight, then
    the order of ``places_by_key``. Texts without a fitting place have no row.
    """
    if not 0 < share <= 100:
        raise ValueError("share is a percentage above 0")
    low = places.select(F.upper("__key").alias("__low"), "__places")
    names = low.select(F.col("__low").alias("__key")).distinct()
    weights = word_weights(names) if weights is None else weights
    texts = asked.where("__key IS NOT NULL AND __key <> ''").select("__key").distinct()
    words = texts.select("__key", F.explode(words_of(F.upper("__key"))).alias("word"))
    # Words that no place has cannot be shared and tell nothing.
    known = spread_join(words, weights, "word", "inner")
    heavy = F.struct((-F.col("weight")).alias("__order"), "word", "weight")
    lists = known.groupBy("__key").agg(F.array_sort(F.collect_list(heavy)).alias("__words"))
    lists = lists.withColumn("__needed", _needed_words(F.col("__words"), share))
    probes = lists.select("__key", "__words", "__needed", F.explode("__needed.word").alias("__probe"))
    postings = low.select(
        "__low", "__places", words_of("__low").alias("__held"), F.explode(words_of("__low")).alias("__posted")
    )
    # A pair that shares several of the words looked up is taken at the first of them alone.
    met = F.filter("__needed", lambda w: F.array_contains("__held", w["word"]))
    first = F.get(met, F.lit(0))["word"] == F.col("__probe")
    near = F.abs(F.length("__key") - F.length("__low")) <= edits
    pairs = spread_join(probes, postings, [("__probe", "__posted")], "inner", residual=near & first)
    shared = _total(F.filter("__words", lambda w: F.array_contains("__held", w["word"])))
    checked = pairs.select(
        "__key",
        "__places",
        "__low",
        shared.alias("__shared"),
        _total(F.col("__words")).alias("__all"),
        F.levenshtein(F.upper("__key"), F.col("__low"), edits).alias("__edits"),
    ).where((F.col("__edits") >= 0) & (F.col("__shared") * 100 >= F.col("__all") * share))
    each = checked.select("__key", "__edits", "__shared", F.explode("__places").alias("__place"))
    order = {"__more": -F.col("__shared"), "__km": F.col("__place.__km"), "__tie": F.col(f"__place.{tie}")}
    best = top_k_per_key(each.withColumns(order), ["__key"], ["__edits", "__more", "__km", "__tie"], k)
    kept = F.struct("__edits", "__more", "__km", "__tie", "__place")
    listed = best.groupBy("__key").agg(F.array_sort(F.collect_list(kept)).alias("__kept"))
    with_edits = F.transform("__kept", lambda b: b["__place"].withField("edits", b["__edits"]))
    return listed.select("__key", with_edits.alias("__places"))
