"""URL verdicts by rules, and by gradient-boosted trees where no rule fits."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

Rule = tuple[str, str, str]  # verdict, host, path

SMOOTH = 20.0
LEXICAL = ["n_host", "n_path", "n_query", "depth", "labels", "digits", "entropy", "params", "marks"]
FEATURES = [*LEXICAL, "suffix_block", "suffix_rows"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; missing without one. The rules are part of the plan."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]

    def choose(values: list[str]) -> Column:
        return F.coalesce(*(F.when(f, v) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))

    return choose([h + p for _, h, p in ranked]), choose([v for v, _, _ in ranked])


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers that depend on the characters of a URL alone."""
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    # Shannon entropy over letters, digits and the usual marks.
    known = string.ascii_lowercase + string.digits + "/.-_?=&%#:"
    counts = [F.length(F.lower(url)) - F.length(F.replace(F.lower(url), F.lit(c))) for c in known]
    entropy = reduce(lambda a, b: a + b, (F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in counts))
    return {
        "n_host": F.length(host),
        "n_path": F.length(path),
        "n_query": F.length(query),
        "depth": _count(path, "/"),
        "labels": _count(host, r"\."),
        "digits": _count(url, "[0-9]") / n,
        "entropy": entropy,
        "params": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0),
        "marks": _count(url, "[-_%~]"),
    }


def url_filter(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    sample: int = 20_000,
    trees: int = 12,
    depth: int = 4,
    block_at: float = 0.5,
) -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict, block_score``.

    URLs that a rule fits are the labelled ones. Suffix statistics (share of blocked rows, number of
    rows by the host's last label) count all of them; the trees are fitted to at most about
    ``sample`` of them, chosen by a hash of the URL. ``block_score`` is the model's, missing where it
    could not be fitted because all labelled rows agree; such rows get the only known verdict, or
    ``allow`` without any. A missing URL is an empty one. Repeated rows get equal verdicts.
    URLs of any length are read whole. An empty table gives an empty result; columns other than the two are
    not read, whatever their names.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(F.col("__url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("__id"), url.alias("__url")).withColumns({"host": host, "path": path})
    rows = rows.withColumns({"rule": rule, "__said": verdict, "__suffix": F.element_at(F.split("host", r"\."), -1)})
    rows = rows.withColumns(lexical(F.col("__url"), F.col("host"), F.col("path")))
    rows = stored(rows)
    labelled = rows.where("__said is not null")
    label = (F.col("__said") == "block").cast("double")
    seen = labelled.groupBy("__suffix").agg(F.sum(label).alias("__b"), F.count(F.lit(1)).alias("__n"))
    # Two numbers for the whole table.
    blocked, total = labelled.agg(F.sum(label), F.count(F.lit(1))).first()
    if not total or blocked in (0, total):
        only = "block" if total and blocked else "allow"
        return rows.select(
            F.col("__id").alias(id_col), "host", "path", "rule",
            F.coalesce("__said", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_score"),
        )
    prior = blocked / total
    known = seen.select(
        "__suffix",
        ((F.col("__b") + SMOOTH * prior) / (F.col("__n") + SMOOTH)).alias("suffix_block"),
        F.log1p("__n").alias("suffix_rows"),
    )
    full = rows.join(known, "__suffix", "left").fillna({"suffix_block": prior, "suffix_rows": 0.0})
    full = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(full)
    share = min(1.0, sample / total)
    chosen = full.where(F.col("__said").isNotNull()).where(F.pmod(F.xxhash64("__url"), F.lit(1_000_000)) < share * 1_000_000)
    weight = F.when(label == 1, 0.5 / prior).otherwise(0.5 / (1 - prior))
    chosen = chosen.select("__features", label.alias("__label"), weight.alias("__weight")).coalesce(4)
    model = GBTClassifier(
        featuresCol="__features", labelCol="__label", weightCol="__weight", maxIter=trees, maxDepth=depth, seed=7
    ).fit(chosen)
    scored = model.transform(full).withColumn("block_score", vector_to_array("probability")[1])
    return scored.select(
        F.col("__id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("__said", F.when(F.col("block_score") >= block_at, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
