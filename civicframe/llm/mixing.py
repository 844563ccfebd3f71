"""Mixing documents to target weights of softly known domains."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Runs of letters and digits, and every other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def token_count(text: Column) -> Column:
    """Words between white space, and one for the end of the text."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def posteriors(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    domains: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 20_000,
    features: int = 4_096,
) -> DataFrame:
    """``__id, text_hash, tokens, posterior array<double>`` in the order of ``domains``, for every row of ``docs``.

    A multinomial logistic regression on hashed term shares, fitted to at most about ``sample``
    labelled documents chosen by a hash of the id. Domains that no chosen label names get a
    posterior of 0; with fewer than two named, the posterior is 1 for the one named, or equal shares.
    """
    number = reduce(lambda a, d: a.when(domain == d[1], float(d[0])), enumerate(domains), F.when(F.lit(False), 0.0))
    other = labels.where(domain.isNotNull() & ~domain.isin(domains)).select(domain.alias("d")).first()
    if other:
        raise ValueError(f"a label names the domain {other.d}, which has no target")
    known = labels.select(F.col(id_col).alias("__id"), number.alias("__y")).where("__id is not null and __y is not null")
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"))
    total = known.count()
    known = known.where(F.pmod(F.xxhash64("__id", F.lit("mix")), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(total, 1)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text).alias("text_hash"))
    steps = Pipeline(
        stages=[
            RegexTokenizer(inputCol="__text", outputCol="__terms", pattern=TOKEN, gaps=False, toLowercase=True),
            HashingTF(inputCol="__terms", outputCol="__counts", numFeatures=features),
            Normalizer(inputCol="__counts", outputCol="__shares", p=2.0),
        ]
    ).fit(rows)
    # Ids of the sample: bounded by its size.
    picked = stored(steps.transform(rows.join(F.broadcast(stored(known)), "__id")).select("__y", "__shares"))
    named = [int(r[0]) for r in picked.select("__y").distinct().collect()]
    measured = rows.withColumn("tokens", token_count(F.col("__text")))
    if len(named) < 2:
        flat = [1.0 if d in named else 0.0 for d in range(len(domains))] if named else [1.0 / len(domains)] * len(domains)
        return measured.select("__id", "text_hash", "tokens", F.array(*map(F.lit, flat)).alias("posterior"))
    model = LogisticRegression(
        featuresCol="__shares", labelCol="__y", family="multinomial", maxIter=40, regParam=1e-4
    ).fit(picked)
    p = vector_to_array("probability")
    known_domains = model.numClasses
    posterior = F.array(*(p[i] if i < known_domains else F.lit(0.0) for i in range(len(domains))))
    return model.transform(steps.transform(measured)).select("__id", "text_hash", "tokens", posterior.alias("posterior"))


def fitted_rates(
    rows: DataFrame,
    targets: list[float],
    budget: float = 1.0,
    keep: float = 1e-3,
    steps: int = 60,
    tolerance: float = 1e-4,
) -> DataFrame:
    """``rows`` with ``rate``: nonnegative, expected tokens per domain as near to the targets as can be.

    Least squares on the domains' relative gaps, with ``keep`` times the squared distance of the
    rates from 1 to choose among equal fits. Projected gradient: a step needs one number per domain
    of the whole table, ``sum(rate * tokens * posterior)``; a row's rate is the same short loop over
    the numbers so far, so nothing per row is kept between steps.
    """
    width = len(targets)
    sums = lambda weight: [F.sum(weight * F.col("tokens") * F.col("posterior")[d]).alias(f"d{d}") for d in range(width)]
    first = rows.agg(F.sum("tokens").alias("all"), *sums(F.lit(1.0))).first()
    total = float(first["all"] or 0)
    if not total:
        return rows.withColumn("rate", F.lit(1.0))
    share = [max((first[f"d{d}"] or 0.0) / total, 1e-9) for d in range(width)]
    wanted = [budget * t / sum(targets) for t in targets]
    have, history = [first[f"d{d}"] / total for d in range(width)], []
    rate = F.lit(1.0)
    for _ in range(steps):
        gaps = [(h - w) / s for h, w, s in zip(have, wanted, share, strict=True)]
        # A domain that no row can give is no gap.
        gaps = [g if s > 1e-9 else 0.0 for g, s in zip(gaps, share, strict=True)]
        history.append(gaps)
        if len(history) > 1 and max(abs(a - b) for a, b in zip(history[-1], history[-2], strict=True)) < tolerance:
            break
        past = F.array(*(F.array(*map(F.lit, g)) for g in history))

        def step(r: Column, g: Column) -> Column:
            slope = reduce(lambda a, b: a + b, (g[d] * F.col("posterior")[d] for d in range(width)))
            return F.greatest(F.lit(0.0), r - (slope + keep * (r - 1)) / (1 + keep))

        rate = F.aggregate(past, F.lit(1.0), step)
        now = rows.agg(*sums(rate)).first()
        have = [now[f"d{d}"] / total for d in range(width)]
    return rows.withColumn("rate", rate)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float = 1.0,
    sample: int = 20_000,
) -> DataFrame:
    """One row per document: ``id_col, text_hash, tokens, posterior, rate``; the hash tells texts of one id apart.

    ``domain`` names a label row's domain, ``targets`` the wanted shares of tokens, ``budget`` the
    wanted tokens as a multiple of those there are. A rate is the expected number of times that the
    document appears in the mixture. Missing and empty texts have one token, for their end. Labels
    without a domain, or for absent documents, are not used; one that names a domain without a target
    is an error. Rows that repeat an
    id are rated each. A domain that no document can belong to is left out of the fit.
    """
    known = stored(posteriors(docs, labels, domain, list(targets), id_col, text_col, sample))
    rated = fitted_rates(known, list(targets.values()), budget)
    return rated.withColumnRenamed("__id", id_col)
