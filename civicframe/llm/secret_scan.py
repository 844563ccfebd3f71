"""Secret scanning through a trigram index."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:  # the parser of the standard library's own regular expressions
    from re import _parser as regex_parser
except ImportError:  # older Python
    import sre_parse as regex_parser


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have at least ``least`` characters; a failing match is dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds. Letters of the keywords match in either case.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Further kinds of tokens with a public form.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]

#: Alternatives of one literal run that a query spells out, at most.
SPELLED = 64

Query = list[frozenset[str]] | None  # any of these sets, all trigrams of it; None: every text


def trigram_query(pattern: str) -> Query:
    """What a text must contain, in lower case, to match ``pattern``; necessary, not sufficient.

    Literal runs are spelled out with their alternatives; what is not literal ends a run. Each run
    demands the trigrams of one of its spellings, and the demands of all runs are joined by "and".
    """
    demands: list[list[frozenset[str]]] = []

    def demand(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            demands.append([s for s in sets if not any(t < s for t in sets)])

    def spell(items) -> set[str] | None:
        """The strings that ``items`` match, in lower case; None if they are too many or not literal."""
        whole = {""}
        for name, value in items:
            part = one(str(name), value)
            if part is None or len(part) * len(whole) > SPELLED:
                return None
            whole = {a + b for a, b in product(whole, part)}
        return whole

    def one(name: str, value) -> set[str] | None:
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN" and all(str(n) == "LITERAL" for n, _ in value):
            return {chr(v).lower() for _, v in value}
        if name == "SUBPATTERN":
            return spell(value[-1])
        if name == "BRANCH":
            parts = [spell(b) for b in value[1]]
            return None if None in parts else set().union(*parts)
        if name == "MAX_REPEAT" and value[1] == 1:
            inner = spell(value[2])
            return None if inner is None else inner | {""} if value[0] == 0 else inner
        return None

    run = {""}
    for name, value in regex_parser.parse(pattern):
        part = one(str(name), value)
        if part is None or len(part) * len(run) > SPELLED:
            demand(run)
            run = part if part is not None and len(part) <= SPELLED else {""}
        else:
            run = {a + b for a, b in product(run, part)}
    demand(run)
    if not demands:
        return None
    query = [frozenset()]
    for d in demands:
        query = [a | b for a, b in product(query, d)]
    return query


MASK_BITS = 60


def posting_masks(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The index over ``grams``: postings ``(gram, id)`` per text, merged into one row of bit masks per id."""
    low = rows.select("__id", F.lower("__text").alias("__low"))
    has = F.array_compact(F.array(*(F.when(F.contains("__low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    postings = low.select("__id", F.explode(has).alias("__gram"))
    masks = []
    for k in range(0, len(grams), MASK_BITS):
        inside = F.col("__gram").between(k, k + MASK_BITS - 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__gram") - k).cast("int"))
        masks.append(F.bit_or(F.when(inside, bit).otherwise(F.lit(0).cast("long"))).alias(f"__m{k // MASK_BITS}"))
    return postings.groupBy("__id").agg(*masks)


def _holds(query: list[frozenset[str]], place: dict[str, int]) -> Column:
    """Whether the postings of all trigrams of one alternative meet in this row's masks."""
    either = F.lit(False)
    for need in query:
        bits: dict[int, int] = {}
        for g in need:
            k, b = divmod(place[g], MASK_BITS)
            bits[k] = bits.get(k, 0) | 1 << b
        all_of = F.lit(True)
        for k, m in bits.items():
            all_of = all_of & (F.coalesce(F.col(f"__m{k}"), F.lit(0)).bitwiseAND(F.lit(m)) == F.lit(m))
        either = either | all_of
    return either


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"

#: Matches whose places are summed up one after another; their number, not that of all matches, is what an array is copied for.
RUN = 128


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once although ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule. A text is its pieces between matches and the matches, in turn.

    The matches are cut into runs. A running sum over the lengths of the runs gives the place where each
    starts, and a sum within it the places of its matches, so that time follows the number of matches.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p).cast("long"))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    checked = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    zero = F.lit(0).cast("long")

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + item["p"]
        end = start + item["m"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(item["g"] >= rule.least, F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.concat(state["found"], kept).alias("found"))

    def placed(run: Column, at: Column) -> Column:
        state = F.struct(at.alias("at"), F.array().cast(SPAN).alias("found"))
        return F.aggregate(run, state, step, lambda s: s["found"])

    def of_runs(runs: Column) -> Column:
        lengths = F.transform(runs, lambda r: F.aggregate(r, zero, lambda t, i: t + i["p"] + i["m"]))
        starts = F.aggregate(lengths, F.array(zero), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        return _let(starts, lambda s: F.flatten(F.transform(runs, lambda run, i: placed(run, F.get(s, i)))))

    def of_items(items: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.size(items), F.lit(RUN))
        runs = F.transform(cuts, lambda c: F.slice(items, c, F.lit(RUN)))
        return F.when(F.size(items) > 0, _let(runs, of_runs)).otherwise(F.array().cast(SPAN))

    items = _let(whole, lambda w: F.arrays_zip(F.slice(between, F.lit(1), F.size(w)).alias("p"), w.alias("m"), checked.alias("g")))
    return _let(items, of_items)


def secret_scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's spans: ``id_col, spans array<struct<start, rank, kind, end>>``, in order of start and rule.

    Positions count code points, the end is exclusive. Each rule's pattern gives a Boolean query over
    trigrams; the queries are answered on the index, and only rows whose id has passed are matched.
    A rule without a mandatory trigram is matched against every text. Missing text is empty and has
    no spans; rows that share an id pass together and are matched one by one.
    Texts of any length are read whole, in time that follows their length and their matches. An empty
    table gives an empty result; columns other than the two are not read, whatever their names.
    """
    rules = BASE + MORE if rules is None else rules
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries if q for need in q for g in need})
    place = {g: i for i, g in enumerate(grams)}
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if grams:
        masks = posting_masks(rows, grams).withColumnRenamed("__id", "__of")
        passes = F.lit(False)
        for q in queries:
            if q:
                passes = passes | _holds(q, place)
        masks = masks.where(passes)
        rows = rows.join(masks, F.col("__id").eqNullSafe(F.col("__of")), "left").drop("__of")
    none = F.array().cast(SPAN)
    found = []
    for rank, (r, q) in enumerate(zip(rules, queries, strict=True)):
        passed = F.rlike("__text", F.lit(r.pattern)) if q is None else _holds(q, place)
        found.append(F.when(passed, _spans(F.col("__text"), r, rank)).otherwise(none).cast(SPAN))
    return rows.select(F.col("__id").alias(id_col), F.array_sort(F.concat(*found)).alias("spans"))


def digest(scanned: DataFrame, base: list[str], id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, a hash of the base spans and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        id_col,
        *(count(k) for k in base),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
