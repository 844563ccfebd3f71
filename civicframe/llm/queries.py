"""One registered query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .fill_middle import fill_middle
from .hilbert import document_shards
from .interpolation import interpolated
from .jaccard_join import jaccard_join
from .mixing import mix
from .near_vectors import near_vectors
from .packing import pack
from .phrase_automata import repeated_phrases
from .prefix_trie import prefix_trie
from .secret_scan import BASE, MORE, Rule, digest, secret_scan
from .toxicity import toxicity
from .url_filter import url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The given rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Workers started from elsewhere find the package too; a cluster has it installed.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter(table(spark, folder, "pages"), URL_RULES)


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


ORACLE["op6_exact_dedup"] = r"""
WITH rows AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM rows
"""


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return digest(secret_scan(table(spark, folder, "documents")), [r.kind for r in BASE])


@query
def op9_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = document_shards(table(spark, folder, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def held_out(modulus: int) -> Column:
    """Rows whose crc32 of the id, as text, leaves 2; a missing id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 2, F.lit(False))


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity(docs, labels, ~held_out(4))
    return scored.withColumns({"held_out": held_out(4), "predicted": (F.col("score") >= 0.3).cast("int")})


#: Wanted shares of tokens by domain: quality and toxicity of a document, as labelled. What is both poor and toxic is not wanted.
MIX_TARGETS = {"q0t0": 0.10, "q0t1": 0.0, "q1t0": 0.88, "q1t1": 0.02}


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return mix(docs, labels, F.concat(F.lit("q"), "quality", F.lit("t"), "toxic"), MIX_TARGETS)


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


@query
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents"), words=4, num=85, den=100)


@query
def op1_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query
def op4_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # Of the rows to learn from, an eighth is kept for the mixture weights.
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / 7) % 8 == 0
    scored = interpolated(docs, ~held_out(7), fold)
    return scored.withColumn("held_out", ~F.col("trained")).drop("trained")


#: Components of pairs ``links(i, j)``, both ways, over ``nodes(id)``: the smallest id that can be reached.
_REACHED = """
reached(id, node) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT r.id, l.j FROM reached r JOIN links l ON r.node = l.i
), least_id AS (SELECT id, min(node) AS component_id FROM reached GROUP BY id)
"""

ORACLE["op1_near_vectors"] = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE i = id) AS n_links, component_id, component_id = id AS kept FROM least_id
"""

ORACLE["op10_jaccard_join"] = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
    SELECT a.doc_id AS i, b.doc_id AS j FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), nodes AS (SELECT doc_id AS id FROM documents), {_REACHED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least_id ON id = doc_id
"""


def _spans_sql(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, p[k] AS start, m[k] AS stop, g[k] AS g FROM (
    SELECT doc_id, unnest(range(1, len(g) + 1)) AS k, g,
        list_transform(range(1, len(g) + 1), lambda k: coalesce(list_sum(list_transform(b[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)) AS p,
        list_transform(range(1, len(g) + 1), lambda k: coalesce(list_sum(list_transform(b[1:k], lambda x: length(x))), 0) + list_sum(list_transform(m[1:k], lambda x: length(x)))) AS m
    FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS b, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g
          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{pattern}')))
WHERE length(g[k]) >= {rule.least}
"""


_BASE_KINDS = ", ".join(f"'{r.kind}'" for r in BASE)
ORACLE["op8_secret_scan"] = f"""
WITH spans AS ({" UNION ALL ".join(_spans_sql(k, r) for k, r in enumerate(BASE + MORE))}),
named AS (SELECT doc_id, kind, start, rank, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS s FROM spans)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
    sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (kind IN ({_BASE_KINDS})), '')) AS base_sha256,
    coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans
FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query
def op11_phrase_automata(spark: SparkSession, folder: str) -> DataFrame:
    left = repeated_phrases(table(spark, folder, "documents"), size=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op11_phrase_automata"] = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
    SELECT r, k, array_to_string(w[k:k + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d)
), again AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1
), recurring AS (SELECT r, k FROM starts JOIN again USING (s)
), words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), marked AS (
    SELECT words.r, p, x, p - max(k) OVER (PARTITION BY words.r ORDER BY p) < 35 AS gone
    FROM words LEFT JOIN recurring ON recurring.r = words.r AND k = p
), counted AS (
    SELECT r, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY p) FILTER (gone IS NOT TRUE) AS kept FROM marked GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN counted USING (r)
"""


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


#: crc32 of a string of ASCII, bit by bit.
_CRC32 = """
4294967295 - list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split({s}, ''), lambda ch: CAST(ascii(ch) AS UBIGINT)), lambda acc, b:
    list_reduce([xor(acc, b)] || CAST(range(8) AS UBIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END))
"""

ORACLE["op12_prefix_trie"] = f"""
WITH own AS (
    SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taken AS (SELECT c, turns, CAST(({_CRC32.format(s="CAST(c AS VARCHAR)")}) % 4 AS BIGINT) AS h FROM own
), rebuilt AS (
    SELECT t.c, CASE WHEN t.h = 0 OR g.c IS NULL THEN [] ELSE g.turns[1:t.h] END || t.turns[t.h + 1:] AS s
    FROM taken t LEFT JOIN own g ON g.c = t.c - t.c % 20
), members AS (SELECT c, d, s[1:d] AS k, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(k[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY k, d
), children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY k[1:d - 1]
), under AS (
    SELECT n.k[1:a] AS k, count(*) FILTER (children.n IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
    FROM (SELECT k, saved, unnest(range(0, d + 1)) AS a FROM nodes) n LEFT JOIN children ON children.k = n.k GROUP BY n.k[1:a]
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(children.n, 0) AS n_children,
    under.n_leaves, CAST(under.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.d = p.d + 1 AND p.k = n.k[1:n.d - 1] LEFT JOIN children ON children.k = n.k JOIN under ON under.k = n.k
"""


@query
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    moved = fill_middle(table(spark, folder, "documents"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE["op13_fill_middle"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), drawn AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
        CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
    FROM d
), cut AS (
    SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, CASE WHEN a = 0 THEN '' ELSE array_to_string(u[1:a], '') END AS p,
        CASE WHEN b = a THEN '' ELSE array_to_string(u[a + 1:b], '') END AS m, CASE WHEN b = n THEN '' ELSE array_to_string(u[b + 1:n], '') END AS s
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
