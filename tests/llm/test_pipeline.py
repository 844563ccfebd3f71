"""Each stage on planted rows, and the whole on a table."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from civicframe.llm.exact_dedup import exact_dedup
from tests.llm.test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], KINDS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels of documents that hold a bad word or junk."""
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [(i, f"plain words number w{i} here" + (" rotten" if i % 10 == 0 else "") + (" %%% ***" if i % 7 == 0 else "")) for i in range(500)]
    labels = [(i, int(i % 7 != 0), int(i % 10 == 0)) for i, _ in texts]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    return path


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").union(frame(spark, [(900, None), (901, ""), (902, "so Rotten!"), (None, "fine"), (3, "rotten")]))
    left = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter([i for i in range(500) if i % 10] + [900, 901, None])


def test_toxic_documents_of_a_small_table_go(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    gone = [r.toxic for r in labels if r.doc_id not in left]
    assert sum(gone) >= 0.85 * sum(r.toxic for r in labels) and sum(gone) >= 0.9 * len(gone)


def test_one_of_equal_texts_stays(spark, folder):
    texts = [(5, "a b"), (3, "a  b"), (3, "a  b"), (3, "c"), (9, "c"), (None, "c"), (None, "d"), (7, None), (6, " "), (8, "")]
    left = corpus_pipeline.drop_copies(spark, frame(spark, texts), folder)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(3, "a  b"), (3, "c"), (None, "d"), (6, " "), (7, None)])


def test_one_of_near_copies_stays(spark, folder):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [(4, base), (2, base + " end"), (9, base + " other end"), (5, "short text"), (6, None), (None, base)]
    left = corpus_pipeline.drop_near_copies(spark, frame(spark, texts), folder)
    assert Counter(r.doc_id for r in left.collect()) == Counter([2, 5, 6, None])


def test_mixture_has_the_wanted_shares(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.mixed(spark, docs.union(docs.where("doc_id = 1")), folder)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    # Documents of the domain that is to grow all stay.
    assert all(times[i] >= 1 for i in range(500) if i % 7)
    low = sum(n for i, n in times.items() if i % 7 == 0) / sum(times.values())
    assert abs(low - 0.05) < 0.03


def test_stages_on_empty_documents(spark, folder):
    docs = frame(spark, []).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps, rows = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, FOLDER).cache()
        steps[name] = rows
    toxic = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in steps["toxicity"].collect()}
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(known.get(i, 1) for i in toxic) >= 0.8 * len(toxic)
    kept = {r.doc_id for r in exact_dedup(steps["toxicity"]).where("kept").collect()}
    assert {r.doc_id for r in steps["exact_dedup"].collect()} == kept
    texts = [(r.doc_id, r.text) for r in steps["exact_dedup"].collect()]
    assert {r.doc_id for r in steps["near_dedup"].collect()} == {i for i, _, c in brute(texts, 5, 4, 5) if i == c}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in steps["mixing"].collect():
        tokens[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, ends = Counter(), defaultdict(int)
    for r in steps["packing"].collect():
        got[r.doc_id] += r.length
        ends[r.sequence_id] += r.length
    assert got == tokens and all(np.log2(n) % 1 == 0 for n in ends.values())
    again = Counter()
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        again[r.doc_id] += r.length
    assert again == got


def test_copies_are_dropped_with_one_exchange_of_the_rows(spark):
    from corpus_pipeline import drop_copies

    rows = [(1, "a  b", "x"), (2, "a b", "x"), (1, "a  b", "x"), (3, None, "y"), (4, "", "y"), (None, "n", "z"), (None, "n", "z"), (0, "m", "z"), (None, "m", "z"), (7, "7", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = drop_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted((tuple(r) for r in out.collect()), key=repr)
    assert kept == sorted([(1, "a  b", "x"), (3, None, "y"), (None, "n", "z"), (0, "m", "z"), (7, "7", None)], key=repr)
    plan = drop_copies(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    # Two of the deduplication, one for each side of its join, one for the rows, one for the verdicts.
    assert len(moved) <= 6, plan
