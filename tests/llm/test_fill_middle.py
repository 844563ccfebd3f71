"""The piece table, and fill-in-the-middle against a plain version."""

import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from civicframe.llm.fill_middle import SENTINELS, Piece, PieceTable, arranged, fill_middle, restored
from civicframe.llm.queries import ORACLE, QUERIES
from workload.compare import compare, connect

TEXT = st.text(st.sampled_from("ab \n\té😀<>PSM"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXT.filter(lambda t: t and not any(s in t for s in SENTINELS)), st.data())
def test_forms_and_the_way_back(text, data):
    first, second = sorted(data.draw(st.integers(0, len(text))) for _ in range(2))
    p, m, s = text[:first], text[first:second], text[second:]
    outputs = {"psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}", "plain": text}
    for form, expected in outputs.items():
        table = arranged(text, first, second, form)
        assert table.text() == expected and table.sha256() == hashlib.sha256(expected.encode()).hexdigest()
        assert restored(expected, form).text() == text


def test_cuts_split_descriptors():
    table = PieceTable.of("abcdef").cut(4).cut(1)
    assert table.pieces == (Piece(0, 0, 1), Piece(0, 1, 3), Piece(0, 4, 2))
    assert table.permuted([2, 0, 1]).text() == "efabcd" and table.buffers == ("abcdef",)


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in SENTINELS) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def test_odd_rows(spark):
    texts = [None, "", " ", "a", " a  b\n", "x <P> y", "one two <M>", "é b 😀 c\x85d\x0b", "w " * 60000, "<P", "<S>"]
    rows = [(i, texts[i % len(texts)]) for i in range(200)] + [(None, "a b c"), (4, "a b"), (4, "a b"), (-5, "a b c d")]
    df = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "doc_id long, text string, n int, output string")
    found = fill_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert Counter(map(tuple, found.collect())) == Counter(plain(*r) for r in rows)
    forms = Counter(r.form for r in fill_middle(df, plain_from=100, spm_below=0).collect())
    assert set(forms) == {"plain", "psm"}
    assert fill_middle(df.where("false")).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op13_fill_middle"](spark, folder), connect(folder), ORACLE["op13_fill_middle"]) is None
