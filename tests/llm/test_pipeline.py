from fractions import Fraction

import public_tokenizers
import pyarrow.parquet as pq
import test_decontam
import test_jaccard
import test_pii
import test_quality

import corpus_pipeline
from cohortloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def replaced(text):
    out, end = "", 0
    for kind, start, stop in test_pii.brute(text):
        if start >= end:
            out += text[end:start] + f"<{kind.upper()}>"
        end = max(end, stop)
    return out + text[end:]


def brute(docs, items):
    """(doc_id, text) that come out, of [(doc_id, text)] where no host is rejected and no term gives an entity away."""
    left = []
    for d, t in docs:
        n, *_, repeated = test_quality.brute(t)
        if n >= 20 and 100 * repeated <= 30 * n:
            left.append((d, t))
    groups = test_jaccard.brute(left, 5, Fraction(4, 5))
    left = [(d, t) for d, t in left if groups[d][1] == d]
    clean = {d for d, _, hit, _ in test_decontam.brute(left, items) if not hit}
    return {d: replaced(t) for d, t in left if d in clean}


def test_run_equals_brute_force(spark, sf):
    docs = [tuple(r.values()) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    items = [tuple(r.values()) for r in pq.read_table(f"{sf}/benchmark.parquet", columns=["item_id", "text"]).to_pylist()]
    want = brute(docs, items)
    out = corpus_pipeline.run(spark, sf)
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(out, PATH).collect()}
    assert got == want and 0 < len(got) < len(docs)
    assert all(r.n_tokens * 4 == len(r.ids) for r in out.collect())


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf, frame):
    prose = " ".join(f"word{k}" for k in range(40))
    rows = [
        (1, prose, "en", "a", 1), (2, prose, "en", "a", 1), (2, prose, "en", "a", 1), (3, None, "en", "a", 1), (4, "", None, None, None),
        (None, prose.upper(), "en", None, 1), (5, "mail x@y.org " + " ".join(f"other{k}" for k in range(30)), "en", "b", 1), (5, "zz " + " ".join(f"third{k}" for k in range(30)), "en", "b", 1),
    ]
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, function(spark, docs, sf)
        assert docs.columns == before.columns, name
    out = sorted(((r.doc_id or 0, r.text) for r in docs.collect()))
    assert out == [(0, prose.upper()), (1, prose), (5, rows[6][1].replace("x@y.org", "<EMAIL>")), (5, rows[7][1])]
    assert sorted(r.n_chars for r in docs.collect() if r.doc_id == 5) == sorted(len(t) for _, t in out[2:])
    empty = frame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, function in corpus_pipeline.STAGES:
        empty = function(spark, empty, sf)
    assert empty.count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(word):
    return " ".join(f"{word}{k}" for k in range(40))


def passage(sf):
    texts = pq.read_table(f"{sf}/benchmark.parquet", columns=["text"]).column(0).to_pylist()
    return next(t for t in texts if t and len(t.split()) >= 12)


def test_a_row_does_not_go_for_another_row_of_its_id(spark, sf, frame):
    near = frame([(1, prose("a"), "en", "s", 1), (7, prose("a"), "en", "s", 1), (7, prose("b"), "en", "s", 1)], SCHEMA)
    kept = corpus_pipeline.near_copies(spark, near, sf).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, prose("a")), (7, prose("b"))]
    docs = frame([(8, prose("c") + " " + passage(sf), "en", "s", 1), (8, prose("d"), "en", "s", 1)], SCHEMA)
    assert [(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, sf).collect()] == [(8, prose("d"))]


def test_rows_without_an_id_are_judged(spark, sf, frame):
    rows = [(None, prose("a")), (None, prose("a")), (None, prose("a") + " more"), (None, prose("b")), (2, prose("c")), (None, prose("d"))]
    docs = frame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, sf).collect()]
    assert len(kept) == 4 and {(None, prose("b")), (2, prose("c")), (None, prose("d"))} < set(kept)
    docs = frame([(None, prose("a") + " " + passage(sf), "en", "s", 1), (None, prose("b"), "en", "s", 1)], SCHEMA)
    assert [r.text for r in corpus_pipeline.decontamination(spark, docs, sf).collect()] == [prose("b")]


def test_rows_that_repeat_an_id_stay_with_their_own_texts(spark, sf, frame):
    rows = [(1, prose("a")), (1, prose("b")), (1, prose("b")), (1, prose("b") + " more"), (2, prose("b")), (3, prose("c")), (3, prose("d")), (0, prose("d"))]
    docs = frame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, sf).collect()]
    assert {t[:3] for _, t in kept} == {"a0 ", "b0 ", "c0 ", "d0 "} and len(kept) == 4
    assert {(1, prose("a")), (3, prose("c")), (0, prose("d"))} < set(kept) and {d for d, t in kept if t[0] == "b"} == {1}


def test_columns_of_any_name_come_through(spark, sf, frame):
    names = ["gone", "again", "copy", "row key", "Row Key_", "group", "key", "gone key", "again key", "a place", "rejected host", "text.", "node", "place"]
    rows = [(1, prose("a")), (1, prose("a")), (2, prose("a")), (3, prose("b")), (4, prose("c") + " " + passage(sf))]
    schema = ", ".join(f"`{n}` string" for n in names)
    docs = frame([(d, t, "en", "s", 1, *(f"{n} {d}" for n in names)) for d, t in rows], f"{SCHEMA}, {schema}")
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, function(spark, docs, sf)
        assert docs.columns == before, name
    got = sorted(tuple(r) for r in docs.collect())
    assert [(r[0], r[5:]) for r in got] == [(d, tuple(f"{n} {d}" for n in names)) for d in (1, 3)]
