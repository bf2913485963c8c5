import re
from collections import Counter

import pyarrow.parquet as pq

from cohortloom.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_query_equals_brute_force(spark, sf):
    want = {r["doc_id"]: brute(r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = quality.digest(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == want
    assert any(r.n_repeat_words for r in got) and any(r.n_dup_lines for r in got) and any(r.n_symbols for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_edge_rows(spark, frame):
    texts = [
        None, "", " \n\n\t", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 9, "a " * 8, "x " * 3000 + "end", "é漢\U0001f600 ü\n\né漢\U0001f600 ü\n x",
        " ".join(f"w{k % 40}" for k in range(4000)), "a\n" * 50, "#*$%&|<> # a\x0bb\x0cc\rd", "w " * 4 + " ".join(map(str, range(30))) + " w w w w",
    ]
    rows = [(k, t, None, "words") for k, t in enumerate(texts)]
    rows += rows[3:5]
    got = quality.judge(frame(rows, "doc_id long, text string, source string, n_words string")).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted((k, *brute(t)) for k, t, *_ in rows)
    assert quality.judge(frame([], "doc_id long, text string, source string")).count() == 0


GOOD, BAD = " ".join(f"word{k}" for k in range(30)), "too short"


def test_hosts_fall_only_with_evidence(spark, frame):
    rows = [(h, BAD if k < bad else GOOD) for h, n, bad in (("a", 60, 1), ("b", 50, 2), ("c", 40, 38), ("small", 1, 1), (None, 40, 39)) for k in range(n)]
    docs = frame([(i, t, h, 0, 0.5) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, host int, rate double")
    verdicts = {r.host: r for r in quality.host_verdicts(docs.selectExpr("source as host", f"text = '{BAD}' as base_failed")).collect()}
    assert {h for h, r in verdicts.items() if r.rejected} == {"c"}
    assert verdicts["small"].rate < 1 and verdicts["a"].failures == 1
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    assert kept == {i for i, (h, t) in enumerate(rows) if h != "c" and t == GOOD}
    left = quality.keep(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept
    assert quality.keep(docs.limit(0)).count() == 0
