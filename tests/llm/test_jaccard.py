import random
import re
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortloom.llm import jaccard
from cohortloom.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, n, share):
    sets = [(d, shingles(t, n)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = {}
    for d, s in sets:
        for g in s:
            owners.setdefault(g, []).append(d)
    by = dict(sets)
    near = {(a, b) for o in owners.values() if len(o) > 1 for a in o for b in o if a < b}
    for a, b in near:
        common = len(by[a] & by[b])
        if share.denominator * common >= share.numerator * (len(by[a]) + len(by[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r.values()) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    want = brute(docs, 4, Fraction(85, 100))
    assert got(jaccard.digest(spark, sf)) == want and any(d != c for d, (_, c) in want.items())


@pytest.mark.parametrize(("n", "share"), [(4, Fraction(85, 100)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_random_edits_around_the_threshold(spark, frame, n, share):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for family in range(25):
        size = rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 40, 90, 250])
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at], rng.choice(vocabulary)]])
                words = words or ["w0"]
            docs.append((len(docs), " ".join(words)))
    assert got(jaccard.classes(frame(docs, "doc_id long, text string"), words=n, share=share)) == brute(docs, n, share)


def test_edge_rows(spark, frame):
    long = " ".join(f"x{k % 900}" for k in range(30000))
    docs = [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (9, "oNE\ttwo"), (10, "one two three"), (11, long), (12, long.upper()), (13, "one two")]
    table = frame([(d, t, 0) for d, t in docs] + [(13, "one two", 0), (None, "one two", 0)], "doc_id long, text string, component_id int")
    rows = jaccard.classes(table, words=4, share=Fraction(85, 100)).collect()
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id} == brute(docs, 4, Fraction(85, 100))
    assert len(rows) == 11 and jaccard.classes(table.limit(0)).count() == 0


def test_components_of_a_long_chain_a_star_and_loops(spark, frame):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(7, 7), (None, 3), (900, 899)]
    got = {r.node: r.component for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 50)}, 900: 899, 899: 899}
    assert components(frame([], "a long, b long")).count() == 0


def test_lists_are_dealt_to_more_tasks_than_the_session_has(spark, frame, monkeypatch):
    counts = []
    written = jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df: (counts.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())), written(df))[1])
    docs = frame([(k, f"one two three four five {k % 2}") for k in range(40)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.classes(docs, words=2, share=Fraction(1, 2)).collect()} == {0}
    plans = [plan for columns, plan in counts if columns == ["list", "node", "size"]]
    asked = jaccard.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(plans) == 1 and re.search(rf"RepartitionByExpression \[list#\d+L?\], {asked}", plans[0])


def test_a_task_takes_small_slices_of_texts_apart():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 1000 + ["y" * 10**6])], ["text"])
    sizes = [[len(t) for t in texts.to_pylist()] for _, texts in jaccard.slices([batch], "text", jaccard.SLICE)]
    assert sum(len(s) for s in sizes) == 1001 and all(sum(s) <= 1 << 18 or len(s) == 1 for s in sizes)


def test_a_text_without_an_id_links_others(spark, frame):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words), " ".join([*words[4:], *"abcd"]), " ".join([*words[8:], *"abcdefgh"])]
    docs = frame([(1, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2])], "doc_id long, text string")
    rows = jaccard.classes(docs, words=1, share=Fraction(4, 5)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows if r.doc_id) == [(1, 1), (3, 1)]
    assert [r.component_id for r in rows if not r.doc_id] == [None, None]
