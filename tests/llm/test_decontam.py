import hashlib
import re

import pyarrow.parquet as pq

from cohortloom.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        size = min(n, len(words))
        for i in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[i : i + size])):
                    found |= owners
                    hit |= set(range(i, i + size))
        yield doc, len(words), len(hit), sorted(found)


def rows(path, *columns):
    return [tuple(r.values()) for r in pq.read_table(path, columns=list(columns)).to_pylist()]


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in decontam.digest(spark, sf).collect()}
    want = {
        d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0)
        for d, n, h, i in brute(rows(f"{sf}/documents.parquet", "doc_id", "text"), rows(f"{sf}/benchmark.parquet", "item_id", "text"))
    }
    assert got == want and any(h for _, h, *_ in want.values())


def test_edge_rows(spark, frame):
    passage = "one two Three four five six seven eight nine ten eleven"
    docs = [
        (1, None), (2, ""), (3, " .,- "), (4, passage.upper()), (5, "x " * 5000 + passage + " y" * 5000), (6, "short item"), (6, "short item"),
        (None, passage), (7, "one two three four five six seven eight nine"), (8, "ten eleven"), (9, passage + " " + passage), (10, "Éa " + passage + "é"),
    ]
    items = [(1, passage), (2, passage), (3, "short, ITEM"), (4, None), (5, ""), (6, "..."), (12, "one two")]
    table = frame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, shard int, place int")
    got = decontam.decontaminate(table, frame(items, "item_id long, text string")).collect()
    want = sorted(((d, n, h, i) for d, n, h, i in brute(docs, items)), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_shards_blocks_and_empty_tables(spark, frame, monkeypatch):
    passage = " ".join(f"w{k}" for k in range(30))
    docs = [(k, f"a{k} {passage} b") for k in range(50)]
    table = frame(docs, "doc_id long, text string").repartition(2)
    items = frame([(k, " ".join(passage.split()[k : k + 12])) for k in range(10)], "item_id long, text string")
    index = decontam.store(decontam.build_index(table, shard_bytes=500))
    assert index.count() > 10
    whole = sorted(map(tuple, decontam.judge(index, decontam.search(index, items)).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 50)
    assert sorted(map(tuple, decontam.judge(index, decontam.search(index, items)).collect()), key=str) == whole
    assert {r[2] for r in whole} == {21}
    assert decontam.decontaminate(table.limit(0), items).count() == 0
    assert [r.n_hit for r in decontam.decontaminate(table, items.limit(0)).collect()] == [0] * 50


def test_proximity(spark, frame):
    docs = frame([(1, "alpha x beta gamma"), (2, "alpha x x x beta gamma"), (3, "beta alpha gamma")], "doc_id long, text string")
    items = frame([(1, "alpha beta gamma")], "item_id long, text string")
    index = decontam.store(decontam.build_index(docs))
    assert {r.doc_id for r in decontam.search(index, items, slop=1).collect()} == {1, 3}
    assert decontam.search(index, items).count() == 0


def test_items_without_an_id_count(spark, frame):
    words = [f"w{k}" for k in range(24)]
    docs = frame([(1, " ".join(words[:12])), (2, " ".join(words)), (3, "other words")], "doc_id long, text string")
    items = frame([(None, " ".join(words[:12])), (5, " ".join(words[12:])), (None, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"]), r.contaminated) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: (12, [], True), 2: (24, ["5"], True), 3: (0, [], False)}
