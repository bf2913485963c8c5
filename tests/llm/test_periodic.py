import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from cohortloom.llm import periodic

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(ids):
    """All runs by trying every period at every place."""
    found = {}
    for q in range(1, len(ids) // 3 + 1):
        at = 0
        while at + q < len(ids):
            if ids[at] != ids[at + q]:
                at += 1
                continue
            end = at
            while end + q < len(ids) and ids[end] == ids[end + q]:
                end += 1
            if end + q - at >= max(24, 3 * q):
                found.setdefault((at, end + q - at), q)
            at = end
    return sorted((s, n, q) for (s, n), q in found.items())


def answer(text, doc_id):
    words = WORD.findall(text or "")
    chance = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if chance % 10 == 0 and words:
        g, n = chance // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return doc_id, len(found), *first, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in drop))


def test_query_equals_brute_force(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = sorted(tuple(r) for r in periodic.digest(spark, sf).collect())
    assert got == sorted(answer(r["text"], r["doc_id"]) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_transform_is_exact():
    generator = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        x, y = (generator.integers(0, periodic.PRIME, (3, size), dtype=np.uint64) for _ in range(2))
        product = periodic.restore(periodic.transform(x) * periodic.transform(y) % np.uint64(periodic.PRIME))
        for a, b, c in zip(x.tolist(), y.tolist(), product.tolist(), strict=True):
            assert c == [sum(a[j] * b[(k - j) % size] for j in range(size)) % periodic.PRIME for k in range(size)]


def test_seeds_are_the_occurrences_of_blocks():
    chance = random.Random(3)
    ids = np.array([chance.randrange(2) for _ in range(300)])
    for block, low, high in ((8, 1, 15), (16, 16, 31), (4, 1, 2)):
        want = {(s, q) for s in range(0, 300 - block, block) for q in range(low, high + 1) if s + q + block <= 300 and (ids[s : s + block] == ids[s + q : s + q + block]).all()}
        assert set(zip(*(v.tolist() for v in periodic.seeds(ids, block, low, high)), strict=True)) == want


def test_runs_of_random_sequences():
    chance = random.Random(7)
    for turn in range(400):
        ids = []
        while len(ids) < chance.choice((20, 60, 300)):
            kind = chance.randrange(4)
            part = [chance.randrange(chance.choice((1, 2, 3, 50))) for _ in range(chance.randrange(1, 30))]
            ids += part * chance.choice((1, 2, 3, 4, 9)) if kind else part
            if kind == 2:
                ids += part[: chance.randrange(len(part))]
        assert periodic.runs(np.array(ids)) == brute(ids), turn


def test_long_runs_and_long_texts():
    part = list(range(5000))
    assert periodic.runs(np.array([9999, *part * 4, 1, 2])) == [(1, 20000, 5000)]
    assert periodic.runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert periodic.runs(np.arange(200_000)) == []
    many = np.concatenate([np.concatenate([np.full(30, k), [10**6 + k]]) for k in range(3000)])
    assert periodic.runs(many) == [(31 * k, 30, 1) for k in range(3000)]


def test_edge_rows(spark, frame):
    texts = [None, "", " \n\t ", "a", "a " * 23, "a " * 24, "A a " * 12, "x y " * 11 + "x y x", "é漢 \U0001f600 ü\n" * 9, "b " * 7 + "a b c " * 9 + "a b d " * 8 + "tail"]
    rows = [(k, t, 1, "own") for k, t in enumerate(texts)]
    rows += rows[5:7] + [(None, "a b " * 30, 1, "own"), (5, "other words", 1, "own")]
    docs = frame(rows, "doc_id long, text string, runs int, collapsed string")
    got = periodic.find(docs).collect()
    want = []
    for k, t, *_ in rows:
        words = WORD.findall(t or "")
        found = brute(words)
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((k, len(words), found, " ".join(w for i, w in enumerate(words) if i not in drop)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert periodic.find(docs.limit(0)).count() == 0
