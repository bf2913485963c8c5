import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import hmm

WORD = re.compile("[^\x20\x09-\x0d]+")
LEARNS = "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(rows):
    """(doc_id, held_out, n_tokens, n_known, N) and the plain score of each row."""
    part = [None if i is None else zlib.crc32(str(i).encode()) % 10 for i, _ in rows]
    counts = Counter()
    for p, (_, text) in zip(part, rows, strict=True):
        if p:
            counts.update([*lowered(text), None])
    n, v = sum(counts.values()), len(counts)
    return [
        ((i, p == 0, len(w), sum(counts[x] > 0 for x in w), n), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        for p, (i, text) in zip(part, rows, strict=True) for w in [[*lowered(text), None]]
    ]


def test_query_equals_brute_force_and_beats_the_plain_model(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = sorted(hmm.digest(spark, sf).collect())
    want = sorted(base(rows))
    assert [tuple(r)[:5] for r in got] == [w[0] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[1] for w in want], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert len(held) > 5 and sum(r.score for r in held) > sum(r.base_score for r in held)


def _tiny(states=2, size=5):
    generator = np.random.default_rng(4)
    draw = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(generator.random(shape) + 0.1)
    return hmm.Model(draw(states), draw(states, states), draw(states, size).T.copy())


def paths(model, seen):
    """The chance of a sequence and the expected counts, over all paths of states."""
    states = len(model.start)
    total, first, moves, each = 0.0, np.zeros(states), np.zeros((states, states)), np.zeros((len(seen), states))
    for path in itertools.product(range(states), repeat=len(seen)):
        chance = model.start[path[0]] * math.prod(model.emit[o, s] for o, s in zip(seen, path, strict=True))
        chance *= math.prod(model.move[a, b] for a, b in zip(path, path[1:], strict=False))
        total += chance
        first[path[0]] += chance
        for t, s in enumerate(path):
            each[t, s] += chance
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += chance
    return total, first / total, moves / total, each / total


def test_recursions_equal_the_sum_over_all_paths():
    model, chance = _tiny(3), random.Random(2)
    seqs = [[chance.randrange(5) for _ in range(n)] for n in (1, 6, 2, 6, 4)]
    seen, firsts = np.array(sum(seqs, []), np.int32), np.cumsum([0, *map(len, seqs)])
    told = [paths(model, s) for s in seqs]
    assert hmm.log_chances(model, seen, firsts) == pytest.approx([math.log10(t[0]) for t in told])
    first, moves, each, total = hmm.expected_counts(model, seen, firsts, np.ones(5, bool))
    assert total == pytest.approx(sum(math.log10(t[0]) for t in told))
    assert first == pytest.approx(sum(t[1] for t in told)) and moves == pytest.approx(sum(t[2] for t in told))
    by_token = np.concatenate([t[3] for t in told])
    assert each == pytest.approx(np.array([[by_token[seen == o, k].sum() for k in range(3)] for o in range(5)]))
    assert np.isfinite(hmm.log_chances(model, np.tile(seen, 20_000), np.array([0, 20_000 * len(seen)]))).all()


def _trained(docs, **options):
    rows = hmm.read(docs, LEARNS)
    counted = hmm.stage(hmm.count_words(rows.where("learns")))
    known = hmm.lexicon(counted)
    seen = hmm.stage(hmm.observe(rows, known))
    return rows, counted, known, seen, *hmm.train(seen, known, **options)


def _texts(n):
    chance = random.Random(9)
    one, two = [f"a{k}" for k in range(20)], [f"b{k}" for k in range(20)]
    made = []
    for _ in range(n):
        words, kind = [], chance.choice((one, two))
        for _ in range(chance.randrange(1, 60)):
            kind = kind if chance.random() < 0.95 else (two if kind is one else one)
            words.append(chance.choice(kind))
        made.append(" ".join(words))
    return made


def test_every_round_gains_and_parts_make_no_difference(spark, frame):
    docs = frame([(k, t) for k, t in enumerate(_texts(300))], "doc_id long, text string").repartition(3)
    _, counted, known, seen, model, chances = _trained(docs, states=4, rounds=8)
    assert all(b > a for a, b in zip(chances[1:], chances[2:], strict=False))
    other, again = hmm.train(hmm.stage(seen.repartition(7)), known, 4, 8)
    assert again == pytest.approx(chances, rel=1e-6) and other.move == pytest.approx(model.move, rel=1e-3)
    assert model.move.sum(1) == pytest.approx(np.ones(4)) and model.emit.sum(0) == pytest.approx(np.ones(4))
    got = hmm.score(seen, counted, known, model).where("not learns").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 10 and got[0] > got[1] + 0.15 * got[2] * 10


def test_chances_of_all_tokens_add_up(spark, frame):
    docs = frame([(1, "x y y zing sing ring " + "w " * 50), (2, "zing a b c thing"), (3, "")], "doc_id long, text string")
    rows = hmm.read(docs, "true")
    counted = hmm.stage(hmm.count_words(rows))
    known = hmm.lexicon(counted)
    counts = {r.word: (r.ending, r.n) for r in counted.collect()}
    assert known.total == 64 and known.distinct == len(counts) and counts[hmm.END] == (-1, 3)
    # Own observations and the classes are all there is; inside a class the words and the unseen one add up.
    model = hmm.first_model(known, 3)
    assert model.emit.sum(0) == pytest.approx(np.ones(3))
    assert known.observed.sum() == known.total


def test_rare_words_meet_their_counts_in_the_join(spark, frame, monkeypatch):
    """The same scores, whichever words the tasks know."""
    docs = frame([(k, t + (" rare" + str(k % 7) if k % 3 else " once" + str(k))) for k, t in enumerate(_texts(60))], "doc_id long, text string")
    monkeypatch.setattr(hmm, "OWN", 40)
    told = []
    for size in (1 << 20, 40):
        monkeypatch.setattr(hmm, "KNOWN", size)
        _, counted, known, seen, model, _ = _trained(docs, states=2, rounds=2)
        told.append((len(known.words), sorted(tuple(r) for r in hmm.score(seen, counted, known, model).collect())))
    assert told[0][0] > told[1][0]
    for a, b in zip(told[0][1], told[1][1], strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


def test_edge_rows(spark, frame):
    texts = [None, "", " \n\t", "A a", "x", "long " * 5000 + "tail", "é 漢 \U0001f600", "a b"]
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    rows += rows[3:5] + [(None, "null id", 1), (3, "another text", 1)]
    docs = frame(rows, "doc_id long, text string, n_tokens int")
    scored, known, _ = hmm.fit_and_score(docs, LEARNS, states=3, rounds=2)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, known.total), r.base_score, r.score) for r in scored.where("doc_id is not null").collect())
    want = sorted(((w[0][0], *w[0][2:]), w[1]) for w in base([r[:2] for r in rows]) if w[0][0] is not None)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])
    assert all(math.isfinite(g[2]) and g[2] < 0 for g in got)
    assert scored.where("doc_id is null").count() == 1
    assert hmm.fit_and_score(docs.limit(0), LEARNS)[0].count() == 0
    unlearned = hmm.fit_and_score(docs, "false")[0].collect()
    assert len(unlearned) == len(rows) and all(r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in unlearned)
