import random
import re
from collections import Counter

import duckdb

from cohortloom.llm import collocations


def brute(rows, support=30, longest=4, cover=80):
    """(lang, phrase, a, l, r, n, score) of all phrases, plainly counted."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {g: n for g, n in counts.items() if n >= support and len(g[1]) > 1}
    covered = set()
    for (lang, g), n in frequent.items():
        for i in range(len(g)):
            for j in range(i + 2, len(g) + 1):
                if j - i < len(g) and 100 * n >= cover * counts[lang, g[i:j]]:
                    covered.add((lang, g[i:j]))
    found = []
    for (lang, g), a in frequent.items():
        if (lang, g) not in covered:
            cuts = [(2_000_000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((lang, " ".join(g), a, counts[lang, g[:k]], counts[lang, g[k:]], total[lang], score))
    return sorted(found)


def got(df):
    return sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    want = brute(rows)
    assert len(want) > 30
    answer = collocations.digest(spark, sf)
    ranked = {}
    for r in sorted(want, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        ranked.setdefault(r[0], []).append((r[0], len(ranked.get(r[0], [])) + 1, *r[1:]))
    assert sorted(tuple(r) for r in answer.collect()) == sorted(x for v in ranked.values() for x in v[:2000])
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert sorted(duck.execute(collocations.SQL).fetchall()) == sorted(tuple(r) for r in answer.collect())


def _corpus(seed, rows):
    chance = random.Random(seed)
    phrases = ["alpha beta", "red green blue", "one two three four five", "x x x", "New York City", "é ü 漢"]
    made = []
    for _ in range(rows):
        parts = [chance.choice(phrases) if chance.random() < 0.3 else f"w{int(chance.paretovariate(0.7)) % 300}" for _ in range(chance.randrange(60))]
        made.append((chance.choice(["en", "de", None]), "".join(p + chance.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for p in parts)))
    return made


def test_whatever_the_sample_proposes(spark, frame):
    rows = _corpus(5, 400)
    docs = frame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    want = brute(rows, 20)
    assert any(len(r[1].split()) == 4 for r in want)
    for sample in (1, 8, 10**6):  # everything, some rows and (nearly) none
        assert got(collocations.mine(docs, support=20, sample=sample)) == want


def test_failures_of_the_border_lead_to_further_passes(spark, frame, monkeypatch):
    passes = []
    count = collocations.count_phrases
    monkeypatch.setattr(collocations, "count_phrases", lambda *a, **k: passes.append(len(a)) or count(*a, **k))
    rows = [("en", "one two three four")] * 40
    docs = frame(rows, "lang string, text string")
    assert got(collocations.mine(docs, sample=10**6)) == brute(rows)
    assert passes.count(3) == 2  # words in threes, then in fours


def test_edge_rows(spark, frame):
    rows = [("en", None), ("en", ""), (None, " \t\n"), ("en", "a b " * 5000), ("en", "A B"), ("de", "a b. " * 40), ("und", "c d, " * 40), (None, "c d\x0b" * 3), ("en", "a.b!a?b:a;b\ra\x0cb\nx"), ("fr", "one")] + [("es", "solo dos")] * 31
    docs = frame([(None, t, lang, "clash", 1) for lang, t in rows], "doc_id long, text string, lang string, phrase string, n int")
    assert got(collocations.mine(docs)) == brute(rows)
    assert collocations.mine(docs.limit(0)).count() == 0
    tied = frame([("en", f"{x} {y}. " * 30) for x, y in (("b", "c"), ("a", "z"), ("ä", "q"))], "lang string, text string")
    assert [r.phrase for r in collocations.best(collocations.mine(tied), 2).orderBy("rank").collect()] == ["a z", "b c"]
