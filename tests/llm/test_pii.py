import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from cohortloom.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if right(kind, m[0])]
    return [(kind, start, stop) for start, _, stop, kind in sorted(spans)]


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query_equals_brute_force(spark, sf):
    want = {r["doc_id"]: brute(r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = pii.digest(spark, sf).collect()
    assert len(got) == len(want) and any(want.values())
    for r in got:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in KINDS]
        assert set(told(base).split(",")) <= set(r.spans.split(","))


def test_patterns_on_noise_and_long_runs(spark, frame):
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", "..", ".", "x@y.z", "_", "-", " ", "  ", "+", "(", ")", "1", "25", "255", "256", "1.2.3.4", "4387513035237269", "4111 1111 1111 1111", "é", "\U0001f600", "\n", "+1 (724) 555-7058", "%d@e.f", "a@b.c_d@e.f"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    texts += [None, "", "a" * 100000, "1" * 100000, "1 " * 50000, "1." * 50000, "+" * 50000, "a@" * 30000, "a." * 50000 + "@b.c", "000001.2.3.255 0.0.0.256", "@b.c", "+" + "1" * 40]
    table = frame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = table.select("doc_id", pii.listed(pii.pattern_spans(table["text"])).alias("s")).collect()
    for r in got:
        assert r.s == told(brute(texts[r.doc_id])), texts[r.doc_id][:200]


def corpus():
    rows = [f"plain line number {'abcdefgh'[k % 8]} of text\nanother line to call about rain" for k in range(60)]
    rows += [f"call Zorblatt about {w} at z@corp.example.com\nmore on {w}, the line" for w in ("rain", "snow", "wind", "sun", "hail")]
    rows[-1] += "\nZorblatt"
    rows[-2] += "\nZORBLATT,"
    return [(k, t, "x") for k, t in enumerate(rows)]


def test_terms_that_disclose_an_entity(spark, frame):
    docs = frame(corpus(), "doc_id long, text string, found string")
    got = {r.doc_id: [(s.kind, s.value) for s in r.found] for r in pii.detect(docs, evidence=8).collect()}
    assert all(not got[k] for k in range(60))
    found = {v.lower() for k in range(60, 65) for kind, v in got[k] if kind == "term"}
    assert "zorblatt" in found and "line" not in found and "rain" not in found
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, evidence=8).collect()}
    assert pii.sanitise(docs).columns == docs.columns
    assert all(clean[k] == t for k, t, _ in corpus()[:60])
    assert all("orblatt" not in clean[k] and "<EMAIL>" in clean[k] and "more on" in clean[k] for k in range(60, 65))


def test_copies_of_a_line_are_no_support(spark, frame):
    rows = [(k, "same Zorblatt at z@corp.example.com") for k in range(50)] + [(99, "other")]
    got = pii.detect(frame(rows, "doc_id long, text string"), evidence=1).collect()
    assert all([s.kind for s in r.found] == (["email"] if r.doc_id < 99 else []) for r in got)


def test_edge_rows(spark, frame):
    rows = [(1, None), (2, ""), (3, "a@b.cd " * 400), (4, "a@b.cd"), (4, "a@b.cd"), (None, "x a@b.cd")]
    docs = frame([(d, t, 5) for d, t in rows], "doc_id long, text string, terms int")
    got = pii.detect(docs).collect()
    assert sorted((str(r.doc_id), len(r.base)) for r in got) == sorted((str(d), len(brute(t))) for d, t in rows)
    clean = sorted(((str(r.doc_id), r.text) for r in pii.sanitise(docs).collect()), key=str)
    assert clean == sorted([("1", None), ("2", ""), ("3", "<EMAIL> " * 400), ("4", "<EMAIL>"), ("4", "<EMAIL>"), ("None", "x <EMAIL>")], key=str)
    assert pii.detect(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_overlapping_spans_are_replaced_once(spark, frame):
    docs = frame([(1, "see +1.2.3.4.5678 or 4111 1111 1111 1111.")], "doc_id long, text string")
    assert "1111" not in pii.sanitise(docs).first().text


def disclosing(texts):
    """{(entity, term): disclosure} by the definition, at the module's parameters."""
    n_term, n_entity, found, total = Counter(), Counter(), defaultdict(list), 0
    for text in texts:
        lines = text.split("\n")
        total += len(lines)
        for i, line in enumerate(lines):
            terms = {t.lower() for t in re.findall(r"[^\W\d_]{3,}", line)}
            entities = {f"{k}:{line[a:b]}" for k, a, b in brute(line)}
            n_term.update(terms)
            n_entity.update(entities)
            for e in entities:
                for t in terms:
                    found[e, t].append((i == 0, tuple(lines[max(i - 1, 0) : i + 2])))
    told = {}
    for (e, t), places in found.items():
        content, kinds = -math.log2(n_entity[e] / total), len(set(places))
        if content > 0 and content * (len(places) if kinds >= pii.SUPPORT else kinds) >= pii.EVIDENCE:
            told[e, t] = math.log2(len(places) / n_entity[e] * total / n_term[t]) / content
    return {p: d for p, d in told.items() if d >= pii.GENERALISED}


def test_terms_at_the_module_parameters(spark, frame):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("rain", "line", "tree", "moor") for b in ("ing", "ful", "less", "ward", "most", "hood")]
    prose = lambda: " ".join(rng.choices(vocabulary, k=4))
    texts = ["\n".join(prose() for _ in range(20)) for _ in range(150)]
    for _ in range(9):
        texts.append(f"{prose()}\nZorblatt {prose()} z@corp.example.com\n{prose()}")
        texts.append(f"{prose()}\ncontact Quixley q@corp.example.com\n{prose()}")  # one line, word for word
        texts.append("copy Vandermere v@corp.example.com\nend")  # one whole text
    want = disclosing(texts)
    docs = frame(list(enumerate(texts)), "doc_id long, text string")
    slim = docs.select("text")
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosures(slim, slim).collect()}
    assert got == pytest.approx(want)
    assert {t for _, t in want} >= {"zorblatt", "quixley"} and "vandermere" not in {t for _, t in want}
    clean = "\n".join(r.text for r in pii.sanitise(docs).collect())
    assert "Zorblatt" not in clean and "Quixley" not in clean and "Vandermere" in clean


def test_spans_come_from_the_row_s_own_text(spark, frame):
    texts = [(k % 3, t) for k, t in enumerate(t for _, t, _ in corpus())] + [(0, "hi a@b.cd"), (0, "Zorblatt alone"), (None, "call Zorblatt about fog at z@corp.example.com"), (None, "x")]
    docs = frame(texts, "doc_id long, text string")
    got = sorted((str(r.doc_id), tuple((s.kind, s.start, s.stop, s.value) for s in r.found)) for r in pii.detect(docs, evidence=8).collect())
    alone = frame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    by_row = {r.doc_id: tuple((s.kind, s.start, s.stop, s.value) for s in r.found) for r in pii.detect(alone, evidence=8).collect()}
    assert got == sorted((str(d), by_row[k]) for k, (d, _) in enumerate(texts))
    for k, (_, text) in enumerate(texts):
        assert all(text[a:b] == v for _, a, b, v in by_row[k])
    clean = [r.text for r in pii.sanitise(docs, evidence=8).collect()]
    assert "hi <EMAIL>" in clean and "Zorblatt alone" in clean and not any("orblatt" in t and "<EMAIL>" in t for t in clean)
