import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from cohortloom.llm import bpe, token_counts
from cohortloom.llm.pretokens import PATTERN

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "it's  we'll\n\n x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|", "½ Ⅷ ² 漢字\x1c\x85\xa0　 é́", "a" * 3000, "ab " * 2000, "\0\r\n\t"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(sf):
    return pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def noise(count, seed=3):
    rng = random.Random(seed)
    pool = "abcdefgh  \n\t'stre123.,;<>|éèñß漢字かतமিж²½Ⅷ\x1c\x85\xa0\U0001f600́"
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(count)]


def test_pattern_is_the_published_one():
    assert PATTERN == public_tokenizers.PATTERN


def test_ids_equal_the_library(library):
    encode = bpe.encoder(PATH)
    for text in [*ODD, *noise(4000)]:
        assert encode(text) == np.array(library.encode_ordinary(text), "<u4").tobytes(), text


def test_query_equals_the_library(spark, sf, library):
    want = {}
    for row in texts(sf):
        ids = library.encode_ordinary(row["text"] or "")
        want[row["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.digest(spark, sf).collect()} == want


def test_null_empty_repeated_and_clashing(spark, frame):
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, "same é", 6, None), (3, "same é", 6, None), (None, "b" * 20000, None, "y")]
    table = frame(rows, "doc_id long, text string, ids int, decoded string")
    back = bpe.decode(bpe.encode(table, PATH), PATH).collect()
    assert [bytes(r.decoded).decode() for r in back] == ["", "", "same é", "same é", "b" * 20000]
    assert [r.doc_id for r in back] == [1, 2, 3, 3, None] and len(back[0].ids) == 0
    assert bpe.encode(table.limit(0), PATH).count() == 0


def counts(names):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in names]


def test_counts_equal_the_library(spark, sf, frame):
    rows = texts(sf)
    want = dict(zip([r["doc_id"] for r in rows], counts([r["text"] for r in rows]), strict=True))
    got = token_counts.digest(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    odd = [None, *ODD, *noise(1500, 4)]
    table = frame([(k, t, "c") for k, t in enumerate(odd)], "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(table, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == counts(odd)
    assert {r.doc_id: r.n_bytes for r in got} == {k: len((t or "").encode()) for k, t in enumerate(odd)}
    assert token_counts.count_tokens(table.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_frequent_words_cover_all_rows(spark, frame):
    table = frame([(k, "often " * 30 + f"rare{k}") for k in range(200)], "doc_id long, text string").repartition(5)
    assert token_counts.frequent_words(table.select("text"), share=0.1).collect() == [("often", 6000)]
