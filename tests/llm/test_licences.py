import pyarrow.parquet as pq
import pytest

from cohortloom.llm import licences

#: What the licence lines of the test documents say.
LINES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
}


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(spark)


def test_documents(spark, model):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: [LINES[line] for line in r["text"].split("\n") if line in LINES] for r in rows}
    got = {r.doc_id: r for r in licences.digest(spark, "/root/testdata/sf0.01").collect()}
    assert any(want.values())
    for k, found in want.items():
        assert (got[k].n_licence_paragraphs, got[k].licences) == (len(found), ",".join(sorted(set(found)))), k


def test_held_out_lines(spark, frame, model):
    sample = licences.sample_lines(1500, 77)
    got = licences.scan(frame([(k, line) for k, (line, _) in enumerate(sample)], "doc_id long, text string"), model).collect()
    hit = sum(r.licences == ([] if f == licences.UNKNOWN else [f]) for r, (_, f) in zip(sorted(got, key=lambda r: r.doc_id), sample, strict=True))
    assert hit / len(sample) > 0.95


def test_edge_rows(spark, frame, model):
    long = "some words of prose " * 20000 + "\n" + "\n".join(LINES)
    rows = [(1, None, 0), (2, "", 0), (3, "\n \n", 0), (4, long, 0), (5, "Released under the MIT License.", 0), (5, "Released under the MIT License.", 0), (None, "a driver's license", 0)]
    got = licences.scan(frame(rows, "doc_id long, text string, licences int"), model).collect()
    assert [(r.doc_id, r.n_paragraphs, list(r.licences)) for r in got] == [
        (1, 0, []), (2, 0, []), (3, 0, []), (4, 5, sorted(LINES.values())), (5, 1, ["mit"]), (5, 1, ["mit"]), (None, 1, []),
    ]
    assert licences.scan(frame([], "doc_id long, text string"), model).count() == 0


#: Wordings that no template has, and what they say.
HELD_OUT = {
    "GNU General Public License, version 2": ["gpl-2.0"],
    "It is covered by the GNU Lesser General Public License, version 3": ["lgpl-3.0"],
    "Everything here is licensed under the Apache License, Version 1.1.": [],
    "Licensed under the Apache License, Version 1.1.": [],
    "The tool was written in a hurry over two summers and then forgotten by its makers. Released under the MIT License. It reads maps and writes lists of the places "
    "found on them, in the order of their names, and it runs on all the usual machines of the time.": ["mit"],
    "All code in this folder is licensed under the GNU Affero General Public License, version 3, unless noted.": ["agpl-3.0"],
    "The photos are licensed under CC BY-NC-ND 4.0 by their owners.": ["cc-by-nc-nd-4.0"],
    "These notes are licensed under a Creative Commons Attribution-ShareAlike 4.0 International licence": ["cc-by-sa-4.0"],
    "This package is distributed under the ISC license": ["isc"],
    "The library is released under the BSD 2-Clause License, see the file": ["bsd-2-clause"],
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software": ["mit"],
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": [],
    "The mayor granted a license to the fishermen, version 3 of which was free of charge.": [],
    "He got his license from MIT and the general public was there.": [],
}


def test_held_out_wordings(spark, frame, model):
    got = licences.scan(frame(list(enumerate(HELD_OUT)), "doc_id long, text string"), model).collect()
    assert {list(HELD_OUT)[r.doc_id]: list(r.licences) for r in got} == HELD_OUT


def test_long_lines_find_every_sentence(spark, frame, model):
    filler = "the river runs past the old mill and the people walk along its banks in summer " * 300
    line = filler + "Licensed under CC BY 4.0. " + filler + "This project is licensed under the terms of the MIT license. " + filler
    got = licences.scan(frame([(1, line), (2, filler), (3, line + "\n" + line)], "doc_id long, text string"), model).collect()
    assert [(r.n_paragraphs, r.n_licence_paragraphs, list(r.licences)) for r in got] == [(1, 1, ["cc-by-4.0", "mit"]), (1, 0, []), (2, 2, ["cc-by-4.0", "mit"])]


def test_window_scores_equal_brute_force(spark, model):
    import numpy as np
    import pyarrow as pa

    from cohortloom.llm.words import ALPHANUMERIC, split_words

    lines = ["", "one", "two words", " ".join(f"w{k % 37}" for k in range(100)), "Released under the MIT License."]
    words, firsts = split_words(pa.array(lines, pa.large_string()), ALPHANUMERIC)
    starts, ends, line = licences.windows(firsts)
    assert set(line.tolist()) == {1, 2, 3, 4} and {p for s, e in zip(starts, ends) for p in range(s, e)} == set(range(len(words)))
    for s, e, got in zip(starts, ends, model.scores(words, starts, ends), strict=True):
        grams = np.concatenate([licences._numbers(words[s:e], n) for n in (1, 2, 3)])
        want = model.weights[:, grams].sum(1) / np.sqrt(max(len(grams), 1)) + model.bias
        assert np.allclose(got, want)
