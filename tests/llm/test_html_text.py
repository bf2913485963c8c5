import random
import re
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest

from cohortloom.llm import html_text
from cohortloom.llm.dom import read


@pytest.fixture(scope="module")
def model(spark):
    return html_text.trees(spark)


def article(source):
    inner = re.search("(?s)<article>(.*?)</article>", source)[1]
    inner = re.sub("</?b>", "", inner).replace("<br>", " ")
    return "\n\n".join(t for t in (" ".join(unescape(b).split()) for b in re.split("</?(?:p|h1)>", inner)) if t)


def test_query_finds_the_articles(spark, sf, model):
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in html_text.digest(spark, sf).collect()}
    assert len(got) == len(rows)
    for row in rows:
        r = got[row["page_id"]]
        assert (r.url, r.text, r.n_chars) == (row["url"], article(row["html"]), len(r.text))


def test_held_out_pages(model):
    rng, right, wrong, missed = random.Random(99), 0, 0, 0
    for _ in range(150):
        page = read(html_text.sample_page(rng))
        told = html_text.labels(page)
        kept = html_text.decode(page, model.chance(html_text.node_features(page)))
        assert all(kept[n.parent] for n, k in zip(page.nodes[1:], kept[1:], strict=True) if k)
        for text, owner in zip(page.texts, page.owners, strict=True):
            right += len(text) * (kept[owner] and told[owner] == 1)
            wrong += len(text) * (kept[owner] and told[owner] == 0)
            missed += len(text) * (not kept[owner] and told[owner] == 1)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_decoding_weighs_the_whole_tree():
    page = read("<div><p>a</p><p>b</p></div>")
    choose = lambda *chance: html_text.decode(page, np.array([0.1, *chance]))
    assert choose(0.45, 0.99, 0.99) == [True, False, False, False]  # a drop settles all below
    assert choose(0.9, 0.99, 0.1) == [True, True, True, False]
    assert choose(0.6, 0.6, 0.9) == [True, True, False, True]  # doubts add up on the way down


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b", ["a", "b"]), ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<p>a <b>bold\n text</b>&nbsp;<br>c</p>", ["a bold text c"]), ("<script>var t='</p>';</script><style>p{}</style>x", ["x"]),
        ("<!-- <p>no</p> -->y<!-- open", ["y"]), ("<p title=\"a > b\">q</p>", ["q"]), ("<script>never closed <p>x", []), ("1 < 2 <3 & 4", ["1 < 2 <3 & 4"]),
        ("<div" * 3000, ["<div" * 3000]), ("<div>" * 3000 + "deep", ["deep"]), ("</div></p>t</b>", ["t"]), ("<head><title>t</title><body>u", ["u"]),
        ("<textarea><p>x</p></textarea><select><option>o</select>v", ["v"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ],
)
def test_reader(source, texts):
    assert read(source).texts == texts


def test_edge_rows(spark, frame, model):
    long = "<article>" + "<p>Some words of an article, and more of them.</p>" * 5000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "v", "<nav><a href=x>menu</a></nav>", 1), (4, "w", long, 1), (4, "w", long, 1), (None, "x", "<article><p>One paragraph of text.</p></article>", 1)]
    got = html_text.extract(frame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in got[:3]] == ["", "", ""] and got[5].text == "One paragraph of text."
    assert got[3].text == got[4].text == "\n\n".join(["Some words of an article, and more of them."] * 5000)
    assert html_text.extract(frame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("<html><head><title>x</title><p>Text", ["Text"]), ("<head><meta charset=a><link rel=b><noscript><img></noscript>Text", ["Text"]),
        ("<head><script>a</script><header>top</header>b", ["top", "b"]), ("<div><button>go</div><p>Text", ["Text"]),
        ("<ul><li>a<svg><g><path></li></ul>b", ["a", "b"]), ("<div><select><div>o</div></select>v</div>", ["v"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>", ["Let x=1 be."]),
        ("<p>a <object data=u>other</object> b</p>", ["a", "other", "b"]), ("<p>a <noscript><img src=u></noscript> b</p>", ["a b"]),
        ("<noscript><p>plain</p></noscript><video src=u>old</video>", ["plain", "old"]),
    ],
)
def test_reader_hides_no_more_than_it_must(source, texts):
    assert read(source).texts == texts


def test_text_in_a_fallback_has_its_own_node():
    page = read("<p>a <object>b</object> c</p>")
    assert [page.nodes[k].tag for k in page.owners] == ["p", "object", "p"]


ARTICLE = "<article><h1>On rivers</h1><p>Rivers carry water from the hills to the sea. They shape the land on their way.</p><p>Some of them run dry in summer. Others flood the fields each spring.</p></article>"
SKIP, RIGHTS = '<a href="#content">Skip to content</a>', "&copy; 2024 Corp. All rights reserved."
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"


@pytest.mark.parametrize(
    "layout",
    [
        "<html><body>{skip}{nav}{article}{rights}</body></html>", "{skip}{nav}{article}{rights}", "<body><div class=wrap>{skip}{nav}{article}{rights}</div></body>",
        "<body>{nav}{skip}<main>{article}</main>{rights}</body>", "<div id=page><div>{nav}</div>{article}<div>{rights}</div></div>",
    ],
)
def test_lines_beside_blocks_are_chosen_like_blocks(model, layout):
    html = layout.format(skip=SKIP, nav=NAV, article=ARTICLE, rights=RIGHTS)
    (text,) = html_text.main_texts(model, [html])
    assert "Skip" not in text and "rights" not in text and "Home" not in text
    assert text.startswith("On rivers\n\nRivers carry water") and text.endswith("each spring.")


def test_a_page_of_plain_text_is_its_text(model):
    plain = "Rivers carry water from the hills to the sea. They shape the land on their way, and some of them run dry in summer."
    assert list(html_text.main_texts(model, [plain, f"<html><body>{plain}</body></html>"])) == [plain, plain]


def test_texts_beside_blocks_have_nodes_of_their_own():
    page = read("<body>a<div>b<p>c</p>d</div><p>e <b>f</b></p>g</body>")
    assert [(page.nodes[k].tag, page.nodes[page.nodes[k].parent].tag, t) for k, t in zip(page.owners, page.texts, strict=True)] == [
        ("#text", "body", "a"), ("#text", "div", "b"), ("p", "div", "c"), ("#text", "div", "d"), ("p", "body", "e f"), ("#text", "body", "g"),
    ]
    assert all(n.parent < k for k, n in enumerate(page.nodes)) and [page.nodes[k].runs for k in page.owners] == [[k] for k in range(6)]


def test_long_odd_pages_take_seconds():
    import time

    n, start = 200_000, time.perf_counter()
    assert read("<div>" * n + "deep").texts == ["deep"]
    assert read("<div" * n).texts == ["<div" * n]
    assert read("<p><table><td>" + "<div>" * n + "x" + "</div>" * n).texts == ["x"]
    assert read("<svg>" + "<g>" * n + "</g>" * n + "</svg>y").texts == ["y"]
    assert read("<ul>" + "<li>z" * n).texts == ["z"] * n
    assert read("</div>" * n + "<!" * 1000 + "w").texts in (["w"], [])
    assert time.perf_counter() - start < 60
