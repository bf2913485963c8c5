"""Main text of web pages: boosted trees over the block elements of each page, decoded along the tree.

Each block element, and each text that stands beside block elements or directly in the body, gets features of its
subtree (text and link density), its tag and attribute tokens, its depth and its siblings. Gradient-boosted trees, trained here on labelled pages of many layouts that ``sample_page``
writes, give the probability that it holds main text if its parent does. Decoding
multiplies these from the root down, so ancestors and descendants never contradict.

Defined cases: null and empty html have an empty text. Rows are read one by one, whatever their ids.
Nothing is cut, however long. Only the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.dom import BARE, FRAME, Page, read
from cohortloom.llm.words import slices

SAMPLE_PAGES, SEED = 1500, 7  # the labelled pages that the trees are fitted on
TREES, DEPTH, STEP = 50, 5, 0.3

ARTICLE = {"article", "main"}
TAGS = [
    {"nav", "menu"}, {"footer"}, {"header"}, {"aside"}, {"form", "fieldset"}, ARTICLE, {"section"}, {"div"}, {"p", "blockquote", "pre"},
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tbody", "tr", "td", "th"}, {"body", "html", "#page"}, {BARE},
]
MARK = "\ue000"  # begins main text of sample pages that has no element of its own
SECTIONS = 6  # the first of these also count as ancestors
FAMILIES = [
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "links", "pagination", "pager", "toc", "tabs"},
    {"foot", "footer", "copyright", "legal", "bottom", "contentinfo"}, {"head", "header", "masthead", "top", "topbar", "logo", "brand"},
    {"side", "sidebar", "aside", "related", "recommended", "widget", "rail", "more", "complementary", "popular", "trending"},
    {"ad", "ads", "adv", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "outbrain"},
    {"comment", "comments", "reply", "replies", "discussion", "disqus", "feedback", "reader"},
    {"cookie", "cookies", "notice", "consent", "alert", "popup", "modal", "gdpr", "warning", "message", "toast"},
    {"form", "search", "login", "signup", "newsletter", "subscribe", "share", "social", "subscription"},
    {"content", "article", "post", "entry", "story", "body", "text", "main", "page", "blog", "news"},
]


def node_features(page: Page) -> np.ndarray:
    """One row for each node."""
    nodes, n = page.nodes, len(page.nodes)
    chars, linked, runs, words, stops, size, paragraphs = (np.zeros(n) for _ in range(7))
    own, rights, holds = np.zeros(n), np.zeros(n), np.zeros(n)
    first = np.full(n, len(page.texts), float)
    for k, (text, owner, links) in enumerate(zip(page.texts, page.owners, page.linked, strict=True)):
        own[owner] += len(text)
        linked[owner] += links
        runs[owner] += 1
        words[owner] += text.count(" ") + 1
        stops[owner] += text.count(".") + text.count("!") + text.count("?") + text.count("。")
        rights[owner] += "©" in text[:40]
        first[owner] = min(first[owner], k)
    chars += own
    depth, order, children = np.zeros(n), np.zeros(n), np.zeros(n)
    tags, family = np.zeros((n, len(TAGS))), np.zeros((n, len(FAMILIES)))
    above, within = np.zeros((n, len(FAMILIES))), np.zeros((n, SECTIONS))
    for i, node in enumerate(nodes):
        size[i] += 1
        paragraphs[i] += node.tag == "p"
        for t, group in enumerate(TAGS):
            if node.tag in group:
                tags[i, t] = 1
                break
        holds[i] = node.tag in ARTICLE
        tokens = node.tokens()
        for f, group in enumerate(FAMILIES) if tokens else ():
            family[i, f] = any(t in group for t in tokens)
        if i:
            p = node.parent
            depth[i] = depth[p] + 1
            order[i] = children[p]
            children[p] += 1
            above[i] = np.maximum(above[p], family[p])
            within[i] = np.maximum(within[p], tags[p, :SECTIONS])
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for sums in (chars, linked, runs, words, stops, size, paragraphs, rights, holds):
            sums[p] += sums[i]
        first[p] = min(first[p], first[i])
    parent = np.array([max(node.parent, 0) for node in nodes])
    siblings = children[parent]
    siblings[0] = 1
    before, after, last = np.zeros(n), np.zeros(n), {}
    for i in range(1, n):
        if (elder := last.get(nodes[i].parent)) is not None:
            before[i], after[elder] = chars[elder], chars[i]
        last[nodes[i].parent] = i
    total = max(chars[0], 1.0)
    density = linked / np.maximum(chars, 1)
    columns = [
        np.log1p(chars), chars / total, np.log1p(own), own / np.maximum(chars, 1), density, density[parent], chars / size, words / np.maximum(runs, 1),
        stops / np.maximum(words, 1), np.log1p(paragraphs), np.log1p(size), np.minimum(depth, 30), order, siblings, order / siblings,
        np.log1p(before), np.log1p(after), chars / np.maximum(chars[parent], 1), chars[parent] / np.maximum(siblings, 1) / total, first / max(len(page.texts), 1),
        # A block apart from the article element of its page, and a block that is little more than a line of rights.
        np.minimum(holds, 1), np.full(n, min(holds[0], 1)), rights / np.maximum(runs, 1),
    ]
    return np.column_stack([*columns, tags, family, above, within])


def decode(page: Page, chance: np.ndarray) -> list[bool]:
    """Keep or drop of all nodes, with nothing kept below a dropped node.

    ``chance`` is that of a node whose parent is kept. Multiplied from the root down it is the chance
    of the node itself, which never grows on the way, so what is kept at one half is a tree.
    """
    whole = np.where([node.tag in FRAME for node in page.nodes], 1, chance)
    for i, node in enumerate(page.nodes[1:], 1):
        whole[i] *= whole[node.parent]
    return (whole >= 0.5).tolist()


class Trees:
    """Boosted trees as arrays, so that tasks score many nodes at once without a JVM."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: list[float]):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> Trees:
        made = []
        for tree in model.trees:
            feature, threshold, left, right, value = [], [], [], [], []
            todo = [tree._java_obj.rootNode()]
            at = 0
            while at < len(todo):
                node = todo[at]
                leaf = node.subtreeDepth() == 0
                feature.append(-1 if leaf else node.split().featureIndex())
                threshold.append(0.0 if leaf else node.split().threshold())
                value.append(node.prediction())
                left.append(at if leaf else len(todo))
                right.append(at if leaf else len(todo) + 1)
                if not leaf:
                    todo += [node.leftChild(), node.rightChild()]
                at += 1
            made.append((np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)))
        return cls(made, list(model.treeWeights))

    def chance(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        everyone = np.arange(len(rows))
        for weight, (feature, threshold, left, right, value) in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(rows), int)
            for _ in range(DEPTH):
                low = rows[everyone, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(low, left[at], right[at])
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def sample_page(rng: random.Random) -> str:
    """A page of a random layout. Blocks of main text have data-y="1"; all else is to be dropped."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: words(rng.randint(3, 22)).capitalize() + rng.choice("....?!")
    prose = lambda low, high: " ".join(sentence() for _ in range(rng.randint(low, high)))
    link = lambda n=2: f'<a href="/{word()}">{words(rng.randint(1, n))}</a>'

    def box(tags: list[str], names: list[str], inner: str) -> str:
        tag, name = rng.choice(tags), rng.choice([*names, *names, ""])
        name = name and rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}-{word()}"'])
        if tag == "div" and not name:
            name = f' class="{rng.choice(names)}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def marked(text: str, tag: str) -> str:
        if rng.random() < 0.25 and " " in text:
            head, _, rest = text.partition(" ")
            text = rng.choice([f"<b>{head}</b> {rest}", f"{head} {link()} {rest}", f"<em>{text}</em>", f"{head}<br>{rest}"])
        return f'<{tag} data-y="1">{text}</{tag}>'

    # Any block around the article may stand in a <div> that says nothing.
    wrapped = lambda block: f"<div>{block}</div>" if rng.random() < 0.15 else block
    items = lambda low, high, n=2: "".join(f"<li>{link(n)}</li>" for _ in range(rng.randint(low, high)))
    menu = lambda: box(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "breadcrumbs"], rng.choice([f"<ul>{items(2, 9)}</ul>", " | ".join(link() for _ in range(rng.randint(2, 7)))]))
    ad = lambda: box(["div", "div", "aside", "section"], ["ad", "advert", "ads", "sponsored", "promo", "banner"], rng.choice([prose(1, 3), link(6), f"<p>{prose(1, 3)}</p>"]))
    notice = lambda: box(["div", "section"], ["cookie", "notice", "consent", "alert"], f"<p>{prose(1, 3)}</p>{link()}")
    form = lambda: box(["form"], ["newsletter", "search", "login"], f"<p>{sentence()}</p><label>{word()}</label><input><button>{word()}</button>")
    side = lambda: box(["aside", "aside", "div"], ["sidebar", "related", "widget"], f"<h3>{words(2)}</h3>" + rng.choice([f"<ul>{items(2, 8, 7)}</ul>", f"<p>{prose(1, 4)}</p>", ad()]))
    foot = lambda: box(["footer", "footer", "div"], ["footer", "copyright", "legal"], rng.choice([f"&copy; {words(3)} &middot; {sentence()}", f"&copy; {word()}.example &middot; {prose(1, 2)}", f"<p>{prose(1, 3)}</p><ul>{items(1, 6)}</ul>", prose(1, 2)]))
    head = lambda: box(["header", "div"], ["header", "masthead", "top"], rng.choice([f"<h1>{words(2)}</h1>", f"<div>{words(2)}</div><p>{sentence()}</p>", link()]) + rng.choice(["", menu()]))

    def reader() -> str:
        body = "".join(f"<li><b>{word()}</b><p>{prose(1, 6)}</p></li>" if rng.random() < 0.5 else f"<div class=\"comment\"><p>{prose(1, 6)}</p></div>" for _ in range(rng.randint(1, 6)))
        return box(["section", "div"], ["comments", "discussion", "replies"], f"<h3>{words(2)}</h3>{body}" + rng.choice(["", form()]))

    def bare() -> str:
        """A line that a page puts beside its blocks."""
        return rng.choice([
            f'<a href="#{word()}">{words(rng.randint(2, 4))}</a>', f"&copy; {rng.randint(1990, 2030)} {words(rng.randint(1, 4))}. {sentence()}",
            f"&copy; {words(2)} {sentence()}", " | ".join(link() for _ in range(rng.randint(2, 6))), words(rng.randint(1, 4)), f"{words(2)}: {link()}", link(4),
        ])

    def article() -> str:
        parts = [marked(words(rng.randint(1, 10)), "h1")] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            kind = rng.random()
            if kind < 0.08:
                parts.append(f"{MARK}{prose(1, 6)}")
            elif kind < 0.11:
                parts.append(f"{bare()}<hr>")
            elif kind < 0.72:
                parts.append(marked(rng.choice([prose(1, 9), sentence(), words(rng.randint(1, 60)), " | ".join(words(1) for _ in range(30))]), "p"))
            elif kind < 0.8:
                parts.append(marked(words(3), rng.choice(["h2", "h3"])))
            elif kind < 0.87:
                parts.append(f"<ul>{''.join(marked(sentence(), 'li') for _ in range(rng.randint(1, 5)))}</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{marked(prose(1, 3), 'p')}</blockquote>")
            elif kind < 0.92:
                parts.append(f"<table><tr>{marked(words(2), 'td')}{marked(words(2), 'td')}</tr></table>")
            else:
                parts.append(rng.choice([ad, side, form])())
        body = "".join(parts)
        if rng.random() < 0.25:
            body = f"<div>{body}</div>"
        return box(["article", "article", "main", "div", "section"], ["content", "article", "post", "entry-content", "story-body", "main"], body)

    main = article()
    if rng.random() < 0.2:
        main = box(["main", "div"], ["content", "wrap", "page"], main + rng.choice(["", reader()]))
    if rng.random() < 0.1:
        main = ""  # a page without an article
    if rng.random() < 0.12:  # a page of plain paragraphs
        main = "<hr>".join(f"{MARK}{prose(1, 7)}" for _ in range(rng.randint(1, 6)))
    busy = rng.choice([0.0, 0.3, 0.5, 0.5])  # some pages are hardly more than their article
    around = [wrapped(f()) for f in (menu, ad, head, notice, form, bare, bare) if rng.random() < busy]
    rng.shuffle(around)
    after = [wrapped(f()) for f in (side, reader, ad, foot, foot, menu, bare, bare) if rng.random() < busy]
    # Lines without an element are set apart, so that they do not run into each other.
    whole = "<hr>".join([*around, main, *after])
    for _ in range(rng.choice([0, 0, 1, 2])):
        name = rng.choice(["wrap", "container", "page", "layout", word()])
        whole = f"<div{rng.choice([f' class={name}', f' id="{name}"', ''])}>{whole}</div>"
    if rng.random() < 0.15:  # a page without a frame
        return whole
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{whole}</body></html>"


def labels(page: Page) -> np.ndarray:
    """1 for marked blocks and texts, what holds them, and the frame of the page."""
    marked = np.array([
        node.tag in FRAME or node.value("data-y") == "1" or (node.tag == BARE and any(page.texts[k].startswith(MARK) for k in node.runs)) for node in page.nodes
    ])
    for i in range(len(page.nodes) - 1, 0, -1):
        marked[page.nodes[i].parent] |= marked[i]
    return marked.astype(float)


_fitted: dict[str, Trees] = {}


def trees(spark: SparkSession, pages: int = SAMPLE_PAGES, seed: int = SEED) -> Trees:
    """Trees fitted on the sample pages, once for each application."""
    key = f"{spark.sparkContext.applicationId}/{pages}/{seed}"
    if key not in _fitted:
        rng, rows = random.Random(seed), []
        for _ in range(pages):
            page = read(sample_page(rng))
            told = labels(page).tolist()
            # Only nodes whose parent is kept: the choice that decoding leaves open.
            rows += [(Vectors.dense(x), told[i]) for i, x in enumerate(node_features(page)) if page.nodes[i].tag not in FRAME and told[page.nodes[i].parent]]
        table = spark.createDataFrame(rows, ["features", "label"]).repartition(4).cache()
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=seed, checkpointInterval=-1).fit(table)
        _fitted[key] = Trees.of(model)
        table.unpersist()
    return _fitted[key]


def main_texts(model: Trees, sources: list[str]) -> Iterator[str]:
    pages = [read(html) for html in sources]
    rows = [node_features(page) for page in pages]
    chance = model.chance(np.concatenate(rows))
    at = 0
    for page in pages:
        kept = decode(page, chance[at : at + len(page.nodes)])
        at += len(page.nodes)
        yield "\n\n".join(text for text, owner in zip(page.texts, page.owners, strict=True) if kept[owner])


def extract(pages: DataFrame, model: Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    model = model or trees(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in slices(batches, "html", 1 << 19):
            texts = list(main_texts(model, sources.to_pylist()))
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
