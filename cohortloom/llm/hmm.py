"""A hidden Markov language model: latent states trained over all partitions, exact text likelihoods.

Tokens are the words of a text and one end. Words with ``1 / OWN`` of all training tokens or more (at most
``OWN`` of them) and the end are observations of their own; all other words are observed as a class, by their
last bytes. A state emits an observation, and a class emits its words by their discounted share of it,
whatever the state. What the discount frees goes to one unseen word of the class. So the chances of all
words of the training texts and the unseen ones add up to 1 in every state.

Training is Baum-Welch. Each round sends the model to all tasks; a task adds up the expected counts of its
texts by scaled forward and backward recursion, and the counts of all tasks are summed by observation.
They are whole numbers of ``UNIT`` parts, so that the sum has no order. Texts of more than ``STRETCH``
tokens train as several sequences, the later ones starting from the stationary chances. The likelihood
of a text is computed over its whole length by the scaled forward recursion.

Counts of words are exact over all training rows. Those with ``1 / KNOWN`` of all tokens or more go to the
tasks (at most ``KNOWN`` rows, at any size of the corpus); the others meet the documents in a join, where
each document brings its rare words once. What a rare word adds does not depend on the state, so the
recursion does not wait for it. Words are 64-bit hashes.

Defined cases: a null or empty text, or one without words, is the end only. A null id takes no part in
training unless ``learns`` says so, and repeated rows count like others. Without any training token all
observations are equally likely. Texts of any length are scored whole. Other columns, whatever their names,
are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.graph import stage
from cohortloom.llm.spans import LOWER, spans
from cohortloom.llm.words import NOT_SPACE, mix, slices, split_words

OWN, KNOWN = 1 << 15, 1 << 20
ENDINGS = 1 << 12
STATES, ROUNDS = 8, 6
STRETCH = 512
DISCOUNT = 0.6  # of each rare word's count
SMOOTH = 20.0  # tokens by which every state is drawn to the corpus
UNIT = 1 << 20
TOKENS = 1 << 20  # tokens that one recursion works on together
SEEN_PRIOR = 0.1  # what the plain model adds to every count
_U64 = np.uint64
END = int(mix(np.array([0x656E64], _U64)).view(np.int64)[0])  # stands for the end among the hashes
ROWS = "row long, doc_id long, learns boolean, n_tokens long, n_known long, base double, inside double, seen binary, rare array<long>, times array<int>"


def _endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each word: a hash of its last three bytes and of whether it is longer."""
    size = ends - starts
    value = np.minimum(size, 4).astype(_U64)
    for back in (1, 2, 3):
        byte = LOWER[data[np.maximum(ends - back, 0)]].astype(_U64)
        value = value * _U64(257) + np.where(size >= back, byte + _U64(1), _U64(0))
    return (mix(value) % _U64(ENDINGS)).astype(np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, n) of all words of (text) rows, and one row for the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_seen = 0
        for _, texts in slices(batches, "text", 1 << 22):
            texts_seen += len(texts)
            words, first, n = np.unique(split_words(texts, NOT_SPACE)[0], return_index=True, return_counts=True)
            data, starts, ends = spans(texts, NOT_SPACE)
            ending = _endings(data, starts[first], ends[first]) if len(first) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ending, pa.int32()), pa.array(n, pa.int64())], ["word", "ending", "n"])
        if texts_seen:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([-1], pa.int32()), pa.array([texts_seen], pa.int64())], ["word", "ending", "n"])

    return docs.select("text").mapInArrow(run, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What the tasks know about words: the frequent ones, and the totals of the classes of the others."""

    total: int  # training tokens
    distinct: int
    words: np.ndarray  # sorted hashes of the known words
    counts: np.ndarray
    endings: np.ndarray
    own: np.ndarray  # for each known word its own observation, or -1
    observed: np.ndarray  # training tokens of every observation: own ones first, the classes behind
    kinds: np.ndarray  # different words of each class

    @property
    def first_class(self) -> int:
        return len(self.observed) - ENDINGS

    def plain(self, counts: np.ndarray) -> np.ndarray:
        """log10 chance of words with these counts in the plain model."""
        return np.log10((counts + SEEN_PRIOR) / (self.total + SEEN_PRIOR * (self.distinct + 1)))

    def inside(self, counts: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """log10 chance of words with these counts inside their classes; a count of 0 is the unseen word."""
        mass = self.observed[self.first_class + endings]
        seen = np.where(counts > 0, counts - DISCOUNT, DISCOUNT * self.kinds[endings])
        return np.log10(np.where(mass > 0, seen, 1.0) / np.maximum(mass, 1))


def lexicon(counted: DataFrame) -> Lexicon:
    """The lexicon of ``count_words``; at most ``KNOWN`` words and ``ENDINGS`` classes come to the driver."""
    total, distinct = (int(x or 0) for x in counted.agg(F.sum("n"), F.count("*")).first())
    known = counted.where((F.col("n") * KNOWN >= total) & (F.col("ending") >= 0)).select("word", "ending", "n").toArrow()
    word, ending, n = (known.column(c).to_numpy() for c in ("word", "ending", "n"))
    order = np.argsort(word.view(_U64))
    word, ending, n = word.view(_U64)[order], ending[order], n[order]
    frequent = n * OWN >= total
    own = np.full(len(word), -1, np.int64)
    own[frequent] = np.arange(1, int(frequent.sum()) + 1)  # 0 is the end
    classes = counted.where((F.col("ending") >= 0) & (F.col("n") * OWN < total)).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    observed, kinds = np.zeros(1 + int(frequent.sum()) + ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    at = classes.column("ending").to_numpy()
    observed[1 + int(frequent.sum()) + at] = classes.column("n").to_numpy()
    kinds[at] = classes.column("kinds").to_numpy()
    observed[1 : 1 + int(frequent.sum())] = n[frequent]
    observed[0] = total - int(observed.sum())
    return Lexicon(total, distinct, word, n, ending, own, observed, kinds)


def read(docs: DataFrame, learns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, learns, text) rows; ``learns`` is an SQL condition on ``docs``."""
    learns = F.expr(learns)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learns.cast("boolean"), F.lit(False)).alias("learns"), F.col(text_col).cast("string").alias("text"))


def observe(rows: DataFrame, known: Lexicon) -> DataFrame:
    """Each (doc_id, learns, text) row as observations, with the words that the lexicon does not know.

    ``seen`` is int32 numbers of observations in order; ``rare`` holds the different other words and
    ``times`` how often each occurs. ``base`` is the plain log10 chance of the text and ``inside`` what
    words add inside their classes, both as if all rare words were unseen; ``n_known`` leaves them out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, number = shared.value, 0
        at_class = np.arange(ENDINGS)
        unseen, plain_unseen = lex.inside(np.zeros(ENDINGS), at_class), float(lex.plain(np.zeros(1))[0])
        plain, plain_end = lex.plain(lex.counts), float(lex.plain(lex.observed[:1])[0])
        inside = np.where(lex.own < 0, lex.inside(lex.counts, lex.endings), 0.0)
        for part, texts in slices(batches, "text", 1 << 20):
            words, firsts = split_words(texts, NOT_SPACE)
            data, starts, ends = spans(texts, NOT_SPACE)
            sizes = np.diff(firsts)
            row = np.repeat(np.arange(len(texts)), sizes)
            place, have = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
            if len(lex.words):
                place = np.minimum(np.searchsorted(lex.words, words), len(lex.words) - 1)
                have = lex.words[place] == words
            seen = np.where(have, lex.own[place], -1) if len(lex.words) else place - 1
            classed, rare = np.flatnonzero(seen < 0), np.flatnonzero(~have)
            seen[classed] = lex.first_class + _endings(data, starts[classed], ends[classed])
            of_row = lambda index, values: np.bincount(row[index], values, len(texts)).astype(float)
            base = plain_end + of_row(have, plain[place[have]]) + of_row(rare, np.full(len(rare), plain_unseen))
            within = of_row(have, inside[place[have]]) + of_row(rare, unseen[seen[rare] - lex.first_class])
            n_known = np.bincount(row[have], minlength=len(texts)) + int(lex.observed[0] > 0)
            # The different rare words of each row, and the end behind every text.
            order = rare[np.lexsort((words[rare], row[rare]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
            once = order[fresh]
            times = np.diff(np.append(np.flatnonzero(fresh), len(order))).astype(np.int32)
            bounds = pa.array(np.searchsorted(row[once], np.arange(len(texts) + 1)), pa.int32())
            seen, bytes_at = np.insert(seen, firsts[1:], 0).astype(np.int32).tobytes(), 4 * (firsts + np.arange(len(firsts)))
            told = [seen[s:e] for s, e in zip(bytes_at[:-1].tolist(), bytes_at[1:].tolist(), strict=True)]
            names = [(TaskContext.get().partitionId() << 33) + number + k for k in range(len(texts))]
            number += len(texts)
            columns = [pa.array(names), part.column(0), part.column(1), pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(within), pa.array(told, pa.binary())]
            columns += [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (words[once].view(np.int64), times)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ROWS.split(", ")])

    return rows.select("doc_id", "learns", "text").mapInArrow(run, ROWS)


@dataclass
class Model:
    start: np.ndarray  # chance of each state for the first token
    move: np.ndarray  # from state to state
    emit: np.ndarray  # (observation, state): chance of the observation in the state


def first_model(known: Lexicon, states: int) -> Model:
    """States that differ by chance (the same for the same observation) and tend to stay."""
    size = len(known.observed)
    chance = mix(np.arange(1, size * states + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)).reshape(size, states) / 2.0**64
    tilted = _background(known)[:, None] * (0.5 + chance)
    move = np.full((states, states), 0.3 / max(states - 1, 1))
    np.fill_diagonal(move, 0.7 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, tilted / tilted.sum(0))


def _background(known: Lexicon) -> np.ndarray:
    return (known.observed + 0.1) / (known.observed + 0.1).sum()


def _stationary(model: Model) -> np.ndarray:
    chances = np.linalg.matrix_power(model.move, 1 << 10)[0]
    return chances / chances.sum()


class Steps:
    """Sequences side by side: the longest first, and all tokens of one place in a row, behind those of the place before."""

    def __init__(self, firsts: np.ndarray):
        sizes = np.diff(firsts)
        self.order = np.argsort(-sizes, kind="stable")
        longest = int(sizes[self.order[0]]) if len(sizes) else 0
        self.active = (len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")).tolist()
        self.edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.active, dtype=np.int64)])
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        at = self.edges[np.arange(int(firsts[-1])) - np.repeat(firsts[:-1], sizes)] + np.repeat(rank, sizes)
        self.tokens = np.empty(len(at), np.int64)  # which token stands where
        self.tokens[at] = np.arange(len(at))
        self.rank = np.empty(len(at), np.int64)
        self.rank[at] = np.repeat(rank, sizes)


def _forward(model: Model, steps: Steps, emitted: np.ndarray, first: np.ndarray, keep: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """The scaled forward chances of every token (if kept) and the scales, step by step."""
    alphas = np.empty_like(emitted) if keep else None
    scales, alpha = np.empty(len(emitted)), first
    for t, n in enumerate(steps.active):
        here = slice(int(steps.edges[t]), int(steps.edges[t]) + n)
        alpha = (alpha[:n] @ model.move if t else alpha[:n]) * emitted[here]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        scales[here] = scale
        if keep:
            alphas[here] = alpha
    return alphas, scales


def log_chances(model: Model, seen: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence of observations by the scaled forward recursion."""
    steps = Steps(firsts)
    first = np.broadcast_to(model.start, (len(firsts) - 1, len(model.start)))
    _, scales = _forward(model, steps, model.emit[seen[steps.tokens]], first, False)
    result = np.empty(len(firsts) - 1)
    result[steps.order] = np.bincount(steps.rank, np.log10(scales), len(result))
    return result


def expected_counts(model: Model, seen: np.ndarray, firsts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states (of sequences that begin a text), moves and observations; and the log10 likelihood."""
    steps = Steps(firsts)
    seen, begins = seen[steps.tokens], begins[steps.order]
    states = len(model.start)
    emitted = model.emit[seen]
    alphas, scales = _forward(model, steps, emitted, np.where(begins[:, None], model.start, _stationary(model)), True)
    emitted /= scales[:, None]
    moves, beta, back = np.zeros((states, states)), np.ones((len(begins), states)), np.ascontiguousarray(model.move.T)
    for t in range(len(steps.active) - 1, -1, -1):
        n = steps.active[t]
        here = slice(int(steps.edges[t]), int(steps.edges[t]) + n)
        if t:
            before = int(steps.edges[t - 1])
            weighed = beta[:n] * emitted[here]
            moves += alphas[before : before + n].T @ weighed
            alphas[here] *= beta[:n]
            beta[:n] = weighed @ back
        else:
            alphas[here] *= beta[:n]
    counts = np.stack([np.bincount(seen, alphas[:, k], len(model.emit)) for k in range(states)], 1)
    return alphas[: len(begins)][begins].sum(0), moves * model.move, counts, float(np.log10(scales).sum())


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Observations of many texts, where each training sequence starts, and whether it begins a text."""
    held, edges, begins, size = [], [0], [], 0
    for batch in batches:
        for value in batch.column(0):
            seen = np.frombuffer(value.as_buffer(), np.int32)
            for start in range(0, len(seen), STRETCH):
                part = seen[start : start + STRETCH]
                held.append(part)
                size += len(part)
                edges.append(size)
                begins.append(start == 0)
                if size >= TOKENS:
                    yield np.concatenate(held), np.array(edges), np.array(begins)
                    held, edges, begins, size = [], [0], [], 0
    if held:
        yield np.concatenate(held), np.array(edges), np.array(begins)


def gather(rows: DataFrame, model: Model) -> DataFrame:
    """(what, counts) of all training rows: counts are for every state, in ``UNIT`` parts.

    ``what`` is an observation; below it, -1 is the first states, -2 - k the moves from state k, and one
    more the log likelihood.
    """
    states = len(model.start)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        emitted, others = np.zeros(now.emit.shape), np.zeros((states + 2, states))
        for seen, firsts, begins in _stretches(batches):
            first, moves, counts, chance = expected_counts(now, seen, firsts, begins)
            emitted += counts
            others[0] += first
            others[1:-1] += moves
            others[-1, 0] += chance
        used = np.flatnonzero(emitted.any(axis=1))
        if not len(used):
            return
        counts = np.rint(np.concatenate([emitted[used], others]) * UNIT).astype(np.int64)
        what = np.concatenate([used, -1 - np.arange(states + 2)]).astype(np.int32)
        columns = [pa.array(what), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(states))]
        yield pa.RecordBatch.from_arrays(columns, ["what", *(f"s{k}" for k in range(states))])

    told = rows.where("learns").select("seen").mapInArrow(run, "what int, " + ", ".join(f"s{k} long" for k in range(states)))
    return told.groupBy("what").agg(*(F.sum(F.col(f"s{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in range(states)))


def improved(model: Model, known: Lexicon, told: pa.Table) -> tuple[Model, float]:
    """The next model, and the log10 likelihood of the training texts under this one."""
    states = len(model.start)
    what = told.column("what").to_numpy()
    counts = np.stack([np.array([float(x) for x in told.column(f"s{k}").to_pylist()]) for k in range(states)], 1) / UNIT if len(what) else np.zeros((0, states))
    emitted, others = np.zeros(model.emit.shape), np.zeros((states + 2, states))
    emitted[what[what >= 0]] = counts[what >= 0]
    others[-1 - what[what < 0]] = counts[what < 0]
    start, move = others[0] + 1, others[1:-1] + 1
    emit = emitted + SMOOTH * _background(known)[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), float(others[-1, 0])


def train(rows: DataFrame, known: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after ``rounds`` of Baum-Welch over observed rows, and the log10 likelihood before each round."""
    model, chances = first_model(known, states), []
    for _ in range(rounds):
        model, chance = improved(model, known, gather(rows, model).toArrow())
        chances.append(chance)
    return model, chances


def _bounded(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows with at most ``TOKENS`` tokens together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False) // 4)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKENS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def score(rows: DataFrame, counted: DataFrame, known: Lexicon, model: Model) -> DataFrame:
    """(doc_id, learns, n_tokens, n_known, base_score, score) of observed rows.

    ``base_score`` is the plain model's log10 chance of the text and ``score`` this model's.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _bounded(batches, 1):
            seen = [np.frombuffer(v.as_buffer(), np.int32) for v in part.column(1)]
            chance = log_chances(shared.value, np.concatenate(seen), np.cumsum([0, *map(len, seen)]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chance), *part.columns[2:]], ["row", "chance", *part.schema.names[2:]])

    slim = ["doc_id", "learns", "n_tokens", "n_known", "base", "inside"]
    scored = rows.select("row", "seen", *slim).mapInArrow(run, "row long, chance double, doc_id long, learns boolean, n_tokens long, n_known long, base double, inside double")
    # What rare words add that were not unseen, each once for a row.
    kinds = counted.where((F.col("ending") >= 0) & (F.col("n") * OWN < known.total)).groupBy("ending").agg(F.count("*").alias("kinds"))
    seen = counted.where((F.col("ending") >= 0) & (F.col("n") * KNOWN < known.total)).join(F.broadcast(kinds), "ending")
    seen = seen.select("word", F.log10((F.col("n") + SEEN_PRIOR) / SEEN_PRIOR).alias("base"), F.log10((F.col("n") - DISCOUNT) / (F.col("kinds") * DISCOUNT)).alias("inside"))
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    more = asked.join(seen, "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("base") * F.col("times")).alias("more_base"), F.sum(F.col("inside") * F.col("times")).alias("more_inside")
    )
    none = F.lit(0.0)
    return scored.join(more, "row", "left").select(
        "doc_id", "learns", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"), (F.col("chance") + F.col("inside") + F.coalesce("more_inside", none)).alias("score"),
    )


def fit_and_score(docs: DataFrame, learns: str, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> tuple[DataFrame, Lexicon, Model]:
    """Scores of all rows of ``docs`` under a model of those that ``learns`` names."""
    rows = read(docs, learns, id_col, text_col)
    counted = stage(count_words(rows.where("learns")))
    known = lexicon(counted)
    seen = stage(observe(rows, known))
    model, _ = train(seen, known, states, rounds)
    return score(seen, counted, known, model), known, model


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = "crc32(cast(cast(doc_id as string) as binary)) % 10"
    scored, known, _ = fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{part} <> 0")
    held_out = F.expr(f"coalesce({part} = 0, false)")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")
