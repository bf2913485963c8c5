"""Conversations as one prefix tree: turns that conversations share at their start are emitted once.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; control strings inside roles and texts are escaped
reversibly. A node is a turn with all turns before it. Sorting conversations by their node keys puts
the tree into depth-first order: a conversation adds exactly the nodes that the one before it does not
have, so places in the stream are running sums over range partitions, and a first turn that a third of
all conversations share needs no task of its own. Each emitted node has its place in the token stream,
the position ids of its tokens (counted along its own conversation) and the stream intervals of its
ancestors, which its tokens may attend to besides their own node.

Defined cases: null texts and roles are empty. Turns of equal number are ordered by role, then text, so
repeated rows are turns of their own. A row without a conversation id is a conversation of one turn
whose id is null. Only the named columns are read. An empty table gives an empty stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm import bpe
from cohortloom.llm.graph import stage
from cohortloom.session import settle

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    """No ``<|`` is left: each gets a backslash, as does each that has backslashes already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def turns(table: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, lone, turn, role, text, head, body): escaped role and text, and the ids of both parts.

    The head is the start mark and the role line; the body is the text. Marks have the two ids after
    those of the vocabulary; the end mark and line break that close each turn are the same for all.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = table.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.replace(escape(role), F.lit("\n"), F.lit(BREAK)).alias("role"), escape(text).alias("text"),
    )
    return bpe.encode(bpe.encode(slim.withColumn("line", F.concat("role", F.lit("\n"))), path, "line", "head"), path, "text", "body").drop("line")


def conversations(told: DataFrame) -> DataFrame:
    """(conv, keys, turns): for every conversation the node keys and the turns in order."""
    # A key is 32 hex digits of the digest of the parent's key and the turn.
    chain = F.aggregate(
        "turns", F.array(F.lit("")),
        lambda a, t: F.array_append(a, F.substring(F.sha2(F.concat(F.element_at(a, -1), F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256), 1, 32)),
    )
    turn = F.struct("turn", "role", "text", "head", "body")
    whole = told.where("conv is not null").groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    lone = told.where("conv is null").select("conv", F.array(turn).alias("turns"))
    return whole.unionByName(lone).select("conv", F.slice(chain, F.lit(2), F.size("turns")).alias("keys"), "turns")


def _size(turn: Column) -> Column:
    """Tokens of a turn: start mark, head, body, end mark and line break."""
    return (F.length(turn["head"]) + F.length(turn["body"])) / 4 + 3


def stream(told: DataFrame, vocabulary_size: int) -> tuple[DataFrame, DataFrame]:
    """The emitted nodes, and each conversation's way through them.

    Nodes: (start, stop, depth, position, attend, ids, body_from, body_to, loss). ``start`` and
    ``stop`` are places in the token stream, ``position`` is the position id of the first token, ``attend`` the
    intervals of all ancestors, joined where they touch, ``ids`` the tokens as little-endian 32-bit
    integers; tokens ``body_from`` to ``body_to`` are the text, under the loss mask if ``loss``.
    Ways: (way, conv, starts, sizes) with the stream places of a conversation's turns in order.
    """
    spark = told.sparkSession
    convs = conversations(told)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["keys", "conv", "way"]
    ranged = stage(settle(convs.withColumn("way", F.monotonically_increasing_id())).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    slim = ranged.select("part", *order, F.transform("turns", lambda t: _size(t).cast("long")).alias("sizes"))
    inside = Window.partitionBy("part").orderBy(*order)
    last = slim.groupBy("part").agg(F.max("keys").alias("last"))  # a row for each partition
    before = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    none = F.array().cast("array<string>")
    rows = slim.join(before, "part").withColumn("prior", F.coalesce(F.lag("keys").over(inside), "before", none))
    # Keys name whole prefixes, so what two sorted neighbours share is what they share anywhere.
    rows = rows.withColumn("shared", F.size(F.filter(F.zip_with("keys", F.slice("prior", F.lit(1), F.size("keys")), lambda a, b: a == b), lambda same: same)))
    fresh = F.aggregate(F.slice("sizes", F.col("shared") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda n, s: n + s)
    rows = rows.withColumn("fresh", fresh).drop("prior", "before")
    totals = rows.groupBy("part").agg(F.sum("fresh").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    rows = rows.join(offsets, "part").withColumn("at", F.col("offset") + F.sum("fresh").over(inside) - F.col("fresh"))
    rows = stage(rows.select("way", "conv", "keys", "sizes", "shared", "at"))

    # Where each node stands: running sums of the fresh sizes of the conversation that emits it.
    steps = rows.select("way", "shared", "at", F.posexplode(F.arrays_zip("keys", "sizes")).alias("k", "node"), "sizes")
    ahead = F.aggregate(F.slice("sizes", F.col("shared") + 1, F.greatest(F.col("k") - F.col("shared"), F.lit(0))), F.lit(0).cast("long"), lambda n, s: n + s)
    emitted = steps.where("k >= shared").select("way", "k", F.col("node")["keys"].alias("key"), (F.col("at") + ahead).alias("start"))
    visits = steps.select("way", "k", F.col("node")["keys"].alias("key"), F.col("node")["sizes"].alias("size"))
    visits = visits.join(emitted.select("key", "start"), "key")
    entry = F.struct("k", "start", "size")
    ways = stage(visits.groupBy("way").agg(F.array_sort(F.collect_list(entry)).alias("visits")))

    def join_up(done: Column, v: Column) -> Column:
        final = F.element_at(done, -1)
        longer = F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), F.struct(final["start"].alias("start"), (v["start"] + v["size"]).alias("stop")))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] == v["start"]), longer).otherwise(
            F.array_append(done, F.struct(v["start"].alias("start"), (v["start"] + v["size"]).alias("stop")))
        )

    def attend(k: Column) -> Column:
        return F.aggregate(F.slice("visits", F.lit(1), k), F.array().cast("array<struct<start:bigint,stop:bigint>>"), join_up)

    position = F.aggregate(F.slice("visits", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda n, v: n + v["size"])
    placed = emitted.select("way", "k", "start").join(ways, "way").select("way", "k", "start", position.alias("position"), attend(F.col("k")).alias("attend"))
    texts = ranged.select("way", F.posexplode("turns").alias("k", "turn"))
    nodes = placed.join(texts, ["way", "k"]).select(
        "start", F.col("k").alias("depth"), "position", "attend", F.col("turn")["role"].alias("role"), F.col("turn")["head"].alias("head"), F.col("turn")["body"].alias("body"),
    )
    marks = [F.lit(int(vocabulary_size + m).to_bytes(4, "little")) for m in (0, 1)]
    ids = F.concat(marks[0], F.col("head"), F.col("body"), marks[1])
    body_from = (F.length("head") / 4 + 1).cast("int")
    body_to = (body_from + F.length("body") / 4).cast("int")
    out = nodes.select("start", "depth", "position", "attend", ids.alias("ids"), body_from.alias("body_from"), body_to.alias("body_to"), (F.col("role") == "assistant").alias("loss"))
    return out, ways.join(rows.select("way", "conv"), "way").select("way", "conv", F.col("visits")["start"].alias("starts"), F.col("visits")["size"].alias("sizes"))


def emit(table: DataFrame, path: str, **columns: str) -> tuple[DataFrame, DataFrame]:
    """``stream`` of a table of turns, the closing line break included in the ids."""
    told = settle(turns(table, path, **columns))
    size = len(bpe.vocabulary(path).tokens)
    nodes, ways = stream(told, size)
    line = F.lit(bpe.encoder(path)("\n"))
    nodes = nodes.withColumn("ids", F.concat("ids", line)).withColumn("stop", F.col("start") + (F.length("ids") / 4).cast("long"))
    return nodes, ways


def read_back(nodes: DataFrame, path: str) -> DataFrame:
    """(start, role, text, trained, formatted) of emitted nodes, from their ids and loss marks alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(bpe.vocabulary(path).tokens)
        known |= {len(known): START.encode(), len(known) + 1: END.encode()}
        for batch in batches:
            rows = batch.to_pydict()
            heads, bodies, trained, formatted = [], [], [], []
            for ids, low, high, loss in zip(rows["ids"], rows["body_from"], rows["body_to"], rows["loss"], strict=True):
                pieces = [known[i] for i in np.frombuffer(ids, "<u4").tolist()]
                whole = b"".join(pieces).decode()
                role, _, rest = whole.removeprefix(START).partition("\n")
                heads.append(role)
                bodies.append(rest[: rest.rindex(END)])
                trained.append(b"".join(pieces[low:high]).decode() if loss else None)
                formatted.append(len(whole))
            columns = [batch.column(0), pa.array(heads), pa.array(bodies), pa.array(trained, pa.string()), pa.array(formatted, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["start", "role", "text", "trained", "formatted"])

    parsed = nodes.select("start", "ids", "body_from", "body_to", "loss").mapInArrow(run, "start long, role string, text string, trained string, formatted long")
    return parsed.select("start", unescape(F.replace(F.col("role"), F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(F.col("text")).alias("text"), unescape(F.col("trained")).alias("trained"), "formatted")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes, ways = emit(table.unionByName(extra), path)
    visits = ways.select("way", "conv", F.posexplode("starts").alias("k", "start"))
    read = visits.join(read_back(nodes, path), "start")
    read = read.groupBy("way", "conv").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text", "trained", "formatted"))).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("turns", lambda t: F.coalesce(t["trained"], F.lit(""))), "")
    return read.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["formatted"]).alias("formatted_chars"),
    )
