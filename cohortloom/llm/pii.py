"""Personal data and the terms that give it away, in native expressions only.

Four patterns find protected entities (an entity is a kind with its value). A line is the unit of
co-occurrence. For an entity c and a term t (a run of three or more letters, lower-cased)

    information content  IC(c) = -log2(lines with c / lines)
    disclosure           PMI(c; t) / IC(c) = log2(n(c, t) * lines / (n(c) * n(t))) / IC(c)

A disclosure of 1 means that whoever reads t knows c. Terms at or above ``REMOVED`` are removed and
those at or above ``GENERALISED`` become a class name, wherever they stand in a document that
mentions c. Counts are over all lines of the corpus. An estimate needs evidence: different
places (a line with its neighbours) enough that chance alone would show t with c there with probability below
2 ** -``EVIDENCE``. Copies of a place are evidence only from ``SUPPORT`` different places on.

Defined cases: a null text counts as empty. Rows with a null id, or that repeat an id, get the spans of
their own text; a term counts in the row that also holds its entity. ``sanitise`` keeps all columns, whatever their
names, and replaces the text; ``spans`` reads only the id and the text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.graph import stage
from cohortloom.llm.quality import let

KINDS = ["email", "ip", "card", "phone", "term"]
SUPPORT, EVIDENCE = 3, 40
BLOCK = 128  # matches placed at a time
REMOVED, GENERALISED = 0.95, 0.85

# The published patterns with possessive repeats, started only where a run of their characters (or the
# search after a match) starts: a start inside a run meets the same end, so it fails as well. That
# keeps long runs linear. A card is a whole run of digits with single separators.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
TERM = r"\p{L}{3,}"
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def _luhn(digits: Column) -> Column:
    def weigh(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh) % 10 == 0


def _right(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(BYTE))
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _rightly(kind: str):
    return lambda span: _right(kind, span["value"])


def _of(kind: str):
    return lambda span: span["kind"] == kind


def _located(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of all matches. The text between matches and the matches themselves give the places."""

    def place(gaps: Column, hits: Column) -> Column:
        # In blocks, as appending to a long array copies it: first the length of each block, then its spans.
        blocks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int"))
        inside = lambda b: F.sequence(b * BLOCK, F.least(F.size(hits), (b + 1) * BLOCK) - 1)
        long = lambda b: F.aggregate(inside(b), F.lit(0), lambda n, i: n + F.length(gaps[i]) + F.length(hits[i]))
        starts = F.aggregate(F.transform(blocks, long), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))

        def step(a: Column, i: Column) -> Column:
            start = (a["end"] + F.length(gaps[i])).cast("int")
            stop = (start + F.length(hits[i])).cast("int")
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), hits[i].alias("value"))
            return F.struct(stop.alias("end"), F.array_append(a["spans"], span).alias("spans"))

        none = lambda at: F.struct(at.alias("end"), F.array().cast(SPAN).alias("spans"))
        spans = lambda s: F.flatten(F.transform(blocks, lambda b: F.aggregate(inside(b), none(s[b]), step)["spans"]))
        return F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(let(starts, spans))

    return let(F.regexp_extract_all(text, pattern, 0), lambda hits: let(F.split(text, pattern, -1), lambda gaps: place(gaps, hits)))


def pattern_spans(text: Column) -> Column:
    """All spans of the four patterns, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for kind, pattern in PATTERNS.items():
        spans = F.when(text.rlike(NEEDED[kind]), _located(text, F.lit(pattern), kind)).otherwise(F.array().cast(SPAN))
        found.append(F.filter(spans, _rightly(kind)))
    return F.array_sort(F.concat(*found))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(TERM), 0), F.lower))


def _entities(line: Column) -> Column:
    return F.array_distinct(F.transform(pattern_spans(line), lambda s: F.concat_ws(":", s["kind"], s["value"])))


def disclosures(texts: DataFrame, holders: DataFrame, support: int = SUPPORT, evidence: float = EVIDENCE) -> DataFrame | None:
    """(entity, term, disclosure) at or above ``GENERALISED``; None if no pair has evidence.

    ``texts`` (text) is the corpus, ``holders`` (text) the texts that hold an entity.
    """
    beside = lambda line, i: F.struct(line.alias("line"), F.get("lines", i - 1).alias("above"), F.get("lines", i + 1).alias("below"))
    lines = holders.select(F.split("text", "\n", -1).alias("lines")).select(F.explode(F.transform("lines", beside)).alias("at")).select("at.*").where(F.col("line").rlike("[0-9@]"))
    place = F.xxhash64(F.col("above").isNull(), "above", "line", "below").alias("place")
    # Copies of a place are counted, but are one kind.
    known = lines.select("line", place, F.explode(_entities(F.col("line"))).alias("entity")).groupBy("entity", "place").agg(F.count("*").alias("n"), F.first("line").alias("line"))
    entities = known.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    held = known.select("entity", "n", F.explode(_terms(F.col("line"))).alias("term"))
    pairs = held.groupBy("entity", "term").agg(F.count("*").alias("kinds"), F.sum("n").alias("n_both")).join(entities, "entity")
    total = texts.agg(F.sum(F.size(F.split("text", "\n", -1)))).scalar()
    content, seen = -F.log2(F.col("n_entity") / total), F.when(F.col("kinds") >= support, F.col("n_both")).otherwise(F.col("kinds"))
    pairs = stage(pairs.withColumn("content", content).where((F.col("content") > 0) & (F.col("content") * seen >= evidence)))
    if pairs.isEmpty():
        return None
    # Every line of the corpus; counts are summed before the shuffle.
    split = texts.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    counts = split.select(F.explode(_terms(F.col("line"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    pmi = F.log2(F.col("n_both") / F.col("n_entity") * (total / F.col("n_term")))
    told = pairs.join(counts, "term").withColumn("disclosure", pmi / F.col("content"))
    return told.where(F.col("disclosure") >= GENERALISED).select("entity", "term", "disclosure")


def _row(id_col: str, text: Column) -> Column:
    """A 64-bit key that only rows of the same id and text share; what is found in a row is found in all of these."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, evidence: float = EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """Two tables: (row, doc_id, found) with the pattern spans of every row, and (row, removed, generalised)
    with the terms of the rows that hold any, each row once. Terms count in the row that also holds their entity."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", _row("doc_id", F.col("text")))
    rows = slim.withColumn("found", pattern_spans(F.col("text")))
    rows = stage(rows.select("row", "doc_id", "found", F.when(F.size("found") > 0, F.col("text")).alias("text")))
    holders = rows.where("text is not null")
    told = disclosures(slim.select("text"), holders.select("text"), support, evidence)
    if told is None:
        terms = holders.limit(0).select("row", F.array().cast("array<string>").alias("removed"), F.array().cast("array<string>").alias("generalised"))
    else:
        named = holders.select("row", F.explode(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["value"]))).alias("entity"))
        here = holders.select("row", F.explode(_terms(F.col("text"))).alias("term"))
        hit = named.distinct().join(stage(told), "entity").join(here.distinct(), ["row", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("most"))
        lists = [F.array_sort(F.collect_list(F.when(at, F.col("term")))).alias(name) for name, at in (("removed", F.col("most") >= REMOVED), ("generalised", F.col("most") < REMOVED))]
        terms = hit.groupBy("row").agg(*lists)
    return rows.select("row", "doc_id", "found"), stage(terms)


def _with_terms(text: Column, found: Column, terms: Column) -> Column:
    """Pattern spans and the spans of whole words among ``terms`` that touch none of them."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    spans = _located(text, pattern, "term")
    free = F.filter(spans, lambda t: ~F.exists(found, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    return F.when(F.size(terms) > 0, F.array_sort(F.concat(found, free))).otherwise(found)


def listed(found: Column) -> Column:
    """kind:start:end of all spans, by comma."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, evidence: float = EVIDENCE) -> DataFrame:
    """(doc_id, base, found) of every row: the pattern spans, and those with the term spans."""
    base, terms = spans(docs, id_col, text_col, support, evidence)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    told = slim.select(_row("doc_id", F.col("text")).alias("row"), "text").join(terms.select("row", F.concat("removed", "generalised").alias("terms")), "row").dropDuplicates(["row"])
    more = told.select("row", F.filter(_with_terms(F.col("text"), pattern_spans(F.col("text")), F.col("terms")), _of("term")).alias("more"))
    found = F.array_sort(F.concat("found", F.coalesce("more", F.array().cast(SPAN))))
    return base.join(more, "row", "left").select("doc_id", F.col("found").alias("base"), found.alias("found"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, evidence: float = EVIDENCE) -> DataFrame:
    """``docs`` with entities replaced by <KIND>, generalised terms by <TERM>, removed terms by nothing."""
    _, terms = spans(docs, id_col, text_col, support, evidence)
    taken, held, held_terms = {c.lower() for c in docs.columns}, "held row", "held terms"
    while {held, held_terms} & taken:
        held, held_terms = held + "_", held_terms + "_"
    named = terms.select(F.col("row").alias(held), F.struct("removed", "generalised").alias(held_terms))
    joined = docs.join(named, _row(f"`{id_col}`", F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(f"`{held}`"), "left")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    removed, general = (F.coalesce(F.col(f"`{held_terms}`")[k], none) for k in ("removed", "generalised"))
    found = let(pattern_spans(text), lambda base: _with_terms(text, base, F.concat(removed, general)))

    def rebuilt(all_spans: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            sign = F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            sign = sign.when(F.array_contains(removed, F.lower(s["value"])), "").otherwise("<TERM>")
            fresh = s["start"] >= a["end"]
            out = F.when(fresh, F.concat(a["out"], F.substring(text, a["end"] + 1, s["start"] - a["end"]), sign)).otherwise(a["out"])
            return F.struct(out.alias("out"), F.greatest(a["end"], s["stop"]).alias("end"))

        last = lambda a: F.concat(a["out"], F.substring(text, a["end"] + 1, F.length(text)))
        return F.aggregate(all_spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("end")), step, last)

    clean = let(found, lambda f: F.when(F.size(f) == 0, F.col(text_col).cast("string")).otherwise(rebuilt(f)))
    return joined.withColumn(text_col, clean).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
