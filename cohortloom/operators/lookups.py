"""Joins that look something up for a fact row.

Join strategy is left to Spark: it broadcasts a side only when it has measured it below its own size limit
and splits skewed partitions at run time. No side is hinted, because every lookup table may grow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.calendar import month_index


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop repeated keys so that a later lookup cannot multiply rows."""
    return df.dropDuplicates(list(keys))


def attach(facts: DataFrame, lookup: DataFrame, on: Mapping[str, str], how: str = "left") -> DataFrame:
    """Join on differently named keys (fact column -> lookup column); the lookup keys are dropped."""
    renamed = lookup.withColumnsRenamed({theirs: f"_key_{theirs}" for theirs in on.values()})
    same = [facts[ours] == renamed[f"_key_{theirs}"] for ours, theirs in on.items()]
    return facts.join(renamed, same, how).drop(*[f"_key_{theirs}" for theirs in on.values()])


def keep_known(facts: DataFrame, known: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows whose key occurs in ``known``."""
    return facts.join(known, [facts[a] == known[b] for a, b in on.items()], "left_semi")


def keep_unknown(facts: DataFrame, known: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows whose key does not occur in ``known``."""
    return facts.join(known, [facts[a] == known[b] for a, b in on.items()], "left_anti")


def membership(facts: DataFrame, known: DataFrame, on: Mapping[str, str], name: str) -> DataFrame:
    """1 where the key occurs in ``known``, else 0; rows are never multiplied."""
    keys = known.select(*on.values()).where(
        " and ".join(f"`{c}` is not null" for c in on.values())
    ).distinct().withColumn(name, F.lit(1))
    return attach(facts, keys, on).withColumn(name, F.coalesce(name, F.lit(0)))


def with_bare_rows(facts: DataFrame, owners: DataFrame, on: str, source: DataFrame | None = None) -> DataFrame:
    """``owners`` left joined to ``facts``: facts with their owner, and owners without any fact.

    Spark cannot split a large key on the right side of a left join. As an inner join plus the
    rows without a match, the facts may be split, and the match test sees each key once. ``source`` has the same
    keys as ``facts`` where these were looked up in other tables before, which the match test need not repeat.
    """
    bare = owners.join((facts if source is None else source).select(on).distinct(), on, "left_anti")
    return facts.join(owners, on).unionByName(bare, allowMissingColumns=True)


def rates_in_range(facts: DataFrame, rates: DataFrame, key: str, fact_date: str, rate_date: str,
                   months: tuple[int, int], how: str = "left") -> DataFrame:
    """Rates of the same key whose age in whole months at the fact date lies in ``months``.

    Every match is kept. Each rate is listed under the calendar months it can reach, so the join
    is an equi-join on (key, month) and a key with many facts is spread over its months.
    """
    low, high = months
    reach = F.sequence(month_index(F.col(rate_date)) + low, month_index(F.col(rate_date)) + high + 1)
    listed = rates.withColumnRenamed(key, "_rate_key").withColumn("_rate_month", F.explode(reach))
    age = F.floor(F.months_between(facts[fact_date], listed[rate_date]))
    same = (
        (facts[key] == listed["_rate_key"])
        & (month_index(facts[fact_date]) == listed["_rate_month"])
        & age.between(low, high)
    )
    return facts.join(listed, same, how).drop("_rate_key", "_rate_month")


def latest_rate(facts: DataFrame, rates: DataFrame, key: str, fact_date: str, rate_date: str, value: str,
                months: tuple[int, int], name: str) -> DataFrame:
    """The value of the newest rate in range as a column; exactly one row per fact.

    The rates a (key, month) can use are gathered first: at most one per day of the months
    that reach it.
    """
    low, high = months
    reach = F.sequence(month_index(F.col(rate_date)) + low, month_index(F.col(rate_date)) + high + 1)
    per_day = rates.groupBy(key, rate_date).agg(F.max(value).alias("_rate"))
    gathered = (
        per_day.withColumn("_month", F.explode(reach))
        .groupBy(F.col(key).alias("_key"), "_month")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(rate_date).alias("since"), F.col("_rate").alias("rate"))),
                          asc=False).alias("_rates"))
    )
    joined = facts.join(
        gathered, (facts[key] == gathered["_key"]) & (month_index(facts[fact_date]) == gathered["_month"]), "left"
    )
    usable = F.filter("_rates", lambda r: F.floor(F.months_between(F.col(fact_date), r["since"])).between(low, high))
    return joined.withColumn(name, F.try_element_at(usable, F.lit(1))["rate"]).drop("_key", "_month", "_rates")


def owner_of(pairs: DataFrame, entity: str, owner: str, latest: str) -> DataFrame:
    """One owner per entity: the one with the latest day, the lowest owner (number or text) on a tie.

    Pairs are reduced to one row per (entity, owner) first, so an entity that fills a large
    share of the rows costs its distinct owners only.
    """
    known = pairs.where(F.col(entity).isNotNull() & F.col(owner).isNotNull())
    last = known.groupBy(entity, owner).agg(F.max(latest).alias("_latest"))
    newest_first = F.struct(F.coalesce(-F.unix_date(F.to_date("_latest")), F.lit(2**31 - 1)).alias("age"), F.col(owner))
    return last.groupBy(entity).agg(F.min_by(F.col(owner), newest_first).alias(owner))


def owners_of(pairs: DataFrame, entity: str, owners: Sequence[str], latest: str) -> DataFrame:
    """``owner_of`` for several kinds of owners from one reading of ``pairs``, each kind decided on its own."""
    last = pairs.where(F.col(entity).isNotNull()).groupBy(entity, *owners).agg(F.max(latest).alias("_latest"))
    age = F.coalesce(-F.unix_date(F.to_date("_latest")), F.lit(2**31 - 1))
    return last.groupBy(entity).agg(*[
        F.min_by(F.col(o), F.when(F.col(o).isNotNull(), F.struct(age.alias("age"), F.col(o)))).alias(o) for o in owners
    ])


def code_texts(facts: DataFrame, table: DataFrame, columns: Mapping[str, tuple[str, str]], field: str = "fld_nm",
               value: str = "fld_valu", text: str = "fld_valu_desc_eng") -> DataFrame:
    """Texts of several code columns from one code table (field, value, text).

    ``columns`` maps a code column to its field in the table and the name of the text. The codes that occur
    together are few, so they are looked up once, all fields in one join, and the facts are joined once with
    what was found. A code without a text, or a null code, has a null text. A value that is listed twice gives
    its lowest text.
    """
    codes = {c: f"_code_{i}" for i, c in enumerate(columns)}
    together = facts.select(*[F.col(c).cast("string").alias(name) for c, name in codes.items()]).distinct()
    asked = F.array(*[
        F.struct(F.lit(known).alias("field"), F.col(codes[c]).alias("value"), F.lit(output).alias("output")) for c, (known, output) in columns.items()
    ])
    listed = table.groupBy(F.col(field).alias("field"), F.col(value).cast("string").alias("value")).agg(F.min(text).alias("_text"))
    told = together.select(*codes.values(), F.explode(asked).alias("a")).select(*codes.values(), "a.*").join(listed, ["field", "value"], "left")
    texts = told.groupBy(*codes.values()).agg(*[F.max(F.when(F.col("output") == output, F.col("_text"))).alias(output) for _, output in columns.values()])
    same = [facts[c].cast("string").eqNullSafe(texts[name]) for c, name in codes.items()]
    return facts.join(texts, same, "left").drop(*codes.values())
