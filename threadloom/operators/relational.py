"""Joins and summaries that go beyond a single built-in call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import code
from threadloom.operators.cluster import checkpointed

#: Characters by which calls and entities meet.
GRAM = 3


def attached(df: DataFrame, columns: DataFrame, key: str = "row_id") -> DataFrame:
    """Columns side by side, matched by a key and never by position; unmatched rows get nulls."""
    return df.join(columns, key, "left")


def inner_renamed(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Inner equi-join; columns of the right side that clash get the suffix `_right`, its key goes."""
    taken = set(left.columns)
    names = {c: f"{c}_right" if c in taken else c for c in right.columns if c != right_on}
    other = right.select(F.col(right_on).alias("_key"), *[F.col(c).alias(n) for c, n in names.items()])
    return left.join(other, left[left_on] == other["_key"]).drop("_key")


def first_containing(calls: DataFrame, entities: DataFrame, call: str, entity: str, position: str, keys: Sequence[str]) -> DataFrame:
    """For each call, the first entity (by position) whose name contains the called name; calls without one go.

    Names are met by the first `GRAM` characters of the call, which an equal piece of the entity must have.
    """
    name = F.col(entity)
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - n + 1)), lambda at: F.substring(name, at, n))))
    indexed = entities.filter(name.isNotNull()).select(name, F.col(position), F.explode(F.array_distinct(pieces)).alias("_gram"))
    pairs = calls.withColumn("_gram", F.substring(call, 1, GRAM)).join(indexed, "_gram").filter(F.contains(F.col(entity), F.col(call)))
    best = pairs.groupBy(*keys, call).agg(F.min_by(F.struct(entity, position), F.struct(position, entity)).alias("_m"))
    return best.select(*keys, call, F.col("_m")[entity].alias(entity), F.col("_m")[position].alias(position))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """left with the latest right value at or before its time, by one union and one window."""
    tagged = [c for c in left.columns]
    l_side = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v"))
    r_side = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in tagged], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"))
    before = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_side.withColumn("_v", F.lit(None).cast(r_side.schema["_v"].dataType)).unionByName(r_side)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(before)["v"]).filter("_side = 1").select(*tagged, name)


def described(df: DataFrame, column: str) -> DataFrame:
    """One row: count, null_count, mean, std, min, max, median of a numeric column."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"),
        F.count_if(c.isNull()).alias("null_count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.percentile(c, 0.5).alias("median"),
    )


def prefix_sums(df: DataFrame, prefix: str) -> DataFrame:
    """One row: sums of the columns whose names begin with the prefix."""
    return df.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in df.columns if c.startswith(prefix)])


def groups_as_json(df: DataFrame, by: str, column: str, order: str) -> DataFrame:
    """(by, members): each group's values, in order, as a JSON array."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(column).alias("value")))), lambda x: x["value"])
    return df.groupBy(by).agg(F.to_json(rows).alias("members"))


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: (same, total)."""
    return df.agg(F.count_if(a == b).alias("same"), F.count("*").alias("total"))


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, parent) for all ancestors; cycles end by themselves.

    `known` are the pairs less than d steps apart, `far` those whose shortest way has d. One of d to 2d - 1
    steps is one of d and a shorter one, one of 2d is two of d, so a round makes a tree's pair once and
    doubles d. Pairs are written in the round that finds them, and only read by those after it.
    """
    far = checkpointed(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).distinct())
    known = far.limit(0)
    while not far.isEmpty():
        step = far.toDF("child", "by")
        beyond, twice = (step.join(d.toDF("by", "parent"), "by").select("child", "parent") for d in (known, far))
        met = known.withColumn("at", F.lit(0)).unionByName(far.unionByName(beyond).withColumn("at", F.lit(1))).unionByName(twice.withColumn("at", F.lit(2)))
        fresh = checkpointed(met.groupBy("child", "parent").agg(F.min("at").alias("at")).filter("at > 0"))
        known, far = known.unionByName(fresh.filter("at = 1").drop("at")), fresh.filter("at = 2").drop("at")
    return known


def with_related_code(df: DataFrame, key: str, column: str, name: str = "code_with_related_prompt") -> DataFrame:
    """Adds each row's code, followed by the code of the first row (by key) whose main entity's name contains the name of a function it calls, for each call in turn; code that calls none of them stays as it is."""
    called = F.transform(code.calls(F.col(column)), lambda c: c["name"])
    each = df.select(F.col(key).alias("_key"), F.posexplode(called).alias("_at", "_call"))
    named = df.select(F.col(key).alias("_of"), code.main_entity(F.col(column)).alias("_entity")).filter("_entity is not null")
    found = each.join(first_containing(each.select("_call").distinct(), named, "_call", "_entity", "_of", []), "_call")
    bodies = found.join(df.select(F.col(key).alias("_of"), F.col(column).alias("_code")), "_of")
    told = bodies.groupBy("_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_code"))), lambda x: x["_code"]), "\n\n").alias("_told"))
    joined = df.join(told, df[key] == told["_key"], "left")
    return joined.withColumn(name, F.when(F.col("_told").isNull(), F.col(column)).otherwise(F.concat(F.col(column), F.lit("\n\n Related Code: "), F.col("_told")))).drop("_key", "_told")
