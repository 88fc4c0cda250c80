"""Conversation threads: an ordered message table, its predicates, positional slices and budgets.

Order is data: `seq` numbers the messages of a conversation from 0, set once at ingest. All retrievals
stay lazy. `by` names the columns that separate threads; with `by=()` the table is one thread, which
brings windows onto one partition and suits small tables only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.tokens import DEFAULT, Tokenizer, message_tokens
from threadloom.schema import THREAD

BY = ("conversation_id",)


def from_messages(df: DataFrame, order: Sequence[str], tokenizer: Tokenizer = DEFAULT, by: Sequence[str] = BY, clock: Column | None = None) -> DataFrame:
    """A thread table from rows with role and content (and any other THREAD columns, which may be missing).

    Missing ids, titles and times become null, upload_time the clock (default: now), message_id a hash
    of thread and position, parent_id the message before.
    """
    have = set(df.columns)
    fields = {f.name: f for f in THREAD}
    get = lambda n: F.col(n).cast(fields[n].dataType) if n in have else F.lit(None).cast(fields[n].dataType)
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = df.withColumn("seq", number.cast("long"))
    key = _identity(by)
    made = {n: get(n) for n in fields}
    made["seq"] = F.col("seq")
    made["message_id"] = F.coalesce(get("message_id"), key)
    made["upload_time"] = F.coalesce(get("upload_time"), clock if clock is not None else F.unix_micros(F.current_timestamp()) / 1e6)
    made["tokens_count"] = message_tokens(F.col("content"), tokenizer)
    table = numbered.select(*[made[n].alias(n) for n in fields])
    return table if "parent_id" in have else with_parents(table, by)


def _identity(by: Sequence[str]) -> Column:
    """A message's id by thread and position."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], "seq"), 256)


def with_parents(thread: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """parent_id: message_id of the message before; null for the first."""
    return thread.withColumn("parent_id", F.lag("message_id").over(Window.partitionBy(*by).orderBy("seq")))


def thinned(thread: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Of a tree of messages in order: roots, and rows whose parent differs from the previous row's parent."""
    before = F.lag("parent_id").over(Window.partitionBy(*by).orderBy("seq"))
    return thread.withColumn("_before", before).filter(F.col("parent_id").isNull() | ~F.col("parent_id").eqNullSafe(F.col("_before"))).drop("_before")


def admitted(messages: DataFrame, max_memory: int | None, by: Sequence[str] = BY) -> DataFrame:
    """Budgeted append: in order of seq, a message is kept if the tokens kept so far and its own don't exceed the budget.

    A message that doesn't fit is skipped and a later, smaller one may still fit, so this is a fold and
    no running sum. It runs on one array a thread; with by=() one array holds the table.
    """
    if max_memory is None:
        return messages
    rest = [c for c in messages.columns if c not in by]
    item = F.struct("seq", "tokens_count", *[c for c in rest if c not in ("seq", "tokens_count")])
    fold = F.aggregate(
        F.transform("_rows", lambda r: F.coalesce(r["tokens_count"], F.lit(0)).cast("long")),
        F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<boolean>").alias("kept")),
        lambda s, t: F.struct(F.when(s["total"] + t <= max_memory, s["total"] + t).otherwise(s["total"]).alias("total"), F.array_append(s["kept"], s["total"] + t <= max_memory).alias("kept")),
    )
    whole = messages.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_rows")).withColumn("_kept", fold["kept"])
    each = whole.select(*by, F.explode(F.filter("_rows", lambda _, i: F.element_at("_kept", i + 1))).alias("_r"))
    return each.select(*[F.col(c) if c in by else F.col("_r")[c].alias(c) for c in messages.columns])


def fifo(thread: DataFrame, max_memory: int, by: Sequence[str] = BY) -> DataFrame:
    """Adds `longterm`: false for the longest suffix of the thread within the budget, true for what overflowed."""
    suffix = F.sum("tokens_count").over(Window.partitionBy(*by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    return thread.withColumn("longterm", suffix > max_memory)


def conversations(thread: DataFrame, by: Sequence[str] = BY, sep: str = " ") -> DataFrame:
    """(by..., contents array in order, content joined)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"])
    return thread.groupBy(*by).agg(ordered.alias("contents")).withColumn("content", F.array_join("contents", sep))


class Thread:
    """Methods over a thread table; each returns a DataFrame unless it says otherwise."""

    def __init__(self, df: DataFrame, by: Sequence[str] = BY, max_memory: int | None = None, tokenizer: Tokenizer = DEFAULT):
        self.df, self.by, self.max_memory, self.tokenizer = df, tuple(by), max_memory, tokenizer

    @classmethod
    def empty(cls, spark: SparkSession, **settings) -> Thread:
        return cls(spark.createDataFrame([], THREAD), **settings)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **settings) -> Thread:
        return cls(spark.read.schema(THREAD).parquet(path), **settings)

    def save(self, path: str) -> None:
        self.df.write.mode("overwrite").option("compression", "zstd").parquet(path)

    def reset_memory(self) -> Thread:
        return self._with(self.df.sparkSession.createDataFrame([], self.df.schema))

    def _with(self, df: DataFrame) -> Thread:
        return Thread(df, self.by, self.max_memory, self.tokenizer)

    def _window(self) -> Window:
        return Window.partitionBy(*self.by)

    @staticmethod
    def _matches(message: str | Mapping) -> Column:
        if isinstance(message, str):
            return F.col("content") == message
        return (F.col("content") == message["content"]) & (F.col("role") == message["role"])

    def _role(self, role: str | None) -> Column:
        return F.lit(True) if role is None else F.col("role") == role

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, index: int | slice) -> DataFrame:
        """Messages by position in each thread; negative positions count from the end."""
        size = F.count("*").over(self._window())

        def place(i: int | None, default: Column) -> Column:
            return default if i is None else F.lit(i) if i >= 0 else size + i

        if isinstance(index, int):
            keep = F.col("seq") == place(index, F.lit(0))
        else:
            if index.step not in (None, 1):
                raise ValueError("slices have step 1")
            keep = (F.col("seq") >= place(index.start, F.lit(0))) & (F.col("seq") < place(index.stop, size))
        return self.df.withColumn("_keep", keep).filter("_keep").drop("_keep")

    def total_tokens(self) -> DataFrame:
        """One row: (total_tokens), 0 for an empty thread."""
        return self.df.agg(F.coalesce(F.sum("tokens_count"), F.lit(0)).cast("long").alias("total_tokens"))

    def find_message(self, message: str | Mapping) -> DataFrame:
        """Messages with exactly this content (and role, if a mapping is given)."""
        return self.df.filter(self._matches(message))

    def find_role(self, role: str) -> DataFrame:
        return self.df.filter(F.col("role") == role)

    def filter_col(self, feature: str, value) -> DataFrame:
        return self.df.filter(F.col(feature) == value)

    def select_col(self, feature: str | Sequence[str]) -> DataFrame:
        return self.df.select(*([feature] if isinstance(feature, str) else feature))

    def messages_more_tokens(self, tokens: int, role: str | None = None) -> DataFrame:
        return self.df.filter((F.col("tokens_count") > tokens) & self._role(role))

    def messages_less_tokens(self, tokens: int, role: str | None = None) -> DataFrame:
        return self.df.filter((F.col("tokens_count") < tokens) & self._role(role))

    def messages_after_time(self, timestamp: float, role: str | None = None, column: str = "create_time") -> DataFrame:
        return self.df.filter((F.col(column) > timestamp) & self._role(role))

    def messages_before_time(self, timestamp: float, role: str | None = None, column: str = "create_time") -> DataFrame:
        return self.df.filter((F.col(column) < timestamp) & self._role(role))

    def first_message(self, role: str | None = None) -> DataFrame:
        """Of each thread."""
        return self._end(role, F.min_by)

    def last_message(self, role: str | None = None) -> DataFrame:
        """Of each thread."""
        return self._end(role, F.max_by)

    def _end(self, role: str | None, pick) -> DataFrame:
        rest = [c for c in self.df.columns if c not in self.by]
        ends = self.df.filter(self._role(role)).groupBy(*self.by).agg(pick(F.struct(*rest), F.col("seq")).alias("_m"))
        return ends.filter("_m is not null").select(*[F.col(c) if c in self.by else F.col("_m")[c].alias(c) for c in self.df.columns])

    def _anchor(self, message: str | Mapping) -> Column:
        """Position of the first match in its thread; null without one."""
        return F.min(F.when(self._matches(message), F.col("seq"))).over(self._window())

    def messages_before(self, message: str | Mapping) -> DataFrame:
        return self.df.withColumn("_a", self._anchor(message)).filter("seq < _a").drop("_a")

    def messages_after(self, message: str | Mapping) -> DataFrame:
        return self.df.withColumn("_a", self._anchor(message)).filter("seq > _a").drop("_a")

    def messages_between(self, start: str | Mapping, end: str | Mapping) -> DataFrame:
        """Strictly between the first matches."""
        return self.df.withColumn("_a", self._anchor(start)).withColumn("_b", self._anchor(end)).filter("seq > _a and seq < _b").drop("_a", "_b")

    def token_bound_history(self, max_tokens: int, role: str | None = None, only_role: str | None = None) -> DataFrame:
        """(by..., content, index, tokens_so_far): the newest messages whose running sum over all roles stays within the bound.

        `role` is left out of the result, `only_role` alone stays in it; both count in the sum.
        """
        newest = self._window().orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
        kept = self.df.withColumn("tokens_so_far", F.sum("tokens_count").over(newest)).filter(F.col("tokens_so_far") <= max_tokens)
        if role is not None:
            kept = kept.filter(~F.col("role").eqNullSafe(F.lit(role)))
        if only_role is not None:
            kept = kept.filter(F.col("role") == only_role)
        return kept.select(*self.by, "content", F.col("seq").alias("index"), "tokens_so_far")

    def remove(self, message: str | Mapping | None = None, idx: int | None = None) -> Thread:
        """Without the message at a position (of each thread), or without all of a content; positions close up."""
        if idx is not None:
            kept = self.df.filter(F.col("seq") != idx)
        elif message is not None:
            kept = self.df.filter(F.col("content") != (message if isinstance(message, str) else message["content"]))
        else:
            raise ValueError("name a position or a message")
        return self._with(kept.withColumn("seq", (F.row_number().over(self._window().orderBy("seq")) - 1).cast("long")))

    def add(self, messages: DataFrame) -> Thread:
        """Appended messages (role, content, ..., in order of their own seq) as far as the budget allows."""
        size = self.df.groupBy(*self.by).agg((F.max("seq") + 1).alias("_n"), F.sum("tokens_count").alias("_t"))
        names = [f.name for f in THREAD]
        fresh = from_messages(messages, ["seq"], self.tokenizer, self.by).join(size, list(self.by), "left")
        fresh = fresh.withColumn("seq", F.col("seq") + F.coalesce("_n", F.lit(0)))
        if "message_id" not in messages.columns:  # ids follow the position in the whole thread
            fresh = fresh.withColumn("message_id", _identity(self.by))
        fresh = fresh.select(*names)
        both = self.df.select(*names).unionByName(fresh)
        return self._with(with_parents(admitted(both, self.max_memory, self.by), self.by))

    def history_messages(self) -> DataFrame:
        """(by..., messages): the thread as a message array, for prompts."""
        rows = F.transform(F.sort_array(F.collect_list(F.struct("seq", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        return self.df.groupBy(*self.by).agg(rows.alias("messages"))
