"""Batch generation: requests, estimates, providers, and a store of finished rows.

A provider is built on the executors and called for a batch of rows from a few threads; it retries
single rows, so that a repeated task doesn't repeat a whole partition's calls, and waits as long as a
reset header says. With `limits`, the requests and tokens a minute are shared by the tasks that can run
at once. Results are joined by row id, never by position, and written once a run: rows that a run has
finished with the same input are not asked again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from threadloom.functions.messages import request_messages
from threadloom.functions.tokens import DEFAULT, Tokenizer
from threadloom.operators.cluster import checkpointed
from threadloom.schema import embedding_col

#: model, dollars per 1000 tokens, endpoint, requests and tokens a minute
PRICES = [
    ("gpt-3.5-turbo", 0.0015, "chat/completions", 3500, 90_000),
    ("gpt-3.5-turbo-16k", 0.003, "chat/completions", 3500, 180_000),
    ("gpt-4", 0.03, "chat/completions", 3500, 90_000),
    ("text-embedding-ada-002", 0.0001, "embeddings", 3000, None),
]
DEFAULT_MODEL, DEFAULT_MAX_TOKENS, WORKERS, ATTEMPTS = "gpt-3.5-turbo", 1000, 17, 5


class Transient(Exception):
    """Worth another try, after the wait that the response's reset header names, if there is one."""

    def __init__(self, said: str = "", reset: str | None = None):
        super().__init__(said)
        self.wait = waited(reset) if reset is not None else None


def waited(header: str) -> float:
    """Seconds of a reset header, as `reset_seconds` reads them; 0.01 for what isn't a number."""
    for unit, scale in (("ms", 1000.0), ("s", 1.0)):
        if unit in header:
            try:
                return float(header.removesuffix(unit)) / scale
            except ValueError:
                break
    return 0.01


class Generator(Protocol):
    def complete(self, messages: list[dict]) -> str: ...


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


class EchoGenerator:
    """Gives back the last message."""

    def complete(self, messages: list[dict]) -> str:
        return messages[-1]["content"] or "" if messages else ""


class LeadingWords:
    """Gives back the first n words of the last message: a stand-in for a summary."""

    def __init__(self, n: int = 20):
        self.n = n

    def complete(self, messages: list[dict]) -> str:
        return " ".join((messages[-1]["content"] or "").split()[: self.n])


class HashingEmbedder:
    """Signed feature hashing of words, of length 1 (zeros for an empty text)."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.dims
        for w in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[h % self.dims] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm for x in out] if norm else out


class Limiter:
    """A budget of requests and tokens a minute, shared by the threads of a partition; it refills evenly."""

    def __init__(self, requests: float, tokens: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most = (requests, tokens if tokens is not None else float("inf"))
        self.left, self.clock, self.sleep, self.lock = list(self.most), clock, sleep, Lock()
        self.at = clock()

    def take(self, tokens: float) -> None:
        """Waits until a request of so many tokens is within the budget; one above the whole budget waits for a full one."""
        while True:
            with self.lock:
                now = self.clock()
                self.left = [min(m, x + (now - self.at) * m / 60) if m != float("inf") else m for x, m in zip(self.left, self.most, strict=True)]
                self.at = now
                if self.left[0] >= 1 and self.left[1] >= min(tokens, self.most[1]):
                    self.left = [self.left[0] - 1, self.left[1] - tokens]
                    return
            self.sleep(0.05)


def requests(df: DataFrame) -> DataFrame:
    """Defaults filled in: an `input` asks for an embedding, anything else for a chat completion."""
    have = set(df.columns)
    get = lambda n, kind: F.col(n) if n in have else F.lit(None).cast(kind)
    is_embedding = get("input", "string").isNotNull()
    out = df.withColumn("request_type", F.when(is_embedding, "embeddings").otherwise("chat"))
    out = out.withColumn("model", F.coalesce(get("model", "string"), F.when(is_embedding, PRICES[3][0]).otherwise(DEFAULT_MODEL)))
    chat = "array<struct<role:string,content:string>>"
    for name, kind, default in (("n", "int", F.lit(1)), ("max_tokens", "int", F.lit(DEFAULT_MAX_TOKENS)), ("messages", chat, F.array().cast(chat))):
        out = out.withColumn(name, F.when(is_embedding, F.lit(None)).otherwise(F.coalesce(get(name, kind), default)).cast(kind))
    return out if "input" in have else out.withColumn("input", F.lit(None).cast("string"))


def estimated_tokens(messages: Column, given: Column, max_tokens: Column, tokenizer: Tokenizer = DEFAULT) -> Column:
    """Embedding: tokens of the input. Chat: 4 a message and the tokens of its values, 2 for the reply's opening, and max_tokens."""
    one = lambda m: 4 + F.coalesce(tokenizer.count(m["role"]), F.lit(0)) + F.coalesce(tokenizer.count(m["content"]), F.lit(0))
    chat = F.aggregate(F.transform(messages, one), F.lit(0), lambda s, x: s + x) + 2 + max_tokens
    return F.when(given.isNotNull(), tokenizer.count(given)).otherwise(chat)


def priced(df: DataFrame, model: str = "model", tokens: str = "total_tokens") -> DataFrame:
    """Adds endpoint, requests_per_minute, tokens_per_minute and estimated_cost; nulls for unknown models."""
    prices = df.sparkSession.createDataFrame(PRICES, "_model string, _price double, endpoint string, requests_per_minute int, tokens_per_minute int")
    joined = df.join(F.broadcast(prices), df[model] == prices["_model"], "left")  # four rows
    return joined.withColumn("estimated_cost", F.col(tokens) / 1000 * F.col("_price")).drop("_model", "_price")


def batch_totals(df: DataFrame, model: str = "model", tokens: str = "total_tokens") -> DataFrame:
    """(model, requests, total_tokens, estimated_cost) of a batch, and a row for all of it with a null model; the cost of unknown models is null and adds nothing."""
    made = priced(df.select(F.col(model).alias("model"), F.col(tokens).alias("total_tokens")))
    sums = [F.count("*").alias("requests"), F.sum("total_tokens").alias("total_tokens"), F.sum("estimated_cost").alias("estimated_cost")]
    by = made.groupingSets([["model"], []], "model").agg(F.grouping("model").alias("_all"), *sums)
    return by.select(F.when(F.col("_all") == 0, F.coalesce("model", F.lit("unknown"))).alias("model"), "requests", "total_tokens", "estimated_cost")


def error_class(text: Column) -> Column:
    """rate_limit and overloaded are tried again, api is not; null is success."""
    return F.when(text.isNull(), None).when(text.contains("Rate limit"), "rate_limit").when(text.contains("currently overloaded"), "overloaded").otherwise("api")


def reset_seconds(header: Column) -> Column:
    """`250ms` 0.25, `6s` 6.0, others without an s 0.01; null for what isn't a number before it."""
    ms = F.regexp_extract(header, r"^([0-9]+(?:\.[0-9]+)?)ms$", 1).try_cast("double") / 1000
    s = F.regexp_extract(header, r"^([0-9]+(?:\.[0-9]+)?)s$", 1)
    return F.when(header.contains("ms"), ms).when(header.contains("s"), F.when(s != "", s.try_cast("double"))).otherwise(0.01)


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """One row of counters."""
    c = F.col(status)
    names = {"rate_limit_errors": "rate_limit", "overloaded_errors": "overloaded", "api_errors": "api", "other_errors": "other"}
    return df.agg(F.count("*").alias("started"), F.count_if(c == "ok").alias("succeeded"), *[F.count_if(c == v).alias(k) for k, v in names.items()])


def chat_rows(responses: DataFrame, response: str = "response") -> DataFrame:
    """Output rows of chat responses in JSON: output and token counts; all other columns stay."""
    r = F.col(response)
    return responses.select(
        *[c for c in responses.columns if c != response],
        F.get_json_object(r, "$.choices[0].message.content").alias("output"),
        *[F.get_json_object(r, f"$.usage.{n}").try_cast("int").alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")],
    )


def embedding_rows(responses: DataFrame, response: str = "response") -> DataFrame:
    r = F.col(response)
    return responses.select(
        *[c for c in responses.columns if c != response],
        F.from_json(F.get_json_object(r, "$.data[0].embedding"), "array<double>").alias("output"),
        *[F.get_json_object(r, f"$.usage.{n}").try_cast("int").alias(n) for n in ("prompt_tokens", "total_tokens")],
    )


def shared_limits(spark: SparkSession, model: str) -> tuple[float, float | None]:
    """A task's share of the requests and tokens a minute of a model: as many tasks as there are cores run at once."""
    for name, _, _, asked, tokens in PRICES:
        if name == model:
            n = max(1, spark.sparkContext.defaultParallelism)
            return asked / n, None if tokens is None else tokens / n
    raise ValueError(f"no limits are known of {model!r}")


def _size(value: object) -> int:
    """About as many tokens as `estimated_tokens` has, without the reply."""
    if isinstance(value, str) or value is None:
        return len((value or "").split())
    return 2 + sum(4 + len(str(m["role"] or "").split()) + len((m["content"] or "").split()) for m in value)


def _called(provider: Callable[[], object], ask: Callable[[object, object], object], attempts: int, workers: int, pause: float, kind: str, limits: tuple[float, float | None] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def one(made: object, limiter: Limiter | None, value: object) -> tuple:
        said = None
        for k in range(attempts):
            if limiter:
                limiter.take(_size(value))
            try:
                return ask(made, value), "ok", k + 1, None
            except Transient as e:
                said = str(e)
                time.sleep(pause * 2**k if e.wait is None else e.wait)
            except Exception as e:  # a failed row is a row with a status
                return None, "other", k + 1, str(e)
        return None, "overloaded" if "overloaded" in (said or "") else "rate_limit", attempts, said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, limiter = provider(), Limiter(*limits) if limits else None
        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                got = list(pool.map(lambda v: one(made, limiter, v), pdf[kind]))
                yield pd.DataFrame({"row_id": pdf["row_id"], "output": [g[0] for g in got], "status": [g[1] for g in got], "attempts": [g[2] for g in got], "error": [g[3] for g in got]})

    return run


def complete(df: DataFrame, provider: Callable[[], Generator], attempts: int = ATTEMPTS, workers: int = WORKERS, pause: float = 0.01, limits: tuple[float, float | None] | None = None) -> DataFrame:
    """(row_id, output, status, attempts, error) of rows (row_id, messages)."""
    ask = lambda g, m: g.complete([x if isinstance(x, dict) else x.asDict() for x in m])
    run = _called(provider, ask, attempts, workers, pause, "messages", limits)
    kind = df.schema["row_id"].dataType.simpleString()
    return df.select("row_id", "messages").mapInPandas(run, f"row_id {kind}, output string, status string, attempts int, error string")


def embed(df: DataFrame, provider: Callable[[], Embedder], attempts: int = ATTEMPTS, workers: int = WORKERS, pause: float = 0.01, limits: tuple[float, float | None] | None = None) -> DataFrame:
    """(row_id, output, status, attempts, error) of rows (row_id, input); output is a vector."""
    run = _called(provider, lambda e, t: e.embed(t), attempts, workers, pause, "input", limits)
    kind = df.schema["row_id"].dataType.simpleString()
    return df.select("row_id", "input").mapInPandas(run, f"row_id {kind}, output array<double>, status string, attempts int, error string")


class RunStore:
    """Finished rows by run, in Parquet below a shared path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def finished(self, run_id: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/run_id={run_id}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def run(self, run_id: str, rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Results of all rows; only those without an `ok` result of this run for the same input are worked on."""
        given = [c for c in rows.columns if c != "row_id"]
        keys = rows.select("row_id", F.md5(F.to_json(F.struct(*given))).alias("input_key"))
        old = self.finished(run_id)
        todo = keys if old is None else keys.join(old.filter("status = 'ok'").select("row_id", "input_key"), ["row_id", "input_key"], "left_anti")
        asked = rows.join(todo.select("row_id").distinct(), "row_id", "left_semi")
        work(asked).join(keys, "row_id").write.mode("append").parquet(f"{self.path}/run_id={run_id}")
        new = self.finished(run_id).join(keys.distinct(), ["row_id", "input_key"], "left_semi").drop("input_key")
        best = new.groupBy("row_id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "row_id"]), F.when(F.col("status") == "ok", 1).otherwise(0)).alias("_r"))
        return best.select("row_id", "_r.*")

    def write_logs(self, run_id: str) -> None:
        """errors/ and status/ as NDJSON beside the results."""
        done = self.finished(run_id)
        done.filter("status <> 'ok'").select(F.col("status").alias("type"), F.unix_timestamp().cast("double").alias("time"), F.col("error").alias("response")).write.mode("overwrite").json(f"{self.path}/errors/{run_id}")
        status_counts(done).withColumn("name", F.lit(run_id)).write.mode("overwrite").json(f"{self.path}/status/{run_id}")


def generated(df: DataFrame, column: str, row_id: str, provider: Callable[[], Generator], system_prompt: str, output: str = "output", store: RunStore | None = None, run_id: str | None = None) -> DataFrame:
    """df with the generated text for a column; failed rows get null. Rows are asked once, at this call."""
    asked = df.select(F.col(row_id).alias("row_id"), request_messages(F.col(f"`{column}`"), system_prompt).alias("messages"))
    work = lambda rows: complete(rows, provider)
    made = store.run(run_id, asked, work) if store else checkpointed(work(asked))
    return _attach(df, made, row_id, output)


def embedded(df: DataFrame, column: str, row_id: str, provider: Callable[[], Embedder], output: str | None = None, store: RunStore | None = None, run_id: str | None = None) -> DataFrame:
    """df with `embedding|column`."""
    asked = df.select(F.col(row_id).alias("row_id"), F.col(f"`{column}`").alias("input"))
    work = lambda rows: embed(rows, provider)
    made = store.run(run_id, asked, work) if store else checkpointed(work(asked))
    return _attach(df, made, row_id, output or embedding_col(column))


def _attach(df: DataFrame, made: DataFrame, row_id: str, output: str) -> DataFrame:
    right = made.select(F.col("row_id").alias("_row"), F.col("output").alias("_out"))
    return df.join(right, df[row_id] == right["_row"], "left").withColumn(output, F.col("_out")).drop("_row", "_out")
