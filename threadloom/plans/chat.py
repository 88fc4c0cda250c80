"""A chat over a stored thread, and a catalogue of prompts by subject and perspective."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import messages
from threadloom.operators.generate import Generator
from threadloom.operators.thread import Thread
from threadloom.schema import MESSAGE

FAILED = "Sorry, there was an error generating a response."


@dataclass
class MemoryChat:
    """Keeps the thread of one conversation within a budget; the provider runs on the driver, a call a turn."""

    spark: SparkSession
    provider: Generator
    max_memory: int | None = None
    max_history: int | None = None
    system_prompt: str | None = messages.DEFAULT_SYSTEM
    user_template: str = "{question}"
    conversation_id: str = "chat"
    thread: Thread | None = None
    logs: dict[str, list] = field(default_factory=lambda: {"inputs": [], "outputs": [], "prompts": [], "failed": []})

    def __post_init__(self) -> None:
        self.thread = self.thread or Thread.empty(self.spark, max_memory=self.max_memory)

    def _append(self, role: str, content: str) -> None:
        row = self.spark.createDataFrame([(self.conversation_id, role, content, 0)], "conversation_id string, role string, content string, seq long")
        added = self.thread.add(row)
        rows = added.df.collect()  # one conversation within its budget: the plan doesn't grow with the turns
        self.thread = added._with(self.spark.createDataFrame(rows, added.df.schema))

    def prompt(self, question: str) -> list[dict]:
        """System prompt, history within max_history tokens, and the templated question."""
        df = self.thread.df
        if self.max_history is not None:
            near = self.thread.token_bound_history(self.max_history).select("conversation_id", F.col("index").alias("seq"))
            df = df.join(near, ["conversation_id", "seq"], "left_semi")
        told = self.thread._with(df).history_messages().select("messages")
        one = told.unionByName(self.spark.createDataFrame([([],)], f"messages array<{MESSAGE.simpleString()}>")).orderBy(F.desc(F.size("messages"))).limit(1)
        row = one.select(messages.composed(F.col("messages"), F.lit(question), self.system_prompt, self.user_template).alias("m")).first()
        return [m.asDict() for m in row["m"]]

    def reply(self, question: str) -> str:
        asked = self.prompt(question)
        self.logs["inputs"].append(question)
        self.logs["prompts"].append(asked)
        try:
            said = self.provider.complete(asked)
        except Exception as e:  # the chat goes on; the failure is logged
            self.logs["failed"].append({"question": question, "error": str(e)})
            return FAILED
        self.logs["outputs"].append(said)
        self._append("user", question)
        self._append("assistant", said)
        return said

    def reset_logs(self) -> None:
        for entries in self.logs.values():
            entries.clear()


class PerspectivePrompts:
    r"""Prompts keyed `subject\perspective`: a table (key, prompt)."""

    def __init__(self, df: DataFrame):
        parts = F.split("key", r"\\")
        self.df = df.select(F.get(parts, F.lit(0)).alias("subject"), F.get(parts, F.lit(1)).alias("perspective"), "key", "prompt")

    def subjects(self) -> DataFrame:
        return self.df.select("subject").distinct()

    def perspectives(self) -> DataFrame:
        return self.df.select("perspective").distinct()

    def get(self, subject: str, perspective: str) -> str:
        row = self.df.filter((F.col("subject") == subject) & (F.col("perspective") == perspective)).select("prompt").first()
        if row is None:
            raise KeyError(f"{subject}\\{perspective}")
        return row["prompt"]

    def random(self, seed: int = 0) -> str:
        """The prompt first in a seeded order."""
        return self.df.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(1).first()["prompt"]
