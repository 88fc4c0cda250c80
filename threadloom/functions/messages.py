"""Chat messages as array<struct<role, content>> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SYSTEM = "You are a helpful assistant. You give concise and complete answers."


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def system(content: Column) -> Column:
    return message("system", content)


def question(content: Column) -> Column:
    return message("user", content)


def answer(content: Column) -> Column:
    return message("assistant", content)


def request_messages(value: Column, system_prompt: str) -> Column:
    """The system prompt, then the value as a user message."""
    return F.array(system(F.lit(system_prompt)), question(value))


def prompt_string(messages: Column) -> Column:
    """` #ROLE: content` of every message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(" #"), F.upper(m["role"]), F.lit(": "), m["content"])), "")


def composed(history: Column, asked: Column, system_prompt: str | None = DEFAULT_SYSTEM, user_template: str = "{question}") -> Column:
    """System prompt, history and the templated question; in the history every role but system speaks as user."""
    told = F.transform(history, lambda m: F.struct(F.when(m["role"] == "system", "system").otherwise("user").alias("role"), m["content"].alias("content")))
    last = F.array(question(F.replace(F.lit(user_template), F.lit("{question}"), asked)))
    return F.concat(F.array(system(F.lit(system_prompt))), told, last) if system_prompt else F.concat(told, last)


def reply_text(response: Column, model: Column) -> Column:
    """The reply in a JSON response: of a chat model, or of a command model, whose `#ASSISTANT` marks go."""
    chat = F.get_json_object(response, "$.choices[0].message.content")
    command = F.replace(F.get_json_object(response, "$.text"), F.lit("#ASSISTANT"), F.lit(""))
    return F.when(model.contains("gpt"), chat).when(model.contains("command"), command)


def is_message(kind: T.DataType) -> bool:
    """Whether a column of this type holds one message, or an array of them."""
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return isinstance(kind, T.StructType) and {"role", "content"} <= set(kind.names)


def checked_message(df: DataFrame, column: str) -> Column:
    """The column as one message: a struct, or the sole entry of an array (raises on any other length)."""
    kind = df.schema[column].dataType
    if not is_message(kind):
        raise TypeError(f"{column} holds no message")
    if isinstance(kind, T.StructType):
        return F.col(column)
    return F.when(F.size(column) == 1, F.get(column, F.lit(0))).otherwise(F.raise_error(F.lit("not a single message")))
