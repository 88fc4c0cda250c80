"""Schemas, fixed names and the column-name protocol."""

from __future__ import annotations

from pyspark.sql import types as T

THREAD = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("conversation_title", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("upload_time", T.DoubleType()),
        T.StructField("create_time", T.DoubleType()),
        T.StructField("update_time", T.DoubleType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tokens_count", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

REQUEST = "model string, input string, messages array<struct<role: string, content: string>>, n int, max_tokens int, temperature double, top_p double, user string"
CHAT_RESULT = "id long, start_time long, output string, prompt_tokens int, completion_tokens int, total_tokens int, end_time long, remaining_token_capacity int"
EMBEDDING_RESULT = "id long, start_time long, output array<double>, prompt_tokens int, total_tokens int, end_time double, remaining_token_capacity int"
ERROR = "type string, time double, response string"
CHAT_EXPORT = "id string, title string, mapping map<string, struct<message: struct<create_time: double, update_time: double, author: struct<role: string>, content: struct<parts: array<string>>>>>"

#: Descriptive columns a frame may carry; a declaration only.
META_COLUMNS = ("Source", "Author", "Created At", "Last Modified At", "ID", "Name")


def tokens_col(column: str) -> str:
    return f"tokens|{column}"


def tokens_len_col(column: str) -> str:
    return f"tokens_len|{column}"


def embedding_col(column: str) -> str:
    return f"embedding|{column}"


def quoted(column: str) -> str:
    """Back-ticked for use in SQL expressions: the protocol's names hold a bar."""
    return "`" + column.replace("`", "``") + "`"
