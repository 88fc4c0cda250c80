"""The topic plan: conversations are summarised, embedded and clustered; clusters are labelled and joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import cluster as clusters_of
from threadloom.operators.generate import Embedder, Generator, RunStore, embedded, generated
from threadloom.operators.thread import conversations

SUMMARY_PROMPT = "Summarise the conversation in a few sentences."
CHECK_PROMPT = "Say whether the topic fits the conversations, and give a better one if it does not."
TOPIC_PROMPT = "Name the topic that these conversations share in a few words."


def topic_features(thread: DataFrame, clusters: DataFrame, label: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Messages with their conversation's cluster and what `label` adds to the clusters.

    clusters: (conversation_id, cluster); label gets (cluster, content), the joined text of a cluster.
    """
    whole = conversations(thread).select("conversation_id", "content").join(clusters, "conversation_id")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("conversation_id", "content"))), lambda x: x["content"])
    grouped = whole.groupBy("cluster").agg(F.array_join(ordered, " ").alias("content"))
    topics = label(grouped).drop("content")
    return thread.join(clusters, "conversation_id").join(topics, "cluster")


def checked(topics: DataFrame, generator: Callable[[], Generator], store: RunStore | None = None, run_id: str = "topic-check") -> DataFrame:
    """Topics (cluster, topic, content) with `topic_check`, what the generator says to the label beside its text: a second pass over all of them."""
    asked = topics.withColumn("_asked", F.concat_ws("\n\n", F.concat(F.lit("Topic: "), F.coalesce("topic", F.lit(""))), "content"))
    return generated(asked, "_asked", "cluster", generator, CHECK_PROMPT, "topic_check", store, run_id).drop("_asked")


def run(
    thread: DataFrame,
    generator: Callable[[], Generator],
    embedder: Callable[[], Embedder],
    run_summary: bool = False,
    cosine: float = 0.4,
    least: int = 2,
    store: RunStore | None = None,
    run_id: str = "topics",
) -> DataFrame:
    """Messages with `cluster` and `topic`; without run_summary the joined conversations are embedded as they are."""
    whole = conversations(thread).select("conversation_id", "content")
    column = "content"
    if run_summary:
        whole, column = generated(whole, "content", "conversation_id", generator, SUMMARY_PROMPT, "summary", store, f"{run_id}-summary"), "summary"
    vectors = embedded(whole, column, "conversation_id", embedder, "embedding", store, f"{run_id}-embedding")
    told = F.when(F.exists("embedding", lambda x: x != 0), F.col("embedding"))  # zeros, of an empty text, are near nothing
    found = clusters_of.density(vectors.select("conversation_id", told.alias("embedding")), "conversation_id", "embedding", cosine, least)
    found = clusters_of.checkpointed(found)
    return topic_features(thread, found, lambda g: generated(g, "content", "cluster", generator, TOPIC_PROMPT, "topic", store, f"{run_id}-topic"))
