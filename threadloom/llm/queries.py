"""The corpus operators' queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import chat, exact, mixing, packing, quality, simhash, suffix, urls, vectors, warc
from threadloom.llm.common import shared_dir, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An example for each assistant turn."""
    return chat.prefix_examples(table(spark, sf_dir, "conversations"))


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the WARC files written for all pages."""
    return warc.write_warc(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of each passage that other documents repeat."""
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, class_id, links) of every vector."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score) of the documents that the classifier accepts."""
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id) of each copy."""
    return exact.exact_copies(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, shard, block, tokens) of the mixture."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, offset, doc_id, start, n_tokens)."""
    return packing.packs(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, canonical, listed); the list holds the pages of two sites."""
    pages = table(spark, sf_dir, "pages")
    return urls.mark_listed(pages, urls.listed_pages(pages))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id) of each document that goes."""
    return simhash.near_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_warc_writer,
        op3_suffix_array_dedup,
        op4_embedding_near_dedup,
        op5_quality_classifier,
        op6_exact_dedup,
        op7_source_mixing,
        op8_best_fit_packing,
        op9_url_filter,
        op10_simhash_near_dedup,
    )
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.SQL,
    "op3_suffix_array_dedup": suffix.SQL,
    "op4_embedding_near_dedup": vectors.SQL,
    "op9_url_filter": urls.SQL,
    "op6_exact_dedup": """
        select doc_id, keep_id from (
            select doc_id, row_number() over w as rank, first_value(doc_id) over w as keep_id
            from documents where text is not null
            window w as (partition by text order by doc_id nulls last)
        ) where rank > 1""",
    "op7_source_mixing": f"""
        with units as (
            select source, doc_id, cast(sum(case when text is null then 0 else len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) end) as bigint) as tokens
            from documents group by source, doc_id
        ), keyed as (
            select *, md5('{mixing.SEED}|' || coalesce(cast(doc_id as varchar), '')) as key,
                cast(floor(sum(tokens) over (partition by source) / {mixing.BLOCK * mixing.SHARD_BLOCKS}) as bigint) + 1 as shards from units
        ), sharded as (
            select *, cast('0x' || substr(key, 1, 15) as bigint) % shards as shard from keyed
        ), placed as (
            select doc_id, source, shard, tokens, cast(floor(coalesce(sum(tokens) over (partition by source, shard order by key, doc_id nulls last rows between unbounded preceding and 1 preceding), 0) / {mixing.BLOCK}) as bigint) as block
            from sharded
        ), filled as (
            select source, shard, block, sum(tokens) as tokens from placed group by all
        ), blocks as (
            select *, greatest(1, coalesce(lead(block) over (partition by source, shard order by block), cast(ceil(sum(tokens) over (partition by source, shard) / {mixing.BLOCK}) as bigint)) - block) as seats from filled
        ), sources as (
            select source, sum(seats)::bigint as n, round(pow(cast(sum(tokens) as double), {mixing.ALPHA})) as weight from blocks group by source
        ), seats as (
            select source, row_number() over (order by weight / (2 * k + 1) desc, source nulls last) as seat
            from (select source, weight, unnest(range(n)) as k from sources)
        ), source_quota as (
            select source, count(*) as quota from seats where seat <= (select floor({mixing.FRACTION} * sum(n)) from sources) group by source
        ), shards as (
            select source, shard, sum(seats)::bigint as n from blocks group by all
        ), shard_seats as (
            select source, shard, row_number() over (partition by source order by n / (2 * k + 1) desc, shard) as seat
            from (select source, shard, n, unnest(range(n)) as k from shards)
        ), shard_quota as (
            select s.source, s.shard, count(*) as quota
            from shard_seats s join source_quota q on s.source is not distinct from q.source
            where s.seat <= q.quota group by all
        ), ranked as (
            select source, shard, block, coalesce(sum(seats) over (partition by source, shard order by md5('{mixing.SEED}|' || coalesce(source, '') || '|' || shard || '|' || block), block rows between unbounded preceding and 1 preceding), 0) as before from blocks
        )
        select p.doc_id, p.source, p.shard, p.block, p.tokens
        from placed p
        join ranked r on p.source is not distinct from r.source and p.shard = r.shard and p.block = r.block
        join shard_quota q on r.source is not distinct from q.source and r.shard = q.shard
        where r.before < q.quota""",
}
