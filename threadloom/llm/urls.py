"""URL filter: a blocked Bloom filter in front of an exact hash join.

The listed canonical URLs set one bit in each of the eight 32-bit words of a 256-bit block, so a
probe touches one block.  The filter is built in ranges of blocks, one task a range.  Up to
`FILTER_BYTES` it is sent to all executors; a larger one stays in its ranges, and URLs go to the range
of their block instead (each range in `SALTS_OF_RANGE` copies, so that pages of one URL don't meet in a
task).  URLs that it rules out pass at once, possible hits go on to a join on the whole canonical URL,
which removes the false positives.

Defined results: a null URL is never listed and has no canonical form; a null on the list lists
nothing; repeated pages are judged alike; an empty list lists nothing; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from threadloom.llm.common import cut, parallelism, pick, small_or_hashed

FILTER_BYTES, BITS = 64 << 20, 16
RANGE_BLOCKS, SALTS_OF_RANGE = 1 << 17, 8
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host(url: Column) -> Column:
    """Lower-case host without `www.`, `m.` and the default ports."""
    whole = F.lower(F.regexp_extract(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "^[^/?#]*", 0))
    return F.regexp_replace(F.regexp_replace(whole, "^(www|m)\\.", ""), ":(80|443)$", "")


def canonical(url: Column) -> Column:
    """Host, path without a last slash, and the sorted query without tracking parameters; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "(?s)^[^?]*", 0), "/$", "")
    asked = F.filter(F.split(F.regexp_replace(rest, "(?s)^[^?]*\\??", ""), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.concat(host(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _place(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit hash, and its eight masks."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h.astype(np.uint32)
    return block.astype(np.int64), np.uint32(1) << ((low[:, None] * SALTS) >> np.uint32(27))


def insert(h: np.ndarray, blocks: int) -> np.ndarray:
    """blocks x 8 words."""
    out = np.zeros((blocks, 8), np.uint32)
    block, mask = _place(h, blocks)
    for w in range(8):
        np.bitwise_or.at(out[:, w], block, mask[:, w])
    return out


def probe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False: certainly not inserted."""
    block, mask = _place(h, len(words))
    return ((words[block] & mask) == mask).all(axis=1)


def _blocks(count: int) -> int:
    return max(1, -(-count * BITS // 256))


def _range(blocks: int, span: int) -> Column:
    """The range of the block of `h`, in whole numbers as in `_place`."""
    return F.expr(f"shiftrightunsigned(shiftrightunsigned(h, 32) * {blocks}L, 32) div {span}L")


def ranges(hashes: DataFrame, blocks: int, span: int) -> DataFrame:
    """(part, words): the filter for the column `h`, `span` blocks a row."""

    def part(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        block, mask = _place(group.column("h").to_numpy().view(np.uint64), blocks)
        words = np.zeros((span, 8), np.uint32)
        for w in range(8):
            np.bitwise_or.at(words[:, w], block - key[0].as_py() * span, mask[:, w])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

    return hashes.select("h", _range(blocks, span).alias("part")).groupBy("part").applyInArrow(part, "part long, words binary")


def build(hashes: DataFrame, count: int) -> np.ndarray:
    """The whole filter."""
    blocks = _blocks(count)
    span = -(-blocks // min(blocks, parallelism(hashes.sparkSession)))
    out = np.zeros((-(-blocks // span) * span, 8), np.uint32)
    for row in ranges(hashes, blocks, span).collect():
        out[row.part * span : (row.part + 1) * span] = np.frombuffer(row.words, np.uint32).reshape(span, 8)
    return out[:blocks]


def tried_in_ranges(pages: DataFrame, hashes: DataFrame, count: int, span: int | None = None) -> DataFrame:
    """`pages` (page_id, url, canonical) with `maybe`, where the filter is too large to be sent to all."""
    blocks, span = _blocks(count), span or RANGE_BLOCKS
    page = [F.col(c) for c in ("page_id", "url", "canonical")]
    salt = F.pmod(F.xxhash64(*page[:2]), F.lit(SALTS_OF_RANGE))
    asked = pages.withColumn("h", F.xxhash64("canonical")).select(_range(blocks, span).alias("part"), salt.alias("salt"), F.lit(None).cast("binary").alias("words"), "h", *page)
    kinds = {f.name: f.dataType for f in pages.schema}
    empty = [F.lit(None).cast("long").alias("h"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("page_id", "url", "canonical")]]
    filters = ranges(hashes, blocks, span).select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS_OF_RANGE - 1).cast("long"))).alias("salt"), "words", *empty)
    together = asked.unionByName(filters).repartition("part", "salt").sortWithinPartitions("part", "salt", F.desc_nulls_last("words"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = None, None
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in (0, 1)], 1)
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if (now := tuple(key[lo])) != at:
                    at, words = now, None
                if lo < hi and b.column(2)[lo].is_valid:
                    words, lo = np.frombuffer(b.column(2)[lo].as_py(), np.uint32).reshape(-1, 8), lo + 1
                rows = b.slice(lo, hi - lo)
                h = rows.column(3).to_numpy().view(np.uint64)
                if words is None:
                    hit = np.zeros(h.size, bool)
                else:
                    block, mask = _place(h, blocks)
                    hit = ((words[block - at[0] * span] & mask) == mask).all(axis=1)
                yield pa.RecordBatch.from_arrays([*rows.columns[4:], pa.array(hit)], ["page_id", "url", "canonical", "maybe"])

    schema = StructType([*[StructField(c, kinds[c]) for c in ("page_id", "url", "canonical")], StructField("maybe", BooleanType())])
    return together.mapInArrow(look, schema)


def mark_listed(pages: DataFrame, listed: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(page_id, url, canonical, listed) of pages (page_id, url); `listed`: (url)."""
    spark = pages.sparkSession
    listed = cut(pick(listed, "url").select(canonical(F.col("url")).alias("canonical")).filter("canonical is not null").distinct())
    count = listed.count()
    exact = small_or_hashed(listed.select(F.col("canonical").alias("hit")), 128)
    pages = pick(pages, "page_id", "url").withColumn("canonical", canonical(F.col("url")))
    fields = ("page_id", "url", "canonical")
    hashes = listed.select(F.xxhash64("canonical").alias("h"))
    if _blocks(count) * 32 > filter_bytes:
        tried = tried_in_ranges(pages, hashes, count)
    else:
        words = spark.sparkContext.broadcast(build(hashes, count))

        @F.pandas_udf("boolean")
        def maybe(h: pd.Series) -> pd.Series:
            return pd.Series(probe(words.value, h.to_numpy(np.int64).view(np.uint64)))

        tried = pages.withColumn("maybe", maybe(F.xxhash64("canonical")))
    out = tried.filter(~F.col("maybe")).select(*fields, F.lit(False).alias("listed"))
    hits = tried.filter("maybe")
    hits = hits.join(exact, hits["canonical"] == exact["hit"], "left").select(*fields, F.col("hit").isNotNull().alias("listed"))
    return out.unionByName(hits)


#: Sites whose pages make up the list of the query.
SITES = ("cheap-pills.example.com", "spam-farm.example.org")


def listed_pages(pages: DataFrame) -> DataFrame:
    """(url): the list of the query, URLs of pages of the `SITES`."""
    return pick(pages, "url").filter(host(F.col("url")).isin(*SITES))


_REST = "regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*', '')"
SQL = f"""
    with hosts as (
        select page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*', 0)), '^(www|m)\\.', ''), ':(80|443)$', '') as host, {_REST} as rest
        from pages
    ), asked as (
        select *, array_to_string(list_sort(list_filter(string_split(regexp_replace(rest, '(?s)^[^?]*\\??', ''), '&'), lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))), '&') as query from hosts
    ), formed as (
        select page_id, url, host, host || regexp_replace(regexp_extract(rest, '(?s)^[^?]*', 0), '/$', '') || case when query = '' then '' else '?' || query end as canonical from asked
    )
    select page_id, url, canonical, coalesce(canonical in (select canonical from formed where host in {SITES} and canonical is not null), false) as listed from formed"""
