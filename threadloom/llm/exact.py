"""Exact dedup through counting quotient filters.

Every partition puts the 64-bit fingerprints of its texts into a counting quotient filter: the high
bits (quotient) choose a run, the low bits (remainder) are stored, sorted within the run, with a
counter where a fingerprint came more than once.  Quotient and remainder together are the whole
fingerprint, so filters of any size merge without loss, as sorted streams.  The filters are cut
into segments by their highest bits, as many as keep a segment at about `SEGMENT` fingerprints; segments
of a range meet in one task.  Only texts whose merged count is above one are compared byte by byte: the
least and the greatest text of a fingerprint, found by partial sums in every partition, are equal bytes
unless different texts share it, which are then told apart one by one.  So a text that is a third of all
rows is never brought together in a task.

Defined results: a null text equals no other and stays; the empty text is a text like any other; of
equal texts the row with the least doc_id (nulls last) stays; repeated rows are copies of each
other; doc_id may be of any type with an order; extra columns are carried, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import cut, parallelism, pick, small_or_hashed

SEGMENT = 1 << 20


@dataclass
class CountingQuotientFilter:
    """Runs of sorted remainders by quotient; `occupied` and `run_end` are the filter's metadata bits."""

    quotient_bits: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainder: np.ndarray
    counter: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Of fingerprints (uint64) in any order."""
        fingerprints = fingerprints.astype(np.uint64, copy=False)
        counts = np.ones(fingerprints.size, np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")
        fingerprints, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]])) if fingerprints.size else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, first) if first.size else np.zeros(0, np.int64)
        fingerprints = fingerprints[first]
        q = max(1, int(fingerprints.size * 4 // 3).bit_length())
        r = np.uint64(64 - q)
        quotient = (fingerprints >> r).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_end = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if quotient.size else np.zeros(0, bool)
        return cls(q, occupied, run_end, fingerprints & ((np.uint64(1) << r) - np.uint64(1)), total)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints ascending, counts)."""
        if not self.remainder.size:
            return self.remainder, self.counter
        run = np.concatenate([[0], np.cumsum(self.run_end)[:-1]])
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotient << np.uint64(64 - self.quotient_bits)) | self.remainder, self.counter

    @staticmethod
    def merge(filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Counts of equal fingerprints add up; nothing is lost, as whole fingerprints are compared."""
        parts = [f.items() for f in filters]
        if not parts:
            return CountingQuotientFilter.build(np.zeros(0, np.uint64))
        return CountingQuotientFilter.build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def to_bytes(self) -> bytes:
        """Bit vectors packed; a remainder takes the bytes it needs; counters only where above one."""
        many = self.counter > 1
        width = (64 - self.quotient_bits + 7) // 8
        low = self.remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([self.quotient_bits, self.remainder.size, int(many.sum())], "<i8").tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.run_end).tobytes() + np.packbits(many).tobytes() + low.tobytes() + self.counter[many].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        q, n, m = (int(x) for x in np.frombuffer(blob, "<i8", 3))
        at = 24

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(blob, np.uint8, size, at - size)

        occupied = np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q).astype(bool)
        run_end = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        many = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        width = (64 - q + 7) // 8
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = take(n * width).reshape(n, width)
        counter = np.ones(n, np.int64)
        counter[many] = take(m * 8).view("<i8")
        return cls(q, occupied, run_end, whole.reshape(-1).view("<u8"), counter)


def repeated_fingerprints(texts: DataFrame, segments: int | None = None) -> DataFrame:
    """(fp, copies) of the fingerprints of `texts.fp` (nulls ignored) that occur more than once."""
    segments = segments or max(parallelism(texts.sparkSession), -(-texts.count() // SEGMENT))
    bits = max(1, (segments - 1).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        fingerprints, counts = CountingQuotientFilter.build(np.concatenate(parts) if parts else np.zeros(0, np.uint64)).items()
        segment = (fingerprints >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]])) if segment.size else [0]
        blobs = [CountingQuotientFilter.build(fingerprints[a:b] << np.uint64(bits), counts[a:b]).to_bytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(segment[edges[:-1]] if len(blobs) else [], pa.int64()), pa.array(blobs, pa.binary())], ["segment", "filter"])

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        merged = CountingQuotientFilter.merge(CountingQuotientFilter.from_bytes(b) for b in group.column("filter").to_pylist())
        low, counts = merged.items()
        fingerprints = (low >> np.uint64(bits)) | (np.uint64(key[0].as_py()) << np.uint64(64 - bits))
        many = counts > 1
        return pa.table({"fp": fingerprints[many].view(np.int64), "copies": counts[many]})

    return texts.select("fp").mapInArrow(build, "segment long, filter binary").groupBy("segment").applyInArrow(merge, "fp long, copies long")


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows whose text can't have a copy, rows whose text may have, and the positional column names."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    marked = docs.toDF(*names).withColumn("fp", F.when(F.col(text).isNotNull(), F.xxhash64(text)))
    many = small_or_hashed(cut(repeated_fingerprints(marked).select("fp")), 16)
    return marked.join(many, "fp", "left_anti"), marked.join(many, "fp", "left_semi"), names


def _order(docs: DataFrame) -> tuple[Window, str, str]:
    text, key = (f"_{docs.columns.index(n)}" for n in ("text", "doc_id"))
    return Window.partitionBy("fp", text).orderBy(F.asc_nulls_last(key)), text, key


def drop_exact(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, any others) with one row of each set of byte-equal texts."""
    single, several, names = _split(docs)
    window, _, _ = _order(docs)
    one = several.withColumn("rank", F.row_number().over(window)).filter("rank = 1")
    return single.select(*names).unionByName(one.select(*names)).toDF(*docs.columns)


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): each row that goes as a copy, with the doc_id of the row that stays for it."""
    docs = pick(docs, "doc_id", "text")
    _, several, names = _split(docs)
    several = several.select("fp", F.col(names[0]).alias("doc_id"), F.col(names[1]).alias("text"))
    # min ignores nulls, so a null doc_id is the last
    told = cut(several.groupBy("fp").agg((F.min("text") == F.max("text")).alias("alike"), F.min("doc_id").alias("keep_id")))
    rows = several.select("fp", "doc_id").join(small_or_hashed(told.filter("alike").select("fp", "keep_id"), 32), "fp")
    gone = rows.filter("not doc_id <=> keep_id").select("doc_id", "keep_id")
    # of the rows of the document that stays, one stays; the others are counted first, as they are alike
    again = rows.filter("doc_id <=> keep_id").groupBy("fp", "doc_id").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    again = again.select("doc_id", "n", F.explode(F.expr("sequence(0L, n - 1, 65536L)")).alias("at"))
    again = again.select("doc_id", F.explode(F.expr("sequence(1L, least(65536L, n - at))"))).select("doc_id", F.col("doc_id").alias("keep_id"))
    window = Window.partitionBy("fp", "text").orderBy(F.asc_nulls_last("doc_id"))
    odd = several.join(small_or_hashed(told.filter("not alike").select("fp"), 16), "fp", "left_semi")
    odd = odd.select("doc_id", F.row_number().over(window).alias("rank"), F.first("doc_id").over(window).alias("keep_id")).filter("rank > 1")
    return gone.unionByName(again).unionByName(odd.select("doc_id", "keep_id"))
