"""Deterministic sharded WARC writer.

Records are range-sorted by reversed host and path, then by page_id (nulls first) and a digest of URL
and html, so that only equal records tie.  The ranges are cut at fixed amounts of bytes in the whole
sorted order, found from exact sums and not from a sample, so the same records give the same files,
byte for byte, however the input is partitioned and ordered.  The ranges' first places are sent to all
tasks; where they would take more than a broadcast may, ranges are twice as large, and so on.  A range
is a partition; its task rolls to a new file when the compressed size reaches `FILE_BYTES`.  Copies of a
record that exceed a range together travel as one row with a count, split over several ranges.  Headers are made anew from the record: ids
are derived from its contents, digests are computed, lengths counted, dates fixed.  Each record is a
gzip member of its own.

A file is written under a temporary name and renamed when it is complete, so a repeated or lost
attempt leaves whole files only; what such attempts left is removed, index and manifest follow, and the
last rename, of MANIFEST.json, commits the set.

Defined results: a null URL sorts first and has no target header; blanks and control characters of a
URL are percent-encoded in the header, and nothing else of it is changed; a null html is an empty body;
repeated records are written repeatedly, numbered; page_id must be a whole number; extra columns are
left out; an empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import BROADCAST_BYTES, cut, parallelism, pick, small_or_hashed
from threadloom.llm.urls import host

RANGE_BYTES, FILE_BYTES, DATE = 128 << 20, 32 << 20, "2000-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, block_digest string"


def sort_key(url: Column) -> Column:
    """`com,example,www)/path?query`; empty for a null URL."""
    rest = F.regexp_replace(F.trim(url), "^([A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host(url), "\\.")), ","), F.lit(")"), rest), F.lit(""))


def place(key: Column) -> Column:
    """Where a record (page_id, url, html) stands in the order of all records; equal for equal records only."""
    # halves of page_id + 2^63, so that negative ones come first; a null is the empty string
    number = F.concat(F.lpad(F.hex(F.shiftrightunsigned("page_id", 32).bitwiseXOR(F.lit(1 << 31))), 8, "0"), F.lpad(F.hex(F.col("page_id").bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))
    rest = F.md5(F.concat(F.coalesce("url", F.lit("")), F.lit("\0"), F.coalesce("html", F.lit(""))))
    return F.concat(key, F.lit("\0"), F.coalesce(number, F.lit("")), F.lit("\0"), rest)


def target(url: str) -> str:
    """A URL that fits into a header line."""
    return re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(kind: str, url: str | None, block: bytes, payload: bytes, name: str, content_type: str) -> tuple[bytes, str, str]:
    """(gzip member, payload digest, block digest) of one record."""
    of_payload, of_block = digest(payload), digest(block)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name + of_block)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + target(url))
    if kind == "response":
        lines.append(f"WARC-Payload-Digest: {of_payload}")
    lines += [f"WARC-Block-Digest: {of_block}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0), of_payload, of_block


def response(page_id: int | None, url: str | None, html: str | None, ordinal: int) -> tuple[bytes, str, str]:
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member("response", url, head + payload, payload, f"{page_id}|{url}|{ordinal}|", "application/http; msgtype=response")


def _replace(filesystem: pafs.FileSystem, temporary: str, name: str) -> None:
    """Renames, also where another attempt has been there and the store doesn't overwrite."""
    try:
        filesystem.move(temporary, name)
    except OSError:
        if filesystem.get_file_info(name).type != pafs.FileType.File:
            raise
        filesystem.delete_file(name)
        filesystem.move(temporary, name)


class RollingFiles:
    """The files of one range: each is renamed to its name only when it is complete."""

    def __init__(self, uri: str, part: int, most: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(uri)
        self.part, self.most, self.roll, self.out, self.size = part, most, 0, None, 0
        self.attempt = uuid.uuid4().hex

    def add(self, data: bytes) -> tuple[str, int]:
        """(file, offset) of the member."""
        if self.out is not None and self.size + len(data) > self.most:
            self.close()
        if self.out is None:
            self.name = f"part-{self.part:08d}-{self.roll:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{self.attempt}.tmp"
            self.out = self.fs.open_output_stream(self.temporary)
            info = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            first = member("warcinfo", None, info, info, self.name, "application/warc-fields")[0]
            self.out.write(first)
            self.size = len(first)
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            _replace(self.fs, self.temporary, f"{self.folder}/{self.name}")
            self.out, self.roll = None, self.roll + 1


def split(records: DataFrame, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Records (page_id, url, html, place, first, copies), and the (place, size) of all of them. Copies that exceed a range together are one row for each range's worth of them."""
    size = (F.coalesce(F.octet_length("html"), F.lit(0)) + 512).cast("long")
    groups = cut(records.select("place", size.alias("size")).groupBy("place").agg(F.first("size").alias("size"), F.count("*").alias("n")))
    large = F.expr(f"n > 1 and n * size > {range_bytes}")
    plain = records.select("*", F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("copies"))
    alone = groups.filter(~large).select("place", (F.col("size") * F.col("n")).alias("size"))
    hot = cut(groups.filter(large).withColumn("step", F.greatest(F.lit(1).cast("long"), F.floor(range_bytes / F.col("size")))))
    if hot.isEmpty():
        return plain, alone
    parted = hot.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("step"))).alias("first"))
    parted = parted.select("place", "size", "first", F.least(F.col("step"), F.col("n") - F.col("first")).alias("copies"), F.concat("place", F.lit("\0"), F.lpad(F.hex("first"), 16, "0")).alias("there"))
    once = records.join(small_or_hashed(hot.select("place"), 256), "place", "left_semi").groupBy("place").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "html")])
    several = once.join(parted, "place").select("page_id", "url", "html", F.col("there").alias("place"), "first", "copies")
    rest = plain.join(small_or_hashed(hot.select("place"), 256), "place", "left_anti")
    return rest.select(several.columns).unionByName(several), alone.unionByName(parted.select(F.col("there").alias("place"), (F.col("size") * F.col("copies")).alias("size")))


def range_starts(sizes: DataFrame, range_bytes: int, most: int = BROADCAST_BYTES) -> list[str]:
    """First places of the ranges of `sizes` (place, size): a new one whenever the running total passes a multiple of `range_bytes` (or twice as many, and so on, so that the places fit into `most` bytes)."""
    placed = cut(sizes.repartitionByRange(parallelism(sizes.sparkSession), "place").withColumn("pid", F.spark_partition_id()))
    totals = sorted(tuple(r) for r in placed.groupBy("pid").agg(F.sum("size")).collect())
    if not totals:
        return []
    starts = zip([p for p, _ in totals], np.concatenate([[0], np.cumsum([t for _, t in totals])[:-1]]).tolist(), strict=True)
    offsets = F.broadcast(sizes.sparkSession.createDataFrame(list(starts), "pid int, offset long"))  # a row a partition
    before = F.coalesce(F.sum("size").over(Window.partitionBy("pid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = placed.withColumn("before", before).join(offsets, "pid").select("place", F.floor((F.col("offset") + F.col("before")) / range_bytes).alias("part"))
    firsts = cut(running.groupBy("part").agg(F.min("place").alias("place")))
    while (firsts.agg(F.sum(F.octet_length("place") + 64)).first()[0] or 0) > most and firsts.count() > 1:
        firsts = cut(firsts.groupBy(F.floor(F.col("part") / 2).alias("part")).agg(F.min("place").alias("place")))
    return sorted(r.place for r in firsts.select("place").collect())


def write_warc(pages: DataFrame, uri: str, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) below `uri`; the index, a row a record: (page_id, url, file, offset, length, payload_digest, block_digest)."""
    spark = pages.sparkSession
    pages = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    records, sizes = split(pages.withColumn("place", place(sort_key(F.col("url")))), range_bytes)
    starts = range_starts(sizes, range_bytes)
    shared = spark.sparkContext.broadcast(np.array(starts, object))

    @F.pandas_udf("int")
    def part_of(there: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, there.to_numpy(object), side="right") - 1).astype("int32")

    filesystem, folder = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, before, ordinal, rows = None, None, 0, []

        def indexed() -> pa.RecordBatch:
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
            rows.clear()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                for row in whole.slice(at, 512).to_pylist():
                    if files is None or files.part != row["part"]:
                        if files:
                            files.close()
                        files, before = RollingFiles(uri, row["part"], file_bytes), None
                    ordinal = ordinal + 1 if row["place"] == before else row["first"]
                    before = row["place"]
                    for ordinal in range(ordinal, ordinal + row["copies"]):
                        data, of_payload, of_block = response(row["page_id"], row["url"], row["html"], ordinal)
                        rows.append((row["page_id"], row["url"], *files.add(data), len(data), of_payload, of_block))
                        if len(rows) == 4096:
                            yield indexed()
                if rows:
                    yield indexed()
        if files:
            files.close()

    parts = records.withColumn("part", part_of("place")).repartitionById(max(1, len(starts)), F.col("part"))
    parts.sortWithinPartitions("part", "place").mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{uri}/index")
    for info in filesystem.get_file_info(pafs.FileSelector(folder)):  # of lost or repeated attempts
        if info.base_name.startswith(".part-") and info.base_name.endswith(".tmp"):
            filesystem.delete_file(info.path)
    index = spark.read.schema(INDEX).parquet(f"{uri}/index")
    manifest = index.groupBy("file").agg(F.count("*").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes"), F.sum(F.crc32("payload_digest")).alias("check"))
    manifest.coalesce(1).sortWithinPartitions("file").write.mode("overwrite").parquet(f"{uri}/manifest")
    whole = spark.read.parquet(f"{uri}/manifest").agg(F.count("*"), F.sum("records"), F.sum("bytes")).first()
    temporary = f"{folder}/.MANIFEST.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temporary) as out:
        out.write(json.dumps({"files": whole[0], "records": whole[1] or 0, "bytes": whole[2] or 0}).encode())
    _replace(filesystem, temporary, f"{folder}/MANIFEST.json")
    return index
