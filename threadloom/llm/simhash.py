"""SimHash near-dedup, exact: no pair of codes within the radius is left out.

A text's code is 256 bits, the signs of the summed +-1 projections of its distinct words, so edits of
case and punctuation don't count and a replaced word counts once.  Two texts are near copies where
their codes differ in at most `RADIUS` bits of 256.  Of texts of 300 distinct words with a share of
0.12, 0.17 and 0.2 replaced, 0.90, 0.53 and 0.30 lie within; unrelated ones differ in 80 bits or more.

All different codes are compared (`near_links`).  They are dealt to blocks by a hash, and each pair of
blocks is a tile, compared in one task: three of the four words of a code decide almost all pairs, the
fourth is looked at for the rest.  A tile gives no pairs but the links of a spanning forest of what it
found, so that a class of m codes costs a tile m rows and not m * m; classes are the components of these.
Texts with the same code are one node, so that thousands of copies cost one.  Nothing that grows is
broadcast: a code is sent once for each block, 12 times up to 12 * `BLOCK` codes.

This work is the square of the number of different codes.  Exact indexes gain little at this radius:
agreement in one of disjoint bands is certain only for 49 bands of 5 bits, which meet more pairs than there
are (49 / 32), and the edges of a BK-tree rule out next to nothing, as the distances of unrelated texts
to any node are mostly within 48 of each other.

`near_pairs` is an index that isn't exact, of BK-trees in bands, with a recall of `RECALL` at the radius (see
`Layout.recall`) and work that grows little more than the corpus.  It leaves pairs out, so no query uses it.

Defined results: null texts and texts without a word have no code and are copies of nothing; rows
with the same doc_id are one document, which stays or goes whole (a null doc_id is one too); doc_id must
be a whole number; the least doc_id of a group (nulls last) stays; extra columns are carried, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from threadloom.llm import textkernel as tk
from threadloom.llm.common import cut, parallelism, pick

RADIUS = 48
WORDS = 4
SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
RECALL, SEED = 0.93, 1
#: Most codes of a block on average; blocks that a corpus has at least if they hold `LEAST` codes.
BLOCK, BLOCKS, LEAST = 1 << 18, 12, 1 << 10
#: Codes compared at a time, rows and columns of a tile.
ROWS, COLUMNS = 8, 1 << 13


@dataclass(frozen=True)
class Layout:
    """Bands of a number of shards: `outer` bits of a shard, `inner` more in each of `places`."""

    shards: int
    outer: int
    inner: int
    places: int

    def recall(self, radius: int) -> float:
        """Probability that a band is met by a pair that differs in `radius` of 256 bits."""
        # given the differing bits among the outer (none), the places are disjoint draws from the rest
        outer = math.comb(256 - self.outer, radius) / math.comb(256, radius)
        rest = 256 - self.outer
        # inclusion and exclusion over the places that agree
        inner = sum((-1) ** (k + 1) * math.comb(self.places, k) * math.comb(rest - k * self.inner, radius) / math.comb(rest, radius) for k in range(1, self.places + 1) if rest - k * self.inner >= radius)
        return 1 - (1 - outer * inner) ** self.shards

    @classmethod
    def of(cls, codes: int, radius: int = RADIUS, recall: float = RECALL) -> Layout:
        """For so many different codes."""
        width = min(64, max(16, (max(1, codes) - 1).bit_length() - 6))
        outer = max(10, width - 16)  # what a code is sent for; a shard's part of the corpus fits a task
        inner = width - outer
        places = min((256 - outer) // inner, max(6, inner))
        shards = 1
        while (made := cls(shards, outer, inner, places)).recall(radius) < recall:
            shards += 1
        return made

    @cached_property
    def order(self) -> np.ndarray:
        """shards x (outer + places * inner) numbers of bits."""
        draw = np.random.RandomState(SEED)
        return np.stack([draw.permutation(256)[: self.outer + self.places * self.inner] for _ in range(self.shards)])

    def keys(self, code: np.ndarray) -> np.ndarray:
        """n x shards: the number of the shard above its bits."""
        bits = np.unpackbits(code.view(np.uint8).reshape(-1, 32), axis=1)
        return _number(bits[:, self.order[:, : self.outer]]) | (np.arange(self.shards) << self.outer)

    def added(self, code: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """n x places values of the bits that the bands add, of one shard (its number) a row."""
        bits = np.unpackbits(code.view(np.uint8).reshape(-1, 32), axis=1)
        at = self.order[shard, self.outer :]
        return _number(np.take_along_axis(bits, at, 1).reshape(-1, self.places, self.inner))

    def first_band(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first band, shard * places + place, in which the codes of each row agree (they must in one)."""
        differ = np.unpackbits((a ^ b).view(np.uint8).reshape(-1, 32), axis=1).astype(bool)
        out = np.full(len(a), -1)
        for s in range(self.shards):
            left = np.flatnonzero(out < 0)
            left = left[~differ[left[:, None], self.order[s, : self.outer]].any(1)]
            agree = ~differ[left[:, None], self.order[s, self.outer :]].reshape(-1, self.places, self.inner).any(2)
            met = agree.any(1)
            out[left[met]] = s * self.places + agree[met].argmax(1)
        return out


def _number(bits: np.ndarray) -> np.ndarray:
    """Numbers of the bits in the last axis."""
    width = bits.shape[-1]
    out = np.zeros(bits.shape[:-1], np.int64)
    for i in range(width):
        out |= bits[..., i].astype(np.int64) << (width - 1 - i)
    return out


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 uint64 codes, whether the text has a word) of a string array."""
    out = np.zeros((len(texts), WORDS), np.uint64)
    has = np.zeros(len(texts), bool)
    for lo, hi in tk.slices(texts):
        row, h = tk.distinct(*tk.words(*tk.raw(texts.slice(lo, hi - lo)))[:2])
        if not row.size:
            continue
        # counters of 8 bits, eight to a machine word: at most 255 words are summed before they widen
        first = np.concatenate([[True], row[1:] != row[:-1]])
        begin = np.flatnonzero(first)
        place = np.arange(row.size) - np.repeat(begin, np.diff(np.concatenate([begin, [row.size]])))
        chunk = np.flatnonzero(place % 255 == 0)
        sums = np.empty((chunk.size, 256), np.uint8)
        step = 1 << 9
        for a in range(0, chunk.size, step):
            b = min(chunk.size, a + step)
            top = chunk[b] if b < chunk.size else row.size
            bits = np.unpackbits(tk.mix(h[chunk[a] : top, None] + SALTS).view(np.uint8), axis=1)
            sums[a:b] = np.add.reduceat(bits.view(np.uint64), chunk[a:b] - chunk[a], axis=0).view(np.uint8)
        head = np.flatnonzero(place[chunk] == 0)
        total = np.add.reduceat(sums.astype(np.int32), head, axis=0)
        size = np.diff(np.concatenate([begin, [row.size]]))
        out[lo + row[begin]] = np.packbits(2 * total > size[:, None], axis=1).view(np.uint64)
        has[lo + row[begin]] = True
    return out, has


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """One BK-tree a shard, built and searched together, level by level.

    `parent` and `key` (the distance to the parent) describe the edges; children of a node have
    different keys. Nodes are the rows of `code`, whose rows of one shard follow each other.
    """

    def __init__(self, code: np.ndarray, shard: np.ndarray):
        n = len(code)
        self.code, self.parent, self.key = code, np.full(n, -1), np.full(n, -1)
        begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, int)
        self.root = np.repeat(begin, np.diff(np.concatenate([begin, [n]])))
        left = np.flatnonzero(self.root != np.arange(n))
        node = self.root[left]
        while left.size:  # each round: below its node, the first row of each distance becomes the child, the rest go on under it
            d = distance(code[left], code[node])
            order = np.lexsort((left, d, node))
            left, node, d = left[order], node[order], d[order]
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (d[1:] != d[:-1])])
            self.parent[left[new]], self.key[left[new]] = node[new], d[new]
            child = left[new][np.cumsum(new) - 1]
            left, node = left[~new], child[~new]
        self.order = np.lexsort((self.key, self.parent))
        self.first = np.searchsorted(self.parent[self.order], np.arange(n), side="left")
        self.last = np.searchsorted(self.parent[self.order], np.arange(n), side="right")

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, found row, distance) for queries that are rows of the forest, each in its own tree."""
        node = self.root[query]
        while query.size:
            d = distance(self.code[query], self.code[node])
            hit = d <= radius
            yield query[hit], node[hit], d[hit]
            many = self.last[node] - self.first[node]
            at = np.repeat(self.first[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            query, d, node = np.repeat(query, many), np.repeat(d, many), self.order[at]
            near = np.abs(self.key[node] - d) <= radius  # only edges within the radius
            query, node = query[near], node[near]


def _several(key: np.ndarray) -> np.ndarray:
    """Whether another row has the key too; keys are sorted."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([begin, [len(key)]]))
    return np.repeat(size > 1, size)


def _pairs(layout: Layout, key: np.ndarray, code: np.ndarray, ident: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Near pairs within shards (rows sorted by key), each only in the first band it shares."""
    keep = _several(key)
    key, code, ident = key[keep], code[keep], ident[keep]
    shard = key >> layout.outer
    value = layout.added(code, shard)
    for place in range(layout.places):
        order = np.lexsort((value[:, place], key))
        change = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (value[order, place][1:] != value[order, place][:-1])]) if order.size else np.zeros(0, bool)
        tree = np.cumsum(change)
        several = _several(tree) if tree.size else np.zeros(0, bool)
        order, tree = order[several], tree[several]
        if order.size:
            yield from _place_pairs(layout, tree, code[order], ident[order], shard[order] * layout.places + place, value[order, :place], radius)


def _place_pairs(layout: Layout, tree: np.ndarray, code: np.ndarray, ident: np.ndarray, band: np.ndarray, before: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Near pairs within trees; pairs that agree in a place `before` are left out, as are those of an earlier shard."""
    forest = BKForest(code, tree)
    begin = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    size = np.diff(np.concatenate([begin, [len(tree)]]))
    cost = np.cumsum(np.repeat(size, size))
    lo = 0
    while lo < len(tree):  # queries by the million visits, to bound the frontier
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + (1 << 19), side="right")))
        for q, f, d in forest.search(np.arange(lo, hi), radius):
            once = ident[q] < ident[f]
            q, f, d = q[once], f[once], d[once]
            once = ~(before[q] == before[f]).any(axis=1)
            q, f, d = q[once], f[once], d[once]
            for at in range(0, q.size, 1 << 15):
                x, y, z = (c[at : at + (1 << 15)] for c in (q, f, d))
                fresh = layout.first_band(code[x], code[y]) == band[x]
                yield pa.RecordBatch.from_arrays([pa.array(ident[x[fresh]]), pa.array(ident[y[fresh]]), pa.array(z[fresh].astype(np.int32))], ["a", "b", "bits"])
        lo = hi


def document_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, code binary) of the documents whose text has a word."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, has = codes(b.column(1))
            blob = pa.Array.from_buffers(pa.binary(32), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(has)), blob.filter(pa.array(has))], ["doc_id", "code"])

    return pick(docs, "doc_id", "text").filter("text is not null").mapInArrow(hashed, "doc_id long, code binary")


def near_pairs(coded: DataFrame, radius: int = RADIUS, layout: Layout | None = None) -> DataFrame:
    """(a, b, bits) of the nodes (node, code) within the radius that share a band, not of all within it; a < b."""
    layout = layout or Layout.of(coded.count(), radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                b = batch.slice(at, 1 << 12)
                blob = b.column(1).cast(pa.binary(32))
                code = np.frombuffer(blob.buffers()[1], np.uint64)[blob.offset * WORDS : (blob.offset + len(b)) * WORDS].reshape(-1, WORDS)
                take = pa.array(np.repeat(np.arange(len(b)), layout.shards))
                yield pa.RecordBatch.from_arrays([pa.array(layout.keys(code).reshape(-1)), b.column(0).take(take), b.column(1).take(take)], ["shard", "node", "code"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for b in batches:
            blob = b.column(2).cast(pa.binary(32))
            code = np.frombuffer(blob.buffers()[1], np.uint64)[blob.offset * WORDS : (blob.offset + len(b)) * WORDS].reshape(-1, WORDS)
            held.append((b.column(0).to_numpy(), code, b.column(1).to_numpy()))
            rows += len(b)
            if rows < 1 << 16:
                continue
            key, code, ident = joined()
            last = int(np.searchsorted(key, key[-1]))  # the last shard may go on in the next batch
            if last:
                yield from _pairs(layout, key[:last], code[:last], ident[:last], radius)
            held, rows = [(key[last:], code[last:], ident[last:])], len(key) - last
        if rows:
            yield from _pairs(layout, *joined(), radius)

    spread_out = coded.select("node", "code").mapInArrow(spread, "shard long, node long, code binary")
    return spread_out.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long, bits int")


def compare(x: np.ndarray, y: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) of all codes within the radius; of a table with itself, each pair once."""
    left, right = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    differ, bits, more = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8), np.empty((ROWS, COLUMNS), np.uint8)
    for lo in range(0, len(y), COLUMNS):
        width = min(COLUMNS, len(y) - lo)
        for at in range(0, min(len(x), lo + width) if x is y else len(x), ROWS):
            rows = min(ROWS, len(x) - at)
            d, n, m = differ[:rows, :width], bits[:rows, :width], more[:rows, :width]
            for w in range(WORDS - 1):  # without the last word, 8 bits hold the count
                np.bitwise_xor(left[w, at : at + rows, None], right[w, lo : lo + width], out=d)
                np.bitwise_count(d, out=m if w else n)
                if w:
                    np.add(n, m, out=n)
            maybe = n <= radius
            if not maybe.any():
                continue
            p, q = np.divmod(np.flatnonzero(maybe), width)
            p, q = p + at, q + lo
            if x is y:
                p, q = p[p < q], q[p < q]
            near = distance(x[p], y[q]) <= radius
            if near.any():
                yield p[near], q[near]


def _read(blobs: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind)


def near_links(coded: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) nodes (node, code; a row a code) within the radius or tied by such: the components are those of all pairs within the radius."""
    from threadloom.llm.vectors import Forest  # which takes components from here

    count = coded.count()
    blocks = max(1, min(BLOCKS, -(-count // LEAST)), -(-count // block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = b.column(0).to_numpy()
            order = np.argsort(to, kind="stable")
            node, code = b.column(1).to_numpy()[order], _read(b.column(2), np.uint64).reshape(-1, WORDS)[order]
            own = np.unique(to)
            end = np.searchsorted(to[order], own, side="right")
            spans = list(zip([0, *end[:-1]], end, strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (node, code)]], ["block", "node", "code"])

    def join(group: pa.Table) -> pa.Table:
        first = group.column("first").to_numpy()

        def side(which: bool) -> tuple[np.ndarray, np.ndarray]:
            own = group.filter(pa.array(first == which))
            return _read(own.column("node"), np.int64), _read(own.column("code"), np.uint64).reshape(-1, WORDS)

        (node, x), (other, y) = side(True), side(False)
        alone = group.column("alone")[0].as_py()
        forest = Forest(node.size + other.size)
        for p, q in compare(x, x if alone else y, radius):
            forest.link(p, q if alone else q + node.size)
        every = np.concatenate([node, other])
        root = forest.find(np.arange(every.size))
        hung = np.flatnonzero(root != np.arange(every.size))
        return pa.table({"a": every[root[hung]], "b": every[hung]})

    to_block = F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block")
    packed = coded.select(to_block, "node", "code").mapInArrow(pack, "block long, node binary, code binary")
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tile = (F.least("block", "other") * blocks + F.greatest("block", "other")).alias("tile")
    sent = sent.select(tile, (F.col("block") <= F.col("other")).alias("first"), (F.col("block") == F.col("other")).alias("alone"), "node", "code")
    # a number given is left alone: tiles are little data and much work
    tiles = blocks * (blocks + 1) // 2
    return sent.repartition(min(tiles, max(200, parallelism(coded.sparkSession))), "tile").groupBy("tile").applyInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of each node of the edges (a, b).

    Rounds of alternating star operations: neighbours are hung on the least node known to either
    end, until every edge leads to a root. The number of rounds grows with the logarithm of the size.
    """

    def state() -> Row:
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = state()
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lead = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lead, "a").select("b", "m").filter("b <> m").unionByName(lead.select(F.col("a").alias("b"), "m"))
        edges = cut(small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b").distinct())
        now = state()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, keep_id): each document that goes, with the one of its group that stays."""
    coded = cut(document_codes(docs).groupBy("doc_id", "code").count().drop("count"))
    high = coded.agg(F.max("doc_id")).first()[0]
    # the null document is known by a number that no other has: the one above all, or else any
    above = high is None or high < (1 << 63) - 1
    null = (-1 if high is None else high + 1) if above else 0
    while not above and coded.filter(F.col("doc_id") == null).count():
        null = null * 6364136223846793005 + 1442695040888963407 & (1 << 63) - 1
    # a code is known by its least document, null being the last
    named = cut(coded.groupBy("code").agg(F.coalesce(F.min("doc_id"), F.lit(null)).alias("node")))
    # rows of one doc_id with different texts tie their codes together
    each = coded.join(named, "code")
    own = each.groupBy("doc_id").agg(F.array_sort(F.collect_set("node")).alias("own")).filter("size(own) > 1")
    tied = own.select(F.explode(F.expr("slice(own, 2, size(own) - 1)")).alias("b"), F.expr("own[0]").alias("a"))
    roots = components(near_links(named, radius).unionByName(tied.select("a", "b")))
    ids = each.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("keep_id"))
    if not above and (of_null := cut(ids.filter(F.col("keep_id") == null))).count():  # its group is named by it, though another document stays
        ids = ids.withColumn("keep_id", F.when(F.col("keep_id") == null, F.lit(of_null.agg(F.min("doc_id")).first()[0])).otherwise(F.col("keep_id")))
    kept = ids.withColumn("keep_id", F.when(F.col("keep_id") != null, F.col("keep_id")))
    return kept.filter("keep_id is not null and (doc_id is null or doc_id <> keep_id)").distinct()


def drop_near(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`docs` with one document of each group of near copies."""
    gone = cut(near_copies(docs, radius).select(F.col("doc_id").alias("gone")))
    names = [f"_{i}" for i in range(len(docs.columns))]
    key = names[docs.columns.index("doc_id")]
    out = docs.toDF(*names)
    return out.join(gone, out[key].eqNullSafe(gone["gone"]), "left_anti").toDF(*docs.columns)
