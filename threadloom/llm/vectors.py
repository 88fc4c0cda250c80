"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are rotated to the principal axes of the whole table.  Cosine >= t is distance <=
eps = sqrt(2 - 2t), so a grid of width eps on the `DIMS` leading axes puts near vectors into equal or
adjacent cells.  The vectors are sorted by their cells (the epsilon grid order) and cut into blocks of
the sequence.  A block pair is skipped where the leaves (`LEAF` vectors in sequence) of the two are all
provably more than eps apart; the others are joined recursively: intervals of the two sequences are
halved, and a pair of intervals is dropped as soon as the gap between their boxes exceeds eps.  Boxes
have one side more than there are axes: the length of what the axes leave of a vector, which differs
between two vectors by no more than their distance.  What is left is compared exactly (single precision
decides where its error can't matter, double precision the rest), so recall is 1.

Near pairs are counted where they are found, not written: a group of n copies has n * n pairs.  A block
pair gives a row for each of its vectors that is in a pair, with the number of pairs and the least
vector that it hangs together with there; classes are the components of these rows.  Equal vectors are
one vector with a count.

How much can be skipped is a matter of the data: where a few axes hold most of the variance the work is
near linear, but isotropic vectors fill every box, nothing is provably distant, and all pairs of blocks
are compared.

Defined results: vectors with a null, NaN or infinite entry, zero vectors and null vectors are near
nothing (no links, a class of their own); vectors of different lengths are never near; rows equal in id
and vector count once; two vectors of one id are a pair like any other if they are near, and one class
in any case; rows with a null vec_id are left out, as a result couldn't name them; vec_id must be a
whole number; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from threadloom.llm.common import cut, parallelism, pick
from threadloom.llm.simhash import components

COSINE, DIMS, LEAF = 0.9, 6, 256
#: Leading axes whose cells bring blocks together, and the steps to a cell's neighbours on them.
KEYED = 3
STEPS = np.stack(np.meshgrid(*[[-1, 0, 1]] * KEYED), -1).reshape(-1, KEYED)
#: Bytes of the vectors of a block, and blocks that are joined with one block in one task, on average.
BLOCK_BYTES, TILE = 2 << 20, 4


def _kind(vectors: DataFrame) -> type:
    return np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, raw, h1, h2): the bytes of the vectors that have a direction, and their hashes."""
    known = pick(vectors, "vec_id", "embedding").filter("vec_id is not null")
    kind = _kind(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes[sizes > 0]).tolist():
                mine = pa.array(sizes == d)
                x = np.asarray(listed.filter(mine).flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, d) + kind(0)  # one zero, not two
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.square(x, dtype=np.float64).sum(1)
                good = np.isfinite(x).all(1) & (norm > 0) & np.isfinite(norm)
                x = np.ascontiguousarray(x[good])
                blob = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * x.itemsize * d), pa.py_buffer(x)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mine).filter(pa.array(good)), pa.array(np.full(len(x), d, np.int32)), blob], ["vec_id", "size", "raw"])

    rows = known.mapInArrow(read, "vec_id long, size int, raw binary")
    return rows.withColumn("h1", F.xxhash64("raw")).withColumn("h2", F.xxhash64(F.lit(1), "raw"))


def _units(raw: bytes, width: int, kind: type) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    x = np.frombuffer(raw, kind).reshape(-1, width).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(nodes: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Principal axes (columns, strongest first) for each vector length, from the second moments of all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            size = b.column(0).to_numpy()
            for d in np.unique(size).tolist():
                x = _units(b"".join(b.column(1).filter(pa.array(size == d)).to_pylist()), d, kind)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(list(m))], ["size", "i", "row"])

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = group.column("row").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(0)
        return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "row": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "size int, i int, row array<double>"
    rows = nodes.select("size", "raw").mapInArrow(moments, schema).groupBy("size", "i").applyInArrow(add, schema).collect()
    out = {}
    for d in {r["size"] for r in rows}:
        moment = np.array([r.row for r in sorted((r for r in rows if r["size"] == d), key=lambda r: r.i)])
        out[d] = np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1]
    return out


def sides(y: np.ndarray) -> np.ndarray:
    """n x (DIMS + 1): the leading coordinates of rotated vectors and the length of the rest."""
    out = np.zeros((len(y), DIMS + 1))
    out[:, : min(DIMS, y.shape[1])] = y[:, :DIMS]
    out[:, DIMS] = np.sqrt((y[:, DIMS:] ** 2).sum(1))
    return out


class Forest:
    """Components of rows 0..n-1, each named by its least row."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        at = self.parent[x]
        while (at != (up := self.parent[at])).any():
            at = up
        self.parent[x] = at
        return at

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while x.size:
            a, b = self.find(x), self.find(y)
            apart = a != b
            x, y = x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


class Sequence:
    """An interval of the epsilon grid order: its unit vectors and the boxes of its leaves."""

    def __init__(self, raw: bytes, width: int, rotation: np.ndarray, kind: type):
        self.unit = _units(raw, width, kind)
        rotated = self.unit @ rotation
        self.single = rotated.astype(np.float32)
        side, at = sides(rotated), np.arange(0, len(rotated), LEAF)
        self.lo, self.hi = np.minimum.reduceat(side, at), np.maximum.reduceat(side, at)


def distant(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, cosine: float) -> np.ndarray:
    """Whether boxes (corners in the last axis) are so far apart that no vectors in them can be near."""
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return (gap * gap).sum(-1) > 2 - 2 * cosine + 1e-9


def join_sequences(x: Sequence, y: Sequence, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) of the near pairs; of a sequence with itself, each pair once."""
    doubt = (x.unit.shape[1] + 8) * 2.4e-7  # of single precision
    stack = [(0, len(x.lo), 0, len(y.lo))]
    while stack:
        a, b, c, d = stack.pop()
        if x is y and d <= a:
            continue
        if distant(x.lo[a:b].min(0), x.hi[a:b].max(0), y.lo[c:d].min(0), y.hi[c:d].max(0), cosine):
            continue
        if b - a == 1 and d - c == 1:
            p0, q0 = a * LEAF, c * LEAF
            dot = x.single[p0 : p0 + LEAF] @ y.single[q0 : q0 + LEAF].T
            if dot.max() < cosine - doubt:
                continue
            p, q = np.nonzero(dot >= cosine - doubt)
            unsure = np.flatnonzero(dot[p, q] <= cosine + doubt)
            p, q = p + p0, q + q0
            sure = np.ones(p.size, bool)
            sure[unsure] = (x.unit[p[unsure]] * y.unit[q[unsure]]).sum(1) >= cosine - 1e-12
            if x is y:
                sure &= p < q
            if sure.any():
                yield p[sure], q[sure]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def blocked(nodes: DataFrame, kind: type, rotation: Broadcast, cosine: float = COSINE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, size, lo, hi, here, around, node, n, h1, h2, raw): the nodes in epsilon grid order, in blocks, with the corners of their leaves, the cells they lie in and those around."""
    eps = float(np.sqrt(2 - 2 * cosine))
    cells = [f"c{k}" for k in range(DIMS)]
    fields = ("node", "n", "h1", "h2", "size", "raw")

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy()
            for d in np.unique(size).tolist():
                mine = b.filter(pa.array(size == d))
                cell = np.floor(sides(_units(b"".join(mine.column("raw").to_pylist()), d, kind) @ rotation.value[d]) / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*mine.columns, *[pa.array(cell[:, k]) for k in range(DIMS)]], [*fields, *cells])

    order = ["size", *cells, "node", "h1", "h2"]
    schema = "node long, n long, h1 long, h2 long, size int, raw binary, " + ", ".join(f"{c} int" for c in cells)
    total = nodes.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    ranges = max(1, min(parallelism(nodes.sparkSession), -(-total // block_bytes)))
    in_order = nodes.select(*fields).mapInArrow(celled, schema).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    in_order = in_order.select(*fields, F.spark_partition_id().alias("pid"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, rows = 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, held, rows
            t = pa.Table.from_batches(held)
            d, raw = t.column("size")[0].as_py(), b"".join(t.column("raw").to_pylist())
            s = Sequence(raw, d, rotation.value[d], kind)
            cell = np.unique(np.floor(sides(s.unit @ rotation.value[d])[:, :KEYED] / eps).astype(np.int64), axis=0)
            here, around = (np.unique((c & 0xFFFF) @ (1 << 16 * np.arange(KEYED))).tolist() for c in (cell, (cell[:, None] + STEPS).reshape(-1, KEYED)))
            values = [(t.column("pid")[0].as_py() << 32) + made, d, s.lo.reshape(-1).tolist(), s.hi.reshape(-1).tolist(), here, around, *[t.column(n).to_numpy().tobytes() for n in fields[:4]], raw]
            types = (pa.int64(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 5)
            made, held, rows = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["block", "size", "lo", "hi", "here", "around", *fields[:4], "raw"])

        for whole in batches:
            at, sizes = 0, whole.column("size").to_numpy()
            while at < whole.num_rows:
                d = int(sizes[at])
                if held and held[0].column("size")[0].as_py() != d:
                    yield close()
                most = max(LEAF, block_bytes // (d * np.dtype(kind).itemsize))
                take = min(int(np.searchsorted(sizes[at:], d, side="right")), most - rows)
                held.append(whole.slice(at, take))
                rows, at = rows + take, at + take
                if rows == most:
                    yield close()
        if held:
            yield close()

    return in_order.mapInArrow(blocks, "block long, size int, lo array<double>, hi array<double>, here array<long>, around array<long>, node binary, n binary, h1 binary, h2 binary, raw binary")


def block_pairs(blocks: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(block, other): the pairs of blocks, each once, that have leaves which aren't provably distant."""
    box = blocks.select("block", "size", "lo", "hi", "here", "around")
    left = box.select("block", "size", F.explode("here").alias("cell"))
    right = box.select(F.col("block").alias("other"), "size", F.explode("around").alias("cell"))
    # adjacency goes both ways, so a pair is met from either side, and by several cells
    met = left.join(right, ["size", "cell"]).filter("block <= other").select("block", "other").distinct()
    met = met.join(box.select("block", "lo", "hi"), "block").join(box.select(F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "other")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for r in range(b.num_rows):
                lo, hi, lo2, hi2 = (np.array(b.column(n)[r].as_py()).reshape(-1, DIMS + 1) for n in ("lo", "hi", "lo2", "hi2"))
                keep.append(not distant(lo[:, None], hi[:, None], lo2[None], hi2[None], cosine).all())
            # either of the two may be the one that its partners are sent to
            x, y = (b.column(n).to_numpy() for n in ("block", "other"))
            turn = (x + (x >> 32) + y + (y >> 32)) % 2 == 1
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(np.where(turn, y, x)).filter(mask), pa.array(np.where(turn, x, y)).filter(mask)], ["block", "other"])

    return met.mapInArrow(near, "block long, other long")


def near_nodes(nodes: DataFrame, kind: type, cosine: float = COSINE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(h1, h2, node, root, links): of each node in near pairs its links, and nodes that it hangs together with; several rows a node."""
    rotation = nodes.sparkSession.sparkContext.broadcast(axes(nodes, kind))  # a square of the vectors' length, however many there are
    made = cut(blocked(nodes, kind, rotation, cosine, block_bytes))
    # a block is sent once to each task that holds a part of its partners
    parts = max(1, -(-made.count() // TILE))
    pairs = cut(block_pairs(made, cosine).withColumn("tile", F.pmod(F.xxhash64("other"), F.lit(parts)).cast("int")))
    payload = ("size", "node", "n", "h1", "h2", "raw")
    home = pairs.select("block", "tile").distinct().join(made.select("block", *payload), "block").select("block", "tile", F.col("block").alias("other"), F.lit(True).alias("home"), *payload)
    there = made.select(F.col("block").alias("other"), *payload)
    away = pairs.filter("block <> other").join(there, "other").select("block", "tile", "other", F.lit(False).alias("home"), *payload)
    own = pairs.filter("block = other").select("block", "tile", "other", F.lit(False).alias("home"), *[F.lit(None).cast(made.schema[c].dataType).alias(c) for c in payload])
    schema = "h1 long, h2 long, node long, root long, links long"

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        row = {n: group.column(n) for n in ("other", "home", *payload)}
        at = row["home"].to_pylist().index(True)
        width = row["size"][at].as_py()
        x = Sequence(row["raw"][at].as_py(), width, rotation.value[width], kind)
        held = [at, *(i for i in range(group.num_rows) if i != at and row["size"][i].as_py() is not None)]
        node, n, h1, h2 = (np.concatenate([np.frombuffer(row[c][i].as_py(), np.int64) for i in held]) for c in ("node", "n", "h1", "h2"))
        links, forest = np.zeros(node.size, np.int64), Forest(node.size)

        def count(pairs: Iterator[tuple[np.ndarray, np.ndarray]], first: int) -> None:
            for p, q in pairs:
                q = q + first
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                forest.link(p, q)

        if group.num_rows > len(held):
            count(join_sequences(x, x, cosine), 0)
        first = len(x.unit)
        for i in held[1:]:
            y = Sequence(row["raw"][i].as_py(), width, rotation.value[width], kind)
            count(join_sequences(x, y, cosine), first)
            first += len(y.unit)
        some = np.flatnonzero(links)
        least = np.full(node.size, np.iinfo(np.int64).max)
        root = forest.find(some)
        np.minimum.at(least, root, node[some])
        return pa.table({"h1": h1[some], "h2": h2[some], "node": node[some], "root": least[root], "links": links[some]})

    return home.unionByName(away).unionByName(own).groupBy("block", "tile").applyInArrow(join, schema)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, class_id, links) of every vec_id: the least id of its class of near vectors, and the number of near pairs it is in."""
    kind, rows = _kind(vectors), valid(vectors)
    ids = cut(rows.select("vec_id", "h1", "h2").distinct())
    # a node is a vector, named by its least id; ids with several vectors may name several
    names = ids.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    bodies = rows.groupBy("h1", "h2").agg(F.first("size").alias("size"), F.first("raw").alias("raw"))
    nodes = cut(bodies.join(names, ["h1", "h2"]))
    found = cut(near_nodes(nodes, kind, cosine, block_bytes))
    each = ids.join(nodes.select("h1", "h2", "node", "n"), ["h1", "h2"])
    own = each.groupBy("vec_id").agg(F.array_sort(F.collect_set("node")).alias("own")).filter("size(own) > 1")
    tied = own.select(F.explode(F.expr("slice(own, 2, size(own) - 1)")).alias("a"), F.expr("own[0]").alias("b"))
    roots = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct().unionByName(tied))
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    each = each.join(links, ["h1", "h2"], "left").join(roots, "node", "left")
    each = each.select("vec_id", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    bare = pick(vectors, "vec_id").filter("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("vec_id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return each.unionByName(bare).groupBy("vec_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


SQL = f"""
    with recursive v as (
        select distinct vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where vec_id is not null
    ), u as (
        select vec_id, v, sqrt(list_dot_product(v, v)) as norm from v
    ), near as (
        select a.vec_id as a, b.vec_id as b
        from u a join u b on (a.vec_id, a.v) <> (b.vec_id, b.v)
        where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {COSINE}
    ), reach as (
        select a, b from near union select r.a, n.b from reach r join near n on r.b = n.a
    ), least as (
        select a, min(b) as b from reach group by a
    ), counted as (
        select a, count(*) as n from near group by a
    )
    select i.vec_id, least(i.vec_id, coalesce(l.b, i.vec_id)) as class_id, coalesce(c.n, 0) as links
    from (select distinct vec_id from v) i left join least l on i.vec_id = l.a left join counted c on i.vec_id = c.a"""
