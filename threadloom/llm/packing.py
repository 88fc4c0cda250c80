"""Best-fit packing by linear grouping.

A document's tokens are its runs of non-blank characters; a document longer than a pack is cut into
full packs and a rest, so that every token is packed once.  Within a shard, the large pieces, sorted
by length, fall into `GROUPS` groups of equal cardinality, each rounded up to its longest piece.  That
leaves few sizes: all ways to fill a pack with them (configurations) are listed, and a linear program
over them, solved by the simplex method, says how often to use each.  Whole uses are carried out with
the actual pieces of each group; the pieces that fractions leave, and then the small ones, are put
where they fit best, the longest first.  With fewer than four large pieces a group, they fall into
fewer groups, of four or more; since rounding costs most there, all pieces are also put where they fit
best alone, and of the two ways the one with fewer packs (of equals the grouped one) is taken.

Shards are hashes of doc_id and hold about `SHARD_ITEMS` documents, so a shard's groups have many
pieces at any corpus size, and the work grows in proportion to the input.

Defined results: null texts and texts without tokens don't appear; repeated rows are packed
separately; of pieces of equal length the least doc_id (nulls last) goes first; doc_id must be a whole
number; extra columns are left out; an empty table gives no packs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, pick

CAPACITY, GROUPS, SMALL, SHARD_ITEMS = 2048, 12, 8, 20_000
GREEDY, MOST_PIVOTS = 400, 20_000


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All maximal multisets of the sizes (falling) that fit: rows of counts."""
    out: list[list[int]] = []
    count = [0] * len(sizes)

    def fill(i: int, left: int) -> None:
        if i == len(sizes) - 1:
            count[i] = left // sizes[i]
            out.append(count.copy())
            count[i] = 0
            return
        for c in range(left // sizes[i], -1, -1):
            count[i] = c
            fill(i + 1, left - c * sizes[i])
        count[i] = 0

    fill(0, capacity)
    made = np.array(out)
    return made[made.sum(1) > 0]


def solve(patterns: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min sum(x) with patterns.T @ x >= demand: (indexes, amounts) of an optimal basis.

    Revised simplex; it starts from the patterns that hold most of each size. Patterns may be used
    with fewer pieces than they hold, so single-size columns with a surplus are allowed for. The
    pattern worth most enters; after `GREEDY` pivots the first that is worth enough (Bland's rule), so
    that it can't go round in circles. No price is left above 1 at the end, or an error is raised.
    """
    k = demand.size
    basis = np.array([int(patterns[:, i].argmax()) for i in range(k)])
    matrix = np.zeros((k, k))
    for i, b in enumerate(basis):
        matrix[i, i] = patterns[b, i]  # the pattern with only this size: it holds no more than the pattern
    columns = matrix.T.copy()
    order = np.arange(k) - k  # numbers of the columns, as Bland's rule needs
    for pivots in range(MOST_PIVOTS):
        inverse = np.linalg.inv(columns.T)
        x = inverse @ demand
        price = np.maximum(np.ones(k) @ inverse, 0)
        value = patterns @ price
        best = int(value.argmax())
        if value[best] <= 1 + 1e-9:
            return columns, np.maximum(np.linalg.solve(columns.T, demand), 0)
        if pivots >= GREEDY:
            best = int((value > 1 + 1e-9).argmax())
        direction = inverse @ (patterns[best] * (price > 1e-12))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        tied = np.flatnonzero(ratio <= ratio.min() + 1e-12)
        leave = int(tied[order[tied].argmin()]) if pivots >= GREEDY else int(ratio.argmin())
        columns[leave], order[leave] = patterns[best] * (price > 1e-12), best
    raise ArithmeticError(f"no optimum of {k} sizes after {MOST_PIVOTS} pivots")


def pack(length: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(pack, offset) of each piece; lengths must be sorted falling and lie in 1..capacity."""
    large = int(np.searchsorted(-length, -(capacity // small), side="left"))
    if large >= groups * 4 or not large:
        return _filled(length, capacity, groups, large)
    grouped = _filled(length, capacity, min(groups, GROUPS, max(1, large // 4)), large)
    plain = _filled(length, capacity, groups, 0)
    return grouped if grouped[0].max() <= plain[0].max() else plain


def _filled(length: np.ndarray, capacity: int, groups: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """(pack, offset) of each piece; the first `large` are grouped."""
    n = length.size
    where, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    left: list[int] = []
    if large:
        cut_at = np.linspace(0, large, groups + 1).astype(int)
        sizes = [int(length[a]) for a in cut_at[:-1]]  # each group rounded up to its longest
        merged: dict[int, list[int]] = {}
        for s, a, b in zip(sizes, cut_at[:-1], cut_at[1:], strict=True):
            merged.setdefault(s, []).extend(range(a, b))
        keys = list(merged)
        queue = [np.array(merged[s]) for s in keys]
        at = np.zeros(len(keys), int)
        columns, amounts = solve(configurations(keys, capacity), np.array([q.size for q in queue], float))
        for column, amount in sorted(zip(columns.round().astype(int).tolist(), np.floor(amounts + 1e-9).astype(int).tolist(), strict=True), reverse=True):
            # the pieces of a group may run out before the whole number of uses
            uses = min([amount, *((queue[i].size - at[i]) // c for i, c in enumerate(column) if c)])
            if uses <= 0:
                continue
            used = np.zeros(uses, np.int64)
            packs = len(left) + np.arange(uses)
            for i, c in enumerate(column):
                for _ in range(c):
                    take = queue[i][at[i] : at[i] + uses]
                    at[i] += uses
                    where[take], offset[take] = packs, used
                    used += length[take]
            left.extend((capacity - used).tolist())
    # best fit: packs by the room they have left, a bit set of the rooms there are
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for p, r in enumerate(left):
        room[r].append(p)
        bits |= 1 << r
    for i in np.flatnonzero(where < 0).tolist():
        size = int(length[i])
        fits = bits >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            p = room[r].pop()
            if not room[r]:
                bits ^= 1 << r
        else:
            r, p = capacity, len(left)
            left.append(capacity)
        where[i], offset[i] = p, capacity - r
        left[p] = r - size
        room[r - size].append(p)
        bits |= 1 << (r - size)
    return where, offset


def packs(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(pack_id, offset, doc_id, start, n_tokens): which tokens of which document lie where."""
    count = F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+")).cast("long")
    items = pick(docs, "doc_id", "text").select("doc_id", count.alias("n")).filter("n > 0")
    items = cut(items)
    shards = items.count() // shard_items + 1
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def arranged(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        group = group.sort_by([("n", "descending"), ("doc_id", "ascending")])
        total = group.column("n").to_numpy()
        pieces = -(-total // capacity)
        row = np.repeat(np.arange(total.size), pieces)
        start = (np.arange(row.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        size = np.minimum(total[row] - start, capacity)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        full = int(np.searchsorted(-size, -capacity, side="right"))
        where, offset = pack(size[full:], capacity, groups, small)
        where = np.concatenate([np.arange(full), where + full])
        offset = np.concatenate([np.zeros(full, np.int64), offset])
        return pa.table({"pack_id": (np.int64(shard) << 32) + where, "offset": offset, "doc_id": group.column("doc_id").take(pa.array(row)), "start": start, "n_tokens": size})

    return items.groupBy("shard").applyInArrow(arranged, "pack_id long, offset long, doc_id long, start long, n_tokens long")
