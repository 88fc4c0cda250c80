"""Suffix-array dedup: passages of `MIN_WORDS` words or more that occur in at least two documents.

Suffix arrays are built by linear grouping: suffixes start grouped by their first symbol; groups are
taken in descending order, and each suffix's previous-smaller pointer names the suffix whose group is
split, by how many pointers it got; what remains are groups of suffixes with equal Lyndon prefixes, in
order.  Then the array is emitted from its front: each emitted suffix appends, along the pointers, the
suffixes that it ends to their groups.  No ranks are renamed and nothing is sorted recursively.

A suffix array of a whole corpus fits no machine, so the corpus is cut into arrays that lose nothing.
Every window of MIN_WORDS words has one owner, the least-hashed of its K-word pieces (the first of
equals).  Equal windows have equal owners, so a window can repeat only within the bucket of its owner's
hash.  Owners seen in a single text are dropped; for the others the stretch of owned windows goes to
the bucket.  There, stretches seen in two texts are repeated as a whole; of the rest, those with a
window whose rolling hash came twice are put into one suffix array, and each run of suffixes with a
common prefix of MIN_WORDS words is a repeat if it comes from two documents.  Equal texts are one text
with several documents.  Words are compared by 32 bits of their hash, MIN_WORDS at a time.

Defined results: words are runs of letters and digits in folded case, so passages are equal regardless
of case and punctuation; repeats within one document alone don't count; null texts and texts of fewer
words have none; rows with one doc_id are one document (null is one too), and its spans refer to the
text they lie in; doc_id must be a whole number; an empty table gives no rows; overlapping and touching passages of a text are one span; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import textkernel as tk
from threadloom.llm.common import cut, pick

MIN_WORDS, K, HOT = 50, 10, 200_000
_STEP = np.uint64(tk.BASE)


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of non-negative symbols by grouping with previous-smaller pointers.

    Symbols and votes are told apart by counting, so the time is linear in the length and the greatest
    symbol, but for the path compression of the pointers.
    """
    n = len(symbols)
    if n == 0:
        return []
    # groups are intervals of `member`; a group is named by its first slot
    buckets: list[list[int]] = [[] for _ in range(max(symbols) + 1)]
    for i, x in enumerate(symbols):
        buckets[x].append(i)
    member = [i for bucket in buckets for i in bucket]
    slot = [0] * n
    group = [0] * n
    end = [0] * (n + 1)
    first = 0
    for i, s in enumerate(member):
        if i and symbols[s] != symbols[member[i - 1]]:
            end[first] = i
            first = i
        slot[s], group[s] = i, first
    end[first] = n
    jump = list(range(-1, n - 1))  # nearest candidate to the left; done suffixes are skipped over
    done = [False] * n
    previous = [-1] * n
    top = n
    while top > 0:
        g = group[member[top - 1]]
        mine = member[g:top]
        for s in mine:
            done[s] = True
        votes: dict[int, int] = {}
        for s in mine:
            p = jump[s]
            trail = [s]
            while p >= 0 and done[p]:
                trail.append(p)
                p = jump[p]
            for t in trail:
                jump[t] = p
            previous[s] = p
            if p >= 0:
                votes[p] = votes.get(p, 0) + 1
        # the most named go last in their group; each (group, votes) becomes a group right after the old one
        ranked: list[dict[int, list[int]]] = [{} for _ in range(max(votes.values(), default=0) + 1)]
        for p, count in votes.items():
            ranked[count].setdefault(group[p], []).append(p)
        for same in reversed(ranked):
            for old, named in same.items():
                last = end[old]
                new = last - len(named)
                if new == old:
                    continue
                for i, p in enumerate(named):
                    a, b = slot[p], last - 1 - i
                    q = member[b]
                    member[a], member[b] = q, p
                    slot[q], slot[p] = a, b
                for p in named:
                    group[p] = new
                end[old], end[new] = new, last
        top = g
    # second phase: from the front; group[] is the next free slot's owner
    out = [-1] * n
    free = list(range(n + 1))
    placed = [False] * n
    s = n  # the empty suffix comes first
    i = -1
    while True:
        j = s - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
        i += 1
        if i == n:
            return out
        s = out[i]


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """lcp[i]: common prefix of the suffixes order[i - 1] and order[i]."""
    n = len(symbols)
    rank = [0] * n
    for i, s in enumerate(order):
        rank[s] = i
    lcp, h = [0] * n, 0
    for s in range(n):
        if rank[s]:
            t = order[rank[s] - 1]
            most = n - max(s, t)
            while h < most and symbols[s + h] == symbols[t + h]:
                h += 1
            lcp[rank[s]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return lcp


def repeats(strings: list[list[int]], owner: list, least: int) -> list[list[int]]:
    """For each string the starts of its `least`-symbol windows that a string of another owner has too. Symbols are >= 0."""
    shift = len(strings)
    symbols: list[int] = []
    source: list[int] = []
    begin: list[int] = []
    for k, string in enumerate(strings):
        begin.append(len(symbols))
        symbols.extend(x + shift for x in string)
        symbols.append(shift - 1 - k)  # a separator that occurs once: no prefix runs over it
        source.extend([k] * (len(string) + 1))
    order = suffix_array(symbols)
    lcp = common_prefixes(symbols, order)
    out: list[list[int]] = [[] for _ in strings]
    i, n = 0, len(order)
    while i < n:
        j = i + 1
        while j < n and lcp[j] >= least:
            j += 1
        if j - i > 1 and len({owner[source[s]] for s in order[i:j]}) > 1:
            for s in order[i:j]:
                out[source[s]].append(s - begin[source[s]])
        i = j
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k successive entries (uint64); entry i is that of h[i : i + k]."""
    out = h[: h.size - k + 1].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : h.size - k + 1 + j]
    return tk.mix(out)


def owners(row: np.ndarray, h: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index, hash, first, last): the pieces that own windows, and the windows, all as word indexes of the stream."""
    w = least - k + 1
    z = np.zeros(0, np.int64)
    if h.size < least:
        return z, z.astype(np.uint64), z, z
    piece = rolling(h, k)
    m = piece.size
    key = (piece & ~np.uint64((1 << 28) - 1)) | (np.arange(m, dtype=np.uint64) & np.uint64((1 << 28) - 1))
    padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = m - w + 1
    best = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    inside = row[:starts] == row[least - 1 : least - 1 + starts]  # the window lies in one text
    window = np.flatnonzero(inside)
    if not window.size:
        return z, z.astype(np.uint64), z, z
    low = (best[window] & np.uint64((1 << 28) - 1)).astype(np.int64)
    index = window + ((low - window) & ((1 << 28) - 1))
    change = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    stop = np.concatenate([change[1:], [index.size]]) - 1
    return index[change], piece[index[change]], window[change], window[stop]


def _word_start(row: np.ndarray, n: int) -> np.ndarray:
    """Index of the first word of each text, n + 1 entries."""
    return np.searchsorted(row, np.arange(n + 1), side="left")


def _segments(fp: np.ndarray, same: np.ndarray, owner: np.ndarray, h1: np.ndarray, h2: np.ndarray, start: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans (h1, h2, start, end) that repeat, of whole buckets; rows sorted by fp, same, owner, h1, h2, start."""
    offset = np.concatenate([[0], np.cumsum(lengths)])
    first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (same[1:] != same[:-1])]))
    last = np.concatenate([first[1:], [fp.size]]) - 1
    several = owner[first] != owner[last]
    hit = np.repeat(several, last - first + 1)
    if hit.any():
        yield h1[hit], h2[hit], start[hit], start[hit] + lengths[hit]
    # one row for each distinct stretch, which stands for all places of it; buckets with two of them or more
    bucket = fp[first]
    change = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    number = np.cumsum(change) - 1
    many = np.bincount(number)[number] > 1
    chosen, final = first[many], last[many]
    if not chosen.size:
        return
    number, several = number[many], several[many]
    size = lengths[chosen]
    at = np.repeat(offset[chosen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    stream = tokens[at]
    begin = np.concatenate([[0], np.cumsum(size)])
    window = rolling(stream.astype(np.uint64) + np.uint64(1), least)
    of = np.repeat(np.arange(chosen.size), size)
    valid = np.flatnonzero(of[: window.size] == of[least - 1 :])
    value, of_valid = window[valid], of[valid]
    order = np.lexsort((of_valid, value, number[of_valid]))
    v, o, b = value[order], of_valid[order], number[of_valid][order]
    edge = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (b[1:] != b[:-1])]))
    until = np.concatenate([edge[1:], [v.size]]) - 1
    twice = np.repeat(o[edge] != o[until], until - edge + 1)
    place, who = valid[order][twice], o[twice]
    if not place.size:
        return
    lo, hi = np.full(chosen.size, np.iinfo(np.int64).max), np.full(chosen.size, -1)
    np.minimum.at(lo, who, place)
    np.maximum.at(hi, who, place + least)
    live = np.flatnonzero(hi >= 0)
    groups = np.flatnonzero(np.concatenate([[True], number[live][1:] != number[live][:-1], [True]]))
    got: list[tuple[int, int, int, int]] = []
    for x, y in zip(groups[:-1], groups[1:], strict=True):
        rows = live[x:y]
        parts = [stream[lo[r] : hi[r]] for r in rows]
        _, ranks = np.unique(np.concatenate(parts), return_inverse=True)
        strings, p = [], 0
        ranks = ranks.tolist()
        for part in parts:
            strings.append(ranks[p : p + part.size])
            p += part.size
        # a stretch of several texts is an owner of its own: another text always has it too
        names = [(int(owner[chosen[r]]), False) if not several[r] else (int(r), True) for r in rows]
        for r, starts in zip(rows, repeats(strings, names, least), strict=True):
            if several[r] or not starts:
                continue
            starts.sort()
            runs: list[list[int]] = []
            for s in starts:
                if not runs or s > runs[-1][1]:
                    runs.append([s, s])
                runs[-1][1] = s + least
            # the stretch may stand in its document several times
            here = slice(chosen[r], final[r] + 1)
            places = set(zip(h1[here].tolist(), h2[here].tolist(), (start[here] + (lo[r] - begin[r])).tolist(), strict=True))
            got.extend((x1, x2, base + a, base + z) for x1, x2, base in places for a, z in runs)
    if got:
        yield tuple(np.array(c, np.int64) for c in zip(*got, strict=True))


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of the repeated passages of each document; buckets of over `hot` rows are reduced as they come."""
    keyed = pick(docs, "doc_id", "text").filter("text is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tk.slices(b.column(2)):
                row, h, _, _ = tk.words(*tk.raw(b.column(2).slice(lo, hi - lo)))
                index, value, _, _ = owners(row, h, least, k)
                where = row[index]
                pos = index - _word_start(row, hi - lo)[where]
                h1, h2 = (b.column(i).to_numpy()[lo + where] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(h1), pa.array(h2), pa.array(pos)], ["fp", "h1", "h2", "pos"])

    found = cut(keyed.select("h1", "h2", "text").mapInArrow(pieces, "fp long, h1 long, h2 long, pos long"))
    # pieces of several texts, summed up before they are sent: a common one has a row a partition
    ends = found.groupBy("fp").agg(*[f(c).alias(f.__name__ + c) for c in ("h1", "h2") for f in (F.min, F.max)])
    shared = found.join(ends.filter("minh1 < maxh1 or minh2 < maxh2").select("fp"), "fp", "left_semi").select("h1", "h2", "pos")
    same = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.bool_or(F.col("doc_id").isNull()).alias("c"))
    same = same.withColumn("several", F.expr("coalesce(a < b, false) or (c and a is not null)"))
    whole = same.filter("several").select("h1", "h2", F.lit(-1).cast("long").alias("pos"))
    wanted = shared.unionByName(whole).groupBy("h1", "h2").agg(F.collect_set("pos").alias("pos"))
    # of equal texts, the one with the least doc_id is read again
    # texts of the same document alone don't repeat each other: it owns them all
    owner = F.when(F.col("several"), F.col("h1")).otherwise(F.xxhash64(F.lit(2), "a")).alias("owner")
    wanted = wanted.join(same.select("h1", "h2", F.col("a").alias("doc_id"), owner), ["h1", "h2"]).hint("shuffle_hash")
    mine = [keyed["h1"] == wanted["h1"], keyed["h2"] == wanted["h2"], keyed["doc_id"].eqNullSafe(wanted["doc_id"])]
    texts = keyed.join(wanted, mine).select(keyed["h1"], keyed["h2"], keyed["text"], wanted["pos"], wanted["owner"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tk.slices(b.column(2), 1 << 20):
                n = hi - lo
                row, h, _, _ = tk.words(*tk.raw(b.column(2).slice(lo, n)))
                begin = _word_start(row, n)
                h1, h2, own = (b.column(i).to_numpy()[lo:hi] for i in (0, 1, 4))
                listed = b.column(3).slice(lo, n)
                of = np.repeat(np.arange(n), listed.value_lengths().to_numpy())
                pos = listed.flatten().to_numpy()
                full = of[pos < 0]
                full = full[np.diff(begin)[full] >= least]
                index, value, first, last = owners(row, h, least, k)
                keep = np.isin(index, (begin[of] + pos)[pos >= 0])
                index, value, first, last = index[keep], value[keep], first[keep], last[keep]
                size = last - first + least
                at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if size.size else np.zeros(0, np.int64)
                token = np.ascontiguousarray(h[at].astype(np.uint32))
                bounds = np.concatenate([[0], np.cumsum(size)]) * 4
                blob = pa.Array.from_buffers(pa.large_binary(), size.size, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(token)]).cast(pa.binary())
                where = row[index]
                columns = [pa.array(value.view(np.int64)), pa.array(own[where]), pa.array(h1[where]), pa.array(h2[where]), pa.array(first - begin[where]), pa.array(np.zeros(size.size, np.int64)), blob]
                names = ["fp", "owner", "h1", "h2", "start", "whole", "stretch"]
                yield pa.RecordBatch.from_arrays(columns, names)
                if full.size:
                    empty = pa.array([b""] * full.size, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(h1[full]), pa.array(own[full]), pa.array(h1[full]), pa.array(h2[full]), pa.array(np.zeros(full.size, np.int64)), pa.array(np.diff(begin)[full]), empty], names)

    cutout = texts.mapInArrow(stretches, "fp long, owner long, h1 long, h2 long, start long, whole long, stretch binary").withColumn("same", F.xxhash64("stretch"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {n: t.column(n).to_numpy() for n in ("fp", "same", "owner", "h1", "h2", "start", "whole")}
            is_whole = c["whole"] > 0
            if is_whole.any():
                yield record(c["h1"][is_whole], c["h2"][is_whole], c["start"][is_whole], c["whole"][is_whole])
            t = t.filter(pa.array(~is_whole))
            if not t.num_rows:
                return
            data, bounds = tk.raw(t.column("stretch").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
            rest = {n: c[n][~is_whole] for n in c}
            for got in _segments(rest["fp"], rest["same"], rest["owner"], rest["h1"], rest["h2"], rest["start"], np.diff(bounds) // 4, np.frombuffer(data.tobytes(), np.uint32), least):
                yield record(*got)

        def record(h1: np.ndarray, h2: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(start), pa.array(end)], ["h1", "h2", "start", "end"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < min(20_000, hot):
                continue
            t = pa.Table.from_batches(held)
            fp = t.column("fp").to_numpy()
            last = int(np.searchsorted(fp, fp[-1]))
            if last:
                yield from spans(t.slice(0, last))
            t = t.slice(last)
            if t.num_rows > hot:  # a hot bucket: stretches of several texts are told at once, two rows of each go on
                a, s, own, x, y, at = (t.column(n).to_numpy() for n in ("fp", "same", "owner", "h1", "h2", "start"))
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
                ends = np.concatenate([first[1:], [a.size]]) - 1
                multi = own[first] != own[ends]
                hit = np.repeat(multi, ends - first + 1)
                if hit.any():
                    told = t.filter(pa.array(hit))
                    begin = told.column("start").to_numpy()
                    yield record(told.column("h1").to_numpy(), told.column("h2").to_numpy(), begin, begin + np.array([len(z) // 4 for z in told.column("stretch").to_pylist()], np.int64))
                # two rows of different documents stand for a stretch of several; of one document's, each place goes on once
                place = np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (at[1:] != at[:-1])]) & ~hit
                keep = np.unique(np.concatenate([first, ends[multi], np.flatnonzero(place)]))
                t = t.take(pa.array(keep))
            held, rows = t.combine_chunks().to_batches(), 0
        if held:
            yield from spans(pa.Table.from_batches(held))

    order = ["fp", "same", "owner", "h1", "h2", "start"]
    spans = cutout.repartition("fp").sortWithinPartitions(*order).mapInArrow(resolve, "h1 long, h2 long, start long, end long")
    here = Window.partitionBy("h1", "h2").orderBy("start", "end")
    marked = spans.withColumn("reach", F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("fresh", F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("h1", "h2", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    ids = keyed.select("doc_id", "h1", "h2").distinct()
    return cut(merged).join(ids, ["h1", "h2"]).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


_CAPITALS = "".join(map(chr, [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]))
SQL = f"""
    with texts as (
        select distinct doc_id, text from documents where text is not null
    ), split as (
        select doc_id, text, regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[0-9a-zA-Z\\x{{80}}-\\x{{10FFFF}}]+') as w from texts
    ), windows as (
        select doc_id, text, i as start, hash(list_slice(w, i + 1, i + {MIN_WORDS})) as h, md5(array_to_string(list_slice(w, i + 1, i + {MIN_WORDS}), ' ')) as m
        from (select doc_id, text, w, unnest(range(len(w) - {MIN_WORDS - 1})) as i from split where len(w) >= {MIN_WORDS})
    ), hit as (
        select doc_id, text, start from (
            select *, min(coalesce(cast(doc_id as varchar), '')) over w as a, max(coalesce(cast(doc_id as varchar), '')) over w as b from windows window w as (partition by h, m)
        ) where a <> b
    ), marked as (
        select *, coalesce(cast(start > lag(start) over (partition by doc_id, text order by start) + {MIN_WORDS} as integer), 1) as fresh from hit
    ), islands as (
        select *, sum(fresh) over (partition by doc_id, text order by start) as island from marked
    )
    select doc_id, min(start) as start_word, max(start) + {MIN_WORDS} as end_word, max(start) + {MIN_WORDS} - min(start) as n_words
    from islands group by doc_id, text, island"""
