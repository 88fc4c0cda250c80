import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import exact, simhash, suffix, vectors
from threadloom.llm import textkernel as tk

DOCS = "doc_id long, text string, source string"


# --- exact copies ----------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5).map(lambda x: x << 60), max_size=40), max_size=5))
def test_quotient_filters_merge_without_loss(parts):
    Filter = exact.CountingQuotientFilter  # noqa: N806
    stored = [Filter.from_bytes(Filter.build(np.array(p, np.uint64)).to_bytes()) for p in parts]
    fingerprints, counts = Filter.merge(stored).items()
    every = [x for p in parts for x in p]
    assert dict(zip(fingerprints.tolist(), counts.tolist(), strict=True)) == {x: every.count(x) for x in every}


def test_exact_copies(spark, rows):
    data = [(5, "a", "s"), (2, "a", "t"), (None, "a", "u"), (7, "b", "s"), (8, None, "s"), (9, None, "s"), (1, "", "s"), (3, "", "s"), (4, "A", "s"), (7, "b", "s"), (10, "x" * 200_000, "s"), (11, "x" * 200_000, "s")]
    df = spark.createDataFrame(data, DOCS)
    assert sorted(map(tuple, exact.exact_copies(df).collect()), key=repr) == sorted([(5, 2), (None, 2), (3, 1), (7, 7), (11, 10)], key=repr)
    clash = df.selectExpr("*", "1 as fp", "2 as rank", "3 as `a.b`", "4 as fp")
    kept = exact.drop_exact(clash)
    assert kept.columns == clash.columns
    assert sorted((r[0] for r in kept.collect()), key=repr) == sorted([2, 7, 8, 9, 1, 4, 10], key=repr)
    assert exact.drop_exact(df.limit(0)).count() == 0 and exact.exact_copies(df.limit(0)).count() == 0


def test_texts_that_share_a_fingerprint_and_repeated_rows(spark, rows, monkeypatch):
    """All texts under one fingerprint: they are told apart by their bytes."""
    data = [(i % 5, "ab"[i % 2], "s") for i in range(40)] + [(None, "a", "s"), (None, "a", "s"), (9, "c", "s"), (-3, None, "s")]
    df = spark.createDataFrame(data, DOCS)
    sql = """select doc_id, keep_id from (select doc_id, row_number() over w as rank, first_value(doc_id) over w as keep_id
        from documents where text is not null window w as (partition by text order by doc_id nulls last)) where rank > 1"""
    want = sorted(by_sql(sql, documents=df), key=repr)
    assert rows(exact.exact_copies(df)) == want and len(want) == 40
    split = exact._split

    def shared(docs):
        single, several, names = split(docs)
        return single, several.withColumn("fp", several["fp"] * 0), names

    monkeypatch.setattr(exact, "_split", shared)
    assert rows(exact.exact_copies(df)) == want
    many = spark.range(70_000).selectExpr("1L as doc_id", "'t' as text", "'s' as source")
    assert exact.exact_copies(many).count() == 69_999


# --- near copies -----------------------------------------------------------------------------


def altered(words, share, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.random()}" if r.random() < share else w for w in words)


def prose(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randint(0, 5000)}" for _ in range(n)]


def test_bk_forest_finds_what_brute_force_finds():
    rng = np.random.RandomState(0)
    base = rng.randint(0, 2**63, (20, 4)).astype(np.uint64)
    code = np.concatenate([base, base ^ (np.uint64(1) << rng.randint(0, 63, base.shape).astype(np.uint64)), rng.randint(0, 2**63, (60, 4)).astype(np.uint64)])
    shard = np.sort(rng.randint(0, 3, len(code)))
    forest = simhash.BKForest(code, shard)
    for i in range(len(code)):  # children of a node have different distances
        assert forest.key[i] == -1 or forest.key[i] == simhash.distance(code[i : i + 1], code[forest.parent[i] : forest.parent[i] + 1])[0]
    edges = [(p, k) for p, k in zip(forest.parent.tolist(), forest.key.tolist(), strict=True) if p >= 0]
    assert len(set(edges)) == len(edges)
    got = {(int(a), int(b)) for q, f, _ in forest.search(np.arange(len(code)), 48) for a, b in zip(q, f, strict=True)}
    want = {(i, j) for i in range(len(code)) for j in range(len(code)) if shard[i] == shard[j] and simhash.distance(code[i : i + 1], code[j : j + 1])[0] <= 48}
    assert got == want


def brute_components(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_pairs_recall_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropna().toPandas()
    code, has = simhash.codes(pa.array(docs["text"]))
    ids = docs["doc_id"].to_numpy()[has]
    code = code[has]
    distance = np.array([np.bitwise_count(code ^ c).sum(1) for c in code])
    a, b = np.nonzero(distance <= simhash.RADIUS)
    want = {(int(ids[x]), int(ids[y])) for x, y in zip(a, b, strict=True) if ids[x] < ids[y]}
    gone = {r.doc_id for r in simhash.near_copies(spark.createDataFrame(docs)).collect()}
    layout = simhash.Layout.of(len(np.unique(code, axis=0)))
    row = {int(i): c for i, c in zip(ids, code, strict=True)}
    met = {(x, y) for x, y in want if (row[x] == row[y]).all() or layout.first_band(row[x][None], row[y][None])[0] >= 0}
    assert len(met) >= 0.99 * len(want)
    roots = brute_components(ids.tolist(), met)
    assert gone == {i for i, r in roots.items() if i != r} and len(gone) > 20


@pytest.mark.parametrize("layout", [simhash.Layout.of(1000), simhash.Layout.of(1 << 30)])
def test_recall_is_what_the_layout_states(layout):
    rng = np.random.RandomState(4)
    for bits in (24, 32, 40, 44, simhash.RADIUS):
        base = rng.randint(0, 256, (6000, 32)).astype(np.uint8)
        other = base ^ np.packbits(rng.rand(6000, 256).argsort(axis=1) < bits, axis=1)
        met = (layout.first_band(base.view(np.uint64), other.view(np.uint64)) >= 0).mean()
        assert abs(met - layout.recall(bits)) < 4 * np.sqrt(max(1e-4, layout.recall(bits) * (1 - layout.recall(bits))) / 6000)
    assert layout.recall(simhash.RADIUS) >= simhash.RECALL and layout.recall(40) > 0.98 and layout.recall(32) > 0.999


def test_bands_widen_with_the_corpus():
    widths = [(made := simhash.Layout.of(1 << k)).outer + made.inner for k in range(10, 40, 3)]
    assert widths == sorted(widths) and widths[0] == 16
    assert all(1 << k >> w <= 1 << 7 for k, w in zip(range(10, 40, 3), widths, strict=True))


@pytest.mark.parametrize("layout", [None, simhash.Layout(60, 12, 7, 8)])
def test_pairs_of_a_band_are_all_found(spark, layout):
    """Without slack: every pair within the radius that shares a band, and no other, once."""
    rng = np.random.RandomState(4)
    base = rng.randint(0, 256, (700, 32)).astype(np.uint8)
    other = [base ^ np.packbits(rng.rand(700, 256).argsort(axis=1) < bits, axis=1) for bits in (20, 47, 50)]
    code = np.concatenate([base, *other]).view(np.uint64)
    used = layout or simhash.Layout.of(len(code))
    want = set()
    for i in range(len(code)):
        d = np.bitwise_count(code ^ code[i]).sum(1)
        j = np.flatnonzero(d <= simhash.RADIUS)
        j = j[j > i]
        j = j[used.first_band(np.repeat(code[i : i + 1], j.size, 0), code[j]) >= 0] if j.size else j
        want |= {(i, int(k), int(d[k])) for k in j}
    coded = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(code)], "node long, code binary")
    got = [(r.a, r.b, r.bits) for r in simhash.near_pairs(coded, layout=layout).collect()]
    assert len(got) == len(set(got)) and set(got) == want and sum(b >= 40 for _, _, b in want) > 500


def test_no_near_text_is_left_out(spark):
    """Pairs about the radius, some of which share no band of the index."""
    texts = [t for i in range(400) for t in (" ".join(prose(80, i)), altered(prose(80, i), 0.15, i))]
    code, _ = simhash.codes(pa.array(texts))
    near = [(i, int(j)) for i in range(len(code)) for j in np.flatnonzero(simhash.distance(code, code[i : i + 1]) <= simhash.RADIUS) if i < j]
    a, b = np.array(near).T
    assert (simhash.Layout.of(len(code)).first_band(code[a], code[b]) < 0).sum() >= 5
    got = {tuple(r) for r in simhash.near_copies(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)).collect()}
    assert got == {(i, r) for i, r in brute_components(range(len(texts)), near).items() if i != r}


@pytest.mark.parametrize("block", [simhash.BLOCK, 100])
def test_links_of_all_blocks(spark, block):
    """The components of all pairs within the radius, chains and one large class included, by a bounded number of rows."""
    rng = np.random.RandomState(7)
    flip = lambda x, bits: x ^ np.packbits(rng.rand(len(x), 256).argsort(axis=1) < bits, axis=1)
    base = rng.randint(0, 256, (300, 32)).astype(np.uint8)
    chain = [base[:100]]
    for bits in (48, 47, 48):
        chain.append(flip(chain[-1], bits))
    code = np.concatenate([base, *chain[1:], flip(base[100:200], 49), flip(np.repeat(base[299:], 500, 0), 12)]).view(np.uint64)
    near = [(i, int(j)) for i in range(len(code)) for j in np.flatnonzero(simhash.distance(code, code[i : i + 1]) <= simhash.RADIUS) if i < j]
    coded = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(code)], "node long, code binary")
    got = [(r.a, r.b) for r in simhash.near_links(coded, block=block).collect()]
    blocks = -(-len(code) // block)
    assert len(near) > 100_000 and len(got) <= len(code) * (blocks + 1)
    assert brute_components(range(len(code)), got) == brute_components(range(len(code)), near)
    found = [(int(i), int(j)) for p, q in simhash.compare(code, code, simhash.RADIUS) for i, j in zip(p, q, strict=True)]
    assert len(found) == len(near) and set(found) == set(near)


@pytest.mark.parametrize("ids", [(3, 5), ((1 << 63) - 1, 5), ((1 << 63) - 1, -(1 << 63))])
def test_no_number_is_confused_with_a_null_id(spark, ids):
    base = prose(300, 1)
    text = " ".join(base)
    rows = [(ids[0], text, "s"), (None, text, "s"), (None, " ".join(prose(300, 9)), "s"), (None, " ".join(prose(300, 10)), "s"), (ids[1], altered(prose(300, 9), 0.03, 1), "s")]
    got = {tuple(r) for r in simhash.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    keep = min(ids)  # the null document ties the two groups together
    assert got == {(max(ids), keep), (None, keep)}
    alone = spark.createDataFrame([(None, text, "s"), (None, altered(base, 0.02, 3), "s"), (ids[1], " ".join(prose(99, 4)), "s")], DOCS)
    assert simhash.near_copies(alone).count() == 0


def test_near_copies_and_edge_cases(spark):
    base = prose(300, 1)
    data = [(3, " ".join(base), "s"), (4, altered(base, 0.05, 1), "s"), (9, altered(base, 0.05, 2).upper(), "s"), (5, " ".join(prose(300, 2)), "s"), (6, None, "s"), (7, "", "s"), (8, "...", "s"), (None, altered(base, 0.03, 3), "s"), (10, " ".join(prose(60_000, 5)), "s"), (11, " ".join(prose(60_000, 5)) + " end", "s")]
    df = spark.createDataFrame(data, DOCS).selectExpr("*", "1 as gone", "2 as node", "3 as code", "4 as `a.b`")
    assert {tuple(r) for r in simhash.near_copies(df).collect()} == {(4, 3), (9, 3), (None, 3), (11, 10)}
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {3, 5, 6, 7, 8, 10}
    repeated = spark.createDataFrame(data[:1] * 3, DOCS)
    assert simhash.near_copies(repeated).count() == 0 and simhash.drop_near(repeated).count() == 3
    assert simhash.drop_near(df.limit(0)).count() == 0


# --- repeated passages -----------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_by_grouping(symbols):
    assert suffix.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_array_of_hard_strings():
    for s in ([0] * 300, [0, 1] * 200, [2, 1, 0] * 90, list(range(100)), list(range(100, 0, -1)), [random.Random(1).randint(0, 50) for _ in range(2000)]):
        order = suffix.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = suffix.common_prefixes(s, order)
        for i in range(1, len(s), 37):
            a, b = s[order[i - 1] :], s[order[i] :]
            assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def brute_passages(texts, least):
    """{doc: spans} of windows of `least` words that two different documents have."""
    words = {d: [bytes(x) for x in _words(t)] for d, t in texts.items()}
    seen = {}
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = set()
    for d, w in words.items():
        hit = [i for i in range(len(w) - least + 1) if len(seen[tuple(w[i : i + least])]) > 1]
        while hit:
            a = b = hit.pop(0)
            while hit and hit[0] <= b + least:
                b = hit.pop(0)
            out.add((d, a, b + least))
    return out


def _words(text):
    data, offsets = tk.raw(pa.array([text]))
    _, _, a, b = tk.words(data, offsets)
    folded = tk.fold(data)
    return [folded[x:y].tobytes() for x, y in zip(a, b, strict=True)]


def test_repeated_passages_match_brute_force(spark):
    shared, second = prose(70, 7), prose(55, 8)
    texts = {i: " ".join(prose(120, 100 + i)) for i in range(12)}
    for i in (1, 4, 9):
        texts[i] += "\n" + " ".join(shared).title() + ". " + " ".join(prose(30, 200 + i))
    texts[5] = " ".join(second) + " " + texts[5]
    texts[6] = texts[6] + "; " + ", ".join(second[:52])
    texts[10] = texts[11] = " ".join(prose(200, 300))
    texts[7] = " ".join(prose(60, 400) * 2)  # repeats within one document only
    texts[8] = " ".join(shared[:49])
    data = [(d, t, "s") for d, t in texts.items()] + [(20, None, "s"), (21, "", "s")]
    df = spark.createDataFrame(data, DOCS).selectExpr("*", "1 as fp", "2 as h1", "3 as pos", "4 as start")
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix.repeated_passages(df).collect()}
    assert got == brute_passages(texts, 50)
    assert {d for d, _, _ in got} == {1, 4, 9, 5, 6, 10, 11}
    assert suffix.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [suffix.HOT, 30])
def test_every_place_of_a_stretch_is_reported(spark, hot):
    block, line = prose(300, 500), prose(120, 501)
    texts = {1: " ".join(block * 2), 2: " ".join([*prose(40, 502), *block[100:180], *prose(40, 503)])}
    texts |= {3: " ".join(prose(20, 504) + line * 60), 4: " ".join([*prose(30, 505), *line[10:95]]), 5: " ".join(line * 3 + prose(9, 506))}
    texts |= {i: texts[1] for i in range(10, 50)}  # copies add no places
    df = spark.createDataFrame([(d, t, "s") for d, t in texts.items()], DOCS)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "20")  # buckets go over batches
    try:
        got = {(r.doc_id, r.start_word, r.end_word) for r in suffix.repeated_passages(df.filter("doc_id < 10"), hot=hot).collect()}
        assert got == brute_passages({d: t for d, t in texts.items() if d < 10}, 50)
        got = {(r.doc_id, r.start_word, r.end_word) for r in suffix.repeated_passages(df, hot=hot).collect()}
        assert got == brute_passages(texts, 50)
    finally:
        spark.conf.unset(size)


def by_sql(sql, **tables):
    """Rows of DuckDB SQL over Spark tables."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql).fetchall()


def test_passages_of_null_ids_repeated_rows_and_long_texts(spark, rows):
    shared = prose(80, 600)
    long = prose(30_000, 601)
    data = [(None, " ".join(shared), "s"), (None, " ".join(prose(10, 602) + shared), "s"), (1, " ".join(prose(20, 603) + shared[5:70]), "s")]
    data += [(2, " ".join(prose(60, 604)), "s")] * 3  # rows of one document
    data += [(3, " ".join(prose(99, 605)), "s"), (3, " ".join(prose(99, 605)[:70]), "s")]  # its texts repeat each other only
    data += [(4, " ".join(long), "s"), (5, " ".join(prose(9, 606) + long[20_000:20_060] + prose(70, 607)), "s"), (6, " ".join(prose(60, 604)[:51]), "s")]
    df = spark.createDataFrame(data, DOCS)
    got = rows(suffix.repeated_passages(df))
    assert got == sorted(map(tuple, by_sql(suffix.SQL, documents=df)), key=repr)
    assert {g[0] for g in got} == {None, 1, 2, 4, 5, 6} and (4, 20_000, 20_060, 60) in got


def test_near_vectors_equal_their_sql(spark, rows):
    rng = np.random.RandomState(8)
    x = np.repeat(rng.randn(20, 12), 6, axis=0) + 0.12 * rng.randn(120, 12)
    data = [(i % 110, v.tolist()) for i, v in enumerate(x)] + [(200 + i, x[0].tolist()) for i in range(9)] + [(None, x[0].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = rows(vectors.near_vectors(df))
    assert got == sorted(map(tuple, by_sql(vectors.SQL, embeddings=df)), key=repr) and len({g[1] for g in got}) < 40


def test_repeated_passages_over_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.dropna(subset=["text"]).collect()}
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix.repeated_passages(df).collect()}
    assert got == brute_passages(texts, 50)


# --- vectors ---------------------------------------------------------------------------------


def brute_near(rows, cosine=vectors.COSINE):
    """{vec_id: (class_id, links)} of rows (vec_id, vector)."""
    rows = list(dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows if i is not None))
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    links, near = dict.fromkeys((i for i, _ in rows), 0), []
    for a in good:
        for b in good:
            x, y = rows[a][1], rows[b][1]
            if a != b and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[rows[a][0]] += 1
                near.append((rows[a][0], rows[b][0]))
    return {i: (c, links[i]) for i, c in brute_components(sorted(links), near).items()}


@pytest.mark.parametrize("block_bytes", [1 << 12, vectors.BLOCK_BYTES])
def test_near_vectors_match_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vectors, "LEAF", 8)
    rng = np.random.RandomState(3)
    centre = rng.randn(40, 16)
    x = np.concatenate([centre + rng.randn(40, 16) * s for s in (0.05, 0.15, 0.3)] + [rng.randn(100, 16)])
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (None, data[0][1], 1), (906, [float("inf")] * 16, 1), (907, [], 1)]
    odd += [data[0], (0, data[50][1], 1), (7, data[0][1], 1), *[(1000 + i, data[9][1], 1) for i in range(30)], (800, [-0.0, *data[3][1][1:]], 1), (801, [0.0, *data[3][1][1:]], 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as raw", "2 as size", "3 as block", "4 as node")
    got = {r.vec_id: (r.class_id, r.links) for r in vectors.near_vectors(df, block_bytes=block_bytes).collect()}
    want = brute_near([(i, v) for i, v, _ in data + odd])
    assert got == want and sum(n > 0 for _, n in want.values()) > 100 and want[905] == (904, 1) and want[1000][1] >= 30
    single = df.filter("size(embedding) = 16").selectExpr("vec_id", "cast(embedding as array<float>) embedding")
    got = {r.vec_id: (r.class_id, r.links) for r in vectors.near_vectors(single, block_bytes=block_bytes).collect()}
    assert got == brute_near([(r.vec_id, r.embedding) for r in single.collect()])
    assert vectors.near_vectors(df.limit(0)).count() == 0


def skipped(spark, x, cosine):
    """Block pairs that are joined, and all of them."""
    nodes = spark.createDataFrame([(i, 1, i, i, x.shape[1], v.tobytes()) for i, v in enumerate(x)], "node long, n long, h1 long, h2 long, size int, raw binary")
    rotation = spark.sparkContext.broadcast(vectors.axes(nodes, np.float64))
    made = vectors.blocked(nodes, np.float64, rotation, cosine, 64 * x.shape[1] * 8).cache()
    n = made.count()
    return vectors.block_pairs(made, cosine).count(), n * (n + 1) // 2


def test_distant_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 16)
    rng = np.random.RandomState(5)
    spread = rng.randn(4000, 32) * 0.7 ** np.arange(32)  # a few axes hold most of the variance
    joined, every = skipped(spark, spread, 0.99)
    assert joined < 0.35 * every
    joined, every = skipped(spark, rng.randn(2000, 64), 0.9)  # isotropic: no block is provably distant
    assert joined == every
