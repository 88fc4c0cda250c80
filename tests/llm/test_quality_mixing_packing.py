import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import mixing, packing, quality

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- quality ---------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    fitted = labels.filter("doc_id % 3 <> 0")
    model = quality.train(docs, fitted)
    held = labels.filter("doc_id % 3 = 0").join(docs, "doc_id").dropna(subset=["text"]).toPandas()
    good = (held["quality"] > 0) & (held["toxic"] <= 0)
    said = np.nan_to_num(model.score(pa.array(held["text"])), nan=0.0) >= quality.THRESHOLD
    assert (said == good).mean() > 0.95
    assert said[held["toxic"] > 0].mean() < 0.1
    assert said[good].mean() > 0.98


def test_scores_are_sums_of_bins(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = [r.text for r in docs.dropna(subset=["text"]).limit(40).collect()]
    got = model.score(pa.array(texts))
    for text, s in zip(texts, got, strict=True):
        x = quality.features(pa.array([text]), model.lexicon)[0]
        if np.isnan(x[0]):
            continue
        b = [int((e < v).sum()) for e, v in zip(model.edges, x, strict=True)]
        c = [i * quality.PAIR_BINS // (e.size + 1) for i, e in zip(b, model.edges, strict=True)]
        total = model.base + sum(t[i] for t, i in zip(model.tables, b, strict=True)) + sum(t[c[i], c[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert s == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "plain words here", "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1), (4, "?!", "en", "s", 1), (None, "more plain words", None, None, None), (5, "w " * 200_000, "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model.constant
    clash = docs.selectExpr("*", "1 as score", "2 as _0", "3 as `a.b`")
    kept = quality.accept(clash, model)
    assert kept.columns == clash.columns
    assert {r.doc_id for r in kept.collect()} == {1, None, 5}
    assert {r.score for r in quality.scores(docs, model).collect()} == {1.0}
    assert quality.scores(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


# --- mixing ----------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1), st.integers(0, 60))
def test_seats_go_to_the_highest_quotients(parties, seats):
    weights, caps = {k: w for k, (w, _) in parties.items()}, {k: c for k, (_, c) in parties.items()}
    quotients = sorted((-w / (2 * k + 1), p) for p, w in weights.items() if w > 0 for k in range(caps[p]))[:seats]
    assert mixing.apportion(seats, weights, caps) == {p: sum(1 for _, x in quotients if x == p) for p in caps}


def test_mixture_by_hand(spark):
    texts = [(i, "w " * (1 + i * 7 % 23), "en", ("big", "small", None)[0 if i % 10 else 1 + i % 20 // 10], 1) for i in range(300)]
    df = spark.createDataFrame([*texts, texts[0], (None, "a b", "en", "big", 1), (900, None, "en", "big", 1), (901, "", "en", "none", 1)], DOCS).selectExpr("*", "1 as shard", "2 as tokens", "3 as `a.b`")
    settings_ = {"block": 40, "shard_blocks": 30}
    units = mixing.blocked(df, 40, 30).toPandas()
    assert units.groupby("source", dropna=False)["shard"].nunique().to_dict()["big"] > 1
    assert units["tokens"].sum() == sum(t[1].count("w") for t in texts) + texts[0][1].count("w") + 2
    blocks = units.groupby(["source", "shard", "block"], dropna=False)["tokens"].sum().reset_index()
    taken = mixing.mix(df, **settings_).toPandas()
    assert len(taken.groupby(["source", "shard", "block"], dropna=False)) == int(0.8 * len(blocks))
    whole = units.merge(taken[["source", "shard", "block"]].drop_duplicates(), on=["source", "shard", "block"])
    assert len(whole) == len(taken)  # blocks are taken whole
    share = taken.groupby("source", dropna=False)["tokens"].sum() / units.groupby("source", dropna=False)["tokens"].sum()
    assert share["small"] >= share["big"]
    kept = mixing.take(df, **settings_)
    assert kept.columns == df.columns
    assert {(r.doc_id, r.source) for r in kept.collect()} == {(None if d != d else d, s if isinstance(s, str) else None) for d, s in zip(taken["doc_id"], taken["source"], strict=True)}
    only = mixing.mix(df, weights={"small": 1}, **settings_).select("source").distinct().collect()
    assert [r.source for r in only] == ["small"]
    assert mixing.take(df.limit(0)).count() == 0


def test_a_block_counts_by_its_tokens(spark):
    """A source of long documents gets no more tokens for its seats than one of short ones."""
    long = [(i, "w " * 900, "en", "long", 1) for i in range(60)]
    short = [(1000 + i, "w " * 30, "en", "short", 1) for i in range(1800)]
    df = spark.createDataFrame([*long, *short, (5000, "w " * 50_000, "en", "one", 1)], DOCS)
    got = mixing.mix(df, weights={"long": 1, "short": 1, "one": 1}, fraction=0.5, block=100).groupBy("source").agg({"tokens": "sum"}).collect()
    tokens = {r.source: r[1] for r in got}
    # 1580 blocks in all, 790 seats: 264 and two of 263, in whole documents
    assert abs(tokens["long"] - 26_400) <= 900 and abs(tokens["short"] - 26_400) <= 800 and tokens["one"] == 50_000


# --- packing ---------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=300))
def test_packs_never_overflow_or_overlap(lengths):
    size = np.sort(np.array(lengths, np.int64))[::-1]
    where, offset = packing.pack(size, capacity=100, groups=4, small=4)
    for p in np.unique(where):
        mine = np.flatnonzero(where == p)
        order = mine[np.argsort(offset[mine])]
        ends = offset[order] + size[order]
        assert offset[order][0] == 0 and (offset[order][1:] == ends[:-1]).all() and ends[-1] <= 100
    best_fit = len(np.unique(packing.pack(size, capacity=100, groups=10**6)[0]))
    assert len(np.unique(where)) <= 1.2 * best_fit + 5


@pytest.mark.parametrize(("lengths", "most"), [(np.random.RandomState(0).lognormal(5.3, 0.9, 20_000), 1.005), (np.random.RandomState(0).uniform(1, 2048, 20_000), 1.1)])
def test_grouping_packs_tightly(lengths, most):
    """Lengths like those of documents leave almost no room; without many small ones rounding costs up to a tenth."""
    size = np.sort(np.clip(lengths, 1, 2048).astype(np.int64))[::-1]
    where, _ = packing.pack(size)
    assert len(np.unique(where)) <= most * size.sum() / packing.CAPACITY + 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 47])
def test_few_large_pieces_are_grouped_too(monkeypatch, n):
    demands = []
    solve = packing.solve
    monkeypatch.setattr(packing, "solve", lambda patterns, demand: demands.append(demand.tolist()) or solve(patterns, demand))
    size = np.sort(np.concatenate([np.random.RandomState(n).randint(257, 2048, n), np.full(30, 20)]))[::-1]
    where, _ = packing.pack(size)
    assert [sum(d) for d in demands] == [n] and len(demands[0]) <= max(1, n // 4)
    assert (np.bincount(where, size) <= packing.CAPACITY).all()
    assert where.max() <= packing._filled(size, packing.CAPACITY, packing.GROUPS, 0)[0].max()


def test_few_sizes_are_solved_to_the_optimum():
    patterns = packing.configurations([6, 4, 3], 10)
    _, amounts = packing.solve(patterns, np.array([30.0, 30.0, 30.0]))
    assert amounts.sum() == pytest.approx(40.0)  # prices 2/3, 1/3, 1/3 fit every configuration and are worth 40


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(10, 100), st.integers(1, 40)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
def test_both_pivot_rules_reach_the_same_optimum(pieces):
    sizes, demand = [s for s, _ in sorted(pieces, reverse=True)], np.array([float(d) for _, d in sorted(pieces, reverse=True)])
    patterns = packing.configurations(sizes, 100)
    _, greedy = packing.solve(patterns, demand)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "GREEDY", 0)
        columns, amounts = packing.solve(patterns, demand)
    assert amounts.sum() == pytest.approx(greedy.sum())
    assert (columns.T @ amounts >= demand - 1e-6).all()


def test_a_lost_optimum_is_an_error(monkeypatch):
    monkeypatch.setattr(packing, "MOST_PIVOTS", 0)
    with pytest.raises(ArithmeticError):
        packing.solve(packing.configurations([6, 4, 3], 10), np.array([30.0, 30.0, 30.0]))


def test_every_token_is_packed_once(spark):
    data = [(i, "w " * (i * 131 % 900), "en", "s", 1) for i in range(400)] + [(1000, "w " * 5000, "en", "s", 1), (1001, None, "en", "s", 1), (1002, " \n", "en", "s", 1), (None, "a b", "en", "s", 1), (3, "w w", "en", "s", 1)]
    df = spark.createDataFrame(data, DOCS).selectExpr("*", "1 as n", "2 as shard", "3 as `a.b`")
    got = packing.packs(df, shard_items=150).toPandas()
    assert got["n_tokens"].sum() == sum(len(t.split()) for _, t, *_ in data if t)
    assert (got.groupby("pack_id")["n_tokens"].sum() <= packing.CAPACITY).all()
    long = got[got["doc_id"] == 1000].sort_values("start")
    assert long["start"].tolist() == [0, 2048, 4096] and long["n_tokens"].tolist() == [2048, 2048, 904]
    for _, p in got.sort_values("offset").groupby("pack_id"):
        assert (p["offset"].to_numpy()[1:] >= (p["offset"] + p["n_tokens"]).to_numpy()[:-1]).all()
    assert got["doc_id"].isna().sum() == 1
    assert packing.packs(df.limit(0)).count() == 0
