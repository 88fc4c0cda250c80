"""The pipeline stage by stage against plain versions of each decision."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from threadloom.llm import mixing, packing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at[-1], SF).write.parquet(str(tmp_path / str(i)))
        at.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == columns for d in at[:-1])
    quality, exact, near, mixed, packed = at[1:]

    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality.collect()}
    good = {d for d, (q, t) in labels.items() if q == 1 and t == 0}
    assert len(kept & good) >= 0.9 * len(good)
    assert len({d for d in kept if labels.get(d, (1, 0))[1] == 1}) <= 0.1 * sum(t for _, t in labels.values())

    first = {}
    for r in quality.orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(first.values())

    rows = exact.orderBy("doc_id").collect()
    code, has = simhash.codes(pa.array([r.text for r in rows]))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero((np.bitwise_count(code ^ code[i]).sum(1) <= simhash.RADIUS) & has & has[i]):
            a, b = i, int(j)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    alone = {r.doc_id for k, r in enumerate(rows) if root[k] == k}
    left = {r.doc_id for r in near.collect()}
    assert alone <= left and len(left - alone) <= 0.1 * max(1, len(rows) - len(alone))

    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in mixing.mix(near).collect()} <= left
    got = packed.toPandas()
    assert got["n_tokens"].sum() == sum(len([w for w in r.text.replace("\xa0", "x").split()]) for r in mixed.collect())
    assert (got.groupby("pack_id")["n_tokens"].sum() <= packing.CAPACITY).all()


def test_near_stage_leaves_no_pair_out(spark):
    """One text of each class of all pairs within the radius, some of which share no band of the index."""
    rng = np.random.RandomState(3)
    words = [[f"w{k}" for k in rng.randint(0, 1 << 30, 100)] for _ in range(600)]
    texts = [" ".join(t) for w in words for t in (w, [f"x{k}" if x < 0.17 else v for v, x, k in zip(w, rng.rand(100), rng.randint(0, 1 << 30, 100), strict=True)])]
    code, _ = simhash.codes(pa.array(texts))
    near = simhash.distance(code[::2], code[1::2]) <= simhash.RADIUS
    assert sum((np.bitwise_count(code ^ c).sum(1) <= simhash.RADIUS).sum() for c in code) == len(code) + 2 * near.sum()
    assert (simhash.Layout.of(len(code)).first_band(code[::2][near], code[1::2][near]) < 0).sum() >= 5
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    left = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()}
    assert left == {*range(0, len(texts), 2), *(2 * np.flatnonzero(~near) + 1).tolist()}


def through(spark, docs, folder):
    """Each stage's result, written and read again."""
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        yield docs


def test_run_equals_its_stages(spark, tmp_path):
    once = corpus_pipeline.run(spark, SF).toPandas()
    *_, last = through(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    key = ["pack_id", "offset"]
    assert once.sort_values(key).reset_index(drop=True).equals(last.toPandas().sort_values(key).reset_index(drop=True))


def test_stages_take_nulls_repeats_and_other_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.selectExpr("cast(null as bigint) as doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "n_chars").limit(2))
    odd = odd.unionByName(spark.createDataFrame([(900_001, None, "en", "s", None), (900_002, "", "en", None, 0), (900_003, "plain words of a long text " * 60_000, "en", "s", 1)], docs.schema))
    wide = docs.unionByName(odd).selectExpr("*", "1 as fp", "2 as node", "3 as shard", "4 as score", "5 as gone", "6 as n_tokens")
    at = list(through(spark, wide, tmp_path / "w"))
    assert all(d.columns == wide.columns for d in at[:-1])
    kept = [d.count() for d in at[:-1]]
    assert kept == sorted(kept, reverse=True) and 0 < kept[-1]
    ids = {r.doc_id for r in at[0].collect()}
    assert not ids & {900_001, 900_002}  # without a word
    assert at[1].filter("text is not null").groupBy("text").count().filter("count > 1").isEmpty()
    assert at[-1].filter("n_tokens > 2048").isEmpty()


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    *front, last = through(spark, docs, tmp_path)
    assert [d.count() for d in front] == [0] * 4 and last.count() == 0
    assert all(d.columns == docs.columns for d in front)
