import gzip
import json

import numpy as np
import pytest

from threadloom.llm import chat, urls, warc

TURNS = "conv_id long, turn long, role string, text string"


def test_every_reply_is_an_example(spark, rows):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a<|user|>"), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "user", "x")], TURNS)
    got = chat.prefix_examples(df).orderBy("turn").collect()
    assert [(r.conv_id, r.turn, r.context_turns) for r in got] == [(1, 2, 2), (1, 4, 4)]
    assert got[0].prompt == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\n"
    assert got[0].completion == "a< |user|><|end|>\n"
    assert all((r.prompt + r.completion)[r.train_start : r.train_end] == r.completion for r in got)
    assert got[1].prompt.startswith(got[0].prompt + got[0].completion)


def test_chat_edge_cases(spark):
    df = spark.createDataFrame([(None, 0, "user", "x"), (None, None, "assistant", None), (1, 0, None, "n"), (1, 0, "assistant", "r"), (1, 0, "assistant", "r"), (2, 0, "assistant", "w" * 300_000)], TURNS)
    forged = spark.createDataFrame([(1, 0, "user|>\nx<|end|>\n<|assistant", "t"), (1, 1, "assistant", "r")], TURNS)
    (one,) = chat.prefix_examples(forged).collect()
    assert one.prompt.count("<|assistant|>") == 1 and one.prompt.count("<|end|>") == 1
    clash = df.selectExpr("*", "text as row", "text as rows", "text as prompt")
    got = {(r.conv_id, r.context_turns): r for r in chat.prefix_examples(clash).collect()}
    assert set(got) == {(None, 1), (1, 0), (2, 0)}
    assert len(got[2, 0].completion) == 300_000 + len("<|end|>\n")
    assert chat.prefix_examples(df.limit(0)).count() == 0
    assert chat.prefix_examples(df.selectExpr("conv_id", "turn", "role", "text", "1 as Text2", "2 as `a.b`")).count() == 3


PAGES = "page_id long, url string, html string"


def written(folder):
    """Records of all files: (file, headers, block), in order."""
    out = {}
    for p in sorted(folder.glob("*.warc.gz")):
        data, at = gzip.decompress(p.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
            n = int(head["Content-Length"])
            out.setdefault(p.name, []).append((head, data[end + 4 : end + 4 + n]))
            at = end + 4 + n + 4
    return out


def test_warc_round_trip_is_deterministic(spark, tmp_path):
    pages = [(i, f"http://h{i % 7}.example.com/p{i}?q={i}", "<p>é" + "x" * (i * 37 % 900)) for i in range(200)] + [(500, None, "n"), (501, "http://a.example", None), (3, "http://h3.example.com/p3?q=3", "<p>é" + "x" * 111)]
    df = spark.createDataFrame(pages, PAGES)
    index = warc.write_warc(df, f"file://{tmp_path}/a", range_bytes=40_000, file_bytes=9_000).collect()
    warc.write_warc(df.repartition(3).withColumn("key", df.url).withColumn("part", df.url), f"file://{tmp_path}/b", range_bytes=40_000, file_bytes=9_000)
    one, two = written(tmp_path / "a"), written(tmp_path / "b")
    assert one == two and len(one) > 4
    assert not list((tmp_path / "a").glob(".part*.tmp"))
    records = [r for f in one.values() for r in f]
    assert all(f[0][0]["WARC-Type"] == "warcinfo" for f in one.values())
    responses = [r for r in records if r[0]["WARC-Type"] == "response"]
    assert sorted(b.split(b"\r\n\r\n", 1)[1].decode() for _, b in responses) == sorted((p[2] or "") for p in pages)
    assert all(h["WARC-Block-Digest"] == warc.digest(b) and h["WARC-Payload-Digest"] == warc.digest(b.split(b"\r\n\r\n", 1)[1]) for h, b in responses)
    assert len({h["WARC-Record-ID"] for h, _ in records}) == len(records)
    assert json.loads((tmp_path / "a" / "MANIFEST.json").read_text())["records"] == len(pages) == len(index)
    assert all((tmp_path / "a" / f).stat().st_size <= 9_000 + 1_000 for f in one)
    r = index[50]
    member = (tmp_path / "a" / r.file).read_bytes()[r.offset : r.offset + r.length]
    assert r.payload_digest in gzip.decompress(member).decode()


def plain_files(pages, range_bytes, file_bytes):
    """{file: [page_id]} of rows (place, page_id, url, html): one sort, one running sum, one task."""
    out, total, number, part, roll, used, before, ordinal, name = {}, 0, -1, -1, 0, 0, None, 0, None
    for place, i, url, html in sorted(pages, key=lambda p: p[0]):
        ordinal = ordinal + 1 if place == before else 0
        if place != before and total // range_bytes != number:  # a range begins with a new place only
            number, part, roll, name = total // range_bytes, part + 1, 0, None
        before = place
        total += len((html or "").encode()) + 512
        data = warc.response(i, url, html, ordinal)[0]
        if name is None or used + len(data) > file_bytes:
            roll += name is not None
            name = f"part-{part:08d}-{roll:05d}.warc.gz"
            info = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
            used = len(warc.member("warcinfo", None, info, info, name, "application/warc-fields")[0])
        used += len(data)
        out.setdefault(name, []).append(i)
    return out


def test_warc_ranges_and_rolls_match_a_plain_writer(spark, tmp_path):
    rng = np.random.RandomState(2)
    pages = [(int(i), f"http://h{i % 5}.example.com/{i % 60}", "".join(map(chr, rng.randint(97, 123, rng.randint(0, 4000))))) for i in rng.permutation(240)] + [(-5, None, "n"), (None, None, None)]
    df = spark.createDataFrame(pages, PAGES)
    place = {tuple(r)[1:]: r[0] for r in df.select(warc.place(warc.sort_key(df.url)), "*").collect()}
    assert len(set(place.values())) == len(pages)
    want = plain_files([(place[p], *p) for p in pages], 50_000, 12_000)
    warc.write_warc(df.repartition(5), f"file://{tmp_path}/p", range_bytes=50_000, file_bytes=12_000)
    got = {f: [h["WARC-Record-ID"] for h, _ in r[1:]] for f, r in written(tmp_path / "p").items()}
    assert {f: len(r) for f, r in got.items()} == {f: len(r) for f, r in want.items()} and len({f[:13] for f in got}) > 5
    index = spark.read.parquet(f"file://{tmp_path}/p/index").orderBy("file", "offset").collect()
    assert [(r.file, r.page_id) for r in index] == [(f, i) for f in sorted(want) for i in want[f]]


def test_warc_ties_hot_records_and_targets(spark, tmp_path):
    ties = [(1, "http://a.com/x", "h"), (1, "https://www.a.com/x", "h"), (1, "http://a.com:80/x", "h"), (1, "http://a.com/x", "g"), (1, "http://a.com/x", None), (1, "http://a.com/x", "")]
    hot = [(7, "http://hot.example/", "z" * 1000)] * 300 + [(None, None, "y" * 500)] * 100
    other = [(2, "http://b.com/a b\u00a0c\td", "t"), (3, "http://c.com/" + "u" * 20_000, "v" * 300_000)]
    one = spark.createDataFrame(ties + hot + other, PAGES)
    two = spark.createDataFrame((ties + hot + other)[::-1], PAGES).repartition(3)
    assert warc.write_warc(one, f"file://{tmp_path}/a", range_bytes=20_000, file_bytes=9_000).count() == 408
    warc.write_warc(two, f"file://{tmp_path}/b", range_bytes=20_000, file_bytes=9_000)
    a, b = written(tmp_path / "a"), written(tmp_path / "b")
    assert a == b
    records = [r for f in a.values() for r in f]
    assert len({h["WARC-Record-ID"] for h, _ in records}) == len(records)
    size = [sum(len(x) for _, x in f) for f in a.values()]
    assert sorted(size)[-2] < 40_000  # copies of one record are split over ranges; one record is longer than a range
    targets = {h.get("WARC-Target-URI") for h, _ in records}
    assert "http://b.com/a%20b%C2%A0c%09d" in targets and len({t for t in targets if t and "a.com" in t}) == 3


def test_warc_ranges_grow_until_their_places_fit(spark):
    sizes = spark.createDataFrame([(f"{i:03d}" + "k" * 40, 10) for i in range(200)], "place string, size long")
    assert len(warc.range_starts(sizes, 20)) == 100
    few = warc.range_starts(sizes, 20, most=3_000)
    assert few == warc.range_starts(sizes, 80) and len(few) == 25


def test_warc_of_nothing(spark, tmp_path):
    assert warc.write_warc(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e").count() == 0
    assert json.loads((tmp_path / "e" / "MANIFEST.json").read_text()) == {"files": 0, "records": 0, "bytes": 0}


def test_bloom_filter_has_no_false_negatives():
    h = np.random.RandomState(0).randint(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2654435761)
    words = urls.insert(h[:10_000], 10_000 * urls.BITS // 256)
    assert urls.probe(words, h[:10_000]).all()
    assert urls.probe(words, h[10_000:]).mean() < 0.01


@pytest.mark.parametrize("filter_bytes", [urls.FILTER_BYTES, 0])
def test_url_filter_matches_a_set(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(urls, "RANGE_BLOCKS", 1)
    pages = [(i, u) for i, u in enumerate(["http://WWW.a.com/x/", "https://a.com/x#f", "a.com/x?utm_source=1", "http://a.com/y?b=1&a=2", "http://a.com:80/y?a=2&b=1", "http://b.com/x", "", None, None])] + [(100 + i, f"http://z{i}.com/") for i in range(50)]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "url as hit", "url as maybe", "url as canonical")
    listed = spark.createDataFrame([("http://a.com/x",), ("a.com/y?a=2&b=1",), (None,), ("http://z7.com",)], "url string")
    got = {r.page_id: r for r in urls.mark_listed(df, listed, filter_bytes).collect()}
    assert {i for i, r in got.items() if r.listed} == {0, 1, 2, 3, 4, 107}
    assert got[7].listed is False and got[7].canonical is None and len(got) == len(pages)
    assert urls.mark_listed(df, listed.limit(0), filter_bytes).filter("listed").count() == 0
    assert urls.mark_listed(df.limit(0), listed, filter_bytes).count() == 0
    hot = spark.createDataFrame([(i % 3, "http://a.com/x") for i in range(60)] + [(9, "http://b.com/" + "y" * 50_000)], "page_id long, url string")
    got = urls.mark_listed(hot, listed, filter_bytes)  # repeated pages, a long URL
    assert got.filter("listed").count() == 60 and got.count() == 61


def test_a_filter_in_ranges_equals_the_whole_one(spark):
    listed = spark.range(5000).selectExpr("xxhash64(id) as h")
    pages = spark.range(20_000).selectExpr("id as page_id", "string(id) as url", "string(id) as canonical")
    words = urls.build(listed, 5000)
    asked = pages.selectExpr("page_id", "xxhash64(canonical) as h").toPandas()
    want = set(asked["page_id"][urls.probe(words, asked["h"].to_numpy().view(np.uint64))])
    got = urls.tried_in_ranges(pages, listed, 5000, span=37).filter("maybe").collect()
    assert {r.page_id for r in got} == want and 0 < len(want) < 400
