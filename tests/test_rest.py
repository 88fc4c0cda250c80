import json
import math
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import messages, text, validate
from threadloom.operators import cluster, generate, pairs, relational, search, strata
from threadloom.plans.chat import FAILED, MemoryChat, PerspectivePrompts
from threadloom.plans.frame import Frame, Roles, embeddable_type
from threadloom.sources import exports, files
from threadloom.streaming import windows


def test_validators(spark):
    df = spark.createDataFrame([(1, 3.5, [1.0, 2.0])], "i int, r double, v array<double>")
    ok = lambda c: df.select(c.alias("x")).first().x
    assert ok(validate.discrete(F.col("i"), [1, 2])) is True
    assert ok(validate.discrete(F.col("i"), [2])) is False
    assert ok(validate.real(F.col("r"), 0, 5)) is True
    assert ok(validate.real(F.col("r"), 0, 3)) is False
    assert ok(validate.n_real(F.col("v"), [(0, 1), (0, 2)])) is True
    assert ok(validate.n_real(F.col("v"), [(0, 1), (0, 1)])) is False
    assert ok(validate.n_real(F.col("v"), [(0, 1)])) is False
    with pytest.raises(Exception, match="invalid i"):
        validate.checked(df, "i", lambda c: validate.discrete(c, [2])).collect()
    assert validate.checked(df, "i", lambda c: validate.discrete(c, [2]), fail=False).first().i_valid is False


def test_generation_retries_and_attaches_by_key(spark, tmp_path):
    class Flaky:
        def __init__(self):
            self.seen = set()

        def complete(self, asked):
            said = asked[-1]["content"]
            if said == "bad":
                raise RuntimeError("no")
            if said not in self.seen:
                self.seen.add(said)
                raise generate.Transient("Rate limit")
            return said.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, value string")
    store = generate.RunStore(spark, str(tmp_path))
    out = generate.generated(df, "value", "id", Flaky, "s", store=store, run_id="r")
    assert {r.id: r.output for r in out.collect()} == {1: "A", 2: None, 3: "C"}
    again = generate.generated(df, "value", "id", generate.EchoGenerator, "s", store=store, run_id="r")
    assert {r.id: r.output for r in again.collect()} == {1: "A", 2: "bad", 3: "C"}
    store.write_logs("r")


def test_reset_header(spark):
    df = spark.createDataFrame([("250ms",), ("6s",), ("soon?",), ("x",)], "h string")
    assert [r[0] for r in df.select(generate.reset_seconds(F.col("h"))).collect()] == [0.25, 6.0, None, 0.01]


def test_chat(spark):
    chat = MemoryChat(spark, generate.EchoGenerator(), user_template="Q {question}")
    assert chat.reply("hi") == "Q hi"
    assert [m["content"] for m in chat.prompt("next")][1:] == ["hi", "Q hi", "Q next"]

    class Broken:
        def complete(self, asked):
            raise RuntimeError("down")

    chat.provider = Broken()
    assert chat.reply("x") == FAILED
    assert len(chat.logs["failed"]) == 1 and len(chat.thread) == 2


def test_prompt_catalogue(spark):
    p = PerspectivePrompts(spark.createDataFrame([("a\\b", "one"), ("a\\c", "two")], "key string, prompt string"))
    assert p.get("a", "c") == "two"
    assert sorted(r[0] for r in p.perspectives().collect()) == ["b", "c"]
    assert p.random() in ("one", "two")
    with pytest.raises(KeyError):
        p.get("a", "z")


def test_frame(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", 2.0), (2, "c", 3.0)], "id long, t string, n double")
    f = Frame(df, Roles(embeddable_columns=("t",)))
    assert [r["tokens_len|t"] for r in f.tokenize_column("t").orderBy("id").collect()] == [2, 1]
    e = f.embed_column("t", "id", generate.HashingEmbedder)
    assert e.roles.embedding_columns == ("embedding|t",)
    q = generate.HashingEmbedder().embed("c")
    assert e.search_column_with_sql("SELECT * WHERE id > 0", q, "t", 1, "id").first().id == 2
    assert f.embed_column("n", "id", generate.HashingEmbedder).orderBy("id").first()["embedding|n"] == [2.0]
    assert embeddable_type(df, "n") == "numeric"
    e.save(str(tmp_path / "f"))
    again = Frame.load(spark, str(tmp_path / "f"))
    assert again.roles == e.roles and again.count() == 2
    assert f.filter("id = 1").count() == 1
    assert f.convert_column_to_messages("t").first().messages[1].content == "a b"
    with pytest.raises(ValueError):
        f.set_embeddable_columns("nope")


def test_python_and_rst_corpora(spark, tmp_path):
    (tmp_path / "p" / "sub").mkdir(parents=True)
    (tmp_path / "p" / "a.py").write_text("def f():\n    '''D.'''\n    return 1\n\nclass A:\n    def m(self):\n        pass\n")
    (tmp_path / "p" / "sub" / "b.py").write_text("def broken(:\n")
    (tmp_path / "p" / "c.rst").write_bytes(b"T\n===\n\xff")
    root = str(tmp_path / "p")
    assert files.python_values(spark, root).count() == 3
    assert files.python_values(spark, root, resolution="class").count() == 1
    assert files.python_values(spark, root, resolution="module").count() == 2
    assert "D." not in "".join(r.code for r in files.python_values(spark, root, remove_docstrings=True).collect())
    assert files.documentation(spark, root).first().content == "T\n===\n"
    assert [r.name for r in files.subdirectories(files.listing(spark, root), root).collect()] == ["sub"]
    modules = files.texts(spark, root, ".py").withColumn("module", F.lit("m"))
    pages = {r.filename.rsplit("/", 1)[1]: r.page for r in files.rst_members(modules).collect()}
    assert pages == {"a.py": ".. autofunction:: m.f\n\n.. autoclass:: m.A"}
    assert files.make_directory(spark, f"{root}/new") and files.copy(spark, f"{root}/c.rst", f"{root}/new/d.rst")
    assert files.move(spark, f"{root}/new/d.rst", f"{root}/new/e.rst") and files.remove(spark, f"{root}/new")


def test_rewrites_and_stubs(spark):
    f = spark.createDataFrame([("x", "a b a"), ("y", "q")], "filename string, content string")
    c = spark.createDataFrame([("x", "a", "z")], "filename string, original string, replacement string")
    assert {r.filename: r.content for r in files.replaced(f, c).collect()} == {"x": "z b z", "y": "q"}
    m, known = spark.createDataFrame([("m",), ("k",)], "module string"), spark.createDataFrame([("k",)], "module string")
    assert files.rst_stubs(m, known).first().page.startswith("m\n=\n")


def test_chat_exports(spark):
    node = {"message": {"create_time": 1.0, "update_time": None, "author": {"role": "user"}, "content": {"parts": ["hi", "x"]}}}
    export = {"id": "c", "title": "t", "mapping": {"n": node, "root": {"message": None}, "e": {"message": {"author": {"role": "tool"}, "content": {"parts": []}}}}}
    df = spark.createDataFrame([(json.dumps(export),), ("not json",)], "json string")
    got = {r.message_id: (r.role, r.content, r.update_time) for r in exports.chat_export(df).collect()}
    assert got == {"n": ("user", "hi", 0.0), "e": ("tool", None, 0.0)}
    page = '<html><script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {"serverResponse": {"data": export}}}}) + "</script>"
    assert exports.shared_pages(spark.createDataFrame([(page,)], "html string")).count() == 2
    with pytest.raises(Exception, match="no conversation"):
        exports.shared_pages(spark.createDataFrame([("<p>",)], "html string")).collect()


def test_issues_commits_papers(spark, tmp_path):
    i = json.dumps([{"number": 1, "title": "t", "body": "b", "state": "open", "labels": [{"name": "x"}]}, {"number": 2, "state": "closed", "labels": []}])
    assert [(r.number, r.labels) for r in exports.issues(spark.createDataFrame([(i,)], "json string")).collect()] == [(1, ["x"])]
    c = json.dumps([{"sha": "s", "commit": {"message": "m", "author": {"name": "n", "email": "e", "date": "d"}}}])
    assert exports.commits(spark.createDataFrame([(c,)], "json string")).first().author.name == "n"
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://x/abs/1234v1</id><title> T </title><summary>S</summary></entry></feed>")
    assert tuple(exports.papers(spark, str(tmp_path / "a.xml")).first()) == ("1234v1", "T", "S")
    h = spark.createDataFrame([(1, '<div class="abstract">A</div><div class="ltx_para">one <b>x</b></div><p>p1</p><p class="k">p2</p>')], "pubmed_id int, html string")
    assert tuple(exports.abstracts(h).first()) == (1, "A", "p1 p2")
    assert h.select(exports.numbered_divisions(F.col("html")).alias("m")).first().m == {0: "one x"}


def test_text_and_messages(spark):
    rst = "Title\n=====\n\n.. function:: f(x)\n.. class:: A\n\nExample\n\n.. code:: python\n\n   x = 1\n\nend\n"
    r = spark.createDataFrame([(rst,)], "t string").select(text.rst_content(F.col("t")).alias("r")).first().r
    assert (r.sections, r.functions, r.classes) == (["Title"], ["f"], ["A"])
    df = spark.createDataFrame([('{"choices":[{"message":{"content":"hi"}}]}', "gpt-4"), ('{"text":"#ASSISTANT yo"}', "command")], "r string, m string")
    assert [x[0].strip() for x in df.select(messages.reply_text(F.col("r"), F.col("m"))).collect()] == ["hi", "yo"]


def test_clusters_and_strata(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.9]), (5, [-1.0, -1.0])], "id long, v array<double>")
    assert {r.id: r.cluster for r in cluster.density(v, "id", "v", 0.9).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: -1}
    km = {r.id: r.cluster for r in cluster.reduced_kmeans(v, "id", "v", 2, 2).collect()}
    assert len(set(km.values())) == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in cluster.components(chain).collect()} == {0}
    s = strata.stratified_folds(spark.range(20).withColumn("g", F.col("id") % 2), ["g"], 5, "id")
    assert {r["count"] for r in s.groupBy("g", "fold").count().collect()} == {2}
    assert strata.stratified_sample(spark.range(100).withColumn("g", F.col("id") % 4), ["g"], 20, "id").count() == 20
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert relational.ancestors(edges).count() == 9


def test_streamed_windows(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id from range(120)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = windows.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", [F.count("*").alias("n")], late="0 seconds")
    q = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [60]  # the second hour is still open
    assert windows.sessions(df, "ts", "2 minutes", [F.count("*").alias("n")], []).first().n == 120
    assert windows.interval_join(df, df, "id", "ts", "ts", "1 minute").count() == 120


def test_limits_are_kept_and_reset_headers_waited_for(spark):
    now = [0.0]
    limiter = generate.Limiter(60, 100, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(120):
        limiter.take(1)
    assert 59 <= now[0] <= 62  # 60 at once, one a second then
    limiter.take(500)  # above the whole budget: as soon as it is full
    assert [generate.waited(h) for h in ("250ms", "6s", "later", "xs")] == [0.25, 6.0, 0.01, 0.01]
    assert generate.Transient("Rate limit", "250ms").wait == 0.25 and generate.Transient("x").wait is None
    df = spark.createDataFrame([(i, [("user", "a b")]) for i in range(40)], "row_id long, messages array<struct<role: string, content: string>>").coalesce(1)
    began = time.monotonic()
    got = generate.complete(df, generate.EchoGenerator, limits=(1200, None)).filter("status = 'ok'").count()
    assert got == 40 and generate.complete(df, generate.EchoGenerator, limits=generate.shared_limits(spark, "gpt-4")).count() == 40
    assert time.monotonic() - began < 60


def test_a_stored_result_belongs_to_its_input(spark, tmp_path):
    store = generate.RunStore(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, value string")
    assert {r.output for r in generate.generated(one, "value", "id", generate.EchoGenerator, "s", store=store, run_id="r").collect()} == {"a", "b"}
    two = spark.createDataFrame([(1, "c"), (2, "b")], "id long, value string")
    assert {r.id: r.output for r in generate.generated(two, "value", "id", generate.EchoGenerator, "s", store=store, run_id="r").collect()} == {1: "c", 2: "b"}
    assert {r.id: r.output for r in generate.generated(one, "value", "id", generate.EchoGenerator, "s", store=store, run_id="r").collect()} == {1: "a", 2: "b"}


def test_topics_are_checked_in_a_second_pass(spark):
    from threadloom.plans import topics

    df = spark.createDataFrame([(0, "cats", "meow"), (1, None, "x")], "cluster int, topic string, content string")
    assert {r.cluster: r.topic_check for r in topics.checked(df, generate.EchoGenerator).collect()} == {0: "Topic: cats\n\nmeow", 1: "Topic: \n\nx"}


def test_nested_divisions(spark):
    from threadloom.sources import exports

    html = '<div class="ltx_para a">one <div class="b">two</div> three</div><div class="x"><div class="ltx_para">four</div></div><div class="ltx_parade">no</div>'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    assert [r[0] for r in df.select(exports.numbered_divisions(F.col("html"))).collect()] == [{0: "one two three", 1: "four"}, None, {}]


def test_first_containing_for_short_and_empty_calls(spark):
    calls = spark.createDataFrame([(x,) for x in ("", "a", "ab", "abcd", "zz", None)], "call string")
    names = spark.createDataFrame([(0, "xabc"), (1, "abcde"), (2, ""), (3, None)], "at int, name string")
    got = {r.call: r.name for r in relational.first_containing(calls, names, "call", "name", "at", []).collect()}
    assert got == {"": "xabc", "a": "xabc", "ab": "xabc", "abcd": "abcde"}


def _vectors(spark):
    """Vectors of two lengths, with nulls, repeated keys and a chain of near ones, over three partitions."""
    chain = [(f"k{i:03}", [math.cos(i / 20), math.sin(i / 20), 0.0]) for i in range(150)]
    odd = [("k007", [0.3, 0.1, 0.2]), ("k007", [0.3, 0.1, 0.2]), ("w", [1.0, 2.0]), ("v", [2.0, 4.1]), ("n", None), ("m", [1.0, None, 2.0]), (None, [1.0, 0.0, 0.0]), ("e", [])]
    return chain + odd, spark.createDataFrame(chain + odd, "k string, v array<double>").repartition(3)


def test_kernel_of_tiles_is_that_of_all_pairs(spark):
    rows, df = _vectors(spark)
    have = [(k, v) for k, v in rows if k is not None]
    def dot(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return None
        return sum((a * b for a, b in zip(x, y, strict=True)), 0.0)

    want = sorted([(a, b, dot(x, y)) for a, x in have for b, y in have if a <= b], key=repr)
    for settings in ({}, {"block": 7, "group": 1500}):
        assert sorted([tuple(r) for r in search.kernel(df, "k", "v", **settings).collect()], key=repr) == want


def test_no_join_of_all_pairs_is_in_a_plan(spark):
    _, df = _vectors(spark)
    made = pairs.checkpointed(pairs.blocks(df, "k", "v", 7))
    for d in (search.kernel(df, "k", "v"), cluster.near_forest(made, 0.9)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_density_of_tiles_writes_a_forest(spark):
    _, df = _vectors(spark)
    for settings in ({}, {"block": 7, "group": 1500}):
        got = {(r.k, r.cluster) for r in cluster.density(df, "k", "v", 0.998, **settings).collect()}
        chain = {c for k, c in got if k and k[0] == "k"}
        assert chain == {0} and {c for k, c in got if k in ("v", "w")} == {1}
        assert {c for k, c in got if k in ("n", "m", "e", None)} == {-1}
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, v array<double>")
    assert sorted(r.cluster for r in cluster.density(odd, "id", "v", 0.4).collect()) == [-1, 0, 0, 0]
    same = spark.range(600).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    made = pairs.checkpointed(pairs.blocks(same, "id", "v", 50))
    assert cluster.near_forest(made, 0.4).count() < 600 * 16  # of 179 700 pairs


def test_ancestors_of_chains_diamonds_cycles_and_nulls(spark, rows):
    chain, diamond = [(i, i + 1) for i in range(13)], [(20, 21), (20, 22), (21, 23), (22, 23), (23, 24), (20, 24), (20, 21)]
    cycle, odd = [(30, 31), (31, 32), (32, 30), (33, 33), (34, 30)], [(None, 20), (40, None), (None, None)]
    edges = {*chain, *diamond, *cycle, *odd}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b is not None and b == c} - want:
        want |= more
    got = rows(relational.ancestors(spark.createDataFrame([*chain, *diamond, *cycle, *odd], "child long, parent long")))
    assert got == sorted(want, key=repr)


def test_ancestors_of_a_tree_are_made_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(relational, "checkpointed", lambda df: (kept := pairs.checkpointed(df), written.append(kept.count()))[0])
    heap = spark.range(2, 2000).select(F.col("id").alias("child"), F.expr("id div 2").alias("parent"))
    n = relational.ancestors(heap).count()
    assert sum(written) < 1.5 * n
