import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.operators import thread
from threadloom.streaming.admission import admitted_stream

SAID = [("user", "a b"), ("assistant", "c"), ("user", "a b"), ("system", "s s s"), ("assistant", "a b"), ("user", "z"), ("assistant", "c"), ("user", None)]


@pytest.fixture
def talk(spark):
    df = spark.createDataFrame([("t", i, r, c) for i, (r, c) in enumerate(SAID)], "conversation_id string, turn int, role string, content string")
    return thread.Thread(thread.from_messages(df, ["turn"], clock=F.lit(1.0)))


def seqs(df, name="seq"):
    return sorted(r[name] for r in df.collect())


def test_tokens_and_parents(talk):
    rows = talk.df.orderBy("seq").collect()
    assert [r.tokens_count for r in rows] == [9, 8, 9, 10, 9, 8, 8, 7]
    assert rows[0].parent_id is None
    assert rows[3].parent_id == rows[2].message_id


def test_predicates(talk):
    assert seqs(talk.find_message("a b")) == [0, 2, 4]
    assert seqs(talk.find_message({"role": "user", "content": "a b"})) == [0, 2]
    assert seqs(talk.messages_more_tokens(9)) == [3]
    assert seqs(talk.messages_less_tokens(9, "user")) == [5, 7]
    assert seqs(talk.filter_col("role", "system")) == [3]


def test_positions(talk):
    assert seqs(talk[-1]) == [7]
    assert seqs(talk[2:4]) == [2, 3]
    assert seqs(talk.first_message("assistant")) == [1]
    assert seqs(talk.last_message("assistant")) == [6]
    assert talk.last_message("nobody").count() == 0
    assert len(talk) == 8


def test_anchors_are_the_first_match(talk):
    assert seqs(talk.messages_before({"role": "assistant", "content": "a b"})) == [0, 1, 2, 3]
    assert seqs(talk.messages_after({"role": "user", "content": "z"})) == [6, 7]
    assert seqs(talk.messages_between({"role": "assistant", "content": "c"}, {"role": "user", "content": "z"})) == [2, 3, 4]
    assert talk.messages_before("not there").count() == 0


def test_history_counts_all_roles(talk):
    got = talk.token_bound_history(33, "user")
    assert sorted((r["index"], r.tokens_so_far) for r in got.collect()) == [(4, 32), (6, 15)]


def test_removal_renumbers(talk):
    assert seqs(talk.remove(idx=0).df) == list(range(7))
    assert talk.remove(message={"role": "user", "content": "a b"}).df.count() == 4  # all of the content, and nulls
    with pytest.raises(ValueError):
        talk.remove()


def test_admission_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("t", 0, 6), ("t", 1, 5), ("t", 2, 4), ("u", 0, None)], "conversation_id string, seq long, tokens_count int")
    assert sorted((r[0], r[1]) for r in thread.admitted(df, 10).collect()) == [("t", 0), ("t", 2), ("u", 0)]
    assert thread.admitted(df, None).count() == 4


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20), min_size=1, max_size=12), st.integers(0, 40))
def test_admission_is_the_greedy_fold(spark, counts, budget):
    df = spark.createDataFrame([("t", i, c) for i, c in enumerate(counts)], "conversation_id string, seq long, tokens_count int")
    total, want = 0, []
    for i, c in enumerate(counts):
        if total + c <= budget:
            total += c
            want.append(i)
    assert seqs(thread.admitted(df, budget)) == want


def test_streamed_admission_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i % 3}", i // 3, 5 + i % 4) for i in range(30)], "conversation_id string, seq long, tokens_count int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = admitted_stream(stream, 30).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = sorted((r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r[0], r[1]) for r in thread.admitted(df, 30).collect())


def test_add_and_round_trip(talk, spark, tmp_path):
    new = spark.createDataFrame([("t", 0, "user", "more")], "conversation_id string, seq long, role string, content string")
    longer = talk.add(new)
    assert seqs(longer.df) == list(range(9))
    longer.save(str(tmp_path / "t"))
    again = thread.Thread.load(spark, str(tmp_path / "t"))
    timeless = lambda t: sorted(map(repr, t.df.drop("upload_time").collect()))  # noqa: E731 (the clock runs on)
    assert timeless(again) == timeless(longer)
    assert again.df.select("message_id").distinct().count() == 9
    assert again.df.filter("seq = 8").first().parent_id == again.df.filter("seq = 7").first().message_id
    assert len(talk.reset_memory()) == 0


def test_fifo_keeps_the_newest(talk):
    assert seqs(thread.fifo(talk.df, 16).filter("not longterm")) == [6, 7]
