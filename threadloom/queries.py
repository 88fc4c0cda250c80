"""The engine's operators as queries over whole tables, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import messages, text, validate, vectors
from threadloom.operators import cluster, generate, relational, search, strata, thread
from threadloom.plans import topics
from threadloom.plans.topics import topic_features
from threadloom.sources import exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BUDGET, HISTORY, QUERY_VECTOR = 300, 200, 0

_TOKENS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_T = f"with t as (select cast(conv_id as varchar) as conversation_id, row_number() over (partition by conv_id order by turn) - 1 as seq, role, text as content, {_TOKENS.format('text')} + 7 as tokens_count from conversations)"
_ROW = "conversation_id, seq, role, content, tokens_count"
_ANCHOR = "(select min(text) from conversations where role = 'user')"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> thread.Thread:
    """The conversations table as a thread a conversation."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"))
    return thread.Thread(thread.from_messages(rows, ["turn"], clock=F.lit(0.0)))


def _row(df: DataFrame) -> DataFrame:
    return df.select(*_ROW.split(", "))


def _anchor(spark: SparkSession, sf_dir: str) -> dict:
    return {"role": "user", "content": table(spark, sf_dir, "conversations").filter("role = 'user'").agg(F.min("text")).first()[0]}


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_VECTOR).first()["embedding"])


# --- threads ---------------------------------------------------------------------------------


@query(f"{_T} select {_ROW} from t where content = (select min(content) from t)")
def find_content(spark, sf):
    t = conversations(spark, sf)
    return _row(t.find_message(table(spark, sf, "conversations").agg(F.min("text")).first()[0]))


@query(f"{_T} select {_ROW} from t where role = 'user' and content = {_ANCHOR}")
def find_message(spark, sf):
    return _row(conversations(spark, sf).find_message(_anchor(spark, sf)))


@query(f"{_T} select {_ROW} from t where role = 'system'")
def find_role(spark, sf):
    return _row(conversations(spark, sf).find_role("system"))


@query(f"{_T} select {_ROW} from t where seq = 2")
def filter_col(spark, sf):
    return _row(conversations(spark, sf).filter_col("seq", 2))


@query(f"{_T} select {_ROW} from t where tokens_count > 60 and role = 'assistant'")
def more_tokens(spark, sf):
    return _row(conversations(spark, sf).messages_more_tokens(60, "assistant"))


@query(f"{_T} select {_ROW} from t where tokens_count < 40")
def less_tokens(spark, sf):
    return _row(conversations(spark, sf).messages_less_tokens(40))


_EVENT = "select event_id, user_id, event_type, value from events where ts {} timestamp '2024-01-15 00:00:00' and event_type = 'click'"


def _events(spark, sf):
    t = table(spark, sf, "events").select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"), F.col("event_type").alias("role"), "event_id", "user_id", "value")
    return thread.Thread(t.withColumn("create_time", F.col("at") / 1e6), by=("user_id",))


@query(_EVENT.format(">"))
def after_time(spark, sf):
    return _events(spark, sf).messages_after_time(1705276800.0, "click").select("event_id", "user_id", F.col("role").alias("event_type"), "value")


@query(_EVENT.format("<"))
def before_time(spark, sf):
    return _events(spark, sf).messages_before_time(1705276800.0, "click").select("event_id", "user_id", F.col("role").alias("event_type"), "value")


@query(f"{_T} select conversation_id, row_number() over (partition by conversation_id order by seq) - 1 as seq, role, content, tokens_count from t where seq <> 1")
def remove_idx(spark, sf):
    return _row(conversations(spark, sf).remove(idx=1).df)


@query(f"{_T} select conversation_id, row_number() over (partition by conversation_id order by seq) - 1 as seq, role, content, tokens_count from t where content <> {_ANCHOR}")
def remove_content(spark, sf):
    return _row(conversations(spark, sf).remove(message=_anchor(spark, sf)).df)


@query(f"{_T}, n as (select *, count(*) over (partition by conversation_id) as n from t) select {_ROW} from n where seq = n - 1")
def item_from_end(spark, sf):
    return _row(conversations(spark, sf)[-1])


@query(f"{_T} select {_ROW} from t where seq >= 1 and seq < 3")
def item_slice(spark, sf):
    return _row(conversations(spark, sf)[1:3])


@query(f"{_T} select cast(coalesce(sum(tokens_count), 0) as bigint) as total_tokens from t")
def total_tokens(spark, sf):
    return conversations(spark, sf).total_tokens()


@query(f"{_T} select conversation_id, string_agg(content, ' ' order by seq) as content, count(*) as messages from t group by 1")
def concat_conversation(spark, sf):
    return thread.conversations(conversations(spark, sf).df).select("conversation_id", "content", F.size("contents").cast("long").alias("messages"))


@query(f"{_T} select {_ROW} from t qualify seq = min(seq) over (partition by conversation_id)")
def first_message(spark, sf):
    return _row(conversations(spark, sf).first_message())


@query(f"{_T} select {_ROW} from t where role = 'assistant' qualify seq = max(seq) over (partition by conversation_id)")
def last_message(spark, sf):
    return _row(conversations(spark, sf).last_message("assistant"))


_BOUND = f"{_T}, a as (select *, min(case when role = 'user' and content = {_ANCHOR} then seq end) over (partition by conversation_id) as a from t)"


@query(f"{_BOUND} select {_ROW} from a where seq < a")
def messages_before(spark, sf):
    return _row(conversations(spark, sf).messages_before(_anchor(spark, sf)))


@query(f"{_BOUND} select {_ROW} from a where seq > a")
def messages_after(spark, sf):
    return _row(conversations(spark, sf).messages_after(_anchor(spark, sf)))


@query(f"{_BOUND}, b as (select *, min(case when content = (select max(text) from conversations where conv_id in (select conv_id from conversations where text = {_ANCHOR})) then seq end) over (partition by conversation_id) as b from a) select {_ROW} from b where seq > a and seq < b")
def messages_between(spark, sf):
    anchor = _anchor(spark, sf)
    raw = table(spark, sf, "conversations")
    where = raw.filter(F.col("text") == anchor["content"]).select("conv_id").distinct()
    end = raw.join(where, "conv_id", "left_semi").agg(F.max("text")).first()[0]
    return _row(conversations(spark, sf).messages_between(anchor, end))


@query(f"{_T} select conversation_id, seq, lag(md5(conversation_id || '|' || seq)) over (partition by conversation_id order by seq) as parent from t")
def parent_pointer(spark, sf):
    df = conversations(spark, sf).df.withColumn("message_id", F.md5(F.concat_ws("|", "conversation_id", "seq")))
    return thread.with_parents(df).select("conversation_id", "seq", F.col("parent_id").alias("parent"))


@query(f"{_T}, p as (select *, case when role = 'system' then null when role = 'user' then 'u' else role end as parent_id from t), q as (select *, lag(parent_id) over (partition by conversation_id order by seq) as before from p) select {_ROW} from q where parent_id is null or parent_id is distinct from before")
def thin_tree(spark, sf):
    df = conversations(spark, sf).df.withColumn("parent_id", F.when(F.col("role") == "system", None).when(F.col("role") == "user", "u").otherwise(F.col("role")))
    return _row(thread.thinned(df))


_SUFFIX = f"{_T}, s as (select *, sum(tokens_count) over (partition by conversation_id order by seq desc rows between unbounded preceding and current row) as total from t)"


@query(f"{_SUFFIX} select conversation_id, content, seq as index, cast(total as bigint) as tokens_so_far from s where total <= {HISTORY} and role <> 'system'")
def token_bound_history(spark, sf):
    return conversations(spark, sf).token_bound_history(HISTORY, "system")


@query(f"{_SUFFIX} select {_ROW}, total > {BUDGET} as longterm from s")
def fifo_split(spark, sf):
    return thread.fifo(conversations(spark, sf).df, BUDGET).select(*_ROW.split(", "), "longterm")


@query(
    f"with recursive {_T[5:]}, kept as (select conversation_id, seq, tokens_count, case when tokens_count <= {BUDGET} then tokens_count else 0 end as total, tokens_count <= {BUDGET} as ok from t where seq = 0 "
    f"union all select t.conversation_id, t.seq, t.tokens_count, case when k.total + t.tokens_count <= {BUDGET} then k.total + t.tokens_count else k.total end, k.total + t.tokens_count <= {BUDGET} from kept k join t on t.conversation_id = k.conversation_id and t.seq = k.seq + 1) "
    "select t.conversation_id, t.seq, t.role, t.content, t.tokens_count from t join kept k on k.conversation_id = t.conversation_id and k.seq = t.seq where k.ok"
)
def budgeted_append(spark, sf):
    return _row(thread.admitted(conversations(spark, sf).df, BUDGET))


@query(f"{_T} select {_ROW} from t union all select {_ROW} from t where role = 'system'")
def union_append(spark, sf):
    df = conversations(spark, sf).df
    return _row(df.unionByName(df.filter("role = 'system'")))


# --- text, messages, requests ----------------------------------------------------------------


@query(f"select conv_id, turn, cast({_TOKENS.format('text')} as bigint) as words from conversations")
def word_count(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.word_count(F.col("text")).cast("long").alias("words"))


@query("select event_id, round(epoch_us(ts) / 1000000.0, 6) as epoch from events")
def epoch_seconds(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(text.epoch_seconds(F.col("ts")), 6).alias("epoch"))


@query("select doc_id from documents where contains(text, 'tion') or contains(text, 'ung ')")
def entity_filter(spark, sf):
    return table(spark, sf, "documents").filter(text.any_of(F.col("text"), ["tion", "ung "])).select("doc_id")


@query("select doc_id, source from documents where regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def regex_filter(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").rlike("[0-9]{3}-[0-9]{4}")).select("doc_id", "source")


@query("select doc_id, lang, n_chars from documents where lang = 'en' and n_chars > 500")
def sql_prefilter(spark, sf):
    return search.where(table(spark, sf, "documents"), "SELECT * WHERE lang = 'en' AND n_chars > 500").select("doc_id", "lang", "n_chars")


@query("select p_partkey, p_brand || ' - ' || p_name as value, p_name || ' - Summary: ' || p_type as summary from part")
def merged_value(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.title_and_text(F.col("p_brand"), F.col("p_name")).alias("value"), text.with_summary(F.col("p_name"), F.col("p_type")).alias("summary"))


@query("select doc_id, x as line from (select doc_id, unnest(string_split(text, chr(10))) as x from documents) where x <> ''")
def split_lines(spark, sf):
    return text.exploded_lines(table(spark, sf, "documents"), "text").select("doc_id", "line")


@query("select conv_id, turn, 'system' as first_role, 'Be brief.' as first_content, 'user' as second_role, text as second_content from conversations")
def messages_column(spark, sf):
    m = messages.request_messages(F.col("text"), "Be brief.")
    pick = [F.get(m, F.lit(i))[f].alias(f"{n}_{f}") for i, n in enumerate(("first", "second")) for f in ("role", "content")]
    return table(spark, sf, "conversations").select("conv_id", "turn", *pick)


@query("select cast(conv_id as varchar) as conversation_id, string_agg(' #' || upper(role) || ': ' || text, '' order by turn) as prompt from conversations group by 1")
def prompt_string(spark, sf):
    return conversations(spark, sf).history_messages().select("conversation_id", messages.prompt_string(F.col("messages")).alias("prompt"))


@query("select cast(conv_id as varchar) as conversation_id, ' #SYSTEM: S' || string_agg(' #' || case when role = 'system' then 'SYSTEM' else 'USER' end || ': ' || text, '' order by turn) || ' #USER: Q: next?' as prompt from conversations group by 1")
def composed_prompt(spark, sf):
    whole = messages.composed(F.col("messages"), F.lit("next?"), "S", "Q: {question}")
    return conversations(spark, sf).history_messages().select("conversation_id", messages.prompt_string(whole).alias("prompt"))


_ESTIMATE = f"select conv_id, turn, cast(14 + {_TOKENS.format('text')} + 1000 as bigint) as total_tokens from conversations"


def _requests(spark, sf):
    asked = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "gpt-4").when(F.col("role") == "assistant", "gpt-3.5-turbo").otherwise("other").alias("model"), messages.request_messages(F.col("text"), "Be brief.").alias("messages"))
    made = generate.requests(asked)
    return made.withColumn("total_tokens", generate.estimated_tokens(F.col("messages"), F.col("input"), F.col("max_tokens")).cast("long"))


@query(_ESTIMATE)
def request_estimate(spark, sf):
    return _requests(spark, sf).select("conv_id", "turn", "total_tokens")


@query(f"select e.conv_id, e.turn, case c.role when 'user' then 'gpt-4' when 'assistant' then 'gpt-3.5-turbo' else 'other' end as model, round(e.total_tokens / 1000.0 * case c.role when 'user' then 0.03 when 'assistant' then 0.0015 end, 9) as estimated_cost from ({_ESTIMATE}) e join conversations c using (conv_id, turn)")
def request_cost(spark, sf):
    return generate.priced(_requests(spark, sf)).select("conv_id", "turn", "model", F.round("estimated_cost", 9).alias("estimated_cost"))


_SAID = "case event_type when 'error' then 'Rate limit reached' when 'view' then 'model currently overloaded' when 'click' then 'bad request' end"


def _responses(spark, sf):
    said = F.when(F.col("event_type") == "error", "Rate limit reached").when(F.col("event_type") == "view", "model currently overloaded").when(F.col("event_type") == "click", "bad request")
    return table(spark, sf, "events").select("event_id", generate.error_class(said).alias("error"))


@query(f"select event_id, case when x like '%Rate limit%' then 'rate_limit' when x like '%currently overloaded%' then 'overloaded' when x is not null then 'api' end as error from (select event_id, {_SAID} as x from events)")
def error_class(spark, sf):
    return _responses(spark, sf)


@query("select count(*) as started, count(*) filter (event_type not in ('error', 'view', 'click')) as succeeded, count(*) filter (event_type = 'error') as rate_limit_errors, count(*) filter (event_type = 'view') as overloaded_errors, count(*) filter (event_type = 'click') as api_errors, cast(0 as bigint) as other_errors from events")
def status_counts(spark, sf):
    return generate.status_counts(_responses(spark, sf).select(F.coalesce("error", F.lit("ok")).alias("status")))


@query("select page_id, len(x) as paragraphs, array_to_string(list_transform(x, lambda p: regexp_replace(p, '(?s)<[^>]*>', '', 'g')), ' ') as body from (select page_id, regexp_extract_all(html, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1) as x from pages)")
def html_paragraphs(spark, sf):
    p = exports.paragraphs(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(p).cast("long").alias("paragraphs"), F.array_join(p, " ").alias("body"))


@query("select page_id, regexp_extract(url, '(\\.[^./]+)$', 1) as extension from pages")
def file_extension(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.file_extension(F.col("url")).alias("extension"))


# --- vectors ---------------------------------------------------------------------------------

_DOT = f"list_dot_product(list_transform(embedding, lambda x: cast(x as double)), (select list_transform(embedding, lambda x: cast(x as double)) from embeddings where vec_id = {QUERY_VECTOR}))"


def _found(df):
    return df.select("vec_id", "label", F.round("dot_product", 6).alias("dot_product"))


@query(f"select vec_id, label, round({_DOT}, 6) as dot_product from embeddings order by {_DOT} desc, vec_id limit 10")
def topk_dot(spark, sf):
    return _found(search.top_k(table(spark, sf, "embeddings"), _vector(spark, sf), "", 10, "vec_id", "embedding"))


@query(f"select vec_id, label, round({_DOT}, 6) as dot_product from embeddings where label < 5 order by {_DOT} desc, vec_id limit 5")
def topk_dot_sql(spark, sf):
    return _found(search.top_k_where(table(spark, sf, "embeddings"), "SELECT * WHERE label < 5", _vector(spark, sf), "", 5, "vec_id", "embedding"))


@query("with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings) select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.v, b.v), 6) as dot_product from v a join v b on a.vec_id <= b.vec_id")
def kernel_matrix(spark, sf):
    return search.kernel(table(spark, sf, "embeddings"), "vec_id", "embedding").select("a", "b", F.round("dot_product", 6).alias("dot_product"))


def _elements(df, values):
    return df.select("vec_id", F.posexplode(values).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def _each(expr: str) -> str:
    return f"select vec_id, cast(i - 1 as bigint) as i, round(cast({expr} as double), 6) as x from (select vec_id, cast(unnest(embedding) as double) as e, generate_subscripts(embedding, 1) as i from embeddings)"


@query(_each("1 / (1 + exp(-e))"))
def sigmoid(spark, sf):
    return _elements(table(spark, sf, "embeddings"), vectors.sigmoid(F.col("embedding").cast("array<double>")))


@query(_each("case when e > 0.1 then 1 else 0 end"))
def threshold(spark, sf):
    return _elements(table(spark, sf, "embeddings"), vectors.threshold(F.col("embedding").cast("array<double>"), 0.1))


@query(_each("e * 2"))
def scaled(spark, sf):
    return _elements(table(spark, sf, "embeddings"), vectors.scaled(F.col("embedding").cast("array<double>"), 2.0))


@query(
    "with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from v), near as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.4), "
    "reach as (select vec_id as a, vec_id as b from v union select r.a, n.b from reach r join near n on r.b = n.a), roots as (select a as vec_id, min(b) as root, count(*) as n from reach group by 1), numbers as (select root, row_number() over (order by root) - 1 as cluster from (select distinct root from roots where n > 1)) "
    "select vec_id, cast(coalesce(cluster, -1) as integer) as cluster from roots left join numbers using (root)"
)
def cluster_embeddings(spark, sf):
    """Connected components of the pairs with cosine of 0.4 and more; -1 for those on their own."""
    return cluster.density(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4, 2)


@query("select e.vec_id, e.label, o.size from embeddings e left join (select vec_id, len(embedding) as size from embeddings where label < 5) o on e.vec_id = o.vec_id")
def positional_join(spark, sf):
    e = table(spark, sf, "embeddings")
    size = e.filter("label < 5").select("vec_id", F.size("embedding").cast("long").alias("size"))
    return relational.attached(e.select("vec_id", "label"), size, "vec_id")


# --- joins, aggregates, windows, sets --------------------------------------------------------


@query("select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as quantity, count(*) as lines from lineitem group by 1, 2")
def group_sum(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))


@query(f"{_T} select conversation_id, arg_min(role, seq) as role, arg_min(content, seq) as content, min(seq) as seq from t group by 1")
def first_per_group(spark, sf):
    return conversations(spark, sf).df.groupBy("conversation_id").agg(F.min_by("role", "seq").alias("role"), F.min_by("content", "seq").alias("content"), F.min("seq").alias("seq"))


@query("select count(distinct source) as sources, count(distinct lang) as langs, count(distinct text) as texts from documents")
def n_unique(spark, sf):
    return table(spark, sf, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct("text").alias("texts"))


@query("select count(n_chars) as count, count(*) filter (n_chars is null) as null_count, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 6) as std, min(n_chars) as min, max(n_chars) as max, quantile_cont(n_chars, 0.5) as median from documents")
def describe(spark, sf):
    d = relational.described(table(spark, sf, "documents"), "n_chars")
    return d.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("select cast(sum(l_quantity) as double) as l_quantity from lineitem")
def prefix_sums(spark, sf):
    return relational.prefix_sums(table(spark, sf, "lineitem"), "l_quantity")


@query("select label, '[' || string_agg(vec_id, ',' order by vec_id) || ']' as members from embeddings group by 1")
def groups_as_json(spark, sf):
    return relational.groups_as_json(table(spark, sf, "embeddings"), "label", "vec_id", "vec_id")


@query("select count(*) filter (quality = toxic) as same, count(*) as total from labels")
def agreement(spark, sf):
    return relational.agreement(table(spark, sf, "labels"), F.col("quality"), F.col("toxic"))


@query("select distinct event_type from events")
def distinct_labels(spark, sf):
    return table(spark, sf, "events").select("event_type").distinct()


@query("select p_partkey, word, n_name, n_nationkey from (select p_partkey, upper(substr(word, 1, 2)) as word, n.n_name, n.n_nationkey, row_number() over (partition by p_partkey, upper(substr(word, 1, 2)) order by n.n_nationkey) as r from (select distinct p_partkey, unnest(string_split(p_name, ' ')) as word from part) p join nation n on contains(n.n_name, upper(substr(word, 1, 2)))) where r = 1")
def theta_first_match(spark, sf):
    calls = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).select("p_partkey", F.upper(F.substring("w", 1, 2)).alias("word")).distinct()
    return relational.first_containing(calls, table(spark, sf, "nation"), "word", "n_name", "n_nationkey", ["p_partkey"])


@query("select e.vec_id, d.doc_id, d.source from embeddings e join documents d on e.vec_id = d.doc_id")
def inner_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("key"), "source")
    return relational.inner_renamed(table(spark, sf, "embeddings").select("vec_id"), docs, "vec_id", "key")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("select n_name, r_name from nation full join region on n_nationkey = r_regionkey + 3")
def full_join(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_nationkey") == F.col("r_regionkey") + 3, "full").select("n_name", "r_name")


@query("select e.event_id, (select arg_max(b.value, b.ts) from events b where b.event_type = 'purchase' and b.user_id = e.user_id and b.ts <= e.ts) as last_value from events e where e.event_type = 'click'")
def asof_join(spark, sf):
    e = table(spark, sf, "events")
    clicks, buys = e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return relational.as_of(clicks, buys, ["user_id"], "ts", "ts", "value", "last_value").select("event_id", "last_value")


@query("select l_returnflag, l_linestatus, count(*) as lines from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"))


@query("select l_returnflag, l_linestatus, count(*) as lines from lineitem group by cube (l_returnflag, l_linestatus)")
def cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"))


@query("select n_nationkey as key from nation intersect select s_nationkey from supplier")
def intersect(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("key")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("select c_nationkey as key from customer except select s_nationkey from supplier where s_acctbal > 5000")
def except_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("key")).subtract(table(spark, sf, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("select o_orderkey, rank() over w as rank, dense_rank() over w as dense_rank, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as number, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_key from orders window w as (partition by o_custkey order by o_orderdate)")
def ranking(spark, sf):
    w, u = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    long = lambda c: c.cast("long")
    return table(spark, sf, "orders").select("o_orderkey", long(F.rank().over(w)).alias("rank"), long(F.dense_rank().over(w)).alias("dense_rank"), long(F.row_number().over(u)).alias("number"), F.lead("o_orderkey").over(u).alias("next_key"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events, round(sum(value), 4) as value from events group by 1")
def tumbling_window(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, sf, "events").groupBy(w).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "value")


@query("with e as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from e) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events from s group by user_id, n")
def session_window(spark, sf):
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    return table(spark, sf, "events").groupBy("user_id", w).agg(F.count("*").alias("events")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


# --- strata, validators, topics --------------------------------------------------------------


@query("select doc_id, cast(dense_rank() over (order by source nulls last) as bigint) as stratum from documents")
def strata_categorical(spark, sf):
    return strata.categorical(table(spark, sf, "documents"), "source", "stratum").select("doc_id", F.col("stratum").cast("long").alias("stratum"))


@query("select p_partkey, cast(least(greatest(floor((p_retailprice - 900) / 110) + 1, 0), 11) as bigint) as stratum from part")
def strata_real(spark, sf):
    return strata.real(table(spark, sf, "part"), "p_retailprice", 900.0, 2000.0, 10, "stratum").select("p_partkey", F.col("stratum").cast("long").alias("stratum"))


@query("select doc_id, cast(dense_rank() over (order by lang nulls last, source nulls last) as bigint) as stratum from documents")
def joint_strata(spark, sf):
    return strata.joint(table(spark, sf, "documents"), ["lang", "source"], "stratum").select("doc_id", F.col("stratum").cast("long").alias("stratum"))


_SAMPLED = "select doc_id, lang, source, row_number() over (partition by lang order by md5('0|' || doc_id), doc_id) as place, count(*) over (partition by lang) as size, count(*) over () as total from documents"


@query(f"select doc_id, lang, source from ({_SAMPLED}) where place <= ceil(size * 100 / total)")
def stratified_sample(spark, sf):
    return strata.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang"], 100, "doc_id")


@query(f"select doc_id, lang, cast((place - 1) % 5 as integer) as fold from ({_SAMPLED})")
def stratified_folds(spark, sf):
    return strata.stratified_folds(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], 5, "doc_id")


@query("select doc_id, quality in (0, 1) as ok from labels")
def validate_discrete(spark, sf):
    return table(spark, sf, "labels").select("doc_id", validate.discrete(F.col("quality"), [0, 1]).alias("ok"))


@query("select p_partkey, p_size between 10 and 40 as ok from part")
def validate_real(spark, sf):
    return table(spark, sf, "part").select("p_partkey", validate.real(F.col("p_size"), 10, 40).alias("ok"))


@query(f"select doc_id, {_TOKENS.format('text')} <= 8000 as ok from documents")
def validate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", validate.text(F.col("text")).alias("ok"))


@query(f"{_T}, c as (select conversation_id, string_agg(content, ' ' order by seq) as content, cast(conversation_id as bigint) % 7 as cluster from t group by 1), g as (select cluster, string_agg(content, ' ' order by conversation_id) as joined from c group by 1) select t.conversation_id, t.seq, c.cluster, length(g.joined) as topic_length from t join c using (conversation_id) join g using (cluster)")
def topic_join(spark, sf):
    """Messages with their conversation's cluster and the length of all its cluster's text."""
    df = conversations(spark, sf).df
    clusters = df.select("conversation_id").distinct().withColumn("cluster", F.col("conversation_id").cast("long") % 7)
    return topic_features(df, clusters, lambda grouped: grouped.withColumn("topic_length", F.length("content"))).select("conversation_id", "seq", "cluster", F.col("topic_length").cast("long").alias("topic_length"))


# --- topics ---------------------------------------------------------------------------------


@query()
def topic_pipeline(spark, sf):
    """(conversation_id, seq, cluster, topic) with the offline providers."""
    t = topics.run(conversations(spark, sf).df, lambda: generate.LeadingWords(5), generate.HashingEmbedder)
    return t.select("conversation_id", "seq", "cluster", "topic")
