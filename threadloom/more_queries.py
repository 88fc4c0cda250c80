"""Queries of the operators that `queries` leaves out: validators, message helpers, results, strata, further joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import messages, text, validate, vectors
from threadloom.operators import generate, relational, strata, thread
from threadloom.plans.chat import PerspectivePrompts
from threadloom.plans.frame import Frame, Roles
from threadloom.queries import _ESTIMATE, _ROW, _T, _TOKENS, _requests, conversations, query, table
from threadloom.sources import exports

# --- validators ------------------------------------------------------------------------------


@query(f"select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: {_TOKENS.format('x')} > 100)) = 0 as ok from documents")
def validate_text_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id", validate.text_list(F.split("text", "\n"), 100).alias("ok"))


@query("select doc_id, lang in ('en', 'fr') as ok from documents")
def validate_discrete_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", validate.discrete(F.col("lang"), ["en", "fr"]).alias("ok"))


@query("select doc_id, coalesce(quality = 0, false) and coalesce(toxic = 0, false) as ok from labels")
def validate_discrete_list(spark, sf):
    item = lambda c: F.struct(F.array(F.col(c).cast("int")).alias("alphabet"))
    return table(spark, sf, "labels").select("doc_id", validate.discrete_list(F.array(item("quality"), item("toxic")), [0]).alias("ok"))


@query("select p_partkey, len(string_split(p_type, ' ')) >= 2 as ok from part")
def validate_n_discrete(spark, sf):
    return table(spark, sf, "part").select("p_partkey", validate.n_discrete(F.split("p_type", " ")).alias("ok"))


@query("select p_partkey, p_size > 25 as same_kinds, p_size > 25 and p_size % 3 in (0, 1) as joint from part")
def validate_n_discrete_list(spark, sf):
    dim = lambda kind: F.struct(kind.alias("kind"), F.array(F.lit(0), F.lit(1)).alias("alphabet"))
    one, two = F.array(dim(F.lit("int")), dim(F.lit("int"))), F.array(dim(F.lit("int")), dim(F.when(F.col("p_size") > 25, "int").otherwise("str")))
    joint = F.array(F.array(F.lit(1), (F.col("p_size") % 3).cast("int")))
    return table(spark, sf, "part").select("p_partkey", validate.n_discrete_list(F.array(one, two)).alias("same_kinds"), validate.n_discrete_list(F.array(one, two), joint).alias("joint"))


@query("select vec_id, list_min(embedding) >= -0.3 and list_max(embedding) <= 0.3 as ok from embeddings")
def validate_real_list(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", validate.real_list(F.col("embedding").cast("array<double>"), -0.3, 0.3).alias("ok"))


@query("select vec_id, cast(embedding[1] as double) between -0.1 and 0.2 and cast(embedding[2] as double) between -0.2 and 0.1 as by_dimension, list_min(embedding[1:2]) >= -0.1 and list_max(embedding[1:2]) <= 0.1 as shared from embeddings")
def validate_n_real(spark, sf):
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 2)
    return table(spark, sf, "embeddings").select("vec_id", validate.n_real(v, [(-0.1, 0.2), (-0.2, 0.1)]).alias("by_dimension"), validate.n_real(v, (-0.1, 0.1)).alias("shared"))


@query("select vec_id, label < 5 and cast(embedding[1] as double) >= -0.1 and cast(embedding[3] as double) >= -0.1 and cast(embedding[2] as double) <= 0.1 and cast(embedding[4] as double) <= 0.1 as ok from embeddings")
def validate_n_real_list(spark, sf):
    v = F.col("embedding").cast("array<double>")
    rows = F.array(F.slice(v, 1, 2), F.slice(v, F.lit(3), F.when(F.col("label") < 5, 2).otherwise(3)))
    return table(spark, sf, "embeddings").select("vec_id", validate.n_real_list(rows, [(-0.1, 9.0), (-9.0, 0.1)]).alias("ok"))


@query(f"select doc_id, coalesce({_TOKENS.format('text')} <= 100, false) as text_valid, 'corpus' as source, 'docs' as data_name, 'elements' as elements_name, true as identified from documents")
def validate_frame(spark, sf):
    """A column marked by a validator, with the header of a typed value."""
    df = Frame(table(spark, sf, "documents").select("doc_id", "text"), Roles(embeddable_columns=("text",))).apply_validator_to_column("text", lambda c: validate.text(c, 100), fail=False).df
    df = validate.header(df, source="corpus", name="docs")
    return df.select("doc_id", "text_valid", "source", "data_name", "elements_name", (F.col("id").isNotNull() & F.col("timestamp").isNotNull()).alias("identified"))


# --- messages, requests, results -------------------------------------------------------------


@query(f"select doc_id, {_TOKENS.format('text')} as tokens, cast({_TOKENS.format('text')} as bigint) as listed from documents")
def tokenized_column(spark, sf):
    df = Frame(table(spark, sf, "documents")).tokenize_column("text").df
    return df.select("doc_id", F.col("`tokens_len|text`").cast("long").alias("tokens"), F.when(F.col("text").isNotNull(), F.size("`tokens|text`")).cast("long").alias("listed"))


@query("select text as input, 'text-embedding-ada-002' as model from documents")
def embedding_requests(spark, sf):
    return Frame(table(spark, sf, "documents")).prepare_column_for_embeddings("text")


@query("select conv_id, turn, role || ': ' || text as said, role in ('system', 'user', 'assistant') as known from conversations")
def role_messages(spark, sf):
    """Messages by the wrapper of their role, checked as single messages."""
    made = F.when(F.col("role") == "system", messages.system(F.col("text"))).when(F.col("role") == "user", messages.question(F.col("text"))).otherwise(messages.answer(F.col("text")))
    df = table(spark, sf, "conversations").withColumn("made", F.array(made))
    one = messages.checked_message(df, "made")
    return df.select("conv_id", "turn", F.concat(one["role"], F.lit(": "), one["content"]).alias("said"), F.lit(messages.is_message(df.schema["made"].dataType)).alias("known"))


_CHAT = "named_struct('choices', array(named_struct('message', named_struct('role', role, 'content', text))), 'text', concat('#ASSISTANT', text), 'usage', named_struct('prompt_tokens', turn, 'completion_tokens', 3, 'total_tokens', turn + 3))"


@query("select conv_id, turn, case role when 'user' then text when 'assistant' then replace(text, '#ASSISTANT', '') end as reply from conversations")
def reply_extraction(spark, sf):
    model = F.when(F.col("role") == "user", "gpt-4").when(F.col("role") == "assistant", "command-x").otherwise("other")
    return table(spark, sf, "conversations").select("conv_id", "turn", messages.reply_text(F.to_json(F.expr(_CHAT)), model).alias("reply"))


@query("select conv_id, turn, text as output, cast(turn as integer) as prompt_tokens, 3 as completion_tokens, cast(turn + 3 as integer) as total_tokens from conversations")
def chat_results(spark, sf):
    return generate.chat_rows(table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.expr(_CHAT)).alias("response")))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total, cast(len(embedding) as bigint) as size, 7 as prompt_tokens, 7 as total_tokens from embeddings")
def embedding_results(spark, sf):
    made = "to_json(named_struct('data', array(named_struct('embedding', cast(embedding as array<double>))), 'usage', named_struct('prompt_tokens', 7, 'total_tokens', 7)))"
    df = generate.embedding_rows(table(spark, sf, "embeddings").select("vec_id", F.expr(made).alias("response")))
    return df.select("vec_id", F.round(F.aggregate("output", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("output").cast("long").alias("size"), "prompt_tokens", "total_tokens")


@query("select event_id, case event_type when 'click' then event_id % 1000 / 1000.0 when 'view' then cast(event_id % 60 as double) else 0.01 end as seconds from events")
def reset_headers(spark, sf):
    k = F.col("event_id")
    header = F.when(F.col("event_type") == "click", F.concat(k % 1000, F.lit("ms"))).when(F.col("event_type") == "view", F.concat(k % 60, F.lit("s"))).otherwise("later")
    return table(spark, sf, "events").select("event_id", generate.reset_seconds(header).alias("seconds"))


@query(
    f"with p as (select case c.role when 'user' then 'gpt-4' when 'assistant' then 'gpt-3.5-turbo' else 'other' end as model, e.total_tokens, case c.role when 'user' then 0.03 when 'assistant' then 0.0015 end as price from ({_ESTIMATE}) e join conversations c using (conv_id, turn)) "
    "select model, count(*) as requests, cast(sum(total_tokens) as bigint) as total_tokens, round(sum(total_tokens / 1000.0 * price), 6) as estimated_cost from p group by grouping sets ((model), ())"
)
def batch_totals(spark, sf):
    """Requests, tokens and cost of a batch, by model and in all."""
    return generate.batch_totals(_requests(spark, sf)).withColumn("estimated_cost", F.round("estimated_cost", 6))


@query("select n_name as subject, r_name as perspective, n_name || ' in ' || r_name as prompt from nation join region on n_regionkey = r_regionkey")
def perspective_catalogue(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit("\\"), "r_name").alias("key"), F.concat("n_name", F.lit(" in "), "r_name").alias("prompt"))
    return PerspectivePrompts(rows).df.select("subject", "perspective", "prompt")


@query("select n_name as subject, r_name as perspective, t || n_name || ' and ' || r_name as prompt from nation, region, (values ('What of '), ('Why ')) as x(t)")
def ideation_prompts(spark, sf):
    """Every template with every pair: a cross join of two small tables."""
    subjects, perspectives = table(spark, sf, "nation").select(F.col("n_name").alias("subject")), table(spark, sf, "region").select(F.col("r_name").alias("perspective"))
    return text.cross_prompts(["What of %s and %s", "Why %s and %s"], subjects, perspectives)


@query("select page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1), lambda p: regexp_replace(p, '(?s)<[^>]*>', '', 'g')), ' ') as content, trim(regexp_replace(regexp_extract(html, '(?s)<div[^>]*class=\"[^\"]*\\babstract\\b[^\"]*\"[^>]*>(.*?)</div>', 1), '(?s)<[^>]*>', '', 'g')) as abstract from pages")
def page_abstracts(spark, sf):
    return exports.abstracts(table(spark, sf, "pages"), "page_id", "html")


@query("select o_orderkey, o_orderkey + 1 as number, o_orderpriority as title, 'p' || o_custkey as body, o_orderstatus as label from orders where o_orderstatus <> 'F'")
def issue_rows(spark, sf):
    state = "if(o_orderstatus = 'F', 'closed', 'open')"
    made = f"to_json(array(named_struct('number', o_orderkey + 1, 'title', o_orderpriority, 'body', concat('p', o_custkey), 'state', {state}, 'labels', array(named_struct('name', o_orderstatus)))))"
    found = exports.issues(table(spark, sf, "orders").select(F.expr(made).alias("json")))
    return found.select((F.col("number") - 1).cast("long").alias("o_orderkey"), F.col("number").cast("long").alias("number"), "title", "body", F.get("labels", F.lit(0)).alias("label"))


# --- frames, threads, strata, vectors --------------------------------------------------------


@query("select doc_id, source, n_chars from documents where n_chars > 1000 and lang <> 'en'")
def frame_filter(spark, sf):
    """Filters by expression, and columns by prefix, through a frame."""
    f = Frame(table(spark, sf, "documents")).apply_expression("n_chars > 1000").filter(F.col("lang") != "en")
    return f.df.select(*f.columns_with_prefix("doc"), *f.columns_with_prefix("sou"), *f.columns_with_prefix("n_"))


@query("select p_partkey as part, p_name as name, 'x' as kind from part where p_brand <> 'Brand#11'")
def renamed_columns(spark, sf):
    f = Frame(table(spark, sf, "part"), Roles(context_columns=("p_brand",))).filter("p_brand <> 'Brand#11'").drop("p_type", "p_size", "p_retailprice", "p_brand")
    return f.withColumnsRenamed({"p_partkey": "part", "p_name": "name"}).withColumn("kind", F.lit("x")).df


@query(f"{_T} select content from t")
def select_column(spark, sf):
    return conversations(spark, sf).select_col("content")


@query(f"{_T} select {_ROW} from t where false")
def truncated_thread(spark, sf):
    return conversations(spark, sf).reset_memory().df.select(*_ROW.split(", "))


@query(f"{_T} select conversation_id, content, cast(row_number() over (partition by conversation_id order by seq desc) as bigint) as place from t")
def reversed_thread(spark, sf):
    w = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    return conversations(spark, sf).df.select("conversation_id", "content", F.row_number().over(w).cast("long").alias("place"))


@query("select event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as stratum from events")
def strata_episodic(spark, sf):
    return strata.episodic(table(spark, sf, "events"), "ts", "day", "stratum").select("event_id", F.date_format("stratum", "yyyy-MM-dd").alias("stratum"))


@query("select p_partkey, cast(1 + len(list_filter(q, lambda x: p_retailprice > x)) as integer) as stratum from part, (select quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) as q from part)")
def strata_quantile(spark, sf):
    return strata.quantile(table(spark, sf, "part"), "p_retailprice", 4, "stratum").select("p_partkey", "stratum")


@query("select vec_id, label as stratum from embeddings")
def strata_embedded(spark, sf):
    e = table(spark, sf, "embeddings")
    return strata.embedded(e.select("vec_id"), e.select("vec_id", "label"), "vec_id", "label", "stratum")


@query("with s as (select distinct source from documents), k as (select source, row_number() over (order by source nulls last) as n from s), l as (select lang, row_number() over (order by lang nulls last) as n from (select distinct lang from documents)) select doc_id, cast(k.n as integer) as by_source, cast(l.n as integer) as by_lang from documents d join k on d.source is not distinct from k.source join l on d.lang is not distinct from l.lang")
def strata_of_columns(spark, sf):
    """Strata of several columns, each by its type."""
    df = Frame(table(spark, sf, "documents").select("doc_id", "source", "lang"), Roles(context_columns=("source", "lang"))).create_stratas().df
    return df.select("doc_id", F.col("`strata|source`").alias("by_source"), F.col("`strata|lang`").alias("by_lang"))


@query("select p_partkey, cast(p_retailprice as double) as x from part")
def numeric_embedding(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.get(vectors.numeric_embedding(F.col("p_retailprice")), F.lit(0)).alias("x"))


# --- joins, windows, sets --------------------------------------------------------------------


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P'")
def left_join(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "o_orderkey")


@query("select a.event_id, b.event_id as other from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 hour where a.event_type = 'view' and b.event_type = 'click'")
def interval_join(spark, sf):
    """Clicks within an hour after a view of the same user: by user and hour, and the hour after."""
    e = table(spark, sf, "events")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "ts", F.explode(F.array(hour, hour + 1)).alias("hour"))
    clicks = e.filter("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("at"), hour.alias("hour"))
    return views.join(clicks, ["user_id", "hour"]).filter("at > ts and at <= ts + interval 1 hour").select("event_id", "other")


@query("select o_orderkey, ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey) as quarter, round(sum(o_totalprice) over (partition by o_custkey order by epoch_us(o_orderdate) range between 2592000000000 preceding and current row), 2) as month_total from orders")
def ntile_and_range(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    month = Window.partitionBy("o_custkey").orderBy("us").rangeBetween(-2592000000000, 0)
    df = table(spark, sf, "orders").withColumn("us", us)
    return df.select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.sum("o_totalprice").over(month), 2).alias("month_total"))


@query("select l_returnflag, l_linestatus, count(*) as lines from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_sets(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.groupingSets([["l_returnflag", "l_linestatus"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"))


@query("with recursive e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey // 2 > 0), up as (select child, parent from e union select u.child, e.parent from up u join e on u.parent = e.child) select child, parent from up")
def ancestors(spark, sf):
    """All ancestors in a binary heap of parts."""
    edges = table(spark, sf, "part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent")).filter("parent > 0")
    return relational.ancestors(edges)


@query("select n_name as name from nation union select r_name from region")
def union_distinct(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf, "region").select("r_name")).distinct()


@query(f"{_T}, b as (select *, sum(tokens_count) over (partition by conversation_id order by seq) as total from t) select {_ROW} from b where total <= 250 and role = 'user'")
def leading_history(spark, sf):
    """Users' messages of the opening of each thread, up to a budget."""
    t = conversations(spark, sf)
    w = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return thread.Thread(t.df.withColumn("total", F.sum("tokens_count").over(w)).filter("total <= 250")).find_role("user").select(*_ROW.split(", "))
