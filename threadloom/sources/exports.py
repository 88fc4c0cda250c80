"""Rows from exported documents: chat exports, shared pages, issues, commits, papers, HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.schema import CHAT_EXPORT

ISSUES = "array<struct<number: long, title: string, body: string, state: string, labels: array<struct<name: string>>>>"
COMMITS = "array<struct<sha: string, commit: struct<message: string, author: struct<name: string, email: string, date: string>>>>"


def chat_export(df: DataFrame, column: str = "json") -> DataFrame:
    """(conversation_id, conversation_title, message_id, role, content, create_time, update_time) of exports in JSON; nodes without a message and rows that aren't JSON go."""
    told = df.select(F.from_json(F.col(column), CHAT_EXPORT).alias("c")).filter("c.mapping is not null")
    nodes = told.select(F.col("c.id").alias("conversation_id"), F.col("c.title").alias("conversation_title"), F.explode("c.mapping").alias("message_id", "node"))
    m = F.col("node.message")
    return nodes.filter("node.message is not null").select(
        "conversation_id",
        "conversation_title",
        "message_id",
        m["author"]["role"].alias("role"),
        F.get(m["content"]["parts"], F.lit(0)).alias("content"),
        m["create_time"].alias("create_time"),
        F.coalesce(m["update_time"], F.lit(0.0)).alias("update_time"),
    )


def shared_page_json(html: Column) -> Column:
    """The conversation's JSON inside a shared page; null without one."""
    script = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    return F.when(script != "", F.get_json_object(script, "$.props.pageProps.serverResponse.data"))


def shared_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """Messages of shared pages; update_time is 0; raises on a page without a conversation."""
    found = shared_page_json(F.col(html))
    told = df.select(F.when(found.isNull(), F.raise_error(F.lit("no conversation in the page")).cast("string")).otherwise(found).alias("json"))
    return chat_export(told).withColumn("update_time", F.lit(0.0))


def issues(df: DataFrame, column: str = "json", state: str | None = "open") -> DataFrame:
    """(number, title, body, labels) of a JSON array of issues; state None keeps all."""
    rows = df.select(F.explode(F.from_json(F.col(column), ISSUES)).alias("i"))
    rows = rows if state is None else rows.filter(F.col("i.state") == state)
    return rows.select("i.number", "i.title", "i.body", F.transform("i.labels", lambda x: x["name"]).alias("labels"))


def commits(df: DataFrame, column: str = "json") -> DataFrame:
    """(sha, message, author) of a JSON array of commits."""
    return df.select(F.explode(F.from_json(F.col(column), COMMITS)).alias("c")).select("c.sha", "c.commit.message", "c.commit.author")


def papers(spark: SparkSession, path: str) -> DataFrame:
    """(arxiv_id, title, summary) of saved Atom feeds."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string").load(path)
    return rows.select(F.element_at(F.split("id", "/"), -1).alias("arxiv_id"), F.trim("title").alias("title"), F.trim("summary").alias("summary"))


def with_content(found: DataFrame, content: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Papers whose content (key, content) is known."""
    return found.join(content.filter("content is not null"), key)


def _without_tags(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<[^>]*>", "")


def paragraphs(html: Column) -> Column:
    """Texts of the <p> elements, in order, without tags."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p(?: [^>]*)?>(.*?)</p>"), F.lit(1)), _without_tags)


class _Divisions(HTMLParser):
    """Texts of the <div> elements of a class, in the order in which they begin; one inside another is in both."""

    def __init__(self, css_class: str):
        super().__init__()
        self.css_class, self.open, self.texts = css_class, [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "div":
            mine = self.css_class in (dict(attrs).get("class") or "").split()
            if mine:
                self.texts.append([])
            self.open.append(len(self.texts) - 1 if mine else None)

    def handle_endtag(self, tag: str) -> None:
        if tag == "div" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        for i in self.open:
            if i is not None:
                self.texts[i].append(data)


def numbered_divisions(html: Column, css_class: str = "ltx_para") -> Column:
    """Map from position to text of the <div> elements of a class, however they are nested."""

    def texts(value: str | None) -> dict[int, str] | None:
        if value is None:
            return None
        parser = _Divisions(css_class)
        parser.feed(value)
        parser.close()
        return {i: "".join(x) for i, x in enumerate(parser.texts)}

    @F.pandas_udf("map<int, string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(texts)

    return run(html)


def full_text(html: Column) -> Column:
    """All paragraphs, joined by spaces."""
    return F.array_join(paragraphs(html), " ")


def abstracts(df: DataFrame, key: str = "pubmed_id", html: str = "html") -> DataFrame:
    """(key, abstract, content): the element of class abstract, and all paragraphs."""
    abstract = _without_tags(F.regexp_extract(html, r'(?s)<div[^>]*class="[^"]*\babstract\b[^"]*"[^>]*>(.*?)</div>', 1))
    return df.select(key, F.trim(abstract).alias("abstract"), full_text(F.col(html)).alias("content"))
