"""Gates of the corpus plan that look at pages and conversations: boilerplate, navigation, link tables, fragments, chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least characters of text, most share of it in links, most share of repeated lines, most links to a line of text.
LEAST_CHARS, LINK_SHARE, REPEATED_SHARE, LINKS_PER_LINE = 200, 0.5, 0.5, 2.0
#: Marks of conversations in plain text; fixed values.
CHAT_MARKS = r"(?im)^\s*(?:<\|(?:im_start|user|assistant|system)\|>|\[/?INST\]|###\s*(?:instruction|response|human|assistant)\b|(?:user|assistant|system|human)\s*:)"


#: Steps from HTML to text: pattern and replacement.
HTML_STEPS = (
    *((rf"(?is)<{tag}\b.*?</{tag}\s*>", " ") for tag in ("script", "style", "noscript")),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/td|/title|/ul|/table)\b[^>]*>", "\n"),
    (r"<[^>]*>", " "),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", "\""),
    (r"&amp;", "&"),
    (r"[ \t\r]+", " "),
    (r" *\n *", "\n"),
    (r"\n{2,}", "\n"),
)


def text_of_html(c: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags; block tags end lines; the usual entities resolved."""
    for pattern, to in HTML_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c, F.lit(" \n"))


def page_signals(pages: DataFrame) -> DataFrame:
    """pages (page_id, html, ...) -> (page_id, chars, lines, repeated_lines, links, link_chars, boilerplate, reason): what decides
    whether a page is text or frame. reason is the first that holds of fragment, links, repeated, navigation; else null.

    A null html is an empty page. One pass over the pages, expressions only.
    """
    html = F.coalesce("html", F.lit(""))
    once = pages.select("page_id", F.explode(F.array(F.struct(text_of_html(html).alias("t"), F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)).alias("a")))).alias("x"))
    lines = F.filter(F.split("x.t", "\n"), lambda x: x != "")
    link_text = F.transform("x.a", lambda a: F.length(F.trim(F.regexp_replace(F.regexp_replace(a, r"<[^>]*>", " "), r"\s+", " "))))
    out = once.select(
        "page_id",
        F.length("x.t").cast("long").alias("chars"),
        F.size(lines).cast("long").alias("lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("repeated_lines"),
        F.size("x.a").cast("long").alias("links"),
        F.aggregate(link_text, F.lit(0), lambda a, n: a + n).cast("long").alias("link_chars"),
    )
    reason = (
        F.when(F.col("chars") < LEAST_CHARS, "fragment")
        .when(F.col("link_chars") > LINK_SHARE * F.col("chars"), "links")
        .when(F.col("repeated_lines") > REPEATED_SHARE * F.col("lines"), "repeated")
        .when(F.col("links") > LINKS_PER_LINE * F.col("lines"), "navigation")
    )
    return out.withColumn("reason", reason).withColumn("boilerplate", F.col("reason").isNotNull())


def conversations(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, turns, roles, marked, chat): whether a record is a conversation: two roles or
    more, an assistant among them, or the marks of one in its text. Partial aggregation; no texts move."""
    marked = F.coalesce(F.col("text").rlike(CHAT_MARKS), F.lit(False))
    out = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.max(marked).alias("marked"), F.max(F.coalesce(F.lower("role") == "assistant", F.lit(False))).alias("answered"))
    return out.select("conv_id", "turns", "roles", "marked", (F.col("marked") | (F.col("answered") & (F.col("roles") > 1))).alias("chat"))


def without_chat(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose text has no marks of a conversation."""
    return docs.filter(~F.coalesce(F.col(text).rlike(CHAT_MARKS), F.lit(False)))
