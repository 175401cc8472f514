"""Measurements and feed links in stored web pages.

Pages come as a table with an id and the HTML text. Regular expressions are
enough for flat tables; a container inside a container is not resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.plans import evaluated_once
from gaugeworks.functions.scalars import (
    ColumnLike, _col, decimal_comma, int_or_null, parse_german_ts,
)
from gaugeworks.schema import MISSING_TOKENS

# Fixed values of the page and feed formats.
FEED_TYPES = ["application/rss+xml", "application/atom+xml"]
NO_TITLE = "No title"


def _element(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"


# Named character references of the page text, ``&amp;`` last so that nothing is read twice.
ENTITIES = {"&nbsp;": " ", "&minus;": "-", "&deg;": "°", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'",
            "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&szlig;": "ß", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü"}
CODED = r"&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));"


def _decoded(text: Column) -> Column:
    """Numeric character references replaced one part at a time; most texts have none."""
    parts = F.split(F.regexp_replace(text, CODED, "\u0001$0\u0001"), "\u0001")
    code = lambda p: F.coalesce(F.regexp_extract(p, CODED, 1).try_cast("int"), F.conv(F.regexp_extract(p, CODED, 2), 16, 10).try_cast("int"))
    wide = lambda p: F.decode(F.unhex(F.lpad(F.hex(code(p)), 8, "0")), "UTF-32")
    valid = lambda p: p.rlike("^" + CODED + "$") & code(p).between(1, 0x10FFFF) & ~code(p).between(0xD800, 0xDFFF)
    return F.when(text.rlike(CODED), F.array_join(F.transform(parts, lambda p: F.when(valid(p), wide(p)).otherwise(p)), "")).otherwise(text)


def plain_text(c: ColumnLike) -> Column:
    """Text of a fragment without tags, character references resolved, blanks folded."""
    text = _decoded(F.regexp_replace(_col(c), r"(?s)<[^>]*>", ""))
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.replace(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit("\u00a0"), F.lit(" "))
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u2212"), F.lit("-")), r"\s+", " "))


def html_rows(pages: DataFrame, container: str = "table", row: str = "tr", cell: str = "td",
              page_key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows of the first container of each page, as position and list of cell texts."""
    body = F.regexp_extract(html, _element(container), 1)
    rows = F.regexp_extract_all(body, F.lit(_element(row)), 1)
    # The outer form spares the check for empty lists, which would extract the rows twice.
    found = pages.select(page_key, F.posexplode_outer(rows).alias("pos", "row_html")).filter(F.col("pos").isNotNull())
    cells = F.transform(F.regexp_extract_all("row_html", F.lit(_element(cell)), 1), plain_text)
    return evaluated_once(found.select(page_key, "pos", cells.alias("cells")))


def html_measurements(rows: DataFrame, page_key: str = "page_id") -> DataFrame:
    """Measurements of all rows but the first; rows that do not parse are skipped."""
    parsed = (
        rows.filter((F.col("pos") > 0) & (F.size("cells") >= 2))
        .select(page_key, "pos", parse_german_ts(F.get("cells", 0)).alias("ts"),
                int_or_null(F.get("cells", 1)).alias("value"))
    )
    return evaluated_once(parsed).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())


def drop_missing_tokens(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not one of the missing-value marks."""
    return df.filter(~F.trim(F.coalesce(F.col(column), F.lit(""))).isin(MISSING_TOKENS))


def first_valid_reading(rows: DataFrame, page_key: str = "page_id") -> DataFrame:
    """Per page the first row below the header that holds a usable reading.

    A page's rows come from one row of the page table, so they meet in one task
    and a single candidate per page is shuffled. Pages without one have no row.
    """
    cells = rows.filter((F.col("pos") > 0) & (F.size("cells") >= 2)).select(
        page_key, "pos", F.get("cells", 0).alias("ts_text"), F.get("cells", 1).alias("value_text"))
    parsed = drop_missing_tokens(cells, "value_text").select(
        page_key, "pos", parse_german_ts("ts_text").alias("ts"), decimal_comma("value_text").alias("value"))
    valid = evaluated_once(parsed).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return (valid.groupBy(page_key)
            .agg(F.min(F.struct("pos", "ts", "value")).alias("r"))
            .select(page_key, "r.*"))


def first_reading(rows: DataFrame, page_key: str = "page_id") -> DataFrame:
    """S10 for levels: only the first row below the header counts, valid or not."""
    return html_measurements(rows.filter(F.col("pos") <= 1), page_key)


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)
    return F.nullif(quoted, F.lit(""))


def feed_links(pages: DataFrame, page_key: str = "page_id", html: str = "html") -> DataFrame:
    """Feed links that a page announces."""
    tag = F.col("tag")
    return (
        pages.select(page_key, F.explode(F.regexp_extract_all(html, F.lit(r"(?i)(<link\s[^>]*>)"), 1)).alias("tag"))
        .filter(F.lower(_attribute(tag, "type")).isin(FEED_TYPES))
        .select(page_key, F.coalesce(_attribute(tag, "title"), F.lit(NO_TITLE)).alias("title"),
                _attribute(tag, "href").alias("href"))
    )


def classify_response(df: DataFrame, status: str = "status", content_type: str = "content_type",
                      body: str = "body") -> DataFrame:
    """P10: class of a response; the order of the rules is part of the result.

    XML that is not declared as such begins with ``<`` and counts as HTML.
    """
    kind = F.lower(F.coalesce(F.col(content_type), F.lit("unknown")))
    text = F.trim(F.coalesce(F.col(body), F.lit("")))
    is_json = F.try_parse_json(text).isNotNull()
    json_class = F.when(is_json, "json").otherwise("json_unparsable")
    found = (
        F.when(kind.contains("json"), json_class)
        .when(kind.contains("image"), "image")
        .when(text.startswith("{") | text.startswith("["), json_class)
        .when(kind.contains("html") | text.startswith("<"), "html")
        .when(kind.contains("xml"), "xml")
        .otherwise("unknown")
    )
    return df.withColumn("response_class", F.when(F.col(status) == 200, found)
                         .when(F.col(status) == 404, "not_found")
                         .when(F.col(status) == 403, "forbidden")
                         .otherwise("other"))


def classify_feed(df: DataFrame, status: str = "status", content_type: str = "content_type",
                  body: str = "body") -> DataFrame:
    """P10, feed variant."""
    kind = F.lower(F.coalesce(F.col(content_type), F.lit("unknown")))
    declared = kind.contains("xml") | kind.contains("rss") | kind.contains("atom")
    found = (F.when(declared, "feed")
             .when(F.trim(F.coalesce(F.col(body), F.lit(""))).startswith("<?xml"), "undeclared_xml")
             .otherwise("not_a_feed"))
    return df.withColumn("feed_class", F.when(F.col(status) == 200, found).otherwise("other"))
