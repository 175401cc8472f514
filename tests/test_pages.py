from __future__ import annotations

import pytest

from gaugeworks.schema import CATALOGUE
from gaugeworks.sources import catalogue, manifest, pages


def table(*rows, tail=""):
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<html><table class='x'>\n<tr><th>Datum</th><th>Wert</th></tr>{body}</table>{tail}</html>"


def frame(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_measurements(spark):
    ok = table(("25.01.2026 16:00", "87"), ("25.01.2026 15:45", " <b>86</b> "), ("bad", "1"), ("25.01.2026 15:30", "4,1"),
               ("one",), tail="<table><tr></tr><tr><td>25.01.2026 16:00</td><td>1</td></tr></table>")
    rows = pages.html_rows(frame(spark, ok, "<p>no table</p>", table()))
    got = pages.html_measurements(rows).orderBy("pos").collect()
    assert [(r.page_id, str(r.ts), r.value) for r in got] == [
        (0, "2026-01-25 16:00:00", 87), (0, "2026-01-25 15:45:00", 86)]
    assert pages.first_reading(rows).first().value == 87


def test_level_takes_the_first_row_only(spark):
    rows = pages.html_rows(frame(spark, table(("25.01.2026 16:00", "--"), ("25.01.2026 15:45", "86"))))
    assert pages.first_reading(rows).count() == 0
    assert pages.first_valid_reading(rows).first().value == 86.0


def test_first_valid_reading_skips_gaps(spark):
    gaps = table(("25.01.2026 16:00", "--"), ("25.01.2026 15:45", ""), ("25.01.2026 15:30", "n/a"),
                 ("25.01.2026 15:15", "N/A"), ("x",), ("bad", "4,0"), ("25.01.2026 15:00", "warm"),
                 ("25.01.2026 14:45", "4,1"), ("25.01.2026 14:30", "4,2"))
    none = table(("25.01.2026 16:00", "--"))
    got = pages.first_valid_reading(pages.html_rows(frame(spark, gaps, none))).collect()
    assert [(r.page_id, r.pos, str(r.ts), r.value) for r in got] == [(0, 8, "2026-01-25 14:45:00", 4.1)]


def test_feed_links(spark):
    html = """<head><link rel="stylesheet" href="s.css"><LINK REL='alternate' TYPE='application/rss+xml'
      TITLE='News' HREF='/rss'><link type="application/atom+xml" href="/atom"></head>"""
    got = sorted((r.title, r.href) for r in pages.feed_links(frame(spark, html, "<p/>")).collect())
    assert got == [("News", "/rss"), ("No title", "/atom")]


@pytest.mark.parametrize("status,kind,body,want,feed", [
    (200, "application/json", '{"a": 1}', "json", "not_a_feed"),
    (200, "application/json", "<p>", "json_unparsable", "not_a_feed"),
    (200, "image/png", "{}", "image", "not_a_feed"),
    (200, "text/plain", " [1, 2]", "json", "not_a_feed"),
    (200, "text/plain", "{oops", "json_unparsable", "not_a_feed"),
    (200, "text/plain", "<?xml version='1.0'?>", "html", "undeclared_xml"),
    (200, "application/xml", "<?xml version='1.0'?>", "html", "feed"),
    (200, "application/xml", "", "xml", "feed"),
    (200, None, "x", "unknown", "not_a_feed"),
    (404, "application/json", "{}", "not_found", "other"),
    (403, None, None, "forbidden", "other"),
    (500, None, None, "other", "other")])
def test_response_classes(spark, status, kind, body, want, feed):
    df = spark.createDataFrame([(status, kind, body)], "status int, content_type string, body string")
    r = pages.classify_feed(pages.classify_response(df)).first()
    assert (r.response_class, r.feed_class) == (want, feed)


def station(uuid, name, water=("BACH",), series=()):
    return (uuid, None, None, name, None, 1.5, None, None, water, list(series))


def test_catalogue(spark):
    values = [(f"V{i}", float(i), "cm") for i in range(7)]
    df = spark.createDataFrame([
        station("u1", "A", ("BACH",), [("LEVEL", "W", "cm", 15, values), ("TEMP", None, None, None, [])]),
        station("u2", "B", None)], CATALOGUE)
    rows = catalogue.flatten_catalogue(df).collect()
    shown = [r for r in rows if r.uuid == "u1" and r.series == "LEVEL"]
    assert [r.value_shortname for r in shown] == [f"V{i}" for i in range(7)]
    empty = [r for r in rows if r.series == "N/A"][0]
    assert (empty.uuid, empty.water, empty.value_value) == ("u2", "N/A", None)
    no_values = [r for r in rows if r.series == "TEMP"][0]
    assert (no_values.unit, no_values.interval_minutes, no_values.value_no) == ("N/A", "N/A", None)
    info = catalogue.station_info(df).filter("uuid = 'u2'").first()
    assert (info.longname, info.km, info.agency, info.water) == ("B", "1.5", "N/A", "N/A")


def test_last_search_wins(spark):
    first = spark.createDataFrame([station("u1", "A"), station("u2", "B")], CATALOGUE)
    second = spark.createDataFrame([station("u1", "A2")], CATALOGUE)
    got = {r.uuid: r.longname for r in catalogue.union_catalogues(first, second).collect()}
    assert got == {"u1": "A2", "u2": "B"}


def test_update_plan(spark, tmp_path):
    for name, text in (("new/a.csv", "1"), ("new/b.csv", "12"), ("new/deep/c.csv", "123"), ("new/d.txt", "x"),
                       ("old/b.csv", "12"), ("old/deep/c.csv", "1"), ("new/deep/b.csv", "12"), ("old/deep/d.csv", "1")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    updates = manifest.list_exports(spark, str(tmp_path / "new"))
    target = manifest.list_exports(spark, str(tmp_path / "old"))
    for policy, applied in (("skip", False), ("overwrite", True), ("backup", True)):
        got = {f"{r.folder}/{r.name}": (r.action, r.applied) for r in manifest.plan_updates(updates, target, policy).collect()}
        assert got == {"/a.csv": ("copy", True), "/b.csv": ("already_applied", True), "deep/b.csv": ("copy", True),
                       "deep/c.csv": (policy, applied)}
    with pytest.raises(ValueError):
        manifest.plan_updates(updates, target, "ask")


def test_one_of_several_targets_of_equal_length_is_enough(spark):
    updates = spark.createDataFrame([("f", "a.csv", 5)], "folder string, name string, length bigint")
    target = spark.createDataFrame([("f", "a.csv", 5), ("f", "a.csv", 9), ("g", "a.csv", 1)], updates.schema)
    assert [r.action for r in manifest.plan_updates(updates, target).collect()] == ["already_applied"]


@pytest.mark.parametrize("text,want", [
    ("a &amp; b", "a & b"), ("12,5&nbsp;&#176;C", "12,5 °C"), ("&minus;3", "-3"), ("&#x2212;4&#8722;", "-4-"), ("&amp;lt;", "&lt;"),
    ("<b>1</b>&#xA0;2", "1 2"), ("&#128167; &#0;", "\U0001F4A7 &#0;"), ("plain", "plain"), ("&#55296;", "&#55296;")])
def test_character_references(spark, text, want):
    from pyspark.sql import functions as F
    assert spark.range(1).select(pages.plain_text(F.lit(text)).alias("t")).first().t == want
