"""The given tables seen as gauge data.

``events`` becomes a raw series and ``orders`` a daily one. Each view keeps every
row of its table; only keys, nulls and status words are derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.plans import evaluated_once
from gaugeworks.functions.scalars import live_time_parts, local_epoch, unit_of
from gaugeworks.operators.rollup import daily_rollup
from gaugeworks.schema import STATUS_CHECKED, STATUS_RAW, WATER_LEVEL, WATER_TEMPERATURE
from gaugeworks.sources.live import LEVEL_KIND, TEMPERATURE_KIND

# Readings and prices have two decimals.
SCALE = 2

# Fixed header cells of the export format; event types without one are unknown.
HEADER_CELLS = {"click": "Wasserstand [cm]", "view": "Wassertemperatur [°C]"}
OTHER_HEADER_CELL = "Abfluss [m³/s]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_raw(events: DataFrame) -> DataFrame:
    """Raw series of an events frame, with ``k`` and ``event_id`` for derived cases."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        (F.col("user_id") % 5).cast("int").alias("station_id"),
        F.col("event_type").alias("parameter"),
        "ts",
        F.when(k % 10 != 0, F.col("value")).alias("value"),
        F.when(k % 2 == 0, STATUS_CHECKED).otherwise(STATUS_RAW).alias("status"),
        k.alias("k"), "event_id")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw(table(spark, sf_dir, "events"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 5).cast("int").alias("station_id"),
        F.col("o_orderpriority").alias("parameter"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("station_id"),
        F.col("l_linestatus").alias("parameter"), F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("status"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_rollup(raw_events(spark, sf_dir), SCALE)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series and day, 1995-2001."""
    return daily_rollup(raw_orders(spark, sf_dir), SCALE)


def as_gauge(raw: DataFrame) -> DataFrame:
    """Event types folded to the two gauge parameters."""
    level = F.col("parameter").isin("click", "view", "purchase")
    return raw.withColumn("parameter", F.when(level, WATER_LEVEL).otherwise(WATER_TEMPERATURE))


def refetched(raw: DataFrame) -> DataFrame:
    """New readings against ``raw``: revisions of stored instants and later ones, fetched twice."""
    once = raw.select(
        "station_id", "parameter",
        F.when(F.col("k") % 2 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
        "value", "status", F.explode(F.array(F.lit(1), F.lit(2))).alias("fetch"))
    return once.select("station_id", "parameter", "ts", (F.col("value") + F.col("fetch")).alias("value"), "status",
                       F.concat(F.lit("2024-02-0"), F.col("fetch").cast("string")).alias("fetched_at"))


def export_lines(raw: DataFrame) -> DataFrame:
    """``raw`` as lines of station exports, one file per series, some values unreadable."""
    path = F.concat(F.lit("exports/"), F.col("station_id").cast("string"), F.lit("_"), F.col("parameter"), F.lit(".csv"))
    number = F.replace(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    value = F.when(F.col("k") % 10 == 1, F.concat(number, F.lit("abc"))).otherwise(F.coalesce(number, F.lit("")))
    status = F.when(F.col("status") == STATUS_CHECKED, F.lit("Geprüft")).otherwise(F.concat(F.lit(" "), F.col("status")))
    minute = F.substring(F.col("ts").cast("string"), 1, 16)
    stamp = F.when(F.col("k") % 10 == 2, F.concat(minute, F.lit(" Uhr"))).otherwise(minute)
    rows = raw.select(path.alias("file_path"),
                      F.concat(F.lit('"'), stamp, F.lit('";'), value, F.lit(";"), status).alias("line"))
    cell = F.lit(OTHER_HEADER_CELL)
    for event_type, text in HEADER_CELLS.items():
        cell = F.when(F.col("parameter") == event_type, text).otherwise(cell)
    number_text = F.col("station_id").cast("string")
    preamble = F.array(
        F.lit('Quelle:;"Pegeldienst"'), F.lit("Zeitbezug:;MEZ"),
        F.concat(F.lit("Messstellen-Name:;Pegel "), number_text),
        F.concat(F.lit("Messstellen-Nr.:;"), (F.col("station_id") + 1).cast("string")),
        F.lit("Gewässer:;Musterbach"),
        F.concat(F.lit("Ostwert:;69"), number_text, F.lit(";Nordwert:;53"), number_text, F.lit(';"UTM 32N"')),
        F.lit(""),
        F.concat(F.lit('Datum;"'), cell, F.lit('";Prüfstatus')))
    heads = raw.select("station_id", "parameter").distinct().select(
        path.alias("file_path"), F.explode(preamble).alias("line"))
    return evaluated_once(rows).unionByName(heads)


def write_export_files(lines: DataFrame, path: str) -> str:
    """Export lines as one ``.csv`` file per series below ``path``, in folders ``series=<name>``."""
    series = F.regexp_extract("file_path", r"([^/]+)\.csv$", 1).alias("series")
    (lines.select(series, "line").repartition("series").write.partitionBy("series")
     .options(sep="\u0001", quote="", emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path))
    return path


def name_exports(spark: SparkSession, path: str, tree: str, folder: str) -> str:
    """Export files of ``write_export_files`` moved to ``<tree>/<folder>/<series>.csv``: one move per series."""
    files = spark._jvm.org.apache.hadoop.fs
    system = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(files.Path(f"{tree}/{folder}"))
    for series in system.listStatus(files.Path(path)):
        name = series.getPath().getName()
        if name.startswith("series="):
            parts = [f.getPath() for f in system.listStatus(series.getPath()) if f.getPath().getName().endswith(".csv")]
            system.rename(parts[0], files.Path(f"{tree}/{folder}/{name.partition('=')[2]}.csv"))
    return tree


def live_json(raw: DataFrame) -> DataFrame:
    """``raw`` as JSON lines of live readings with their kind, some of them cut short."""
    level = F.col("parameter") == WATER_LEVEL
    parts = live_time_parts("ts")
    reading = F.struct(
        parts["timestamp"].alias("timestamp"), local_epoch("ts").alias("timestamp_unix"),
        parts["date"].alias("date"), parts["time"].alias("time"),
        F.when(level, F.col("value")).alias("value_cm"), F.when(~level, F.col("value")).alias("value_celsius"),
        unit_of("parameter").alias("unit"), F.col("station_id").cast("string").alias("station_id"),
        F.lit("Pegel").alias("station_name"), F.lit("table").alias("source"),
        parts["timestamp"].alias("fetched_at"))
    line = F.to_json(reading)
    cut = F.when(F.col("k") % 10 == 3, F.substring(line, 1, 30)).otherwise(line)
    return evaluated_once(raw.select("event_id", F.when(level, LEVEL_KIND).otherwise(TEMPERATURE_KIND).alias("kind"),
                                     cut.alias("line")))


def faulty_live_json(raw: DataFrame) -> DataFrame:
    """``raw`` as JSON lines of live files by kind and day: cut short, without a station, or fetched days before they were read."""
    level = F.col("parameter") == WATER_LEVEL
    stamp = live_time_parts("ts")["timestamp"]
    early = live_time_parts(F.col("ts") - F.expr("INTERVAL 2 DAYS"))["timestamp"]
    case = F.col("k") % 10
    line = F.to_json(F.struct(
        stamp.alias("timestamp"), F.when(level, F.col("value")).alias("value_cm"), F.when(~level, F.col("value")).alias("value_celsius"),
        F.when(case == 4, "").otherwise(F.col("station_id").cast("string")).alias("station_id"),
        F.when(case == 5, early).otherwise(stamp).alias("fetched_at")))
    return evaluated_once(raw.select(
        F.when(level, LEVEL_KIND).otherwise(TEMPERATURE_KIND).alias("kind"), F.to_date("ts").cast("string").alias("day"),
        F.when(case == 3, F.substring(line, 1, 30)).otherwise(line).alias("line")))


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def measurement_pages(raw: DataFrame) -> DataFrame:
    """One page per reading: a table with a header, gaps and then the reading."""
    text = F.col("ts").cast("string")
    german = F.concat(F.substring(text, 9, 2), F.lit("."), F.substring(text, 6, 2), F.lit("."),
                      F.substring(text, 1, 4), F.lit(" "), F.substring(text, 12, 5))
    value = F.coalesce(F.replace(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")),
                       F.lit("n/a"))
    gap = (F.when(F.col("k") % 4 == 0, "--").when(F.col("k") % 4 == 1, "")
           .when(F.col("k") % 4 == 2, "N/A").otherwise(F.floor("value").cast("string")))
    first_stamp = F.when(F.col("k") % 8 == 3, F.lit("gestern")).otherwise(german)
    html = F.concat(
        F.lit("<html><body><p>x</p><table class=\"t\"><tr><th>Datum</th><th>Wert</th></tr>"),
        _cells(first_stamp, gap), F.lit("<tr><td>one cell</td></tr>"),
        _cells(german, F.concat(F.lit(" <b>"), value, F.lit("</b> "))),
        F.lit("</table><table><tr><td>other</td></tr></table></body></html>"))
    return evaluated_once(raw.select(F.col("event_id").alias("page_id"), html.alias("html")))


def responses(pages: DataFrame) -> DataFrame:
    """Pages as HTTP responses of all kinds."""
    n = F.col("page_id")
    return pages.select(
        "page_id",
        F.when(n % 7 == 0, 404).when(n % 11 == 0, 403).when(n % 13 == 0, 500).otherwise(200).alias("status"),
        F.when(n % 5 == 0, "application/json").when(n % 5 == 1, "text/html; charset=utf-8")
        .when(n % 5 == 2, "image/png").when(n % 5 == 3, "application/rss+xml").otherwise(F.lit("text/plain"))
        .alias("content_type"),
        F.when(n % 3 == 0, F.to_json(F.struct(F.col("url").alias("url")))).when(n % 3 == 1, F.col("html"))
        .otherwise(F.concat(F.lit("{ "), F.col("url"))).alias("body"))


def pages_with_feeds(pages: DataFrame) -> DataFrame:
    """Pages that announce feeds in their head, besides a style sheet."""
    def link(kind: str, title: Column, href: Column) -> Column:
        return F.concat(F.lit('<link rel="alternate" type="'), F.lit(kind), F.lit('"'), title,
                        F.lit(' href="'), href, F.lit('">'))

    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(' title="Feed '), F.col("page_id").cast("string"),
                                                       F.lit('"'))).otherwise(F.lit(""))
    head = F.concat(F.lit("<head>"), link("text/css", F.lit(""), F.lit("/s.css")),
                    link("application/rss+xml", title, F.concat(F.col("url"), F.lit("/rss"))),
                    link("application/atom+xml", title, F.concat(F.col("url"), F.lit("/atom"))))
    return pages.withColumn("html", F.replace(F.col("html"), F.lit("<head>"), head))


def supplier_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a station catalogue; a series per return flag with six characteristic values.

    The nested lists are bounded by the three return flags and the six statistics.
    """
    price = F.col("l_extendedprice")
    stats = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.min(price).alias("lo"), F.max(price).alias("hi"), F.min("l_quantity").alias("qlo"),
        F.max("l_quantity").alias("qhi"), F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax"))

    def value(name: str, column: str, unit: Column) -> Column:
        return F.struct(F.lit(name).alias("shortname"), F.col(column).alias("value"), unit.alias("unit"))

    no_unit = F.lit(None).cast("string")
    series = F.struct(
        F.concat(F.lit("FLAG "), F.col("l_returnflag")).alias("longname"),
        F.col("l_returnflag").alias("shortname"), F.lit("cm").alias("unit"), F.lit(15).alias("equidistance"),
        F.array(value("MNW", "lo", F.lit("cm")), value("MHW", "hi", F.lit("cm")), value("QL", "qlo", no_unit),
                value("QH", "qhi", no_unit), value("D", "disc", no_unit), value("T", "tax", no_unit))
        .alias("characteristicValues"))
    per_supplier = stats.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(series)).alias("timeseries"))
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return suppliers.join(per_supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_suppkey").cast("string").alias("uuid"), F.col("s_suppkey").cast("string").alias("number"),
        F.lit(None).cast("string").alias("shortname"), F.col("s_name").alias("longname"),
        F.lit(None).cast("string").alias("agency"), F.col("s_acctbal").alias("km"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.when(F.col("s_suppkey") % 4 != 0, F.struct(F.col("n_name").alias("longname"))).alias("water"),
        "timeseries")
