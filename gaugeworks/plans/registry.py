"""Registered queries over the given tables, each with its SQL twin.

Timestamps and dates leave a query as text, as they do at the presentation edge.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import scalars as S
from gaugeworks.operators import asof, climate, merge, quality, ranges, records, rollup, series
from gaugeworks.plans import driver_tables as D
from gaugeworks.plans import refresh, series_lookup, series_store
from gaugeworks.plans import sql as Q
from gaugeworks.schema import CATALOGUE, KEYS, WATER_LEVEL, WATER_TEMPERATURE
from gaugeworks.session import shared_dir
from gaugeworks.sinks import store as sinks
from gaugeworks.sources import catalogue, exports, live, manifest, pages, store
from gaugeworks.streaming import arrivals as late_streams
from gaugeworks.streaming import exports as export_streams
from gaugeworks.streaming import live as streams

Query = Callable[[SparkSession, str], DataFrame]

SEASON_DAY = "1998-07-01"
RANGE = ("2024-01-03", "2024-01-27")
CUTOFF = "2024-01-08"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def as_text(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text."""
    timed = (T.TimestampNTZType, T.TimestampType, T.DateType)
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, timed)
                       else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: as_text(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


# --- scans, ranges, resolutions ------------------------------------------------------------

@query(Q.raw_scan())
def raw_scan(spark, sf):
    return series.with_value(D.raw_events(spark, sf)).select(*KEYS, "ts", "value", "status")


@query(Q.raw_range(*RANGE))
def raw_range(spark, sf):
    return series.raw_range(D.raw_events(spark, sf), *RANGE)


@query(Q.raw_range_ordered(*RANGE))
def raw_range_ordered(spark, sf):
    """Places of the ordered output; rows of one instant share the first of theirs."""
    ordered = series.raw_range(D.raw_events(spark, sf), *RANGE, ordered=True)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    path = _folder(spark, "ordered")
    ordered.withColumns({"part": F.spark_partition_id(), "within": within}).write.parquet(path)
    placed = spark.read.parquet(path)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).alias("s")
    before = (sizes.join(sizes.alias("o"), F.col("o.part") < F.col("s.part"), "left").groupBy("s.part")
              .agg(F.coalesce(F.sum("o.n"), F.lit(0)).alias("before")))
    return (placed.join(before, "part").groupBy(*KEYS, "x")
            .agg(F.min(F.col("before") + F.col("within") + 1).alias("place"), F.count(F.lit(1)).alias("n")))


@query(Q.raw_range(*RANGE, inclusive=True))
def raw_range_inclusive(spark, sf):
    return series.raw_range(D.raw_events(spark, sf), *RANGE, end_inclusive_day=True)


@query(Q.start_date_filter(CUTOFF))
def start_date_filter(spark, sf):
    return series.since_date(D.raw_events(spark, sf), CUTOFF).select(*KEYS, "ts", "value", "status")


@query(Q.daily_range(*RANGE))
def daily_range(spark, sf):
    return series.daily_range(D.daily_events(spark, sf), *RANGE)


@query(Q.series_dispatch(*RANGE))
def series_dispatch(spark, sf):
    """Every resolution of one parameter, whatever preset the range comes from."""
    raw, daily = D.raw_events(spark, sf), D.daily_events(spark, sf)
    cases = [("raw", "month"), ("hourly", "5y"), ("daily", ""), ("raw", "1y")]
    out = None
    for resolution, preset in cases:
        part = (series.series(raw, daily, "view", *RANGE, resolution, scale=D.SCALE)
                .withColumn("asked", F.lit(f"{resolution}/{preset}")))
        out = part if out is None else out.unionByName(part)
    return out


@query(Q.relative_ranges())
def relative_ranges(spark, sf):
    """Rows and extent of every preset against the last day of the table's calendar."""
    raw = series.with_value(D.raw_orders(spark, sf))
    inside = []
    for preset in S.PRESETS:
        start, end = S.relative_range(preset, "1998-03-31")
        inside.append((preset, F.col("ts").between(ranges.as_ts(start), ranges.as_ts(end))))
    flags = F.array(*[F.when(hit, F.lit(preset)) for preset, hit in inside])
    return (raw.select(*KEYS, "ts", F.explode(F.array_compact(flags)).alias("preset"))
            .groupBy(*KEYS, "preset").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"),
                                          F.max("ts").alias("last_ts")))


# --- rollups -------------------------------------------------------------------------------

@query(Q.daily_rollup())
def daily_rollup(spark, sf):
    return D.daily_events(spark, sf)


@query(Q.daily_rollup(Q.LINES))
def daily_rollup_lines(spark, sf):
    return rollup.daily_rollup(D.raw_lines(spark, sf), D.SCALE)


@query(Q.daily_rollup())
def partials_merge(spark, sf):
    """The table folded in two chunks equals the table folded at once."""
    raw = D.raw_events(spark, sf)
    early = F.col("ts") < F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    chunks = [rollup.rollup_partials(raw.filter(early), D.SCALE),
              rollup.rollup_partials(raw.filter(~early), D.SCALE)]
    return rollup.daily_from_partials(rollup.merge_partials(*chunks))


@query(Q.status_mode())
def status_mode(spark, sf):
    return rollup.status_mode(D.raw_events(spark, sf))


@query(Q.hourly_mean())
def hourly_mean(spark, sf):
    return rollup.hourly_mean(D.raw_events(spark, sf), scale=D.SCALE)


@query(Q.latest_daily())
def latest_daily(spark, sf):
    return series.latest_daily(D.daily_events(spark, sf))


# --- seasonal bands ------------------------------------------------------------------------

@query(Q.seasonal_band(SEASON_DAY))
def seasonal_band(spark, sf):
    return (climate.seasonal_band(D.daily_orders(spark, sf), SEASON_DAY))


@query(Q.seasonal_band(None))
def seasonal_band_latest(spark, sf):
    return (climate.seasonal_band(D.daily_orders(spark, sf)))


@query(Q.seasonal_band_all(wrap=False))
def seasonal_band_all(spark, sf):
    return (climate.seasonal_band_all(D.daily_orders(spark, sf)))


@query(Q.seasonal_band_all(wrap=True))
def seasonal_band_all_wrapped(spark, sf):
    return (climate.seasonal_band_all(D.daily_orders(spark, sf), wrap=True))


# --- records and extents -------------------------------------------------------------------

@query(Q.records())
def extreme_records(spark, sf):
    return records.records(D.raw_events(spark, sf))


@query(Q.records())
def extreme_records_via_daily(spark, sf):
    return records.records_via_daily(D.raw_events(spark, sf), D.daily_events(spark, sf))


@query(Q.record_context())
def record_context(spark, sf):
    found = records.record_rows(records.records(D.raw_orders(spark, sf)))
    return records.record_context(found, D.daily_orders(spark, sf))


@query(Q.completeness())
def completeness(spark, sf):
    return quality.completeness(D.raw_events(spark, sf), D.daily_events(spark, sf))


@query(Q.since_threshold(CUTOFF))
def since_threshold(spark, sf):
    return series.since(D.raw_events(spark, sf), CUTOFF)


@query(Q.value_domain())
def value_domain(spark, sf):
    return series.value_domain(D.raw_events(spark, sf))


@query(Q.visible_domain(*RANGE))
def visible_domain(spark, sf):
    return series.visible_domain(D.raw_events(spark, sf), *RANGE)


@query(Q.visible_points(*RANGE))
def visible_points(spark, sf):
    return series.visible(D.raw_events(spark, sf), *RANGE).select(*KEYS, "ts", "value")


# --- merges and joins ----------------------------------------------------------------------

@query(Q.merge_last_wins())
def merge_last_wins(spark, sf):
    raw = D.raw_events(spark, sf)
    return merge.merge_last_wins(raw, D.refetched(raw))


@query(Q.merge_report())
def merge_report(spark, sf):
    raw = D.raw_events(spark, sf)
    return merge.merge_report(raw, D.refetched(raw))


@query(Q.new_readings())
def new_readings(spark, sf):
    """Copies are dropped; revisions and new instants stay."""
    raw = D.raw_events(spark, sf)
    third = F.col("k") % 3
    incoming = raw.select(
        *KEYS, F.when(third == 2, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("ts"),
        F.when(third == 1, F.col("value") + 1).otherwise(F.col("value")).alias("value"), "status")
    return merge.new_readings(incoming, raw)


@query(Q.latest_live())
def latest_live(spark, sf):
    return live.latest_live(series.with_value(D.raw_events(spark, sf)))


@query(Q.live_or_daily())
def live_or_daily(spark, sf):
    """Error events have a live feed at station 4 only, which has no daily table."""
    raw = series.with_value(D.raw_events(spark, sf))
    daily = series.latest_daily(D.daily_events(spark, sf).filter(F.col("station_id") != 4))
    return merge.live_or_daily(daily, live.latest_live(raw.filter((F.col("parameter") != "error") | (F.col("station_id") == 4))))


@query(Q.newest_topn())
def newest_topn(spark, sf):
    return (series.newest(D.raw_events(spark, sf), 10, tie=["event_id"])
            .select(*KEYS, "ts", "value", "status", "rank"))


@query(Q.snapshot_nested())
def snapshot_nested(spark, sf):
    """Documents per user and day; the users grow with the table, so a document does not."""
    readings = series.with_value(D.table(spark, sf, "events").select(
        F.col("user_id").cast("int").alias("station_id"), F.col("event_type").alias("parameter"), "ts", "value"))
    first, last = F.element_at("measurements", 1), F.element_at("measurements", -1)
    return sinks.snapshot(readings).select(
        *KEYS, "window_start", F.size("measurements").cast("bigint").alias("n"),
        first["ts"].alias("newest_ts"), first["value"].alias("newest_value"), last["ts"].alias("oldest_ts"))


def _probes(raw: DataFrame) -> DataFrame:
    """Every reading probes the next station, some minutes before or after itself."""
    shift = F.make_dt_interval(mins=F.col("k") - 50)
    return raw.select(((F.col("station_id") + 1) % 5).alias("station_id"), "parameter",
                      (F.col("ts") + shift).alias("probe_ts"), "event_id")


@query(Q.nearest_observation())
def nearest_observation(spark, sf):
    raw = D.raw_events(spark, sf)
    return asof.nearest_observation(_probes(raw), raw)


@query(Q.update_plan())
def update_plan(spark, sf):
    """Orders as update files: pending ones are not there yet, open ones in another size.

    Every name occurs in two folders; in the second one nothing is there.
    """
    orders = D.table(spark, sf, "orders")
    folder = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("folder")
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("name")
    size = F.floor("o_totalprice")
    updates = orders.select(folder, name, size.alias("length"))
    target = orders.filter(F.col("o_orderstatus") != "P").select(
        F.lit("a").alias("folder"), name, F.when(F.col("o_orderstatus") == "O", size + 1).otherwise(size).alias("length"))
    return manifest.plan_updates(updates, target, "backup")


# --- text formats --------------------------------------------------------------------------

def _export(spark: SparkSession, sf: str) -> exports.Export:
    lines = D.export_lines(D.raw_events(spark, sf))
    return exports.parse_export(lines, exports.store_meta(lines, _folder(spark, "files")))


@query(Q.csv_line_balance())
def csv_line_balance(spark, sf):
    """Every line of a file is preamble, header, blank or a row, and every row in the series or a reject."""
    lines = D.export_lines(D.raw_events(spark, sf))
    export = exports.parse_export(lines, exports.store_meta(lines, _folder(spark, "files")))
    kept = export.raw.groupBy(F.col("source_file").alias("file_path")).agg(F.count(F.lit(1)).alias("n_series"))
    lost = (export.rejects.filter(~F.col("reject_reason").isin("bad_value"))
            .groupBy("file_path").agg(F.count(F.lit(1)).alias("n_rejects")))
    return (exports.line_balance(lines).join(kept, "file_path", "left").join(lost, "file_path", "left")
            .fillna(0, ["n_series", "n_rejects"]))


@query(Q.export_listing())
def export_listing(spark, sf):
    """Export files written, listed without being read, and their sizes added up by folder."""
    path = D.write_export_files(D.export_lines(D.raw_events(spark, sf)), _folder(spark, "exports"))
    return manifest.list_exports(spark, path).groupBy("folder").agg(F.sum("length").alias("n_bytes"))


@query(Q.export_files())
def export_files(spark, sf):
    """Export files with the names of the format, found by their paths and read."""
    root = _folder(spark, "named")
    D.name_exports(spark, D.write_export_files(D.export_lines(D.raw_events(spark, sf)), f"{root}/written"), f"{root}/exports", "all")
    raw = exports.read_export(spark, exports.export_paths(f"{root}/exports")).raw
    return raw.select(*KEYS, "ts", "value", "status", F.regexp_extract("source_file", r"([^/]+)$", 1).alias("file_name"))


@query(Q.update_files())
def update_files(spark, sf):
    """Update files in two folders with equal names against what is there: station 0 is older, station 1 missing, a folder new."""
    root = _folder(spark, "updates")
    raw = D.raw_events(spark, sf)
    older = raw.filter((F.col("station_id") > 1) | ((F.col("station_id") == 0) & (F.col("k") < 50)))
    for rows, tree, folder in ((raw, "updates", "a"), (raw, "updates", "b/c"), (older, "target", "a")):
        written = D.write_export_files(D.export_lines(rows), f"{root}/written/{tree}/{folder}")
        D.name_exports(spark, written, f"{root}/{tree}", folder)
    plan = manifest.plan_updates(manifest.list_exports(spark, f"{root}/updates"), manifest.list_exports(spark, f"{root}/target"), "backup")
    return plan.select("folder", "name", "length", "target_length", "action", "applied")


@query(Q.export_dedup())
def export_dedup(spark, sf):
    """Every series exported twice; the file queried later has smaller values and an earlier name."""
    raw = series.with_value(D.raw_events(spark, sf))
    minute = raw.withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    files = []
    for name, queried, change in (("26.12.2024", "26.12.2024 11:50", 1000), ("02.01.2025", "02.01.2025 08:00", 0)):
        lines = D.export_lines(minute.withColumns({"value": F.col("value") + change, "k": F.lit(0)}))
        path = F.regexp_replace("file_path", "_", f"_{name}_")
        query_line = F.when(F.col("line").startswith("Quelle:"), f'Datenbankabfrage:;"{queried}"').otherwise(F.col("line"))
        files.append(lines.select(path.alias("file_path"), query_line.alias("line")))
    both = files[0].unionByName(files[1])
    raw = exports.parse_export(both, exports.store_meta(both, _folder(spark, "files"))).raw
    return merge.dedup_last(raw)


@query(Q.csv_roundtrip())
def csv_roundtrip(spark, sf):
    return _export(spark, sf).raw.drop("fetched_at")


@query(Q.csv_rejects())
def csv_rejects(spark, sf):
    rejects = _export(spark, sf).rejects
    return rejects.groupBy("file_path", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(Q.station_meta())
def station_meta(spark, sf):
    meta = exports.parse_export(D.export_lines(D.raw_events(spark, sf))).meta
    return (meta.withColumn("n_fields", F.size("raw_meta").cast("bigint"))
            .withColumn("time_zone_field", F.element_at("raw_meta", "Zeitbezug")).drop("raw_meta"))


@query(Q.station_documents())
def station_documents(spark, sf):
    meta = exports.parse_export(D.export_lines(D.raw_events(spark, sf))).meta
    return sinks.station_document(meta).select(
        F.col("station.station_id").alias("station_id"), F.col("station.station_name").alias("station_name"),
        F.col("station.easting").alias("easting"),
        F.concat_ws(",", "water_level_files").alias("water_level_files"),
        F.concat_ws(",", "water_temperature_files").alias("water_temperature_files"))


@query(Q.jsonl_roundtrip())
def jsonl_roundtrip(spark, sf):
    """Readings to JSON lines and back; every line is kept, with the reason where it is rejected."""
    lines = D.live_json(D.as_gauge(D.raw_events(spark, sf)))
    options = {k: v for k, v in live.json_reader_options().items() if k != "recursiveFileLookup"}
    parsed = lines.select("event_id", "kind", F.from_json("line", live.LIVE_WITH_CORRUPT, options).alias("j"))
    return live.type_live(parsed.select("event_id", "kind", "j.*")).select(
        "event_id", F.col("station_key").alias("station_id"), "ts", "value",
        F.when(F.col("reject_reason").isNull(), F.col("parameter")).alias("parameter"), "reject_reason")


@query(Q.scalar_suite())
def scalar_suite(spark, sf):
    raw = D.as_gauge(D.raw_events(spark, sf))
    text = F.col("ts").cast("string")
    day, month, year = F.substring(text, 9, 2), F.substring(text, 6, 2), F.substring(text, 1, 4)
    minute = F.substring(text, 1, 16)
    dot, value = F.lit("."), F.col("value").cast("decimal(18,2)").cast("string")
    odd = F.col("k") % 2 == 1
    german = F.concat(day, dot, month, dot, year, F.lit(" "), F.substring(text, 12, 5))
    parts = S.live_time_parts("ts")
    return raw.select(
        "event_id",
        S.parse_ts(F.when(odd, minute).otherwise(F.concat(minute, F.lit(":x")))).alias("f01"),
        S.parse_german_ts(F.when(odd, german).otherwise(text)).alias("f02"),
        S.decimal_comma(F.when(odd, F.replace(value, dot, F.lit(","))).otherwise(F.concat(value, F.lit("f")))).alias("f03"),
        S.clean_text(F.when(odd, F.lit('""')).otherwise(F.concat(F.lit(' "'), F.col("status"), F.lit('" ')))).alias("f04"),
        S.fold_status(F.when(odd, F.lit(" Geprüft ")).otherwise(F.col("status"))).alias("f05"),
        S.meta_key(F.concat(F.lit("﻿ "), F.col("parameter"), F.lit(": "))).alias("f06"),
        S.int_or_null(F.when(odd, F.concat(F.lit(" "), F.col("k").cast("string"))).otherwise(value)).alias("f07"),
        S.day_of("ts").alias("f08"), S.hour_label("ts").alias("f09"),
        S.doy("ts").alias("f10"), F.abs(S.doy("ts") - 15).alias("f11"),
        parts["timestamp"].alias("f12"), parts["time"].alias("f12_time"), S.local_epoch("ts").alias("f13"),
        text.alias("f14"), F.coalesce(F.when(odd, F.col("status")), F.lit("")).alias("f15"),
        S.fixed("value", 2).alias("f16"), S.unit_of("parameter").alias("f19"))


@query(Q.mixed_ts())
def mixed_ts(spark, sf):
    """Each timestamp in one of five text forms, one of them unreadable, parsed back."""
    raw = D.raw_events(spark, sf)
    text, form = F.col("ts").cast("string"), F.col("k") % 5
    written = (F.when(form == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
               .when(form == 1, F.replace(text, F.lit(" "), F.lit("T")))
               .when(form == 2, F.substring(text, 1, 16)).when(form == 3, F.substring(text, 1, 10))
               .otherwise(F.concat(F.lit("am "), text)))
    return raw.select("event_id", written.alias("written"), S.mixed_ts(written).alias("ts"))


# --- pages and catalogues ------------------------------------------------------------------

@query(Q.html_cells())
def html_cells(spark, sf):
    rows = pages.html_rows(D.table(spark, sf, "pages"), "ul", "li", "a")
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"),
                       F.size("cells").cast("bigint").alias("n_cells"), F.get("cells", 0).alias("cell"))


@query(Q.html_measurements())
def html_measurements(spark, sf):
    rows = pages.html_rows(D.measurement_pages(D.raw_events(spark, sf)))
    return pages.html_measurements(rows).withColumn("pos", F.col("pos").cast("bigint"))


@query(Q.first_valid_reading())
def first_valid_reading(spark, sf):
    rows = pages.html_rows(D.measurement_pages(D.raw_events(spark, sf)))
    return pages.first_valid_reading(rows).withColumn("pos", F.col("pos").cast("bigint"))


@query(Q.response_class())
def response_class(spark, sf):
    classed = pages.classify_feed(pages.classify_response(D.responses(D.table(spark, sf, "pages"))))
    return classed.select("page_id", "response_class", "feed_class")


@query(Q.feed_links())
def feed_links(spark, sf):
    return pages.feed_links(D.pages_with_feeds(D.table(spark, sf, "pages")))


@query(Q.catalogue_values())
def catalogue_values(spark, sf):
    """The catalogue written as JSON, read back and flattened."""
    entries = D.supplier_catalogue(spark, sf)
    parsed = entries.select(F.from_json(F.to_json(F.struct(*entries.columns)), CATALOGUE).alias("s")).select("s.*")
    flat = catalogue.flatten_catalogue(parsed)
    return flat.select("uuid", "station", "water", F.col("series_no").cast("bigint").alias("series_no"), "series",
                       "unit", "interval_minutes", F.col("value_no").cast("bigint").alias("value_no"),
                       "value_shortname", F.col("value_value").try_cast("double").alias("value_number"), "value_unit")


@query(Q.catalogue_union())
def catalogue_union(spark, sf):
    """Two searches with common stations; the second one wins."""
    suppliers = D.table(spark, sf, "supplier")

    def search(keep: Column, label: str) -> DataFrame:
        return suppliers.filter(keep).select(F.col("s_suppkey").cast("string").alias("uuid"),
                                             F.concat(F.lit(label), F.col("s_name")).alias("longname"))

    return catalogue.union_catalogues(search(F.col("s_acctbal") < 6000, "first "),
                                      search(F.col("s_acctbal") > 2000, "second "))


# --- stored tables and streams -------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared directory for the tables of one run."""
    return f"{shared_dir(spark).rstrip('/')}/queries/{name}-{uuid.uuid4().hex}"


def _gauge(spark: SparkSession, sf: str) -> DataFrame:
    return D.as_gauge(D.raw_events(spark, sf))


@query(Q.stored_raw())
def raw_store(spark, sf):
    path = _folder(spark, "raw")
    sinks.write_raw(_gauge(spark, sf), path)
    return store.read_raw(spark, path)


@query(Q.stored_range(*RANGE))
def raw_store_range(spark, sf):
    """One parameter and range of a stored series: folders are pruned, the rest is pushed down."""
    path = _folder(spark, "raw")
    sinks.write_raw(_gauge(spark, sf), path)
    return store.read_raw(spark, path, "water_level_cm", start=RANGE[0], end=RANGE[1], end_inclusive_day=True)


@query(Q.daily_rollup(Q.ORDERS))
def daily_store(spark, sf):
    path = _folder(spark, "daily")
    sinks.write_daily(D.daily_orders(spark, sf), path)
    return store.read_daily(spark, path)


@query(Q.stored_live())
def live_store(spark, sf):
    """Live lines appended by date and read back for the last 31 days."""
    path = _folder(spark, "live")
    sinks.append_live(sinks.live_lines(_gauge(spark, sf), "Pegel", "table", F.lit("2024-01-31T00:00:00")), path)
    readings, _ = live.read_live(spark, path, "2024-01-31", days_back=31)
    return live.live_to_raw(readings).select(*KEYS, "ts", "value", "status", "fetched_at")


def _merged_store(spark: SparkSession, sf: str) -> refresh.Layout:
    out = refresh.Layout(_folder(spark, "merge"))
    raw = _gauge(spark, sf)
    sinks.write_raw(raw, out.raw)
    sinks.write_daily(rollup.daily_rollup(raw, D.SCALE), out.daily)
    refresh.merge_into_store(spark, D.refetched(raw), out.raw, "once", daily_path=out.daily, scale=D.SCALE)
    return out


def _merged_series(spark: SparkSession, sf: str, days: bool, runs: int = 1, compact_after: int | None = None) -> str:
    """The new readings merged into a versioned store, in runs by day of month."""
    root = _folder(spark, "series")
    raw = _gauge(spark, sf)
    series_store.load_series(spark, raw, root, D.SCALE, days)
    for run in range(runs):
        new = D.refetched(raw).filter(F.dayofmonth("ts") % runs == run)
        series_store.merge_series(spark, new, root, f"run {run}", D.SCALE, days, compact_after=compact_after)
    return root


@query(Q.merged_store())
def store_merge(spark, sf):
    """Changes laid over the base while it is read."""
    return series_store.read_series(spark, _merged_series(spark, sf, days=False)).select(*KEYS, "ts", "value", "status")


@query(Q.merged_store())
def store_compacted(spark, sf):
    """Changes of two runs, laid over the base for good after the second one."""
    root = _merged_series(spark, sf, days=False, runs=2, compact_after=2)
    return series_store.read_series(spark, root).select(*KEYS, "ts", "value", "status")


def _halves_series(spark: SparkSession, sf: str) -> str:
    """All readings in a versioned store: even events as its base, odd ones as changes."""
    root = _folder(spark, "halves")
    raw = D.raw_events(spark, sf)
    series_store.load_series(spark, raw.filter("event_id % 2 = 0"), root, D.SCALE)
    series_store.merge_series(spark, raw.filter("event_id % 2 = 1"), root, "odd", D.SCALE)
    return root


@query(Q.records())
def records_stored(spark, sf):
    """Records by way of the stored daily state; only the folders that hold them are opened."""
    return series_lookup.stored_records(spark, _halves_series(spark, sf), D.SCALE)


@query(Q.nearest_observation())
def nearest_stored(spark, sf):
    """Probes against the stored series; folders of their days and of the nearest days with a value are opened."""
    return series_lookup.stored_nearest(spark, _halves_series(spark, sf), _probes(D.raw_events(spark, sf)), D.SCALE)


@query(Q.merged_store())
def store_merge_folders(spark, sf):
    """The same merge into a plain store, whose touched folders are replaced."""
    return store.read_raw(spark, _merged_store(spark, sf).raw)


@query(Q.merged_store_daily())
def store_merge_daily(spark, sf):
    return store.read_daily(spark, _merged_store(spark, sf).daily)


@query(Q.merged_store_daily())
def daily_refresh_partials(spark, sf):
    """Daily rows from the state that the merges kept up; the series is not rolled up again."""
    return series_store.read_days(spark, _merged_series(spark, sf, days=True), D.SCALE)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream, in the raw schema.

    A stream reads folders; the pattern lets it read a table that is a single file too.
    """
    schema = D.table(spark, sf, "events").schema
    return D.as_raw(spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet"))


@query(Q.stream_dedup())
def stream_dedup(spark, sf):
    """Every reading sent twice; one of each is left."""
    root = _folder(spark, "dedup")
    sent = _event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = streams.naive(streams.dedup_stream(sent)).select(*KEYS, "ts", "value")
    (once.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start(f"{root}/rows").awaitTermination())
    return spark.read.parquet(f"{root}/rows")


@query(Q.stream_late())
def stream_late(spark, sf):
    """Readings of even events first, then all: those behind the watermark are late, those sent before repeated."""
    root = _folder(spark, "late")
    events = D.table(spark, sf, "events")
    for run, rows in ((1, events.where("event_id % 2 = 0")), (2, events)):
        rows.write.mode("append").parquet(f"{root}/sent")
        sent = D.as_raw(spark.readStream.schema(events.schema).parquet(f"{root}/sent"))
        late_streams.start_arrivals(sent, f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
    return late_streams.read_arrivals(spark, f"{root}/rows")


def _stream_partials(spark: SparkSession, sf: str, width: str) -> DataFrame:
    root = _folder(spark, "rollup")
    partials = streams.rollup_stream(streams.with_event_time(_event_stream(spark, sf)), width, D.SCALE)
    streams.start_rollup(partials, f"{root}/state", f"{root}/checkpoint", D.SCALE, available_now=True).awaitTermination()
    return streams.window_state(spark, f"{root}/state", D.SCALE)


@query(Q.daily_rollup())
def stream_daily(spark, sf):
    return rollup.daily_from_partials(_stream_partials(spark, sf, "1 day"))


@query(Q.hourly_mean())
def stream_hourly(spark, sf):
    return streams.hourly_from_partials(_stream_partials(spark, sf, "1 hour"))


@query(Q.latest_live())
def stream_current(spark, sf):
    root = _folder(spark, "current")
    current = streams.current_values(series.with_value(_event_stream(spark, sf)))
    streams.start_current(current, f"{root}/state", f"{root}/checkpoint", available_now=True).awaitTermination()
    return streams.read_current(spark, f"{root}/state")


@query(Q.merged_store())
def stream_merge(spark, sf):
    """The new readings arrive as a stream and are merged into a versioned series."""
    root = _folder(spark, "stream_merge")
    series_store.load_series(spark, _gauge(spark, sf), f"{root}/series", days=False)
    new = D.refetched(D.as_gauge(_event_stream(spark, sf)))
    streams.start_series(new, f"{root}/series", f"{root}/checkpoint", days=False, available_now=True).awaitTermination()
    return series_store.read_series(spark, f"{root}/series").select(*KEYS, "ts", "value", "status")


@query(Q.live_stream_rejects())
def live_stream_rejects(spark, sf):
    """Live lines, some cut short, without a station, from the future or without a value: all are stored or rejected."""
    root = _folder(spark, "live_rejects")
    lines = D.faulty_live_json(_gauge(spark, sf))
    lines.select("kind", "day", F.col("line").alias("value")).write.partitionBy("kind", "day").text(f"{root}/live")
    found = streams.live_lines(spark, f"{root}/live", max_files_per_trigger=20)
    streams.start_live(found, f"{root}/series", f"{root}/checkpoint", f"{root}/rejects", days=False, available_now=True).awaitTermination()
    stored = series_store.read_series(spark, f"{root}/series").select(
        F.lit("stored").alias("outcome"), "parameter", F.col("ts").cast("string").alias("ts"))
    schema = "kind string, timestamp string, reject_reason string"
    level = F.when(F.col("kind") == live.LEVEL_KIND, WATER_LEVEL).otherwise(WATER_TEMPERATURE)
    rejected = spark.read.schema(schema).json(f"{root}/rejects").select(
        F.col("reject_reason").alias("outcome"), level.alias("parameter"),
        F.when(F.col("reject_reason") != "malformed", S.mixed_ts("timestamp").cast("string")).alias("ts"))
    return stored.unionByName(rejected).groupBy("outcome", "parameter", "ts").agg(F.count(F.lit(1)).alias("n"))


@query(Q.live_stream_store())
def live_stream_store(spark, sf):
    """Readings written as JSON lines, read as a stream and merged; the oldest of them are late and stay."""
    root = _folder(spark, "live_stream")
    lines = sinks.live_lines(series.with_value(_gauge(spark, sf)), "Pegel", "table", F.lit("2024-01-31T00:00:00"))
    sinks.append_live(lines, f"{root}/live")
    stream = streams.live_stream(spark, f"{root}/live", max_files_per_trigger=20)
    streams.start_merge(stream, f"{root}/raw", f"{root}/checkpoint", available_now=True).awaitTermination()
    return store.read_raw(spark, f"{root}/raw")


@query(Q.export_stream_store())
def export_stream_store(spark, sf):
    """Export files picked up as a stream and merged; of one minute the last file's largest value stays."""
    root = _folder(spark, "export_stream")
    D.write_export_files(D.export_lines(D.raw_events(spark, sf)), f"{root}/exports")
    lines = export_streams.export_stream(spark, f"{root}/exports")
    export_streams.start_ingest(lines, f"{root}/raw", f"{root}/checkpoint", available_now=True).awaitTermination()
    return store.read_raw(spark, f"{root}/raw")
