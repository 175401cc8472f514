"""Tables in versions: changes beside a base, and one small file that says what counts (K5, ST3, ST5, ST6).

A run writes its own rows into a folder of its own and then one list of the folders that
make up the next version. The list is a single file, which a file system shows whole
or not at all, so a reader sees the version before or the one after, and a run that dies
leaves folders that no list names. Readers lay the changes over the base; ``compact``
does so for good, for the folders that have changes. Files are never changed, and are
removed by ``vacuum`` only. Runs on one store follow one another.

The stations of a period lie in as many folders as its rows need, noted in the list as a
depth. A first load counts its rows; later a period gets more folders when it is
compacted, so that base and changes always have the same ones.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.plans import observed
from gaugeworks.operators.merge import lay_over
from gaugeworks.sinks.store import counted_depths, grouped, laid_out, period_key

NOTE = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("table", T.StringType()), T.StructField("gen", T.LongType()),
    T.StructField("part", T.StringType()), T.StructField("is_base", T.BooleanType()), T.StructField("n_rows", T.LongType()),
    T.StructField("depths", T.MapType(T.StringType(), T.IntegerType()))])
RUNS_KNOWN = 100
"""Runs that a version remembers; a stream repeats its last batch only."""


class Table(NamedTuple):
    """What a table holds: columns, those that tell its rows apart, its folders, and the order inside files; ``place`` adds the folder columns but ``bucket``."""

    schema: T.StructType
    keys: list[str]
    folders: list[str]
    place: Callable[[DataFrame], DataFrame]
    order: list[str]

    @property
    def stored(self) -> T.StructType:
        known = self.schema.fieldNames()
        return T.StructType([*self.schema.fields, *[T.StructField(c, T.IntegerType()) for c in self.folders if c not in known]])


class Part(NamedTuple):
    """A folder that counts: all of what a run wrote to a table, or one folder of it.

    ``depths`` names the periods that got more folders with this part.
    """

    table: str
    gen: int
    part: str | None
    is_base: bool
    n_rows: int
    depths: dict[str, int] = {}


class Version(NamedTuple):
    number: int
    runs: list[str]
    parts: list[Part]

    def of(self, name: str) -> list[Part]:
        return [p for p in self.parts if p.table == name]

    def depths(self, name: str) -> dict[str, int]:
        """Depth of each period that has more than one folder; it only ever grows."""
        found: dict[str, int] = {}
        for part in self.of(name):
            found |= {p: max(d, found.get(p, 0)) for p, d in part.depths.items()}
        return found


def _names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Versions whose list is there as a whole; the folder of one that is being written has no list yet."""
    found = [int(n.partition("=")[2]) for n in _names(spark, f"{root}/versions") if n.startswith("number=")]
    return sorted(n for n in found if any(x.endswith(".json") for x in _names(spark, f"{root}/versions/number={n}")))


def latest(spark: SparkSession, root: str) -> Version:
    """The version that counts now; version 0 is an empty store."""
    number = max(_numbers(spark, root), default=0)
    if not number:
        return Version(0, [], [])
    notes = spark.read.schema(NOTE).json(f"{root}/versions/number={number}").collect()  # one row per folder and known run
    runs = [n["run_id"] for n in notes if n["run_id"] is not None]
    parts = [Part(n["table"], n["gen"], n["part"], n["is_base"], n["n_rows"], n["depths"] or {}) for n in notes if n["table"] is not None]
    return Version(number, runs, parts)


def _announce(spark: SparkSession, root: str, version: Version) -> None:
    """The list of a version as one file; what a run left that died here has no file yet and goes."""
    rows = [(run, None, None, None, None, None, None) for run in version.runs[-RUNS_KNOWN:]] + [(None, *p) for p in version.parts]
    spark.createDataFrame(rows, NOTE).coalesce(1).write.mode("overwrite").json(f"{root}/versions/number={version.number}")


def _data(root: str, name: str) -> str:
    return f"{root}/data/{name}"


def write(spark: SparkSession, root: str, name: str, table: Table, rows: DataFrame, now: Version, is_base: bool = False,
          grown: dict[str, int] | None = None) -> Part:
    """Rows into a folder of their own, which the version after ``now`` is to name; what an earlier try left there goes.

    They go to the station groups of ``now``, but for periods that are ``grown``. The rows
    of a base that is the first of its table are counted by period, to choose the groups.
    """
    gen = now.number + 1
    path = f"{_data(root, name)}/gen={gen}"
    placed = table.place(rows.select(table.schema.fieldNames()))
    if grown is None:
        grown = counted_depths(placed, table.folders) if is_base and "bucket" in table.folders and not now.of(name) else {}
    seen = Observation()
    placed = grouped(placed, table.folders, now.depths(name) | grown).observe(seen, F.count(F.lit(1)).alias("n"))
    (laid_out(placed, table.folders, table.order).write.mode("overwrite").option("compression", "zstd")
     .partitionBy(*table.folders).parquet(path))
    return Part(name, gen, None, is_base, observed(seen, "n") or 0, grown)


def folders_of(spark: SparkSession, root: str, name: str, table: Table, part: Part) -> list[str]:
    """The folders of a part, as they are called in paths."""
    if part.part is not None:
        return [part.part]
    path = f"{_data(root, name)}/gen={part.gen}"
    mark = f"/gen={part.gen}/"
    files = spark.read.schema(table.stored).parquet(path).inputFiles() if part.n_rows else []
    return sorted({unquote(f).split(mark, 1)[1].rsplit("/", 1)[0] for f in files})


def _scan(spark: SparkSession, root: str, name: str, table: Table, parts: list[Part]) -> DataFrame:
    schema = T.StructType([*table.stored.fields, T.StructField("gen", T.LongType())])
    paths = [f"{_data(root, name)}/gen={p.gen}" + (f"/{p.part}" if p.part else "") for p in parts if p.n_rows]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", _data(root, name)).parquet(*paths)


def _latest_changes(changes: DataFrame, table: Table, runs: int) -> DataFrame:
    """One row per key: that of the last run. A run has no key twice."""
    columns = table.stored.fieldNames()
    if runs < 2:
        return changes.select(columns)
    rest = [c for c in columns if c not in table.keys]
    last = changes.groupBy(*table.keys).agg(F.max_by(F.struct(*rest), "gen").alias("r"))
    return last.select(*[F.col(c) if c in table.keys else F.col(f"r.{c}").alias(c) for c in columns])


def read(spark: SparkSession, root: str, name: str, table: Table, version: Version | None = None,
         only: list[str] | None = None) -> DataFrame:
    """A version of a table (by default the latest) with its folder columns; ``only`` names the folders to open.

    What it reads stays as it is while later runs publish. Filters on folder columns
    reach base and changes alike.
    """
    parts = (version or latest(spark, root)).of(name)
    if only is not None:
        wanted = set(only)
        parts = [p._replace(part=f) for p in parts for f in folders_of(spark, root, name, table, p) if f in wanted]
    base, changes = [p for p in parts if p.is_base], [p for p in parts if not p.is_base]
    stored = _scan(spark, root, name, table, base).select(table.stored.fieldNames())
    if not changes:
        return stored
    rows = {p.gen: p.n_rows for p in changes}
    last = _latest_changes(_scan(spark, root, name, table, changes), table, len(rows))
    # A key lies in one folder; naming the folder too lets filters on folders reach both sides of the join.
    return lay_over(stored, last, [*table.keys, *[c for c in table.folders if c not in table.keys]], sum(rows.values()))


def touched(rows: DataFrame, table: Table, depths: dict[str, int]) -> list[str]:
    """Folders of ``rows`` by their names in paths: a row per folder reaches the driver."""
    found = grouped(table.place(rows), table.folders, depths).select(*[F.col(c).cast("string") for c in table.folders]).distinct().collect()
    return ["/".join(f"{c}={_escaped(r[c])}" for c in table.folders) for r in found]


def _escaped(value: str) -> str:
    """A folder value as Spark writes it."""
    special = set('"#%\'*/:=?\\\x7f{[]^') | {chr(i) for i in range(1, 32)}
    return "".join(f"%{ord(c):02X}" if c in special else c for c in value)


def publish(spark: SparkSession, root: str, tables: dict[str, Table], changes: dict[str, DataFrame], run_id: str,
            base: bool = False) -> Version:
    """Writes the rows of a run, each key once per table, and makes them the next version of all its tables at once.

    A run that is repeated changes nothing. ``base`` is for a first load; later rows with
    the same keys then lie over it.
    """
    now = latest(spark, root)
    if run_id in now.runs:
        return now
    return announce(spark, root, now, [write(spark, root, name, tables[name], rows, now, base) for name, rows in changes.items()], run_id)


def announce(spark: SparkSession, root: str, now: Version, written: list[Part], run_id: str) -> Version:
    """The version after ``now``, with what a run has written for it; a run without rows leaves ``now`` as it is."""
    if not any(p.n_rows for p in written):
        return now
    version = Version(now.number + 1, [*now.runs, run_id], [*now.parts, *[p for p in written if p.n_rows]])
    _announce(spark, root, version)
    return version


def changes_waiting(version: Version) -> int:
    """Runs whose changes still lie beside the base."""
    return len({p.gen for p in version.parts if not p.is_base})


def _grown(spark: SparkSession, root: str, name: str, table: Table, now: Version, held: list[tuple[Part, list[str]]], changed: set[str]) -> dict[str, int]:
    """Periods with changes that need more folders than they have, by their rows; files are not read beyond their footers."""
    if "bucket" not in table.folders:
        return {}
    periods, known = {period_key(f) for f in changed}, now.depths(name)
    parts = [p._replace(part=f) for p, folders in held for f in folders if period_key(f) in periods]
    needed = counted_depths(_scan(spark, root, name, table, parts), table.folders)
    return {p: d for p, d in needed.items() if d > known.get(p, 0)}


def compact(spark: SparkSession, root: str, tables: dict[str, Table]) -> Version:
    """Lays all changes over the base for good; folders without changes keep their files.

    A period that has outgrown its folders is written anew as a whole, with more of them.
    """
    now = latest(spark, root)
    if not changes_waiting(now):
        return now
    parts = []
    for name, table in tables.items():
        known = now.of(name)
        if all(p.is_base for p in known):
            parts += known
            continue
        held = {i: folders_of(spark, root, name, table, p) for i, p in enumerate(known)}
        changed = {f for i, p in enumerate(known) if not p.is_base for f in held[i]}
        grown = _grown(spark, root, name, table, now, [(p, held[i]) for i, p in enumerate(known)], changed)
        changed |= {f for folders in held.values() for f in folders if period_key(f) in grown}
        for i, part in enumerate(known):
            kept = [f for f in held[i] if f not in changed] if part.is_base else []
            # Depths are noted with the part that is written now, for what is left of an older one may go.
            parts += [part._replace(depths={})] if part.is_base and kept == held[i] else [part._replace(part=f, depths={}) for f in kept]
        rows = read(spark, root, name, table, now, sorted(changed))
        written = write(spark, root, name, table, rows, now, True, grown)
        parts.append(written._replace(depths=now.depths(name) | grown))
    version = Version(now.number + 1, now.runs, parts)
    _announce(spark, root, version)
    return version


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes what none of the last ``keep`` versions names, and returns it; readers of older versions lose their files."""
    numbers = _numbers(spark, root)
    kept, last = numbers[-keep:], numbers[-1] if numbers else 0
    used = {(r["table"], r["gen"]) for n in kept for r in spark.read.schema(NOTE).json(f"{root}/versions/number={n}").collect()}
    gone = [f"{root}/versions/number={n}" for n in numbers if n not in kept]
    for name in _names(spark, f"{root}/data"):
        gens = [int(g.partition("=")[2]) for g in _names(spark, _data(root, name)) if g.startswith("gen=")]
        gone += [f"{_data(root, name)}/gen={g}" for g in gens if g <= last and (name, g) not in used]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone
