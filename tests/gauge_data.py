"""Small inputs for the tests, written from plain values."""

from __future__ import annotations

import datetime as dt

from gaugeworks.schema import RAW

STATION = 90001234

# Half a day of quarter-hour levels in cm, and temperatures in tenths of a degree, from a formula.
LEVELS = [200 + (7 * i * i + 3 * i) % 23 for i in range(48)]
TENTHS = [100 + (5 * i * i + i) % 17 for i in range(51)]

PREAMBLE = [
    "\ufeffQuelle:;\"Pegeldienst, www.example.org\"",
    "Datenbankabfrage:;\"03.04.2031 07:20\"",
    "Zeitbezug:;MEZ",
    "Messstellen-Name:;Beispielstadt",
    f"Messstellen-Nr.:;{STATION}",
    "Gewässer:;Musterbach",
]


def clock(i: int) -> str:
    return (dt.datetime(2031, 4, 3) + dt.timedelta(minutes=15 * i)).strftime("%Y-%m-%d %H:%M")


def level_lines() -> list[str]:
    head = [*PREAMBLE, 'Ostwert:;400100;Nordwert:;5200200;"Musternetz 1"',
            'Pegelnullpunktshöhe:;"123,45 m MH"', "", 'Datum;"Wasserstand [cm]";Prüfstatus']
    return head + [f'"{clock(i)}";{v},00;Rohdaten' for i, v in enumerate(LEVELS)]


def temperature_lines() -> list[str]:
    head = [*PREAMBLE, 'Ostwert:;400300;Nordwert:;5200400;"Musternetz 1"', "",
            'Datum;"Wassertemperatur [°C]";Prüfstatus']
    rows = [f'"{clock(i)}";{v // 10},{v % 10};Rohdaten' for i, v in enumerate(TENTHS)]
    return [*head, *rows, f'"{clock(len(TENTHS))}";;Rohdaten']


def write_exports(root) -> str:
    for folder, lines in (("wasserstand", level_lines()), ("bach-wassertemperatur", temperature_lines())):
        path = root / folder
        path.mkdir(parents=True, exist_ok=True)
        (path / f"{STATION}_03.04.2031_ezw_0.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(root)


def ts(text: str | None) -> dt.datetime | None:
    return None if text is None else dt.datetime.fromisoformat(text)


def raw_rows(spark, rows, station: int = 1, parameter: str = "water_level_cm"):
    """Raw frame from (timestamp text, value, status) tuples."""
    data = [(station, parameter, ts(t), None if v is None else float(v), s) for t, v, s in rows]
    return spark.createDataFrame(data, RAW)
