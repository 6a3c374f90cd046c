"""Parsers from text readings to typed columns. What can't be read is null, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes that say what a reading's text tells.
SKY_CODES = ["CLR", "FEW", "SCT", "BKN", "OVC", "VV"]
PRESENT_WEATHER = {
    "Drizzle": ["DZ"],
    "Rain": ["RA"],
    "Snow": ["SN"],
    "SnowGrains": ["SG"],
    "IceCrystals": ["IC"],
    "Hail": ["PL", "GR", "GS", "HAIL", "|27", "SH:"],
    "Mist": ["BR"],
    "Fog": ["FG"],
    "Smoke": ["FU"],
    "Dust": ["FU", "VA", "DU", "SA", "PO", "PY", "SS", "DS"],
    "Haze": ["HZ"],
    "Storm": ["SQ", "FC", "TS"],
}
CARRIER_DELAYS = {
    "infrequent": ["HA", "AS", "DL", "US", "YX", "OO"],
    "frequent": ["G4", "NK", "WN", "VX", "F9", "B6"],
}


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is null)."""
    return F.when(condition, 1).otherwise(0)


def number(text: Column) -> Column:
    return text.try_cast("double")


def before(text: Column, mark: str) -> Column:
    """What stands before the first `mark`."""
    return F.substring_index(text, mark, 1)


def suffix_num(text: Column, sep: str = "s") -> Column:
    """A number that a suspect mark may follow."""
    return number(before(text, sep))


def visibility(text: Column) -> Column:
    return number(before(before(text, "s"), "V"))


def precip(text: Column) -> Column:
    """Precipitation: traces and missing count as 0, of up to three amounts run together the largest by text counts."""
    x = F.regexp_replace(F.regexp_replace(before(text, "s"), "T", "0"), r"\*", "0")
    top = lambda n: F.greatest(*[F.substring(x, 1 + n * k, n) for k in range(3)])
    picked = F.when(F.length(x) % 4 == 0, top(4)).when(F.length(x) % 5 == 0, top(5)).otherwise(x)
    return F.coalesce(number(picked), F.lit(0.0))


def precip_flags(text: Column, amount: Column | None = None) -> tuple[Column, Column]:
    """Whether there is a trace, and whether there is anything at all."""
    trace = F.coalesce(text.contains("T"), F.lit(False))
    return flag(trace), flag(trace | ((precip(text) if amount is None else amount) > 0))


def tendency_flags(text: Column) -> dict[str, Column]:
    """Pressure increasing, decreasing or constant, by the code of the tendency."""
    code = number(text)
    return {"increasing": flag(code <= 3), "decreasing": flag(code >= 5), "constant": flag(code == 4)}


def wind_dir(text: Column) -> tuple[Column, Column]:
    """Direction in degrees (variable: null), and whether it is calm."""
    return number(F.when(text != "VRB", before(text, "s"))), flag(text == "000")


def contains_flags(text: Column, codes: list[str]) -> dict[str, Column]:
    return {c: flag(text.contains(c)) for c in codes}


def contains_any_flags(text: Column, groups: dict[str, list[str]]) -> dict[str, Column]:
    return {name: flag(reduce(lambda a, b: a | b, [text.contains(c) for c in codes])) for name, codes in groups.items()}


# Packed fields, by name of each part, and for numbers what they are divided by (None: text).
ISD_FIELDS = {
    "WND": [("angle", None), ("angle_quality", 1), ("type", None), ("speed", 10), ("speed_quality", None)],
    "CIG": [("height", 1), ("quality", None), ("determination", None), ("cavok", None)],
    "VIS": [("distance", 1), ("quality", None), ("variability", None), ("variability_quality", None)],
    "TMP": [("value", 10), ("quality", None)],
    "DEW": [("value", 10), ("quality", None)],
    "SLP": [("value", 10), ("quality", None)],
    "AA1": [("hours", 1), ("depth", 10), ("condition", None), ("quality", None)],
}


def isd_fields(df: DataFrame, fields: dict[str, list] | None = None) -> DataFrame:
    """Comma-packed columns as typed ones named field_part; missing parts are null, packed columns go."""
    out = {}
    for field, parts in (fields or ISD_FIELDS).items():
        if field in df.columns:
            cut = F.split(F.col(field), ",")
            for i, (part, scale) in enumerate(parts):
                text = F.get(cut, F.lit(i))
                out[f"{field.lower()}_{part}"] = text if scale is None else number(text) / scale
    return df.withColumns(out).drop(*(fields or ISD_FIELDS))


def code_flags(codes: list[Column], groups: dict[str, list[str]]) -> dict[str, Column]:
    """By name, whether any of several code columns has one of the codes."""
    return {name: flag(F.arrays_overlap(F.array(*codes), F.lit(values))) for name, values in groups.items()}


def coords(text: Column) -> tuple[Column, Column]:
    """(lon, lat) of "lon, lat"."""
    cut = F.split(text, ",")
    return tuple(number(F.trim(F.get(cut, F.lit(i)))) for i in (0, 1))


def hhmm(clock: Column) -> Column:
    """A clock time as four digits."""
    return F.lpad(clock.cast("string"), 4, "0")


def dep_hour(clock: Column) -> Column:
    """The hour of a clock time such as 905."""
    return hhmm(clock).substr(1, 2).try_cast("int")


def categorize(value: Column, groups: dict[str, list], default: str) -> Column:
    """The name of the first group that lists the value."""
    out = None
    for name, values in groups.items():
        out = F.when(value.isin(values), name) if out is None else out.when(value.isin(values), name)
    return out.otherwise(default) if out is not None else F.lit(default)


def band(value: Column, edges: list[float]) -> Column:
    """The number of edges that are at most the value: 0 below the first."""
    return F.when(value.isNotNull(), sum((flag(value >= e) for e in edges), F.lit(0)))


def recode(value: Column, names: dict, default: Column | None = None) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(value if default is None else default)
