"""Text payloads to columns: fixed-width lines and columnar JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (name, first character, length, type) of a station line.
STATION = (("station", 1, 11, "string"), ("latitude", 13, 8, "double"), ("longitude", 22, 9, "double"), ("name", 43, 30, "string"))


def fixed_width(lines: DataFrame, layout: tuple[tuple[str, int, int, str], ...], column: str = "value") -> DataFrame:
    """Columns cut from fixed places and trimmed; what doesn't parse is NULL."""
    return lines.select(*[F.trim(F.substring(column, first, size)).try_cast(kind).alias(name) for name, first, size, kind in layout])


def columnar(rows: DataFrame, column: str, fields: dict[str, str], root: str = "daily") -> DataFrame:
    """One row for each position of the arrays under ``root``; short arrays are NULL beyond their end, bad JSON gives no row."""
    inner = ",".join(f"`{name}`: array<{kind}>" for name, kind in fields.items())
    parsed = rows.select(F.from_json(column, f"`{root}` struct<{inner}>")[root].alias("d"))
    return parsed.select(F.arrays_zip(*[F.col(f"d.{name}") for name in fields]).alias("z")).select(F.inline("z")).toDF(*fields)
