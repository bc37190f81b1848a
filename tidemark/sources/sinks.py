"""Results as text: CSV, JSON lines and a table for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars


def csv_lines(rows: DataFrame) -> DataFrame:
    """One ``line`` a row, cells quoted only where they must be; ``csv_header`` gives the first line."""
    return rows.select(F.concat_ws(",", *[scalars.csv_cell(F.col(f"`{c}`")) for c in rows.columns]).alias("line"))


def csv_header(rows: DataFrame) -> str:
    return ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if set(c) & set(',"\n') else c for c in rows.columns)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def as_table(rows: DataFrame, most: int = 100) -> str:
    """The first ``most`` rows, in columns."""
    return rows._show_string(most, False, False)
