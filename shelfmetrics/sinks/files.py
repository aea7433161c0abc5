"""Exports: CSV in the two house styles, and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmetrics.plans.workspace import sized_by


def write_report_csv(report: DataFrame, path: str) -> None:
    """Comma-separated, with missing values spelled ``NULL`` and empty text left empty."""
    report.write.csv(path, header=True, nullValue="NULL", emptyValue="", escape='"')


LINE_END = "\r\n"
#: Columns of these types are written bare.
BARE_TYPES = (T.NumericType, T.BooleanType)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _field(column: Column, kind: T.DataType) -> Column:
    """A missing value is an empty field, an empty text a pair of quotes."""
    text = column.cast("string")
    return F.coalesce(text if isinstance(kind, BARE_TYPES) else _quoted(text), F.lit(""))


def table_lines(table: DataFrame) -> DataFrame:
    """Each row as one line: text, dates and times in quotes, numbers bare."""
    fields = [_field(table[f"`{f.name}`"], f.dataType) for f in table.schema.fields]
    return table.select(F.concat_ws(";", *fields).alias("line"))


def write_table_csv(table: DataFrame, path: str) -> None:
    """Semicolon-separated with Windows line ends, as the cleaned tables are handed on.

    Spark's CSV writer quotes all fields or those that need it, so the lines are made here. Each
    file begins with the quoted names, before its task's first line; a table without rows
    leaves no line.
    """
    names = ";".join('"' + name.replace('"', '""') + '"' for name in table.columns)
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    headed = F.when(row_in_task == 0, F.concat(F.lit(names + LINE_END), "line")).otherwise(F.col("line"))
    table_lines(table).select(headed.alias("line")).write.text(path, lineSep=LINE_END)


def write_table_parquet(table: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = table.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_master(master: DataFrame, path: str) -> None:
    """One folder per quality flag, so that readers of clean rows open nothing else."""
    write_table_parquet(sized_by(master, "data_flag"), path, partition_by="data_flag")
