"""Writers of tables, lines and scripts. Each makes a folder of one text part, for files that people or tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A tab-separated table with a header; empty cells for nulls and empty texts, quotes only where needed."""
    rows.coalesce(1).write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_lines(rows: DataFrame, path: str, column: str = "line", mode: str = "overwrite", head: list[str] | None = None) -> None:
    """One text a line, behind an optional head."""
    body = rows.select(F.col(column).alias("value"))
    if head:
        lines = rows.sparkSession.createDataFrame([("\n".join(head),)], "value string")
        body = lines.unionAll(body)
    body.coalesce(1).write.mode(mode).text(path)


def write_report(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as pretty JSON texts, null members included."""
    rows.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode(mode).text(path)
