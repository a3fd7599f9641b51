"""Rows through a child process."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def stream_through(rows: DataFrame, command: str, schema: str) -> DataFrame:
    """Each partition's rows as tab-separated lines to the command's input; its output lines are the rows of the result."""
    # A string literal of SQL, inside a template whose braces are names.
    quoted = command.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}")
    columns = ", ".join(f"`{c}`" for c in rows.columns)
    names = ", ".join(re.sub(r"^\s*(\S+)\s+(.+?)\s*$", r"\1 \2", f) for f in schema.split(","))
    sql = f"SELECT TRANSFORM({columns}) ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\t' USING '{quoted}' AS ({names}) ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\t' FROM {{rows}}"
    return rows.sparkSession.sql(sql, rows=rows)
