"""Ad-hoc read-only SQL over the tables, and the sparse shape its rows are returned in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.session import shared_dir


def select(t, sql: str, args: dict | None = None, tables: list[str] = ()) -> DataFrame:
    """Result of one SELECT (CTEs allowed) over the named tables; `args` fill `:name` markers.

    The text is placed in a subquery, so a statement that is not a query does not parse.
    """
    for name in tables:
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark.sql(f"select * from (\n{sql.strip().rstrip(';')}\n)", args=args or {})


def run_select(t, sql: str, args: dict | None = None, tables: list[str] = ()) -> dict:
    """{"rows": DataFrame of sparse JSON rows} or {"error_message": text}.

    The query runs here, once; its rows are checkpointed in the cluster's shared folder, so an error
    in a row is a message as well and reading the rows cannot fail.
    """
    shared_dir(t.spark)
    try:
        return {"rows": sparse_json(select(t, sql, args, tables)).checkpoint()}
    except Exception as error:
        return {"error_message": str(error)}


def sparse_json(df: DataFrame) -> DataFrame:
    """One JSON text per row without the fields that are NULL or empty text; 0 and false stay."""
    fields = [
        F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    return df.select(F.to_json(F.struct(*fields)).alias("row"))
