"""The disease taxonomy file: an array of records with codes, names and parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """code string, name string, mainType string, tissue string, parent string, level int,
            revocations array<string>, precursors array<string>"""


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy records of a JSON array file, normalised."""
    return normalize_taxonomy(spark.read.schema(SCHEMA).json(path, multiLine=True))


def normalize_taxonomy(raw: DataFrame) -> DataFrame:
    """The eight known fields, sorted by code; empty texts and empty lists become NULL."""
    texts = {"code": "code", "name": "name", "mainType": "main_type", "tissue": "tissue", "parent": "parent"}
    return raw.select(
        *[F.nullif(F.col(c), F.lit("")).alias(name) for c, name in texts.items()],
        "level",
        *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("revocations", "precursors")],
    ).orderBy("code")
