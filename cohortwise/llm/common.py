"""Helpers of the operators that concern Spark: row keys, lineage cuts, folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortwise.session import shared_dir


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, **options) -> DataFrame:
    """`df` written to the shared folder and read back, so that later steps do not recompute it. `options` are the writer's."""
    path = scratch(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """`df` without its lineage, by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one number, from which group counts are derived."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a vocabulary file installed with `public_tokenizers`, read by the driver."""
    import public_tokenizers

    from cohortwise.llm.bpe import read_ranks

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
