"""Input tables: read from Parquet, projected from the sample schema, or prepared once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortwise.session import shared_dir, start_wide
from cohortwise.sources import prep, projection


class Tables:
    """Named DataFrames, each made on first use: `t.clinical_data_derived`."""

    def __init__(self, spark: SparkSession, get: Callable[[str], DataFrame], directory: str | None = None):
        self.spark = spark
        self.directory = directory
        self._get = get
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._get(name)
        return self._frames[name]

    def replace(self, **frames: DataFrame) -> Tables:
        """The same tables with some of them replaced or added."""
        return Tables(
            self.spark, lambda name: frames[name] if name in frames else getattr(self, name), self.directory
        )

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> Tables:
        def get(name: str) -> DataFrame:
            if name not in frames:
                raise AttributeError(f"no table {name}")
            return frames[name]

        return cls(spark, get)


def load(spark: SparkSession, directory: str) -> Tables:
    """Tables stored as `directory/<name>` (a prepared folder) in Parquet."""
    return Tables(spark, lambda name: prep.read_table(spark, f"{directory}/{name}", name), directory)


def _files(directory: str) -> dict[str, str]:
    return {n: f"select * from parquet.`{directory}/{n}.parquet`" for n in projection.BASE_TABLES}


def project(spark: SparkSession, directory: str) -> Tables:
    """Cohort tables as lazy projections of the sample Parquet files in `directory`."""

    def get(name: str) -> DataFrame:
        if name in projection.BASE_TABLES:
            return spark.read.parquet(f"{directory}/{name}.parquet")
        return spark.sql(projection.with_tables(f"select * from {name}", "spark", _files(directory)))

    return Tables(spark, get, directory)


_written: set[str] = set()
_rows: dict[str, int] = {}

#: The tables that grow fastest, from which the large derived ones are made.
LARGEST = ("lineitem", "orders", "events", "embeddings")


#: Derived where they are read, not stored: rows of their parents in another form, so that to sort, write and read them
#: again costs more than to derive them.
IN_PLACE = ("sample_expression",)


def warehouse(spark: SparkSession, directory: str) -> Tables:
    """`project`, with each table written once per application to the shared folder.

    Derived tables are joined, clustered and stored on first use, as the data model wants
    them; later queries read physical columns and can skip row groups by study and gene. A
    table is derived from the stored copies of the tables it builds on. Those of IN_PLACE are derived anew by each query.
    """
    digest = hashlib.md5(directory.encode()).hexdigest()[:12]
    root = f"{shared_dir(spark)}/cohortwise/{spark.sparkContext.applicationId}/{digest}"
    definitions = projection.texts("spark")
    if root not in _rows:  # counted from the files' footers
        _rows[root] = max((spark.read.parquet(f"{directory}/{n}.parquet").count() for n in LARGEST), default=0)
    partitions = start_wide(spark, _rows[root])

    def parents(name: str) -> set[str]:
        """Stored tables that this one is derived from."""
        direct = projection.mentioned(definitions[name], set(definitions) - {name})
        return {p for parent in direct for p in (parents(parent) if parent in IN_PLACE else {parent})}

    def derived(name: str) -> DataFrame:
        copies = {parent: f"select * from parquet.`{stored(parent)}`" for parent in sorted(parents(name))}
        return spark.sql(projection.with_tables(f"select * from {name}", "spark", {**_files(directory), **copies}))

    def stored(name: str) -> str:
        path = f"{root}/{name}"
        if path not in _written:
            prep.write_table(derived(name), path, name, partitions)
            _written.add(path)
        return path

    def get(name: str) -> DataFrame:
        if name in projection.BASE_TABLES:
            return spark.read.parquet(f"{directory}/{name}.parquet")
        return derived(name) if name in IN_PLACE else prep.read_table(spark, stored(name), name)

    return Tables(spark, get, directory)
