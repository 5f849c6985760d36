"""Preparation of a cloned database: column clean-up, comments, taxonomy, cohorts, storage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.plans.scope import STUDY

# Columns by which the large tables are clustered: range-partitioned and sorted, so that
# row-group statistics prune by study and gene. The last column is close to unique, which
# lets the range partitioner cut through a study or gene that holds much of the table.
CLUSTERED = {
    "genomic_event_derived": [STUDY, "hugo_gene_symbol", "sample_unique_id"],
    "clinical_data_derived": ["attribute_name", STUDY, "patient_unique_id", "sample_unique_id"],
    "sample_to_gene_panel_derived": [STUDY, "sample_unique_id"],
    "genetic_alteration_derived": [STUDY, "hugo_gene_symbol", "sample_unique_id"],
    "sample_expression": [STUDY, "hugo_gene_symbol", "sample_unique_id"],
    "clinical_event_derived": [STUDY, "event_type", "key", "patient_id", "clinical_event_id"],
}

# Low-cardinality columns that every query of the table filters on, stored as folders.
FOLDERS = {
    "genomic_event_derived": ["variant_type"],
    "sample_to_gene_panel_derived": ["alteration_type"],
    "genetic_alteration_derived": ["profile_type"],
    "sample_expression": ["profile_type"],
    "cancer_study_query_preferences": ["preference_name"],
}

# Meaning of the columns people most often get wrong.
COMMENTS = {
    "sample": {
        "internal_id": "Key of the sample.",
        "stable_id": "Id within the study; study id, underscore and this id form sample_unique_id.",
        "patient_id": "The sample's patient: patient.internal_id.",
    },
    "patient": {
        "internal_id": "Key of the patient.",
        "stable_id": "Id within the study; study id, underscore and this id form patient_unique_id.",
        "cancer_study_id": "The patient's study: cancer_study.cancer_study_id.",
    },
    "clinical_data_derived": {
        "sample_unique_id": "Sample id unique over studies; empty on patient-level rows.",
        "patient_unique_id": "Patient id unique over studies; set on rows of both levels.",
        "attribute_name": "Attribute, such as SAMPLE_TYPE, CANCER_TYPE, AGE or OS_MONTHS.",
        "attribute_value": "Value as text; convert before comparing as a number.",
        "type": "Level of the row: sample or patient.",
    },
    "genomic_event_derived": {
        "variant_type": "mutation, cna or structural_variant; filter on it in every query.",
        "hugo_gene_symbol": "Gene symbol.",
        "mutation_status": "Somatic, Germline, UNKNOWN or UNCALLED; leave UNCALLED out of counts.",
        "off_panel": "1 where the gene is not on the sample's panel; frequencies use 0 only.",
        "cna_alteration": "Copy-number level from -2 (deep deletion) to 2 (amplification); NULL for other events.",
        "mutation_variant": "Protein change, such as p.V600E; NA for other events.",
    },
    "cancer_study": {
        "cancer_study_identifier": "Study id to filter on.",
        "cancer_study_id": "Internal number of the study.",
        "name": "Full name of the study.",
    },
    "type_of_cancer": {
        "main_type": "Broad group the type belongs to.",
        "tissue": "Tissue of origin.",
        "level": "Depth in the taxonomy; 1 is the tissue.",
        "revocations": "Retired codes this code took over.",
        "precursors": "Earlier codes merged into this code.",
    },
}


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Without the named columns; absent ones are ignored."""
    return df.drop(*columns)


def comment_columns(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """The same rows with `comment` metadata on the named columns that exist."""
    for column, text in comments.items():
        if column in df.columns:
            df = df.withMetadata(column, {**df.schema[column].metadata, "comment": text})
    return df


def column_comments(df: DataFrame) -> DataFrame:
    """One row per column: name, type, comment (NULL without one), and how many rows have a value."""
    fields = [
        F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.lit(f.metadata.get("comment")).cast("string").alias("comment"), F.col(f"`_{i}`").alias("present"))
        for i, f in enumerate(df.schema)
    ]
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(df.schema)])
    return counts.select(F.inline(F.array(*fields)))


def enrich_cancer_types(types: DataFrame, onco: DataFrame) -> DataFrame:
    """Cancer types with taxonomy fields, matched by lower-case code.

    Only fields the taxonomy supplies are set: other rows and fields keep what they have.
    """
    fields = {"main_type": "string", "tissue": "string", "level": "smallint",
              "revocations": "array<string>", "precursors": "array<string>"}
    fresh = onco.select(
        F.lower("code").alias("type_of_cancer_id"),
        *[F.col(f).cast(kind).alias(f"_new_{f}") for f, kind in fields.items()],
    )
    # an empty text or list counts as not supplied
    supplied = {
        f: F.when(F.size(f"_new_{f}") > 0, F.col(f"_new_{f}")) if kind.startswith("array")
        else F.nullif(F.col(f"_new_{f}"), F.lit("")) if kind == "string"
        else F.col(f"_new_{f}")
        for f, kind in fields.items()
    }
    old = {f: F.col(f) if f in types.columns else F.lit(None).cast(kind) for f, kind in fields.items()}
    kept = [c for c in types.columns if c not in fields]
    return types.join(fresh, "type_of_cancer_id", "left").select(
        *kept, *[F.coalesce(supplied[f], old[f]).alias(f) for f in fields]
    )


def cohort_by_pattern(t, name: str, like: str, note: str = "pattern-detected") -> DataFrame:
    """Cohort of the studies whose id matches a LIKE pattern (`_` is any one character)."""
    return t.cancer_study.where(F.col(STUDY).like(like)).select(
        F.lit(name).alias("preference_name"), STUDY, F.lit(note).alias("notes")
    )


def cohort_by_rows(t, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Literal (preference, study, note) rows, kept only where the study exists."""
    wanted = t.spark.createDataFrame(list(rows), f"preference_name string, {STUDY} string, notes string")
    return wanted.join(t.cancer_study, STUDY, "left_semi").select("preference_name", STUDY, "notes")


def cohort_by_ids(t, name: str, ids: Iterable[str], note: str = "curated set") -> DataFrame:
    """Cohort of the listed study ids that exist; a repeated id counts once."""
    return cohort_by_rows(t, [(name, study, note) for study in dict.fromkeys(ids)])


def preferences(*cohorts: DataFrame) -> DataFrame:
    """One preferences table from several cohorts; rows are appended, not merged."""
    first, *rest = cohorts
    for cohort in rest:
        first = first.unionByName(cohort)
    return first


def prepare(t, steps: Iterable[tuple[str, str, Callable]]):
    """Run (file-like name, table, step) in the order of the numeric name prefix.

    A step takes the tables prepared so far and returns the new content of its table.
    Steps of one deployment follow the portable ones: give them names under a folder.
    """

    def order(name: str) -> tuple[int, int, str]:
        folder, _, leaf = name.rpartition("/")
        return (1 if folder else 0, int(leaf.split("-", 1)[0]), leaf)

    for _, table, step in sorted(steps, key=lambda s: order(s[0])):
        t = t.replace(**{table: step(t)})
    return t


def read_table(spark, path: str, name: str) -> DataFrame:
    """A stored table with the values and types it was written with; those of folder columns are texts.

    A filter on a folder column is evaluated on the folders' names, so it still skips folders.
    """
    folders = FOLDERS.get(name, [])
    table = spark.read.parquet(path)
    if not folders:
        return table
    fields = [T.StructField(f.name, T.StringType()) if f.name in folders else f for f in table.schema]
    stored = spark.read.schema(T.StructType(fields)).parquet(path)
    return stored.withColumns({f: _from_folder(F.col(f)) for f in folders})


#: Marks a folder's text that would be read as missing as it is. Fixed value: the folder name of a missing one.
MARK, MISSING = "=", "__HIVE_DEFAULT_PARTITION__"


def _to_folder(value: Column) -> Column:
    """A folder cannot tell an empty text from a missing one: such texts, and those that begin like one, are marked."""
    text = value.cast("string")
    return F.when((text == "") | (text == MISSING) | text.startswith(MARK), F.concat(F.lit(MARK), text)).otherwise(text)


def _folder(value: Column) -> Column:
    """Name of the value's folder, never missing: Spark replaces a column that may be by another one, and then sorts anew by it alone."""
    return F.coalesce(_to_folder(value), F.lit(MISSING))


def _from_folder(name: Column) -> Column:
    return F.when(name.startswith(MARK), F.substring(name, len(MARK) + 1, 1 << 30)).otherwise(name)


def write_table(df: DataFrame, path: str, name: str, partitions: int | None = None) -> None:
    """Store one table as Parquet in its layout; an existing copy is replaced.

    `partitions` is the number of ranges a clustered table is cut into, at best its size
    over 200 MB; the default is `spark.sql.shuffle.partitions`, made fewer by AQE.
    """
    clustered, folders = CLUSTERED.get(name, []), FOLDERS.get(name, [])
    df = df.withColumns({f: _folder(F.col(f)) for f in folders})
    if clustered:
        order = [*folders, *clustered]
        ranged = df.repartitionByRange(*order) if partitions is None else df.repartitionByRange(partitions, *order)
        # on the folders' names themselves, as the writer would else sort by them, and Spark drops an order below another
        df = ranged.sortWithinPartitions(*order)
    df.write.mode("overwrite").partitionBy(*folders).parquet(path)


def write(t, directory: str, names: Iterable[str], partitions: dict[str, int] | None = None) -> None:
    """Store the named tables under `directory`; `load` reads them back."""
    for name in names:
        write_table(getattr(t, name), f"{directory}/{name}", name, (partitions or {}).get(name))
