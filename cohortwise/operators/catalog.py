"""Finding studies, disease codes and linked resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortwise.functions.labels import alteration_type, study_sources
from cohortwise.functions.text import id_tokens, substrings
from cohortwise.functions.values import contains_any, present
from cohortwise.operators.frequency import altered_events
from cohortwise.plans.ranking import null_safe_join, top_per_group
from cohortwise.plans.scope import STUDY, by_study, distinct_counts
from cohortwise.session import shared_dir

SAMPLE = "sample_unique_id"


def list_studies(
    t, search: str | None = None, limit: int | None = 20, at_most: int | None = 100, guides: tuple[str, ...] = ()
) -> DataFrame:
    """Studies by number of samples; `search` looks in id, name, type and description.

    The report shows `limit` studies, at least one and no more than `at_most`; None lifts either bound.
    """
    studies = t.cancer_study
    if search:
        studies = studies.where(contains_any([STUDY, "name", "type_of_cancer_id", "description"], [search]))
    # samples are counted per study before the join; a study without rows counts 0
    rows = t.clinical_data_derived.join(studies.select(STUDY), STUDY, "left_semi") if search else t.clinical_data_derived
    counts = rows.groupBy(STUDY).agg(F.count_distinct(present(SAMPLE)).alias("sample_count"))
    listed = (
        studies.join(counts, STUDY, "left")
        .select(
            STUDY, "name", "description", "type_of_cancer_id",
            F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
            F.col(STUDY).isin(*guides).alias("has_guide") if guides else F.lit(False).alias("has_guide"),
        )
    )
    bounds = [b for b in (limit, at_most) if b is not None]
    return listed.orderBy(F.desc("sample_count"), F.asc(STUDY)).limit(max(1, min(bounds))) if bounds else listed


def resolve_studies(t, requested: DataFrame) -> DataFrame:
    """Each requested id with the study as the data spells it; NULL where there is none."""
    wanted = requested.select("requested_id").distinct()
    known = t.cancer_study.select(STUDY, F.lower(STUDY).alias("_key"))
    return (
        wanted.withColumn("_key", F.lower("requested_id"))
        .join(known, "_key", "left")
        .select(
            "requested_id", STUDY, F.col(STUDY).isNotNull().alias("found"),
            F.col("requested_id").rlike("^[a-zA-Z0-9_-]+$").alias("valid_id"),
        )
    )


def similar_studies(t, requested: DataFrame, limit: int | None = 10) -> DataFrame:
    """Studies whose id contains a part of the requested id, the first `limit` by id (None: all).

    Study ids are indexed by their substrings, so the search is an equi-join on the part.
    Only the first `limit` studies of a part can be among the first of a request, so the
    index is cut to them and a part that every id has brings no more rows than others.
    """
    index = t.cancer_study.select(STUDY, "name", F.explode(substrings(F.lower(STUDY), 3)).alias("token"))
    if limit is not None:
        index = top_per_group(index, ["token"], [F.asc(STUDY)], limit)
    parts = (
        requested.select("requested_id").distinct()
        .select("requested_id", F.explode(F.array_distinct(id_tokens(F.col("requested_id")))).alias("token"))
    )
    hits = parts.join(index, "token").select("requested_id", STUDY, "name").distinct()
    return hits if limit is None else top_per_group(hits, ["requested_id"], [F.asc(STUDY)], limit)


TABLES_OF_SECTIONS = ("clinical_data_derived", "sample_to_gene_panel_derived", "genomic_event_derived")


def study_profile(t, study: str | None = None, tops: tuple[int | None, int | None, int | None] = (10, 20, 10)) -> DataFrame:
    """Overview of studies as rows (section_no, section, position, name, detail, count).

    `study` is found whatever its case, and all sections use the id as the data spells it. For an unknown id the
    rows are those of section `similar_studies`: ids that share a part with it. Positions number a
    section's rows, the largest count first, ties by name. `tops` cuts the panels, attributes and
    genes; None keeps all.
    """
    keys, all_studies = [STUDY], t.cancer_study
    if study is not None:
        wanted = t.cancer_study.where(F.lower(STUDY) == study.lower())
        one = wanted.select(STUDY)
        t = t.replace(cancer_study=wanted, **{name: getattr(t, name).join(one, STUDY, "left_semi") for name in TABLES_OF_SECTIONS})
    panels, attributes, genes = tops
    counts = study_counts(t)
    if study is not None:  # a study without rows has counts of 0
        named = wanted.select(STUDY, _section("counts"), F.explode(F.array(F.lit("patients"), F.lit("samples"))).alias("name"))
        counts = named.join(counts.drop("section"), [STUDY, "name"], "left").fillna(0, ["count"])
    sections = [
        study_header(t), counts, study_data_types(t), study_panels(t, k=panels),
        study_attributes(t, k=attributes), study_top_genes(t, k=genes), study_sample_types(t),
    ]
    shaped = []
    for number, section in enumerate(sections, 1):
        have = set(section.columns)
        shaped.append(section.select(
            *keys, F.lit(number).alias("section_no"), "section", "name",
            F.col("detail") if "detail" in have else F.lit(None).cast("string").alias("detail"),
            F.col("count").cast("bigint") if "count" in have else F.lit(None).cast("bigint").alias("count"),
        ))
    rows, *rest = shaped
    for section in rest:
        rows = rows.unionByName(section)
    order = W.partitionBy(*keys, "section_no").orderBy(F.desc_nulls_last("count"), "name", "detail")
    rows = rows.withColumn("position", F.row_number().over(order))
    if study is None:
        return rows
    asked = t.spark.createDataFrame([(study, study.lower())], "requested_id string, _key string")
    missing = asked.join(wanted.select(F.lower(STUDY).alias("_key")), "_key", "left_anti")
    near = similar_studies(t.replace(cancer_study=all_studies), missing)
    near = near.select(
        F.lit(0).alias("section_no"), F.lit("similar_studies").alias("section"), F.col(STUDY).alias("name"), F.col("name").alias("detail"),
        F.lit(None).cast("bigint").alias("count"), F.row_number().over(W.partitionBy("requested_id").orderBy(STUDY)).alias("position"))
    return rows.drop(STUDY).unionByName(near)


def _section(title: str) -> Column:
    return F.lit(title).alias("section")


def study_header(t, study: str | None = None) -> DataFrame:
    """Name, disease code and description of the study, ignoring the case of the id asked for."""
    studies, keys = t.cancer_study, [STUDY]
    if study is not None:
        studies, keys = studies.where(F.lower(STUDY) == study.lower()), []
    return studies.select(
        *keys, _section("header"),
        F.expr("stack(3, 'name', name, 'cancer_type', type_of_cancer_id, 'description', description) as (name, detail)"),
    )


def study_counts(t, study: str | None = None) -> DataFrame:
    rows, keys = by_study(t.clinical_data_derived, study)
    counts = distinct_counts(rows, keys, {"patients": F.col("patient_unique_id"), "samples": present(SAMPLE)})
    return counts.select(
        *keys, _section("counts"), F.expr("stack(2, 'patients', patients, 'samples', samples) as (name, `count`)")
    )


def study_data_types(t, study: str | None = None) -> DataFrame:
    studies, keys = by_study(t.cancer_study, study)
    profiles = t.genetic_profile.select(
        "cancer_study_id", F.col("genetic_alteration_type"), F.col("datatype"), F.col("name").alias("profile")
    )
    return (
        profiles.join(studies.select("cancer_study_id", STUDY), "cancer_study_id")
        .select(*keys, "genetic_alteration_type", "datatype", "profile")
        .distinct()
        .select(*keys, _section("data_types"), F.col("genetic_alteration_type").alias("name"), F.col("profile").alias("detail"))
    )


def _largest(counts: DataFrame, keys: list[str], title: str, k: int | None) -> DataFrame:
    """Section of (name, count) rows, the `k` largest of each study."""
    order = [F.desc("count"), F.asc("name")]
    if k is not None:
        counts = top_per_group(counts, keys, order, k) if keys else counts.orderBy(*order).limit(k)
    return counts.withColumn("section", F.lit(title))


def study_panels(t, study: str | None = None, k: int | None = 10) -> DataFrame:
    """Panels by number of samples, the first `k` of each study (None: all)."""
    rows, keys = by_study(t.sample_to_gene_panel_derived, study)
    counts = rows.groupBy(*keys, F.col("gene_panel_id").alias("name")).agg(F.count_distinct(SAMPLE).alias("count"))
    return _largest(counts, keys, "panels", k).withColumn(
        "detail", F.when(F.col("name") == "WES", "whole exome: all genes")
    )


def study_attributes(t, study: str | None = None, k: int | None = 20) -> DataFrame:
    """Attributes by number of samples, the first `k` of each study (None: all)."""
    rows, keys = by_study(t.clinical_data_derived, study)
    counts = rows.groupBy(*keys, F.col("attribute_name").alias("name")).agg(
        F.count_distinct(present(SAMPLE)).alias("count")
    )
    return _largest(counts, keys, "attributes", k)


def study_top_genes(t, study: str | None = None, k: int | None = 10) -> DataFrame:
    """The `k` most often mutated genes of each study (None: all); off-panel calls are counted here, unlike in the frequencies."""
    rows, keys = by_study(altered_events(t, on_panel=False), study)
    counts = rows.groupBy(*keys, F.col("hugo_gene_symbol").alias("name")).agg(F.count_distinct(SAMPLE).alias("count"))
    return _largest(counts, keys, "top_genes", k)


def study_sample_types(t, study: str | None = None) -> DataFrame:
    rows, keys = by_study(t.clinical_data_derived, study)
    counts = (
        rows.where(F.col("attribute_name") == "SAMPLE_TYPE")
        .groupBy(*keys, F.col("attribute_value").alias("name"))
        .agg(F.count_distinct(present(SAMPLE)).alias("count"))
    )
    return _largest(counts, keys, "sample_types", None)


def taxonomy_index(onco: DataFrame) -> DataFrame:
    """(needle, code, score): every lower-case text that finds a code, with its best rule.

    The rules form a descending scale, so the first rule that matches is the one with the
    highest score. With the index, searching any number of terms is one equi-join.
    """
    code, name, main, tissue = (F.lower(F.coalesce(c, F.lit(""))) for c in ("code", "name", "main_type", "tissue"))

    def scored(texts: Column, score: int) -> Column:
        return F.transform(texts, lambda x: F.struct(x.alias("needle"), F.lit(score).alias("score")))

    def prefixes(text: Column) -> Column:
        lengths = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
        return F.transform(F.coalesce(lengths, F.array().cast("array<int>")), lambda n: F.substring(text, 1, n))

    # Score of each rule.
    rules = [
        scored(F.array(code), 100),
        scored(F.transform(_retired(), F.lower), 90),
        scored(F.array(name), 80),
        scored(prefixes(code), 70),
        scored(F.array(main), 65),
        scored(prefixes(name), 60),
        scored(substrings(name), 50),
        scored(substrings(main), 45),
        scored(substrings(tissue), 40),
    ]
    return (
        onco.where(F.col("code").isNotNull())
        .select("code", F.explode(F.concat(*rules)).alias("rule"))
        .groupBy(F.col("rule.needle").alias("needle"), "code")
        .agg(F.max("rule.score").alias("score"))
    )


def _retired() -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce("revocations", none), F.coalesce("precursors", none))


def search_taxonomy(onco: DataFrame, terms: DataFrame, limit: int | None = 25) -> DataFrame:
    """For each distinct term the codes it finds, best score first, with path and retired codes.

    Ranking and cutting happen in the index, which is as large as the taxonomy; the table of
    terms only looks its needles up. Blank terms find nothing.
    """
    best = taxonomy_index(onco)
    if limit is not None:
        best = top_per_group(best, ["needle"], [F.desc("score"), F.asc("code")], limit)
    retired = F.when(F.size(_retired()) > 0, F.array_join(_retired(), ","))
    details = onco.select("code", "name", "main_type", "tissue", retired.alias("replaced_codes")).join(
        taxonomy_paths(onco), "code", "left"
    )
    needle = F.lower(F.btrim("term", F.lit(" \t\n\r\f\v")))
    wanted = terms.select("term").distinct().withColumn("needle", needle).where(F.col("needle") != "")
    return (
        wanted.join(best.join(details, "code"), "needle")
        .select("term", "code", "name", "score", "main_type", "tissue", "hierarchy", "replaced_codes")
    )


def taxonomy_paths(onco: DataFrame) -> DataFrame:
    """(code, hierarchy): `ROOT > .. > CODE`; a path ends at an unknown parent or before a code it already has."""
    return _paths(onco).select("code", F.array_join(F.reverse("path"), " > ").alias("hierarchy"))


def taxonomy_closure(onco: DataFrame) -> DataFrame:
    """(code, ancestor, distance): each code with itself, at 0, its parent, at 1, and so on to the root."""
    return _paths(onco).select("code", F.posexplode("path").alias("distance", "ancestor")).select("code", "ancestor", "distance")


def taxonomy_rollup(onco: DataFrame, coded: DataFrame, unit: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, code, depth, own, total) for every code of the taxonomy: units that carry it, and units that carry it or a code below.

    `coded` has (keys, code, unit); codes are compared in upper case. A unit with several codes counts once per ancestor, however many
    of its codes lie below it. Codes without units are listed with zeros, for each combination of keys that occurs. A root has
    depth 1. Units are made distinct per ancestor before they are counted, so the root is counted by many tasks.
    """
    keys = keys or []
    closure = taxonomy_closure(onco)
    carried = coded.where(F.col(unit).isNotNull()).select(*keys, F.upper("code").alias("_code"), unit).distinct()
    reached = carried.join(closure.withColumn("_code", F.upper("code")), "_code")
    nearest = reached.groupBy(*keys, "ancestor", unit).agg(F.min("distance").alias("_distance"))
    found = nearest.groupBy(*keys, "ancestor").agg(F.count(F.when(F.col("_distance") == 0, 1)).alias("own"), F.count("*").alias("total"))
    codes = closure.groupBy("code").agg(F.count("*").cast("int").alias("depth"))
    if keys:  # every combination with every code: the taxonomy is one small list
        every = codes.agg(F.collect_list(F.struct("code", "depth"))).scalar()
        codes = coded.select(*keys).distinct().select(*keys, F.explode(every).alias("_c")).select(*keys, "_c.code", "_c.depth")
    found = found.withColumnRenamed("ancestor", "code")
    return null_safe_join(codes, found, [*keys, "code"], "left").fillna(0, ["own", "total"]).select(*keys, "code", "depth", "own", "total")


def _paths(onco: DataFrame) -> DataFrame:
    """(code, path): the codes from each code up to its root.

    Paths are doubled: each round joins a path's upper end with the path of that code, so a tree
    of depth d is done after log2(d) rounds, each one join of a row per code, checkpointed. The
    driver only learns whether a path is still open.
    """
    codes = onco.where(F.col("code").isNotNull()).select("code", "parent").dropDuplicates(["code"])
    known = codes.select(F.col("code").alias("_known"))
    # `up`: the next code above the path, NULL at its end
    paths = codes.join(known, F.col("parent") == F.col("_known"), "left").select(
        "code", F.array("code").alias("path"), F.when(F.col("parent") != F.col("code"), F.col("_known")).alias("up"))
    shared_dir(onco.sparkSession)
    while True:  # ends, because an open path doubles and is cut when it meets itself
        paths = paths.checkpoint()
        if paths.where("up is not null").isEmpty():
            break
        above = paths.select(F.col("code").alias("_code"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        joined = paths.join(above, F.col("up") == F.col("_code"), "left")
        # a path that meets itself is cut before the first code it already has
        meets = F.arrays_overlap("path", "_path")
        first = F.array_min(F.transform(F.array_intersect("_path", "path"), lambda c: F.array_position("_path", c)))
        part = F.when(meets, F.slice("_path", F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(F.col("_path"))
        paths = joined.select(
            "code", F.when(F.col("_code").isNull(), F.col("path")).otherwise(F.concat("path", part)).alias("path"),
            F.when(~F.coalesce(meets, F.lit(False)), F.col("_up")).alias("up"))
    return paths.select("code", "path")


def retired_codes(onco: DataFrame) -> DataFrame:
    """(retired_code, code): codes no longer in use and what replaced them."""
    return onco.select(F.explode(_retired()).alias("retired_code"), "code").distinct()


def _defined(t, terms: list[str]) -> DataFrame:
    return t.resource_definition.where(contains_any(["display_name", "description"], terms))


def study_links(t, terms: list[str], limit: int | None = None) -> DataFrame:
    """Study-level links to resources that mention a term."""
    links = (
        t.resource_study.join(_defined(t, terms), "resource_id")
        .select("resource_id", "display_name", "description", "resource_type", STUDY, "url")
    )
    return links if limit is None else links.orderBy(STUDY, "display_name", "url").limit(limit)


def _owner_links(t, owners: DataFrame, links: DataFrame, terms: list[str], limit: int | None) -> DataFrame:
    rows = (
        links.join(_defined(t, terms), "resource_id")
        .join(owners, "internal_id")
        .select("resource_id", "display_name", "description", STUDY, "unique_id", "url")
    )
    return rows if limit is None else rows.orderBy(STUDY, "display_name", "unique_id", "url").limit(limit)


def _with_study(t) -> DataFrame:
    return t.patient.join(t.cancer_study.select("cancer_study_id", STUDY), "cancer_study_id")


def sample_links(t, terms: list[str], limit: int | None = None) -> DataFrame:
    """Sample-level links to resources that mention a term."""
    patients = _with_study(t).select(F.col("internal_id").alias("patient_id"), STUDY)
    owners = t.sample.join(patients, "patient_id").select(
        "internal_id", STUDY, F.concat_ws("_", STUDY, "stable_id").alias("unique_id")
    )
    return _owner_links(t, owners, t.resource_sample, terms, limit)


def patient_links(t, terms: list[str], limit: int | None = None) -> DataFrame:
    """Patient-level links to resources that mention a term."""
    owners = _with_study(t).select("internal_id", STUDY, F.concat_ws("_", STUDY, "stable_id").alias("unique_id"))
    return _owner_links(t, owners, t.resource_patient, terms, limit)


def resource_definitions(t, terms: list[str]) -> DataFrame:
    """Resources whose name or description mentions a term."""
    return _defined(t, terms).select("resource_id", "display_name", "description", "resource_type")


def find_studies(t, term: str) -> DataFrame:
    """Studies with the term in name or id."""
    return t.cancer_study.where(contains_any(["name", STUDY], [term])).select(STUDY, "name")


def types_catalog(t) -> DataFrame:
    """Number of studies per disease code."""
    return t.cancer_study.groupBy("type_of_cancer_id").agg(F.count("*").alias("studies"))


def study_source(t) -> DataFrame:
    """(study, source): sources the study id points at, one row each."""
    return t.cancer_study.select(STUDY, F.explode(study_sources(STUDY)).alias("source"))


def study_urls(t, view_base: str, download_base: str) -> DataFrame:
    """Links to view a study and to download its archive, under the given addresses."""
    return t.cancer_study.select(
        STUDY,
        F.concat(F.lit(view_base), STUDY).alias("view_url"),
        F.concat(F.lit(download_base), STUDY, F.lit(".tar.gz")).alias("download_url"),
    )


def alteration_types(words: DataFrame) -> DataFrame:
    """(word, genetic_alteration_type) of the data-type words in a table; NULL when unknown."""
    return words.select("word", alteration_type("word").alias("genetic_alteration_type"))
