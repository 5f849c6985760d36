"""Study search, taxonomy and resource-link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.operators import catalog
from cohortwise.registry import Query

STUDY = "cancer_study_identifier"


def taxonomy(t):
    """The taxonomy records of the sample tables, with retired codes as a list."""
    codes = F.when(F.col("replaced_csv") != "", F.split("replaced_csv", ","))
    return t.oncotree.select(
        "code", "name", "main_type", "tissue", "parent", F.col("level").cast("int").alias("level"),
        codes.alias("revocations"), F.lit(None).cast("array<string>").alias("precursors"),
    )


COUNTS = f"""
  select s.{STUDY}, s.name, s.description, s.type_of_cancer_id, count(distinct nullif(c.sample_unique_id, '')) as sample_count,
    s.{STUDY} = 'nation_1_msk_2024' as has_guide
  from cancer_study s left join clinical_data_derived c on c.{STUDY} = s.{STUDY} group by all"""

PATHS = """
with recursive walk as (
  select code as leaf, parent, [code] as steps from oncotree
  union all
  select w.leaf, o.parent, list_prepend(o.code, w.steps) from walk w join oncotree o on o.code = w.parent
  where not list_contains(w.steps, o.code))
select leaf as code, array_to_string(arg_max(steps, len(steps)), ' > ') as hierarchy from walk group by leaf"""

def coded_samples(t):
    """Samples with the code of their study; metastases have that of its subtype, and recurrences both."""
    kind = t.clinical_data_derived.where("attribute_name = 'SAMPLE_TYPE'").select(STUDY, "sample_unique_id", F.col("attribute_value").alias("kind"))
    studies = t.cancer_study.select(STUDY, "type_of_cancer_id", F.concat(F.lit("sub"), F.col("cancer_study_id").cast("string")).alias("subtype"))
    codes = F.when(F.col("kind") == "Metastasis", F.array("subtype")).when(F.col("kind") == "Primary", F.array("type_of_cancer_id")).otherwise(
        F.array("subtype", "type_of_cancer_id"))
    return kind.join(studies, STUDY).select(F.explode(codes).alias("code"), "sample_unique_id", "kind")


CODED = f"""
  select distinct upper(unnest(case attribute_value when 'Metastasis' then ['sub' || s.cancer_study_id] when 'Primary' then [type_of_cancer_id]
    else ['sub' || s.cancer_study_id, type_of_cancer_id] end)) as code, sample_unique_id, attribute_value as kind
  from clinical_data_derived c join cancer_study s on s.{STUDY} = c.{STUDY} where attribute_name = 'SAMPLE_TYPE'"""

ROLLUP = """
select * from (
with recursive up as (
  select code, code as ancestor, parent, 0 as distance from oncotree
  union all select u.code, o.code, o.parent, distance + 1 from up u join oncotree o on o.code = u.parent),
coded as ({coded}),
depths as (select code, count(*)::int as depth from up group by 1),
nearest as (select {keys}ancestor, sample_unique_id, min(distance) as distance from coded join up using (code) group by all),
found as (select {keys}ancestor as code, count(*) filter (distance = 0) as own, count(*) as total from nearest group by all)
select {all_keys}d.code, depth, coalesce(own, 0) as own, coalesce(total, 0) as total from depths d {combinations} left join found f on f.code = d.code {match})"""


SCORED = """
select t.term, o.code, o.name,
  case when q = lower(code) then 100
    when list_contains(string_split(lower(replaced_csv), ','), q) then 90
    when q = lower(name) then 80
    when starts_with(lower(code), q) then 70
    when q = lower(main_type) then 65
    when starts_with(lower(name), q) then 60
    when contains(lower(name), q) then 50
    when contains(lower(main_type), q) then 45
    when contains(lower(tissue), q) then 40 else 0 end as score,
  main_type, tissue, nullif(replaced_csv, '') as replaced_codes
from (select term, trim(lower(term)) as q from search_terms) t, oncotree o"""

TERMS = ["minerva", "slide", "image"]
STUDY_TERMS = ["image", "protocol"]


def mentions(terms: list[str]) -> str:
    return " or ".join(f"contains(lower(display_name), '{x}') or contains(lower(description), '{x}')" for x in terms)


def top(counts: str, section: str, k: int | None, detail: str = "null") -> str:
    cut = f"qualify row_number() over (partition by {STUDY} order by n desc, name) <= {k}" if k else ""
    return f"select {STUDY}, '{section}' as section, name, {detail} as detail, n as \"count\" from ({counts}) {cut}"


SECTIONS = {
    "header": f"""
      select {STUDY}, 'header' as section, unnest(['name', 'cancer_type', 'description']) as name,
        unnest([name, type_of_cancer_id, description]) as detail, null::bigint as "count" from cancer_study""",
    "counts": f"""
      select {STUDY}, 'counts' as section, 'patients' as name, null as detail, count(distinct patient_unique_id) as "count"
      from clinical_data_derived group by 1
      union all select {STUDY}, 'counts', 'samples', null, count(distinct sample_unique_id) from clinical_data_derived
      where sample_unique_id <> '' group by 1""",
    "data_types": f"""
      select distinct {STUDY}, 'data_types' as section, genetic_alteration_type as name, p.name as detail, null::bigint as "count"
      from genetic_profile p join cancer_study s using (cancer_study_id)""",
    "panels": top(
        f"select {STUDY}, gene_panel_id as name, count(distinct sample_unique_id) as n from sample_to_gene_panel_derived group by 1, 2",
        "panels", 10, "case when name = 'WES' then 'whole exome: all genes' end"),
    "attributes": top(
        f"""select {STUDY}, attribute_name as name, count(distinct nullif(sample_unique_id, '')) as n
            from clinical_data_derived group by 1, 2""", "attributes", 20),
    "top_genes": top(
        f"""select {STUDY}, hugo_gene_symbol as name, count(distinct sample_unique_id) as n from genomic_event_derived
            where variant_type = 'mutation' and mutation_status <> 'UNCALLED' group by 1, 2""", "top_genes", 10),
    "sample_types": top(
        f"""select {STUDY}, attribute_value as name, count(distinct nullif(sample_unique_id, '')) as n
            from clinical_data_derived where attribute_name = 'SAMPLE_TYPE' group by 1, 2""", "sample_types", None),
}
def profile(sections: dict[str, str]) -> str:
    """All sections with their numbers and the positions of their rows."""
    parts = " union all by name ".join(f"select *, {n} as section_no from ({s})" for n, s in enumerate(sections.values(), 1))
    return f"""select *, row_number() over (partition by {STUDY}, section_no
      order by "count" desc nulls last, name nulls first, detail nulls first) as position from ({parts})"""


def uncut(section: str) -> str:
    """A section without its limit."""
    return section.split("qualify")[0]


WHOLE = {name: uncut(text) for name, text in SECTIONS.items()}


def section(name: str, columns: str) -> str:
    return f"select {columns} from ({SECTIONS[name]})"


def words(t):
    """Data-type words as free text would have them."""
    return t.genetic_profile.select(
        F.when(F.col("datatype") == "MAF", "Mutations").when(F.col("datatype") == "DISCRETE", "CNA")
        .when(F.col("datatype") == "SV", "fusion").otherwise("unheard of").alias("word")
    )


QUERIES = {
    "k01_list_studies": Query(
        lambda t: catalog.list_studies(t, limit=10, guides=("nation_1_msk_2024",)),
        f"{COUNTS} order by sample_count desc, {STUDY} limit 10"),
    "k01_list_studies_limit_is_clamped": Query(
        lambda t: catalog.list_studies(t, limit=100000, guides=("nation_1_msk_2024",)),
        f"{COUNTS} order by sample_count desc, {STUDY} limit 100"),
    "k02_search_studies": Query(
        lambda t: catalog.list_studies(t, search="N_1", limit=100, guides=("nation_1_msk_2024",)),
        f"""select * from ({COUNTS}) where contains(lower({STUDY}), 'n_1') or contains(lower(name), 'n_1')
              or contains(lower(type_of_cancer_id), 'n_1') or contains(lower(description), 'n_1')
            order by sample_count desc, {STUDY} limit 100"""),
    "k03_resolve_studies": Query(
        lambda t: catalog.resolve_studies(t, t.requested_studies),
        f"""select requested_id, s.{STUDY}, s.{STUDY} is not null as found,
              regexp_full_match(requested_id, '[a-zA-Z0-9_-]+') as valid_id
            from requested_studies left join cancer_study s on lower(s.{STUDY}) = lower(requested_id)"""),
    "k04_similar_studies": Query(
        lambda t: catalog.similar_studies(t, t.requested_studies),
        f"""select requested_id, s.{STUDY}, s.name from requested_studies, cancer_study s
            where len(list_filter(regexp_split_to_array(lower(requested_id), '[_-]+'),
              lambda x: len(x) >= 3 and contains(lower(s.{STUDY}), x))) > 0
            qualify row_number() over (partition by requested_id order by s.{STUDY}) <= 10"""),
    "k05_study_profile": Query(lambda t: catalog.study_profile(t), profile(SECTIONS)),
    "k05_study_profile_all": Query(lambda t: catalog.study_profile(t, tops=(None, None, None)), profile(WHOLE)),
    "k05_study_profile_any_case": Query(
        lambda t: catalog.study_profile(t, "NATION_1_MSK_2024"),
        f"select * exclude ({STUDY}) from ({profile(SECTIONS)}) where {STUDY} = 'nation_1_msk_2024'"),
    "k05_study_profile_miss": Query(
        lambda t: catalog.study_profile(t, "Nation_tcga_9999"),
        f"""select 0 as section_no, 'similar_studies' as section, {STUDY} as name, name as detail, null::bigint as "count",
              row_number() over (order by {STUDY}) as position
            from cancer_study where contains(lower({STUDY}), 'nation') or contains(lower({STUDY}), 'tcga') or contains(lower({STUDY}), '9999')
            order by {STUDY} limit 10"""),
    "p4_study_panels_all": Query(lambda t: catalog.study_panels(t, k=None), f'select {STUDY}, section, name, detail, "count" from ({WHOLE["panels"]})'),
    "p5_study_attributes_all": Query(lambda t: catalog.study_attributes(t, k=None), f'select {STUDY}, section, name, "count" from ({WHOLE["attributes"]})'),
    "p6_study_top_genes_all": Query(lambda t: catalog.study_top_genes(t, k=None), f'select {STUDY}, section, name, "count" from ({WHOLE["top_genes"]})'),
    "k01_list_studies_all": Query(
        lambda t: catalog.list_studies(t, limit=None, at_most=None, guides=("nation_1_msk_2024",)), COUNTS),
    "p1_study_header": Query(
        lambda t: catalog.study_header(t), section("header", f"{STUDY}, section, name, detail")),
    "p1_study_header_any_case": Query(
        lambda t: catalog.study_header(t, "NATION_1_MSK_2024"),
        section("header", "section, name, detail") + f" where {STUDY} = 'nation_1_msk_2024'"),
    "p2_study_counts": Query(lambda t: catalog.study_counts(t), section("counts", f'{STUDY}, section, name, "count"')),
    "p3_study_data_types": Query(
        lambda t: catalog.study_data_types(t), section("data_types", f"{STUDY}, section, name, detail")),
    "p4_study_panels": Query(
        lambda t: catalog.study_panels(t), section("panels", f'{STUDY}, section, name, detail, "count"')),
    "p5_study_attributes": Query(
        lambda t: catalog.study_attributes(t), section("attributes", f'{STUDY}, section, name, "count"')),
    "p6_study_top_genes": Query(
        lambda t: catalog.study_top_genes(t), section("top_genes", f'{STUDY}, section, name, "count"')),
    "p7_study_sample_types": Query(
        lambda t: catalog.study_sample_types(t), section("sample_types", f'{STUDY}, section, name, "count"')),
    "k06_search_taxonomy": Query(
        lambda t: catalog.search_taxonomy(taxonomy(t), t.search_terms),
        f"""with paths as ({PATHS}) select s.*, hierarchy from ({SCORED}) s join paths using (code) where score > 0
            qualify row_number() over (partition by term order by score desc, code) <= 25"""),
    "k07_taxonomy_paths": Query(lambda t: catalog.taxonomy_paths(taxonomy(t)), f"select * from ({PATHS})"),
    "k07_taxonomy_rollup": Query(
        lambda t: catalog.taxonomy_rollup(taxonomy(t), coded_samples(t), "sample_unique_id"),
        ROLLUP.format(coded=CODED, keys="", all_keys="", combinations="", match="")),
    "k07_taxonomy_rollup_by_sample_type": Query(
        lambda t: catalog.taxonomy_rollup(taxonomy(t), coded_samples(t), "sample_unique_id", ["kind"]),
        ROLLUP.format(coded=CODED, keys="kind, ", all_keys="k.kind, ", combinations="cross join (select distinct kind from coded) k",
                      match="and f.kind = k.kind")),
    "k08_retired_codes": Query(
        lambda t: catalog.retired_codes(taxonomy(t)),
        """select distinct unnest(string_split(replaced_csv, ',')) as retired_code, code from oncotree where replaced_csv <> ''"""),
    "k09_study_links": Query(
        lambda t: catalog.study_links(t, STUDY_TERMS, limit=None),
        f"""select resource_id, display_name, description, resource_type, {STUDY}, url
            from resource_study join resource_definition using (resource_id) where {mentions(STUDY_TERMS)}"""),
    "k09_study_links_first_100": Query(
        lambda t: catalog.study_links(t, STUDY_TERMS, limit=100),
        f"""select resource_id, display_name, description, resource_type, {STUDY}, url
            from resource_study join resource_definition using (resource_id) where {mentions(STUDY_TERMS)}
            order by {STUDY}, display_name, url limit 100"""),
    "k10_sample_links": Query(
        lambda t: catalog.sample_links(t, TERMS, limit=None),
        f"""select resource_id, display_name, d.description, {STUDY}, {STUDY} || '_' || m.stable_id as unique_id, url
            from resource_sample r join resource_definition d using (resource_id) join sample m on m.internal_id = r.internal_id
              join patient p on p.internal_id = m.patient_id join cancer_study s on s.cancer_study_id = p.cancer_study_id
            where {mentions(TERMS).replace("description", "d.description")}"""),
    "k10_patient_links": Query(
        lambda t: catalog.patient_links(t, STUDY_TERMS, limit=None),
        f"""select resource_id, display_name, d.description, {STUDY}, {STUDY} || '_' || p.stable_id as unique_id, url
            from resource_patient r join resource_definition d using (resource_id) join patient p on p.internal_id = r.internal_id
              join cancer_study s on s.cancer_study_id = p.cancer_study_id
            where {mentions(STUDY_TERMS).replace("description", "d.description")}"""),
    "k11_resource_definitions": Query(
        lambda t: catalog.resource_definitions(t, ["minerva"]),
        f"select resource_id, display_name, description, resource_type from resource_definition where {mentions(['minerva'])}"),
    "k12_find_studies": Query(
        lambda t: catalog.find_studies(t, "Nation_2"),
        f"""select {STUDY}, name from cancer_study
            where contains(lower({STUDY}), 'nation_2') or contains(lower(name), 'nation_2')"""),
    "k13_types_catalog": Query(
        lambda t: catalog.types_catalog(t), "select type_of_cancer_id, count(*) as studies from cancer_study group by 1"),
    "k14_study_source": Query(
        lambda t: catalog.study_source(t),
        f"""select {STUDY}, 'tcga' as source from cancer_study where contains({STUDY}, '_tcga_')
            union all select {STUDY}, 'msk' from cancer_study where contains({STUDY}, '_msk_') or starts_with({STUDY}, 'msk_')
            union all select {STUDY}, 'pan_cancer_atlas' from cancer_study where contains({STUDY}, '_pan_can_')"""),
    "k15_study_urls": Query(
        lambda t: catalog.study_urls(t, "https://portal.example.org/study?id=", "https://files.example.org/"),
        f"""select {STUDY}, 'https://portal.example.org/study?id=' || {STUDY} as view_url,
              'https://files.example.org/' || {STUDY} || '.tar.gz' as download_url from cancer_study"""),
    "k16_alteration_types": Query(
        lambda t: catalog.alteration_types(words(t)),
        """select case datatype when 'MAF' then 'Mutations' when 'DISCRETE' then 'CNA' when 'SV' then 'fusion' else 'unheard of' end as word,
             case when datatype <> 'CONTINUOUS' then genetic_alteration_type end as genetic_alteration_type
           from genetic_profile"""),
}
