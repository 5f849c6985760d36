"""The cohort tables as projections of the sample star schema, one SQL text per table.

The text means the same in Spark SQL and DuckDB (except the unnest of `embeddings`), so a
check can build the same inputs in both. Tables are named by their role in the data model.
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "cancer_study": """
select n.n_nationkey as cancer_study_id,
  lower(n.n_name) || case when n.n_nationkey % 3 = 0 then '_tcga_pan_can_atlas_2018' else '_msk_2024' end as cancer_study_identifier,
  n.n_name || ' (' || r.r_name || ')' as name, 'Cohort from ' || r.r_name as description,
  'nat' || cast(n.n_nationkey as string) as type_of_cancer_id
from nation n join region r on n.n_regionkey = r.r_regionkey
""",
    "patient": """
select c_custkey as internal_id, 'P' || cast(c_custkey as string) as stable_id, c_nationkey as cancer_study_id from customer
""",
    "sample": """
select o_orderkey as internal_id, 'S' || cast(o_orderkey as string) as stable_id, o_custkey as patient_id from orders
""",
    "sample_patient": """
select o.o_orderkey as sample_id, cs.cancer_study_identifier || '_S' || cast(o.o_orderkey as string) as sample_unique_id,
  cs.cancer_study_identifier || '_P' || cast(c.c_custkey as string) as patient_unique_id, cs.cancer_study_identifier,
  cast(substr(o.o_orderpriority, 1, 1) as int) as panel_no, o.o_orderstatus, o.o_totalprice, c.c_mktsegment, c.c_nationkey
from orders o join customer c on o.o_custkey = c.c_custkey join cancer_study cs on c.c_nationkey = cs.cancer_study_id
""",
    "gene": """
select distinct p_partkey % 50 as entrez_gene_id, 'GENE' || cast(p_partkey % 50 as string) as hugo_gene_symbol from part
""",
    "gene_panel": """
select distinct cast(substr(o_orderpriority, 1, 1) as int) as internal_id, 'PANEL' || substr(o_orderpriority, 1, 1) as stable_id
from orders where substr(o_orderpriority, 1, 1) <> '1'
""",
    "gene_panel_list": """
select gp.internal_id, g.entrez_gene_id as gene_id from gene_panel gp join gene g on g.entrez_gene_id % 6 < gp.internal_id
""",
    "sample_to_gene_panel_derived": """
select sp.sample_unique_id, sp.cancer_study_identifier, a.alteration_type,
  case when sp.panel_no = 1 then 'WES' else 'PANEL' || cast(sp.panel_no as string) end as gene_panel_id
from sample_patient sp
join (select 'MUTATION_EXTENDED' as alteration_type, 10 as lim union all select 'COPY_NUMBER_ALTERATION', 8 union all select 'STRUCTURAL_VARIANT', 5) a
  on sp.sample_id % 10 < a.lim
""",
    "genomic_event_derived": """
select sp.sample_unique_id, sp.patient_unique_id, sp.cancer_study_identifier,
  'GENE' || cast(l.l_partkey % 50 as string) as hugo_gene_symbol, l.l_partkey % 50 as entrez_gene_id,
  case l.l_returnflag when 'A' then 'mutation' when 'N' then 'cna' else 'structural_variant' end as variant_type,
  case when l.l_returnflag <> 'A' then 'NA' when l.l_linenumber % 5 = 0 then 'UNCALLED' when l.l_linenumber % 5 = 1 then 'Germline'
       when l.l_linenumber % 5 = 2 then 'UNKNOWN' else 'Somatic' end as mutation_status,
  case when l.l_returnflag = 'A' then 'p.V' || cast(l.l_suppkey % 10 as string) || 'E' else 'NA' end as mutation_variant,
  case when l.l_returnflag <> 'A' then 'NA' when l.l_suppkey % 7 = 0 then 'Missense_Mutation' when l.l_suppkey % 7 = 1 then 'Nonsense_Mutation'
       when l.l_suppkey % 7 = 2 then 'Frame_Shift_Ins' when l.l_suppkey % 7 = 3 then 'Frame_Shift_Del' when l.l_suppkey % 7 = 4 then 'In_Frame_Del'
       when l.l_suppkey % 7 = 5 then 'Splice_Site' else 'Silent' end as mutation_type,
  case when l.l_returnflag = 'N' then cast(floor(l.l_quantity) as int) % 5 - 2 end as cna_alteration,
  case when sp.panel_no = 1 or (l.l_partkey % 50) % 6 < sp.panel_no then 0 else 1 end as off_panel
from lineitem l join sample_patient sp on l.l_orderkey = sp.sample_id
""",
    "clinical_data_derived": """
select sample_unique_id, patient_unique_id, cancer_study_identifier, 'CANCER_TYPE' as attribute_name, c_mktsegment as attribute_value, 'sample' as type from sample_patient
union all select sample_unique_id, patient_unique_id, cancer_study_identifier, 'CANCER_TYPE_DETAILED', c_mktsegment || ' subtype ' || cast(sample_id % 3 as string), 'sample' from sample_patient
union all select sample_unique_id, patient_unique_id, cancer_study_identifier, 'SAMPLE_TYPE', case o_orderstatus when 'F' then 'Primary' when 'O' then 'Metastasis' else 'Local Recurrence' end, 'sample' from sample_patient
union all select sample_unique_id, patient_unique_id, cancer_study_identifier, 'TMB_NONSYNONYMOUS', case when sample_id % 13 = 0 then 'NA' else cast(cast(floor(o_totalprice / 10000) as int) as string) end, 'sample' from sample_patient
union all select sample_unique_id, patient_unique_id, cancer_study_identifier, 'TUMOR_PURITY', '0.' || cast(1 + sample_id % 9 as string), 'sample' from sample_patient
union all select sample_unique_id, patient_unique_id, cancer_study_identifier, 'PLATFORM', case when sample_id % 2 = 0 then 'Illumina HiSeq' else 'Ion Torrent' end, 'sample' from sample_patient
union all select '', cs.cancer_study_identifier || '_' || p.stable_id, cs.cancer_study_identifier, 'SEX', case when p.internal_id % 2 = 0 then 'Female' else 'Male' end, 'patient' from patient p join cancer_study cs on p.cancer_study_id = cs.cancer_study_id
union all select '', cs.cancer_study_identifier || '_' || p.stable_id, cs.cancer_study_identifier, 'AGE', case when p.internal_id % 17 = 0 then 'NA' else cast(20 + p.internal_id % 70 as string) end, 'patient' from patient p join cancer_study cs on p.cancer_study_id = cs.cancer_study_id
union all select '', cs.cancer_study_identifier || '_' || p.stable_id, cs.cancer_study_identifier, 'OS_MONTHS', cast(1 + (p.internal_id * 7) % 120 as string), 'patient' from patient p join cancer_study cs on p.cancer_study_id = cs.cancer_study_id
union all select '', cs.cancer_study_identifier || '_' || p.stable_id, cs.cancer_study_identifier, 'OS_STATUS', case when p.internal_id % 3 = 0 then '1:DECEASED' else '0:LIVING' end, 'patient' from patient p join cancer_study cs on p.cancer_study_id = cs.cancer_study_id
""",
    "clinical_attribute_meta": """
select distinct cs.cancer_study_id, cd.attribute_name as attr_id, 'Attribute ' || cd.attribute_name as description, cd.type = 'patient' as patient_attribute
from clinical_data_derived cd join cancer_study cs on cd.cancer_study_identifier = cs.cancer_study_identifier
""",
    "cancer_study_query_preferences": """
select 'pan_cancer_tcga' as preference_name, cancer_study_identifier, 'pattern-detected' as notes from cancer_study where cancer_study_identifier like '%_tcga_pan_can_atlas_2018'
union all select 'all_studies_non_redundant', cancer_study_identifier, 'all studies' from cancer_study
union all select p.preference_name, p.cancer_study_identifier, 'single study' from
  (select 'large_genomic_cohort' as preference_name, 'nation_1_msk_2024' as cancer_study_identifier union all select 'absent_cohort', 'no_such_study') p
  where p.cancer_study_identifier in (select cancer_study_identifier from cancer_study)
""",
    "genetic_profile": """
select cs.cancer_study_id, t.genetic_alteration_type, t.datatype, t.genetic_alteration_type || ' of ' || cs.name as name
from cancer_study cs join (select 'MUTATION_EXTENDED' as genetic_alteration_type, 'MAF' as datatype, 1 as m
  union all select 'COPY_NUMBER_ALTERATION', 'DISCRETE', 2 union all select 'MRNA_EXPRESSION', 'CONTINUOUS', 3
  union all select 'STRUCTURAL_VARIANT', 'SV', 4) t on cs.cancer_study_id % t.m = 0
""",
    "clinical_event": """
select event_id as clinical_event_id, user_id as patient_id,
  case event_type when 'click' then 'Treatment' when 'view' then 'TREATMENT' when 'purchase' then 'Sequencing' when 'signup' then 'SURGERY' else 'Diagnosis' end as event_type,
  cast(day(ts) as int) - 1 as start_date, cast(day(ts) as int) + 6 as stop_date
from events
""",
    "clinical_event_data": """
select event_id as clinical_event_id, 'AGENT' as key, 'AGENT' || cast(cast(substr(props, 7, length(props) - 7) as int) % 12 as string) as value from events where event_type in ('click', 'view')
union all select event_id, 'SUBTYPE', case cast(substr(props, 7, length(props) - 7) as int) % 4 when 0 then 'Chemo' when 1 then 'Immuno' when 2 then 'Targeted' else 'Hormone' end from events where event_type in ('click', 'view') and event_id % 5 <> 0
""",
    "clinical_event_derived": """
select s.cancer_study_identifier, p.internal_id as patient_id, s.cancer_study_identifier || '_' || p.stable_id as patient_unique_id,
  e.clinical_event_id, e.event_type, e.start_date, d.key, d.value
from clinical_event e join patient p on p.internal_id = e.patient_id join cancer_study s on s.cancer_study_id = p.cancer_study_id
  left join clinical_event_data d on d.clinical_event_id = e.clinical_event_id
""",
    "oncotree": """
select 'REG' || cast(r_regionkey as string) as code, r_name as name, r_name || ' Tumor' as main_type, r_name as tissue, cast(null as string) as parent, 1 as level, '' as replaced_csv from region
union all select 'NAT' || cast(n.n_nationkey as string), n.n_name, r.r_name || ' Tumor', r.r_name, 'REG' || cast(n.n_regionkey as string), 2, case when n.n_nationkey % 5 = 0 then 'OLD' || cast(n.n_nationkey as string) || ',ALL' else '' end from nation n join region r on n.n_regionkey = r.r_regionkey
union all select 'SUB' || cast(n_nationkey as string), n_name || ' subtype', 'Subtype', n_name, 'NAT' || cast(n_nationkey as string), 3, '' from nation
""",
    "resource_definition": """
select distinct 'R' || cast(page_id % 4 as string) as resource_id, case page_id % 4 when 0 then 'Minerva Viewer' when 1 then 'Pathology Slide' when 2 then 'CT Image' else 'Protocol PDF' end as display_name, 'linked page' as description, case when page_id % 4 < 2 then 'SAMPLE' else 'STUDY' end as resource_type from pages
""",
    "resource_sample": """
select 'R' || cast(page_id % 4 as string) as resource_id, page_id as internal_id, url from pages where page_id % 4 < 2
""",
    "resource_study": """
select 'R' || cast(p.page_id % 4 as string) as resource_id, cs.cancer_study_identifier, p.url from pages p join cancer_study cs on p.page_id % 25 = cs.cancer_study_id where p.page_id % 4 >= 2
""",
    "spans": """
select event_id as span_id, ts, event_type as tool_name, event_type <> 'error' as success,
  case when user_id % 3 = 0 then 'librechat' else 'direct' end as client_kind,
  case when cast(substr(props, 7, length(props) - 7) as int) % 5 = 0 then null else 'client_' || cast(cast(substr(props, 7, length(props) - 7) as int) % 5 as string) end as client_name,
  case when user_id % 3 = 0 then cast(user_id as string) end as enduser_id,
  'sess_' || cast(user_id as string) || '_' || cast(day(ts) as string) as session_id, '10.0.0.' || cast(user_id % 40 as string) as client_ip
from events
""",
    "clinical_patient": """
select c_custkey as patient_id, 'SEX' as attr_id, case when c_custkey % 2 = 0 then 'Female' else 'Male' end as attr_value from customer
union all select c_custkey, 'AGE', case when c_custkey % 17 = 0 then 'NA' else cast(20 + c_custkey % 70 as string) end from customer
""",
    "clinical_sample": """
select o_orderkey as internal_id, 'SAMPLE_TYPE' as attr_id, case o_orderstatus when 'F' then 'Primary' when 'O' then 'Metastasis' else 'Local Recurrence' end as attr_value from orders
union all select o_orderkey, 'PLATFORM', case when o_orderkey % 2 = 0 then 'Illumina HiSeq' else 'Ion Torrent' end from orders
""",
    "type_of_cancer": """
select 'nat' || cast(n_nationkey as string) as type_of_cancer_id, n_name as name from nation
union all select 'old' || cast(n_nationkey as string), n_name || ' (retired)' from nation where n_nationkey % 5 = 0
""",
    "resource_patient": """
select 'R' || cast(page_id % 4 as string) as resource_id, page_id as internal_id, url from pages where page_id % 4 >= 2
""",
    "raw_spans": """
select event_id as span_id, ts, event_type as tool_name, event_type <> 'error' as success,
  case when user_id % 3 = 0 then case when user_id % 2 = 0 then '' else cast(user_id as string) end end as x_user_id,
  case user_id % 4 when 0 then 'b64:dXNlckBleGFtcGxlLm9yZw==' when 1 then 'user' || cast(user_id as string) || '@example.org' when 2 then '' end as x_user_email,
  case when user_id % 5 = 0 then ' 10.0.0.' || cast(user_id % 40 as string) || ' , 172.16.0.1' when user_id % 5 = 1 then '  ' end as x_forwarded_for,
  '192.168.0.' || cast(user_id % 40 as string) as remote_host,
  case when user_id % 7 = 0 then '' else 'client_' || cast(user_id % 5 as string) end as handshake_name,
  'sess_' || cast(user_id as string) as session_id
from events
""",
    "sample_expression": """
select sp.sample_unique_id, sp.cancer_study_identifier, 'GENE' || cast(l.l_partkey % 50 as string) as hugo_gene_symbol, 'mrna_median_Zscores' as profile_type,
  case when l.l_linenumber = 7 then 'NA' else cast(cast(floor(l.l_extendedprice / 50) as int) as string) end as alteration_value
from lineitem l join sample_patient sp on l.l_orderkey = sp.sample_id
""",
    "search_terms": """
select distinct case c_custkey % 8 when 0 then 'nat' || cast(c_nationkey as string) when 1 then 'OLD' || cast(c_nationkey as string) when 2 then 'NATION_' || cast(c_nationkey as string)
  when 3 then 'nat' when 4 then 'ALL' when 5 then 'ion_' || cast(c_nationkey % 10 as string) when 6 then 'Tumor' else lower(c_mktsegment) end as term
from customer
""",
    "requested_studies": """
select distinct case c_custkey % 4 when 0 then upper('nation_' || cast(c_nationkey as string) || '_msk_2024') when 1 then 'nation_' || cast(c_nationkey as string) || '_tcga'
  when 2 then 'xx-' || cast(c_nationkey as string) || '_MSK-zz' else 'ab_' || cast(c_nationkey as string) end as requested_id
from customer
""",
}

# The one dialect-specific table: array elements with their position.
SPARK_ONLY = {
    "genetic_alteration_derived": """
select 'expr_study_E' || cast(vec_id as string) as sample_unique_id, 'expr_study' as cancer_study_identifier, 'GENE' || cast(pos as string) as hugo_gene_symbol, 'mrna' as profile_type,
  case when (vec_id + pos) % 23 = 0 then 'NA' when (vec_id + pos) % 29 = 0 then '' else cast(cast(floor(cast(v as double) * 1000) as bigint) as string) end as alteration_value
from embeddings lateral view posexplode(embedding) t as pos, v
""",
}

DUCKDB_ONLY = {
    "genetic_alteration_derived": """
select 'expr_study_E' || cast(vec_id as string) as sample_unique_id, 'expr_study' as cancer_study_identifier, 'GENE' || cast(pos as string) as hugo_gene_symbol, 'mrna' as profile_type,
  case when (vec_id + pos) % 23 = 0 then 'NA' when (vec_id + pos) % 29 = 0 then '' else cast(cast(floor(cast(v as double) * 1000) as bigint) as string) end as alteration_value
from (select vec_id, unnest(embedding) as v, unnest(range(len(embedding))) as pos from embeddings)
""",
}


def texts(dialect: str) -> dict[str, str]:
    """All table definitions for one engine, `spark` or `duckdb`."""
    return {**VIEWS, **(SPARK_ONLY if dialect == "spark" else DUCKDB_ONLY)}


def mentioned(sql: str, names) -> set[str]:
    """Those of the names that the text refers to."""
    return {n for n in names if re.search(rf"(?<![\w.']){n}(?![\w'])", sql)}


def with_tables(sql: str, dialect: str, base: dict[str, str] | None = None) -> str:
    """`sql` preceded by one CTE for each table it needs, in dependency order.

    `base` maps tables to the text that reads a stored copy; without it the base tables
    are expected to exist under their own names, as they do in the check.
    """
    definitions = {**texts(dialect), **(base or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in sorted(mentioned(definitions[name], set(definitions) - {name})):
            visit(other)
        ordered.append(name)

    for name in sorted(mentioned(sql, definitions)):
        visit(name)
    ctes = ",\n".join(f"{name} as ({definitions[name].strip()})" for name in ordered)
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
