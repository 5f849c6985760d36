"""Time the headline queries on prepared tables and print one JSON line.

The tables are written once before the clock starts, as a deployment would have them; the
time this takes is reported as `prepare_sec`. Each query then runs once to warm up and
BENCH_RUNS times for the clock, and the median is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from cohortwise import build_session, warehouse
from cohortwise.registry import all_queries

HEADLINE = (
    "f04_gene_mutation_frequency_by_cancer_type",
    "f04_mutation_frequency_by_cancer_type_all_genes",
    "f05_mutation_frequency_in_every_study",
    "f08_top_mutated_genes_in_cohort",
    "f12_study_gene_frequency",
    "f15_patient_frequency_all_genes",
    "c07_survival_table",
    "c08_median_by_mutation",
    "c10_samples_all",
    "c18_type_hierarchy",
    "c28_events_with_clinical",
    "t05_treatment_timing",
    "t08_agents_per_category",
    "x03_gene_pair_coexpression",
    "x04_attribute_coexpression",
    "x05_tmb_expression",
    "x06_coexpression_scan",
    "k01_list_studies",
    "k05_study_profile",
    "k06_search_taxonomy",
    "r09_requests_cube",
    "r11_heartbeat_alerts",
    "r12_error_alerts",
    "h3_wilcoxon",
    "h5_benjamini_hochberg",
)
TABLES = (
    "cancer_study", "patient", "sample", "gene", "gene_panel", "gene_panel_list", "sample_to_gene_panel_derived",
    "genomic_event_derived", "clinical_data_derived", "cancer_study_query_preferences", "genetic_profile",
    "clinical_event_derived", "oncotree", "spans", "search_terms", "genetic_alteration_derived",
    "sample_expression",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "12g"), spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    tables = warehouse(spark, directory)
    start = time.perf_counter()
    for name in TABLES:
        getattr(tables, name)
    prepare = time.perf_counter() - start

    known = all_queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name].build(tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline queries, sum of median warm times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")),
        "cpus": int(cpus),
        "runs": runs,
        "prepare_sec": round(prepare, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
