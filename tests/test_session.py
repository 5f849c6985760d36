from __future__ import annotations

import pytest

from cohortwise import session, warehouse
from cohortwise.sources import tables


@pytest.fixture
def settings(spark):
    """The session with its settings put back afterwards."""
    kept = {k: spark.conf.get(k, None) for k in (session.INITIAL, session.READ, session.MERGE)}
    yield spark
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shuffles_start_with_partitions_that_follow_the_rows(settings, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 10)
    settings.conf.unset(session.INITIAL)
    least = int(settings.conf.get("spark.sql.shuffle.partitions"))
    assert session.start_wide(settings, 7) is None and settings.conf.get(session.INITIAL) == str(least)
    assert session.start_wide(settings, 5000) == 500 and settings.conf.get(session.INITIAL) == "500"
    assert session.start_wide(settings, 3000) == 300 and settings.conf.get(session.INITIAL) == "300"
    settings.conf.set(session.INITIAL, "77")  # the session's own
    assert session.start_wide(settings, 5000) == 500 and settings.conf.get(session.INITIAL) == "77"


def test_merged_partitions_stay_small_unless_the_session_sets_their_size(settings):
    settings.conf.unset(session.MERGE)
    session.start_wide(settings, 7)
    assert settings.conf.get(session.MERGE) == "16m"
    settings.conf.set(session.MERGE, "100m")  # the session's own
    session.start_wide(settings, 7)
    assert settings.conf.get(session.MERGE) == "100m"


def test_a_large_table_is_written_in_ranges_that_follow_its_rows(settings, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "ROWS", 100)
    settings.range(1).selectExpr("0 as n_nationkey", "'N' as n_name", "0 as n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    settings.range(1).selectExpr("0 as r_regionkey", "'R' as r_name").write.parquet(f"{tmp_path}/region.parquet")
    settings.range(50).selectExpr("id as c_custkey", "0 as c_nationkey", "'A' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    settings.range(4000).selectExpr(
        "id as o_orderkey", "id % 50 as o_custkey", "'2-HIGH' as o_orderpriority", "'F' as o_orderstatus", "1e0 as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    for name in set(tables.LARGEST) - {"orders"}:
        settings.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = warehouse(settings, str(tmp_path)).sample_to_gene_panel_derived
    assert got.count() == 4000 + 3200 + 2000
    assert len(got.inputFiles()) >= 40
