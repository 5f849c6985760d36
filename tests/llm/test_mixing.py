from __future__ import annotations

from collections import Counter

import pytest

from cohortwise.llm.mixing import mix_sources, source_rates


def test_counts_follow_the_rates(spark):
    frame = spark.range(60_000).selectExpr(
        "id as doc_id", "repeat('x', 9) as text", "'en' as lang", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "9L as n_chars", "5 as copy_no", "'q' as __u")
    mixed = mix_sources(frame, temperature=0.5)
    rates = {r[0]: r[1] for r in source_rates(frame).collect()}
    n = {r[0]: r[1] for r in frame.groupBy("source").count().collect()}
    got = {r[0]: r[1] for r in mixed.groupBy("source").count().collect()}
    assert sum(rates[s] * n[s] for s in n) == pytest.approx(60_000)
    for s in n:
        assert got[s] == pytest.approx(rates[s] * n[s], rel=0.06)
    times = Counter(r[0] for r in mixed.where("source = 's1'").groupBy("doc_id").count().select("count").collect())
    assert times[1] > times[2] > times[3] > 0
    copies = mixed.groupBy("doc_id").agg({"copy_no": "max", "*": "count"}).collect()
    assert all(r[1] == r[2] for r in copies)


def test_targets_nulls_ties_and_repeated_rows(spark, documents):
    rows = [(i, "word " * 5) for i in range(1, 700)] + [(None, None), (None, ""), (8, "word " * 5), (8, "word " * 5), (9, "x" * 200_000)]
    frame = documents(rows)
    targets = spark.createDataFrame([("s", 3.0), (None, 1.0), ("absent", 0.0)], "source string, weight double")
    mixed = mix_sources(frame, targets=targets, budget=2.0)
    assert mixed.columns == [*frame.columns, "copy_no"]
    counts = Counter((r.doc_id, r.copy_no) for r in mixed.collect())
    assert counts[8, 1] in (0, 3) and all(v == counts[i, 1] for (i, c), v in counts.items())
    only = mix_sources(frame, targets=targets.where("source = 's'"))
    assert {r.source for r in only.collect()} == {"s"}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mix_sources(frame.repartition(7), targets=targets, budget=2.0).collect()))


def test_rows_without_an_id_are_drawn_by_their_texts(spark, documents):
    rows = [(None, f"text {i}") for i in range(2000)] + [(None, None), (None, "")]
    mixed = mix_sources(documents(rows), budget=1.0)
    assert 0.9 < mixed.count() / len(rows) < 1.1
    times = Counter(r["count"] for r in mixed.groupBy("text").count().collect())
    assert times[1] > times[2] > times[3] > 0
    assert sum(times.values()) < 0.7 * len(rows)  # e**-1 of them are drawn zero times


def test_many_sources_are_not_broadcast(spark, documents, monkeypatch):
    from cohortwise.llm import mixing

    few = [str(r) for r in mix_sources(documents([(i, "a b") for i in range(300)])).collect()]
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(few) == sorted(str(r) for r in mix_sources(documents([(i, "a b") for i in range(300)])).collect())


def test_order_is_random(spark, documents):
    found = [r.doc_id for r in mix_sources(documents([(i, "a b c") for i in range(2000)]), budget=3.0).collect()]
    rising = sum(a < b for a, b in zip(found, found[1:])) / len(found)
    assert 0.4 < rising < 0.6


def test_empty_table(documents):
    assert mix_sources(documents([])).count() == 0
