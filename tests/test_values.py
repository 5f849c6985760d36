from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortwise.functions import labels, text, values


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first()[0]


@pytest.mark.parametrize(("written", "number"), [
    ("12", 12.0), (" 12 ", 12.0), ("-0.5", -0.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0),
    ("", None), ("NA", None), ("<1", None), ("nan", None), ("inf", None), ("-Infinity", None), ("1e999", None),
    ("1.0d", None), ("1f", None), ("0x1p3", None), (None, None),
])
def test_to_number(spark, written, number):
    assert one(spark, written, values.to_number("x")) == number


@pytest.mark.parametrize(("part", "whole", "percent"), [
    (7, 560, 1.2), (9, 800, 1.1), (13105, 25040, 52.3), (1, 3, 33.3), (0, 5, 0.0), (1, 0, None)])
def test_percent_rounds_ties_to_even(spark, part, whole, percent):
    got = spark.createDataFrame([(part, whole)], "a long, b long").select(values.percent(F.col("a"), F.col("b"))).first()[0]
    assert got == percent


def test_contains_any_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("A%B",)], "x string")
    assert [r[0] for r in df.where(values.contains_any(["x"], ["A_B"])).collect()] == ["a_b"]
    assert [r[0] for r in df.where(values.contains_any(["x"], ["%"])).collect()] == ["A%B"]


def test_labels(spark):
    assert one(spark, 2, labels.cna_label("x"), "int") == "Amplification"
    assert one(spark, None, labels.cna_label("x"), "int") is None
    assert one(spark, "RPPA", labels.profile_family("x")) == "Protein"
    assert one(spark, "Fusion", labels.alteration_type("x")) == "STRUCTURAL_VARIANT"
    assert one(spark, "Splice_Site", labels.mutation_classes("x")) == ["splice", "truncating", "point_mutation"]
    assert one(spark, "brca_tcga_pan_can_atlas_2018", labels.study_sources("x")) == ["tcga", "pan_cancer_atlas"]
    assert one(spark, "msk_ch_2020", labels.study_sources("x")) == ["msk", "clonal_hematopoiesis"]


@pytest.mark.parametrize("word", ["", "a", "ab", "abcab", "banana"])
def test_substrings(spark, word):
    for shortest in (1, 3):
        want = {word[i:j] for i in range(len(word)) for j in range(i + shortest, len(word) + 1)}
        assert set(one(spark, word, text.substrings(F.col("x"), shortest))) == want


def test_id_tokens(spark):
    assert one(spark, "NBL__msk-2023_ab", text.id_tokens(F.col("x"))) == ["nbl", "msk", "2023"]
