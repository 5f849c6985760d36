from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cohortwise.llm import mixing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, documents, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    passage = prose(60)
    rows = [(i, prose(120)) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(20)]  # near copies
    rows += [(300 + i, prose(100) + " " + passage + " " + prose(100)) for i in range(10)]
    rows += [(400 + i, prose(50) + " villain " + prose(3) + " rogue") for i in range(40)]
    rows += [(500, None), (501, ""), (502, "short")]
    documents(rows).selectExpr("*", "1 as extra").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 400)) for i in [*range(100), *range(400, 425)]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), dict(rows), passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs, after = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), stage(spark, docs, path).schema)
        after[name] = [r.asDict() for r in docs.collect()]
    ids = {name: {r["doc_id"] for r in rows} for name, rows in after.items()}
    assert ids["toxicity"] == {i for i in texts if not 400 <= i < 440}
    assert ids["minhash_near_dedup"] == {i for i in ids["toxicity"] if not 200 <= i < 220}
    assert ids["suffix_array_dedup"] == ids["minhash_near_dedup"]
    cut = {r["doc_id"]: r for r in after["suffix_array_dedup"]}
    for i in range(300, 310):
        assert passage not in cut[i]["text"] and cut[i]["n_chars"] == len(cut[i]["text"]) >= len(texts[i]) - len(passage) - 40
    assert all(cut[i]["text"] == texts[i] for i in range(20, 200))
    for name in list(after)[:-1]:
        assert all(list(r) == pipeline.COLUMNS for r in after[name])
    before = spark.createDataFrame(after["suffix_array_dedup"], "doc_id long, lang string, n_chars long, source string, text string").select(pipeline.COLUMNS)
    assert Counter(r["doc_id"] for r in after["mixing_sources"]) == Counter(r.doc_id for r in mixing.mix_sources(before).collect())
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in after["byte_level_bpe"])
    assert Counter(r["doc_id"] for r in after["byte_level_bpe"]) == Counter(r["doc_id"] for r in after["mixing_sources"])


def test_run_over_the_given_tables(spark):
    out = pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "round_trip"]
    assert out.where("not round_trip").count() == 0 and out.count() > 50


def test_empty_tables(spark, documents):
    docs = documents([])
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, docs, SMALL).count() == 0
    assert pipeline.drop_toxic(spark, docs, SMALL).count() == 0


def test_one_document_of_each_group(spark, documents, folder):
    path, texts, _ = folder
    rows = [(i, texts[i]) for i in range(100)]
    rows += rows + [(i, texts[i] + " end") for i in range(30)] * 2  # loaded twice; near copies under the same id
    rows += [(None, texts[i]) for i in (0, 0)] + [(None, texts[150] + " x"), (None, texts[150]), (None, texts[150])]
    rows += [(None, texts[160])] * 3 + [(7, texts[170])] * 2 + [(901, None), (901, ""), (902, " "), (902, " ")]
    docs = documents(rows).union(documents([(3, texts[3])]).replace("en", "de", "lang"))
    kept = pipeline.drop_near_duplicates(spark, pipeline.drop_toxic(spark, docs, path), path)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    named = Counter(i for i, _ in got.elements())
    assert named == Counter({**dict.fromkeys(range(100), 1), 7: 2, None: 2, 901: 2, 902: 1})
    assert all(sum((i, t) in got for t in (texts[i], texts[i] + " end")) == 1 for i in range(30))
    assert sum((None, t) in got for t in (texts[150], texts[150] + " x")) == 1 and got[None, texts[160]] == 1 and got[7, texts[170]] == 1
    for _, stage in pipeline.STAGES[2:3]:
        assert Counter(r.doc_id for r in stage(spark, kept, path).collect()) == named


def test_a_cut_text_keeps_its_own_replacement_characters(spark, documents):
    """U+FFFD of the source stays; only whole characters go where a repeat begins or ends inside one."""
    passage = "".join(chr(0x4E00 + 7 * i) for i in range(100))  # 300 bytes
    rows = [(1, f"one \ufffd two é{passage}ê three \ufffd"), (2, f"clean \ufffd text è{passage}ë"), (3, "clean \ufffd text")]
    got = {r.doc_id: r for r in pipeline.cut_repeats(spark, documents(rows), SMALL).collect()}
    for i, text in rows:
        want = text.replace(passage, "")
        # é, è, ê and ë share their first byte, which is part of the repeat
        want = want.replace("éê", "é").replace("èë", "è") if i != 3 else want
        assert got[i].text == want and got[i].n_chars == len(want)


def test_null_sources_and_clashing_columns_pass_all_stages(spark, documents, folder):
    path, texts, _ = folder
    docs = documents([(i, texts[i]) for i in range(60)]).selectExpr(
        "*", "'x' as node", "1 as copy_no", "2 as token_ids", "3 as n_bytes", "4 as p_toxic", "5 as component_id", "6 as __id")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), stage(spark, docs, path).schema)
        assert docs.count() > 20 and {r.source for r in docs.select("source").distinct().collect()} == {None, "s"}
