"""Interaction of document filters: what each removes, alone and after others, in every order.

A document's failures are bits of a mask, so a part of the corpus is at most 2**k counted cells. A
recursive query extends prefixes of filter orders by one unused filter at a time; it carries the
bits applied so far beside each mask, so every level says for each mask what that step does to it.
Cells then meet their masks, and a step's counts are sums over cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortwise.llm.common import stored

SPLIT = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def quality_filters(text: Column, word_list: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words, repeated words, capitals, special characters."""
    return {
        "A": F.size(word_list) < 100,
        "B": 100 * F.size(F.array_distinct(word_list)) < 80 * F.size(word_list),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask): bit 0 to 4 for the filters A to E each document fails.

    A to D are `quality_filters`; E is a text that a row with a smaller id has as well, anywhere in
    `docs`. Texts are equal if their SHA-256 is. Null texts are empty and parts that are null are the
    empty text; a null id is greater than all others, so null ids alone do not fail E against
    one another, nor do rows with one id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"), words(body).alias("words"))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(quality_filters(F.col("text"), F.col("words")).values())]
    rows = rows.select(
        "id", "part", F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("at"), F.unhex(F.sha2("text", 256)).alias("digest"),
        reduce(lambda a, b: a + b, bits).alias("mask"))
    rows = stored(rows, "failures")
    # a text's first id is found by its digest, but joined by the id, so that copies in any number do not meet
    first = rows.groupBy("digest").agg(F.min("at").alias("at")).select("at", F.col("digest").alias("first_digest"), F.lit(True).alias("is_first"))
    joined = rows.join(first, (rows.at == first["at"]) & (rows.digest == first.first_digest), "left")
    return joined.select("id", "part", F.when(F.col("is_first"), rows.mask).otherwise(rows.mask + 16).alias("mask"))


def cells(marked: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and those labelled quality 1 and toxic 1.

    A document counts as labelled so if any of its rows in `labels` says it; null ids have no label.
    """
    known = labels.groupBy(F.col(id_column).alias("of")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = marked.join(known, F.col("id") == F.col("of"), "left")
    return rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def prefixes(spark: SparkSession, letters: str) -> DataFrame:
    """(mask, prefix, letter, step, and what the step does to documents of this mask), one row per mask and prefix of an order.

    2**k masks times the number of prefixes: 10,400 rows for five filters, whatever the corpus.
    """
    named = ", ".join(f"struct('{letter}' as letter, {1 << i} as bit)" for i, letter in enumerate(letters))
    masks = 1 << len(letters)
    return spark.sql(f"""
        with recursive masks as (select explode(sequence(0, {masks - 1})) as mask),
        unused as (
          select applied, f.letter, f.bit from (select mask as applied, explode(array({named})) as f from masks) where (applied & f.bit) = 0),
        walk(mask, prefix, letter, bit, before, applied, step) as (
          select mask, '', '', 0, 0, 0, 0 from masks
          union all
          select w.mask, concat(w.prefix, u.letter), u.letter, u.bit, w.applied, w.applied | u.bit, w.step + 1
          from walk w join unused u on u.applied = w.applied)
        select mask, prefix, letter, step, (mask & applied) = 0 as is_kept, (mask & bit) != 0 and (mask & before) = 0 as is_removed,
          (mask & bit) != 0 and (mask & before) != 0 as is_redundant, mask = bit as is_unique
        from walk where step > 0""")


def audit(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the filters.

    `counted` is like the result of `cells`. Counts are of documents of the part: kept after the step,
    removed by it, failing its filter but removed before, failing no other filter, and removed with a
    good or toxic label. shapley is what the step's filter removes, summed over all orders. Zeros are
    returned. A part without documents has no rows.
    """
    walk = stored(prefixes(counted.sparkSession, letters), "prefixes")

    def total(column: str, flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(column)).otherwise(F.lit(0)))

    # the walk has a fixed number of rows
    steps = counted.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "letter").agg(
        total("n", "is_kept").alias("kept"), total("n", "is_removed").alias("removed"), total("n", "is_redundant").alias("redundant"),
        total("n", "is_unique").alias("unique_fails"), total("good", "is_removed").alias("good_lost"), total("toxic", "is_removed").alias("toxic_lost"))
    # zeros of masks that do not occur come from the prefixes of the masks that do: each mask has all prefixes
    whole = walk.where((F.col("step") == len(letters)) & (F.col("mask") == 0)).select(F.col("prefix").alias("filter_order"))
    orders = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.withColumn("of", F.expr("substr(filter_order, 1, step)"))
    placed = steps.join(F.broadcast(orders), F.col("prefix") == F.col("of"))
    sums = placed.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    sums = sums.select(F.col("part").alias("its_part"), F.col("letter").alias("its_letter"), "shapley")
    return placed.join(sums, (F.col("part") == F.col("its_part")) & (F.col("letter") == F.col("its_letter"))).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
