"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortwise.llm.common import stored

HEX_DIGITS = 13
#: Sources up to this number are sent to every task; of more, each task reads its own.
FEW = 10_000


def source_rates(
    docs: DataFrame, targets: DataFrame | None = None, temperature: float = 0.5, budget: float = 1.0,
    source: str = "source", text: str = "text",
) -> DataFrame:
    """(source, rate): how often a document of each source is to appear on average.

    A source's size is its characters plus one per document. Its share of the mix is its
    `weight` in `targets` (source, weight; sources that are not in it get nothing), or, without
    targets, its size to the power `temperature`, scaled to sum to one. The mix is `budget`
    times as large as the input. Null is a source of its own.
    """
    size = F.sum(F.coalesce(F.length(text), F.lit(0)) + F.lit(1)).cast("double")
    sizes = docs.groupBy(F.col(source).alias("__source")).agg(size.alias("__size"))
    if targets is None:
        weighted = sizes.withColumn("__weight", F.pow("__size", F.lit(temperature)))
    else:
        wanted = targets.groupBy(F.col("source").alias("__wanted")).agg(F.sum("weight").cast("double").alias("__weight"))
        weighted = sizes.join(wanted, F.col("__source").eqNullSafe(F.col("__wanted")), "left").fillna(0.0, ["__weight"])
    weighted = stored(weighted, "sources")
    total, weights = weighted.agg(F.sum("__size"), F.sum("__weight")).first()
    factor = budget * total / weights if weights else 0.0
    return weighted.select("__source", (F.lit(factor) * F.col("__weight") / F.col("__size")).alias("__rate"))


def cumulative(rates: DataFrame) -> DataFrame:
    """(source, array of P(count <= 0), P(count <= 1), ..) of the Poisson distribution with each rate."""
    steps = rates.select(
        "__source", "__rate",
        F.explode(F.expr("sequence(0, cast(ceil(__rate + 12 * sqrt(__rate) + 20) as int))")).alias("__n"))
    upto = Window.partitionBy("__source").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("__n") == 0, -F.col("__rate")).when(F.col("__rate") == 0, F.lit(-1e9)).otherwise(F.ln(F.col("__rate") / F.col("__n")))
    mass = steps.withColumn("__mass", F.exp(F.sum(step).over(upto)))
    sums = mass.withColumn("__below", F.sum("__mass").over(upto))
    listed = sums.groupBy("__source").agg(F.array_sort(F.collect_list(F.struct("__n", "__below"))).alias("__steps"))
    return listed.select("__source", F.col("__steps.__below").alias("__below"))


def mix_sources(
    docs: DataFrame, targets: DataFrame | None = None, temperature: float = 0.5, budget: float = 1.0, seed: int = 17,
    id_column: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """`docs` repeated so that sources have their target shares, in a random order.

    Each document appears as often as the Poisson distribution with its source's rate (see
    `source_rates`) says at a uniform number in [0, 1) made from the seed and its id: zero,
    one or more times, and the same in every run and retry. Adds copy_no, 1 for the first copy
    (a column of this name is replaced). Rows with the same id have the same number of copies. A row
    without an id is drawn by its text. Null and empty texts are kept like others.

    Copies are dealt to partitions by a hash of seed, id, text and number and sorted by another one
    inside, so the rows in the order of the partitions are a random order of the whole mix.
    """
    listed = stored(cumulative(source_rates(docs, targets, temperature, budget, source, text)), "rates")
    if listed.count() <= FEW:  # then no text is shuffled by its source
        listed = F.broadcast(listed)
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")))))
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))
    counted = docs.join(listed, F.col(source).eqNullSafe(F.col("__source")), "left").withColumn("__u", uniform)
    counted = counted.withColumn("__copies", F.size(F.filter("__below", lambda p: p <= F.col("__u")))).where("__copies > 0")
    copies = counted.drop("__source", "__below", "__u", "copy_no").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    order = F.xxhash64(F.lit(seed), name, F.col(text), F.col("copy_no"))
    return copies.drop("__copies").withColumn("__order", order).repartition("__order").sortWithinPartitions(
        F.hash("__order"), "__order").drop("__order")


def mix_sql(temperature: float = 0.5, budget: float = 1.0, seed: int = 17) -> str:
    """The same rows in DuckDB."""
    return f"""
with sizes as (select source, sum(coalesce(length(text), 0) + 1)::double as size from documents group by source),
totals as (select sum(size) as total, sum(size ** {temperature}) as weights from sizes),
rates as (select source, {budget} * total / weights * size ** {temperature} / size as rate from sizes, totals),
steps as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::bigint + 1)) as n from rates),
logs as (select source, n, sum(case when n = 0 then -rate else ln(rate / n) end) over (partition by source order by n) as mass from steps),
below as (select source, sum(exp(mass)) over (partition by source order by n) as p from logs),
numbers as (
  select *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'text ' || md5(coalesce(text, '')))), 1, {HEX_DIGITS}))::bigint / 16.0::double ** {HEX_DIGITS} as u
  from documents),
counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, (select count(*) from below b where b.source is not distinct from d.source and b.p <= d.u) as copies
  from numbers d)
select doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::int as copy_no from counted"""
