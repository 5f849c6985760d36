"""SimHash fingerprints and near fingerprints, in DataFrame operations only.

A text's terms are its pairs of neighbouring words (and the last word); a term's weight is its
length. The terms' 128-bit hashes vote on each bit with their weights. Votes are counted two bits
to a number: a bit of the lower and one of the upper half of a 64-bit hash are spread to the two
halves of a long and multiplied by the weight.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortwise.llm.common import stored

BITS = 128
HALVES = 1 << 32 | 1
#: Ids to a group when documents are put in order.
GROUP_BITS = 10
#: Groups whose first documents are sent to every task, some megabytes; more are joined by a shuffle.
FEW_GROUPS = 1 << 17
#: Fingerprints of one key that are held together.
CHUNK = 1024
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def terms(text: Column) -> Column:
    words = F.split(F.regexp_replace(text, f"^{SPACE}|{SPACE}$", ""), SPACE)
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, low long, high long): the fingerprint of each key's text; a null or empty text has none of its bits set."""
    term = texts.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("__term"))
    hashed = term.select(
        *keys, F.length("__term").cast("long").alias("__w"), F.xxhash64("__term").alias("__a"), F.xxhash64("__term", F.lit(1)).alias("__b"))
    one = F.lit(HALVES)
    votes = [F.sum(F.shiftright(h, k).bitwiseAND(one) * F.col("__w")).alias(f"{h}{k}") for h in ("__a", "__b") for k in range(32)]
    voted = hashed.groupBy(*keys).agg(F.sum("__w").alias("__total"), *votes)

    def side(h: str) -> Column:
        bits = F.lit(0).cast("long")
        for k in range(32):
            low, high = F.col(f"{h}{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"{h}{k}", 32)
            for count, at in ((low, k), (high, k + 32)):
                bits = bits.bitwiseOR(F.when(count * 2 > F.col("__total"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
        return bits

    return voted.select(*keys, side("__a").alias("low"), side("__b").alias("high"))


def likeness(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(low.bitwiseXOR(other_low)) + F.bit_count(high.bitwiseXOR(other_high))) / F.lit(float(BITS))


def hexadecimal(low: Column, high: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def next_lower(groups: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, next): for each distinct long of at most `bits` bits the next lower one, null for the lowest.

    Numbers are ordered inside groups of their upper bits, 2**16 to a group, and the groups in the
    same way, so no task sorts more than 2**16 of them.
    """
    if bits <= 16:
        return groups.withColumn("next", F.lead(column).over(Window.orderBy(F.desc(column))))
    upper = F.shiftright(column, 16)
    inside = groups.withColumn("__upper", upper)
    inside = inside.withColumn("__next", F.lead(column).over(Window.partitionBy("__upper").orderBy(F.desc(column))))
    heads = inside.groupBy("__upper").agg(F.max(column).alias("__head"))
    below = next_lower(heads.select(F.col("__upper").alias("__u")), "__u", bits - 16)
    below = below.join(heads, F.col("next") == F.col("__upper")).select(F.col("__u").alias("__of"), F.col("__head").alias("__below"))
    out = inside.join(below, F.col("__upper") == F.col("__of"), "left")
    return out.select(column, F.coalesce("__next", "__below").alias("next"))


def in_order(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(group, rn, id, text, next text, last): documents by descending id, with the text of the next one.

    The last one's next is the first. Equal ids are ordered by their texts; null ids come last.
    Documents are grouped by the upper bits of their id; the first document of a group also
    stands, marked as a guest, behind those of the group before.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__group", F.coalesce(F.shiftright("__id", GROUP_BITS), F.lit(-(1 << 62))))
    heads = rows.groupBy("__group").agg(F.max("__id").alias("__head"))
    lower = next_lower(heads.select("__group"), "__group", 64)
    top = heads.agg(F.max("__group")).first()[0]
    hosts = lower.select(F.coalesce("next", F.lit(top).cast("long")).alias("__guest"), F.col("__group").alias("__host"))
    guests = heads.join(hosts, F.col("__group") == F.col("__guest")).select(F.col("__group").alias("__from"), "__head", "__host")
    guests = stored(guests, "guests")
    if guests.count() <= FEW_GROUPS:  # then the texts are shuffled only once, by their groups
        guests = F.broadcast(guests)
    of = (F.col("__group") == F.col("__from")) & F.col("__id").eqNullSafe(F.col("__head"))
    placed = rows.join(guests, of, "left").select(
        "__id", "__text",
        F.explode(F.when(F.col("__host").isNull(), F.array(F.struct(F.col("__group").alias("g"), F.lit(False).alias("guest")))).otherwise(
            F.array(F.struct(F.col("__group").alias("g"), F.lit(False).alias("guest")), F.struct(F.col("__host").alias("g"), F.lit(True).alias("guest"))))).alias("__at"))
    placed = placed.select("__id", "__text", F.col("__at.g").alias("__group"), F.col("__at.guest").alias("__guest"))
    order = Window.partitionBy("__group").orderBy("__guest", F.desc_nulls_last("__id"), F.xxhash64("__text"), "__text")
    return placed.withColumns({
        "__rn": F.row_number().over(order), "__next": F.lead("__text").over(order), "__was_guest": F.lag("__guest").over(order)})


def compare_neighbours(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of an edited text, and of the next document by descending id.

    The edited text replaces the last floor(n/2) of a text's n code points by the first as many
    (or all) of the next document's text; the last document's next is the first. Returns
    id_column, n_chars, edited_sha256, low, high, edited_low, edited_high, next_low, next_high, one row per row of
    `docs`. Null texts are empty. Equal ids are ordered by their texts, null ids come after all
    others. An empty table gives no rows.
    """
    placed = in_order(docs, id_column, text)
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    # a group's first guest is only there for its text; further guests (equal ids) are not needed
    placed = placed.where("not __guest or not __was_guest").withColumn("__n", n)
    edited = F.when(~F.col("__guest"), F.concat(F.col("__text").substr(F.lit(1), n - half), F.col("__next").substr(F.lit(1), half)))
    both = placed.withColumn("__edited", edited)
    both = both.withColumn("__sha", F.unhex(F.sha2("__edited", 256)))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("__text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("__edited").alias("text")))
    keys = ["__group", "__rn", "__id", "__guest", "__n", "__sha", "__kind"]
    each = both.select(*keys[:-1], F.explode(kinds).alias("__k")).select(*keys[:-1], F.col("__k.kind").alias("__kind"), F.col("__k.text").alias("__text"))
    prints = fingerprints(each.where("not __guest or __kind = 0"), keys, "__text")
    # a text's own print also goes to the document before it
    own = F.struct(F.col("__rn").alias("rn"), F.lit(False).alias("as_next"))
    sent = F.when((F.col("__kind") == 1), F.array(own)).when(F.col("__guest"), F.array(F.struct((F.col("__rn") - 1).alias("rn"), F.lit(True).alias("as_next")))).otherwise(
        F.array(own, F.struct((F.col("__rn") - 1).alias("rn"), F.lit(True).alias("as_next"))))
    sent = prints.withColumn("__to", F.explode(sent))
    as_next = F.col("__to.as_next")
    mine, changed = ~as_next & (F.col("__kind") == 0), ~as_next & (F.col("__kind") == 1)

    def one(condition: Column, value: str) -> Column:
        return F.max(F.when(condition, F.col(value)))

    gathered = sent.groupBy("__group", F.col("__to.rn").alias("__at")).agg(
        one(mine, "__id").alias(id_column), F.max(F.when(mine, True)).alias("__real"), one(mine, "__n").cast("long").alias("n_chars"),
        F.lower(F.hex(one(mine, "__sha"))).alias("edited_sha256"),
        one(mine, "low").alias("low"), one(mine, "high").alias("high"),
        one(changed, "low").alias("edited_low"), one(changed, "high").alias("edited_high"),
        one(as_next, "low").alias("next_low"), one(as_next, "high").alias("next_high"))
    return gathered.where("__real").drop("__real")


def cut_bits(blocks: int, low: Column, high: Column) -> list[Column]:
    """The 128 bits as `blocks` numbers."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def cut(a: int, b: int) -> Column:
        if b - a == 64:
            return low if a == 0 else high
        if b <= 64:
            return F.shiftrightunsigned(low, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        if a >= 64:
            return F.shiftrightunsigned(high, a - 64).bitwiseAND(F.lit((1 << (b - a)) - 1))
        return F.shiftrightunsigned(low, a).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit((1 << (b - 64)) - 1)), 64 - a))

    return [cut(a, b) for a, b in zip(edges, edges[1:])]


def block_tables(radius: int, blocks: int) -> list[tuple[Column, ...]]:
    """Keys of the permuted tables: two fingerprints at most `radius` bits apart agree in one of them.

    The bits are cut into `blocks` blocks; each table is keyed by blocks - radius of them.
    """
    parts = cut_bits(blocks, F.col("low"), F.col("high"))
    return [tuple(parts[i] for i in table) for table in combinations(range(blocks), blocks - radius)]


def near(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """(query_low, query_high, low, high, distance): all prints at most `radius` bits from a query.

    Both frames have low and high; equal prints count once. Candidates meet in the block tables;
    the distance of each is then counted on all bits, and a pair found in several tables is
    returned once.
    """

    def keyed(frame: DataFrame) -> DataFrame:
        tables = F.array(*[F.xxhash64(F.lit(i), *key) for i, key in enumerate(block_tables(radius, blocks))])
        return frame.select("low", "high").distinct().withColumn("__key", F.explode(tables))

    asked = keyed(queries).select(F.col("low").alias("query_low"), F.col("high").alias("query_high"), "__key")
    distance = F.bit_count(F.col("low").bitwiseXOR(F.col("query_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("query_high")))
    return asked.join(keyed(prints), "__key").withColumn("distance", distance).where(F.col("distance") <= radius).drop("__key").distinct()


def count_near(prints: DataFrame, queries: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(query_low, query_high, n_near): how many rows of `prints` lie at most `radius` bits from each distinct query.

    For radii beyond what equal blocks can find: of `blocks` blocks one differs in at most
    radius // blocks bits, so each table is keyed by one block, and a query asks for all numbers that
    near to its own. All bits are counted then, and a pair counts in the first table it meets
    in. Prints of a key are held in arrays of about CHUNK, so pairs are counted but never rows.
    """
    flips = radius // blocks
    widths = [BITS * (i + 1) // blocks - BITS * i // blocks for i in range(blocks)]
    numbers = F.posexplode(F.array(*cut_bits(blocks, F.col("low"), F.col("high")))).alias("table", "number")
    keyed = prints.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).select("low", "high", "n", numbers)
    sizes = keyed.groupBy("table", "number").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    held = keyed.join(sizes, ["table", "number"]).groupBy("table", "number", F.pmod(F.xxhash64("low", "high"), "chunks").alias("chunk")).agg(
        F.collect_list(F.struct("low", "high", "n")).alias("held"))
    held = stored(held, "held")
    # the numbers with at most `flips` bits: as many for every input, some hundreds a table
    masks = prints.sparkSession.range(0, 1 << max(widths), 1, 1).where(F.bit_count("id") <= flips).select(
        F.posexplode(F.array(*map(F.lit, widths))).alias("mask_of", "width"), F.col("id").alias("mask")).where("mask < shiftleft(1L, width)")
    asked = queries.select("low", "high").distinct().select(F.col("low").alias("query_low"), F.col("high").alias("query_high"), numbers)
    asked = asked.join(F.broadcast(masks), F.col("table") == F.col("mask_of")).select(
        "query_low", "query_high", "table", F.col("number").bitwiseXOR(F.col("mask")).alias("number"))

    def counted(p: Column) -> Column:
        low, high = p["low"].bitwiseXOR(F.col("query_low")), p["high"].bitwiseXOR(F.col("query_high"))
        first = F.lit(True)
        for i, part in enumerate(cut_bits(blocks, low, high)[:-1]):
            first = first & ((F.col("table") <= i) | (F.bit_count(part) > flips))
        return F.when((F.bit_count(low) + F.bit_count(high) <= radius) & first, p["n"]).otherwise(F.lit(0).cast("long"))

    found = F.aggregate("held", F.lit(0).cast("long"), lambda n, p: n + counted(p))
    # a shuffle join: what is asked packs well, and would be taken for something small to broadcast
    return asked.hint("merge").join(held, ["table", "number"]).groupBy("query_low", "query_high").agg(F.sum(found).alias("n_near"))
