"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

The mix is a sequence of slots. Slot ``i`` is the point ``frac(i * golden ratio)``; cumulative target shares map the
point to a source. The r-th slot of a source takes the r-th block of that source: its documents in a hashed order,
laid end to end and cut into blocks of equally many words; after the last block the next epoch starts again. A source
stops at its target; slots that the sequence gives it beyond that are left out, and slots that it lacks (the
discrepancy, a few per source) are appended, so that every source takes exactly its target in whole words.

Nothing is ranked in one task: running sums over documents and slots are made per bucket of hash or slot range, whose
totals are summed up first. Texts and other columns that are kept are moved once, to the words that the mix takes.

Defined results: a null text has no words; a null source is a source of its own, ordered last; documents without
words take none; repeated rows are separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.llm.common import WORD, materialize, unused

#: Words of a block and so of a slot.
BLOCK_WORDS = 1024
#: Weights by the position of a source in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is repeated this often at most.
MAX_EPOCHS = 3

#: Rows of a bucket in which a running sum is made by one task.
BUCKET_ROWS = 4096
#: The points are multiples of the golden ratio's fraction, in units of 2 ** -31: 2 ** 31 / 1.618..., made odd.
POINT_RANGE = 1 << 31
GOLDEN = 1327217885
#: Cells of the unit interval that turn the look-up of a point into an equal join.
CELLS = 1024
KEY_BITS = 60


def mix_key(doc_id: str, text: str) -> Column:
    """60 bits that order the documents of a source, the same in every run."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``position``, ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    The targets share the total size by weight; those over ``max_epochs`` times the source's size stop there and the
    excess goes to the others by weight. Sorted by size per weight, the sources that stop come first, so the level
    is that of the first source that need not stop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    position = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((position - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_epochs
    rows = sizes.withColumn("position", position).withColumn("weight", weight).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("capped", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("fill", F.row_number().over(by_fill))
    )
    level = F.min_by("level", F.when(F.col("fits"), F.col("fill"))).over(everything)
    target = F.least(F.col("weight") * level, F.col("cap").cast("double"))
    return rows.withColumn("target", target).select("source", "source_size", "position", "weight", "target")


def running(rows: DataFrame, group: str, bucket: Column, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows of ``group`` that come before, in the order of bucket and ``order``."""
    rows = rows.withColumn("_bucket", bucket).withColumn("_amount", amount)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, "_bucket").agg(F.sum("_amount").alias("_total"))
    offsets = totals.select(group, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    joined = summed.join(offsets, [group, "_bucket"])
    return joined.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_bucket", "_amount", "_inside", "_offset")


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots ``(slot, position, rank, epoch, block, words)`` for sources with whole-number ``quota`` and size."""
    spark = plan.sparkSession
    size, quota = F.col("source_size"), F.col("quota")
    rounds = F.when(size > 0, F.expr("quota div source_size")).otherwise(F.lit(0))
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    rest = quota - rounds * size
    plan = (
        plan.withColumn("blocks", blocks)
        .withColumn("rounds", rounds)
        .withColumn("rest", rest)
        .withColumn("slots", F.col("rounds") * F.col("blocks") + F.expr(f"(rest + {block_words - 1}) div {block_words}"))
    )
    # Cumulative shares on the grid of the points; the last source ends at the full range.
    total = F.sum("quota").over(Window.partitionBy())
    upto = F.sum("quota").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = lambda c: F.floor(c / total * POINT_RANGE)
    shares = (
        plan.where(quota > 0)
        .withColumn("high", edge(upto))
        .withColumn("low", edge(upto - quota))
        .where("high > low")
        .select("position", "low", "high", "slots", "blocks", "rounds", "rest", "source_size")
    )
    width = POINT_RANGE // CELLS
    cells = shares.withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    n_slots = plan.agg(F.coalesce(F.sum(F.expr(f"(quota + {block_words - 1}) div {block_words}")), F.lit(0))).first()[0]
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.expr(f"((id % {POINT_RANGE}) * {GOLDEN}) % {POINT_RANGE}").alias("point")
    )
    drawn = (
        points.withColumn("cell", F.expr(f"point div {width}"))
        .join(cells.select("cell", "position", "low", "high"), "cell")
        .where("low <= point AND point < high")
        .select("slot", "position")
    )
    ranked = running(drawn, "position", F.expr(f"slot div {BUCKET_ROWS}"), ["slot"], F.lit(1), "rank")
    counts = drawn.groupBy("position").agg(F.count("*").alias("drawn"))
    facts = plan.select("position", "slots", "blocks", "rounds", "rest", "source_size")
    lacking = (
        facts.join(counts, "position", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .where("drawn < slots")
        .select("position", F.explode(F.expr("sequence(drawn, slots - 1)")).alias("rank"))
        .select((F.col("rank") + n_slots).alias("slot"), "position", "rank")
    )
    taken = ranked.select("slot", "position", "rank").unionByName(lacking).join(facts, "position").where("rank < slots")
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    words = F.when(F.col("epoch") < F.col("rounds"), length).otherwise(
        F.least(length, F.col("rest") - F.col("block") * block_words)
    )
    return (
        taken.withColumn("epoch", F.expr("rank div blocks"))
        .withColumn("block", F.expr("rank % blocks"))
        .withColumn("words", words)
        .select("slot", "position", "rank", "epoch", "block", "words")
    )


def mix(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` plus ``size``, ``source_size``, ``target`` and ``taken``, and the names of these four.

    ``taken`` is the number of the document's words in the mix, repeats included. Names that are among ``keep`` get a
    leading underscore.
    """
    names = {n: unused(n, keep) for n in ("size", "source_size", "target", "taken")}
    body = F.col(text).cast("string")
    r1 = F.xxhash64(F.col(doc_id), F.lit(1), body, F.lit(2), F.col(source))
    r2 = F.hash(body, F.lit(7), F.col(doc_id), F.lit(8), F.col(source))
    held = F.struct(*[F.col(c) for c in keep]).alias("held")
    measured = [
        F.col(doc_id).cast("string").alias("tie"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        mix_key(doc_id, text).alias("key"),
    ]
    # What is kept of a row stays where it is until the end: 96 bits name the row. Rows of one name are written with
    # what is kept of them, and have numbers instead.
    name = ["r1", "r2", "row"]
    listed = materialize(docs.select(r1.alias("r1"), r2.alias("r2"), F.lit(-1).cast("long").alias("row"), *measured), "mix-documents")
    again = materialize(listed.groupBy("r1", "r2").count().where("count > 1").select("r1", "r2"), "mix-again")
    copies = None
    if again.limit(1).count():
        rows = docs.select(r1.alias("r1"), r2.alias("r2"), held, *measured).join(again, ["r1", "r2"], "left_semi")
        copies = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-copies")
        single = listed.join(again, ["r1", "r2"], "left_anti").select(*listed.columns)
        listed = materialize(single.unionByName(copies.select(*listed.columns)), "mix-documents")
    plan = targets(listed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    plan = materialize(plan.withColumn("quota", F.floor("target")), "mix-targets")

    same = F.col("source").eqNullSafe(F.col("_source"))
    sources = plan.select(F.col("source").alias("_source"), "position")
    placed = listed.select(*name, "tie", "source", "size", "key").join(sources, same).drop("source", "_source")
    n_docs = listed.count()
    bits = max(0, (n_docs // BUCKET_ROWS).bit_length())
    bucket = F.shiftright("key", KEY_BITS - bits)
    starts = running(placed.where("size > 0"), "position", bucket, ["key", "tie", "size", *name], F.col("size"), "start")
    pieces = (
        starts.select(*name, "position", "start", (F.col("start") + F.col("size")).alias("stop"))
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (stop - 1) div {block_words})")))
        .withColumn("from", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
        .withColumn("to", F.least(F.col("stop") - F.col("block") * block_words, F.lit(block_words)))
    )
    # Each block with the words that its slots take: all of them some times, and its first words once at most.
    slots = schedule(plan, block_words).groupBy("position", "block").agg(F.collect_list("words").alias("takes"))
    overlap = F.aggregate(
        "takes", F.lit(0).cast("long"), lambda n, w: n + F.greatest(F.least(F.col("to"), w) - F.col("from"), F.lit(0))
    )
    taken = (
        pieces.join(slots, ["position", "block"]).groupBy(*name).agg(F.sum(overlap).alias("taken"))
    )
    facts = plan.select(F.col("source").alias("_source"), "source_size", "target")
    marks = listed.select(*name, "source", "size").join(taken, name, "left").join(facts, same)
    marks = materialize(marks.select(*name, "size", "source_size", "target", "taken"), "mix-marks")
    single = docs.select(r1.alias("r1"), r2.alias("r2"), held).join(marks.where("row < 0"), ["r1", "r2"])
    parts = [single]
    if copies is not None:
        parts.append(copies.select("row", "held").join(marks.where("row >= 0"), "row"))
    results = [
        part.select(
            *[F.col("held")[c].alias(c) for c in keep],
            F.col("size").alias(names["size"]),
            F.col("source_size").alias(names["source_size"]),
            F.col("target").alias(names["target"]),
            F.coalesce("taken", F.lit(0)).cast("long").alias(names["taken"]),
        )
        for part in parts
    ]
    return reduce(DataFrame.unionByName, results), names
