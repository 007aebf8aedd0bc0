"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its hashed word shingles; its sketch is the ``SKETCH`` smallest hashes. Documents with equal
sets form a class first, so exact copies cost nothing later. Of each class, the ``LISTED`` smallest hashes go into
inverted lists. Two sets with similarity 0.8 or more share a listed hash but for a chance below 0.2 ** 12:

* a list of at most ``LONG`` classes serves all its members;
* a longer list (a passage in many documents, or a large group of near copies) serves its *dense* members only, those
  with too few hashes in short lists. Others are found through their short lists, whatever their partner is.

Pairs come from lists in rounds, never all at once. In a star round each list has one member as its centre, and every
class is compared with one centre from another component; the next round takes other centres. Where lists still hold several
components, all pairs between components follow: of short lists as they are, of the dense members of long lists by a
prefix filter on the full sets in the order of rarity (see ``prefixes``), again in star rounds first. So no link that could join components is
left out. A pair must pass the estimate from the union of both sketches (five standard deviations below the
threshold), then the exact similarity of the full sets decides.

Defined results: null texts and texts without words have an empty set, are linked with nothing and are kept; repeated
rows are exact copies; a null id counts as larger than any other.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from shelfcast.llm.common import identified, map_text, materialize, unused
from shelfcast.llm.graph import components
from shelfcast.session import settle

SKETCH = 64
LISTED = 20
LONG = 64
#: Hashes in short lists from which a class needs no long list, and shared hashes without which it has no partner.
SAFE = 12
SHARED = 5
#: The estimate from 64 values may be too low by five standard deviations.
MARGIN = 0.25
STAR_ROUNDS = 2
#: Star rounds over the rare elements of dense sets, before all pairs that are still open.
PREFIX_ROUNDS = 3
#: Bits of the map by which texts that nobody asks for stay where they are (0.5 to 16 MB), bits per text that is asked
#: for, and bits of one of its pieces.
LEAST_BITS, MAP_BITS = 1 << 22, 1 << 27
BITS_EACH = 64
PIECE_BITS = 8 * 4096
#: Each pair stands once, the smaller set first.
BY_SIZE = "(na < nb OR na = nb AND a < b)"

_A = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CACHE = 1 << 16


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, so that neighbouring values are far apart."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingler(width: int):
    """A function from a text to its sorted distinct shingle hashes."""
    seen: dict[bytes, int] = {}

    def hashes(raw: bytes) -> np.ndarray:
        words = raw.lower().split()
        if not words:
            return np.array([], np.int64)
        if len(seen) > _CACHE:
            seen.clear()
        ids = []
        for word in words:
            h = seen.get(word)
            if h is None:
                h = seen[word] = xxhash.xxh64_intdigest(word)
            ids.append(h)
        own = np.array(ids, np.uint64)
        m = min(width, len(own))
        total = np.full(len(own) - m + 1, m, np.uint64)
        for i in range(m):
            total = mixed(total * _A + own[i : len(own) - m + 1 + i])
        return np.unique(total.view(np.int64))

    return hashes


def identity(values: np.ndarray) -> bytes | None:
    return blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def sketches(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, class, n, sketch)`` per document: identity and size of its set, and the smallest hashes."""

    def make():
        shingles = shingler(width)

        def kernel(texts):
            sets = [shingles(raw) for raw in texts]
            return [
                pa.array([identity(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64())),
            ]

        return kernel

    named = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("body"))
    fields = [StructField("class", BinaryType()), StructField("n", LongType()), StructField("sketch", ArrayType(LongType()))]
    return map_text(named, make, fields, text="body", keep=["id"])


def map_bits(n_wanted: int) -> int:
    """A power of two, so that one row in ``BITS_EACH`` that is not wanted is found at most until the map is full."""
    return min(MAP_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n_wanted - 1).bit_length()))


def perhaps_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key is in ``wanted``, and few others: by a map of hashed keys, bounded however many there are.

    The map, which the driver holds while it is sent, has the size that ``wanted`` (a written table) needs. A join with
    ``wanted`` has to follow; it moves the rows that are left only.
    """
    bits = map_bits(wanted.count())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = wanted.select(slot(wanted_key).alias("_slot")).groupBy(F.expr(f"_slot div {PIECE_BITS}").alias("_piece"))
    marks = marks.agg(F.bitmap_construct_agg(F.col("_slot") % PIECE_BITS).alias("_map"))
    byte = F.conv(F.hex(F.expr(f"substring(_map, int(_slot % {PIECE_BITS} div 8) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumn("_slot", slot(key)).withColumn("_at", F.expr(f"_slot div {PIECE_BITS}"))
    found = found.join(F.broadcast(marks), F.col("_at") == F.col("_piece"))
    return found.where(F.call_function("getbit", byte, (F.col("_slot") % 8).cast("int")) == 1).select(*rows.columns)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(class, set)`` for the classes of ``wanted``, whose ``id`` names one document each."""
    body = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("body"))
    body = perhaps_in(body, "_id", wanted, "id")
    found = wanted.select("id", F.col("class").alias("expected")).join(body, F.col("id").eqNullSafe(F.col("_id")))

    def make():
        shingles = shingler(width)

        def kernel(texts):
            sets = [shingles(raw) for raw in texts]
            return [pa.array([identity(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))]

        return kernel

    fields = [StructField("class", BinaryType()), StructField("set", ArrayType(LongType()))]
    # A document id that occurs with several texts finds the one of its class; copies of the same row give one row.
    sets = map_text(found, make, fields, text="body", keep=["expected"]).where("class = expected")
    return sets.groupBy("class").agg(F.first("set").alias("set"))


def similar(a: str, b: str, percent: int) -> Column:
    """Exact: 100 * intersection >= percent * union."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def promising(a: str, b: str, percent: int) -> Column:
    """The estimate from the smallest values of the union; exact where it holds both sets."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return both >= (percent / 100 - MARGIN) * F.size(union)


def inverted_lists(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(value, class, n, long, dense, weight)`` rows of the lists that are used, and the classes in them.

    ``long`` marks the lists of dense classes; ``weight`` is how many classes share a class's hashes, in all.
    """
    listed = classes.select("class", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    sizes = listed.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    lists = materialize(listed.join(materialize(sizes, "list-sizes"), "value"), "lists")
    need = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))
    safe = F.least(F.lit(SAFE), F.floor(F.col("n") * (100 - percent) / 100) + 2)
    members = (
        lists.groupBy("class")
        .agg(
            F.first("n").alias("n"), F.count("*").alias("shared"), F.count_if(F.col("f") > LONG).alias("in_long"),
            F.sum("f").alias("weight"),
        )
        .where(F.col("shared") >= need)
        .withColumn("dense", F.least(F.lit(LISTED), "n") - F.col("in_long") < safe)
    )
    members = materialize(members.select("class", "dense", "weight"), "members")
    used = lists.join(members, "class").withColumn("long", F.col("f") > LONG).where(~F.col("long") | F.col("dense"))
    used = used.select("value", "class", "n", "long", "dense", "weight")
    return materialize(used, "used-lists"), members


def linked_classes(classes: DataFrame, docs: DataFrame, width: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """``(class, root)`` for the classes that may have partners; linked classes share their root."""
    lists, members = inverted_lists(classes, percent)
    wanted = classes.join(members.select("class"), "class", "left_semi")
    facts = materialize(
        full_sets(docs, materialize(wanted.select("class", "id"), "wanted"), width, text, doc_id).join(
            wanted.select("class", "sketch"), "class"
        ),
        "full-sets",
    )
    roots = materialize(members.select("class", F.col("class").alias("root")), "roots")

    def with_column(pairs: DataFrame, end: str, column: str) -> DataFrame:
        own = facts.select(F.col("class").alias(end), F.col(column).alias(f"{end}_{column}"))
        return pairs.join(own, end)

    def verified(pairs: DataFrame) -> DataFrame:
        """``(ra, rb)`` roots joined by the linked ones among the different pairs ``(a, b, na, nb, ra, rb)``."""
        close = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "ra", "rb")
        close = with_column(with_column(close, "a", "sketch"), "b", "sketch")
        close = close.where(promising("a_sketch", "b_sketch", percent)).select("a", "b", "ra", "rb")
        exact = with_column(with_column(close, "a", "set"), "b", "set")
        return materialize(exact.where(similar("a_set", "b_set", percent)).select("ra", "rb"), "links")

    def merge(roots: DataFrame, links: DataFrame) -> DataFrame:
        top = components(links, "ra", "rb")
        moved = roots.join(top, roots["root"] == top["node"], "left")
        return materialize(moved.select("class", F.coalesce(top["root"], roots["root"]).alias("root")), "roots")

    for k in range(STAR_ROUNDS + 1):
        placed = materialize(lists.join(roots, "class"), "placed")
        # Each list with several components, and one of its members as this round's centre: first the one with most
        # in common with others, from which near copies differ by their own edits alone; then another.
        rank = F.struct(F.when(F.lit(k % 2 == 0), F.col("weight")).otherwise(0), F.xxhash64("class", F.lit(k)))
        centre = F.max_by(F.struct("class", "n", "root"), rank)
        open_lists = placed.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), centre.alias("c"))
        open_lists = materialize(open_lists.where("lo != hi").select("value", "c"), "open-lists")
        if open_lists.isEmpty():
            break
        if k < STAR_ROUNDS:
            star = placed.join(open_lists, "value").where("root != c.root")
            # Of the centres of its lists, a member meets the one that it shares most lists with.
            met = star.groupBy("class", "n", "root", "c").agg(F.count("*").alias("m"))
            best = met.groupBy("class", "n", "root").agg(F.max_by("c", F.struct("m", "c")).alias("c"))
            pairs = best.selectExpr("class AS a", "n AS na", "root AS ra", "c.class AS b", "c.n AS nb", "c.root AS rb")
        else:
            rest = placed.join(open_lists.select("value"), "value")
            dense = facts.join(rest.where("long").select("class").distinct(), "class").select("class", "set")
            first = prefixes(dense, percent)
            for j in range(PREFIX_ROUNDS):
                pairs = materialize(prefix_stars(first.join(roots, "class"), percent, j), "prefix-stars")
                if pairs.isEmpty():
                    break
                links = verified(pairs)
                if links.isEmpty():
                    break
                roots = merge(roots, links)
            rest = lists.where("NOT long").join(open_lists.select("value"), "value").join(roots, "class")
            left = rest.selectExpr("value", "class AS a", "n AS na", "root AS ra")
            right = rest.selectExpr("value", "class AS b", "n AS nb", "root AS rb")
            sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
            short = left.join(right, "value").where(f"{BY_SIZE} AND ra != rb AND {sized}").drop("value")
            pairs = short.unionByName(prefix_pairs(first.join(roots, "class"), percent)).distinct()
        links = verified(pairs)
        if not links.isEmpty():
            roots = merge(roots, links)
    return roots


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``(class, n, block1, block2, at, scale)``: the first elements of each set, by which all similar sets meet.

    Elements are ordered from rare to frequent. Similar sets share an element among the first ones of both, a fifth of
    each at 80 percent. A near copy has its own edits first, so of a large group only those with very few edits meet.

    Elements that the same sets hold (a passage that documents share) are one *block*, named by 128 bits of its
    holders, so a pair meets once per block and not once per element. A block stands in one piece in the order, and
    its first element, at position ``at``, is the same in all its sets. ``scale`` counts the steps of the largest ratio of sizes allowed.
    """
    # A row per element: the sets are dealt evenly first, however the files or joins that they come from are cut.
    even = sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = materialize(even.select("class", F.size("set").alias("n"), F.explode("set").alias("value")), "elements")
    holders = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"block{k}") for k in (1, 2)]
    common = items.groupBy("value").agg(F.count("*").alias("f"), *holders).where("f > 1")
    items = items.join(materialize(common, "common-elements"), "value")
    order = Window.partitionBy("class").orderBy("f", "block1", "block2", "value")
    # Elements that no other set has come first; they are not in the join.
    alone = F.col("n") - F.count("*").over(Window.partitionBy("class"))
    items = items.withColumn("at", F.row_number().over(order) - 1 + alone)
    first = items.where(100 * F.col("at") <= (100 - percent) * F.col("n"))
    first = first.groupBy("class", "n", "block1", "block2").agg(F.min("at").alias("at"))
    return materialize(first.withColumn("scale", F.log("n") / math.log(100 / percent)), "prefixes")


def enough_left(percent: int) -> str:
    """From their first shared element on, similar sets have enough elements for the overlap that is needed."""
    return f"{100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb)"


def prefix_stars(first: DataFrame, percent: int, k: int) -> DataFrame:
    """``(a, b, na, nb, ra, rb)``: each class with one centre from another component per block and band of sizes.

    Sets that share rare elements mostly are similar, so few rounds leave little open. Bands move by half a
    step from round to round, which joins neighbouring ones.
    """
    key = ["block1", "block2", "band"]
    placed = first.withColumn("band", F.floor(F.col("scale") + 0.5 * (k % 2)))
    # The fewer rare elements stand before the shared one, the more typical a set is; later rounds try others like it.
    rank = F.struct(F.col("at") + F.pmod(F.xxhash64("class", F.lit(k)), F.lit(1 + 4 * k)), F.xxhash64("class", F.lit(k)))
    centre = F.min_by(F.struct("class", "n", "root", "at"), rank)
    centres = placed.groupBy(*key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), centre.alias("c"))
    centres = materialize(centres.where("lo != hi").select(*key, "c"), "centres")
    met = placed.join(centres, key).selectExpr(
        "class AS a", "n AS na", "root AS ra", "at AS ia", "c.class AS b", "c.n AS nb", "c.root AS rb", "c.at AS ib"
    )
    met = met.where(f"ra != rb AND {enough_left(percent)}")
    return met.select("a", "b", "na", "nb", "ra", "rb").distinct()


def prefix_pairs(first: DataFrame, percent: int) -> DataFrame:
    """``(a, b, na, nb, ra, rb)``: all pairs with different roots that can be similar; ``na <= nb``.

    The first shared element is among the first ninth of the smaller set (at 80 percent). Sizes are in the join key,
    in bands, so sets of too different sizes never meet.
    """
    # A partner's size is at most one band up; sizes at the edge of a band count on both sides of it.
    bands = F.sequence(F.floor(F.col("scale") - 1e-6), F.floor(F.col("scale") + 1 + 1e-6))
    smaller = first.where((100 + percent) * F.col("at") <= (100 - percent) * F.col("n")).withColumn("band", F.explode(bands))
    key = ["block1", "block2", "band"]
    left = smaller.selectExpr(*key, "class AS a", "n AS na", "root AS ra", "at AS ia")
    right = first.withColumn("band", F.floor("scale")).selectExpr(*key, "class AS b", "n AS nb", "root AS rb", "at AS ib")
    met = left.join(right, key).where(f"{BY_SIZE} AND ra != rb AND {enough_left(percent)}")
    return met.select("a", "b", "na", "nb", "ra", "rb")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per document; linked documents share the smallest id among them.

    The result is written; the tables made on the way are removed.
    """
    return settle(docs.sparkSession, "near-duplicates", lambda: component_marks(docs, width, percent, text, doc_id))


def component_marks(docs: DataFrame, width: int, percent: int, text: str, doc_id: str) -> DataFrame:
    drawn = materialize(sketches(docs, width, text, doc_id), "sketches")
    classes = drawn.where("n > 0").groupBy("class").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes, "classes")
    roots = linked_classes(classes, docs, width, percent, text, doc_id)
    placed = classes.select("class", "id").join(roots, "class", "left")
    placed = materialize(placed.select("class", "id", F.coalesce("root", "class").alias("root")), "placed-classes")
    tops = materialize(placed.groupBy("root").agg(F.min("id").alias("component_id")), "components")
    answer = materialize(placed.join(tops, "root").select("class", "component_id"), "class-components")
    # Two names of the key: the join must not be with a renamed copy of the same column.
    result = drawn.select("id", F.col("n").alias("n_shingles"), F.col("class").alias("own")).join(
        answer, F.col("own") == F.col("class"), "left"
    )
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    result = result.select("id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group of near-duplicates, with the documents' own columns.

    Of rows that repeat the kept id with the kept text, one stays.
    """
    marks = near_duplicates(docs, width, percent, text, doc_id)
    again, r1, r2 = (unused(n, docs.columns) for n in ("again", "r1", "r2"))

    def odd_rows() -> DataFrame:
        """96 bits that name a row by id and text, for rows to drop and (``again``) for kept ones that occur repeatedly."""
        chosen = marks.where("kept").select(F.col("id").alias("_kept"), F.lit(True).alias("_found")).distinct()
        rows = identified(docs, text, doc_id).groupBy("_r1", "_r2", "_id").agg(F.count("*").alias("n"))
        rows = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_kept")), "left")
        odd = rows.where("_found IS NULL OR n > 1")
        return odd.select(F.col("_r1").alias(r1), F.col("_r2").alias(r2), F.col("_found").isNotNull().alias(again))

    # Most rows are neither, so their texts stay where they are as long as this table is small enough to broadcast.
    odd = settle(docs.sparkSession, "odd-rows", odd_rows)
    body = docs[text].cast("string")
    named = docs.withColumns({r1: F.xxhash64(docs[doc_id], body), r2: F.hash(body, F.lit(7), docs[doc_id])})
    single = named.join(odd, [r1, r2], "left_anti")
    repeated = named.join(odd.where(F.col(again)), [r1, r2], "left_semi").dropDuplicates([r1, r2])
    return single.unionByName(repeated).select(*docs.columns)
