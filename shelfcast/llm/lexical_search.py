"""Ranked lexical search: the best documents of each item, scored once per bag of item words.

Method (bag deduplication): a document is only its counts of words that some item has, and its length class ``m``.
Documents with equal counts and equal ``m`` score alike for every item, so they form a class: rows are grouped by a
64-bit hash of the counts, by ``m`` and by the counts themselves, which is the verification. Classes are scored once,
against all items, in numpy batches; then the classes that an item takes are expanded to their documents by ascending
id.

Bounds. Items are worked in blocks of about ``BLOCK_PAIRS`` (item, word) pairs and ``BLOCK_ITEMS`` items, each block
against all documents; a block's words, weights and postings are what tasks hold, whatever the number of documents. A
task keeps ``k`` classes per item: a class with ``k`` better classes (by score, then by smallest id) before it has ``k``
better documents before each of its own. Of a class only the ``k`` smallest ids can be taken, which the window limit
cuts inside each task before anything is shuffled, so that a class that holds a third of all rows is small. The
classes taken (at most ``k`` per item of a block) are what is broadcast.

Odd input: a null or empty text has no word and is never a result; items without words, or whose words no document
has, have no rows; rows of one ``item_id`` are one item (null is an id of its own); repeated documents each take a rank
of their own; a null ``doc_id`` comes after all others. Document ids are whole numbers. Further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from shelfcast.llm.common import map_text, materialize

#: Bounds of a block of items.
BLOCK_PAIRS = 400_000
BLOCK_ITEMS = 5_000

#: Cells and postings of one scoring step inside a task.
CELLS = 4 << 20

#: Ids sort as whole numbers; a null id counts as this one.
NO_ID = (1 << 63) - 1

#: Bytes of a word: digits, letters (capitals become small) and all bytes of characters beyond ASCII.
_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_TABLE = bytes(b if b in _KEPT else 32 for b in bytes(range(256)).lower())


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def item_terms(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """Distinct ``(item, term)`` pairs."""

    def make():
        return lambda texts: [pa.array([sorted(set(terms_of(raw))) for raw in texts], pa.list_(pa.binary()))]

    named = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    lists = map_text(named, make, [StructField("terms", ArrayType(BinaryType()))], keep=["item"])
    return lists.select("item", F.explode("terms").alias("term")).distinct()


class Block:
    """The items of one block: words, and for each word the items that have it."""

    def __init__(self, pairs: pa.Table):
        items = pairs.column("item").to_pylist()
        words = pairs.column("term").to_pylist()
        self.items = list(dict.fromkeys(items))
        at = {item: i for i, item in enumerate(self.items)}
        self.words = {w: i for i, w in enumerate(dict.fromkeys(words))}
        item = np.array([at[i] for i in items], np.int64)
        word = np.array([self.words[w] for w in words], np.int64)
        self.postings = item[np.argsort(word, kind="stable")]
        self.sizes = np.bincount(word, minlength=len(self.words))
        self.starts = np.cumsum(self.sizes) - self.sizes


def bags(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """``doc``, ``n`` (all words) and ``bag``: (word, count) pairs of the block's words in order, as 32-bit numbers."""
    v = len(words)

    def make():
        def kernel(texts):
            lists = [terms_of(raw) for raw in texts]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter((i for ws in lists for i in map(words.get, ws, repeat(-1))), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(lists)), n)
            known = ids >= 0
            keys, counts = np.unique(doc[known] * v + ids[known], return_counts=True)
            pairs = np.empty((len(keys), 2), "<u4")
            pairs[:, 0], pairs[:, 1] = keys % v, counts
            cuts = np.searchsorted(keys, np.arange(len(lists) + 1) * v)
            out = [pairs[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            return [pa.array(n), pa.array(out, pa.binary())]

        return kernel

    return map_text(docs, make, [StructField("n", LongType()), StructField("bag", BinaryType())], keep=["doc"])


def statistics(held: DataFrame, v: int) -> tuple[int, int, np.ndarray]:
    """Documents with a word, all words, and the documents of each word of the block."""

    def run(batches):
        df, n_docs, n_words = np.zeros(v, np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            n_docs, n_words = n_docs + int((n > 0).sum()), n_words + int(n.sum())
            df += np.bincount(unpack(batch.column("bag").to_pylist())[0][:, 0], minlength=v)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], seen])), pa.array(np.concatenate([[n_docs, n_words], df[seen]]))],
            names=["word", "count"],
        )

    sums = held.select("n", "bag").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))
    found = {r["word"]: r["count"] for r in sums.collect()}
    df = np.array([found.get(i, 0) for i in range(v)], np.int64)
    return found.get(-1, 0), found.get(-2, 0), df


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All (word, count) pairs as an array, and the number of pairs of each bag."""
    pairs = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2).astype(np.int64)
    return pairs, np.fromiter(map(len, packed), np.int64, len(packed)) // 8


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class Scorer:
    """Scores classes against a block's items and keeps the best ``k`` classes of each."""

    def __init__(self, block: Block, weight: np.ndarray, k: int):
        self.block, self.weight, self.k = block, weight, k
        self.n = len(block.items)
        self.least = np.ones(self.n, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4  # item, score, smallest id, place in ``classes``
        self.classes: list[tuple] = []
        self.pending: list[list[np.ndarray]] = []

    def scores(self, m: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of some classes (rows) for all items (columns), in 64-bit whole numbers."""
        block, row = self.block, np.repeat(np.arange(len(m)), sizes)
        word, tf = pairs[:, 0], pairs[:, 1]
        gain = self.weight[word] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        many = block.sizes[word]
        shift = np.repeat(block.starts[word] - (np.cumsum(many) - many), many)
        item = block.postings[np.arange(len(shift)) + shift]
        out = np.zeros(len(m) * self.n, np.int64)
        np.add.at(out, np.repeat(row * self.n, many) + item, np.repeat(gain, many))
        return out.reshape(len(m), self.n)

    def add(self, h: list, m: np.ndarray, packed: list[bytes], first: np.ndarray) -> None:
        pairs, sizes = unpack(packed)
        work = np.add.reduceat(np.append(self.block.sizes[pairs[:, 0]], 0), np.cumsum(sizes) - sizes)
        start, ends = 0, np.cumsum(sizes)
        load = np.cumsum(np.maximum(work, self.n))
        while start < len(m):
            before = load[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(load, before + CELLS, "right")))
            found = self.scores(m[start:stop], pairs[ends[start] - sizes[start] : ends[stop - 1]], sizes[start:stop])
            row, item = np.nonzero(found >= self.least)
            if len(row):
                used, place = np.unique(row, return_inverse=True)
                base = len(self.classes)
                self.classes += [(h[i], int(m[i]), packed[i], int(first[i])) for i in (used + start).tolist()]
                self.pending.append([item, found[row, item], first[start + row], base + place])
                if sum(len(p[0]) for p in self.pending) > 8 * self.k * self.n:
                    self.prune()
            start = stop

    def prune(self) -> None:
        item, score, first, place = (np.concatenate(parts) for parts in zip(self.kept, *self.pending))
        order = np.lexsort((first, -score, item))
        item, score, first, place = item[order], score[order], first[order], place[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        best = rank < self.k
        full = item[rank == self.k - 1]
        self.least[full] = score[rank == self.k - 1]
        used, place = np.unique(place[best], return_inverse=True)
        self.classes = [self.classes[i] for i in used.tolist()]
        self.kept, self.pending = [item[best], score[best], first[best], place], []


def best_classes(classes: DataFrame, block: Block, weight: np.ndarray, k: int) -> DataFrame:
    """The best classes of each item within each task."""

    def run(batches):
        scorer = Scorer(block, weight, k)
        for batch in batches:
            if batch.num_rows:
                scorer.add(
                    batch.column("h").to_pylist(),
                    batch.column("m").to_numpy(),
                    batch.column("bag").to_pylist(),
                    batch.column("first").to_numpy(),
                )
        scorer.prune()
        item, score, first, place = scorer.kept
        for start in range(0, len(item), 4096):
            part = slice(start, start + 4096)
            held = [scorer.classes[i] for i in place[part].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item[part]), pa.array(score[part]), pa.array(first[part]), pa.array([c[0] for c in held], pa.int64()),
                    pa.array([c[1] for c in held], pa.int64()), pa.array([c[2] for c in held], pa.binary()),
                ],
                names=["at", "score", "first", "h", "m", "bag"],
            )

    return classes.mapInArrow(run, "at long, score long, first long, h long, m long, bag binary")


def take(df: DataFrame, by: list[str], order: list, k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group; tasks cut their own rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def rank_block(docs: DataFrame, block: Block, k: int) -> DataFrame | None:
    held = materialize(bags(docs, block.words), "search-bags")
    n_docs, n_words, df = statistics(held, len(block.words))
    if not n_words:
        return None
    m = F.expr(f"100 - 50 + (50L * n * {n_docs}L) div {n_words}L")
    known = held.where(F.length("bag") > 0).select(F.col("doc"), m.alias("m"), "bag")
    known = known.withColumn("h", F.xxhash64("m", "bag"))
    classes = known.groupBy("h", "m", "bag").agg(F.min("doc").alias("first"))
    found = best_classes(classes, block, weights(n_docs, df), k)
    taken = materialize(take(found, ["at"], [F.desc("score"), F.asc("first")], k, "r").drop("r", "first"), "search-classes")
    keys = taken.select("h", "m").distinct()
    members = take(known.join(F.broadcast(keys), ["h", "m"], "left_semi"), ["h", "m", "bag"], [F.asc("doc")], k, "r").drop("r")
    ranked = take(taken.join(members, ["h", "m", "bag"]), ["at"], [F.desc("score"), F.asc("doc")], k, "rank")
    return ranked.select("at", "rank", "doc", "score")


def rank(
    docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", block_pairs: int = BLOCK_PAIRS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    body = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    pairs = materialize(item_terms(items, item_text, item_id), "search-items")
    size = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.coalesce(F.xxhash64("item"), F.lit(0))).alias("items")).first()
    blocks = max(1, -(-size["pairs"] // block_pairs), -(-size["items"] // block_items))
    item_type = items.schema[item_id].dataType
    out = []
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        block = Block(own.orderBy("item", "term").toArrow())
        ranked = rank_block(body, block, k) if block.items else None
        if ranked is not None:
            schema = StructType([StructField("at", LongType()), StructField("item_id", item_type)])
            names = spark.createDataFrame(list(enumerate(block.items)), schema)
            out.append(ranked.join(F.broadcast(names), "at"))
    if not out:
        numbers = [StructField(c, LongType()) for c in ("at", "rank", "doc", "score")]
        out = [spark.createDataFrame([], StructType([*numbers, StructField("item_id", item_type)]))]
    return reduce(DataFrame.unionByName, out).select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score"
    )
