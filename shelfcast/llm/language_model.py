"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

A token's probability is that of its class times that within the class, given the history. Of the most frequent words
of the training text, ``HEAD`` are spread over head classes of ``WIDTH`` words by frequency; every other word is in
the tail class of its last two bytes. Both factors of a head word are softmaxes over the weights of hashed features of
the history: the word before, the one before that (a skip feature), and both together. Within a tail class, a word
has its smoothed share of the class in the training text.

Training is distributed: in each round the tasks start from the same weights, take sparse gradient steps over their
documents in numpy batches, and return by how much each row of weights has moved; the moves are averaged over the
tasks that have moved the row. A training document is in one round, so all of them are used once. The model has a
fixed size; counts of words grow with the corpus and stay in tables.

Scoring looks up the counts of the ``KNOWN`` most frequent words in a broadcast of bounded size. Rarer tokens are
hashed and joined with the table of all counts.

Defined results: a null or empty text has one token, the end; words unknown to the training text count as c = 0; with
no training text, every token has the probability of an unknown word in an empty vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from shelfcast.llm.common import chunks, map_rows, materialize

#: The end of a text; no word has a blank in it.
END = b" "
WIDTH = 32
HEAD_CLASSES = 16
TAIL_CLASSES = 16
HEAD = WIDTH * HEAD_CLASSES
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Words whose counts are broadcast; some 60 bytes each in a task.
KNOWN = 1 << 17
#: Rows of weights per feature, for the classes and again for the words within head classes.
ROWS = 1 << 13
FEATURES = 3
ROUNDS = 2
BATCH = 8192
STEP = 0.15
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000


def tail_class(word: bytes) -> int:
    return crc32(word[-2:]) % TAIL_CLASSES


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(word, tail, n)`` over all texts, the end of each included."""
    schema = StructType([StructField("word", StringType()), StructField("tail", IntegerType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = list(counts)
            columns = [
                pa.array(words, pa.binary()).cast(pa.string()),
                pa.array([tail_class(w) for w in words], pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            for _, texts in chunks(batch, "body"):
                for raw in texts:
                    counts.update(raw.lower().split())
                counts[END] += len(texts)
                if len(counts) > COUNTED:
                    yield passed_on()
        yield passed_on()

    rows = docs.select(F.col(text).cast("string").alias("body")).mapInArrow(run, schema)
    return rows.groupBy("word", "tail").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words with their counts, the head first, and totals of the training text."""

    words: list[bytes]
    counts: np.ndarray
    tails: np.ndarray
    tokens: int
    distinct: int
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray

    @property
    def head(self) -> int:
        return min(HEAD, len(self.words))

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and place within the head class (-1 in the tail) by id; ids from ``len(words)`` on are tail classes."""
        ids = np.arange(len(self.words))
        own = np.where(ids < self.head, ids // WIDTH, HEAD_CLASSES + self.tails)
        place = np.where(ids < self.head, ids % WIDTH, -1)
        tail = np.arange(TAIL_CLASSES)
        return np.concatenate([own, HEAD_CLASSES + tail]), np.concatenate([place, np.full(TAIL_CLASSES, -1)])


class Ids(dict):
    """Id of a word; of one that is not listed, that of its tail class."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.size = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.size + tail_class(word)


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """From a written table of word counts; at most ``known`` rows come to the driver."""
    top = counts.orderBy(F.desc("n"), "word").limit(known).toArrow()
    words = [w.encode() for w in top["word"].to_pylist()]
    if END in words:  # always a head word
        i = words.index(END)
        order = [i, *range(i), *range(i + 1, len(words))]
        words = [words[k] for k in order]
        top = top.take(order)
    head = {w.decode() for w in words[:HEAD]}
    all_of = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["tail"]], distinct[r["tail"]] = r["n"], r["v"]
    n, tails = top["n"].to_numpy().astype(np.int64), top["tail"].to_numpy().astype(np.int64)
    np.subtract.at(tokens, tails[: len(head)], n[: len(head)])
    np.subtract.at(distinct, tails[: len(head)], 1)
    return Vocabulary(words, n, tails, int(all_of["n"]), int(all_of["v"]), tokens, distinct)


@dataclass
class Model:
    """Start values of both factors (log shares), and one matrix of feature weights for both."""

    class_base: np.ndarray
    word_base: np.ndarray
    weights: np.ndarray


def start_model(v: Vocabulary) -> Model:
    counts = np.zeros((HEAD_CLASSES, WIDTH))
    counts.flat[: v.head] = v.counts[: v.head]
    live = np.zeros(HEAD_CLASSES * WIDTH, bool)
    live[: v.head] = True
    mass = np.concatenate([counts.sum(1), v.tail_tokens + v.tail_distinct + 1.0])
    # A head class without words can't be drawn.
    with np.errstate(divide="ignore"):
        class_base = np.log(mass / mass.sum())
        word_base = np.where(live.reshape(counts.shape), np.log(counts / np.maximum(counts.sum(1, keepdims=True), 1)), -np.inf)
    weights = np.zeros((2 * FEATURES * ROWS, WIDTH), np.float32)
    return Model(np.maximum(class_base, -1e4).astype(np.float32), np.maximum(word_base, -1e4).astype(np.float32), weights)


_H = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - 13)
assert ROWS == 1 << 13 and CLASSES == WIDTH


def feature_rows(before: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    """Rows of the class weights for the word before, the skipped-to word, and both."""
    a, b = before.astype(np.uint64) + np.uint64(1), earlier.astype(np.uint64) + np.uint64(1)
    mixed = [a * _H[0], b * _H[1], (a * _H[0] ^ (b * _H[2] + _H[1])) * _H[0]]
    return [(m >> _SHIFT).astype(np.int64) + i * ROWS for i, m in enumerate(mixed)]


def word_rows(rows: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    """Rows of the word weights: the same features together with the class."""
    salt = classes.astype(np.uint64) * _H[2] + _H[1]
    out = []
    for i, r in enumerate(rows):
        m = ((r.astype(np.uint64) + np.uint64(1)) * _H[0] ^ salt) * _H[1]
        out.append((m >> _SHIFT).astype(np.int64) + (FEATURES + i) * ROWS)
    return out


def log_softmax(base: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = base + weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def token_stream(texts: list[bytes], ids: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens, of the one before and the one before that (-1 before the text), and tokens per text."""
    get = ids.__getitem__
    parts, sizes = [], []
    for raw in texts:
        words = raw.lower().split()
        words.append(END)
        parts.append(np.fromiter(map(get, words), np.int64, len(words)))
        sizes.append(len(words))
    tokens = np.concatenate(parts) if parts else np.array([], np.int64)
    sizes = np.array(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = -1
    earlier = np.empty_like(tokens)
    earlier[1:] = before[:-1]
    earlier[starts] = -1
    return tokens, before, earlier, sizes


def steps(model: Model, weights: np.ndarray, squares: np.ndarray, cls, place, before, earlier) -> None:
    """One adaptive gradient step for a batch of tokens, in place."""
    rows = feature_rows(before, earlier)
    error = np.exp(log_softmax(model.class_base, weights, rows))
    error[np.arange(len(cls)), cls] -= 1
    moves = [(rows, error)]
    head = np.flatnonzero(place >= 0)
    if len(head):
        inner = word_rows([r[head] for r in rows], cls[head])
        inside = np.exp(log_softmax(model.word_base[cls[head]], weights, inner))
        inside[np.arange(len(head)), place[head]] -= 1
        moves.append((inner, inside))
    for own, values in moves:
        for r in own:
            order = np.argsort(r, kind="stable")
            at = r[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            gradient = np.add.reduceat(values[order], first, axis=0)
            row = at[first]
            squares[row] += gradient * gradient
            weights[row] -= STEP * gradient / np.sqrt(squares[row] + 1)


def train(docs: DataFrame, v: Vocabulary, doc_id: str, text: str, rounds: int = ROUNDS) -> Model:
    """Local gradient steps over all documents, averaged after each of ``rounds`` disjoint parts."""
    spark = docs.sparkSession
    model = start_model(v)
    if not v.tokens:
        return model
    words = spark.sparkContext.broadcast(v)
    moved = StructType([StructField("row", IntegerType()), StructField("move", BinaryType())])
    merged = StructType([*moved.fields, StructField("tasks", IntegerType())])
    for k in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, v = start.value, words.value
            ids = Ids(v.words)
            classes, places = v.classes()
            weights, squares = own.weights.copy(), np.zeros_like(own.weights)
            for batch in batches:
                for _, texts in chunks(batch, "body"):
                    tokens, before, earlier, _ = token_stream(texts, ids)
                    cls, place = classes[tokens], places[tokens]
                    for a in range(0, len(tokens), BATCH):
                        b = slice(a, a + BATCH)
                        steps(own, weights, squares, cls[b], place[b], before[b], earlier[b])
            row = np.flatnonzero(squares.any(axis=1))
            move = (weights[row] - own.weights[row]).astype(np.float32)
            columns = [pa.array(row.astype(np.int32)), pa.array([m.tobytes() for m in move], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=moved.names)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2 * FEATURES * ROWS, WIDTH), np.float32)
            tasks = np.zeros(len(total), np.int32)
            for batch in batches:
                if batch.num_rows:
                    row = batch.column("row").to_numpy()
                    np.add.at(tasks, row, 1)
                    np.add.at(total, row, np.frombuffer(b"".join(batch.column("move").to_pylist()), np.float32).reshape(-1, WIDTH))
            row = np.flatnonzero(tasks)
            columns = [pa.array(row.astype(np.int32)), pa.array([m.tobytes() for m in total[row]], pa.binary()), pa.array(tasks[row])]
            yield pa.RecordBatch.from_arrays(columns, names=merged.names)

        part = F.pmod(F.xxhash64(doc_id, text), F.lit(rounds)) == k
        bodies = docs.where(part).select(F.col(text).cast("string").alias("body"))
        sums = bodies.mapInArrow(run, moved).repartition("row").mapInArrow(add, merged).toArrow()
        if sums.num_rows:
            row = sums["row"].to_numpy()
            total = np.frombuffer(b"".join(sums["move"].to_pylist()), np.float32).reshape(-1, WIDTH)
            model.weights[row] += total / sums["tasks"].to_numpy()[:, None]
    return model


def scores(docs: DataFrame, v: Vocabulary, model: Model, counts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``n_tokens, n_known, base_score, score`` (log10)."""
    spark = docs.sparkSession
    both = spark.sparkContext.broadcast((v, model))
    fields = [
        StructField("_tokens", LongType()), StructField("_listed", LongType()), StructField("_base", DoubleType()),
        StructField("_score", DoubleType()), StructField("_rare", ArrayType(LongType())),
    ]

    def make():
        v, model = both.value
        ids = Ids(v.words)
        size = len(v.words)
        classes, places = v.classes()
        tail_total = np.log10(v.tail_tokens + v.tail_distinct + 1.0)
        log_count = np.concatenate([np.log10(v.counts + 1.0), np.zeros(TAIL_CLASSES)])
        base_total = np.log10(v.tokens + v.distinct + 1.0)

        def kernel(texts, _):
            tokens, before, earlier, sizes = token_stream(texts, ids)
            cls, place = classes[tokens], places[tokens]
            logp = np.empty(len(tokens))
            for a in range(0, len(tokens), BATCH):
                b = slice(a, a + BATCH)
                c, p = cls[b], place[b]
                rows = feature_rows(before[b], earlier[b])
                own = log_softmax(model.class_base, model.weights, rows)[np.arange(len(c)), c].astype(np.float64)
                head = np.flatnonzero(p >= 0)
                inner = word_rows([r[head] for r in rows], c[head])
                inside = log_softmax(model.word_base[c[head]], model.weights, inner)
                own[head] += inside[np.arange(len(head)), p[head]]
                logp[b] = own / np.log(10)
            tail = place < 0
            # Counts of tokens that are not listed are added from the table of all counts.
            logp[tail] += log_count[tokens[tail]] - tail_total[cls[tail] - HEAD_CLASSES]
            starts = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.array([])
            listed = (tokens < size).astype(np.int64)
            rare = []
            for raw, a, n, known in zip(texts, starts, sizes, add(listed)):
                if known == n:
                    rare.append([])
                    continue
                words = raw.lower().split()
                rest = np.flatnonzero(listed[a : a + n] == 0)
                rare.append(np.array([xxhash.xxh64_intdigest(words[i], 42) if i < n - 1 else _END_KEY for i in rest], np.uint64).view(np.int64))
            return [
                pa.array(sizes, pa.int64()), pa.array(add(listed), pa.int64()),
                pa.array(add(log_count[tokens]) - sizes * base_total, pa.float64()), pa.array(add(logp), pa.float64()),
                pa.array(rare, pa.list_(pa.int64())),
            ]

        return kernel

    held = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_held"), F.col(text).cast("string").alias("_body"))
    drawn = map_rows(held, make, fields, "_body", ["_held"]).withColumn("_row", F.monotonically_increasing_id())
    drawn = materialize(drawn, "lm-partial")
    rare = drawn.select("_row", F.explode("_rare").alias("key"))
    by_key = counts.select(F.xxhash64("word").alias("key"), "n")
    found = rare.join(by_key, "key").groupBy("_row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    joined = drawn.drop("_rare").join(found, "_row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        *[F.col("_held")[c].alias(c) for c in keep],
        F.col("_tokens").alias("n_tokens"),
        (F.col("_listed") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + more).alias("base_score"),
        (F.col("_score") + more).alias("score"),
    )


_END_KEY = xxhash.xxh64_intdigest(END, 42)


def score_documents(
    docs: DataFrame, train_on: Column, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Train on the documents for which ``train_on`` holds and score all of them.

    Returns the columns ``keep`` and ``n_tokens, n_known, train_tokens, base_score, score``; both scores are log10.
    """
    own = docs.where(train_on)
    counts = materialize(word_counts(own, text), "word-counts")
    v = vocabulary(counts)
    model = train(own, v, doc_id, text)
    return scores(docs, v, model, counts, text, list(keep))
