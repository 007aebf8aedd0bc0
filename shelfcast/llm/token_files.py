"""Token ids of all documents as files of range-coded blocks, written in order of ids and read back in any order.

Files. A folder of Parquet files, so that any Spark file system and committer can hold it and a lost executor's files are
written again. A row is a block of one part's chain of ids: ``part`` and ``block`` number, ``first`` (ids of the part
before it), ``n_ids``, ``payload`` (see ``range_coder``: the model starts anew in each block, and the block has its
checksum) and the documents that have ids in it: ``doc_at`` (place of the first of them in its part), ``doc_ids``,
``doc_starts`` and ``doc_sizes`` (within the part). Parts follow each other in the order of document ids.

Writing. Texts become ids once, in a written table; its rows are sorted by document id over ranges, then by a hash of
the text, so that a document id that a third of all rows have is split as well. A task holds ``LANES`` blocks at a time.

Reading. Every row can be decoded by itself, so file splits need not keep the order. A document's CRC-32 over several
blocks is the exclusive-or of its pieces' sums, each moved by the bytes that follow it, so that pieces need not meet
in order.

Odd input: a null or empty text has no ids but the end mark; a null document id comes first; repeated ids and rows
each keep their own ids. Further columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from shelfcast.llm.common import map_text, materialize
from shelfcast.llm.range_coder import BLOCK_IDS, LANES, crc_of, decode_blocks, encode_blocks

#: White space that every word tokenizer drops or cuts at, as blanks; a text's ids are those of its words.
BLANKS = bytes.maketrans(b"\t\n\r", b"   ")

#: Known words that a Python worker keeps, and new ones that are encoded as one text.
KEPT_WORDS = 1_000_000
WORDS_AT_ONCE = 1_000
#: A sign that stands between words of one text, where the tokenizer makes one id of it.
BETWEEN = "\x01"


class WordTokenizer:
    """A file of the ``tokenizers`` library that drops white space, so that words can be encoded one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between, self.mark = next(iter(special.items()), (None, None))
        # A special token costs a search and a text of its own; an ordinary word that is one id does not.
        alone, (sign,) = self.encode([f" {BETWEEN} "])[0], self.encode([f"a {BETWEEN} {BETWEEN} a"])
        if len(alone) == 1 and sign.count(alone[0]) == 2 and self.between is not None:
            self.between, self.mark = BETWEEN, alone[0]
        self.special = re.compile("|".join(map(re.escape, [*special, BETWEEN]))) if special else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; many words are one text, with a sign between them."""
        if self.special is None:
            return [np.array(ids, np.uint32) for ids in self.encode(words)]
        out: list = [None] * len(words)
        odd = [i for i, w in enumerate(words) if self.special.search(w)]
        skip = set(odd)
        plain = [i for i in range(len(words)) if i not in skip]
        parts = [plain[i : i + WORDS_AT_ONCE] for i in range(0, len(plain), WORDS_AT_ONCE)]
        joint = f" {self.between} "
        for part, ids in zip(parts, self.encode([joint.join([words[i] for i in p]) for p in parts])):
            chain = np.array(ids, np.uint32)
            cuts = [-1, *np.flatnonzero(chain == self.mark).tolist(), len(chain)]
            if len(cuts) != len(part) + 1:  # a word has the sign's id
                odd += part
                continue
            for i, lo, hi in zip(part, cuts, cuts[1:]):
                out[i] = chain[lo + 1 : hi]
        for i, ids in zip(odd, self.encode([words[i] for i in odd]) if odd else []):
            out[i] = np.array(ids, np.uint32)
        return out


class TextEncoder:
    """Ids of texts by the words seen so far."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        split = [raw.translate(BLANKS).decode("utf-8", "replace").split(" ") if raw else [] for raw in texts]
        words = [w for ws in split for w in ws]
        if len(self.known) > KEPT_WORDS:
            self.clear()
        at = list(map(self.known.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at) if i is None))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            found = self.tokenizer.words(new)
            self.ids = np.concatenate([self.ids, *found])
            self.counts = np.append(self.counts, np.fromiter(map(len, found), np.int64, len(found)))
            self.starts = np.cumsum(self.counts) - self.counts
            at = [self.known[w] if i is None else i for w, i in zip(words, at)]
        at = np.array(at, np.int64)
        counts = self.counts[at] if len(at) else np.zeros(0, np.int64)
        shift = np.repeat((self.starts[at] if len(at) else counts) - (np.cumsum(counts) - counts), counts)
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        return self.ids[np.arange(len(shift)) + shift], np.bincount(doc, counts, len(texts)).astype(np.int64)


#: The encoder of this Python worker, by the function that loads its tokenizer: a worker's tasks meet the same words.
_ENCODER: list[tuple[Callable, TextEncoder]] = []


def encoder_of(load: Callable[[], WordTokenizer]) -> TextEncoder:
    if not _ENCODER or _ENCODER[0][0] is not load:
        _ENCODER[:] = [(load, TextEncoder(load()))]
    return _ENCODER[0][1]


def forget_words() -> None:
    """Give the memory of known words back, before a task that needs none."""
    for _, encoder in _ENCODER:
        encoder.clear()


def tokenized(docs: DataFrame, load: Callable[[], WordTokenizer], end_id: int, text: str, doc_id: str) -> DataFrame:
    """``doc``, a hash of the text, and the compressed ids with the end mark, written."""
    named = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("mix"), F.col(text).alias("text"))

    def make():
        encoder = encoder_of(load)
        pack = zstandard.ZstdCompressor(level=1).compress

        def kernel(texts):
            ids, sizes = encoder.encode(texts)
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            cuts = [0, *(ends + np.arange(1, len(ends) + 1)).tolist()]
            return [pa.array([pack(ids[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])], pa.binary())]

        return kernel

    return materialize(map_text(named, make, [StructField("ids", BinaryType())], keep=["doc", "mix"]), "tokens")


class Part:
    """The chain of one part's ids, cut into blocks."""

    def __init__(self, number: int, id_type: pa.DataType, names: list[str]):
        self.number, self.id_type, self.names = number, id_type, names
        self.docs: list[tuple] = []  # id, start and size of documents that reach into the next block
        self.first_doc, self.total, self.block = 0, 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        chain = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(chain) if last else len(chain) - len(chain) % BLOCK_IDS
        at = self.total - len(chain)
        for start in range(0, stop, LANES * BLOCK_IDS):
            blocks = [chain[i : min(i + BLOCK_IDS, stop)] for i in range(start, min(start + LANES * BLOCK_IDS, stop), BLOCK_IDS)]
            yield self.batch(at + start, blocks, encode_blocks(blocks))
        self.held, self.n_held = [chain[stop:]], len(chain) - stop

    def batch(self, at: int, blocks: Sequence[np.ndarray], coded: list[bytes]) -> pa.RecordBatch:
        rows, n = [], 0
        for ids, payload in zip(blocks, coded):
            end = at + len(ids)
            stop = n
            while stop < len(self.docs) and self.docs[stop][1] < end:
                stop += 1
            own = self.docs[n:stop]
            rows.append((self.number, self.block, at, len(ids), payload, self.first_doc + n, *map(list, zip(*own))))
            n = stop - (own[-1][1] + own[-1][2] > end)
            at, self.block = end, self.block + 1
        self.docs, self.first_doc = self.docs[n:], self.first_doc + n
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(self.id_type),
                 pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=self.names)


def write_tokens(
    docs: DataFrame, load: Callable[[], WordTokenizer], end_id: int, path: str, text: str = "text", doc_id: str = "doc_id"
) -> str:
    """Write the ids of all documents, each closed by ``end_id``, in order of document ids."""
    rows = tokenized(docs, load, end_id, text, doc_id)
    order = ["doc", "mix", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # splits rows that are alike, in whatever order
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "ids")
    id_type = rows.schema["doc"].dataType
    schema = StructType(
        [StructField("part", IntegerType()), *[StructField(c, LongType()) for c in ("block", "first")],
         StructField("n_ids", IntegerType()), StructField("payload", BinaryType()), StructField("doc_at", LongType()),
         StructField("doc_ids", ArrayType(id_type)), *[StructField(c, ArrayType(LongType())) for c in ("doc_starts", "doc_sizes")]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        open_, part = zstandard.ZstdDecompressor().decompress, None
        for batch in batches:
            docs_ = batch.column("doc")
            part = part or Part(TaskContext.get().partitionId(), docs_.type, schema.names)
            for doc, packed in zip(docs_.to_pylist(), batch.column("ids").to_pylist()):
                part.add(doc, np.frombuffer(open_(packed), "<u4"))
                if part.n_held >= LANES * BLOCK_IDS:
                    yield from part.flush(last=False)
        if part:
            yield from part.flush(last=True)

    ordered.mapInArrow(run, schema).write.parquet(path)
    return path


#: Gets the ids of a document in a block and how many ids of the document follow the block; gives the fields' values.
View = Callable[[np.ndarray, int], tuple]


def read_pieces(spark: SparkSession, path: str, view: View, fields: Sequence[StructField]) -> DataFrame:
    """Per block and document: ``part``, ``doc_at``, ``doc``, ``start`` in the part, ``size``, and what ``view`` gives."""
    table = spark.read.parquet(path)
    own = [StructField("part", IntegerType()), StructField("doc_at", LongType()),
           StructField("doc", table.schema["doc_ids"].dataType.elementType), StructField("start", LongType()),
           StructField("size", LongType())]
    schema = StructType([*own, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            kinds = kinds or [pa.int32(), pa.int64(), batch.column("doc_ids").type.value_type, pa.int64(), pa.int64()]
            for at in range(0, batch.num_rows, LANES):
                blocks = batch.slice(at, LANES).to_pylist()
                out: list[tuple] = []
                for row, ids in zip(blocks, decode_blocks([b["payload"] for b in blocks])):
                    if len(ids) != row["n_ids"]:
                        raise ValueError("a block of ids has another length than its row says")
                    docs = zip(row["doc_ids"], row["doc_starts"], row["doc_sizes"])
                    for k, (doc, start, size) in enumerate(docs):
                        lo, hi = max(start - row["first"], 0), min(start + size - row["first"], len(ids))
                        after = start + size - (row["first"] + hi)
                        out.append((row["part"], row["doc_at"] + k, doc, start, size, *view(ids[lo:hi], after)))
                if out:
                    columns = list(zip(*out))
                    arrays = [pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array(c) for c in columns[5:]]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    needed = table.select("part", "first", "n_ids", "payload", "doc_at", "doc_ids", "doc_starts", "doc_sizes")
    return needed.mapInArrow(run, schema)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids of all parts before each part; a row per part, at most as many as the write had tasks."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


#: Fixed values of CRC-32 (its polynomial and 1, x and x^8 modulo it, lowest power first).
_POLYNOMIAL = 0xEDB88320
_ONE = 1 << 31
_BYTE = 1 << 23


def _times(a: int, b: int) -> int:
    out = 0
    for power in range(32):
        if a >> (31 - power) & 1:
            out ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def moved_crc(crc: int, n_bytes: int) -> int:
    """What a piece's CRC-32 adds to that of a whole in which ``n_bytes`` bytes follow the piece."""
    power, step = _ONE, _BYTE
    while n_bytes:
        if n_bytes & 1:
            power = _times(power, step)
        step = _times(step, step)
        n_bytes >>= 1
    return _times(power, crc)


def piece_crc(ids: np.ndarray, after: int) -> tuple[int]:
    crc = crc_of(ids)
    return (moved_crc(crc, 4 * after) if after else crc,)


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    pieces = materialize(read_pieces(spark, path, piece_crc, [StructField("crc", LongType())]), "token-pieces")
    key = ["part", "doc_at"]
    counted = pieces.groupBy(*key).agg(
        F.first("doc").alias("doc"), F.first("start").alias("start"), F.first("size").alias("size"),
        F.bit_xor("crc").alias("crc"),
    )
    starts = part_starts(spark, path)
    return counted.join(F.broadcast(starts), "part").select(
        "doc", (F.col("before") + F.col("start")).alias("start"), F.col("size").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc``, ``start`` and ``ids`` of every document; one document's ids are held by one task."""
    fields = [StructField("after", LongType()), StructField("ids", ArrayType(LongType()))]
    pieces = read_pieces(spark, path, lambda ids, after: (after, ids.tolist()), fields)
    chain = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("after"), "ids"))), lambda p: p["ids"]))
    whole = pieces.groupBy("part", "doc_at").agg(F.first("doc").alias("doc"), F.first("start").alias("start"), chain.alias("ids"))
    return whole.join(F.broadcast(part_starts(spark, path)), "part").select(
        "doc", (F.col("before") + F.col("start")).alias("start"), "ids"
    )
