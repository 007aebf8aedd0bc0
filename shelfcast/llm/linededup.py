"""Line dedup: lines that equal an earlier line but for one edited word or for where their blanks are.

A line is its lower-cased words; the distance is the number of words inserted, deleted or replaced. A line is dropped
if an earlier one, in the order of document id and line number, equals it, is within distance one, or is the same
without blanks, however many words are joined or split; whether that one is itself dropped plays no part, so the
result does not depend on any order of work. Lines of fewer than ``MIN_WORDS`` words are only compared for equality,
from ``min_exact`` words on (by default ``MIN_WORDS``; the registered query and the pipeline pass 1).

* Equal lines are one distinct line with its earliest place.
* Lines that differ in blanks have the same hash without them (128 bits, as equal lines).
* The deletion neighbourhood of a line is the line without its i-th word, for every i, and the line itself. Two lines
  are within one replacement if they have the same variant at the same i; within one insertion if one is a variant of
  the other. So the earliest member of each hashed key decides and no pairs are made.
* Variants are made only for lines that share their first or last p words with another line (p is a power of two, up
  to half of the words): one edit leaves one of the two as it is, so this loses nothing. The hash without blanks is
  shared in the same way.
* Every decision by a variant is verified by the edit distance between the line and its earliest partner.

Texts travel compressed where they must be joined. The large joins are merge joins at every size, so that a trial on
few rows, where one side could be broadcast, moves what a run on many rows moves.

Defined results: null and empty texts stay as they are; of rows that repeat id and text, each is treated as one of
them; documents with a null id come last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from shelfcast.llm.common import identified, map_rows, map_text, materialize, packed, unused
from shelfcast.session import settle

MIN_WORDS = 8

_B = np.uint64(0xD6E8FEB86659FD93)
_B_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LINE = StructType(
    [StructField("line_no", IntegerType())]
    + [StructField(n, LongType()) for n in ("line", "check")]
    + [StructField("anchors", ArrayType(LongType()))]
)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def anchor_lengths(n: int) -> list[int]:
    """Powers of two up to n / 2: the largest, and the one that a line with a word less has, if it is another."""
    p = 1 << ((n // 2).bit_length() - 1)
    q = 1 << (((n - 1) // 2).bit_length() - 1)
    return sorted({p, q})


def anchors(words: list[bytes]) -> list[int]:
    out = []
    for p in anchor_lengths(len(words)):
        out.append(signed(xxhash.xxh64_intdigest(b" ".join(words[:p]), seed=2 * p)))
        out.append(signed(xxhash.xxh64_intdigest(b" ".join(words[-p:]), seed=2 * p + 1)))
    return [*out, unspaced(words)[0]]


def unspaced(words: list[bytes]) -> tuple[int, int]:
    """128 bits of a line without its blanks."""
    whole = b"".join(words)
    return signed(xxhash.xxh64_intdigest(whole, seed=1)), signed(xxhash.xxh64_intdigest(whole, seed=0))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def neighbourhood(ids: np.ndarray) -> np.ndarray:
    """Hash of the line, then of the line without its i-th word for every i; in linear time."""
    n = len(ids)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(ids * powers[:n])])
    without = sums[:n] + (sums[n] - sums[1:]) * _B_INVERSE
    lengths = np.full(n + 1, n - 1, np.uint64)
    lengths[0] = n
    return mixed(np.concatenate([sums[n:], without]) + lengths * _M1).view(np.int64)


def within_one(a: list[int], b: list[int]) -> bool:
    """Whether the edit distance between two word sequences is one at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def line_table(docs: DataFrame, text: str, doc_id: str, min_words: int, min_exact: int) -> DataFrame:
    """``(doc, r1, r2, line_no, line, check, anchors)`` for every line that takes part; short lines have no anchors."""
    least = max(1, min(min_words, min_exact))
    keyed = identified(docs, text, doc_id).select(F.col("_id").alias("doc"), "_r1", "_r2", "_body")

    def make():
        def kernel(texts):
            offsets, numbers, lines, checks, starts, keys = [0], [], [], [], [0], []
            for raw in texts:
                for number, line in enumerate(raw.split(b"\n")):
                    words = line.lower().split()
                    if len(words) >= least:
                        whole = b" ".join(words)
                        numbers.append(number)
                        lines.append(signed(xxhash.xxh64_intdigest(whole)))
                        checks.append(signed(xxhash.xxh64_intdigest(whole, seed=1)))
                        if len(words) >= min_words:
                            keys.extend(anchors(words))
                        starts.append(len(keys))
                offsets.append(len(numbers))
            anchor_lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys, pa.int64()))
            parts = [pa.array(numbers, pa.int32()), pa.array(lines, pa.int64()), pa.array(checks, pa.int64()), anchor_lists]
            rows = pa.StructArray.from_arrays(parts, names=LINE.names)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)]

        return kernel

    listed = map_text(keyed, make, [StructField("lines", ArrayType(LINE))], text="_body", keep=["doc", "_r1", "_r2"])
    return listed.select("doc", F.col("_r1").alias("r1"), F.col("_r2").alias("r2"), F.inline("lines"))


def place() -> Column:
    """The order of lines; ids that are null come last."""
    return F.struct(F.col("doc").isNull().alias("last"), "doc", "r1", "r2", "line_no")


def near_lines(distinct: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``(line, check)`` of the distinct lines that have an earlier line within one edit, or the same without blanks."""
    keys = distinct.select("line", "check", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shared = materialize(keys.groupBy("anchor").agg(F.count("*").alias("f")).where("f > 1").select("anchor"), "anchors")
    wanted = keys.join(shared.hint("merge"), "anchor").select("line", "check").distinct()
    # Ranges are sorted and numbered in their order, so a smaller number is an earlier line.
    numbered = distinct.join(wanted, ["line", "check"]).select("line", "check", "first").orderBy("first")
    numbered = materialize(numbered.withColumn("no", F.monotonically_increasing_id()), "numbered")

    asked = numbered.groupBy(F.col("first.r1").alias("_r1"), F.col("first.r2").alias("_r2")).agg(
        F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "no")).alias("asked")
    )
    found = packed(docs, text, doc_id).dropna(subset=["_z"]).join(materialize(asked, "asked").hint("merge"), ["_r1", "_r2"])
    row = StructType(
        [StructField(n, LongType()) for n in ("no", "letters", "letters_check")] + [StructField("ids", ArrayType(LongType()))]
    )

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def kernel(packed, part):
            out = []
            for z, asked in zip(packed, part.column("asked").to_pylist()):
                lines = unpack(z).split(b"\n")
                own = []
                for a in asked:
                    words = lines[a["line_no"]].lower().split()
                    letters, check = unspaced(words)
                    ids = [signed(xxhash.xxh64_intdigest(w)) for w in words]
                    own.append({"no": a["no"], "letters": letters, "letters_check": check, "ids": ids})
                out.append(own)
            fields = [(n, pa.int64()) for n in ("no", "letters", "letters_check")] + [("ids", pa.list_(pa.int64()))]
            return [pa.array(out, pa.list_(pa.struct(fields)))]

        return kernel

    texts = map_rows(found, make, [StructField("rows", ArrayType(row))], "_z", ["_r1"]).select(F.inline("rows"))
    # Rows that repeat id and text give a line twice.
    texts = materialize(texts.dropDuplicates(["no"]), "line-words")

    def variants():
        def kernel(_, part):
            lists = part.column("ids")
            flat = lists.flatten().to_numpy().astype(np.int64, copy=False).view(np.uint64)
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            keys = [neighbourhood(flat[a:b]) for a, b in zip(cuts, cuts[1:])]
            return [pa.array(keys, pa.list_(pa.int64()))]

        return kernel

    listed = map_rows(
        texts.withColumn("_size", F.col("ids").cast("string")), variants,
        [StructField("keys", ArrayType(LongType()))], "_size", ["no"],
    )
    # Position 0 is the line itself, position i the line without its i-th word.
    rows = materialize(listed.select("no", F.posexplode("keys").alias("position", "key")), "variants")
    by_key = rows.groupBy("key").agg(
        F.count("*").alias("f"),
        F.min(F.when(F.col("position") == 0, F.col("no"))).alias("whole"),
        F.min(F.when(F.col("position") > 0, F.col("no"))).alias("variant"),
    )
    by_key = materialize(by_key.where("f > 1").drop("f"), "keys")
    at_place = rows.where("position > 0").groupBy("key", "position").agg(F.count("*").alias("f"), F.min("no").alias("same"))
    at_place = materialize(at_place.where("f > 1").drop("f"), "places")
    inserted = rows.join(by_key, "key").select(
        "no", F.when(F.col("position") == 0, F.col("variant")).otherwise(F.col("whole")).alias("partner")
    )
    replaced = rows.join(at_place, ["key", "position"]).select("no", F.col("same").alias("partner"))
    earlier = inserted.unionByName(replaced).where("partner < no").groupBy("no").agg(F.min("partner").alias("partner"))
    mine = texts.select("no", F.col("ids").alias("a"))
    theirs = texts.select(F.col("no").alias("partner"), F.col("ids").alias("b"))
    both = materialize(earlier, "partners").join(mine, "no").join(theirs, "partner")

    def verify():
        def kernel(_, part):
            pairs = zip(part.column("a").to_pylist(), part.column("b").to_pylist())
            return [pa.array([within_one(a, b) for a, b in pairs], pa.bool_())]

        return kernel

    checked = map_rows(
        both.withColumn("_size", F.col("a").cast("string")), verify, [StructField("ok", BooleanType())], "_size", ["no"]
    )
    own = texts.select("no", "letters", "letters_check")
    firsts = own.groupBy("letters", "letters_check").agg(F.count("*").alias("f"), F.min("no").alias("partner"))
    moved = own.join(materialize(firsts.where("f > 1").drop("f"), "letters"), ["letters", "letters_check"])
    near = checked.where("ok").select("no").unionByName(moved.where("partner < no").select("no")).distinct()
    return near.join(numbered, "no").select("line", "check")


def dropped_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, min_exact: int = MIN_WORDS
) -> DataFrame:
    """``(_r1, _r2, dropped)``: sorted numbers of the lines to drop, for documents that have some."""
    lines = materialize(line_table(docs, text, doc_id, min_words, min_exact), "lines")
    distinct = lines.groupBy("line", "check").agg(
        F.min(place()).alias("first"), F.count("*").alias("f"), F.first("anchors").alias("anchors")
    )
    distinct = materialize(distinct, "distinct-lines")
    near = near_lines(distinct, docs, text, doc_id).withColumn("near", F.lit(True))
    marked = distinct.select("line", "check", "first", "f").join(materialize(near, "near-lines"), ["line", "check"], "left")
    marked = materialize(marked.where("near OR f > 1").drop("f"), "marked-lines")
    drops = lines.join(marked.hint("merge"), ["line", "check"]).where(F.col("near").isNotNull() | (place() != F.col("first")))
    return drops.groupBy(F.col("r1").alias("_r1"), F.col("r2").alias("_r2")).agg(
        F.sort_array(F.collect_set("line_no")).alias("dropped")
    )


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, min_exact: int = MIN_WORDS
) -> tuple[DataFrame, dict[str, str]]:
    """The documents with ``text`` without the dropped lines, plus ``n_lines``, ``n_dropped`` and ``emptied``.

    ``emptied`` marks a document that had a word before and has none left. Also returns the names of the new columns.
    """
    names = {n: unused(n, docs.columns) for n in ("n_lines", "n_dropped", "emptied")}
    drops = settle(docs.sparkSession, "drops", lambda: dropped_lines(docs, text, doc_id, min_words, min_exact))
    joined = packed(docs, text, doc_id, ["_held"]).join(drops.hint("merge"), ["_r1", "_r2"], "left")
    # A null text has no bytes to slice by.
    joined = joined.withColumn("_null", F.col("_z").isNull())

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def kernel(packed, part):
            texts, counts, gone, emptied = [], [], [], []
            for z, drop, null in zip(packed, part.column("dropped").to_pylist(), part.column("_null").to_pylist()):
                if null:
                    texts.append(None), counts.append(0), gone.append(0), emptied.append(False)
                    continue
                lines = unpack(z).decode().split("\n")
                out = set(drop or ())
                kept = "\n".join(line for i, line in enumerate(lines) if i not in out) if out else "\n".join(lines)
                texts.append(kept), counts.append(len(lines)), gone.append(len(out))
                emptied.append(bool(out) and not kept.encode().split())
            return [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(emptied)]

        return kernel

    fields = [
        StructField("_new", StringType()),
        StructField(names["n_lines"], LongType()),
        StructField(names["n_dropped"], LongType()),
        StructField(names["emptied"], BooleanType()),
    ]
    out = map_rows(joined, make, fields, "_z", ["_held"])
    own = [F.col("_new" if c == text else f"_held.`{c}`").alias(c) for c in docs.columns]
    return out.select(*own, *names.values()), names
