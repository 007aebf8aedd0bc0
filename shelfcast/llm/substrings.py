"""Substring dedup: remove every byte of a string of ``LENGTH`` bytes that also starts anywhere else.

The method is prefix doubling: positions are ranked by a short string, then by longer ones, and a position drops out
as soon as its string is unique. Ranking every position would shuffle a row per byte and round, so two things differ:

* Ranks are names. The name of a string is a hash of its bytes, which a task computes for every position in a few
  passes over an array; equal strings get equal names without a global sort. Spark only finds out which are unique.
* Only anchors are ranked. The anchor of a window of ``LENGTH`` bytes is its first position with the smallest name
  of ``SHORT`` bytes. It depends on the window's bytes alone, so equal windows have their anchors at the same offset.
  Neighbouring windows with a common anchor are a run; there is a run for some eighty bytes.

Rounds, each on what the last one left:

1. ``SHORT`` bytes at the anchor: a run drops out if no other run has its name.
2. All bytes of the run's windows: if another run has the same, all its windows are repeated.
3. Single windows, for runs whose anchor is shared with a different run. Groups of up to ``GROUP`` different runs are
   compared by their bytes within a task; the windows of larger groups are named and counted as rows.

Texts are cut into pieces for the first round, which may split a run; its windows then meet in the third round.

Defined results: null and empty texts have no bytes and nothing removed; rows that repeat id and text are different
places, so they repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from shelfcast.llm.common import identified, map_rows, materialize, packed, unused

LENGTH = 200
SHORT = 40
GROUP = 4096
#: Windows of a text that are handled at once; bounds the memory of a task for very long texts.
PIECE = 1 << 19

_B = 0xD6E8FEB86659FD93
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Namer:
    """Names of all strings of a byte array from one running sum."""

    def __init__(self, short: int, length: int):
        self.short, self.length = short, length
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        n = PIECE + length
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_B))]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(_B, -1, 1 << 64)))]))

    def runs(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per piece: name at the anchor, name of all bytes, first window, windows before the anchor, windows."""
        for start in range(0, len(raw) - self.length + 1, PIECE):
            yield self._piece(np.frombuffer(raw, np.uint8, min(PIECE + self.length - 1, len(raw) - start), start), start)

    def _piece(self, data: np.ndarray, start: int):
        n, k, length = len(data), self.short, self.length
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[:n], out=sums[1:])
        names = mixed((sums[k:] - sums[:-k]) * self.inverse[: n - k + 1])
        anchor = first_smallest(names, length - k + 1)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        windows = np.diff(np.append(first, len(anchor)))
        stop = first + windows - 1 + length
        own = (sums[stop] - sums[first]) * self.inverse[first] + (stop - first).astype(np.uint64) * _M2
        at = anchor[first]
        return names[at].view(np.int64), mixed(own).view(np.int64), first + start, at - first, windows


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value in every window of ``width``, by doubling the width."""
    at = np.arange(len(values))
    span = 1

    def combine(at: np.ndarray, shift: int) -> np.ndarray:
        left, right = at[: len(at) - shift], at[shift:]
        return np.where(values[left] <= values[right], left, right)

    while 2 * span <= width:
        at = combine(at, span)
        span *= 2
    return combine(at, width - span) if width > span else at


RUN = StructType(
    [StructField("name", LongType()), StructField("whole", LongType())]
    + [StructField(n, IntegerType()) for n in ("first", "before", "windows")]
)


def run_rows(docs: DataFrame, text: str, doc_id: str, length: int, short: int, full: bool) -> DataFrame:
    """A row per run; only its name unless ``full``."""
    keyed = identified(docs, text, doc_id).select("_r1", "_r2", "_body")

    def make():
        namer = Namer(short, length)

        def kernel(texts, _):
            parts, offsets = [[np.array([], np.int64)] for _ in range(5)], [0]
            for raw in texts:
                n = 0
                for piece in namer.runs(raw):
                    n += len(piece[0])
                    for store, values in zip(parts, piece):
                        store.append(values)
                offsets.append(offsets[-1] + n)
            flat = [np.concatenate(p) for p in parts]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            cuts = pa.array(offsets, pa.int32())
            if not full:
                return [pa.ListArray.from_arrays(cuts, pa.array(flat[0], pa.int64()))]
            rows = pa.StructArray.from_arrays([pa.array(v.astype(t.to_pandas_dtype())) for v, t in zip(flat, types)], RUN.names)
            return [pa.ListArray.from_arrays(cuts, rows)]

        return kernel

    if not full:
        listed = map_rows(keyed, make, [StructField("names", ArrayType(LongType()))], "_body", [])
        return listed.select(F.explode("names").alias("name"))
    listed = map_rows(keyed, make, [StructField("runs", ArrayType(RUN))], "_body", ["_r1", "_r2"])
    return listed.select("_r1", "_r2", F.inline("runs"))


def with_bytes(runs: DataFrame, docs: DataFrame, text: str, doc_id: str, length: int) -> DataFrame:
    """Adds ``bytes``, all bytes of a run's windows, to rows with ``_r1, _r2, first, windows``."""
    others = [c for c in runs.columns if c not in ("_r1", "_r2")]
    asked = runs.groupBy("_r1", "_r2").agg(F.collect_list(F.struct(*others)).alias("asked"))
    # Rows that repeat id and text have the same bytes; the groups of the third round must see a run once.
    texts = packed(docs, text, doc_id).dropna(subset=["_z"])
    found = texts.join(materialize(asked, "asked-runs"), ["_r1", "_r2"])
    place = others.index("first"), others.index("windows")

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def kernel(packs, part):
            lists = part.column("asked")
            fields = lists.flatten().flatten()
            first, windows = (fields[i].to_numpy() for i in place)
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            out = []
            for z, a, b in zip(packs, cuts, cuts[1:]):
                raw = unpack(z)
                out += [raw[f : f + w - 1 + length] for f, w in zip(first[a:b], windows[a:b])]
            offsets = pa.array(cuts, pa.int32())
            return [pa.ListArray.from_arrays(offsets, pa.array(out, pa.binary()))]

        return kernel

    listed = map_rows(found, make, [StructField("_bytes", ArrayType(BinaryType()))], "_z", ["_r1", "_r2", "asked"])
    zipped = listed.select("_r1", "_r2", F.inline(F.arrays_zip("asked", F.col("_bytes").alias("bytes"))))
    return zipped.select("_r1", "_r2", *[F.col("asked")[c].alias(c) for c in others], "bytes")


def spans_in(flags: list[bool], first: int, length: int) -> list[list[int]]:
    """Byte spans covered by the windows whose flag is set."""
    out: list[list[int]] = []
    for i, flag in enumerate(flags):
        if flag:
            start = first + i
            if out and start <= out[-1][1]:
                out[-1][1] = start + length
            else:
                out.append([start, start + length])
    return out


SPANS = ArrayType(ArrayType(IntegerType()))


def compared_in_groups(rows: DataFrame, length: int) -> DataFrame:
    """``(_r1, _r2, spans)`` of single runs whose windows occur in another run of their group."""
    schema = StructType([StructField("_r1", LongType()), StructField("_r2", IntegerType()), StructField("spans", SPANS)])

    def settled(group: list[dict]) -> Iterator[dict]:
        count: dict[bytes, int] = {}
        for row in group:
            raw, times = row["bytes"], row["copies"]
            for i in range(row["windows"]):
                window = raw[i : i + length]
                count[window] = count.get(window, 0) + times
        for row in group:
            if row["copies"] == 1:
                raw = row["bytes"]
                flags = [count[raw[i : i + length]] > 1 for i in range(row["windows"])]
                if spans := spans_in(flags, row["first"], length):
                    yield {"_r1": row["_r1"], "_r2": row["_r2"], "spans": spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("_r1", pa.int64()), ("_r2", pa.int32()), ("spans", pa.list_(pa.list_(pa.int32())))])
        group: list[dict] = []
        done: list[dict] = []
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                for row in batch.slice(start, GROUP).to_pylist():
                    if group and group[-1]["name"] != row["name"]:
                        done += settled(group)
                        group = []
                    group.append(row)
                yield pa.RecordBatch.from_pylist(done, schema=target)
                done = []
        yield pa.RecordBatch.from_pylist(list(settled(group)), schema=target)

    by_name = rows.repartition("name").sortWithinPartitions("name")
    return by_name.select("name", "_r1", "_r2", "first", "windows", "copies", "bytes").mapInArrow(run, schema)


def compared_as_rows(rows: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: a row per window."""
    pair = StructType([StructField("h1", LongType()), StructField("h2", LongType())])

    def make():
        def kernel(raws, part):
            high, low, offsets = [], [], [0]
            for raw, windows in zip(raws, part.column("windows").to_pylist()):
                for i in range(windows):
                    h = xxhash.xxh3_128_digest(raw[i : i + length])
                    high.append(h[:8]), low.append(h[8:])
                offsets.append(len(high))
            both = [pa.array(np.frombuffer(b"".join(x), np.int64)) for x in (high, low)]
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(both, pair.names))]

        return kernel

    keep = ["_r1", "_r2", "first", "copies"]
    listed = map_rows(rows, make, [StructField("pairs", ArrayType(pair))], "bytes", keep)
    windows = listed.select(*keep, F.posexplode("pairs").alias("i", "pair")).select(*keep, "i", "pair.*")
    windows = materialize(windows, "windows")
    repeated = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2")
    hit = windows.where("copies = 1").join(materialize(repeated, "repeated-windows"), ["h1", "h2"])
    start = (F.col("first") + F.col("i")).cast("int")
    span = F.array(start, start + length)
    return hit.select("_r1", "_r2", F.array(span).alias("spans"))


def repeated_spans(docs: DataFrame, text: str, doc_id: str, length: int, short: int) -> DataFrame:
    """``(_r1, _r2, spans)``: byte spans of repeated strings, which may overlap, for documents that have some."""
    names = run_rows(docs, text, doc_id, length, short, full=False).groupBy("name").agg(F.count("*").alias("n"))
    names = materialize(names.where("n > 1").select("name"), "shared-names")
    runs = materialize(run_rows(docs, text, doc_id, length, short, full=True).join(names, "name"), "runs")

    key = ["name", "whole", "before", "windows"]
    place = F.min(F.struct("_r1", "_r2", "first")).alias("place")
    wholes = materialize(runs.groupBy(*key).agg(F.count("*").alias("copies"), place), "wholes")
    same = runs.join(wholes.where("copies > 1").select(*key), key)
    start = F.col("first")
    settled = same.select("_r1", "_r2", F.array(F.array(start, (start + F.col("windows") - 1 + length).cast("int"))).alias("spans"))

    groups = wholes.groupBy("name").agg(F.count("*").alias("different")).where("different > 1")
    mixed_groups = wholes.join(materialize(groups, "groups"), "name")
    asked = mixed_groups.select("place.*", "name", "windows", F.least("copies", F.lit(2)).cast("int").alias("copies"), "different")
    rows = materialize(with_bytes(materialize(asked, "asked"), docs, text, doc_id, length), "run-bytes")
    small = compared_in_groups(rows.where(F.col("different") <= GROUP), length)
    large = compared_as_rows(rows.where(F.col("different") > GROUP), length)
    spans = settled.unionByName(small).unionByName(large)
    return spans.groupBy("_r1", "_r2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of covered bytes; touching spans are one run."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(first[1:], True)
    return np.column_stack([spans[first, 0], reach[last]])


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, short: int = SHORT
) -> tuple[DataFrame, dict[str, str]]:
    """The documents with ``n_bytes``, ``removed`` (maximal byte spans) and ``kept`` (the other bytes, joined).

    Also returns the names of the new columns, for documents that use these names.
    """
    names = {n: unused(n, docs.columns) for n in ("n_bytes", "removed", "kept")}
    spans = materialize(repeated_spans(docs, text, doc_id, length, short), "spans")
    joined = packed(docs, text, doc_id, ["_held"]).join(spans, ["_r1", "_r2"], "left")

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def kernel(packs, part):
            texts, sizes, removed, kept = [], [], [], []
            for z, own in zip(packs, part.column("spans").to_pylist()):
                raw = unpack(z) if z else b""
                texts.append(raw if z else None)
                cut = merged(np.array(own, np.int64)) if own else np.empty((0, 2), np.int64)
                edges = [0, *cut.ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(raw)), removed.append(cut.tolist())
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            removed = pa.array(removed, pa.list_(pa.list_(pa.int32())))
            return [texts, pa.array(sizes, pa.int64()), removed, pa.array(kept, pa.binary())]

        return kernel

    fields = [
        StructField("_text", StringType()),
        StructField(names["n_bytes"], LongType()),
        StructField(names["removed"], SPANS),
        StructField(names["kept"], BinaryType()),
    ]
    out = map_rows(joined, make, fields, "_z", ["_held"])
    own = [F.col("_text" if c == text else f"_held.`{c}`").alias(c) for c in docs.columns]
    return out.select(*own, *names.values()), names
