"""Benchmark decontamination: Wu-Manber multi-pattern search over the words of every document.

The patterns are the 13-word windows of the benchmark items; an item of fewer words is one window. A table of
shifts, indexed by the last two words under the search position, says how far the search may jump without missing an
occurrence; where it says zero, the bucket of that word pair holds the windows to compare directly.

Windows are searched in blocks of a bounded number, one pass over the documents per block, so neither the driver nor
a task ever holds more than one block however large the benchmark is.

Defined results: null or empty texts have no words and no hits; repeated items or item ids count once per id; an item
with a null id is known as the text ``null``; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from shelfcast.llm.common import map_text, materialize, unused

WINDOW = 13
#: Windows that one pass searches for; at some 400 bytes each, a block takes 80 MB in a task at most.
BLOCK_WINDOWS = 200_000

#: Bytes to words: A-Z become lower case, everything but 0-9, a-z and bytes of non-ASCII characters becomes a blank.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

Pattern = tuple[bytes, ...]


def benchmark_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class WuManber:
    """Occurrences of word patterns. Patterns are grouped by length; a length has its own shift table."""

    def __init__(self, patterns: Iterable[tuple[Pattern, list[str]]]):
        by_length: dict[int, list[tuple[Pattern, list[str]]]] = defaultdict(list)
        for pattern, items in patterns:
            by_length[len(pattern)].append((pattern, items))
        self.tables = [(m, *self._table(m, own)) for m, own in sorted(by_length.items())]

    @staticmethod
    def _table(m: int, patterns):
        block = min(2, m)
        shift: dict[Pattern, int] = {}
        buckets: dict[Pattern, dict[Pattern, list[str]]] = defaultdict(dict)
        for pattern, items in patterns:
            for end in range(block, m + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, m), m - end)
            buckets[pattern[m - block :]].setdefault(pattern, []).extend(items)
        return block, shift, dict(buckets)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans that are inside an occurrence, and the items with an occurring window."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        n = len(words)
        for m, block, shift, buckets in self.tables:
            jump = m - block + 1
            get = shift.get
            end = m
            while end <= n:
                key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
                step = get(key, jump)
                if step:
                    end += step
                    continue
                found = buckets[key].get(tuple(words[end - m : end]))
                if found is not None:
                    spans.append((end - m, end))
                    items.update(found)
                end += 1
        return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct ``(pattern, item)`` rows: a pattern is an array of words in UTF-8."""

    def make():
        def kernel(texts):
            out = []
            for raw in texts:
                words = benchmark_words(raw)
                m = min(width, len(words))
                out.append(sorted({b" ".join(words[i : i + m]) for i in range(len(words) - m + 1)}) if words else [])
            return [pa.array(out, pa.list_(pa.binary())).cast(pa.list_(pa.string()))]

        return kernel

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("body"))
    listed = map_text(named, make, [StructField("windows", ArrayType(StringType()))], text="body", keep=["item"])
    return listed.select(F.explode("windows").alias("pattern"), "item").distinct()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> tuple[DataFrame, dict[str, str]]:
    """The documents' rows with word count, hit spans and matched items; and the names of these new columns.

    ``n_words`` counts the document's words, ``spans`` holds ``[start, stop]`` word positions, ``items`` the matched
    item ids, sorted as strings. Names that the documents already use get a leading underscore.
    """
    spark = docs.sparkSession
    patterns = materialize(windows(benchmark, item, item_text, width), "windows")
    n_blocks = max(1, -(-patterns.count() // block_windows))
    names = {n: unused(n, docs.columns) for n in ("n_words", "spans", "items")}
    fields = [
        StructField(names["n_words"], LongType()),
        StructField(names["spans"], ArrayType(ArrayType(IntegerType()))),
        StructField(names["items"], ArrayType(StringType())),
    ]
    out = docs
    for k in range(n_blocks):
        # At most one block of windows is on the driver; its size is bounded by block_windows.
        own = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)) == k)
        rows = own.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
        block = spark.sparkContext.broadcast([(r["pattern"], list(r["items"])) for r in rows])

        def make(block=block):
            search = WuManber((tuple(p.encode().split()), items) for p, items in block.value).search

            def kernel(texts):
                counts, spans, items = [], [], []
                for raw in texts:
                    words = benchmark_words(raw)
                    found, matched = search(words)
                    counts.append(len(words))
                    spans.append([list(s) for s in found])
                    items.append(sorted(matched, key=lambda i: i.encode()))
                return [
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    pa.array(items, pa.list_(pa.string())),
                ]

            return kernel

        if k == 0:
            out = map_text(docs, make, fields, text=text, keep=docs.columns)
            continue
        again = [StructField(f"{f.name}__{k}", f.dataType) for f in fields]
        out = map_text(materialize(out, "decontaminate"), make, again, text=text, keep=[*docs.columns, *names.values()])
        out = out.select(
            *docs.columns,
            names["n_words"],
            F.concat(names["spans"], again[1].name).alias(names["spans"]),
            F.array_sort(F.array_union(names["items"], again[2].name)).alias(names["items"]),
        )
    return out, names


def hit_words(spans: str):
    """Words covered by the spans, which may overlap where they come from several blocks."""
    ordered = F.array_sort(F.col(spans))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc, s):
        start = F.greatest(s[0], acc["end"])
        return F.struct(
            (acc["n"] + F.greatest(s[1] - start, F.lit(0))).alias("n"), F.greatest(acc["end"], s[1]).alias("end")
        )

    return F.aggregate(ordered, zero, add, lambda acc: acc["n"].cast("long"))


def judged(docs: DataFrame, benchmark: DataFrame, min_share: int = 20, **options) -> tuple[DataFrame, dict[str, str]]:
    """Adds ``n_hit`` and ``contaminated``: some word is hit and the hits are at least one in ``min_share`` words."""
    out, names = find_contamination(docs, benchmark, **options)
    for n in ("n_hit", "contaminated"):
        names[n] = unused(n, out.columns)
    out = out.withColumn(names["n_hit"], hit_words(names["spans"]))
    hit = F.col(names["n_hit"])
    return out.withColumn(names["contaminated"], (hit > 0) & (min_share * hit >= F.col(names["n_words"]))), names


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    out, names = judged(docs, benchmark, **options)
    return out.where(~F.col(names["contaminated"])).select(*docs.columns)
