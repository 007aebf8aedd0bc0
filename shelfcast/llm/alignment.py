"""Alignment of two tokenizers: which tokens overlap, and where both cut the text.

Method. The tokens of both sides get their byte ranges in the batch. Two ``pandas.merge_asof`` calls per batch, keyed by
document, find for each token start the token of the other side that covers it; the union of both directions holds
every overlapping pair once. Overlapping tokens that end together are linked, and the shared ends cut a text into
groups. Counts of linked id pairs are sums over all documents.

Tokenizing. Neither tokenizer merges across a single blank between two characters that are not blanks: one cuts before
such a blank, the other has no piece with its blank mark behind another character (checked where it is loaded). So a
text is the chain of its words' tokens, and a task keeps the tokens of the words that it has seen, up to ``KEPT_TOKENS``.

Bounds. A task holds the tokens of one slice of texts, at least one whole text. Linked tokens end together, so the
bytes of one are a suffix of the other's: the number of id pairs that can be linked follows from the two vocabularies
(``linkable``; some hundred thousand), whatever the corpus. That bounds the table of pair counts, which goes to the
driver and from there to all tasks.

Odd input: null and empty texts, texts that are not UTF-8, and texts whose joined token bytes are not a blank and the
text (a side normalizes, or has a blank mark in the text) have no tokens. Rows are never compared with each other, so
repeated rows and ids each give a row; columns that are passed on keep their names, and new ones get a longer name where
one is taken.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from shelfcast.llm.common import map_rows, map_text, unused

#: A blank between two characters that are not blanks (the one behind is no white space at all).
BETWEEN_WORDS = re.compile(r"(?<=[^ ]) (?=\S)")
ODD_BLANK = re.compile(r" \s")

#: Tokens of known words that a task keeps; beyond that it starts anew.
KEPT_TOKENS = 4_000_000

#: New words that are encoded as one text.
WORDS_AT_ONCE = 1_000

#: Fixed values of the public formats: the mark of a blank, and pieces that stand for one byte.
BLANK_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def words_of(text: str) -> list[str]:
    """The text cut at ``BETWEEN_WORDS``; most texts have no other blanks."""
    plain = text[0] != " " and text[-1] != " " and not ODD_BLANK.search(text)
    return text.split(" ") if plain else BETWEEN_WORDS.split(text)


def byte_symbols() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library; special tokens in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        symbols = byte_symbols()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            known = all(c in symbols for c in token)
            self.tokens[at] = bytes(symbols[c] for c in token) if known else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a blank before it."""
        found = self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in found]


class Pieces:
    """A sentencepiece model, which puts a blank before each text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(BLANK_MARK in p.lstrip(BLANK_MARK) for p in pieces):
            raise ValueError("a piece spans words, so texts can't be encoded word by word")
        self.tokens = [self.bytes_of(p) for p in pieces]

    @staticmethod
    def bytes_of(piece: str) -> bytes:
        byte = BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(BLANK_MARK, " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """Tokens of one tokenizer for the words that a task has seen."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.sizes = np.fromiter(map(len, tokenizer.tokens), np.int64, len(tokenizer.tokens))
        self.clear()

    def clear(self) -> None:
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.faithful = np.zeros(0, bool)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def learn(self, words: list[str]) -> None:
        """Tokens of new words, encoded many at a time: their chain is cut where the bytes of a word end."""
        parts = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        for part, found in zip(parts, self.tokenizer.encode([" ".join(p) for p in parts])):
            raw = [b" " + w.encode() for w in part]
            ids = np.array(found, np.int32)
            if b"".join(map(self.tokenizer.tokens.__getitem__, found)) == b"".join(raw):
                ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
                cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
                self.keep(ids, np.diff(cuts, prepend=0), np.ones(len(part), bool))
            else:
                own = self.tokenizer.encode(part)
                counts = np.fromiter(map(len, own), np.int64, len(own))
                same = [b"".join(map(self.tokenizer.tokens.__getitem__, o)) == r for o, r in zip(own, raw)]
                self.keep(np.array([i for o in own for i in o], np.int32), counts, np.array(same, bool))

    def keep(self, ids: np.ndarray, counts: np.ndarray, faithful: np.ndarray) -> None:
        self.new.append((ids, counts, faithful))

    def settle(self) -> None:
        """Put what was learned behind what was known."""
        ids, counts, faithful = zip((self.ids, self.counts, self.faithful), *self.new)
        self.ids, self.counts, self.faithful = np.concatenate(ids), np.concatenate(counts), np.concatenate(faithful)
        self.starts = np.cumsum(self.counts) - self.counts
        self.new = []

    def tokens_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words in a row, and the number of tokens of each word."""
        counts = self.counts[places]
        shift = np.repeat(self.starts[places] - (np.cumsum(counts) - counts), counts)
        return self.ids[np.arange(len(shift)) + shift], counts


@dataclass
class Tokens:
    """Tokens of a slice of texts: ids, document of each, and byte ranges, counted through all texts of the slice."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def frame(self, place: str | None = None) -> pd.DataFrame:
        columns = {"at": self.start, "doc": self.doc}
        return pd.DataFrame(columns | ({place: np.arange(len(self.ids))} if place else {}))


@dataclass
class Aligned:
    """Tokens of both sides and their overlaps, in the order of the text; ``linked`` marks those that end together."""

    n_docs: int
    a: Tokens
    b: Tokens
    over_a: np.ndarray
    over_b: np.ndarray
    linked: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the group of each token, counted through the slice."""
        out = []
        for tokens, over in ((self.a, self.over_a), (self.b, self.over_b)):
            closing = np.zeros(len(tokens.ids), np.int64)
            closing[over[self.linked]] = 1
            out.append(np.cumsum(closing) - closing)
        return out[0], out[1]

    def per_doc(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.n_docs)


def covering(left: Tokens, right: Tokens) -> np.ndarray:
    """For each start of a left token, the right token of the same document that covers it."""
    found = pd.merge_asof(left.frame(), right.frame("other"), on="at", by="doc", direction="backward")
    return found["other"].to_numpy(np.int64)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that share a byte: the later of both starts lies in the other token."""
    in_b, in_a = covering(a, b), covering(b, a)
    later = a.start[in_a] < b.start  # pairs with equal starts are found in both directions
    first = np.concatenate([np.arange(len(a.ids)), in_a[later]])
    second = np.concatenate([in_b, np.flatnonzero(later)])
    order = np.argsort(np.maximum(a.start[first], b.start[second]), kind="stable")
    return first[order], second[order]


class Aligner:
    """Tokenizes and aligns slices of texts; one per task."""

    def __init__(self, first, second):
        self.sides = (Side(first), Side(second))
        self.known: dict[str, int] = {}

    def places(self, words: list[str]) -> np.ndarray:
        """Places of the words in the memory of both sides; new ones are encoded."""
        if max(len(s.ids) for s in self.sides) > KEPT_TOKENS:
            self.known = {}
            for side in self.sides:
                side.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            for side in self.sides:
                side.learn(new)
                side.settle()
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def same_bytes(self, places: np.ndarray, raw: bytes) -> bool:
        for side in self.sides:
            tokens = side.tokenizer.tokens
            if not side.faithful[places].all() and b"".join(tokens[i] for i in side.tokens_of(places)[0]) != b" " + raw:
                return False
        return True

    def align(self, texts: list[bytes]) -> Aligned:
        split = []
        for raw in texts:
            try:
                split.append(words_of(raw.decode()) if raw else [])
            except UnicodeDecodeError:
                split.append([])
        places = self.places([w for words in split for w in words])
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(n_words)
        whole = np.array([self.same_bytes(places[e - n : e], raw) for raw, n, e in zip(texts, n_words, ends)], bool)
        doc = np.repeat(np.arange(len(texts)), n_words)
        places, doc = places[whole[doc]], doc[whole[doc]]
        sides = []
        for side in self.sides:
            ids, counts = side.tokens_of(places)
            end = np.cumsum(side.sizes[ids])
            sides.append(Tokens(ids, np.repeat(doc, counts), end - side.sizes[ids], end))
        a, b = sides
        over_a, over_b = overlaps(a, b)
        return Aligned(len(texts), a, b, over_a, over_b, a.end[over_a] == b.end[over_b])


#: A kernel that turns an alignment into Arrow arrays, one row per text.
View = Callable[[Aligned], Sequence[pa.Array]]


def cut(values: np.ndarray, doc: np.ndarray, n_docs: int, kind: pa.DataType) -> pa.Array:
    """A list per document of values that are sorted by document."""
    offsets = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def whole_view(found: Aligned) -> list[pa.Array]:
    """Ids, groups, and overlapping pairs as places in the two id lists."""
    a_group, b_group = found.groups()
    doc = found.a.doc[found.over_a]
    firsts = [np.searchsorted(d, np.arange(found.n_docs)) for d in (found.a.doc, found.b.doc)]
    link_doc = doc[found.linked]
    first_group = np.searchsorted(link_doc, np.arange(found.n_docs))
    int32 = pa.int32()
    return [
        cut(found.a.ids, found.a.doc, found.n_docs, int32),
        cut(found.b.ids, found.b.doc, found.n_docs, int32),
        cut(a_group - first_group[found.a.doc], found.a.doc, found.n_docs, int32),
        cut(b_group - first_group[found.b.doc], found.b.doc, found.n_docs, int32),
        cut(found.over_a - firsts[0][doc], doc, found.n_docs, int32),
        cut(found.over_b - firsts[1][doc], doc, found.n_docs, int32),
    ]


#: Columns of ``whole_view``.
WHOLE = ("a_ids", "b_ids", "a_group", "b_group", "over_a", "over_b")


def align(
    docs: DataFrame, first: Callable, second: Callable, view: Callable[[Aligner], View], fields: Sequence[StructField],
    text: str = "text", keep: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` and what ``view`` makes of each text's alignment, with the names that the new columns got.

    ``first`` and ``second`` load the tokenizers inside a task, for example ``lambda: ByteLevel(path)``.
    """
    names: dict[str, str] = {}
    for f in fields:
        names[f.name] = unused(f.name, [*keep, *names.values()])
    renamed = [StructField(names[f.name], f.dataType) for f in fields]

    def make():
        aligner = Aligner(first(), second())
        shown = view(aligner)
        return lambda texts: shown(aligner.align(texts))

    return map_text(docs, make, renamed, text, keep), names


def align_whole(docs: DataFrame, first: Callable, second: Callable, text: str = "text", keep: Sequence[str] = ()):
    """Ids of both sides, the group of each token, and overlapping pairs (places in the id lists)."""
    fields = [StructField(c, ArrayType(IntegerType())) for c in WHOLE]
    return align(docs, first, second, lambda _: whole_view, fields, text, keep)


def digits(n_ids: int) -> np.ndarray:
    """Decimal digits of all ids, right-aligned in rows of bytes, zero before them; the last place is free."""
    width = len(str(n_ids)) + 1
    rows = np.zeros((n_ids, width), np.uint8)
    for i in range(n_ids):
        shown = str(i).encode()
        rows[i, width - 1 - len(shown) : width - 1] = list(shown)
    return rows


def group_texts(found: Aligned, rows: np.ndarray) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2``, empty without tokens; ``rows`` are the digits of all ids."""
    a_group, b_group = found.groups()
    n = int(found.linked.sum())
    a_count, b_count = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    before_a = np.cumsum(b_count) - b_count
    before_b = np.cumsum(a_count)
    ids = np.empty(len(found.a.ids) + len(found.b.ids), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    doc = np.empty(len(ids), np.int64)
    for tokens, group, before, last in ((found.a, a_group, before_a, "|"), (found.b, b_group, before_b, ";")):
        at = np.arange(len(tokens.ids)) + before[group]
        ids[at], doc[at] = tokens.ids, tokens.doc
        ends = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        mark[at[ends]] = ord(last)
    shown = rows[ids]
    shown[:, -1] = mark
    flat = shown[shown != 0].tobytes()
    sizes = np.cumsum(np.append(0, np.count_nonzero(rows, axis=1)[ids] + 1))
    cuts = sizes[np.searchsorted(doc, np.arange(found.n_docs + 1))]
    return [flat[i : max(i, j - 1)] for i, j in zip(cuts.tolist(), cuts[1:].tolist())]


def link_lists(found: Aligned, n_first: int, n_second: int) -> list[bytes]:
    """Each text's linked pairs as compressed codes (first id times ``n_second`` plus second id) with their counts."""
    a, b = found.over_a[found.linked], found.over_b[found.linked]
    span = n_first * n_second
    keys = np.sort((found.a.doc[a] * n_first + found.a.ids[a]) * n_second + found.b.ids[b])
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(np.append(at, len(keys)))
    codes, doc = keys[at] % span, keys[at] // span
    cuts = np.searchsorted(doc, np.arange(found.n_docs + 1)).tolist()
    pack = zstandard.ZstdCompressor(level=1).compress
    steps = np.diff(codes, prepend=0)
    first = np.array([c for c in cuts[:-1] if c < len(codes)], np.int64)
    steps[first] = codes[first]
    steps, many = steps.astype("<i8"), counts.astype("<u4")
    return [pack(steps[i:j].tobytes() + many[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]


def unpack_links(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, counts and the row of each, from what ``link_lists`` made."""
    open_ = zstandard.ZstdDecompressor().decompress
    raw = [open_(p) for p in packed]
    n = np.fromiter(map(len, raw), np.int64, len(raw)) // 12
    codes = [np.cumsum(np.frombuffer(r, "<i8", k)) for r, k in zip(raw, n.tolist())]
    counts = [np.frombuffer(r, "<u4", k, 8 * k) for r, k in zip(raw, n.tolist())]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *codes]), np.concatenate([none, *counts]), np.repeat(np.arange(len(raw)), n)


def linkable(first: list[bytes], second: list[bytes]) -> int:
    """Id pairs that can be linked at all: the bytes of one token are a suffix of the other's."""
    ends, total = [Counter(first), Counter(second)], 0
    for own, other, proper in ((first, ends[1], 0), (second, ends[0], 1)):
        for token in own:
            total += sum(other[token[i:]] for i in range(proper, len(token)))
    return total


def pair_counts(linked: DataFrame, column: str) -> DataFrame:
    """``code`` and ``count`` of every linked id pair over all rows; tasks sum their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = pd.Series(dtype=np.int64)
        for batch in batches:
            codes, counts, _ = unpack_links(batch.column(0).to_pylist())
            own = pd.Series(counts.astype(np.int64)).groupby(codes).sum()
            total = total.add(own, fill_value=0) if len(total) else own
        codes = total.index.to_numpy(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total.to_numpy(np.int64))], names=["code", "count"])

    partial = linked.select(column).mapInArrow(run, "code long, count long")
    return partial.groupBy("code").agg(F.sum("count").alias("count"))


def rate_links(
    linked: DataFrame, column: str, counts: DataFrame, n_second: int, most: int
) -> tuple[DataFrame, dict[str, str]]:
    """Per row ``n_best``, links whose pair is the most frequent of its second id, and ``count_sum`` over its links.

    ``most`` is the proven bound of the rows of ``counts`` (see ``linkable``).
    """
    of_second = Window.partitionBy(F.pmod("code", F.lit(n_second)))
    best = F.col("count") == F.max("count").over(of_second)
    rows = counts.select("code", "count", best.alias("best")).limit(most + 1).toArrow().combine_chunks().sort_by("code")
    if rows.num_rows > most:
        raise ValueError(f"more than {most} linked pairs: the counts are not of these vocabularies")
    code, count, top = (rows.column(c).to_numpy() for c in ("code", "count", "best"))
    keep = [c for c in linked.columns if c != column]
    names = {c: unused(c, keep) for c in ("n_best", "count_sum")}
    fields = [StructField(n, LongType()) for n in names.values()]

    def make():
        def kernel(packed, _):
            codes, times, row = unpack_links(packed)
            at = np.searchsorted(code, codes)
            n_best, total = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
            np.add.at(n_best, row, times * top[at])
            np.add.at(total, row, times * count[at])
            return [pa.array(n_best), pa.array(total)]

        return kernel

    return map_rows(linked, make, fields, column, keep), names
