"""Statistics of whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Integer statistics of a text, in the order of ``counts``.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Ratios that describe a text independent of its length, in the order of ``features``.
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "exclaim_share", "punct_share", "distinct_share", "echo_share", "line_words", "short_share", "bare_share",
    "non_ascii_share", "sentence_share",
)

_CLASSES = {
    "space": b" \t\n\r\x0b\x0c",
    "symbol": SYMBOLS,
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "exclaim": b"!?",
    "punct": b".,;:'\"()-",
    "continued": bytes(range(128, 192)),
    "high": bytes(range(128, 256)),
}
_TABLE = np.zeros((256, len(_CLASSES)), np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _i] = 1
_AT = {name: i for i, name in enumerate(_CLASSES)}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that is found twice or more in the text, the first included."""
    grams = list(zip(*[words[i:] for i in range(width)]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    total, reach = 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            total += i + width - max(i, reach)
            reach = i + width
    return total


def duplicate_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    real = [line for line in lines if line.split()]
    return len(real) - len(set(real))


def measure(raw: bytes) -> tuple[list[int], list[float]]:
    """The counts and the features of one text."""
    words = raw.split()
    lines = raw.split(b"\n")
    classes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE
    chars = len(raw) - int(classes[_AT["continued"]])
    n = len(words)
    word_chars = chars - int(classes[_AT["space"]])
    symbols = int(classes[_AT["symbol"]])
    dup = duplicate_lines(lines)
    repeat = repeated_words(words)
    letters = int(classes[_AT["upper"]] + classes[_AT["lower"]])
    w, c = max(n, 1), max(word_chars, 1)
    echo = sum(map(bytes.__eq__, words, words[1:]))
    short = sum(1 for x in words if len(x) <= 3)
    bare = sum(1 for x in words if not x.isalnum() and len(x) <= 2)
    ended = sum(1 for line in lines if line.rstrip()[-1:] in (b".", b"!", b"?"))
    features = [
        np.log1p(n), word_chars / w, symbols / c, dup / max(len(lines), 1), repeat / w,
        classes[_AT["upper"]] / max(letters, 1), classes[_AT["digit"]] / c, classes[_AT["exclaim"]] / w,
        classes[_AT["punct"]] / w, len(set(words)) / w, echo / w, n / len(lines), short / w, bare / w,
        classes[_AT["high"]] / max(len(raw), 1), ended / len(lines),
    ]
    return [n, word_chars, symbols, dup, repeat], [float(x) for x in features]


def features_of(texts: list[bytes]) -> np.ndarray:
    return np.array([measure(raw)[1] for raw in texts], np.float64).reshape(len(texts), len(FEATURES))
