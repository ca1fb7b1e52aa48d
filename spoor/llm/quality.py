"""Repetition coverage: how much of a text lies inside repeated n-grams and lines.

Words are numbered within their text, n-grams get rolling hashes in numpy, and the characters
of all words inside an n-gram that the text has had before are added up, each word once. A text
is rejected if that share of its word characters exceeds the limit of any n-gram length, or if
repeated lines hold too large a share. First occurrences do not count, so a passage given twice
counts once, and the limits are about half of what they would be with both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spoor.llm.common import find_words, over_batches

#: N-gram length to the largest share of word characters inside repeats. A heading
#: that comes again in a text of some 90 words stays below all of them.
LIMITS = {5: 0.15, 6: 0.14, 8: 0.14, 10: 0.14}
#: Largest share of characters in lines equal to an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

_DROP_SYMBOLS = {ord(c): None for c in SYMBOLS}
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, "
    + ", ".join(f"cover_{n} double" for n in LIMITS)
)


def _repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more, and which of them have occurred before."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(values), bool)
    again[order[1:][same]] = True
    twice = again.copy()
    twice[order[:-1][same]] = True
    return twice, again


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside any of the n-grams that are marked by their first word."""
    steps = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """A value for each n-gram. Exact while n ids fit into 64 bits, else a rolling hash."""
    width = int(ids.max()).bit_length()
    if width * n <= 64:
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            out = (out << np.uint64(width)) | ids[k : len(ids) - n + 1 + k]
        return out
    # Prefix hashes modulo 2^64: the hash of a window is one difference of two of them,
    # scaled by an inverse power so that equal windows agree wherever they stand. Ids are
    # scattered first, since small ones would leave the high bits to the powers alone.
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            out = out * _BASE + mixed[k : len(ids) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return out


def measure(text: str | None) -> tuple:
    """The measures of one text, in the order of ``SCHEMA``."""
    text = text or ""
    words = find_words(text)
    n_words = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    chars = int(lengths.sum())
    symbols = len(text) - len(text.translate(_DROP_SYMBOLS))

    seen: set[str] = set()
    dup_lines = dup_chars = line_chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            seen.add(line)

    numbers: dict[str, int] = {}
    ids = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n_words
    )
    repeat_words = 0
    cover = dict.fromkeys(LIMITS, 0.0)
    if n_words >= 3:
        # A repeated longer n-gram needs a repeated 3-gram, so most texts end here.
        twice, again = _repeated(_windows(ids, 3))
        if again.any():
            repeat_words = int(_covered(twice, 3, n_words).sum())
            for n in LIMITS:
                if n_words < n or not again.any():
                    break
                _, again = _repeated(_windows(ids, n))
                cover[n] = float(lengths[_covered(again, n, n_words)].sum() / max(chars, 1))
    failed = n_words < MIN_WORDS or 100 * repeat_words > 50 * n_words
    line_share = dup_chars / line_chars if line_chars else 0.0
    bad = line_share > LINE_LIMIT or any(cover[n] > LIMITS[n] for n in LIMITS)
    return (
        n_words, chars, symbols, dup_lines, repeat_words,
        failed, not failed and not bad, line_share, *cover.values(),
    )


def measure_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its measures and the verdict ``kept``.

    A null text counts as empty and is rejected, having fewer than 50 words. Rows are judged
    one by one: repeated ids or null ids change nothing. Other columns are not read.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(measure(t) for t in batch.column(1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c) for c in columns)],
            names=[key, *(part.split()[0] for part in SCHEMA.split(", "))],
        )

    return over_batches(docs.select(key, text), work, f"{key} {key_type}, {SCHEMA}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all of their columns."""
    place = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(place)
        return batch.filter(
            pa.array([measure(texts[i].as_py())[6] for i in range(batch.num_rows)], pa.bool_())
        )

    return over_batches(docs, work, docs.schema)
