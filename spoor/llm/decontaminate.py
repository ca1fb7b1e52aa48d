"""Benchmark items in training texts: BM25 with block-max bounds, then overlap of both parts.

The test items make an inverted index with BM25 weights, each divided by the score that the item
reaches on itself, so one threshold serves all items. Every passage of every document is a
query, and all items at or above the threshold are wanted, not the best few. Items stand in
blocks of like items. Per term and block the index knows the greatest weight; the sum of those
over the terms of a passage bounds every score in the block. As in WAND the bound is first taken
over the rarer terms, with the most that the common terms could add, so that most passages open
no block. Passages that open a block are scored on its items together, as a product of matrices.

A passage is two neighbouring segments, and a segment is at least as long as the longest item:
every run of words as long as an item lies within one passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from spoor.llm.common import over_batches

K1, B = 1.2, 0.75
#: Share of an item's score on itself that a passage has to reach.
THRESHOLD = 0.5
#: Share of the word 5-grams of a part that a passage has to hold.
OVERLAP, GRAM = 0.8, 5
BLOCK = 8
SEGMENT = 64
#: Most that the common terms may add to a bound; others are looked up.
COMMON = 0.2
#: Bytes of item texts in one index; more items make several indexes, one pass for each.
INDEX_BYTES = 32 << 20
#: Words that are looked up at a time.
WORDS = 1 << 20
#: Cells (segment, term) that are marked at a time.
MARKS = 4 << 20
#: Cells (term, item) of the blocks whose weights are kept as matrices.
CELLS = 4 << 20

words_of = re.compile(r"\w+").findall
#: ASCII characters in lower case, those of no word as spaces.
PLAIN = {n: chr(n).lower() if re.match(r"\w", chr(n)) else " " for n in range(128)}


def lower_words_of(text: str) -> list[str]:
    """The words of the text in lower case; ASCII texts take a shorter way to the same words."""
    return text.translate(PLAIN).split() if text.isascii() else words_of(text.lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """The words of question and answer: the answer follows the last question mark, or else the
    last end of a sentence; without either it is empty."""
    cut = text.rfind("?") + 1
    if not cut or not words_of(text[cut:]):
        ends = [m.end() for m in re.finditer(r"[.!?:](?=\s)", text) if words_of(text[m.end() :])]
        cut = ends[-1] if ends else len(text)
    return words_of(text[:cut].lower()), words_of(text[cut:].lower())


def grams_of(words: list[str]) -> set[tuple[str, ...]]:
    """The distinct word 5-grams, or the whole sequence if it is shorter."""
    return {tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


class Index:
    """The inverted index of one bounded set of items, as arrays."""

    def __init__(self, items: list[Row], threshold: float):
        self.threshold = threshold
        texts = [(r["item"], *parts_of(r["text"] or "")) for r in items]
        texts = [(i, q, a) for i, q, a in texts if q or a]
        df = Counter(t for _, q, a in texts for t in set(q) | set(a))
        # Like items side by side: those that share their most common words.
        texts.sort(key=lambda x: (sorted(set(x[1] + x[2]), key=lambda t: (-df[t], t))[:4], str(x[0])))
        self.items = texts
        self.terms = {t: n for n, t in enumerate(sorted(df, key=lambda t: (df[t], t)))}
        self.longest = max((len(q) + len(a) for _, q, a in texts), default=1)
        self.blocks = -(-len(texts) // BLOCK)
        self._weigh(df)
        self._bound()

    def _weigh(self, df: Counter) -> None:
        n = len(self.items)
        mean = sum(len(q) + len(a) for _, q, a in self.items) / max(n, 1)
        self.vectors, self.matrices, self.cells = [], {}, 0
        for _, q, a in self.items:
            counts = Counter(q + a)
            length = K1 * (1 - B + B * (len(q) + len(a)) / mean)
            ids = np.array([self.terms[t] for t in counts], np.int64)
            weights = np.array([
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + length)
                for t, c in counts.items()
            ])
            self.vectors.append((ids, weights / weights.sum()))

    def _bound(self) -> None:
        """Greatest weights by (term, block), and by block what the common terms add at most."""
        best: dict[tuple[int, int], float] = {}
        for place, (ids, weights) in enumerate(self.vectors):
            for t, w in zip(ids.tolist(), weights.tolist()):
                key = (t, place // BLOCK)
                best[key] = max(best.get(key, 0.0), w)
        size = len(self.terms)
        # Terms are numbered from rare to common: find the first of those that count as common.
        first = size
        share = np.zeros(len(self.items))
        holders: dict[int, list[tuple[int, float]]] = {}
        for place, (ids, weights) in enumerate(self.vectors):
            for t, w in zip(ids.tolist(), weights.tolist()):
                holders.setdefault(t, []).append((place, w))
        for t in range(size - 1, -1, -1):
            for place, w in holders[t]:
                share[place] += w
            if max(share[place] for place, _ in holders[t]) > min(COMMON, self.threshold):
                for place, w in holders[t]:
                    share[place] -= w
                break
            first = t
        self.rare = first
        self.extra = np.zeros(max(self.blocks, 1))
        np.maximum.at(self.extra, np.arange(len(self.items)) // BLOCK, share)
        rows = sorted((t, b, w) for (t, b), w in best.items() if t < first)
        self.block_of = np.array([b for _, b, _ in rows], np.int64)
        self.bound_of = np.array([w for _, _, w in rows])
        counts = np.bincount(np.array([t for t, _, _ in rows], np.int64), minlength=size)
        self.start = np.concatenate([[0], np.cumsum(counts)])

    def opened(self, ids: np.ndarray, segment: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows (passage, block) whose bound reaches the threshold.

        ``ids`` are term numbers or -1, ``segment`` the segment of each word, and ``last`` marks
        segments that end a document. Passage p is segments p and p + 1.
        """
        known = (ids >= 0) & (ids < self.rare)
        pairs = _distinct(segment[known] * self.rare + ids[known])
        segments, terms = np.divmod(pairs, max(self.rare, 1))
        counts = self.start[terms + 1] - self.start[terms]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - self.start[terms], counts)
        cells = np.repeat(segments, counts) * self.blocks + self.block_of[at]
        cells, inverse = np.unique(cells, return_inverse=True)
        sums = np.bincount(inverse, self.bound_of[at], len(cells))
        # The bound of a passage adds those of its two segments.
        segments, blocks = np.divmod(cells, max(self.blocks, 1))
        first = np.concatenate([cells, cells[(segments > 0)] - self.blocks])
        first = _distinct(first)
        bound = _lookup(cells, sums, first) + np.where(
            last[first // max(self.blocks, 1)], 0.0, _lookup(cells, sums, first + self.blocks)
        )
        keep = bound + self.extra[first % max(self.blocks, 1)] >= self.threshold - 1e-9
        return np.stack(np.divmod(first[keep], max(self.blocks, 1)), axis=1)

    def reached(
        self, opened: np.ndarray, ids: np.ndarray, segment: np.ndarray, last: np.ndarray
    ) -> list[tuple[int, int]]:
        """Pairs (passage, place) of the items in opened blocks that reach the threshold, up to
        rounding, in order. ``opened`` is what ``opened`` returns, the others are its arguments."""
        size = len(self.terms)
        step = max(1, MARKS // max(size, 1) - 1)
        marks = np.zeros((min(step, len(last)) + 1, size), bool)
        known = np.flatnonzero(ids >= 0)
        ids, segment = ids[known], segment[known]
        found = []
        for lowest in np.unique(opened[:, 0] // step) * step:
            # A passage reaches into the segment after it.
            begin, end = np.searchsorted(segment, [lowest, lowest + step + 1])
            here = (segment[begin:end] - lowest, ids[begin:end])
            marks[here] = True
            mine = opened[slice(*np.searchsorted(opened[:, 0], [lowest, lowest + step]))]
            mine = mine[np.argsort(mine[:, 1], kind="stable")]
            blocks, starts = np.unique(mine[:, 1], return_index=True)
            for block, group in zip(blocks.tolist(), np.split(mine[:, 0], starts[1:])):
                terms, weights = self._matrix(block)
                rows = (group - lowest)[:, None]
                present = marks[rows, terms]
                on = np.flatnonzero(~last[group])
                present[on] |= marks[rows[on] + 1, terms]
                row, column = np.nonzero(present @ weights >= self.threshold - 1e-6)
                found += zip(group[row].tolist(), (column + block * BLOCK).tolist())
            marks[here] = False
        return sorted(found)

    def _matrix(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a block's items, and their weights by (term, item)."""
        if block not in self.matrices:
            if self.cells > CELLS:
                self.matrices.clear()
                self.cells = 0
            vectors = self.vectors[block * BLOCK : (block + 1) * BLOCK]
            terms = np.unique(np.concatenate([ids for ids, _ in vectors]))
            weights = np.zeros((len(terms), len(vectors)))
            for column, (ids, w) in enumerate(vectors):
                weights[np.searchsorted(terms, ids), column] = w
            self.matrices[block] = terms, weights
            self.cells += weights.size
        return self.matrices[block]

    def score(self, present: np.ndarray, place: int) -> float:
        """The score of an item, given which terms a passage has."""
        ids, weights = self.vectors[place]
        return float(weights[present[ids]].sum())


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; here sorting is far faster than the hashes of ``np.unique``."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([numbers[:1] == numbers[:1], numbers[1:] != numbers[:-1]])]


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, zero for keys that are not there."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _overlap(part: list[str], grams: dict[int, set], words: list[str]) -> float | None:
    """Share of the part's grams among ``words``; None for an empty part."""
    wanted = grams_of(part)
    if not wanted:
        return None
    n = len(next(iter(wanted)))
    if n not in grams:
        grams[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(wanted & grams[n]) / len(wanted)


def search(index: Index, texts: list[str | None]) -> list[tuple]:
    """Rows (text number, item, score, overlap, question, answer) of the leaks in the texts.

    The best passage of each text and item counts.
    """
    size = max(SEGMENT, index.longest)
    get, best = index.terms.get, {}

    def flush(group: list[tuple[int, list[str]]]) -> None:
        lengths = np.array([len(w) for _, w in group])
        segments = -(-lengths // size)
        bases = np.concatenate([[0], np.cumsum(segments)])
        words = chain.from_iterable(w for _, w in group)
        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, lengths.sum())
        starts = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.arange(len(ids)) - np.repeat(starts[:-1], lengths)
        segment = np.repeat(bases[:-1], lengths) + inside // size
        last = np.zeros(bases[-1], bool)
        last[bases[1:] - 1] = True
        present = np.zeros(len(index.terms) + 1, bool)
        now = -1
        opened = index.opened(ids, segment, last)
        for passage, place in index.reached(opened, ids, segment, last):
            if passage != now:
                now = passage
                member = int(np.searchsorted(bases, passage, "right")) - 1
                number, words = group[member]
                begin = (passage - int(bases[member])) * size
                words, grams = words[begin : begin + 2 * size], {}
                here = starts[member] + begin
                seen = ids[here : here + len(words)]
                present[:] = False
                present[seen] = True
                present[-1] = False  # where unknown words went
            score = index.score(present, place)
            if score >= index.threshold - 1e-9:
                item, question, answer = index.items[place]
                shares = [_overlap(p, grams, words) for p in (question + answer, question, answer)]
                parts = [s for s in shares[1:] if s is not None]
                if shares[0] >= OVERLAP or min(parts) >= OVERLAP:
                    row = (shares[0], score, *shares[1:])
                    key = (number, place)
                    if key not in best or row[:2] > best[key][0][:2]:
                        best[key] = (row, item)

    group, count = [], 0
    for number, text in enumerate(texts):
        words = lower_words_of(text or "")
        if words:
            group.append((number, words))
            count += len(words)
        if count > WORDS:
            flush(group)
            group, count = [], 0
    if group:
        flush(group)
    return [
        (number, item, row[1], row[0], row[2], row[3])
        for (number, _), (row, item) in sorted(best.items())
    ]


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """``key, item_key, score, overlap, question_overlap, answer_overlap`` of every leak.

    A row means that a passage of the document reaches the threshold on the item and holds at
    least ``OVERLAP`` of the word 5-grams of the item, or of question and answer each; a part of
    fewer words counts as one gram. Items and texts without words, null ones included, leak
    nowhere; the overlap of an empty part is null. Repeated items and documents give rows each.

    The items are read to the driver in sets of at most ``INDEX_BYTES``, however many there are,
    and the documents are passed once for each set.
    """
    key_type, item_type = (
        df.schema[name].dataType.simpleString() for df, name in ((docs, key), (items, item_key))
    )
    schema = (
        f"{key} {key_type}, {item_key} {item_type}, score double, overlap double, "
        "question_overlap double, answer_overlap double"
    )
    out = docs.sparkSession.createDataFrame([], schema)
    for part, shared in enumerate(_indexes(items, item_key, item_text, threshold)):

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            rows = search(shared.value, batch.column(1).to_pylist())
            numbers, *columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [_arrow_type(item_type), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(numbers, pa.int64())),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                ],
                names=[key, item_key, "score", "overlap", "question_overlap", "answer_overlap"],
            )

        found = over_batches(docs.select(key, text), work, schema)
        out = out.unionByName(found) if part else found
    return out


def drop_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all of their columns."""
    place = docs.columns.index(text)
    for shared in _indexes(items, item_key, item_text, threshold):

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = {r[0] for r in search(shared.value, batch.column(place).to_pylist())}
            return batch.filter(
                pa.array([i not in found for i in range(batch.num_rows)], pa.bool_())
            )

        docs = over_batches(docs, work, docs.schema)
    return docs


def _indexes(
    items: DataFrame, key: str, text: str, threshold: float
) -> Iterator[Broadcast[Index]]:
    """The indexes of all items, each broadcast; a set is bounded by the bytes of its texts."""
    context = items.sparkSession.sparkContext
    items = items.select(F.col(key).alias("item"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = -(-size // INDEX_BYTES)
    for part in range(sets):
        # Items are dealt by a hash.
        mine = items.filter(F.pmod(F.xxhash64("text", "item"), F.lit(sets)) == part)
        index = Index(mine.collect(), threshold)
        if index.items:
            yield context.broadcast(index)


def _arrow_type(name: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return kinds[name]
