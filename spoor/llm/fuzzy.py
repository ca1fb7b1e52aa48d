"""SimHash near-duplicates by fuzzy hashing with the Golay code.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18 (filled up with
zeros). Each segment stands for the indices of the codewords near it, and segments that differ
in at most two bits share an index. Four errors over three segments leave one of three cases:

* A and B have at most two errors each: they share an index of A together with one of B;
* A has three or more: B and C have one error at most together, so one of them is equal and
  the other shares an index;
* B has three or more: the same with A and C.

So fingerprints within four bits share one of about fifty keys. Fingerprints with a key in
common meet in one task, are compared exactly, and yield a spanning forest of their links, not
all pairs. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import Scratch, find_words, free_names, over_batches
from spoor.llm.components import components
from spoor.llm.golay import near_codewords

MAX_BITS = 4
SEED = 42
#: Fingerprints of one key that a task compares; more are split into a grid of parts.
PART = 4096

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_A, _B, _C = (23, 0), (23, 23), (18, 46)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of the word shingles of a text; zero without words."""
    words = find_words((text or "").translate(_LOWER))
    if not words:
        return 0
    encoded = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([len(w) + 1 for w in encoded])
    starts = [0, *ends[:-1].tolist()]
    joined = b" ".join(encoded)
    count = max(1, len(words) - width + 1)
    ends = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    over = np.zeros(64, np.int64)
    for at in range(0, count, 65536):
        hashes = np.fromiter(
            (
                digest(joined[a:b], SEED)
                for a, b in zip(starts[at : min(at + 65536, count)], ends[at : at + 65536])
            ),
            "<u8",
        )
        over += np.unpackbits(
            hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(0, dtype=np.int64)
    bits = np.packbits(2 * over > count, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4):
    """``key`` and the fingerprint as a signed long ``fp``, one row per document."""
    key_type = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        found = np.fromiter(
            (fingerprint(texts[i].as_py(), width) for i in range(batch.num_rows)),
            np.uint64, batch.num_rows,
        )
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"]
        )

    return over_batches(docs.select(key, text), work, f"{key} {key_type}, fp long")


def _segment(fps: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    bits, shift = part
    return ((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of unsigned fingerprints, as (row of the fingerprint, key)."""
    a, b, c = (_segment(fps, part) for part in (_A, _B, _C))
    (ka, ma), (kb, mb), (kc, mc) = (near_codewords(x) for x in (a, b, c))
    rows = np.arange(len(fps))
    found = []

    def add(kind: int, exact: np.ndarray, near: np.ndarray, mask: np.ndarray) -> None:
        keys = (np.int64(kind) << 40) | (exact.reshape(len(fps), -1, 1) << 12) | near[:, None, :]
        keep = np.broadcast_to(mask, keys.shape)
        owner = np.broadcast_to(rows[:, None, None], keys.shape)
        found.append((owner[keep], keys[keep]))

    add(0, ka, kb, ma[:, :, None] & mb[:, None, :])
    add(1, a, kc, mc[:, None, :])
    add(2, b, kc, mc[:, None, :])
    add(3, c, ka, ma[:, None, :])
    add(4, c, kb, mb[:, None, :])
    return np.concatenate([o for o, _ in found]), np.concatenate([k for _, k in found])


def _keyed(fps: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.Table:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = []
        for at in range(0, len(values), 2000):
            part = values[at : at + 2000]
            owner, keys = keys_of(part.view(np.uint64))
            parts.append(pa.record_batch({"key": keys, "fp": part[owner]}))
        return pa.Table.from_batches(parts)

    return over_batches(fps, work, "key long, fp long")


def forest(fps: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints that differ in ``limit`` bits or fewer.

    Each fingerprint looks only at those not reached yet, so a dense group costs about as many
    comparisons as it has members.
    """
    rest, sources, targets = fps, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= limit
            if near.any():
                hits = rest[near]
                sources.append(np.full(len(hits), at))
                targets.append(hits)
                rest = rest[~near]
                front.extend(hits)
    if not sources:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(sources), np.concatenate(targets)


def _group_links(group: np.ndarray, fps: np.ndarray, limit: int):
    """Links within each run of equal ``group``; ``fps`` are unsigned."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[edges, len(group)])
    # Groups of two are most of them: compare them all at once.
    pairs = edges[sizes == 2]
    near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= limit
    out = [(fps[pairs[near]], fps[pairs[near] + 1])]
    for at, size in zip(edges[sizes > 2], sizes[sizes > 2]):
        out.append(forest(np.unique(fps[at : at + size]), limit))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _links(keyed: DataFrame, limit: int) -> DataFrame:
    """Links among the rows of equal ``key``, which are sorted together in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(keys, fps):
            a, b = _group_links(keys, fps, limit)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            keys = np.concatenate([held_keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate(
                [held_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            )
            if not len(keys):
                continue
            # The last key may go on in the next batch.
            whole = int(np.searchsorted(keys, keys[-1]))
            held_keys, held_fps = keys[whole:], fps[whole:]
            if whole:
                yield links(keys[:whole], fps[:whole])
        if len(held_keys):
            yield links(held_keys, held_fps)

    return keyed.mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, scratch: Scratch, limit: int = MAX_BITS, part: int = PART):
    """Enough links between distinct fingerprints to give the components of all links.

    A key with more than ``part`` fingerprints is cut into parts, and each pair of its parts
    meets in a task of its own.
    """
    keyed = _keyed(fps)
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    big = scratch.put(counts.filter(F.col("n") > part))
    if big.isEmpty():
        return _links(keyed.repartition("key").sortWithinPartitions("key"), limit).distinct()
    small = keyed.join(big, "key", "left_anti")
    found = _links(small.repartition("key").sortWithinPartitions("key"), limit)
    tiles = F.ceil(F.col("n") / part).cast("long")
    grid = (
        keyed.join(big, "key")
        .withColumn("mine", F.pmod(F.xxhash64("fp"), tiles))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        .select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
            "fp",
        )
    )
    found = found.unionByName(_links(grid.repartition("key").sortWithinPartitions("key"), limit))
    return found.distinct()


def group_near(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4,
    limit: int = MAX_BITS,
) -> DataFrame:
    """``key, fingerprint, component_id`` for every document.

    The component is the least key among all documents reachable over fingerprints that differ
    in ``limit`` bits or fewer. Texts without words, null ones included, have fingerprint zero
    and are linked like any other. Null keys are no candidates for the least key; a component
    of null keys only has a null id. Repeated rows each give a row; an empty table gives none.
    """
    if limit > MAX_BITS:
        raise ValueError(f"the keys cover at most {MAX_BITS} differing bits")
    scratch = Scratch(docs.sparkSession)
    marked = scratch.put(fingerprints(docs, key, text, width))
    classes = scratch.put(marked.groupBy("fp").agg(F.min(key).alias("first")))
    links = scratch.put(near_links(classes.select("fp"), scratch, limit))
    labels = scratch.put(
        components(links.select("a", "b"), scratch).withColumnRenamed("node", "fp")
    )
    least = labels.join(classes, "fp").groupBy("label").agg(F.min("first").alias("least"))
    of_class = (
        classes.join(labels.join(least, "label").select("fp", "least"), "fp", "left")
        .select("fp", F.when(F.col("least").isNull(), F.col("first")).otherwise(
            F.col("least")).alias("component_id"))
    )
    return marked.join(of_class, "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all of its columns.

    The row with the least key stays; a null key comes after all others. Of rows that are equal
    in every column one stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    a, b, row, n = free_names(docs, "a", "b", "row", "n")
    marks = docs.withColumns(
        {a: F.xxhash64(*columns), b: F.xxhash64(F.lit(1), *reversed(columns))}
    )
    rows = marks.select(
        F.struct(F.col(key).isNull().alias("last"), key, a, b).alias(row), text
    )
    chosen = group_near(rows, row, text).select(f"component_id.{a}", f"component_id.{b}").distinct()
    once = Window.partitionBy(a, b).orderBy(a)
    return (
        marks.join(chosen, [a, b], "left_semi")
        .withColumn(n, F.row_number().over(once))
        .filter(F.col(n) == 1)
        .drop(a, b, n)
    )
