"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes those whose inner product with it reaches a bound, and
near vectors pass the same ones. The directions form a product code: the space is turned at
random and halved, each half has ``B`` random unit vectors, and every pair of them, joined, is
one direction. So ``B * B`` directions cost ``2 B`` inner products, and all that exceed the
bound are listed by walking the sorted products of one half for each of the other
(``Code.decode``). The bound follows from the number of directions: a random vector passes
``HITS`` of them on average, and each passes ``LEAST`` at least. The number of directions grows
with the vectors, so that a filter holds about ``BUCKET`` of one label.

Vectors meet by label and filter, and every pair in a filter is compared by its cosine. Pairs do
not leave the task: it gives the links of each vector, a pair counted in the first filter that
it shares, and a spanning forest. Equal vectors are one node from the start. Filters with more
than ``PART`` vectors are cut into parts, and each pair of parts is a task of its own.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import Scratch, over_batches
from spoor.llm.components import components

COSINE = 0.93
#: Filters that a vector passes on average, and at least.
HITS = 12
LEAST = 6
#: Vectors of one label that a filter should hold.
BUCKET = 64
#: Vectors of one filter that a task compares with each other.
PART = 2048
#: Rows of the filters that share a task.
SLOT_ROWS = 8192
SEED = 13
_STEP = 512


# ---------------------------------------------------------------- the code


def _tail(dim: int, bounds: np.ndarray) -> np.ndarray:
    """Share of the unit sphere whose inner product with a direction reaches each bound."""
    x = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - x * x, 0) ** max(0.0, (dim - 3) / 2)
    below = np.cumsum(density)
    return 1 - np.interp(bounds, x, below / below[-1])


class Code:
    """``size * size`` directions in ``dim`` dimensions, the same in every task."""

    def __init__(self, dim: int, size: int, hits: int = HITS, least: int = LEAST):
        rng = np.random.default_rng((SEED, dim, size))
        self.size, self.least = size, min(least, size)
        self.half = max(1, -(-dim // 2))
        turned = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.turn = np.pad(turned, ((0, 0), (0, 2 * self.half - dim)))
        halves = rng.normal(size=(2, size, self.half))
        self.halves = halves / np.linalg.norm(halves, axis=2, keepdims=True)
        bounds = np.linspace(-1, 1, 20_001)
        enough = _tail(dim, bounds) * size * size >= hits
        self.bound = float(bounds[enough].max(initial=-1.0))

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` of every direction that a row passes, ordered by row and filter."""
        n, size = len(units), self.size
        y = units @ self.turn
        left = y[:, : self.half] @ self.halves[0].T
        right = y[:, self.half :] @ self.halves[1].T
        order = np.argsort(right, axis=1)
        right = np.take_along_axis(right, order, axis=1)
        # The ``least`` greatest sums lie among as many greatest of each half.
        best = np.sort(left, axis=1)[:, -self.least :, None] + right[:, None, -self.least :]
        fallback = np.sort(best.reshape(n, -1), axis=1)[:, -self.least]
        bound = np.minimum(self.bound * np.sqrt(2), fallback) - 1e-9
        need = bound[:, None] - left
        row, i = np.nonzero(need <= right[:, -1:])
        # One search for all rows: each row's products lie in an interval of their own.
        flat = (right + 4.0 * np.arange(n)[:, None]).ravel()
        start = np.searchsorted(flat, np.maximum(need[row, i], -1.5) + 4.0 * row)
        count = np.maximum((row + 1) * size - start, 0)
        at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        row, i = np.repeat(row, count), np.repeat(i, count)
        found = i * size + order[row, at - row * size]
        place = np.lexsort((found, row))
        return row[place], found[place]


@lru_cache(8)
def _code(dim: int, size: int, hits: int, least: int) -> Code:
    return Code(dim, size, hits, least)


# ---------------------------------------------------------------- vectors


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components in double precision, NaN for null ones, and where each vector starts."""
    return (
        column.values.to_numpy(zero_copy_only=False).astype(np.float64),
        column.offsets.to_numpy(),
    )


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _marks(rows: DataFrame) -> DataFrame:
    """``row, kind, digest``: null where the vector links with nothing.

    ``kind`` is the number of components and the label, ``digest`` 128 bits of the vector.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, vectors = batch.column(1), batch.column(2)
        flat, starts = _values(vectors)
        kinds, digests = [], []
        for i, label in enumerate(labels.to_pylist()):
            v = flat[starts[i] : starts[i + 1]]
            good = label is not None and vectors[i].is_valid and v.any() and np.isfinite(v).all()
            kinds.append(f"{len(v)}:{label}" if good else None)
            digests.append(
                blake2b((v + 0.0).tobytes(), digest_size=16).hexdigest() if good else None
            )
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kinds, pa.string()), pa.array(digests, pa.string())],
            names=["row", "kind", "digest"],
        )

    return over_batches(rows, work, "row long, kind string, digest string")


def _hits(classes: DataFrame, size: int, hits: int, least: int, vectors: bool) -> DataFrame:
    """One row per node and filter that it passes.

    ``kind, filter``, and with ``vectors`` also the node, its copies, the filters before this
    one and the vector.
    """
    kind_of_vector = dict(classes.dtypes)["vector"]

    def work(batch: pa.RecordBatch) -> pa.Table:
        flat, starts = _values(batch.column(3))
        lengths = np.diff(starts)
        out = []
        for dim in np.unique(lengths):
            members = np.flatnonzero(lengths == dim)
            part = batch.take(pa.array(members))
            x = flat[starts[members][:, None] + np.arange(dim)]
            row, found = _code(int(dim), size, hits, least).decode(_units(x))
            columns = [part.column(0).take(pa.array(row)), pa.array(found, pa.int64())]
            if vectors:
                first = np.searchsorted(row, np.arange(len(members)))
                before = np.arange(len(row)) - first[row]
                ends = np.cumsum(before)
                at = np.arange(before.sum()) - np.repeat(ends - before, before)
                earlier = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, ends], pa.int32()),
                    pa.array(found[np.repeat(first[row], before) + at], pa.int64()),
                )
                columns += [part.column(1).take(pa.array(row)), part.column(2).take(pa.array(row)),
                            earlier, part.column(3).take(pa.array(row))]
            out.append(pa.table(columns, names=names))
        return pa.concat_tables(out)

    names, schema = ["kind", "filter"], "kind string, filter long"
    if vectors:
        names += ["node", "copies", "earlier", "vector"]
        schema += f", node long, copies long, earlier array<long>, vector {kind_of_vector}"
    return over_batches(classes.select("kind", "node", "copies", "vector"), work, schema)


# ---------------------------------------------------------------- comparison


def _shared_before(earlier: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair have a filter in common before this one."""
    used = np.unique(np.r_[i, j])
    place = np.zeros(len(earlier), np.int64)
    place[used] = np.arange(len(used))
    lengths = [len(earlier[u]) for u in used]
    flat = np.concatenate([earlier[u] for u in used])
    names, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    twice = count > 1
    if not twice.any():
        return np.zeros(len(i), bool)
    number = np.cumsum(twice) - 1
    keep = twice[column]
    member = np.zeros((len(used), int(twice.sum())), bool)
    member[np.repeat(np.arange(len(used)), lengths)[keep], number[column[keep]]] = True
    bits = np.packbits(member, axis=1)
    step = max(1, (16 << 20) // bits.shape[1])
    return np.concatenate([
        (bits[place[i[at : at + step]]] & bits[place[j[at : at + step]]]).any(axis=1)
        for at in range(0, len(i), step)
    ])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(units, copies, earlier, side, cosine):
    """``(links, root)`` per row; with two sides only pairs across them count."""
    n, pairs = len(units), []
    for at in range(0, n, _STEP):
        i, j = np.nonzero(units[at : at + _STEP] @ units.T >= cosine)
        i = i + at
        good = (j > i) if side is None else (j > i) & (side[i] != side[j])
        pairs.append((i[good].astype(np.int32), j[good].astype(np.int32)))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    links = np.zeros(n)
    if not len(i):
        return links.astype(np.int64), np.arange(n)
    new = ~_shared_before(earlier, i, j)
    links += np.bincount(i[new], copies[j[new]], n) + np.bincount(j[new], copies[i[new]], n)
    return links.astype(np.int64), _forest(n, i, j)


def _verify(cosine: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def verify(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("kind", "filter", "a", "b", "node")])
        rows = rows.combine_chunks()
        kinds = rows["kind"].combine_chunks().dictionary_encode().indices.to_numpy()
        marks = np.column_stack([kinds, *(rows[c].to_numpy() for c in ("filter", "a", "b"))])
        starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
        flat, at = _values(rows["vector"].combine_chunks())
        listed = rows["earlier"].combine_chunks()
        names, where = listed.values.to_numpy(), listed.offsets.to_numpy()
        nodes, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        mine = rows["mine"].to_numpy()
        out = []
        for start, end in zip(starts, [*starts[1:], len(rows)]):
            if end - start < 2:
                continue
            units = _units(flat[at[start] : at[end]].reshape(end - start, -1))
            earlier = [names[where[r] : where[r + 1]] for r in range(start, end)]
            across = marks[start, 2] != marks[start, 3]
            links, root = _compare(
                units, copies[start:end], earlier, mine[start:end] if across else None, cosine
            )
            hit = np.flatnonzero((links > 0) | (root != np.arange(end - start)))
            own = nodes[start:end]
            out.append((own[hit], links[hit], own[root[hit]]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return verify


def _cells(hits: DataFrame, counts: DataFrame, scratch: Scratch, part: int) -> DataFrame:
    """Adds the cell ``a, b`` of the filter's grid, and ``mine``, the part of the row."""
    zero = F.lit(0).cast("long")
    big = scratch.put(counts.filter(F.col("n") > part))
    if big.isEmpty():
        return hits.withColumns({"a": zero, "b": zero, "mine": zero})
    parts = F.ceil(F.col("n") / part).cast("long")
    on = ["kind", "filter"]
    marked = hits.join(F.broadcast(big) if big.count() < 100_000 else big, on, "left")
    return (
        marked.withColumn("parts", F.coalesce(parts, F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("node"), "parts"))
        .withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        .withColumns({"a": F.least("mine", "other"), "b": F.greatest("mine", "other")})
        .drop("n", "parts", "other")
    )


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    cosine: float = COSINE, hits: int = HITS, least: int = LEAST, bucket: int = BUCKET,
    part: int = PART,
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Linked are rows of one label whose vectors have a cosine of ``cosine`` or more, as far as
    the filters find them; none below. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the least key reachable, the row's own included, and ``kept`` says
    whether that is the row's own.

    A null label, and a vector that is null, empty, zero or holds null or non-finite components,
    links with nothing. Vectors of different lengths do not link. Rows with one key are vectors
    of their own. A null key is no candidate for the least one; a component of null keys only
    has a null id, and its rows are kept. An empty table gives no rows. Other columns are not
    read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.put(vectors.select(
        F.col(key).alias("id"), F.col(label).cast("string").alias("label"),
        F.col(vector).alias("vector"), F.monotonically_increasing_id().alias("row"),
    ))
    marks = _marks(rows.select("row", "label", "vector"))
    marked = scratch.put(marks.join(rows, "row").select("row", "id", "kind", "digest", "vector"))
    classes = scratch.put(
        marked.filter("digest is not null").groupBy("kind", "digest").agg(
            F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"),
            F.min("id").alias("least"), F.any_value("vector").alias("vector"),
        )
    )
    largest = classes.groupBy("kind").count().agg(F.max("count")).first()[0] or 1
    size = max(2, int(np.ceil(np.sqrt(hits * largest / bucket))))
    counts = scratch.put(
        _hits(classes, size, hits, least, vectors=False)
        .groupBy("kind", "filter").agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    met = _cells(_hits(classes, size, hits, least, vectors=True), counts, scratch, part)
    # Filters of one slot share a task; a cell of a grid has one of its own.
    slots = F.lit(max(1, total // SLOT_ROWS))
    cell = F.xxhash64("kind", "filter", "a", "b")
    grid = F.col("b") > 0
    slot = F.when(grid, cell).otherwise(F.pmod(F.xxhash64("kind", "filter"), slots))
    found = scratch.put(
        met.withColumn("slot", slot).groupBy("slot")
        .applyInArrow(_verify(cosine), "node long, links long, root long")
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = scratch.put(components(
        found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), scratch
    ))
    lowest = joined.join(classes, "node").groupBy("label").agg(F.min("least").alias("lowest"))
    of_class = (
        classes.drop("vector").join(links, "node", "left")
        .join(joined.join(lowest, "label").select("node", "lowest"), "node", "left")
        .select(
            "kind", "digest",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("lowest", "least").alias("component_id"),
        )
    )
    own = F.col("id").alias(key)
    alone = F.col("digest").isNull()
    linked = marked.drop("vector").join(of_class, ["kind", "digest"], "left")
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return linked.select(
        own, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"), F.equal_null("id", component).alias("kept"),
    )
