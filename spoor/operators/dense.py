"""Rank reference vector sets for every query vector set.

MaxSim compares every vector of a query with every vector of a reference. Each side is a table
of distinct vectors and a table of who holds which, so that a vector that many labels hold is
compared once per task. Both are cut into parts of bounded size, *blocks* of queries and *tiles*
of references; a block and a tile meet in one task, and only what the ranking needs leaves it.

Tiles hold labels that lie near each other. For each tile the table knows, per ball of vectors,
how near to its centre and how far from it the tile's members lie, which bounds every score that
a query can reach in the tile. A query first meets the tile with its best bound. The k-th best
score found there is a floor, and after that it meets only tiles whose bound reaches the floor.
For the rank of the expected label, that label's own score is the floor. Results are those of
comparing everything.

A label with more vectors than a tile takes tiles of its own, and its partial scores are merged.

Labels with the same vectors are one class: ``dense_topk`` and ``dense_ranks`` compare classes,
and a rank searches the names of a class only where it ties.
"""

from __future__ import annotations

import copy
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from spoor.functions.numbers import ratio
from spoor.functions.vectors import best_columns, matrix_of, unit_rows
from spoor.operators import balls
from spoor.operators.overlap import names_before, value_blocks
from spoor.operators.pooling import mean_vectors
from spoor.operators.ranking import is_ahead, name_positions, order_score, top_k
from spoor.session import measured, ship_package, stored

# Rows of one tile; its distinct vectors are at most as many.
TILE_ROWS = 131_072
# A side is cut into about this many tiles or blocks at most while these fit a task, however
# small a tile was asked for: what is shuffled grows with their number.
MAX_TILES = 32
# Bytes that the vectors of a tile may take in double precision.
TILE_BYTES = 64 << 20
# Rows of a tile or block whose vectors are few, and tiles that such sides are cut into at least.
FEW_VECTORS_ROWS = 1 << 20
LEAST_TILES = 16
# Bytes of the best products of all vectors of a block with a tile, to be kept for all its queries.
BEST_BYTES = 128 << 20
# Rows of a block of queries; fewer, but not below the least, where that gives MAX_TILES blocks.
BLOCK_ROWS = 4_096
LEAST_BLOCK_ROWS = 1_024
MAX_TASKS = 20_000
# Queries scored at a time, and query vectors per matrix product.
STEP_QUERIES = 256
STEP_ROWS = 64
# Rows of a tile per matrix product, so that the products stay in the cache.
STEP_COLUMNS = 4_096
# Parts of balls in one task of the bounds.
SUMMARY_ROWS = 50_000
# Scores closer than this tie, so that the name decides (see order_score).
ORDER_DIGITS = 9
# Rows of references that are packed at a time, and bytes of a pack about.
PACK_ROWS = 65_536
PACK_BYTES = 4 << 20
# A bound this much below a floor closes a tile.
SLACK = 1e-7
# Scores farther apart than this keep their order when they are rounded.
NEAR = 2e-9

VECTOR_METHODS = ("mean_pool", "maxsim")
# More than the parts of any label.
_PARTS = 1_000_000

PARTS = pa.schema(
    [
        ("query", pa.string()),
        ("method", pa.string()),
        ("device", pa.string()),
        ("part", pa.int64()),
        ("best", pa.float64()),
        ("weight", pa.float64()),
        ("acc", pa.list_(pa.float64())),
        ("counted", pa.bool_()),
    ]
)
PARTS_SCHEMA = from_arrow_schema(PARTS)
PACKED = "unit long, part int, pack binary"
OPENED_SCHEMA = "query string, unit long, bound double"
# What is known of a class: places of the expected names of queries, and places of names.
FACTS = {"query": ["first", "last"], "device": ["members", "low", "high"]}


# ---------------------------------------------------------------- tables


def _distinct_vectors(df: DataFrame, keys: list[str]) -> _Distinct:
    """Rows ``(*keys, vid, copies)`` and vectors ``(vid, embedding)``, each vector once.

    Vectors are told apart by 128 bits of hashes, so that no vector is sorted or shuffled as a
    key.
    """
    marks = {"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}
    # New column identities: both sides may come from one bank.
    hashed = df.toDF(*df.columns).withColumns(marks)
    vectors, seen = measured(
        hashed.groupBy("h1", "h2").agg(F.any_value("embedding").alias("embedding"))
        .withColumn("vid", F.monotonically_increasing_id()),
        vectors=F.count(F.lit(1)), dim=F.max(F.size("embedding")),
    )
    rows = hashed.groupBy(*keys, "h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    rows, sizes = measured(
        rows.join(vectors.select("h1", "h2", "vid"), ["h1", "h2"]).drop("h1", "h2"),
        rows=F.count(F.lit(1)),
    )
    return _Distinct(rows, vectors.select("vid", "embedding"), sizes["rows"], **seen)


@dataclass(frozen=True)
class _Distinct:
    rows: DataFrame  # (label ..., vid, copies)
    held: DataFrame  # (vid, embedding)
    count: int  # of rows
    vectors: int
    dim: int | None


def _with_columns(df: DataFrame, **kinds: str) -> DataFrame:
    missing = {n: F.lit(None).cast(k) for n, k in kinds.items() if n not in df.columns}
    return df.withColumns(missing)


class _Placed:
    """Rows of one side with ``unit`` and ``part``: what is read together, and its pieces.

    Labels near each other share a unit; a label with more rows than fit has a unit of its own,
    in ``parts`` pieces (only with ``split``).
    """

    def __init__(self, side: _Distinct, label: str, size: int, split: bool, near=True):
        rows, self.vectors, self.label = side.rows, side.held, label
        self.rows = rows
        units = -(-side.count // size)
        one_part = {"part": F.lit(0), "whole": F.lit(True)}
        dealt = F.pmod(F.xxhash64(label), F.lit(max(1, units)))
        if units <= 1:
            self.rows, self.units = rows.withColumns({"unit": F.lit(0).cast("long"), **one_part}), units
            return
        self.centres = balls.fit_centres(self.vectors, side.vectors) if near is True else near
        if self.centres is None:
            labels, unit = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), dealt
        else:
            labels, unit, units = self._near(size, split)
        fits = (F.col("n") <= size) if split else F.lit(True)
        large = labels.filter(~fits)
        count_large = large.count() if split else 0
        self.units = units + count_large
        if self.centres is None and not count_large:
            self.rows = rows.withColumns({"unit": dealt, **one_part})
            return
        shared = labels.filter(fits).select(
            label, unit.cast("long").alias("unit"), F.lit(1).alias("parts")
        )
        if count_large:
            shared = shared.unionByName(large.join(name_positions(large, label), label).select(
                label, (F.col("position") + units).alias("unit"),
                F.ceil(F.col("n") / size).cast("int").alias("parts"),
            ))
        # Rows of one text stay together, so that texts are taken out together.
        salt = F.pmod(F.xxhash64(F.coalesce("text", F.col("vid").cast("string"))), F.col("parts"))
        self.rows = stored(
            rows.join(shared, label)
            .withColumns({"part": salt.cast("int"), "whole": F.col("parts") == 1}).drop("parts")
        )

    def _near(self, size: int, split: bool):
        """Labels, the unit of those that fit by the ball that holds most of a label, and
        the number of units."""
        self.balls = stored(balls.assign(self.vectors, self.centres))
        per_ball = self.rows.join(self.balls, "vid").groupBy(self.label, "ball").agg(
            F.count(F.lit(1)).alias("n")
        )
        labels = stored(per_ball.groupBy(self.label).agg(
            F.sum("n").alias("n"), F.max_by("ball", F.struct("n", -F.col("ball"))).alias("ball")
        ))
        held = labels.filter(F.col("n") <= size) if split else labels
        held = held.groupBy("ball").agg(F.sum("n")).collect()  # one row per ball
        groups, units = balls.group_balls(
            {r[0]: r[1] for r in held}, balls.along_a_tour(self.centres), size
        )

        def of_ball(place):
            pairs = [F.lit(x) for ball, found in groups.items() for x in (ball, found[place])]
            return F.create_map(*pairs)[F.col("ball")]

        return labels, of_ball(0) + F.pmod(F.xxhash64(self.label), of_ball(1)), units

    def with_vectors(self, rows: DataFrame, *place: str) -> DataFrame:
        """``rows`` and, once for each place, the vectors that its rows hold."""
        needed = rows.select(*place, "vid").distinct().join(self.vectors, "vid")
        return rows.unionByName(needed, allowMissingColumns=True)

    def summary(self) -> DataFrame:
        """``(unit, ball, low, high)``: angles between the unit's vectors and the ball's centre."""
        return self.rows.join(self.balls, "vid").groupBy("unit", "ball").agg(
            F.min("angle").alias("low"), F.max("angle").alias("high")
        )


# ---------------------------------------------------------------- kernel


def _packed(rows: DataFrame) -> DataFrame:
    """``(unit, part, pack)``: the rows of tiles as Arrow tables in bytes.

    A tile goes to every block that opens it, and a few packs travel faster than many rows.
    """
    def work(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= PACK_ROWS:
                yield from _packs(pa.concat_tables(held))
                held = []
        if held:
            yield from _packs(pa.concat_tables(held))

    return rows.mapInArrow(work, PACKED)


def _packs(rows: pa.Table):
    place = np.column_stack([rows["unit"].to_numpy(), rows["part"].to_numpy()])
    order = np.lexsort(place.T[::-1])
    rows, place = rows.drop_columns(["unit", "part"]).take(pa.array(order)), place[order]
    starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)][: len(place)])
    step = max(1, len(rows) * PACK_BYTES // max(1, rows.nbytes))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
        for at in range(a, b, step):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows.slice(at, min(step, b - at)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([place[a, 0]], pa.int64()), pa.array([place[a, 1]], pa.int32()),
                 pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["unit", "part", "pack"],
            )


def _unpacked(packs: pa.Table) -> pa.Table:
    return pa.concat_tables(
        [pa.ipc.open_stream(pack.as_buffer()).read_all() for pack in packs["pack"]]
    )


def _names(rows: pa.Table, column: str) -> np.ndarray:
    coded = rows[column].combine_chunks().dictionary_encode()
    names = np.array([*coded.dictionary.to_pylist(), None], dtype=object)
    return names[coded.indices.fill_null(len(names) - 1).to_numpy()]


def _coded(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The names of a column in order, a missing one last, and each row's place among them."""
    coded = rows[column].combine_chunks().dictionary_encode()
    names = np.array([*coded.dictionary.to_pylist(), None], dtype=object)
    order = np.argsort(names[:-1], kind="stable")
    place = np.full(len(names), len(order))
    place[order] = np.arange(len(order))
    return names[np.r_[order, len(order)]], place[coded.indices.fill_null(len(order)).to_numpy()]


def _starts(labels: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])


def _split_off_vectors(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of labels, the number of each row's vector, and the unit vectors."""
    is_vector = rows["copies"].combine_chunks().is_null()
    labelled = rows.drop_columns("embedding").filter(pa.compute.invert(is_vector))
    vectors = rows.select(["vid", "embedding"]).filter(is_vector)
    vids = vectors["vid"].to_numpy()
    order = np.argsort(vids)
    at = order[np.searchsorted(vids[order], labelled["vid"].to_numpy())]
    units = matrix_of(vectors["embedding"])
    # In place and a part at a time: the vectors are most of a task's memory.
    for first in range(0, len(units), STEP_COLUMNS):
        units[first : first + STEP_COLUMNS] = unit_rows(units[first : first + STEP_COLUMNS])
    return labelled, at, units


class _Tile:
    """The reference side of a task, devices in name order."""

    def __init__(self, rows: pa.Table, masked: bool):
        labelled, at, self.units = _split_off_vectors(rows)
        names, labels = _coded(labelled, "device")
        order = np.argsort(labels, kind="stable")
        labels = labels[order]
        self.vector = at[order]
        if len(self.vector) <= len(self.units):
            # In the order of the rows, so that no second copy is needed.
            self.units, self.vector = self.units[self.vector], np.arange(len(self.vector))
        self.starts = _starts(labels)
        self.ends = np.r_[self.starts[1:], len(labels)]
        self.devices = names[labels[self.starts]]
        self.device = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        self.whole = labelled["whole"].to_numpy(zero_copy_only=False)[order][self.starts]
        self.copies = labelled["copies"].to_numpy()[order].astype(np.float64)
        # Members of a class of labels, and the places of its first and last name.
        self.members = None
        if "members" in labelled.column_names:
            self.members, self.low, self.high = (
                labelled[c].to_numpy()[order][self.starts] for c in ("members", "low", "high")
            )
        self.best_of: np.ndarray | None = None
        self.rows_of: dict[str, np.ndarray] = {}
        if masked:
            listed = defaultdict(list)
            for row, text in enumerate(_names(labelled, "text")[order]):
                if text is not None:
                    listed[text].append(row)
            self.rows_of = {text: np.array(at) for text, at in listed.items()}

    def best(self, some: np.ndarray) -> np.ndarray:
        """The best product of each of some vectors with each device."""
        best = np.full((len(some), len(self.starts)), -np.inf)
        # Vectors of several rows are multiplied once.
        shared = len(self.units) < len(self.vector)
        products = some @ self.units.T if shared else None
        for at in range(0, len(self.vector), STEP_COLUMNS):
            rows = self.vector[at : at + STEP_COLUMNS]
            found = products[:, rows] if shared else some @ self.units[at : at + STEP_COLUMNS].T
            device = self.device[at : at + STEP_COLUMNS]
            met = slice(device[0], device[-1] + 1)
            np.maximum(
                best[:, met], np.maximum.reduceat(found, _starts(device), axis=1), out=best[:, met]
            )
        return best

    @cached_property
    def sums(self) -> np.ndarray:
        """Sums of the vectors of each device."""
        return np.add.reduceat(self.units[self.vector] * self.copies[:, None], self.starts, axis=0)

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.linalg.norm(self.sums, axis=1)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.add.reduceat(self.copies, self.starts)


class _Block:
    """The query side of a task: a row per query, its vectors and what it takes out."""

    def __init__(self, rows: pa.Table, tile: _Tile | None):
        labelled, at, self.units = _split_off_vectors(rows)
        names, labels = _coded(labelled, "query")
        order = np.argsort(labels, kind="stable")
        labelled, self.vector, labels = labelled.take(pa.array(order)), at[order], labels[order]
        self.starts = _starts(labels)
        self.ends = np.r_[self.starts[1:], len(labels)]
        first = labelled.take(pa.array(self.starts))
        self.first, self.names = first, names[labels[self.starts]]
        self.expected = _names(first, "expected")
        self.whole = first["whole"].to_numpy(zero_copy_only=False)
        self.copies = labelled["copies"].to_numpy().astype(np.float64)
        self.total = np.add.reduceat(self.copies, self.starts)
        self.vid_of = np.zeros(len(self.units), np.int64)
        self.vid_of[self.vector] = labelled["vid"].to_numpy()
        # Rows of the tile that each query takes out.
        self.gone: dict[int, np.ndarray] = {}
        if tile is not None and tile.rows_of:
            out = labelled["unseen"].to_pylist()
            texts = labelled["text"].to_pylist()
            for q, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
                gone = {t for t, x in zip(texts[a:b], out[a:b]) if x and t in tile.rows_of}
                if gone:
                    self.gone[q] = np.concatenate([tile.rows_of[t] for t in gone])

    def held(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct vectors of a query and how often it has each."""
        own = slice(self.starts[q], self.ends[q])
        held, column = np.unique(self.vector[own], return_inverse=True)
        return held, np.bincount(column, self.copies[own])

    def steps(self):
        """Runs of queries with the numbers of the vectors they hold and each query's weights."""
        for a in range(0, len(self.starts), STEP_QUERIES):
            b = min(a + STEP_QUERIES, len(self.starts))
            rows = slice(self.starts[a], self.ends[b - 1])
            held, column = np.unique(self.vector[rows], return_inverse=True)
            query = np.repeat(np.arange(b - a), self.ends[a:b] - self.starts[a:b])
            weights = np.zeros((b - a, len(held)))
            np.add.at(weights, (query, column), self.copies[rows])
            yield a, b, held, weights


def _maxsim(block: _Block, tile: _Tile, a: int, b: int, held, weights) -> np.ndarray:
    """Scores of the queries ``a:b`` against the devices of the tile."""
    if tile.best_of is None and 8 * len(block.units) * len(tile.starts) <= BEST_BYTES:
        # Once for all queries of the block.
        tile.best_of = np.empty((len(block.units), len(tile.starts)))
        for at in range(0, len(block.units), STEP_ROWS):
            tile.best_of[at : at + STEP_ROWS] = tile.best(block.units[at : at + STEP_ROWS])
    if tile.best_of is not None:
        best = tile.best_of if len(held) == len(tile.best_of) else tile.best_of[held]
        if not block.gone:
            return (weights / block.total[a:b, None]) @ best
        total = weights @ best
    else:
        total = np.zeros((b - a, len(tile.starts)))
        for at in range(0, len(held), STEP_ROWS):
            some = block.units[held[at : at + STEP_ROWS]]
            total += weights[:, at : at + STEP_ROWS] @ tile.best(some)
    for q in range(a, b):
        if q in block.gone:
            _take_out(block, tile, q, total[q - a])
    return total / block.total[a:b, None]


def _rows_of(tile: _Tile, devices: np.ndarray, gone: np.ndarray):
    """Rows that some devices keep, and the place of each row's device among them."""
    lengths = tile.ends[devices] - tile.starts[devices]
    rows = np.repeat(tile.ends[devices] - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
    place = np.repeat(np.arange(len(devices)), lengths)
    if not len(gone):
        return rows, place
    keep = ~np.isin(rows, gone)
    return rows[keep], place[keep]


def _take_out(block: _Block, tile: _Tile, q: int, totals: np.ndarray) -> None:
    """Totals anew for the devices that hold a row which the query takes out, and only those."""
    gone = block.gone[q]
    devices = np.unique(tile.device[gone])
    rows, place = _rows_of(tile, devices, gone)
    totals[devices] = 0.0
    if not len(rows):
        return
    first, kept = _starts(place), tile.units[tile.vector[rows]]
    held, weights = block.held(q)
    for at in range(0, len(held), STEP_ROWS):
        products = block.units[held[at : at + STEP_ROWS]] @ kept.T
        best = np.maximum.reduceat(products, first, axis=1)
        totals[devices[place[first]]] += weights[at : at + STEP_ROWS] @ best


def _mean_pool(block: _Block, tile: _Tile, a: int, b: int, held, weights) -> np.ndarray:
    means = unit_rows(weights @ block.units[held])
    dots = means @ tile.sums.T
    lengths = tile.lengths
    scores = np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)
    for q in range(a, b):
        if q not in block.gone:
            continue
        # Sums anew for the devices that lose a row, and only those.
        devices, sums = _sums_without(block, tile, q)
        length = np.linalg.norm(sums, axis=1)
        dot = sums @ means[q - a]
        scores[q - a, devices] = np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)
    return scores


def _sums_without(block: _Block, tile: _Tile, q: int) -> tuple[np.ndarray, np.ndarray]:
    gone = block.gone.get(q, np.empty(0, np.int64))
    devices, place = np.unique(tile.device[gone], return_inverse=True)
    sums, counts = tile.sums[devices], tile.counts[devices]
    np.subtract.at(sums, place, tile.units[tile.vector[gone]] * tile.copies[gone, None])
    np.subtract.at(counts, place, tile.copies[gone])
    sums[counts == 0] = 0.0
    return devices, sums


class _Rows:
    """Collects output rows by column."""

    def __init__(self):
        self.parts: list[pa.Table] = []

    def add(self, n: int, **columns) -> None:
        if n:
            out = []
            for field in PARTS:
                values = columns.get(field.name)
                if isinstance(values, np.ndarray):
                    out.append(pa.array(values, field.type))
                elif isinstance(values, list):
                    out.append(pa.array(values, field.type))
                else:
                    out.append(pa.array([values] * n, field.type))
            self.parts.append(pa.table(out, schema=PARTS))

    def table(self) -> pa.Table:
        return pa.concat_tables(self.parts) if self.parts else PARTS.empty_table()


def _own_maxsim(block: _Block, tile: _Tile, a: int, b: int) -> np.ndarray:
    """Scores of the queries ``a:b`` against their expected devices; NaN at all others."""
    scores = np.full((b - a, len(tile.starts)), np.nan)
    for q in range(a, b):
        at = _place_of_expected(block, tile, q)
        if at is not None and tile.whole[at]:
            held, weights = block.held(q)
            best = _best_by_row(block, tile, q, held, np.array([at]))[:, 0]
            scores[q - a, at] = weights @ np.nan_to_num(best) / block.total[q]
    return scores


def _place_of_expected(block: _Block, tile: _Tile, q: int) -> int | None:
    expected = block.expected[q]
    if expected is None:
        return None
    at = int(np.searchsorted(tile.devices, expected))
    return at if at < len(tile.devices) and tile.devices[at] == expected else None


def _best_by_row(block: _Block, tile: _Tile, q: int, held, devices: np.ndarray) -> np.ndarray:
    """Best product of each vector of a query with each of some devices; NaN where none is left."""
    rows, place = _rows_of(tile, devices, block.gone.get(q, np.empty(0, np.int64)))
    best = np.full((len(held), len(devices)), np.nan)
    if len(rows):
        first, kept = _starts(place), tile.units[tile.vector[rows]]
        for at in range(0, len(held), STEP_ROWS):
            products = block.units[held[at : at + STEP_ROWS]] @ kept.T
            best[at : at + STEP_ROWS, place[first]] = np.maximum.reduceat(products, first, axis=1)
    return best


def _emit_parts(out: _Rows, block: _Block, tile: _Tile, method: str, q: int, at, scores, key):
    """Partial scores of a query and the devices ``at``, to be merged across tasks."""
    name, whole = block.names[q], tile.whole[at]
    if method == "mean_pool":
        held, weights = block.held(q)
        mean = unit_rows((weights @ block.units[held])[None])[0]
        touched, corrected = _sums_without(block, tile, q)
        sums = tile.sums[at]
        for d, row in zip(touched, corrected):
            sums[at == d] = row
        acc = [[float(x @ mean), *x.tolist()] for x in sums]
        out.add(len(at), query=name, method=method, device=tile.devices[at], part=key[1], acc=acc)
        return
    done = at[whole]
    out.add(len(done), query=name, method=method, device=tile.devices[done], part=-1 - key[0],
            best=scores[done], weight=block.total[q])
    rest = at[~whole]
    if len(rest):
        held, weights = block.held(q)
        best = _best_by_row(block, tile, q, held, rest)
        out.add(
            best.size, query=name, method=method, device=np.repeat(tile.devices[rest], len(held)),
            part=np.tile(block.vid_of[held], len(rest)),
            best=[None if np.isnan(x) else float(x) for x in best.T.ravel()],
            weight=np.tile(weights, len(rest)),
        )


def _emit(out: _Rows, block, tile, method, mode, k, a, b, scores, key) -> None:
    if mode == "own":
        for q in range(a, b):
            at = _place_of_expected(block, tile, q)
            if at is not None:
                _emit_parts(out, block, tile, method, q, np.array([at]), scores[q - a], key)
        return
    partial = np.flatnonzero(~tile.whole)
    for q in range(a, b):
        at = np.arange(len(tile.devices)) if not block.whole[q] else partial
        if len(at):
            _emit_parts(out, block, tile, method, q, at, scores[q - a], key)
    rows = np.flatnonzero(block.whole[a:b])
    final = np.flatnonzero(tile.whole)
    if not len(rows) or not len(final):
        return
    names, found = tile.devices[final], scores
    if len(rows) < len(scores) or len(final) < scores.shape[1]:
        found = scores[np.ix_(rows, final)]
    if mode == "top":
        row, column = best_columns(found, k, ORDER_DIGITS)
        out.add(len(row), query=block.names[a:b][rows[row]], method=method, device=names[column],
                best=found[row, column], weight=1.0, counted=True)
        return
    own = np.round(block.first["own_" + method].to_numpy(zero_copy_only=False)[a:b][rows], ORDER_DIGITS)
    if tile.members is not None:
        first, last = (block.first[c].to_numpy()[a:b][rows] for c in ("first", "last"))
        members, low, high = tile.members[final], tile.low[final], tile.high[final]
        sure = found > own[:, None] + NEAR
        # Few are members of several names, mostly.
        ahead = sure.sum(axis=1)
        several = np.flatnonzero(members > 1)
        ahead += (sure[:, several] * (members[several] - 1)).sum(axis=1)
        row, column = np.nonzero((found >= own[:, None] - NEAR) & ~sure)
        close = np.round(found[row, column], ORDER_DIGITS)
        above = close > own[row]
        np.add.at(ahead, row[above], members[column[above]])
        tied = close == own[row]
        row, column = row[tied], column[tied]
        below = high[column] < first[row]
        np.add.at(ahead, row[below], members[column[below]])
        # The others are counted by name.
        row, column = (x[~below & (low[column] < last[row])] for x in (row, column))
        out.add(len(row), query=block.names[a:b][rows[row]], method=method, device=names[column],
                best=found[row, column], weight=1.0, counted=True)
        hit = np.flatnonzero(ahead)
        out.add(len(hit), query=block.names[a:b][rows[hit]], method=method, part=key[1],
                best=ahead[hit].astype(np.float64), weight=1.0, counted=True)
        return
    order = np.round(found, ORDER_DIGITS)
    before = np.array([
        len(names) if e is None else int(np.searchsorted(names, e)) for e in block.expected[a:b][rows]
    ])
    tied = (order == own[:, None]) & (np.arange(len(names)) < before[:, None])
    ahead = ((order > own[:, None]) | tied).sum(axis=1)  # a NULL score is ahead of none
    hit = np.flatnonzero(ahead)
    out.add(len(hit), query=block.names[a:b][rows[hit]], method=method, part=key[1],
            best=ahead[hit].astype(np.float64), weight=1.0, counted=True)


SCORERS = {"maxsim": _maxsim, "mean_pool": _mean_pool}


def _kernel(mode: str, methods: Sequence[str], k: int, masked: bool):
    """Function for one block and one tile.

    ``own``: parts of the score of each query's expected device. ``ahead``: number
    of devices ahead of it. ``top``: the k best devices.
    """

    def score_tiles(key, q: pa.Table, r: pa.Table) -> pa.Table:
        out = _Rows()
        if len(q) == 0 or len(r) == 0:
            return out.table()
        block, unit, part = (x.as_py() for x in key)
        key = (block, unit * _PARTS + part)
        tile = _Tile(_unpacked(r), masked)
        block = _Block(q, tile)
        for a, b, held, weights in block.steps():
            for method in methods:
                if (mode, method) == ("own", "maxsim"):
                    scores = _own_maxsim(block, tile, a, b)
                else:
                    scores = SCORERS[method](block, tile, a, b, held, weights)
                _emit(out, block, tile, method, mode, k, a, b, scores, key)
        return out.table()

    return score_tiles


def _bound_kernel(centres: np.ndarray, best_only: bool, masked: bool):
    """Function for one block and the summaries of some units: bounds on maxsim.

    Either the unit with the best bound of each query, or all that reach its ``floor``. Taking
    rows out lowers scores, except that a device without rows scores zero.
    """
    schema = pa.schema([("query", pa.string()), ("unit", pa.int64()), ("bound", pa.float64())])

    def bound_units(key, q: pa.Table, r: pa.Table) -> pa.Table:
        if len(q) == 0 or len(r) == 0:
            return schema.empty_table()
        r = r.sort_by("unit")
        unit = r["unit"].to_numpy()
        starts = _starts(unit)
        ball, low, high = (r[c].to_numpy() for c in ("ball", "low", "high"))
        block, out = _Block(q, None), []

        def best_of(units):
            best = np.empty((len(units), len(starts)))
            for at in range(0, len(units), STEP_ROWS):
                some = units[at : at + STEP_ROWS]
                bounds = balls.upper_bounds(
                    balls.angles(some, centres), ~some.any(axis=1), ball, low, high
                )
                best[at : at + STEP_ROWS] = np.maximum.reduceat(bounds, starts, axis=1)
            return best

        # Once for all queries of the block, where that fits.
        fits = 8 * len(block.units) * len(starts) <= BEST_BYTES
        every = best_of(block.units) if fits else None
        for a, b, held, weights in block.steps():
            total = weights @ (best_of(block.units[held]) if every is None else every[held])
            total /= block.total[a:b, None]
            if masked:
                total = np.maximum(total, 0.0)
            if best_only:
                row, column = np.arange(b - a), np.argmax(total, axis=1)
            else:
                floor = block.first["floor"].to_numpy(zero_copy_only=False)[a:b]
                row, column = np.nonzero(total >= floor[:, None] - SLACK)
            out.append(pa.table(
                [pa.array(block.names[a:b][row], pa.string()), pa.array(unit[starts][column]),
                 pa.array(total[row, column])], schema=schema,
            ))
        return pa.concat_tables(out)

    return bound_units


# ---------------------------------------------------------------- plans


def _merge(parts: DataFrame) -> DataFrame:
    """``(query, method, device, score, counted)`` from the rows of the kernel.

    maxsim: the best over the tiles of a device per query row, then the weighted
    mean over rows. Sums of vectors add up. A device without rows left scores 0.
    """
    keys = ["query", "method", "device"]
    best = parts.groupBy(*keys, "part").agg(
        F.max("best").alias("best"),
        F.max("weight").alias("weight"),
        F.max("acc").alias("acc"),
        F.max("counted").alias("counted"),
    )
    product = F.coalesce(F.col("best") * F.col("weight"), F.lit(0.0))
    added = F.coalesce("acc", F.array(product, F.col("weight")))
    merged = best.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector(added))).alias("acc"),
        F.max("counted").alias("counted"),
    )
    acc = F.col("acc")
    rest = F.slice(acc, F.lit(2), F.size(acc) - 1)
    length = F.sqrt(F.aggregate(rest, F.lit(0.0), lambda total, x: total + x * x))
    score = F.when(
        F.col("counted") | (F.col("method") == "maxsim"), ratio(acc[0], acc[1])
    ).otherwise(ratio(acc[0], length))
    total = F.col("device").isNull()
    return merged.select(*keys, F.when(total, acc[0]).otherwise(score).alias("score"), "counted")


def _merge_maxsim(parts: DataFrame) -> DataFrame:
    """``_merge`` where maxsim is the only method: plain sums, no vectors."""
    keys = ["query", "method", "device"]
    product = F.coalesce(F.col("best") * F.col("weight"), F.lit(0.0))
    merged = (
        parts.groupBy(*keys, "part")
        .agg(*[F.max(c).alias(c) for c in ("best", "weight", "counted")])
        .groupBy(*keys)
        .agg(
            F.sum(product).alias("total"),
            F.sum("weight").alias("weight"),
            F.max("counted").alias("counted"),
        )
    )
    total, weight = F.col("total"), F.col("weight")
    score = F.when(F.col("device").isNull(), total).otherwise(ratio(total, weight))
    return merged.select(*keys, score.alias("score"), "counted")


@dataclass(frozen=True)
class Pruning:
    """How much a search looked at: pairs of a query and a unit of references."""

    pairs: int
    opened: int


class DenseSearch:
    """Queries against references, both made ready once.

    ``queries (query, expected, row_id, embedding[, text, unseen])`` and
    ``references (device, row_id, embedding[, text])``. Texts marked unseen in a
    query are taken out of every device before that query is scored.
    """

    def __init__(
        self, queries: DataFrame, references: DataFrame,
        methods: Sequence[str] = ("maxsim",), tile_rows: int = TILE_ROWS,
        block_rows: int = BLOCK_ROWS, prune: bool = True,
    ):
        self.methods = list(methods)
        self.masked = "unseen" in queries.columns
        ship_package(queries.sparkSession)
        q = _with_columns(queries, text="string", unseen="boolean")
        r = _with_columns(references, text="string")
        if not self.masked:
            none = F.lit(None).cast("string")
            q, r = q.withColumn("text", none), r.withColumn("text", none)
        self.classes = "members" in references.columns
        q = _distinct_vectors(q, ["query", "expected", "text", "unseen", *FACTS["query"][: 2 * self.classes]])
        r = _distinct_vectors(r, ["device", "text", *FACTS["device"][: 3 * self.classes]])
        fitting = min(TILE_ROWS, max(1, TILE_BYTES // (8 * (r.dim or 1))))
        block_rows = min(block_rows, tile_rows)
        tile_rows = max(tile_rows, min(fitting, -(-r.count // MAX_TILES)))
        # Few distinct vectors fit into any tile, however many rows hold them.
        tile_rows = tile_rows if r.vectors <= fitting else min(tile_rows, fitting)
        dealt = -(-q.count // MAX_TILES)
        block_rows = max(min(block_rows, max(LEAST_BLOCK_ROWS, dealt)), min(fitting, dealt))
        block_rows = max(1, min(block_rows, tile_rows))
        # Each side travels once per part of the other, so parts are as large as a task bears.
        large = min(FEW_VECTORS_ROWS, -(-r.count // LEAST_TILES))
        if r.vectors <= fitting < large:
            tile_rows = max(tile_rows, large)
        if q.vectors <= fitting:
            block_rows = max(block_rows, min(FEW_VECTORS_ROWS, -(-q.count // MAX_TILES), tile_rows))
        # Only maxsim adds up over the rows of a query, and only if the query takes nothing
        # out of the references. Otherwise a query stays whole, however many rows it has.
        split = self.methods == ["maxsim"] and not self.masked
        self.tiles = _Placed(r, "device", tile_rows, True)
        # Queries lie together in blocks only where tiles can be closed for them.
        several = self.tiles.units > 1
        self.blocks = _Placed(q, "query", block_rows, split, self.tiles.centres if several else None)
        block = F.col("unit") * _PARTS + F.col("part")
        self.rows = self.blocks.rows.withColumn("block", block).drop("unit", "part")
        # One unit cannot be closed, and the bounds hold for maxsim.
        self.prune = prune and self.methods == ["maxsim"] and self.tiles.units > 1
        self.opened: list[DataFrame] = []

    @cached_property
    def held(self) -> DataFrame:
        """Rows and vectors of all tiles, packed."""
        held = _packed(self.tiles.with_vectors(self.tiles.rows, "unit", "part"))
        return stored(held) if self.tiles.units > 1 or self.blocks.units > 1 else held

    @cached_property
    def places(self) -> DataFrame:
        return stored(self.tiles.rows.select("unit", "part").distinct())

    def _everywhere(self, rows: DataFrame) -> DataFrame:
        last = F.lit(max(0, self.tiles.units - 1)).cast("long")
        units = F.explode(F.sequence(F.lit(0).cast("long"), last))
        return rows.select("query").distinct().withColumn("unit", units)

    @cached_property
    def _summary(self) -> tuple[int, DataFrame]:
        """The bounds' summaries in chunks of whole units, and their number."""
        summary = stored(self.tiles.summary())
        chunks = max(1, -(-summary.count() // SUMMARY_ROWS))
        return chunks, summary.withColumn(
            "chunk", F.pmod(F.xxhash64("unit"), F.lit(chunks)).cast("int")
        )

    def _bounds(self, floors: DataFrame | None) -> DataFrame:
        """``(query, unit)`` with the best bound, or those that reach the ``(query, floor)``."""
        # A query whose rows are spread over several blocks has no bound of its own.
        rows = self.rows.filter("whole")
        rows = rows if floors is None else rows.join(floors, "query")
        chunks, summary = self._summary
        asked = rows.select("block").distinct().withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
        )
        left = self.blocks.with_vectors(rows, "block").join(asked, "block")
        right = summary.join(asked.select("block", "chunk").toDF("block", "chunk"), "chunk")
        found = (
            left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
            .applyInArrow(_bound_kernel(self.tiles.centres, floors is None, self.masked), OPENED_SCHEMA)
        )
        if floors is None:
            best = Window.partitionBy("query").orderBy(F.col("bound").desc(), "unit")
            found = found.withColumn("place", F.row_number().over(best)).filter("place = 1")
        return found.select("query", "unit")

    def _score(self, rows: DataFrame, opened: DataFrame, mode: str, k: int = 0) -> DataFrame:
        """Every query against the units opened for it."""
        if self.tiles.units <= 1:
            meet = rows.withColumns({"unit": F.lit(0).cast("long"), "part": F.lit(0)})
        else:
            meet = rows.join(opened, "query").join(self.places, "unit")
        left = self.blocks.with_vectors(meet, "block", "unit", "part")
        # New column identities, as both sides come from one table.
        asked = meet.select("block", "unit", "part").distinct().toDF("block", "unit", "part")
        right = (
            self.held.join(asked, ["unit", "part"]) if self.blocks.units > 1 or self.tiles.units > 1
            # One block at most: its place is that of any of its rows.
            else self.held.withColumn("block", F.lit(0).cast("long"))
        )
        merge = _merge_maxsim if self.methods == ["maxsim"] else _merge
        key = ["block", "unit", "part"]
        # More tasks than pairs of a block and a unit, while those are few, so that few share one.
        tasks = max(1, min(2 * self.blocks.units * self.tiles.units, MAX_TASKS))
        return merge(
            left.repartition(tasks, *key).groupBy(*key)
            .cogroup(right.repartition(tasks, *key).groupBy(*key))
            .applyInArrow(_kernel(mode, self.methods, k, self.masked), PARTS_SCHEMA)
        )

    def _open(self, pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs) if self.prune else pairs
        self.opened.append(pairs)
        return pairs

    def _several(self) -> list[DenseSearch]:
        """One search per method where tiles can be closed for one and not for another."""
        if len(self.methods) == 1 or self.tiles.units <= 1:
            return []
        found = []
        for method in self.methods:
            one = copy.copy(self)
            one.methods, one.opened, one.prune = [method], [], method == "maxsim"
            found.append(one)
        return found

    def topk(self, k: int = 5) -> DataFrame:
        """``(query, method, device, score, rank)`` for the k best devices per query."""
        def ranked(scored):
            return top_k(scored, ["query", "method"], k, order_score(F.col("score")))

        self.opened = []
        if self._several():
            found = [one.topk(k) for one in self._several()]
            return reduce(DataFrame.unionByName, found)
        if not self.prune:
            opened = self._open(self._everywhere(self.rows))
            return ranked(self._score(self.rows, opened, "top", k).drop("counted"))
        first = self._open(
            self._bounds(None).unionByName(self._everywhere(self.rows.filter("not whole")))
        )
        near = stored(ranked(self._score(self.rows, first, "top", k).drop("counted")))
        kth = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
        floors = self.rows.select("query").distinct().join(kth, "query", "left").select(
            "query", F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).alias("floor")
        )
        rest = self._open(self._bounds(floors).join(first, ["query", "unit"], "left_anti"))
        far = self._score(self.rows, rest, "top", k).drop("counted")
        return ranked(near.drop("rank").unionByName(far))

    def own(self) -> DataFrame:
        """``(query, own_<method>...)``: score of each query's expected device.

        Queries meet only the tiles that hold their expected device.
        """
        homes = self.tiles.rows.select(F.col("device").alias("expected"), "unit").distinct()
        asked = self.rows.select("query", "expected").distinct().join(homes, "expected")
        scores = self._score(self.rows, asked.select("query", "unit"), "own")
        return scores.groupBy("query").agg(
            *[
                F.max(F.when(F.col("method") == m, F.col("score"))).alias("own_" + m)
                for m in self.methods
            ]
        )

    def ranks(self) -> DataFrame:
        """``(query, expected, method, score, rank)`` of the expected device, from 1.

        First the score of the expected device, then the number of devices ahead of it.
        Score and rank are NULL for an unknown device.
        """
        self.opened = []
        self.parted = self._several()
        if self.parted:
            return reduce(DataFrame.unionByName, [one.ranks() for one in self.parted])
        own = stored(self.own())
        rows = self.rows.join(own, "query")  # those with an unknown device have no rank
        if self.prune:
            floors = own.select("query", F.col("own_maxsim").alias("floor"))
            spread = self._everywhere(rows.filter("not whole"))
            opened = self._open(self._bounds(floors).unionByName(spread))
        else:
            opened = self._open(self._everywhere(rows))
        parts = self._score(rows, opened, "ahead")
        stacked = ", ".join(f"'{m}', own_{m}" for m in self.methods)
        expected = (
            self.rows.select("query", "expected").distinct().join(own, "query", "left")
            .selectExpr("query", "expected", f"stack({len(self.methods)}, {stacked}) as (method, own)")
        )
        score, own = order_score(F.col("score")), order_score(F.col("own"))
        met = parts.join(expected.select("query", "method", "expected", "own"), ["query", "method"])
        better, each = is_ahead(score, F.col("device"), own, F.col("expected")), F.lit(1.0)
        if self.classes:
            facts = (self.tiles.rows.select("device", *FACTS["device"]),
                     self.rows.select("query", *FACTS["query"]))
            met = stored(
                met.join(facts[0].distinct(), "device", "left").join(facts[1].distinct(), "query")
            )
            below = F.col("high") < F.col("first")
            better, each = (score > own) | ((score == own) & below), F.col("members").cast("double")
            #: Classes that tie with a query, whose names are to be counted.
            self.tied = met.filter((score == own) & ~below & F.expr("low < last")).select(
                "query", "method", "device"
            )
        ahead = (
            F.when(F.col("device").isNull(), F.col("score"))
            .when(better, each)
            .otherwise(F.lit(0.0))
        )
        counts = (
            met.groupBy("query", "method")
            .agg(F.sum(ahead).alias("ahead"))
        )
        rank = (F.coalesce("ahead", F.lit(0.0)) + 1).cast("long")
        return expected.join(counts, ["query", "method"], "left").select(
            "query",
            "expected",
            "method",
            F.col("own").alias("score"),
            F.when(F.col("own").isNotNull(), rank).alias("rank"),
        )

    def pruning(self) -> Pruning:
        """Pairs of queries and units in all, and those that were compared, in the last search."""
        queries = self.rows.select("query").distinct().count()
        return Pruning(queries * self.tiles.units, sum(df.count() for df in self.opened))


def dense_topk(
    queries: DataFrame,
    references: DataFrame,
    methods: Sequence[str] = ("maxsim",),
    k: int = 5,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(query, method, device, score, rank)`` for the k best devices per query.

    Queries with the same vectors have the same list, and the first k names of references with
    the same vectors stand for them.
    """
    if "unseen" in queries.columns:
        return DenseSearch(queries, references, methods, tile_rows).topk(k)
    asked = _classed(queries, "query")
    names = Window.partitionBy("class").orderBy("device")
    kept = _classed(references, "device").withColumn("place", F.row_number().over(names))
    kept = kept.filter(F.col("place") <= k).select("device")
    found = DenseSearch(
        _of_classes(queries, asked, "query").drop("expected").withColumn(
            "expected", F.lit(None).cast("string")
        ),
        references.join(kept, "device"), methods, tile_rows,
    ).topk(k)
    return asked.join(found.withColumnRenamed("query", "class"), "class").select(
        "query", "method", "device", "score", "rank"
    )


def dense_ranks(
    queries: DataFrame,
    references: DataFrame,
    methods: Sequence[str] = ("maxsim",),
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(query, expected, method, score, rank)`` of the expected device, from 1.

    Queries with the same vectors that expect the same class of references share all but the
    place of the expected name among the names of classes that tie.
    """
    if "unseen" in queries.columns:
        return DenseSearch(queries, references, methods, tile_rows).ranks()
    asked, known = _classed(queries, "query", "expected"), _classed(references, "device")
    devices = stored(known.join(name_positions(known, "device"), "device"))
    own = asked.join(
        devices.toDF("expected", "own_class", "place"), "expected", "left"
    ).withColumn("unit", F.concat("class", F.lit("|"), "own_class"))
    own = stored(own)
    units = own.filter("unit is not null").groupBy("class", "own_class", "unit").agg(
        F.min("place").alias("first"), F.max("place").alias("last")
    )
    facts = devices.groupBy("class").agg(
        F.count(F.lit(1)).alias("members"), F.min("position").alias("low"),
        F.max("position").alias("high"),
    )
    q = _of_classes(queries.drop("expected"), asked, "query").withColumnRenamed("query", "class")
    q = q.join(units, "class").drop("class").withColumnsRenamed(
        {"unit": "query", "own_class": "expected"}
    )
    r = _of_classes(references, known, "device").withColumnRenamed("device", "class")
    r = r.join(facts, "class").withColumnRenamed("class", "device")
    search = DenseSearch(q, r, methods, tile_rows)
    ranks = search.ranks().select(
        F.col("query").alias("unit"), "method", "score", F.col("rank").alias("whole")
    )
    tied = [search.tied] if hasattr(search, "tied") else [one.tied for one in search.parted]
    unit = F.concat("method", F.lit("|"), "query").alias("query")
    tied = reduce(DataFrame.unionByName, tied).select(
        unit, "device", F.lit(1).cast("long").alias("sign")
    )
    every = F.explode(F.array(*[F.lit(m) for m in search.methods])).alias("method")
    places, _ = value_blocks(
        own.filter("unit is not null").select(F.col("unit").alias("query"), "place", every)
        .select(unit, "place").distinct(), ["query"], "place", "places",
    )
    blocks, _ = value_blocks(
        devices.select(F.col("class").alias("device"), "position"), ["device"], "position",
        "positions",
    )
    before = names_before(tied, places, blocks).groupBy(
        F.substring_index("query", "|", 1).alias("method"), F.col("query").alias("named"), "place"
    ).agg(F.sum("ahead").alias("before"))
    out = own.select("query", "expected", "unit", "place", every).join(
        ranks, ["unit", "method"], "left"
    ).withColumn("named", F.concat("method", F.lit("|"), "unit"))
    return out.join(before, ["named", "method", "place"], "left").select(
        "query", "expected", "method", "score",
        (F.col("whole") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"),
    )


def _classed(bank: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, class)``: labels with the same vectors, each as often, share a class.

    A class is told from others by its rows and sums of two hashes of 64 bits, and has a short
    name, as it comes with every row.
    """
    marks = [
        F.sum(h.cast("decimal(20,0)")).cast("string")
        for h in (F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding"))
    ]
    held = F.concat_ws("/", F.count(F.lit(1)).cast("string"), *marks)
    labels = stored(bank.groupBy(*keys).agg(held.alias("held")))
    number = F.conv(F.monotonically_increasing_id().cast("string"), 10, 36)
    names = stored(labels.select("held").distinct().withColumn("class", number))
    return stored(labels.join(names, "held").drop("held"))


def _of_classes(bank: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """The rows of one label of each class, under the name of the class."""
    first = classes.groupBy("class").agg(F.min(key).alias(key))
    return bank.join(first, key).drop(key).withColumnRenamed("class", key)


def pooled(queries: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both banks reduced to one unit mean vector per label.

    One vector on each side makes maxsim the cosine of the two means. The means are written: their
    last bits follow the order in which the parts of a group arrive, so a second run of the
    aggregate would give other vectors, and a search reads its banks several times.
    """
    q = mean_vectors(queries, "query", "expected").withColumn("row_id", F.lit(0).cast("long"))
    r = mean_vectors(references, "device").withColumn("row_id", F.lit(0).cast("long"))
    return stored(q), stored(r)
