"""Exact ranked search over documents by blocked posting lists.

A document is the vector of its terms' impacts, a query the vector of its terms' weights, and a
score their inner product, all in integers. Documents are indexed in shards, and each shard
holds, per term, the posting list cut into blocks of similar documents: every document goes to
the most similar of evenly picked representatives of the list. A block stores the greatest
impact of its documents for every term that is asked together with the list's term. Weights
times these summaries bound the score of all documents in the block, so a block is skipped if
its bound lies below the k-th best score known, and only then. Documents of open blocks are
scored in full.

The first thresholds are the k-th best sums over the rarest terms of a query. The terms of a
query that cannot reach its threshold together need no lists: a document without any other term
is none of the best.

Only the terms of the queries are indexed. Queries are taken in sets of a bounded number of
terms, one set after the other, each against all documents; a shard has as many rows as its
terms allow, so no task holds more than ``CELLS`` impacts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spoor.llm.common import Scratch, over_batches
from spoor.session import ship_package

#: Documents per query.
K = 20
#: Distinct terms of the queries of one set; a longer query has a set of its own.
TERMS = 65_536
#: Impacts of one shard, and its documents at most.
CELLS = 4 << 20
SHARD = 1024
#: Documents that a block should hold.
BLOCK = 8
#: Postings that the first thresholds may read per query, if its rarest term has not more.
SEED_POSTINGS = 8192
#: Dimensions in which documents of a list are compared.
SKETCH = 32

#: Rows of the index are large: small row groups, so that a reader holds few of them at once.
_ROW_GROUPS = {
    "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
}
#: Columns of the index that hold 32-bit numbers as bytes; the summaries, mostly zeros, packed.
_NUMBERS = ("starts", "terms", "impacts", "lists", "blocks", "sizes", "members", "peaks")

_SPACE = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes.maketrans(
    bytes([*_SPACE, *range(0x41, 0x5B)]), b" " * len(_SPACE) + bytes(range(0x61, 0x7B))
)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf, length, n: int, total: int):
    """``tf`` and ``length`` as integers or arrays of them."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * length * n) // total))


# ---------------------------------------------------------------- queries


def _query_sets(queries: DataFrame, scratch: Scratch) -> tuple[DataFrame, list]:
    """Queries as ``query, set, terms, counts`` and the ids of the sets."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Counter(terms_of(x)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([list(x) for x in found], pa.list_(pa.binary())),
             pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))],
            names=["query", "terms", "counts"],
        )

    read = over_batches(
        queries.select("query", "text"), work,
        "query long, terms array<binary>, counts array<long>",
    ).filter("size(terms) > 0")
    read = scratch.put(read)
    total = read.agg(F.sum(F.size("terms"))).first()[0] or 0
    placed = scratch.put(
        read.repartition(max(1, -(-total // TERMS))).withColumn("part", F.spark_partition_id())
    )
    # A running sum per part: a set holds at most TERMS beside its last query.
    running = Window.partitionBy("part").orderBy("query")
    cut = F.floor((F.sum(F.size("terms")).over(running) - F.size("terms")) / TERMS)
    sets = scratch.put(
        placed.withColumn("set", F.struct("part", cut.alias("number"))).drop("part")
    )
    return sets, sorted((tuple(r[0]) for r in sets.select("set").distinct().collect()))


class _Queries:
    """The queries of one set: terms as numbers, and which lists each of them needs."""

    def __init__(self, rows: list):
        self.ids = [row["query"] for row in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.counts = [], []
        for row in rows:
            number = [
                self.vocabulary.setdefault(bytes(t), len(self.vocabulary)) for t in row["terms"]
            ]
            self.terms.append(np.array(number, np.int64))
            self.counts.append(np.array(row["counts"], np.int64))

    def weigh(self, n: int, total: int, df: dict[int, int], peak: dict[int, int]) -> None:
        """Terms that a document holds, with their weights; terms of weight zero add nothing."""
        self.n, self.total, self.df, self.peak = n, total, df, peak
        self.weights = []
        for q, terms in enumerate(self.terms):
            each = np.array([weight(n, df[t]) if t in df else 0 for t in terms.tolist()], np.int64)
            self.terms[q] = terms[each > 0]
            self.weights.append((each * self.counts[q])[each > 0])
        self.floor = np.zeros(len(self.ids), np.int64)

    def seeds(self) -> list[tuple[int, int, int]]:
        """``(query, term, weight)`` of the rarest terms of each query."""
        out = []
        for q, terms in enumerate(self.terms):
            read = 0
            for at in sorted(range(len(terms)), key=lambda i: self.df[int(terms[i])]):
                read += self.df[int(terms[at])]
                if read > SEED_POSTINGS and read > self.df[int(terms[at])]:
                    break
                out.append((q, int(terms[at]), int(self.weights[q][at])))
        return out

    def choose_lists(self) -> None:
        """Lists that can lift a document to the floor of a query, with the terms asked there."""
        asked: dict[int, list[int]] = {}
        for q, terms in enumerate(self.terms):
            most = [int(w) * self.peak[int(t)] for t, w in zip(terms, self.weights[q])]
            reach = 0
            for at in sorted(range(len(terms)), key=most.__getitem__):
                reach += most[at]
                if reach >= max(1, self.floor[q]):
                    asked.setdefault(int(terms[at]), []).append(q)
        self.lists = {}
        for term, askers in asked.items():
            coordinates = np.unique(np.concatenate([self.terms[q] for q in askers]))
            weights = np.zeros((len(coordinates), len(askers)), np.int64)
            for column, q in enumerate(askers):
                weights[np.searchsorted(coordinates, self.terms[q]), column] = self.weights[q]
            self.lists[term] = (np.array(askers), coordinates, weights)


# ---------------------------------------------------------------- index


def _forward(docs: DataFrame, queries: _Queries) -> DataFrame:
    """``doc, length, terms, counts`` of the documents with terms; terms of the queries only."""
    number = queries.vocabulary.get

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ends, terms, counts, texts = [], [0], [], [], batch.column(1)
        for i in range(batch.num_rows):
            words = terms_of(texts[i].as_py())
            found = Counter(map(number, words))
            found.pop(None, None)
            lengths.append(len(words))
            terms.extend(found)
            counts.extend(found.values())
            ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int64()),
             pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
             pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
            names=["doc", "length", "terms", "counts"],
        )

    kind = docs.schema["doc"].dataType.simpleString()
    return over_batches(
        docs.select("doc", "text"), work,
        f"doc {kind}, length long, terms array<int>, counts array<long>",
    ).filter("length > 0")


def _postings(forward: DataFrame, n: int, total: int) -> DataFrame:
    """``row, term, impact``."""
    # Numbered before, not beside the explosion, which would number postings.
    numbered = forward.withColumn("row", F.monotonically_increasing_id())
    flat = numbered.select("row", "length", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return flat.selectExpr(
        "row", "x.terms as term",
        f"(1000000000 * x.counts) div (1000 * x.counts + 12 * (75 + (25 * length * {n}) div {total}))"
        " as impact",
    )


def _first_floors(forward: DataFrame, queries: _Queries, k: int) -> None:
    """The k-th best sum over the rarest terms; no document's score is below its sum."""
    spark = forward.sparkSession
    seeds = spark.createDataFrame(queries.seeds(), "query int, term int, weight long")
    sums = (
        _postings(forward, queries.n, queries.total)
        .join(F.broadcast(seeds), "term")  # at most the terms of one set
        .groupBy("query", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    )
    best = Window.partitionBy("query").orderBy(F.col("score").desc())
    kth = sums.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    for row in kth.filter(F.col("place") == k).collect():
        queries.floor[row["query"]] = row["score"]


def _dense(rows: int, width: int, row: np.ndarray, terms: np.ndarray, values: np.ndarray):
    dense = np.zeros((rows, width), np.int32)
    dense[row, terms] = values
    return dense


def _blocks(members: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a list in order of their blocks, and where each block starts."""
    if len(members) <= BLOCK:
        return members, np.zeros(1, np.int64)
    leaders = sketch[members[::BLOCK]]
    nearest = np.argmax(sketch[members] @ leaders.T, axis=1)
    order = np.argsort(nearest, kind="stable")
    nearest = nearest[order]
    return members[order], np.flatnonzero(np.r_[True, nearest[1:] != nearest[:-1]])


def _rows_of_shard(queries: _Queries) -> int:
    return max(1, min(SHARD, CELLS // max(1, len(queries.vocabulary))))


def make_shard(queries: _Queries, kind: pa.DataType):
    """Function from documents ``doc, length, terms, counts`` to one row: the index of a shard.

    The row holds the impacts of the documents and the blocks of all lists; ``peaks`` is, per
    block, the greatest impact for each term asked together with the list's.
    """
    width = len(queries.vocabulary)
    signs = np.random.default_rng(11).choice(
        np.array([-1, 1], np.float32), size=(width, SKETCH)
    )
    worth = np.zeros(width, np.float32)
    for term, df in queries.df.items():
        worth[term] = weight(queries.n, df)
    n, total, lists = queries.n, queries.total, queries.lists
    schema = pa.schema([("docs", pa.list_(kind)), *((name, pa.binary()) for name in _NUMBERS)])

    def shard(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        listed = rows["terms"].combine_chunks()
        starts = listed.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        terms = listed.flatten().to_numpy().astype(np.int64)
        counts = rows["counts"].combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(rows)), np.diff(starts))
        values = impacts(counts, rows["length"].to_numpy()[row], n, total)
        dense = _dense(len(rows), width, row, terms, values)
        sketch = (dense * worth) @ signs
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        by_term = np.lexsort((row, terms))
        held, first = np.unique(terms[by_term], return_index=True)
        last = np.r_[first[1:], len(terms)]
        out = {name: [] for name in ("lists", "blocks", "sizes", "members", "peaks")}
        for term, a, b in zip(held.tolist(), first.tolist(), last.tolist()):
            if term not in lists:
                continue
            members, cuts = _blocks(row[by_term[a:b]], sketch)
            peaks = np.maximum.reduceat(dense[np.ix_(members, lists[term][1])], cuts, axis=0)
            out["lists"].append(term)
            out["blocks"].append(len(cuts))
            out["sizes"].append(np.diff(np.r_[cuts, len(members)]))
            out["members"].append(members)
            out["peaks"].append(peaks.ravel())
        flat = [starts, terms, values, out["lists"], out["blocks"]]
        flat += [np.concatenate(out[c]) if out[c] else [] for c in ("sizes", "members", "peaks")]
        packed = [np.asarray(numbers, np.int32).tobytes() for numbers in flat]
        packed[-1] = zlib.compress(packed[-1], 1)
        docs = rows["doc"].combine_chunks()
        columns = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)]
        columns += [pa.array([one], pa.binary()) for one in packed]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return shard


def _index(forward: DataFrame, queries: _Queries) -> DataFrame:
    """One row per shard of documents, see ``make_shard``."""
    kind = forward.schema["doc"].dataType
    rows, shard = _rows_of_shard(queries), make_shard(queries, to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            waiting = now if waiting is None else pa.concat_tables([waiting, now])
            while len(waiting) >= rows:
                yield shard(waiting.slice(0, rows))
                waiting = waiting.slice(rows)
        if waiting is not None and len(waiting):
            yield shard(waiting)

    ship_package(forward.sparkSession)
    return forward.mapInArrow(
        run,
        f"docs array<{kind.simpleString()}>, "
        + ", ".join(f"{name} binary" for name in _NUMBERS),
    )


# ---------------------------------------------------------------- search


class _Best:
    """The k best documents of each query so far, and the floor that follows."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, np.maximum(floor, 1)
        self.rows: list[list] = [[] for _ in floor]

    def add(self, q: int, docs: list, scores: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.floor[q])
        if not len(good):
            return
        if len(good) > self.k:  # ties with the k-th stay until the ids decide
            kth = np.partition(scores[good], len(good) - self.k)[len(good) - self.k]
            good = good[scores[good] >= kth]
        rows = self.rows[q] + [
            (-int(scores[i]), docs[i] is None, docs[i]) for i in good.tolist()
        ]
        # A null id comes last and is never compared with others.
        rows.sort(key=lambda x: x if x[2] is not None else x[:2])
        self.rows[q] = rows[: self.k]
        if len(rows) >= self.k:
            self.floor[q] = max(self.floor[q], -rows[self.k - 1][0])


def unpack(batch: pa.RecordBatch, i: int) -> dict:
    """A row of the index as arrays of numbers."""
    row = {name: batch.column(name)[i].as_py() for name in ("docs", *_NUMBERS)}
    row["peaks"] = zlib.decompress(row["peaks"])
    return row | {name: np.frombuffer(row[name], np.int32) for name in _NUMBERS}


class Opened:
    """What a search looked at; for tests and reports."""

    def __init__(self):
        self.blocks = self.open = self.scored = 0


def search_shard(row: dict, queries: _Queries, best: _Best, seen: Opened) -> None:
    """Open the blocks of one shard whose bound reaches the floor, and score their documents."""
    docs = row["docs"]
    place = np.repeat(np.arange(len(docs)), np.diff(row["starts"]))
    dense = _dense(len(docs), len(queries.vocabulary), place, row["terms"], row["impacts"])
    wanted = np.zeros((len(queries.ids), len(docs)), bool)
    sizes, members, peaks = row["sizes"], row["members"], row["peaks"]
    at = block = doc = 0
    for term, blocks in zip(row["lists"].tolist(), row["blocks"].tolist()):
        askers, coordinates, weights = queries.lists[term]
        n = blocks * len(coordinates)
        bounds = peaks[at : at + n].reshape(blocks, -1).astype(np.int64) @ weights
        size = sizes[block : block + blocks]
        held = members[doc : doc + size.sum()]
        open_ = bounds >= best.floor[askers]
        for column in np.flatnonzero(open_.any(axis=0)):
            wanted[askers[column], held[np.repeat(open_[:, column], size)]] = True
        seen.blocks += open_.size
        seen.open += int(open_.sum())
        at, block, doc = at + n, block + blocks, doc + len(held)
    for q in np.flatnonzero(wanted.any(axis=1)).tolist():
        rows = np.flatnonzero(wanted[q])
        seen.scored += len(rows)
        scores = dense[np.ix_(rows, queries.terms[q])].astype(np.int64) @ queries.weights[q]
        best.add(q, [docs[i] for i in rows.tolist()], scores)


def _search(index: DataFrame, queries: _Queries, k: int) -> DataFrame:
    """``query, doc, score``: the k best of each task's shards."""
    kind = index.schema["docs"].dataType.elementType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = _Best(queries.floor, k), Opened()
        for batch in batches:
            for i in range(batch.num_rows):
                search_shard(unpack(batch, i), queries, best, seen)
        found = [(queries.ids[q], x[2], -x[0]) for q, rows in enumerate(best.rows) for x in rows]
        query, doc, score = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(doc, arrow_kind), pa.array(score, pa.int64())],
            names=["query", "doc", "score"],
        )

    ship_package(index.sparkSession)
    return index.mapInArrow(run, f"query long, doc {kind.simpleString()}, score long")


def _search_set(docs: DataFrame, queries: _Queries, k: int, scratch: Scratch) -> DataFrame | None:
    forward = scratch.put(_forward(docs, queries))
    n, total = forward.agg(F.count(F.lit(1)), F.sum("length")).first()
    if not n:
        return None
    # At most one row per term of the set.
    stats = _postings(forward, n, total).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max("impact").alias("peak")
    ).collect()
    queries.weigh(
        n, total, {r["term"]: r["df"] for r in stats}, {r["term"]: r["peak"] for r in stats}
    )
    _first_floors(forward, queries, k)
    queries.choose_lists()
    index = scratch.put(_index(forward, queries), **_ROW_GROUPS)
    scratch.drop(forward)
    found = scratch.put(_search(index, queries, k))
    scratch.drop(index)
    return found


def search(
    docs: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", text: str = "text",
    query_key: str = "item_id", query_text: str = "text",
) -> DataFrame:
    """``query_key, rank, key, score``: the k best documents of every query, best first.

    Equal scores rank by key, null keys last. Documents with score zero are not returned, so a
    query without terms, or none that a document holds, gives no rows. Null texts have no terms.
    Repeated rows on either side are rows of their own; an empty table gives no rows. Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    asked = scratch.put(queries.select(
        F.col(query_key).alias("id"), F.col(query_text).alias("text"),
        F.monotonically_increasing_id().alias("query"),
    ))
    sets, names = _query_sets(asked, scratch)
    none = read.limit(0).selectExpr("cast(0 as long) as query", "doc", "cast(0 as long) as score")
    found = none
    for part, number in names:
        # The rows of one set: a bounded number of terms.
        chosen = sets.filter((F.col("set.part") == part) & (F.col("set.number") == number))
        rows = chosen.orderBy("query").collect()
        part_found = _search_set(read, _Queries(rows), k, scratch)
        found = found if part_found is None else found.unionByName(part_found)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "id"), "query").select(
        F.col("id").alias(query_key), "rank", F.col("doc").alias(key), "score"
    )
