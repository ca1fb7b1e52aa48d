"""Passages that an earlier document has, by a logarithmic family of sampled suffix arrays.

Which suffixes are sampled depends on nearby text alone: each window of ``WINDOW`` bytes is named
by the first place of the least hash among its ``GRAM``-byte substrings, its anchor. Equal windows
have their anchor at the same place, so two documents share a window exactly where the texts
around two of their anchors agree for ``WINDOW`` bytes. Neighbouring windows with the same anchor
form a block, on average 17 windows in 66 bytes.

1. All anchors are dealt by hash, pre-aggregated per piece of text: a block that an earlier
   document has whole repeats (compared by 128 bits: hash of the anchor and XXH64 of the block),
   and an anchor whose bytes stand in no second block is dropped.
2. What is left comes in batches by id, each twice as long as the one before. A batch's array has
   its sampled suffixes in the order of their bytes, within cells by hash of the anchor. It is
   merge-scanned against the arrays of earlier batches: in the merged order, the lengths of common
   prefixes of neighbours, forwards and backwards from the anchor, say which windows are equal byte
   by byte. Then arrays of equal rank are merged, so their number is logarithmic.
3. Anchors with more than ``KEY_BLOCKS`` different blocks are spread by window instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import Scratch, over_batches
from spoor.session import ship_package

WINDOW, GRAM = 50, 16
#: Places of an anchor in a window.
PLACES = WINDOW - GRAM + 1
#: Sampled suffixes in the first batch; each later batch doubles what there is.
UNIT = 1_000_000
#: Blocks of an anchor whose suffixes are sorted in one task; anchors with more are spread.
KEY_BLOCKS = 10_000
#: Anchors dealt to one cell, sampled suffixes of a cell of an array, and anchors in a piece.
CELL_ANCHORS, CELL_SUFFIXES, PIECE = 400_000, 50_000, 1 << 18
#: Bytes of a text whose blocks are worked out at a time.
CHUNK = 1 << 22
#: A null id counts as larger than any other.
LAST = (1 << 63) - 1

#: Shuffle files go once a query has written its table.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Columns of packed anchors and of packed marks, one after the other in a binary value.
ANCHORS = ("u8", "u8", "i8", "i8", "i4", "i1", "i1")
MARKS = ("i8", "i8", "i4", "i4")
_MARK = "doc long, tag long, at int, n int"
_FOUND = f"{_MARK}, key long, off int, kind int"
#: Kinds of what the cells find: whole blocks that repeat, suffixes to sort, windows to spread.
WHOLE, SORTED, SPREAD = 0, 1, 2


def _hashes(data: bytes) -> np.ndarray:
    """A hash of each substring of ``GRAM`` bytes."""
    padded = data + bytes(16)
    words = np.empty(len(data), np.uint64)
    for shift in range(8):
        at = np.frombuffer(padded, "<u8", (len(padded) - shift) // 8, shift)
        words[shift::8] = at[: len(words[shift::8])]
    n = len(data) - GRAM + 1
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def blocks_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first windows, numbers of windows of the blocks of a text, and how many bytes of
    the first window stand before the anchor."""
    windows = len(data) - WINDOW + 1
    if windows <= 0:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    keys, firsts, offs = [], [], []
    for start in range(0, windows, CHUNK):
        part = data[start : min(len(data), start + CHUNK + WINDOW - 1)]
        hashes = _hashes(part)
        least = _least(hashes, PLACES)
        # The anchor of a window is the first place of its least hash. It moves on where that
        # hash changes, or where the window leaves its first place and finds it again later.
        moves = (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])
        change = np.flatnonzero(np.concatenate([[True], moves]))
        key = least[change]
        off = np.zeros(len(change), np.int64)
        todo = np.arange(len(change))
        for step in range(PLACES):
            off[todo] = step
            todo = todo[hashes[change[todo] + step] != key[todo]]
        keys.append(key)
        firsts.append(change + start)
        offs.append(off)
    key, first, off = (np.concatenate(c) for c in (keys, firsts, offs))
    return key, first, np.diff(np.concatenate([first, [windows]])), off


def _pack(columns, kinds: tuple[str, ...]) -> bytes:
    return b"".join(c.astype(f"<{k}", copy=False).tobytes() for c, k in zip(columns, kinds))


def _unpack(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    parts = [[np.empty(0, f"<{k}")] for k in kinds]
    sizes = [np.dtype(k).itemsize for k in kinds]
    for blob in blobs:
        at, n = 0, len(blob) // sum(sizes)
        for part, kind, size in zip(parts, kinds, sizes):
            part.append(np.frombuffer(blob, f"<{kind}", n, at))
            at += n * size
    return [np.concatenate(part) for part in parts]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _anchors(docs: DataFrame, cells: int) -> DataFrame:
    """``cell, anchors, marks``: the packed anchors of pieces of text, by cell.

    ``docs`` has ``doc, tag, body``. Of a block that several documents of a piece hold, only that
    of the first goes to a cell, the others are marked here; so a block that very many documents
    hold reaches its cell once per piece.
    """

    def piece(parts: list[tuple]) -> list[tuple[int, bytes, bytes]]:
        key, digest, doc, tag, at, n, off = (np.concatenate(c) for c in zip(*parts))
        # Documents come in order of id, and the sort is stable.
        order = np.argsort(key ^ digest * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        new = _starts(key[order], digest[order])
        copies = doc[order] > doc[order][new][np.cumsum(new) - 1]
        # Blocks that follow each other in a text are one mark.
        gone = np.sort(order[copies])
        d, t, a, m = doc[gone], tag[gone], at[gone], n[gone].astype(np.int64)
        out = []
        if len(gone):
            first = _starts(d, t)
            first[1:] |= a[1:] != a[:-1] + m[:-1]
            begin = np.flatnonzero(first)
            marks = (d[begin], t[begin], a[begin], np.add.reduceat(m, begin))
            out.append((int(key[0] % np.uint64(cells)), b"", _pack(marks, MARKS)))
        sent = order[~copies]
        mixed = key[sent] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
        cell = (mixed % np.uint64(cells)).astype(np.int64)
        turn = np.argsort(cell, kind="stable")
        sent, cell = sent[turn], cell[turn]
        columns = [c[sent] for c in (key, digest, doc, tag, at, n, off)]
        edges = [*np.flatnonzero(_starts(cell)).tolist(), len(cell)]
        for a, b in zip(edges, edges[1:]):
            out.append((int(cell[a]), _pack([c[a:b] for c in columns], ANCHORS), b""))
        return out

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        cells_of, anchors, marks = zip(*piece(parts))
        return pa.record_batch(
            [pa.array(cells_of, pa.int64()), pa.array(anchors, pa.binary()),
             pa.array(marks, pa.binary())], ["cell", "anchors", "marks"],
        )

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs, tags, bodies = batch.columns
        docs, tags = docs.to_numpy(), tags.to_numpy()
        parts, size = [], 0
        hashed = xxhash.xxh64_intdigest
        for row in np.argsort(docs, kind="stable").tolist():
            data = bodies[row].as_py()
            key, first, n, off = blocks_of(data)
            if not len(key):
                continue
            view = memoryview(data)
            ends = first + n + WINDOW - 1
            digest = np.fromiter(
                (hashed(view[a:b]) for a, b in zip(first.tolist(), ends.tolist())),
                np.uint64, len(key),
            )
            parts.append((
                key, digest, np.full(len(key), docs[row], np.int64),
                np.full(len(key), tags[row], np.int64), first.astype(np.int32),
                n.astype(np.int8), off.astype(np.int8),
            ))
            size += len(key)
            if size >= PIECE:
                yield packed(parts)
                parts, size = [], 0
        if parts:
            yield packed(parts)

    ship_package(docs.sparkSession)
    return docs.mapInArrow(
        lambda batches: (out for batch in batches for out in work(batch)),
        "cell long, anchors binary, marks binary",
    )


def judge(cell: pa.Table) -> pa.Table:
    """What the anchors of a cell say: rows of ``_FOUND``."""
    doc, tag, at, n = _unpack(cell["marks"].to_pylist(), MARKS)
    marked = [doc, tag, at, n, np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int32)]
    columns = _unpack(cell["anchors"].to_pylist(), ANCHORS)
    # Most anchors stand alone and go first.
    order = np.argsort(columns[0], kind="stable")
    new = _starts(columns[0][order])
    sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
    keep = order[np.repeat(sizes > 1, sizes)] if len(order) else order
    columns = [c[keep] for c in columns]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    key, digest, doc, tag, at, n, off = (c[order] for c in columns)
    kind = np.full(len(key), -1, np.int32)
    if len(key):
        block = _starts(key, digest)
        whole = doc > doc[block][np.cumsum(block) - 1]
        new = _starts(key)
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        low = np.minimum.reduceat(doc, begin)
        high = np.maximum.reduceat(np.where(whole, low[group], doc), begin)
        several = (np.add.reduceat(block.astype(np.int64), begin) > 1) & (low < high)
        met = ~whole & several[group]
        crowded = np.add.reduceat(met.astype(np.int64), begin) > KEY_BLOCKS
        kind[whole] = WHOLE
        kind[met] = np.where(crowded[group[met]], SPREAD, SORTED)
    sent = kind >= 0
    found = [c[sent] for c in (doc, tag, at, n, key.view(np.int64), off)]
    both = [np.concatenate(c) for c in zip(marked, found)]
    kinds = np.concatenate([np.full(len(marked[0]), WHOLE, np.int32), kind[sent]])
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    return pa.table(
        [pa.array(c.astype(t.to_pandas_dtype(), copy=False), t)
         for c, t in zip([*both, kinds], types)],
        ["doc", "tag", "at", "n", "key", "off", "kind"],
    )


def _suffixes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The found anchors with the text of their block: ``before`` the anchor, and the ``suffix``
    from it on."""
    wanted = found.filter(F.col("kind") != WHOLE).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("key", "at", "n", "off", "kind")).alias("blocks")
    )

    def with_text(b):
        anchor = b["at"] + b["off"]
        return F.struct(
            b["key"].alias("key"), b["at"].alias("at"), b["n"].alias("n"), b["off"].alias("off"),
            b["kind"].alias("kind"), F.substring("body", b["at"] + 1, b["off"]).alias("before"),
            F.substring("body", anchor + 1, b["n"] + WINDOW - 1 - b["off"]).alias("suffix"),
        )

    return docs.join(wanted, ["doc", "tag"]).select(
        "doc", "tag", F.explode(F.transform("blocks", with_text)).alias("b")
    ).select("doc", "tag", "b.*")


class Family:
    """The arrays of one run by rank: tables in suffix order within cells, bucketed by cell."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch = spark, scratch
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.count = 0
        self.arrays: list[tuple[int, str]] = []

    def write(self, df: DataFrame) -> str:
        self.count += 1
        name = f"spoor_{self.scratch.base.rsplit('-', 1)[-1]}_{self.count}"
        (
            df.repartition(self.buckets, "cell")
            .write.bucketBy(self.buckets, "cell").sortBy("cell", "suffix")
            .option("path", f"{self.scratch.base}/{name}").saveAsTable(name)
        )
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.scratch.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, name: str, rank: int) -> None:
        """A new array; arrays of equal rank are merged, as when one is added in binary."""
        while self.arrays and self.arrays[-1][0] == rank:
            _, other = self.arrays.pop()
            merged = self.write(self.spark.table(other).unionByName(self.spark.table(name)))
            self.drop(other)
            self.drop(name)
            name, rank = merged, rank + 1
        self.arrays.append((rank, name))

    def scan(self, name: str) -> DataFrame:
        """Marks of the new array ``name``, merge-scanned against all arrays before."""
        new = self.spark.table(name).groupBy("cell")
        if not self.arrays:
            return new.applyInArrow(_own_runs, _MARK)
        older = None
        for _, array in self.arrays:
            part = self.spark.table(array)
            older = part if older is None else older.unionByName(part)
        return older.groupBy("cell").cogroup(new).applyInArrow(shared_runs, _MARK)


def _sorted_bytes(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings of at most ``width`` bytes, and how many bytes each has in common
    with the one before it in that order."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    data = np.frombuffer(b"".join(values) + bytes(width), np.uint8)
    at = np.arange(width)
    rows = data[(np.cumsum(sizes) - sizes)[:, None] + at]
    rows[at >= sizes[:, None]] = 0
    words = rows.view(">u8").astype(np.uint64)
    # By length where padding makes them equal: no shorter one stands between two of equal start.
    order = np.lexsort((sizes, *words.T[::-1]))
    rows, sizes = rows[order], sizes[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.concatenate([[0], np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))])


def shared_runs(older: pa.Table, newer: pa.Table) -> pa.Table:
    """Windows of the newer suffixes that a smaller id has, as ``doc, tag, at, n``.

    Two suffixes share the window that starts ``o`` bytes before the anchor if they have ``o``
    bytes before it and ``WINDOW - o`` from it on in common; in sorted order those are runs.
    """
    both = pa.concat_tables([older.select(newer.column_names), newer])
    doc, tag, at, n, off = (
        both[c].to_numpy().astype(np.int64) for c in ("doc", "tag", "at", "n", "off")
    )
    size = len(doc)
    hits = np.zeros((size, PLACES), bool)
    if newer.num_rows:
        ahead, ahead_common = _sorted_bytes(both["suffix"].to_pylist(), 56)
        back, back_common = _sorted_bytes([b[::-1] for b in both["before"].to_pylist()], 40)
        right, left = np.empty(size, np.int64), np.empty(size, np.int64)
        for o in range(PLACES):
            right[ahead] = np.cumsum(ahead_common < WINDOW - o)
            left[back] = np.cumsum(back_common < o)
            mine = np.flatnonzero((off - n < o) & (o <= off))
            if not len(mine):
                continue
            code = right[mine] * (size + 1) + left[mine]
            order = np.argsort(code, kind="stable")
            new = _starts(code[order])
            least = np.minimum.reduceat(doc[mine][order], np.flatnonzero(new))
            again = doc[mine][order] > least[np.cumsum(new) - 1]
            hits[mine[order[again]], PLACES - 1 - o] = True
    hits[: older.num_rows] = False
    steps = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(steps == 1)
    end = np.nonzero(steps == -1)[1]
    return pa.table(
        [pa.array(doc[row]), pa.array(tag[row]),
         pa.array((at[row] + off[row] - PLACES + 1 + begin).astype(np.int32)),
         pa.array((end - begin).astype(np.int32))], ["doc", "tag", "at", "n"],
    )


def _own_runs(newer: pa.Table) -> pa.Table:
    return shared_runs(newer.slice(0, 0), newer)


def _batches(suffixes: DataFrame, rows: int, unit: int) -> list[Column]:
    """Conditions that part the suffixes by id: ``unit`` of them, as many again, then twice, four
    times as many."""
    shares, met = [], unit
    while met < rows:
        shares.append(met / rows)
        met *= 2
    cuts = suffixes.approxQuantile("doc", shares, 0.01) if shares else []
    edges = sorted({min(int(c), LAST - 1) for c in cuts})
    doc = F.col("doc")
    return [
        (doc > a if a is not None else F.lit(True)) & (doc <= b if b is not None else F.lit(True))
        for a, b in zip([None, *edges], [*edges, None])
    ]


def _sorted_marks(suffixes: DataFrame, scratch: Scratch, unit: int) -> list[DataFrame]:
    spark = suffixes.sparkSession
    rows = suffixes.count()
    if not rows:
        return []
    family = Family(spark, scratch)
    cells = max(family.buckets, rows // CELL_SUFFIXES)
    suffixes = suffixes.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    batches = _batches(suffixes, rows, unit)
    marks = []
    for i, batch in enumerate(batches):
        array = family.write(suffixes.filter(batch))
        marks.append(scratch.put(family.scan(array)))
        if i + 1 < len(batches):
            family.add(array, max(0, i - 1))
        else:
            family.drop(array)
    for _, array in family.arrays:
        family.drop(array)
    return marks


def _spread_marks(suffixes: DataFrame) -> DataFrame:
    """Windows that a smaller id has, met by their bytes wherever they are."""
    windows = suffixes.select(
        "doc", "tag", "at", F.concat("before", "suffix").alias("bytes"),
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"),
    ).select(
        "doc", "tag", (F.col("at") + F.col("i")).cast("int").alias("at"), F.lit(1).alias("n"),
        F.substring("bytes", F.col("i") + 1, F.lit(WINDOW)).alias("window"),
    )
    least = windows.groupBy("window").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most")
    ).filter("least < most")
    return windows.join(least, "window").filter("least < doc").select("doc", "tag", "at", "n")


def _spans(marks: DataFrame) -> DataFrame:
    """All marked runs (at, n) of each document in one row, at most as many as its windows."""
    return marks.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def cut(data: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left; ``runs`` are (window, windows)."""
    steps = np.zeros(len(data) + 1, np.int64)
    if runs:
        first, n = (np.array(c, np.int64) for c in zip(*runs))
        np.add.at(steps, first, 1)
        np.add.at(steps, np.minimum(first + n + WINDOW - 1, len(data)), -1)
    gone = np.cumsum(steps[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return int(gone.sum()), spans, left


@contextmanager
def _settings(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def mark_repeats(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """``doc, tag, runs`` of documents (doc, tag, body): the windows that earlier ones have."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.withColumn("tag", F.col("tag").cast("long"))
    scratch = Scratch(spark)
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                2 * size // (PLACES + 1) // CELL_ANCHORS)
    found = scratch.put(_anchors(docs, cells).groupBy("cell").applyInArrow(judge, _FOUND))
    suffixes = scratch.put(_suffixes(docs, found))
    marks = found.filter(F.col("kind") == WHOLE).select("doc", "tag", "at", "n")
    for part in _sorted_marks(suffixes.filter(F.col("kind") == SORTED), scratch, unit):
        marks = marks.unionByName(part)
    marks = marks.unionByName(_spread_marks(suffixes.filter(F.col("kind") == SPREAD)))
    return scratch.put(_spans(marks))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: int = UNIT
) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept``, one row per document, ``kept`` being the bytes
    that are left of the UTF-8 text.

    A byte goes if it is covered by ``WINDOW`` bytes that a document with a smaller key holds as
    well. A null text is empty. Keys are integers; a null key counts as larger than any other,
    and rows with the same key never remove bytes from each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"),
        body.alias("body"),
    )
    # Where keys repeat, a 64-bit hash of the text tells their rows apart; equal rows share results.
    unique = base.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    tag = F.lit(0) if unique else F.xxhash64("body")
    base = base.withColumn("tag", tag.cast("long"))
    texts = base.select("doc", "tag", "body")
    with _settings(spark):
        runs = mark_repeats(texts if unique else texts.dropDuplicates(["doc", "tag"]), unit)
    met = base.join(runs, ["doc", "tag"], "left").select("id", "body", "runs")
    id_type = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, spans, left = [], [], [], []
        bodies, marks = batch.column(1), batch.column(2)
        for row in range(batch.num_rows):
            data = bodies[row].as_py()
            mark = marks[row]
            pairs = []
            if mark.is_valid:
                values = mark.values
                pairs = list(zip(values.field(0).to_numpy(), values.field(1).to_numpy()))
            removed, runs_gone, kept = cut(data, pairs)
            sizes.append(len(data))
            gone.append(removed)
            spans.append(runs_gone)
            left.append(kept)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, gone, spans)),
             pa.array(left, pa.binary())],
            names=[key, "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return over_batches(
        met, work, f"{key} {id_type}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def repeat_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = remove_repeats(docs, key, text)
    return out.select(
        key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
