"""Shortest-pack-first packing of token sequences over the histogram of their lengths.

A document is tokenised once, in one pass that yields its pieces: full sequences of ``SIZE``
ids, and a rest. Only the histogram of piece lengths reaches the driver, at most ``SIZE`` rows.
There lengths are placed longest first, each into the packing pattern with the most room, and
the counts of the patterns are updated, never single pieces. Pieces then find their pattern by
their rank among the pieces of equal length.

Lengths that fit badly, say one length that most documents have, leave patterns with room. Their
packs are laid end to end and cut into sequences, which splits one piece in two per sequence;
packs with at most ``ROOM`` ids to spare stay whole.
"""

from __future__ import annotations

import base64
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import Scratch, over_batches, salted_rank

SIZE = 1024
END_ID = 0
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
#: The one added token of the vocabulary, which tokenizers reads as a single id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

#: Ids that a pack may lack: beyond that it is filled up by cutting.
ROOM = 8

#: Cut pieces that are broadcast, about 100 bytes each, to where their ids are.
BROADCAST_PIECES = 100_000

#: ``ids`` are those of a rest, which may have to be cut; full pieces never are.
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_encoders: dict[str, object] = {}
_tokenizers: list = []


def _encoder(path: str):
    """The byte-level vocabulary, loaded once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encoders[path]


def _encode(part: str, path: str) -> np.ndarray:
    try:
        return _encoder(path).encode_to_numpy(part, disallowed_special=())
    except ValueError:  # the pattern gives up on white space of some hundred thousand characters
        if not _tokenizers:
            from tokenizers import Tokenizer

            _tokenizers.append(Tokenizer.from_file(public_tokenizers.path(TOKENIZER)))
        return np.array(_tokenizers[0].encode(part, add_special_tokens=False).ids, "<u4")


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text as unsigned 32-bit numbers, with the end id."""
    parts: list[np.ndarray] = []
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            parts.append(np.array([SPECIAL_ID], "<u4"))
        if part:
            parts.append(_encode(part, path))
    return np.concatenate([*parts, np.array([END_ID], "<u4")]).astype("<u4", copy=False)


def cut_pieces(docs: DataFrame, key: str, text: str, path: str, size: int = SIZE) -> DataFrame:
    """The pieces of each document: full sequences and the rest, with checksums of their ids."""
    key_type = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, lengths, sums, totals, rests = [], [], [], [], [], []
        texts = batch.column(1)
        for row in range(batch.num_rows):
            ids = token_ids(texts[row].as_py() or "", path)
            for start in range(0, len(ids), size):
                piece = ids[start : start + size]
                rows.append(row)
                starts.append(start)
                lengths.append(len(piece))
                data = piece.tobytes()
                sums.append(zlib.crc32(data))
                totals.append(len(ids))
                rests.append(data if len(piece) < size else None)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)),
                pa.array(rests, pa.binary()),
            ],
            names=[key, "start", "length", "ids_crc32", "doc_tokens", "ids"],
        )

    return over_batches(docs.select(key, text), work, f"{key} {key_type}, {PIECES}")


def plan_patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns as (count, lengths), from the longest length to the shortest.

    The open patterns are kept by room; a length goes to the pattern with the most room, as
    often as both have members left, and opens new packs when nothing open has room for it.
    """
    open_packs: list[tuple[int, int, tuple[int, ...]]] = []  # room, count, lengths
    done: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and open_packs[-1][0] >= length:
                room, count, lengths = open_packs.pop()
            else:
                room, count, lengths = size, left, ()
            used = min(count, left)
            if used < count:
                insort(open_packs, (room, count - used, lengths))
            room, lengths = room - length, (*lengths, length)
            left -= used
            if room:
                insort(open_packs, (room, used, lengths))
            else:
                done.append((used, lengths))
    return done + [(count, lengths) for _, count, lengths in open_packs]


def plan_places(
    patterns: list[tuple[int, tuple[int, ...]]], size: int = SIZE, room: int = ROOM
) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, position of the first, stride).

    A position counts ids over all sequences, and the next rank stands a stride further. Full
    packs start at a sequence each; the others stand end to end after them. The patterns are a
    function of the histogram alone, so the plan has as many rows as the patterns have places,
    whatever the number of documents.
    """
    used: dict[int, int] = {}
    places, position = [], 0
    for count, lengths in sorted(patterns, key=lambda p: sum(p[1]) < size - room):
        total = sum(lengths)
        stride = total if total < size - room else size
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            places.append((length, first, first + count, position + offset, stride))
            used[length] = first + count
            offset += length
        position += count * stride
    return places


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
    size: int = SIZE,
) -> DataFrame:
    """One row per piece: its document, ids and place in a sequence of at most ``size`` ids.

    A null or empty text is the end id alone. An empty table gives no rows. Rows with equal or
    null ids are documents of their own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    path = path or public_tokenizers.path(RANKS)
    # The number of a piece is written with it, so it is the same whenever it is read.
    pieces = scratch.put(
        cut_pieces(docs, key, text, path, size).withColumn("piece", F.monotonically_increasing_id())
    )
    histogram = {
        r["length"]: r["n"]
        for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    places = plan_places(plan_patterns(histogram, size), size)
    plan = spark.createDataFrame(
        places or [(0, 0, 0, 0, 1)],
        "length long, first_rank long, end_rank long, first_position long, stride long",
    )
    ranked = salted_rank(pieces.drop("ids"), "length", ["piece"], sum(histogram.values()), "rank")
    # At most a few thousand places, bounded by the sequence length: safe to broadcast.
    found = ranked.join(
        F.broadcast(plan),
        (ranked["length"] == plan["length"])
        & (ranked["rank"] >= plan["first_rank"])
        & (ranked["rank"] < plan["end_rank"]),
    ).drop(plan["length"])
    position = F.col("first_position") + (F.col("rank") - F.col("first_rank")) * F.col("stride")
    placed = scratch.put(found.select(
        key, "start", "length", "ids_crc32", "doc_tokens", "piece",
        F.floor(position / size).alias("sequence_id"), (position % size).alias("offset"),
    ))
    crosses = F.col("offset") + F.col("length") > size
    split = placed.filter(crosses)
    # At most one per sequence; a few are sent to the ids, so that the ids stay where they are.
    if split.count() <= BROADCAST_PIECES:
        split = F.broadcast(split)
    whole = placed.filter(~crosses).drop("piece")
    head = F.lit(size) - F.col("offset")
    parts = F.array(
        F.struct(F.lit(0).cast("long").alias("at"), head.alias("n"),
                 F.col("sequence_id").alias("in"), F.col("offset").alias("place")),
        F.struct(head.alias("at"), (F.col("length") - head).alias("n"),
                 (F.col("sequence_id") + 1).alias("in"), F.lit(0).cast("long").alias("place")),
    )
    cut = split.join(pieces.select("piece", "ids"), "piece").select(
        key, "start", "doc_tokens", "ids", F.explode(parts).alias("p")
    )
    data = F.substring("ids", (F.col("p.at") * 4 + 1).cast("int"), (F.col("p.n") * 4).cast("int"))
    return whole.unionByName(cut.select(
        key, (F.col("start") + F.col("p.at")).alias("start"), F.col("p.n").alias("length"),
        F.crc32(data).alias("ids_crc32"), "doc_tokens", F.col("p.in").alias("sequence_id"),
        F.col("p.place").alias("offset"),
    ))
