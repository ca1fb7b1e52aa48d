import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoor.llm import repeats
from spoor.llm.repeats import GRAM, WINDOW, blocks_of, cut, mark_repeats, remove_repeats, repeat_digests, shared_runs

from .conftest import odd_texts


def brute(rows):
    """Results by row for (id, text): windows of smaller ids in a set."""
    by_id, out = {}, []
    for doc, text in rows:
        by_id.setdefault(repeats.LAST if doc is None else doc, []).append((text or "").encode())
    seen, found = set(), {}
    for doc in sorted(by_id):
        fresh = set()
        for data in by_id[doc]:
            gone = bytearray(len(data))
            for i in range(len(data) - WINDOW + 1):
                w = data[i : i + WINDOW]
                fresh.add(w)
                if w in seen:
                    gone[i : i + WINDOW] = b"\1" * WINDOW
            spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            kept = bytes(c for c, g in zip(data, gone) if not g)
            found[doc, data] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        seen |= fresh
    for doc, text in rows:
        out.append((str(doc), *found[repeats.LAST if doc is None else doc, (text or "").encode()]))
    return sorted(out)


def result(df):
    return sorted(
        (str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        for r in repeat_digests(df).collect()
    )


def passages(rng, n):
    alphabet = "abcdefgh éß"
    return ["".join(rng.choices(alphabet, k=rng.randint(45, 130))) for _ in range(n)]


def corpus(rng, n):
    shared = passages(rng, 12) + ["-" * 60, "ab" * 70]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            text += "".join(rng.choices("abcdefgh é", k=rng.randint(0, 120)))
            if rng.random() < 0.7:
                p = rng.choice(shared)
                a = rng.randint(0, 20)
                text += p[a : rng.randint(a, len(p))] if rng.random() < 0.5 else p
        rows.append((i * 7 - 200, text))
    rows += [(10_000 + i, rows[i][1]) for i in range(0, n, 3)]
    return rows


@pytest.mark.parametrize("chunk", [repeats.CHUNK, 70])
def test_blocks_cover_all_windows_and_depend_on_nearby_text(monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = random.Random(2)
    for text in [*odd_texts(), *passages(rng, 20), "a" * 400, "ab" * 300]:
        data = (text or "").encode()[:5000]
        keys, first, n, off = blocks_of(data)
        windows = max(0, len(data) - WINDOW + 1)
        assert first.tolist() == np.cumsum([0, *n.tolist()])[: len(n)].tolist()
        assert n.sum() == windows and (n <= WINDOW - GRAM + 1).all()
        # The key of a window is that of the window alone.
        for key, a, b, o in zip(keys, first, n, off):
            for i in (a, a + b - 1):
                alone, _, _, place = blocks_of(data[i : i + WINDOW])
                assert alone[0] == key and i + place[0] == a + o


def test_cut():
    data = bytes(range(200))
    assert cut(data, []) == (0, 0, data)
    assert cut(data, [(10, 1), (60, 1)]) == (100, 1, data[:10] + data[110:])
    assert cut(data, [(10, 1), (61, 2)]) == (101, 2, data[:10] + data[60:61] + data[112:])
    assert cut(b"", []) == (0, 0, b"")


def test_equals_brute_force(spark):
    rows = corpus(random.Random(4), 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sum(r[2] for r in want) > 5000
    assert result(df) == want


@pytest.mark.parametrize("blocks", [3, repeats.KEY_BLOCKS])
def test_crowded_keys_and_more_batches(spark, monkeypatch, blocks):
    monkeypatch.setattr(repeats, "KEY_BLOCKS", blocks)
    scans = []
    scan = repeats.Family.scan
    monkeypatch.setattr(
        repeats.Family, "scan", lambda self, name: (scans.append(len(self.arrays)), scan(self, name))[1]
    )
    rows = corpus(random.Random(5), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = mark_repeats(
        df.select(F.col("doc_id").alias("doc"), F.lit(0).alias("tag"),
                  F.col("text").cast("binary").alias("body")), unit=20,
    ).collect()
    found = {r["doc"]: [tuple(x) for x in r["runs"]] for r in runs}
    got = []
    for doc, text in rows:
        n, spans, left = cut(text.encode(), found.get(doc, []))
        got.append((str(doc), len(text.encode()), n, spans, hashlib.sha256(left).hexdigest()))
    assert sorted(got) == brute(rows)
    # Each batch but the first meets one array that holds all before it.
    assert len(scans) >= 3 and scans == [0] + [1] * (len(scans) - 1)


def test_odd_rows(spark, odd_docs, no_docs):
    # A second row of an id with another text: rows of one id do not remove from each other.
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows += [(8, odd_texts()[16]), (8, odd_texts()[8]), (30, odd_texts()[15])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    assert Counter(result(df)) == Counter(brute(rows))
    assert remove_repeats(no_docs).collect() == []


def test_rows_of_one_id_and_texts_alike_are_told_apart(spark):
    import zlib

    # Two texts of one id that agree in 20 bits of their checksum, one with a repeat.
    shared = "".join(f"{i:03d}" for i in range(30))
    seen, pair = {}, None
    for i in range(100_000):
        text = f"{i} {shared}" if i % 2 else f"{i} " + "q" * 30
        tag = zlib.crc32(text.encode()) % (1 << 20)
        if tag in seen and seen[tag][0] % 2 != i % 2:
            pair = [seen[tag][1], text]
            break
        seen[tag] = (i, text)
    rows = [(1, shared), (None, pair[0]), (None, pair[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)


def table(rows):
    """Suffixes at a fixed anchor of texts (doc, text, off)."""
    names = ["doc", "tag", "at", "n", "off", "before", "suffix"]
    cells = [(d, 0, 0, len(t) - WINDOW + 1, o, t[:o], t[o:]) for d, t, o in rows]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*cells), types)], names)


def test_sorted_suffixes_share_the_windows_of_their_bytes():
    rng = random.Random(6)
    anchor = bytes(range(100, 116))
    for _ in range(40):
        rows = []
        for doc in range(30):
            # Zero bytes and short alphabets: common starts of all lengths, padding-like ends.
            off = rng.randint(0, 34)
            before = bytes(rng.choices([0, 1], [9, 1], k=off))
            after = bytes(rng.choices([0, 1], [9, 1], k=rng.randint(34 - off, 34)))
            rows.append((doc // 2, before + anchor + after, off))
        older, newer = rows[:14], rows[14:]
        seen = {}
        for doc, text, _ in rows:
            for i in range(len(text) - WINDOW + 1):
                seen[text[i : i + WINDOW]] = min(doc, seen.get(text[i : i + WINDOW], doc))
        want = Counter(
            (doc, i) for doc, text, _ in newer for i in range(len(text) - WINDOW + 1)
            if seen[text[i : i + WINDOW]] < doc
        )
        runs = shared_runs(table(older), table(newer)).to_pylist()
        assert Counter((r["doc"], r["at"] + j) for r in runs for j in range(r["n"])) == want


def test_copies_of_a_row_without_id_send_their_marks_once(spark):
    text = "".join(f"{i:03d}" for i in range(400))
    rows = [(1, text)] + [(None, text + "!")] * 200 + [(None, "x" * 500)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute(rows)
    base = df.select(F.coalesce("doc_id", F.lit(repeats.LAST)).alias("doc"),
                     F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("body"))
    runs = mark_repeats(base.dropDuplicates(["doc", "tag"])).collect()
    assert len(runs) == 1 and len(runs[0]["runs"]) < len(text) // 10
