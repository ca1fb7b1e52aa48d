import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spoor.llm.packing import RANKS, SIZE, pack, plan_patterns, plan_places, token_ids

from .conftest import odd_texts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizer_file():
    for text in odd_texts():
        got = token_ids(text or "", public_tokenizers.path(RANKS))
        assert got.tolist() == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    assert token_ids(text, public_tokenizers.path(RANKS)).tolist() == ids_of(text)


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "\u00a0", "\r\n", "a", "7", "!", "é", "漢"])
def test_a_million_of_one_kind(unit):
    text = "x" + unit * 1_000_000 + "y<|endoftext|> z"
    path = public_tokenizers.path(RANKS)
    assert token_ids(text, path).tolist() == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=20))
def test_plan_places_each_piece_once(histogram):
    patterns = plan_patterns(histogram, 40)
    assert all(sum(lengths) <= 40 for _, lengths in patterns)
    ranks, filled = defaultdict(list), []
    for length, first, end, position, stride in plan_places(patterns, 40, 3):
        for rank in range(first, end):
            ranks[length].append(rank)
            start = position + (rank - first) * stride
            filled += range(start, start + length)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert len(set(filled)) == len(filled)
    # Only packs that lack three ids or fewer are padded, and the last sequence.
    missing = defaultdict(lambda: 40)
    for position in filled:
        missing[position // 40] -= 1
    assert all(n <= 3 for sequence, n in missing.items() if sequence != max(missing))
    assert sorted(missing) == list(range(len(missing)))


def test_one_length_that_fits_badly(spark):
    docs = [(i, "word " * 599) for i in range(40)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(rows, dict(docs))
    tokens = sum(r["length"] for r in rows)
    assert max(r["sequence_id"] for r in rows) + 1 == -(-tokens // SIZE)


def check(rows, texts):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= SIZE
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc, text in texts.items():
        ids = np.array(ids_of(text), "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert (r["length"], r["doc_tokens"]) == (len(piece), len(ids))
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes())


def test_pieces_cover_every_document(spark, odd_docs, no_docs):
    unique = odd_docs.filter("doc_id is not null").distinct()
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    check(pack(unique).collect(), texts)
    whole = pack(odd_docs).collect()
    counts = sum(len(ids_of(r["text"])) for r in odd_docs.collect())
    assert sum(r["length"] for r in whole) == counts
    assert len({(r["sequence_id"], r["offset"]) for r in whole}) == len(whole)
    assert pack(no_docs).collect() == []
