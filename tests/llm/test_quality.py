import re
from collections import Counter

import pytest

from spoor.llm.quality import LIMITS, measure, measure_quality

from .conftest import odd_texts


def covered(words, n):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts = Counter(grams)
    return {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(n)}


def covered_again(words, n):
    seen, out = set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        out |= set(range(i, i + n)) if gram in seen else set()
        seen.add(gram)
    return out


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = len(covered(words, 3))
    chars = sum(map(len, words))
    return (
        len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        repeated, len(words) < 50 or 100 * repeated > 50 * len(words),
        {n: sum(len(words[i]) for i in covered_again(words, n)) / max(chars, 1) for n in LIMITS},
    )


@pytest.mark.parametrize("text", odd_texts())
def test_measures_equal_brute_force(text):
    got, want = measure(text), brute(text)
    assert got[:6] == want[:6]
    assert dict(zip(LIMITS, got[8:], strict=True)) == pytest.approx(want[6])


def test_one_row_per_document(odd_docs, no_docs):
    rows = measure_quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert measure_quality(no_docs).collect() == []


def test_repetition_rejects_and_plain_text_stays():
    plain = " ".join(f"word{i}" for i in range(400))
    assert measure(plain)[6]
    # A heading that comes again stays, half a text of repeats does not.
    heading = " ".join(f"head{i}" for i in range(13))
    assert measure(f"{heading}\n{plain[:420]}\n{heading}")[6]
    part = " ".join(f"longerword{i}" for i in range(20))
    mixed = " ".join([part] * 5 + [f"x{i}" for i in range(110)])
    assert not measure(mixed)[5] and not measure(mixed)[6]


def test_a_passage_given_twice_goes():
    plain = " ".join(f"word{i}" for i in range(400))
    twice = "\n".join([plain[:700]] * 2 + [plain[700:2400]])
    assert not measure(twice)[5] and not measure(twice)[6]
    many = " ".join(f"w{i % 131}" for i in range(131 * 2))
    assert not measure(many)[6]
    # What the base rules leave goes well before half of the words are repeats.
    words = plain.split()
    for n in (75, 95):
        text = " ".join(words[300 : 300 + n] + words)
        assert not measure(text)[5] and not measure(text)[6]
