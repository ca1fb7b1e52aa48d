import random
import re

import numpy as np
import xxhash

from spoor.llm import fuzzy
from spoor.llm.common import Scratch
from spoor.llm.components import components
from spoor.llm.fuzzy import fingerprint, forest, group_near, keys_of, near_links

from .conftest import odd_texts


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def brute_components(values):
    """Least index reachable over at most four differing bits."""
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if bin(a ^ b).count("1") <= 4:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(values))]


def test_fingerprints_equal_brute_force():
    for text in odd_texts():
        assert fingerprint(text) == brute_fingerprint(text)


def test_near_fingerprints_share_a_key():
    rng = random.Random(3)
    for errors in range(5):
        a = [rng.getrandbits(64) for _ in range(400)]
        b = [x ^ sum(1 << k for k in rng.sample(range(64), errors)) for x in a]
        keys = []
        for values in (a, b):
            rows, found = keys_of(np.array(values, np.uint64))
            sets = [set() for _ in values]
            for row, key in zip(rows, found):
                sets[row].add(int(key))
            keys.append(sets)
        assert all(x & y for x, y in zip(*keys))


def test_every_way_to_spread_four_errors_over_the_segments():
    rng = random.Random(5)
    parts = [list(range(23)), list(range(23, 46)), list(range(46, 64))]
    for i in range(5):
        for j in range(5 - i):
            k = 4 - i - j
            for _ in range(30):
                a = rng.getrandbits(64)
                flips = rng.sample(parts[0], i) + rng.sample(parts[1], j) + rng.sample(parts[2], k)
                b = a ^ sum(1 << f for f in flips)
                rows, keys = keys_of(np.array([a, b], np.uint64))
                assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_forest_spans_links():
    rng = random.Random(1)
    values = [rng.getrandbits(10) for _ in range(200)]
    unique = sorted(set(values))
    a, b = forest(np.array(unique, np.uint64), 2)
    assert all(bin(int(x) ^ int(y)).count("1") <= 2 for x, y in zip(a, b))
    assert len(a) < len(unique)


def near_values(rng, n):
    values = []
    for _ in range(n):
        base = rng.choice(values) if values and rng.random() < 0.6 else rng.getrandbits(64)
        values.append(base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))))
    return values


def test_links_give_the_components_also_when_keys_are_split(spark):
    rng = random.Random(9)
    values = sorted(set(near_values(rng, 400)))
    wanted = brute_components(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    place = {v: i for i, v in enumerate(signed)}
    for part in (fuzzy.PART, 3):
        scratch = Scratch(spark)
        links = near_links(fps, scratch, part=part)
        label = list(range(len(values)))
        found = {r["node"]: r["label"] for r in components(links, scratch).collect()}
        groups = {}
        for v, lab in found.items():
            groups.setdefault(lab, []).append(place[v])
        for members in groups.values():
            for m in members:
                label[m] = min(members)
        assert label == wanted


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()
    labels = {r["node"]: r["label"] for r in found}
    assert labels == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []


def test_groups_of_documents(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    labels = brute_components(prints)
    least = {}
    for r, lab in zip(rows, labels):
        if r["doc_id"] is not None:
            least[lab] = min(least.get(lab, r["doc_id"]), r["doc_id"])
    want = sorted(
        (str(r["doc_id"]), f"{p:016x}", least.get(lab)) for r, p, lab in zip(rows, prints, labels)
    )
    got = sorted(
        (str(r["doc_id"]), r["fingerprint"], r["component_id"])
        for r in group_near(odd_docs).collect()
    )
    assert got == want
    assert group_near(no_docs).collect() == []
