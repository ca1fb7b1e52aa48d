import cProfile
import pstats
import random

from pyspark.sql import Row

from spoor.llm.decontaminate import (
    Index, find_leaks, grams_of, lower_words_of, parts_of, search, words_of,
)


def vocabulary(rng, n=3000):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n)]


def made(rng, words, n):
    out = [rng.choice(words[:20] if rng.random() < 0.4 else words) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in out)


def scores(index, passage):
    """BM25 of every item by its definition, relative to its score on itself."""
    seen = set(passage)
    return {
        item: sum(w for t, w in zip(ids.tolist(), weights) if terms[t] in seen)
        for (item, _, _), (ids, weights) in zip(index.items, index.vectors)
        for terms in [list(index.terms)]
    }


def test_bounds_open_every_block_that_holds_a_hit():
    rng = random.Random(5)
    words = vocabulary(rng, 400)
    items = [Row(item=i, text=made(rng, words, rng.randint(5, 40))) for i in range(60)]
    index = Index(items, 0.35)
    index_size = max(64, index.longest)
    import numpy as np

    for _ in range(30):
        text = made(rng, words, 400)
        for it in rng.sample(items, 3):
            cut = words_of(it.text)
            rng.shuffle(cut)
            text += " " + " ".join(cut[: int(len(cut) * rng.uniform(0.2, 1))])
        tokens = words_of(text)
        ids = np.array([index.terms.get(w, -1) for w in tokens])
        segment = np.arange(len(tokens)) // index_size
        last = np.zeros(segment[-1] + 1, bool)
        last[-1] = True
        opened = {tuple(r) for r in index.opened(ids, segment, last).tolist()}
        for p in range(segment[-1] + 1):
            passage = tokens[p * index_size : (p + 2) * index_size]
            hits = {i for i, s in scores(index, passage).items() if s >= 0.35}
            for place, (item, _, _) in enumerate(index.items):
                if item in hits:
                    # A passage that the next or the one before covers with the same words may do.
                    assert (p, place // 8) in opened or not any(
                        t in index.terms and index.terms[t] < index.rare for t in passage
                    )


def test_items_of_opened_blocks_score_as_by_definition(monkeypatch):
    import numpy as np

    rng = random.Random(11)
    words = vocabulary(rng, 300)
    items = [Row(item=i, text=made(rng, words, rng.randint(5, 40))) for i in range(60)]
    index = Index(items, 0.35)
    size = max(64, index.longest)
    texts = [words_of(made(rng, words, rng.randint(1, 700))) for _ in range(20)]
    tokens = [w for t in texts for w in t]
    ids = np.array([index.terms.get(w, -1) for w in tokens])
    counts = [-(-len(t) // size) for t in texts]
    segment = np.concatenate([
        np.arange(len(t)) // size + sum(counts[:n]) for n, t in enumerate(texts)
    ])
    last = np.zeros(sum(counts), bool)
    last[np.cumsum(counts) - 1] = True
    passages = [t[i : i + 2 * size] for t in texts for i in range(0, len(t), size)]
    opened = index.opened(ids, segment, last)
    wanted = sorted(
        (p, place)
        for p, block in opened.tolist()
        for by_item in [scores(index, passages[p])]
        for place in range(block * 8, min(len(items), block * 8 + 8))
        if by_item[index.items[place][0]] >= 0.35
    )
    assert len(wanted) > 20
    # Marks of a few segments at a time, or few matrices kept, change nothing.
    for marks, cells in ((16 << 20, 4 << 20), (1, 1), (3 * len(index.terms), 5000)):
        monkeypatch.setattr("spoor.llm.decontaminate.MARKS", marks)
        monkeypatch.setattr("spoor.llm.decontaminate.CELLS", cells)
        assert index.reached(opened, ids, segment, last) == wanted


def test_search_makes_no_calls_per_word_or_opened_block():
    rng = random.Random(12)
    words = vocabulary(rng, 500)
    index = Index([Row(item=i, text=made(rng, words, 40)) for i in range(100)], 0.5)
    texts = [made(rng, words, 500) for _ in range(100)]
    profile = cProfile.Profile()
    profile.runcall(search, index, texts)
    assert pstats.Stats(profile).total_calls < 0.5 * sum(len(words_of(t)) for t in texts)


def test_words_of_ascii_and_other_texts():
    every = "".join(map(chr, range(128)))
    for text in (every, every[::-1], "A_b-C9\x1cd\x85e", "Éa ß\u2028İx", ""):
        assert lower_words_of(text) == words_of(text.lower())
    for n in range(128):
        assert lower_words_of(f"A{chr(n)}b") == words_of(f"A{chr(n)}b".lower())


def brute(items, texts, overlap=0.8):
    found = set()
    for number, text in enumerate(texts):
        words = words_of((text or "").lower())
        for it in items:
            q, a = parts_of(it.text or "")
            if not q + a:
                continue
            wanted = grams_of(q + a)
            n = len(next(iter(wanted)))
            have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            if len(wanted & have) >= overlap * len(wanted):
                found.add((number, it.item))
    return found


def test_leaks_equal_brute_force():
    rng = random.Random(8)
    words = vocabulary(rng)
    items = [Row(item=i, text=made(rng, words, rng.randint(12, 60))) for i in range(80)]
    items += [Row(item=90, text=None), Row(item=91, text=" . "), Row(item=92, text=items[3].text)]
    texts = [None, "", "..."]
    for k in range(150):
        text = made(rng, words, rng.randint(0, 600))
        if k % 3 == 0:
            leak = rng.choice(items[:80]).text.upper().replace(".", ";\n")
            at = rng.randint(0, len(text))
            text = f"{text[:at]} {leak} {text[at:]}"
        elif k % 3 == 1:
            text += " " + " ".join(words_of(rng.choice(items[:80]).text)[:8])
        texts.append(text)
    got = {(r[0], r[1]) for r in search(Index(items, 0.5), texts)}
    assert got == brute(items, texts) and len(got) >= 40


def test_parts():
    assert parts_of("Who is it? It is me.") == (["who", "is", "it"], ["it", "is", "me"])
    assert parts_of("One two. Three four.") == (["one", "two"], ["three", "four"])
    assert parts_of("no end") == (["no", "end"], [])
    assert parts_of("") == ([], [])


def test_near_copies_and_clean_texts(spark):
    rng = random.Random(3)
    words = vocabulary(rng)
    items = [(i, made(rng, words, 50)) for i in range(30)]
    near = items[4][1].split()
    near[25] = "changed"
    half = items[5][1].split()[:20]
    docs = [(1, made(rng, words, 900) + " " + " ".join(near)), (2, " ".join(half)),
            (3, made(rng, words, 5000)), (None, items[6][1]), (4, None), (1, items[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", df_lit())
    found = find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in found) == [("1", 4), ("1", 7), ("None", 6)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(df, none).collect() == []
    assert find_leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_several_index_sets(spark, monkeypatch):
    from spoor.llm import decontaminate

    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    rng = random.Random(4)
    words = vocabulary(rng)
    items = [(i, made(rng, words, 40)) for i in range(25)]
    docs = [(i, made(rng, words, 300) + " " + t) for i, t in items]
    found = find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, i) for i in range(25)]
