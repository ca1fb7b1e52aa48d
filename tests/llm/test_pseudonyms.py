import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from spoor.llm.pseudonyms import ROUNDS, kind_of, pseudonym, pseudonymise

KEY = "spoor"


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def card(rng, n=16):
    body = "4" + "".join(rng.choices("0123456789", k=n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def replaced(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pseudonymise(df, key=KEY, kinds="kinds").orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["kinds"] for r in rows]


def shape(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text)))


def test_values_change_within_their_format_and_stay_linked(spark):
    rng = random.Random(1)
    cards = [card(rng) for _ in range(60)]
    values = (
        cards + [f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}" for c in cards[:5]]
        + [f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}" for _ in range(40)]
        + [f"user{i}.x@mail{i}.example.com" for i in range(40)]
        + [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(40)]
        + [f"19{rng.randint(10, 99)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}" for _ in range(40)]
        + ["123-45-6789", "DE89370400440532013000", "03/14/1987", "24.12.2020", "+4915112345678"]
    )
    values = sorted(set(values))
    once, kinds = replaced(spark, [f"at {v}, so" for v in values])
    again, _ = replaced(spark, [f"{v} and é {v}" for v in values])
    new = [t[3:-4] for t in once]
    assert all(len(k) == 1 for k in kinds)
    assert all(a == f"{n} and é {n}" for a, n in zip(again, new))
    assert len(set(new)) == len(new)
    assert sum(n == v for n, v in zip(new, values)) == 0
    for v, n, (kind,) in zip(values, new, kinds):
        if kind == "ipv4":
            assert all(0 <= int(o) <= 255 for o in n.split("."))
        else:
            assert shape(v)[:1] == shape(n)[:1] and len(v) == len(n)
            assert shape(v) == shape(n) or kind == "iban"
        if kind == "card":
            assert luhn(n)
        if kind == "iban":
            turned = n[4:] + n[:4]
            assert int("".join(str(int(c, 36)) for c in turned)) % 97 == 1
    # Pseudonyms are values of the same kind, so they pass the checks again.
    _, kinds_of_new = replaced(spark, [f"at {n}, so" for n in new])
    assert kinds_of_new == kinds


def test_dates_are_permuted_one_to_one(spark):
    days = spark.range(0, 146_097, 37).select(
        F.date_format(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")),
                      "yyyy-MM-dd").alias("day")
    )
    new = days.select("day", pseudonym(F.col("day"), kind_of(F.col("day")), KEY).alias("new"))
    rows = new.collect()
    assert len({r["new"] for r in rows}) == len(rows)
    assert all("1700-01-01" <= r["new"] <= "2099-12-31" for r in rows)


def test_what_fails_its_check_stays(spark):
    texts = [
        "4111111111111112", "256.1.1.1", "1.2.3", "2021-02-30", "1699-12-31", "000-12-3456",
        "DE00370400440532013000", "x@y", "in 1999 and 2000", "@" * 5000, "a" * 50_000, "", "1" * 40_000,
        "pi 3.14159265358979", "word " * 200,
    ]
    new, kinds = replaced(spark, texts)
    assert new == texts
    assert not any(kinds)


def test_odd_rows_and_other_columns(odd_docs, no_docs):
    before = odd_docs.collect()
    after = pseudonymise(odd_docs, key=KEY).collect()
    assert pseudonymise(odd_docs, key=KEY).columns == odd_docs.columns
    assert sorted(map(str, before)) == sorted(map(str, after))
    assert pseudonymise(no_docs, key=KEY).collect() == []


def test_key_decides(spark):
    df = spark.createDataFrame([(1, "call +1 (988) 555-2485 now")], "doc_id long, text string")
    a, b = (pseudonymise(df, key=k).first()["text"] for k in ("one", "two"))
    assert a != b and shape(a) == shape(b)


def test_numbers_beside_a_card_or_iban_do_not_hide_it(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    texts = [
        f"{card} 123", "4111111111111111 05 24", f"12 {card}", f"2024 {card}", f"{card} 2024",
        f"12 {card} 05 24 123", f"{card} 5500-0000-0000-0004", "3782 822463 10005 1234",
        f"{card} 2021-05-03", f"{card} 10.0.0.1", f"{card} 123-45-6789", f"{card} 12@mail.com",
        iban, f"IBAN {iban} EUR 50", f"{iban} {card}", f"{iban} 2021-05-03", f"AB12 {card}",
        "BE68 5390 0754 7034 PAYS NOW", f"7 {iban}", "411111 1111111111 123", "DE88 3704 0044 0532 0130 00",
    ]
    want = [
        ["card"], ["card"], ["card"], ["card"], ["card"], ["card"], ["card", "card"], ["card"],
        ["card", "date"], ["card", "ipv4"], ["card", "ssn"], ["card", "email"],
        ["iban"], ["iban"], ["iban", "card"], ["iban", "date"], ["card"],
        ["iban"], ["iban"], ["card"], [],
    ]
    table = " ".join(str(n) for n in range(10, 1000))
    new, kinds = replaced(spark, [*texts, card, "DE89370400440532013000", table])
    assert kinds[: len(texts)] == want
    same, bare, same_length = new[len(texts) :]
    assert len(same_length) == len(table)
    for text, out in zip(texts, new):
        assert len(text) == len(out) or "10.0.0.1" in text
        assert card not in out and iban not in out and "4111111111111111" not in out
    assert new[:1] == [f"{same} 123"] and new[2:6] == [
        f"12 {same}", f"2024 {same}", f"{same} 2024", f"12 {same} 05 24 123"
    ]
    assert new[12].replace(" ", "") == bare and new[13] == f"IBAN {new[12]} EUR 50"


def test_cards_of_unusual_grouping_are_found_in_runs_of_any_length(spark):
    base = "4111111 111111111"
    new, _ = replaced(spark, [base + " 22" * n for n in (0, 3, 12, 40)])
    assert not any(base in text for text in new)


def feistel(value, kind, key=KEY):
    """The permutation of letters and digits, worked out without Spark."""
    def place(c):
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if 0 <= ord(c) - ord(first) < size:
                return ord(first), size
        return None

    middle = (len(value) + 1) // 2
    halves = [value[:middle], value[middle:]]
    for turn in range(ROUNDS):
        moved = 0 if turn % 2 else 1
        seed = f"{key}|{kind}|{turn}|{halves[1 - moved]}"
        digest = hashlib.sha512(seed.encode()).digest()
        out = ""
        for i, c in enumerate(halves[moved]):
            at = place(c)
            out += c if at is None else chr(at[0] + (ord(c) - at[0] + digest[i % 64]) % at[1])
        halves[moved] = out
    return "".join(halves)


def valid_ssn(value):
    a, b, c = value.split("-")
    return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"


def test_pseudonyms_are_those_of_the_permutation(spark):
    rng = random.Random(9)
    ssns = set()
    while len(ssns) < 1500:
        value = f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        if valid_ssn(value):
            ssns.add(value)
    ssns = sorted(ssns)
    mails = [f"User.{n}_x@mail{n}.Example.org" for n in range(40)]
    cards = [card(rng) for _ in range(40)]
    new, _ = replaced(spark, [*ssns, *mails, *cards])
    every = [f"{a:03d}-{b:02d}" for a in range(1, 900) if a != 666 for b in range(1, 100)]
    places = {head: place for place, head in enumerate(every)}
    for value, out in zip(ssns, new):
        halves = [places[value[:6]], int(value[7:]) - 1]
        for turn in range(ROUNDS):
            moved = 0 if turn % 2 else 1
            seed = f"{KEY}|ssn|{turn}|{halves[1 - moved]}"
            number = int(hashlib.sha256(seed.encode()).hexdigest()[:13], 16)
            halves[moved] = (halves[moved] + number) % (len(every), 9999)[moved]
        assert out == f"{every[halves[0]]}-{halves[1] + 1:04d}" and valid_ssn(out)
    assert len(set(new[:1500])) == 1500
    for value, out in zip(mails, new[1500:]):
        name, end = value.rsplit(".", 1)
        assert out == f"{feistel(name, 'email')}.{end}"
    for value, out in zip(cards, new[1540:]):
        assert out[:-1] == feistel(value[:-1], "card") and luhn(out)


def test_a_key_is_asked_for_and_no_column_is_lost(spark):
    from spoor.llm.fuzzy import keep_one

    df = spark.createDataFrame(
        [(1, "call +1 (988) 555-2485 now", 1, 2, 3, 4, 5)],
        "doc_id long, text string, __found int, __New int, __a int, __b int, __n int",
    )
    with pytest.raises(TypeError):
        pseudonymise(df)
    out = pseudonymise(df, key="k")
    assert out.columns == df.columns and out.first()[2:] == (1, 2, 3, 4, 5)
    assert keep_one(df).columns == df.columns and keep_one(df).first()[2:] == (1, 2, 3, 4, 5)
