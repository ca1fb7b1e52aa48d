import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, fp string"


def odd_texts() -> list[str | None]:
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta.", "é", "naïve", "#tag", "x1", "ΣΑΣ", "of", "the"]
    base = " ".join(rng.choice(words) for _ in range(300))
    return [
        None, "", " ", "\n\n", "one", "One", "one two three", "a b  c", base, base,
        base.replace("gamma,", "gamma!", 1), base.upper(), base[: len(base) // 2],
        "same line\n" * 40, "word " * 70, "x" * 70_000, (base + "\n") * 30,
        "😀 emoji 😀 text " * 20, "<|endoftext|> a <|endoftext|>", "tab\tfeed\x0c\x0bline\r\nend  two",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra clashing columns."""
    texts = odd_texts()
    rows = [(i, t, "en", "src", len(t or ""), 5, "x") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, texts[8], None, None, None, None, None),
             (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
