"""Secrets in texts: fixed forms, and random-looking strings by character Markov models.

Two models of character pairs are trained, one on random strings and one on ordinary
identifiers. A string is reported if the log-likelihood ratio of the two models reaches
``MIN_RATIO``. Everything runs in SQL functions; the driver only turns two tables of pair
counts into one table of log ratios.

Labelled samples: random strings are the values that the fixed forms find in a sample of the
documents, and digests of ordinary words written as base64 and in base 36; ordinary
identifiers are the other strings in a sample of the documents. The sample takes documents by a
hash of their id and has about ``SAMPLE`` documents for the words and ``SECRET_SAMPLE`` for the
values, however large the table is. The scan itself reads every text whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.spans import matches, spans

#: The forms, in the order in which they are listed.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = {"assign": (ASSIGN, 12), "access": (ACCESS, 18), "hex": (HEX, 16)}
RANDOM = "random"

#: Strings that the models judge, and the least length of one.
MIN_LENGTH = 16
STRING = r"[A-Za-z0-9+/=_-]{%d,}" % MIN_LENGTH
#: Log-likelihood ratio, in nats, from which a string counts as random.
MIN_RATIO = 10.0
SAMPLE, SECRET_SAMPLE = 2_000, 50_000

#: Printable ASCII; the space stands for the start of a string.
_FIRST, _CODES = 32, 95


def _base_spans(text: Column, kind: str) -> Column:
    """Spans of one fixed form. A match that is too short is used up, then dropped."""
    pattern, least = KINDS[kind]
    # A run shorter than asked for holds no longer one, so the length can go into the search.
    if kind == "access":
        pattern = r"AKIA[A-Z0-9]{%d,}" % (least - 4)
    elif kind == "hex":
        pattern = r"[0-9a-f]{%d,}" % least
    found = spans(text, matches(text, pattern), pattern)
    if kind != "assign":
        return found
    return F.filter(found, lambda s: F.length(_secret(s["value"])) >= least)


def _secret(value: Column) -> Column:
    return F.regexp_extract(value, ASSIGN, 2)


def _base_values(docs: DataFrame, text: str) -> DataFrame:
    text = F.coalesce(F.col(text), F.lit(""))
    each = [
        F.transform(
            _base_spans(text, kind),
            (lambda s: _secret(s["value"])) if kind == "assign" else (lambda s: s["value"]),
        )
        for kind in KINDS
    ]
    return docs.select(F.explode(F.concat(*each)).alias("string")).distinct()


def _sampled(docs: DataFrame, key: str, rows: int, wanted: int) -> DataFrame:
    every = max(1, rows // wanted)
    return docs.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(every)) == 0)


def _pair_counts(strings: DataFrame) -> DataFrame:
    """How often one character follows another, by label; a space stands before the first."""
    padded = F.concat(F.lit(" "), F.col("string"))
    at = F.explode(F.sequence(F.lit(1), F.length("string")))
    pairs = strings.select("label", padded.alias("padded"), at.alias("at")).select(
        "label", F.substr("padded", F.col("at"), F.lit(2)).alias("pair")
    )
    return pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    """Log ratios of the two models, for each pair of characters in code order.

    The counts that reach the driver are at most two tables of pairs of printable characters.
    """
    rows = docs.count()
    values = _base_values(_sampled(docs, key, rows, SECRET_SAMPLE), text)
    words = (
        _sampled(docs, key, rows, SAMPLE)
        .select(F.explode(F.regexp_extract_all(
            F.coalesce(F.col(text), F.lit("")), F.lit(r"[A-Za-z0-9+/=_-]{3,}"), F.lit(0)
        )).alias("string"))
        .distinct()
        .join(values, "string", "left_anti")
        .filter(~F.col("string").rlike(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}"))
    )
    digest = F.sha2("string", 256)
    digests = words.select(F.explode(F.array(
        F.base64(F.unhex(digest)), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)),
        F.lower(F.conv(F.substring(digest, 16, 15), 16, 36)),
    )).alias("string"))
    labelled = words.withColumn("label", F.lit(0)).unionByName(
        values.unionByName(digests).withColumn("label", F.lit(1))
    )
    counts = [[0.0] * (_CODES * _CODES) for _ in range(2)]
    for row in _pair_counts(labelled).collect():
        a, b = (ord(c) - _FIRST for c in row["pair"])
        counts[row["label"]][a * _CODES + b] += row["n"]
    return _log_ratios(*counts)


def _log_ratios(ordinary: list[float], random: list[float]) -> list[float]:
    """Smoothed: half an observation for each following character."""
    out = []
    for a in range(_CODES):
        row = slice(a * _CODES, (a + 1) * _CODES)
        sums = [sum(counts[row]) + _CODES / 2 for counts in (random, ordinary)]
        for r, o in zip(random[row], ordinary[row], strict=True):
            out.append(round(math.log((r + 0.5) / sums[0]) - math.log((o + 0.5) / sums[1]), 3))
    return out


def log_ratio(string: Column, ratios: Column) -> Column:
    """The log-likelihood ratio of a string of printable ASCII characters."""
    codes = F.transform(F.split(string, ""), lambda c: F.ascii(c) - F.lit(_FIRST))
    empty = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(state, code):
        value = F.get(ratios, state["last"] * _CODES + code)
        return F.struct(code.alias("last"), (state["sum"] + value).alias("sum"))

    return F.aggregate(codes, empty, step, lambda state: state["sum"])


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ratios: list[float] | None = None
) -> DataFrame:
    """One row per document with ``found``, an array of (start, kind, end, value, score).

    Kinds are those of ``KINDS`` and ``random``. A random string that touches a span of a fixed
    form is left to that form. A null or empty text has no spans; repeated rows and null ids are
    rows like others, other columns are not read. An empty table gives no rows.
    """
    if ratios is None:
        ratios = train(docs, key, text)
    # A literal array, folded once: character pairs are looked up by index.
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    body = F.coalesce(F.col(text), F.lit(""))
    order = {kind: i for i, kind in enumerate([*KINDS, RANDOM])}

    def named(kind: str, found: Column, score) -> Column:
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(order[kind]).alias("place"), F.lit(kind).alias("kind"),
            s["end"].alias("end"), s["value"].alias("value"), score(s["value"]).alias("score"),
        ))

    none = lambda value: F.lit(None).cast("double")
    base = docs.select(F.col(key), body.alias("__text")).withColumns(
        {f"__{kind}": _base_spans(F.col("__text"), kind) for kind in KINDS}
    ).withColumn(
        "__base", F.concat(*(named(kind, F.col(f"__{kind}"), none) for kind in KINDS))
    ).withColumn("__strings", matches(F.col("__text"), STRING))
    # Places are worked out only where some string of the text is random.
    judged = base.withColumn(
        "__random",
        F.when(
            F.exists("__strings", lambda s: log_ratio(s, table) >= MIN_RATIO),
            F.filter(
                spans(F.col("__text"), F.col("__strings"), STRING),
                lambda s: (log_ratio(s["value"], table) >= MIN_RATIO) & ~F.exists(
                    "__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
                ),
            ),
        ).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")),
    )
    found = F.concat("__base", named(RANDOM, F.col("__random"), lambda v: log_ratio(v, table)))
    return judged.select(key, F.array_sort(found).alias("found"))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, by start and then kind, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def secret_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = find_secrets(docs, key, text)
    base = F.filter("found", lambda s: s["kind"] != RANDOM)

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        key,
        *(count(kind).alias(f"n_{kind}") for kind in [*KINDS, RANDOM]),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
