"""Toxicity by weak supervision: many weak voters, a label model, a linear classifier.

Voters look for words of a lexicon or for a pattern and vote or abstain. Some lexicons are fixed,
others are learned from labelled rows. The label model takes the counts of all vote patterns over
the whole table, and fits class balance and voter accuracies by expectation maximisation. It
measures which voters go together beyond what the class explains, and treats such voters as one.
Its posterior of a pattern labels documents without labels, and a logistic regression on words is
trained on these posteriors. The classifier alone gives the score.

Labels are read from rows whose crc32(id as text) modulo 5 is not 0, and from no others. Bounds:
lexicons are learned from at most about ``LEXICON_ROWS`` labelled rows, the classifier is fitted
to about ``FIT_ROWS`` documents, both taken by a hash of the id. Votes, patterns and scores cover
every document and its whole text.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
LEXICON_ROWS, FIT_ROWS = 10_000, 10_000
#: What words are made of, in a pattern.
LETTERS = r"\p{L}\p{N}_"
#: Lengths of stems, in characters.
STEMS = (4, 5, 6)
#: Learned words: least documents, least distance from chance in standard errors, most words.
MIN_DOCS, MIN_Z, MOST_WORDS, LEARNED_VOTERS = 5, 6.0, 60, 4
#: Correlation within a class from which two voters count as one, and most voters in one.
LINKED, MOST_LINKED = 0.3, 3
#: Features of the classifier: least documents of a word, most words, penalty.
MIN_DF, VOCABULARY, PENALTY = 5, 1 << 15, 2e-4

#: Lexicons in several languages, one voter each.
LEXICONS = {
    "insult": ["idiot", "idiots", "idiota", "moron", "morons", "imbecile", "imbécile", "imbécil",
               "stupid", "dumb", "dumbass", "dummkopf", "cretin", "crétin", "fool", "halfwit"],
    "worth": ["worthless", "loser", "losers", "pathetic", "useless", "perdedor", "versager",
              "minable", "inutile", "nobody", "failure"],
    "contempt": ["scum", "trash", "garbage", "vermin", "filth", "abschaum", "ordure", "basura",
                 "escoria", "parasite", "parasites", "subhuman"],
    "disgust": ["disgusting", "revolting", "repulsive", "vile", "gross", "widerlich", "dégoûtant",
                "asqueroso", "nasty", "sickening"],
    "ridicule": ["clown", "clowns", "laughable", "ridiculous", "lächerlich", "ridicule",
                 "payaso", "buffoon", "joker"],
    "profanity": ["fuck", "fucking", "shit", "bullshit", "bitch", "bastard", "asshole", "crap",
                  "scheiße", "arschloch", "merde", "connard", "mierda", "puta", "cabrón"],
    "threat": ["kill", "murder", "strangle", "töten", "umbringen", "tuer", "matar"],
}
#: Patterns, one voter each.
PATTERNS = {
    "address": r"(?i)\byou(?:'re| are)? (?:\w+ )?(?:idiot|moron|loser|clown|scum|trash|stupid|pathetic)",
    "hate": r"(?i)\b(?:i hate (?:you|them)|shut up|go to hell|get lost|drop dead)\b",
}
#: A document with this many different words of all lexicons.
SEVERAL = 2


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


def _longer_than(size: int):
    return lambda w: F.length(w) > size


def _stem(size: int):
    return lambda w: F.concat(F.substring(w, 1, size), F.lit("*"))


def words(text: Column) -> Column:
    """The distinct words of a text in lower case, and their stems with a star.

    A stem is the start of a longer word: voters and classifier can go by it where a word is
    inflected or joined to others.
    """
    found = F.array_distinct(F.split(F.lower(text), rf"[^{LETTERS}]+"))
    stems = [
        F.transform(
            F.filter(found, _longer_than(size)), _stem(size)
        )
        for size in STEMS
    ]
    return F.array_distinct(F.concat(found, *stems))


def _strings(values: list[str]) -> Column:
    """An array of constants; as one JSON text, so that a long list is no large expression."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def wanted_words(text: Column, wanted: list[str]) -> Column:
    """Those of some ``words`` that a text has, in the order of ``words``.

    Stems are taken from the text by a pattern that eats a longer word whole, and only where one
    of their length is wanted; stems of every word would be by far the dearest step.
    """
    lower = F.lower(text)
    whole = [w for w in wanted if not w.endswith("*")]
    found = F.array_intersect(F.split(lower, rf"[^{LETTERS}]+"), _strings(whole))
    stems = []
    for size in STEMS:
        if starts := [w[:-1] for w in wanted if w.endswith("*") and len(w) == size + 1]:
            longer = F.regexp_extract_all(lower, F.lit(rf"([{LETTERS}]{{{size}}})[{LETTERS}]+"), 1)
            stems.append(F.transform(F.array_intersect(longer, _strings(starts)), _starred))
    return F.concat(found, *stems) if stems else found


def _starred(stem: Column) -> Column:
    return F.concat(stem, F.lit("*"))


def _sampled(df: DataFrame, key: str, rows: int, wanted: int) -> DataFrame:
    every = max(1, rows // wanted)
    return df.filter(F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(every)) == 0)


def learn_lexicon(docs: DataFrame, labels: DataFrame, rows: int, key: str, text: str) -> list[str]:
    """Words far more frequent in documents labelled toxic, best first."""
    chosen = _sampled(labels, key, rows, LEXICON_ROWS)
    # Bounded by the sample, so safe to broadcast; texts are not moved for the join.
    known = docs.select(key, text).join(F.broadcast(chosen), key)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if not ones or not zeros:
        return []
    share = (F.col("a") + F.col("b")) / F.lit(ones + zeros)
    distance = (F.col("a") / ones - F.col("b") / zeros) / F.sqrt(
        share * (1 - share) * (1 / ones + 1 / zeros) + 1e-12
    )
    found = (
        known.select("toxic", F.explode(words(F.coalesce(F.col(text), F.lit("")))).alias("word"))
        .filter(F.length("word") >= 3)
        .groupBy("word")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .filter(F.col("a") >= MIN_DOCS)
        .withColumn("z", distance)
        # Far from chance, and several times as frequent as elsewhere.
        .filter((F.col("z") >= MIN_Z) & (F.col("a") / ones >= 5 * F.col("b") / zeros))
        .orderBy(F.desc("z"), "word")
        .limit(MOST_WORDS)
    )
    return [r["word"] for r in found.collect()]


def vote_patterns(
    docs: DataFrame, learned: list[str], key: str, text: str
) -> tuple[DataFrame, list[str]]:
    """``key`` and the votes as the bits of a long for every document; the voters' names."""
    lexicons = dict(LEXICONS)
    for part in range(LEARNED_VOTERS):
        if mine := learned[part::LEARNED_VOTERS]:
            lexicons[f"learned_{part}"] = mine
    every = sorted({w for ws in lexicons.values() for w in ws})
    body = F.coalesce(F.col(text), F.lit(""))
    hits = wanted_words(body, every)
    df = docs.select(
        key, hits.alias("__hits"), *(body.rlike(form).alias(n) for n, form in PATTERNS.items())
    )
    votes = [
        F.arrays_overlap("__hits", F.array(*map(F.lit, ws))) for ws in lexicons.values()
    ] + [F.size("__hits") >= SEVERAL] + [F.col(name) for name in PATTERNS]
    bits = sum(
        (vote.cast("long") * (1 << place) for place, vote in enumerate(votes)), F.lit(0).cast("long")
    )
    return df.select(key, bits.alias("votes")), [*lexicons, "several", *PATTERNS]


def _logistic(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


class LabelModel:
    """Latent classes of vote patterns, with groups of correlated voters as joint voters."""

    def __init__(self, names: list[str]):
        self.names = names
        self.groups = [(i,) for i in range(len(names))]

    def _outcomes(self, patterns: np.ndarray) -> np.ndarray:
        """For each pattern and group, the joint vote as a number."""
        columns = []
        for group in self.groups:
            value = np.zeros(len(patterns), np.int64)
            for place, voter in enumerate(group):
                value |= ((patterns >> voter) & 1) << place
            columns.append(value)
        return np.stack(columns, axis=1)

    def _fit(self, patterns, counts, known, rounds=200) -> None:
        """``known`` is 0, 1, or -1 for patterns of documents without a label."""
        outcomes = self._outcomes(patterns)
        # Start: more votes, more likely toxic. Labelled rows stay as they are labelled.
        votes = np.array([bin(int(p)).count("1") for p in patterns])
        weight = np.clip(votes / max(1.0, len(self.names) / 3), 0.02, 0.98)
        q = np.where(known >= 0, known, weight).astype(float)
        for _ in range(rounds):
            balance = float(np.clip((counts * q).sum() / counts.sum(), 1e-4, 1 - 1e-4))
            self.balance, self.tables = balance, []
            for g, group in enumerate(self.groups):
                size = 1 << len(group)
                table = np.stack([
                    np.bincount(outcomes[:, g], counts * w, size) + 0.5 / size for w in (1 - q, q)
                ])
                self.tables.append(np.log(table / table.sum(1, keepdims=True)))
            new = np.where(known >= 0, known, self.posterior(patterns))
            if np.abs(new - q).max() < 1e-7:
                break
            q = new

    def _votes_odds(self, patterns: np.ndarray) -> np.ndarray:
        """What each group's vote adds to the log odds of a pattern."""
        outcomes = self._outcomes(patterns)
        return np.stack(
            [(t[1] - t[0])[outcomes[:, g]] for g, t in enumerate(self.tables)], axis=1
        )

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        prior = math.log(self.balance / (1 - self.balance))
        return _logistic(prior + self._votes_odds(patterns).sum(1))

    def _correlations(self, patterns, counts, known) -> np.ndarray:
        """How much oftener two voters vote together than the classes explain, per unit of spread.

        The classes are told by the other voters: were the two asked as well, a pair of copies
        would be the class itself.
        """
        odds = self._votes_odds(patterns)
        prior = math.log(self.balance / (1 - self.balance))
        votes = ((patterns[:, None] >> np.arange(len(self.names))) & 1).astype(float)
        share = counts / counts.sum()
        owner = {v: g for g, group in enumerate(self.groups) for v in group}
        # How often each voter votes, by class.
        rate = np.zeros((len(self.names), 2))
        for g, group in enumerate(self.groups):
            outcome = np.arange(1 << len(group))
            for place, v in enumerate(group):
                rate[v] = np.exp(self.tables[g])[:, (outcome >> place) & 1 == 1].sum(1)
        out = np.zeros((len(self.names),) * 2)
        for a, b in combinations(range(len(self.names)), 2):
            if owner[a] == owner[b]:
                continue
            told = _logistic(prior + odds.sum(1) - odds[:, owner[a]] - odds[:, owner[b]])
            told = np.where(known >= 0, known, told)
            toxic = float(share @ told)
            mix = np.array([1 - toxic, toxic])
            expected = float(mix @ (rate[a] * rate[b]))
            spread = math.sqrt(np.prod([mix @ (rate[v] * (1 - rate[v])) for v in (a, b)]))
            if spread > 1e-6:
                out[a, b] = (float(share @ (votes[:, a] * votes[:, b])) - expected) / spread
        return out

    def fit(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray) -> LabelModel:
        if not len(patterns):  # an empty table: as if one document had no votes
            patterns, counts, known = np.array([0]), np.array([1.0]), np.array([-1])
        self._fit(patterns, counts, known)
        # The strongest pair first: once it is one voter, what it lent to others is gone.
        while True:
            self.correlations = np.abs(self._correlations(patterns, counts, known))
            owner = {v: group for group in self.groups for v in group}
            pairs = [
                (self.correlations[a, b], owner[a], owner[b])
                for a, b in combinations(range(len(self.names)), 2)
                if owner[a] != owner[b] and len(owner[a]) + len(owner[b]) <= MOST_LINKED
            ]
            link, first, second = max(pairs, default=(0.0, (), ()))
            if link < LINKED:
                return self
            joint = tuple(sorted(first + second))
            self.groups = sorted([g for g in self.groups if g not in (first, second)] + [joint])
            self._fit(patterns, counts, known)

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """By group: how often it votes at all on clean and on toxic documents."""
        return {
            "+".join(self.names[i] for i in group): tuple(1 - np.exp(t[:, 0]))
            for group, t in zip(self.groups, self.tables)
        }


def fit_label_model(docs, labels, learned, key, text) -> tuple[LabelModel, Column]:
    """The model, and its posterior as a function of the column ``votes``."""
    votes, names = vote_patterns(docs, learned, key, text)
    rows = (
        votes.join(labels, key, "left")
        .groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("known"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    patterns, known, counts = (
        np.array([r[c] for r in rows], np.int64) for c in ("votes", "known", "n")
    )
    model = LabelModel(names).fit(patterns, counts.astype(float), known)
    odds = F.lit(math.log(model.balance / (1 - model.balance)))
    for group, table in zip(model.groups, model.tables):
        value = F.lit(0)
        for place, voter in enumerate(group):
            value = value + F.shiftright("votes", voter).bitwiseAND(F.lit(1)) * (1 << place)
        ratios = F.array(*(F.lit(float(x)) for x in table[1] - table[0]))
        odds = odds + F.get(ratios, value.cast("int"))
    return model, 1 / (1 + F.exp(-odds))


def fit_classifier(
    docs: DataFrame, learned: list[str], posterior: Column, key: str, text: str
) -> tuple[dict[str, float], float]:
    """Weights of words and the intercept, from posterior labels of sampled documents.

    Each document counts as toxic with the weight of its posterior, and as clean with the rest.
    """
    rows = docs.count()
    chosen = _sampled(docs.filter(~held_out(F.col(key))), key, rows, FIT_ROWS)
    body = F.coalesce(F.col(text), F.lit(""))
    # The words travel along in place of the key, so votes and words need no join.
    carried = chosen.select(F.struct(words(body).alias("words")).alias(key), text)
    votes, _ = vote_patterns(carried, learned, key, text)
    marked = votes.select(f"{key}.words", posterior.alias("p"))
    split = marked.select(
        "words", F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")),
        )).alias("side"),
    ).select("words", "side.label", "side.weight").filter("weight > 1e-4")
    split = split.persist()
    try:
        if split.select("label").distinct().count() < 2:
            return {}, -4.0
        vectors = CountVectorizer(
            inputCol="words", outputCol="features", minDF=2 * MIN_DF, vocabSize=VOCABULARY, binary=True
        ).fit(split)
        model = LogisticRegression(
            weightCol="weight", regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=60
        ).fit(vectors.transform(split))
        weights = {
            w: float(c) for w, c in zip(vectors.vocabulary, model.coefficients.toArray()) if c
        }
        return weights, float(model.intercept)
    finally:
        split.unpersist()


def score(text: Column, weights: dict[str, float], intercept: float) -> Column:
    """The classifier's probability: only the words with a weight are looked at."""
    chosen = sorted(weights)
    known = _strings(chosen)
    values = F.from_json(F.lit(json.dumps([weights[w] for w in chosen])), "array<double>")
    hits = wanted_words(text, chosen)
    total = F.aggregate(
        hits, F.lit(float(intercept)),
        lambda acc, w: acc + F.get(values, (F.array_position(known, w) - 1).cast("int")),
    )
    return 1 / (1 + F.exp(-total))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """``key, held_out, score, predicted`` for every document.

    Null and empty texts are scored as texts without words. Rows of ``labels`` with a null in
    key or label are not used; a key that is labelled in two ways is not used either. Without any
    label of one of the classes the fixed lexicons alone train the model. A row with a null key
    counts as not held out. Repeated rows are scored alike; an empty table gives no rows.
    """
    usable = (
        labels.select(F.col(key), F.col(label).cast("int").alias("toxic"))
        .filter(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(key)))
        .groupBy(key)
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most"))
        .filter("toxic = __most")
        .drop("__most")
    )
    body = docs.select(key, text)
    out_of_fold = F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out")
    learned = learn_lexicon(body, usable, usable.count(), key, text)
    _, posterior = fit_label_model(body, usable, learned, key, text)
    weights, intercept = fit_classifier(body, learned, posterior, key, text)
    value = score(F.coalesce(F.col(text), F.lit("")), weights, intercept)
    return body.select(key, out_of_fold, value.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
