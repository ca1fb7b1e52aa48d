"""Personal numbers and dates replaced by keyed permutations within their format.

A value that passes its check (Luhn, mod 97, octets, calendar) is permuted by a Feistel network
over its own format: a card becomes another card with a right check digit, a date another date,
an address another address. The permutation depends on the key and the kind only, so equal
values get equal pseudonyms in every document and different values different ones. All of it
is SQL functions; round functions are SHA-512 of key, kind, round and the other half.

Cards and printed IBANs are looked for at each group of a whole run of groups, the usual groupings
first, so that a number beside one does not hide it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import free_names
from spoor.llm.spans import matches, pieces

ROUNDS = 8

#: The forms, tried in this order at each place.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}+\.)"
    r"(?:[A-Za-z0-9-]{1,63}+\.){0,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}"
    r"|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9./-]*[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]*[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?"
    r"|\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-](?=[0-9]{3}[.-][0-9]{4}))"
    r"[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    "e164": r"(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: A printed IBAN: groups of four, the last of one to four.
SPACED_IBAN = r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?"
#: A run ends before a value that is a match of its own.
_OWN = "|".join(FORMS[kind] for kind in ("ipv4", "date", "ssn", "phone")) + (
    r"|[A-Za-z0-9._%+-]{1,64}+@"
)
#: Groups of 13 digits or more, or of an IBAN's head and what follows. Possessive, so that long
#: runs are read without recursion.
RUN = (
    r"(?:(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= [A-Z0-9]{4} [A-Z0-9]{3,4}(?![A-Za-z0-9]))"
    rf"(?: (?!{_OWN})[A-Z0-9]{{1,4}}(?![A-Za-z0-9]))++"
    r"|(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++)"
    rf"(?:[ -](?!{_OWN})[0-9]++)*+"
)
ANY = "|".join([*(form for kind, form in FORMS.items() if kind != "card"), RUN])
#: Digits by group of the usual cards, and how their numbers start.
GROUPINGS = ("4 4 4 4", "4 4 4 4 3", "4 6 5", "4 6 4")
ISSUERS = "^(?:[3-6]|2[2-7])"
#: A 400-year cycle of the calendar has 189 * 773 days; dates outside it stay.
FIRST_DAY, LEFT_DAYS, RIGHT_DAYS = "1700-01-01", 189, 773


def _number(seed: Column, digits: int = 13) -> Column:
    """A non-negative number from the start of a digest of ``seed``."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, digits), 16, 10).cast("long")


def _seed(key: str, kind: str, turn: int, other: Column) -> Column:
    return F.concat(F.lit(f"{key}|{kind}|{turn}|"), other.cast("string"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: a list of one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _classes(chars: Column) -> Column:
    """Characters as (place in their class, size of the class, first code, character)."""

    def one(c):
        code = F.ascii(c)

        def member(first, size):
            return F.struct(
                (code - first).alias("v"), F.lit(size).alias("m"), F.lit(first).alias("b"),
                c.alias("c"),
            )

        return (
            F.when(c.between("0", "9"), member(48, 10))
            .when(c.between("a", "z"), member(97, 26))
            .when(c.between("A", "Z"), member(65, 26))
            .otherwise(F.struct(
                F.lit(0).alias("v"), F.lit(1).alias("m"), F.lit(0).alias("b"), c.alias("c")
            ))
        )

    return F.transform(chars, one)


def _written(cells: Column) -> Column:
    return F.array_join(F.transform(
        cells, lambda x: F.when(x["m"] == 1, x["c"]).otherwise(F.char(x["b"] + x["v"]))
    ), "")


def _fpe(value: Column, key: str, kind: str) -> Column:
    """Permute letters and digits of a string, each within its class; the rest stays.

    A balanced Feistel network over the two halves of the string: in each round every cell of
    one half is shifted by a byte of the digest of the other half.
    """
    cells = _classes(F.split(value, ""))
    middle = F.ceil(F.size(cells) / 2).cast("int")
    state = F.struct(
        F.slice(cells, F.lit(1), middle).alias("l"),
        F.slice(cells, middle + 1, F.size(cells)).alias("r"),
    )

    def turn_of(turn: int):
        moved, kept = ("l", "r") if turn % 2 else ("r", "l")

        def turn_state(s):
            seed = _seed(key, kind, turn, _written(s[kept]))

            def shift(x, i, digest):
                byte = F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                return F.struct(
                    ((x["v"] + byte) % x["m"]).cast("int").alias("v"), x["m"].alias("m"),
                    x["b"].alias("b"), x["c"].alias("c"),
                )

            new = _let(F.sha2(seed, 512), lambda d: F.transform(s[moved], lambda x, i: shift(x, i, d)))
            halves = {moved: new, kept: s[kept]}
            return F.struct(halves["l"].alias("l"), halves["r"].alias("r"))

        return turn_state

    state = reduce(lambda s, turn: _let(s, turn_of(turn)), range(ROUNDS), state)
    return _let(state, lambda s: F.concat(_written(s["l"]), _written(s["r"])))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    marks = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2 % 10) + F.floor(c.cast("int") * 2 / 10)
        ).cast("int"),
    )
    return F.aggregate(marks, F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str) -> Column:
    body = F.substr(value, F.lit(1), F.length(value) - 1)
    new = _fpe(body, key, "card")
    return _let(new, lambda n: F.concat(
        n, ((10 - _luhn(F.concat(_digits(n), F.lit("0"))) % 10) % 10).cast("string")
    ))


def _mod97(value: Column) -> Column:
    """Remainder by 97 of an IBAN with its first four characters put last."""
    turned = F.concat(F.substr(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def step(rest, c):
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise(
            (rest * 100 + F.ascii(c) - 55) % 97
        )

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    country = F.substring(value, 1, 2)
    body = _fpe(F.substr(value, F.lit(5), F.length(value)), key, "iban")
    return _let(body, lambda b: F.concat(
        country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b
    ))


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda o: o.cast("long"))


def _ipv4(value: Column, key: str) -> Column:
    o = _octets(value)
    left, right = (F.element_at(o, i) * 256 + F.element_at(o, i + 1) for i in (1, 3))
    left, right = _chain(left, right, (1 << 16, 1 << 16), key, "ipv4")
    return _let(F.struct(left.alias("l"), right.alias("r")), lambda s: F.concat_ws(".", *(
        part.cast("string")
        for half in (s["l"], s["r"]) for part in (F.floor(half / 256), half % 256)
    )))


def _chain(left: Column, right: Column, sizes, key: str, kind: str):
    """A permutation of pairs (left, right) below ``sizes``: each half is shifted by the other."""
    def step_of(turn: int):
        def step(s):
            new_left, new_right = s["l"], s["r"]
            if turn % 2:
                new_left = (s["l"] + _number(_seed(key, kind, turn, s["r"]))) % sizes[0]
            else:
                new_right = (s["r"] + _number(_seed(key, kind, turn, s["l"]))) % sizes[1]
            return F.struct(new_left.alias("l"), new_right.alias("r"))

        return step

    state = F.struct(left.alias("l"), right.alias("r"))
    state = reduce(lambda s, turn: _let(s, step_of(turn)), range(ROUNDS), state)
    return state["l"], state["r"]


#: A date's look and the pattern that reads and writes it.
DATE_FORMATS = {
    r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{2}\.": "dd.MM.yyyy", r"^[0-9]{2}/": "MM/dd/yyyy",
}


def _day(value: Column) -> Column:
    """Days since ``FIRST_DAY``, or null where it is no date of the cycle."""
    out = F.lit(None).cast("long")
    for look, form in DATE_FORMATS.items():
        day = F.datediff(F.try_to_date(value, form), F.lit(FIRST_DAY).cast("date")).cast("long")
        out = F.when(value.rlike(look), day).otherwise(out)
    return F.when(out.between(0, LEFT_DAYS * RIGHT_DAYS - 1), out)


def _date(value: Column, key: str) -> Column:
    day = _day(value)
    left, right = _chain(
        F.floor(day / RIGHT_DAYS), day % RIGHT_DAYS, (LEFT_DAYS, RIGHT_DAYS), key, "date"
    )
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (left * RIGHT_DAYS + right).cast("int"))
    out = F.date_format(new, "yyyy-MM-dd")
    for look, form in DATE_FORMATS.items():
        out = F.when(value.rlike(look), F.date_format(new, form)).otherwise(out)
    return out


def _email(value: Column, key: str) -> Column:
    name = F.regexp_extract(value, r"^(.*)(\.[A-Za-z]+)$", 1)
    return F.concat(_fpe(name, key, "email"), F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1))


def _valid_ssn(value: Column) -> Column:
    return ~value.rlike("^(?:000|666|9)|-00-|-0000$")


def _ssn(value: Column, key: str) -> Column:
    """Valid numbers are permuted among themselves, by their place in a list of all of them."""
    area, group, serial = (
        F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4))
    )
    areas = area - F.when(area > 666, 2).otherwise(1)
    left, right = _chain(areas * 99 + group - 1, serial - 1, (898 * 99, 9999), key, "ssn")

    def written(s):
        place = F.floor(s["l"] / 99)
        return F.concat_ws(
            "-", F.lpad((place + F.when(place >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"),
            F.lpad((s["r"] + 1).cast("string"), 4, "0"),
        )

    return _let(F.struct(left.alias("l"), right.alias("r")), written)


def _phone(value: Column, key: str) -> Column:
    """The country code stays; digits after it are permuted."""
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-])[ .-]?|\+[0-9]{2}|)", 1)
    rest = F.substr(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _fpe(rest, key, "phone"))


def kind_of(value: Column) -> Column:
    """The kind of a match, or null if it fails the check of its kind."""
    def whole(kind):
        return value.rlike("^(?:" + FORMS[kind] + ")$")

    octets = F.forall(_octets(value), lambda o: o <= 255)
    return (
        F.when(value.contains("@"), "email")
        .when(whole("iban"), F.when(_mod97(value) == 1, "iban"))
        .when(whole("ipv4"), F.when(octets, "ipv4"))
        .when(whole("date"), F.when(_day(value).isNotNull(), "date"))
        .when(whole("ssn"), F.when(_valid_ssn(value), "ssn"))
        .when(
            F.length(_digits(value)).between(13, 19) & ~value.contains("+") & ~value.contains("(")
            & ~value.contains("."),
            F.when(_luhn(_digits(value)) % 10 == 0, "card"),
        )
        .when(F.length(_digits(value)).between(7, 15), "phone")
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(value, key))
        .when(kind == "iban", _let(
            _let(F.replace(value, F.lit(" "), F.lit("")), lambda v: _iban(v, key)),
            lambda new: F.when(value.contains(" "), _spaced(new)).otherwise(new),
        ))
        .when(kind == "ipv4", _ipv4(value, key))
        .when(kind == "date", _date(value, key))
        .when(kind == "card", _card(value, key))
        .when(kind == "ssn", _ssn(value, key))
        .when(kind == "phone", _phone(value, key))
        .otherwise(value)
    )


def _window_at(rest: Column, i: Column, n: Column) -> Column:
    """The first ``n`` groups of ``rest``, which starts at group ``i`` of a run, as (rank, turn,
    at, size); the rank is lower for a surer find, null for none."""
    def judged(part):
        usual = F.array_join(F.transform(part, F.length), " ").isin(*GROUPINGS)

        def rank(digits):
            card = digits.rlike("^[0-9]{13,19}$")
            return F.when(
                digits.rlike("^[A-Z]") & F.array_join(part, " ").rlike(f"^{SPACED_IBAN}$"),
                F.when(_mod97(digits) == 1, 0),
            ).when(card, F.when(_luhn(digits) % 10 == 0, F.when(n == 1, 0).when(
                usual, F.when(digits.rlike(ISSUERS), 1).otherwise(2)
            ).otherwise(3)))

        # Of the usual groupings the shorter is the likelier, of the others the longer.
        return _let(_let(F.array_join(part, ""), rank), lambda r: F.struct(
            r.alias("rank"), F.when(r.isin(1, 2), n).otherwise(-n).alias("turn"),
            i.alias("at"), n.alias("size"),
        ))

    return _let(F.slice(rest, F.lit(1), n), judged)


def _chosen(groups: Column) -> Column:
    """Windows that do not overlap: the leftmost, unless a surer one starts within it."""
    def best(i):
        """The surest window that starts at group ``i``, or null."""
        return _let(F.slice(groups, i + 1, F.lit(20)), lambda rest: F.array_min(F.filter(
            F.transform(
                F.sequence(F.lit(1), F.least(F.size(rest), F.lit(19))),
                lambda n: _window_at(rest, i, n),
            ),
            lambda w: w["rank"].isNotNull(),
        )))

    found = F.filter(
        F.transform(F.sequence(F.lit(0), F.size(groups) - 1), best), lambda w: w.isNotNull()
    )

    def surest(all_found):
        return F.filter(all_found, lambda w, k: ~F.exists(
            F.slice(all_found, k + 2, F.lit(20)),
            lambda v: (v["at"] < w["at"] + w["size"]) & (v["rank"] < w["rank"]),
        ))

    kind = "array<struct<at:int,size:int>>"
    empty = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("out"))

    def step(state, w):
        one = F.array(F.struct(w["at"].alias("at"), w["size"].alias("size")))
        return F.when(w["at"] < state["free"], state).otherwise(F.struct(
            (w["at"] + w["size"]).alias("free"), F.concat(state["out"], one).alias("out")
        ))

    return F.aggregate(_let(found, surest), empty, step, lambda state: state["out"])


def _spaced(iban: Column) -> Column:
    return F.regexp_replace(iban, "(.{4})(?=.)", "$1 ")


#: A stretch of a match: its kind, null where it stays, and its text.
_PARTS = "array<struct<kind:string,text:string>>"


def _run(value: Column) -> Column:
    """A run of groups cut into its cards and printed IBANs and what is between them."""
    # Each group with the separator before it.
    cells = F.zip_with(
        F.split(value, "[ -]"),
        F.concat(F.array(F.lit("")), F.regexp_extract_all(value, F.lit("[ -]"), F.lit(0))),
        lambda g, lead: F.struct(g.alias("group"), lead.alias("lead")),
    )

    def text(cells, first, n):
        return F.array_join(F.transform(
            F.slice(cells, first + 1, n), lambda c: F.concat(c["lead"], c["group"])
        ), "")

    def part(kind, text):
        return F.struct(kind.cast("string").alias("kind"), text.alias("text"))

    def written(cells, chosen):
        def two(w, k):
            before = F.element_at(chosen, F.greatest(k, F.lit(1)))
            end = F.when(k == 0, 0).otherwise(before["at"] + before["size"])
            first = F.element_at(cells, w["at"] + 1)
            found = F.concat(first["group"], text(cells, w["at"] + 1, w["size"] - 1))
            return F.array(
                part(F.lit(None), F.concat(text(cells, end, w["at"] - end), first["lead"])),
                part(F.when(found.rlike("^[A-Z]"), "iban").otherwise("card"), found),
            )

        last = F.element_at(chosen, -1)
        rest = text(cells, last["at"] + last["size"], F.size(cells) - last["at"] - last["size"])
        return F.when(F.size(chosen) == 0, F.array(part(F.lit(None), value))).otherwise(F.concat(
            F.flatten(F.transform(chosen, two)), F.array(part(F.lit(None), rest))
        ))

    return _let(cells, lambda cells: _let(
        _let(F.transform(cells, lambda c: c["group"]), _chosen),
        lambda chosen: written(cells, chosen),
    ))


def pseudonymise(
    docs: DataFrame, text: str = "text", *, key: str, kinds: str | None = None
) -> DataFrame:
    """``docs`` with the personal values of ``text`` replaced; other columns stay as they are.

    Whoever knows ``key`` can invert the pseudonyms; there is no default.

    ``kinds`` names an optional new column with the kinds replaced, in order of place. A null
    text stays null, an empty one empty. Matches that fail their check stay as they are.
    """
    body = F.col(f"`{text}`")
    found = matches(body, ANY)

    def judged(m):
        groups = m.rlike("^(?:[A-Z]{2}[0-9]{2} |[0-9](?:[ -]?[0-9]){12})") & ~m.contains("@")
        one = F.array(F.struct(kind_of(m).alias("kind"), m.alias("text")))
        parts = F.when(groups, _run(m)).otherwise(one).cast(_PARTS)
        return _let(parts, lambda parts: F.struct(
            F.filter(F.transform(parts, lambda p: p["kind"]), lambda k: k.isNotNull()).alias("kinds"),
            F.array_join(F.transform(parts, lambda p: F.coalesce(
                pseudonym(p["text"], p["kind"], key), p["text"]
            )), "").alias("new"),
        ))

    found_in, new_in = free_names(docs, "found", "new")
    marked = docs.withColumn(found_in, F.when(body.rlike(r"[0-9@]"), found)).withColumn(
        new_in, F.when(F.size(found_in) > 0, F.transform(found_in, judged))
    )
    between = pieces(body, ANY)
    rest = F.concat(F.transform(new_in, lambda n: n["new"]), F.array(F.lit("")))
    written = F.array_join(F.zip_with(between, rest, lambda a, b: F.concat(a, b)), "")
    out = marked.withColumn(text, F.when(F.col(new_in).isNotNull(), written).otherwise(body))
    if kinds:
        names = F.when(
            F.col(new_in).isNotNull(),
            F.flatten(F.transform(new_in, lambda n: n["kinds"])),
        ).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(kinds, names)
    return out.drop(found_in, new_in)
