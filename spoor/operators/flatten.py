"""Nested access-control documents to ordered, distinct rule lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.rules import matches, protocol_tokens, rule_line

# Where the access lists sit in a profile document.
ACL_PATH = "$['ietf-access-control-list:access-lists'].acl"
ACE_PATH = "$.aces.ace"


def reasoned(documents: DataFrame) -> DataFrame:
    """Documents with their ``acls``, size and, where they have none, the ``reason``.

    Without access lists are texts that are no JSON object, or one without the list of them.
    ``acls`` is NULL for them, and only they keep their text. A document that is too large for
    one VARIANT, or that repeats a key, is read list by list.
    """
    text = F.col("text")
    whole = F.try_variant_get(F.try_parse_json(text), ACL_PATH, "array<variant>")
    lists = F.from_json(F.get_json_object(text, ACL_PATH), "array<string>")
    is_object = F.json_object_keys(text).isNotNull()
    acls = F.coalesce(whole, F.when(is_object, F.transform(lists, F.try_parse_json)))
    reason = F.when(is_object, "no access lists").otherwise("no JSON object")
    others = [c for c in documents.columns if c != "text"]
    sized = documents.withColumns({"acls": acls, "original_size": F.length(text).cast("long")})
    lacks = F.col("acls").isNull()
    return sized.select(
        *others, F.when(lacks, text).alias("text"), "acls", "original_size",
        F.when(lacks, reason).alias("reason"),
    )


def parse_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their ``acls``, and apart from them those without any, with a reason.

    The second DataFrame is the quarantine; ``acls`` is NULL for its rows in the first.
    """
    found = reasoned(documents)
    bad = found.filter("reason is not null")
    return found.drop("reason"), bad.drop("acls", "original_size")


def document_sizes(parsed: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, original_size)`` of the documents with access lists.

    Others leave through an explode, as a filter would parse every document twice (see ``render``).
    """
    size = F.when(F.col("acls").isNotNull(), F.col("original_size"))
    return parsed.select(*keys, F.explode(F.array_compact(F.array(size))).alias("original_size"))


def entries(parsed: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, acl_pos, ace_pos, acl_name, ace)``, one row per entry.

    Entries that are no objects are skipped; a list without entries yields none. The outer explode
    only keeps Spark from adding a filter on ``acls``, which would be pushed to the scan and parse
    every document a second time there; what it adds for a document without lists has no entries.
    """
    acls = parsed.select(*keys, F.posexplode_outer("acls").alias("acl_pos", "acl"))
    name = F.coalesce(F.try_variant_get("acl", "$.name", "string"), F.lit(""))
    aces = F.try_variant_get("acl", ACE_PATH, "array<variant>")
    is_object = F.try_variant_get("ace", "$", "map<string, variant>").isNotNull()
    return acls.select(
        *keys, "acl_pos", name.alias("acl_name"), F.posexplode(aces).alias("ace_pos", "ace")
    ).filter(is_object)


def render(found: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, acl_pos, ace_pos, line)`` without empty lines.

    Empty lines leave through an explode and not through a filter, which would be
    pushed below and render every line a second time.
    """
    kept = [*keys, "acl_pos", "ace_pos"]
    blocks = found.select(*kept, "acl_name", matches(F.col("ace")).alias("blocks"))
    tokens = protocol_tokens(F.col("blocks"))
    blocks = blocks.withColumns({f"_{f}": token for f, token in tokens.items()})
    line = rule_line(F.col("acl_name"), F.col("blocks"), {f: F.col(f"_{f}") for f in tokens})
    lines = F.array_compact(F.array(F.nullif(line, F.lit(""))))
    return blocks.select(*kept, F.explode(lines).alias("line"))


def ordered_distinct(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per distinct line of a document, with the place it first occurs at.

    ``order`` columns hold that place; sorting by them gives the document's order.
    """
    first = F.min(F.struct(*order)).alias("first")
    found = lines.groupBy(*keys, "line").agg(first)
    return found.select(*keys, *[F.col("first")[c].alias(c) for c in order], "line")
