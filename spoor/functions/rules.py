"""Render one access-control entry as one short line of text.

The blocks of an entry are maps of VARIANT values, because the rules for a field
tell a key that is *present* (even with a null value) from a value that is
*non-empty*.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readable names of IP protocol numbers.
PROTOCOL_NAMES = {2: "igmp", 6: "tcp", 17: "udp", 58: "icmpv6"}

# The blocks of an entry and the keys that make up a line.
MUD, ETH = "ietf-mud:mud", "eth"
FAMILIES, LAYERS = ("ipv4", "ipv6"), ("tcp", "udp")
DIRECTION_KEY = "ietf-mud:direction-initiated"
SRC_DNS_KEY, DST_DNS_KEY = "ietf-acldns:src-dnsname", "ietf-acldns:dst-dnsname"

# How values without content look as text, the empty string aside.
EMPTY = r"^(?:-?0(?:\.0*)?(?:[eE][-+]?[0-9]+)?|false|\[\]|\{\})$"

MATCHES_TYPE = (
    "struct<"
    + ", ".join(f"`{block}`: map<string, variant>" for block in (MUD, ETH, *FAMILIES, *LAYERS))
    + ">"
)


def matches(entry: Column) -> Column:
    """The blocks of an entry, all taken in one pass over the VARIANT."""
    return F.try_variant_get(entry, "$.matches", MATCHES_TYPE)


def _get(block: Column, key: str) -> Column:
    return F.try_element_at(block, F.lit(key))


def _value(raw: Column) -> Column:
    return F.try_variant_get(raw, "$", "string")


def _text(raw: Column) -> Column:
    """Text of a present key; a JSON null reads ``None``, a missing key is NULL."""
    return F.when(F.is_variant_null(raw), F.lit("None")).otherwise(_value(raw))


def _filled(raw: Column) -> Column:
    """Text of a key that holds a non-empty value, else NULL.

    Empty are the empty string, list and object, zero and false, but not their text.
    """
    value = _value(raw)
    empty = value.rlike(EMPTY) & (F.schema_of_variant(raw) != "STRING")
    return F.when((value != "") & ~F.coalesce(empty, F.lit(False)), value)


def protocol_label(number: Column, text: Column) -> Column:
    """Readable protocol name; anything without a known number stays as text."""
    names = F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, number), text)


def direction_label(acl_name: Column) -> Column:
    return F.when(acl_name.startswith("from-"), "egress").when(
        acl_name.startswith("to-"), "ingress"
    )


def controller_hint(controller: Column) -> Column:
    """Last part of a URN such as ``urn:x:dns``."""
    return F.concat(F.lit("controller:"), F.substring_index(controller, ":", -1))


def _endpoint(block: Column, prefix: str, dns_key: str, network_key: str) -> Column:
    name = F.coalesce(_filled(_get(block, dns_key)), _text(_get(block, network_key)))
    return F.concat(F.lit(prefix), name)


def _protocol_token(block: Column) -> Column:
    raw = _get(block, "protocol")
    return protocol_label(F.try_variant_get(raw, "$", "int"), _text(raw))


def _annotate(tokens: dict[str, Column], block: Column, layer: str) -> dict[str, Column]:
    """Add the initiating side to the first protocol token that names ``layer``."""
    side = _filled(_get(block, DIRECTION_KEY))
    marked = F.concat(F.lit(f"{layer} (direction-initiated:"), side, F.lit(")"))
    out, taken = {}, F.lit(False)
    for family, token in tokens.items():
        here = F.coalesce((token == layer) & side.isNotNull() & ~taken, F.lit(False))
        out[family] = F.when(here, marked).otherwise(token)
        taken = taken | here
    return out


def _port(block: Column, key: str, prefix: str) -> Column:
    port = F.try_variant_get(_get(block, key), "$.port", "variant")
    return F.concat(F.lit(prefix), _text(port))


def protocol_tokens(blocks: Column) -> dict[str, Column]:
    """The protocol token of each family, with the initiating side where one is known."""
    tokens = {f: _protocol_token(blocks[f]) for f in FAMILIES}
    for layer in LAYERS:
        tokens = _annotate(tokens, blocks[layer], layer)
    return tokens


def rule_line(acl_name: Column, blocks: Column, tokens: dict[str, Column]) -> Column:
    """One line per entry; tokens that do not apply are NULL and fall out."""
    mud, eth = blocks[MUD], blocks[ETH]
    parts = [
        direction_label(acl_name),
        controller_hint(_filled(_get(mud, "controller"))),
        F.when(_get(mud, "local-networks").isNotNull(), "local"),
        F.concat(F.lit("eth:"), _text(_get(eth, "ethertype"))),
        F.concat(F.lit("mac:"), _text(_get(eth, "destination-mac-address"))),
    ]
    for f in FAMILIES:
        block = blocks[f]
        parts += [
            F.when(F.size(block) > 0, f),
            tokens[f],
            _endpoint(block, "src:", SRC_DNS_KEY, f"source-{f}-network"),
            _endpoint(block, "dst:", DST_DNS_KEY, f"destination-{f}-network"),
        ]
    for layer in LAYERS:
        parts += [
            _port(blocks[layer], "source-port", "src-port:"),
            _port(blocks[layer], "destination-port", "dst-port:"),
        ]
    return F.concat_ws(" ", *parts)
