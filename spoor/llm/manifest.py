"""A Merkle manifest of a table, kept as append logs in postorder.

Rows are leaves. Per group they ascend by key; runs of two become one node, level by level,
and a run of one becomes a node of its own. The roots of the groups, in order of the groups,
make a tree of the same kind above them.

A builder takes an aligned run of ``2 ** HEIGHT`` leaves and writes every node at the moment it
is complete: a subtree stands right before its own root. So the place of a node follows from the
sizes of the subtrees before it, without any index (``position``), and a proof reads its
siblings from the log by place. The roots of the runs are the leaves of the next layer of
builders, which makes log(n) / HEIGHT layers. No task holds more than one run, and a layer is
written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spoor.llm.common import Scratch
from spoor.session import ship_package

#: Levels of one builder; a run of 1,024 leaves makes a log of at most 2,047 digests and a spine.
HEIGHT = 10
RUN = 1 << HEIGHT
#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_LOG = "array<string>"


# ---------------------------------------------------------------- one log


def digest(text: str) -> str:
    return sha256(text.encode("utf-8")).hexdigest()


def position(level: int, index: int, leaves: int) -> int:
    """The place in the log of the node at ``level`` that is ``index``-th from the left.

    The ``e`` leaves up to the end of a whole subtree leave ``2 e - bits(e)`` nodes in the log,
    as each set bit of ``e`` is a whole tree that still waits for its right side. Nodes over
    the ragged end come last, from the lowest level upwards.
    """
    end = (index + 1) << level
    if end <= leaves:
        return 2 * (end - 1) - (end - 1).bit_count() + level
    whole_levels = (leaves & -leaves).bit_length()
    return 2 * leaves - leaves.bit_count() + level - whole_levels


def height_of(leaves: int) -> int:
    return (leaves - 1).bit_length()


def build_log(leaves: Sequence[str], height: int) -> list[str]:
    """All nodes of one tree in the order of their completion; the last one is the root."""
    log: list[str] = []
    waiting: list[tuple[int, str]] = []
    for leaf in leaves:
        level, node = 0, leaf
        log.append(node)
        while waiting and waiting[-1][0] == level:
            node, level = digest(waiting.pop()[1] + node), level + 1
            log.append(node)
        waiting.append((level, node))
    level, node = waiting.pop()
    for level in range(level, height):
        left = waiting.pop()[1] if waiting and waiting[-1][0] == level else ""
        node = digest(left + node)
        log.append(node)
    return log


def proof(log: Sequence[str], leaf: int, leaves: int, height: int) -> list[str]:
    """Steps from a leaf to the root: ``L`` or ``R`` and the sibling's digest, or ``-``."""
    steps = []
    for level in range(height):
        index = leaf >> level
        sibling = index ^ 1
        if sibling << level >= leaves:
            steps.append("-")
        else:
            steps.append("LR"[sibling > index] + log[position(level, sibling, leaves)])
    return steps


def fold(leaf: str, steps: Sequence[str]) -> str:
    """The root that a leaf and its steps lead to."""
    for step in steps:
        if step[0] == "L":
            leaf = digest(step[1:] + leaf)
        else:
            leaf = digest(leaf + step[1:])
    return leaf


# ---------------------------------------------------------------- layers


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the UTF-8 byte count, a colon, the value."""
    parts = []
    for value in values:
        as_text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(as_text), F.lit(":"), as_text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _numbered(rows: DataFrame, scratch: Scratch, order: list) -> DataFrame:
    """Adds ``at``, the place within ``grp``, and ``leaves``, the number of its rows.

    Rows are sorted in ranges, one per task; the rows of a group in the ranges before shift the
    places. ``order`` must tell equal rows apart, so that no range has to hold them all.
    """
    ranged = scratch.put(
        rows.repartitionByRange("grp", *order)
        .sortWithinPartitions("grp", *order)
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    )
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("grp", "part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
        .select(
            "grp", "part", F.sum("n").over(whole).alias("leaves"),
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        )
    )
    return ranged.join(shifts, ["grp", "part"]).withColumn(
        "at", F.col("row") + F.col("shift")
    ).drop("part", "row", "shift")


def _builder(extra: list[str], schema: pa.Schema):
    """One aligned run of leaves to one row that holds its log."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        leaves = rows["leaves"][0].as_py()
        height = HEIGHT if leaves > RUN else height_of(leaves)
        log = build_log(rows["node"].to_pylist(), height)
        row = {
            "grp": key[0].as_py(), "run": key[1].as_py(), "n": len(rows), "height": height,
            "runs": -(-leaves // RUN), "root": log[-1], "log": log,
        }
        row |= {name: rows[name].to_pylist() for name in extra}
        return pa.Table.from_pylist([row], schema=schema)

    return build


def _logs(nodes: DataFrame, scratch: Scratch, extra: list[str]) -> DataFrame:
    """One row per aligned run: ``grp, run, n, height, runs, root, log`` and lists of ``extra``."""
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    fields = [("grp", pa.string()), ("run", pa.int64()), ("n", pa.int64()), ("height", pa.int64()),
              ("runs", pa.int64()), ("root", pa.string()), ("log", pa.list_(pa.string()))]
    fields += [(name, pa.list_(to_arrow_type(kinds[name]))) for name in extra]
    ddl = "grp string, run long, n long, height long, runs long, root string, log " + _LOG
    ddl += "".join(f", `{name}` array<{kinds[name].simpleString()}>" for name in extra)
    run = F.shiftright("at", HEIGHT).alias("run")
    return scratch.put(
        nodes.select("grp", run, "at", "leaves", "node", *extra)
        .groupBy("grp", "run")
        .applyInArrow(_builder(extra, pa.schema(fields)), ddl)
    )


def _layers(nodes: DataFrame, scratch: Scratch, extra: list[str]) -> list[DataFrame]:
    """Logs from the leaves upwards, until every group is one run."""
    layers = [_logs(nodes, scratch, extra)]
    while not layers[-1].filter("runs > 1").isEmpty():
        upper = layers[-1].filter("runs > 1").select(
            "grp", F.col("run").alias("at"), F.col("runs").alias("leaves"),
            F.col("root").alias("node"),
        )
        layers.append(_logs(upper, scratch, []))
    return layers


def _over_rows(df: DataFrame, work, schema: str) -> DataFrame:
    """Map rows that are large each; a row may give many, in batches of one run."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield work(batch.slice(at, 1).to_pylist()[0])

    return df.mapInArrow(run, schema)


def _descend(layers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest layer with ``path``: the steps from a run's root to the root above ``tops``."""
    paths = tops.withColumn("run", F.lit(0).cast("long"))
    schema = f"grp string, path {_LOG}, run long"

    def members(row):
        n, height = row["n"], row["height"]
        steps = [proof(row["log"], i, n, height) + row["path"] for i in range(n)]
        first = row["run"] * RUN
        return pa.record_batch(
            [pa.array([row["grp"]] * n, pa.string()), pa.array(steps, pa.list_(pa.string())),
             pa.array(range(first, first + n), pa.int64())],
            names=["grp", "path", "run"],
        )

    for layer in reversed(layers[1:]):
        lower = _over_rows(layer.join(paths, ["grp", "run"]), members, schema)
        paths = lower.unionByName(paths.join(layer.select("grp").distinct(), "grp", "left_anti"))
    return layers[0].join(paths, ["grp", "run"])


class Manifest:
    """Logs of all layers, the roots of the groups and the root of the table (None if empty)."""

    def __init__(
        self, docs: DataFrame, key: str = "doc_id", group: str | None = "lang",
        fields: Sequence[str] = FIELDS, presented: dict[str, Column] | None = None,
    ):
        """``presented`` gives other values for some fields, as a doubted copy holds them."""
        self.scratch = Scratch(docs.sparkSession)
        self.key = key
        # No group name can equal the mark of null rows, and null comes first.
        grp = F.lit("") if group is None else F.coalesce(
            F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")
        )
        leaf = leaf_digest([F.col(c) for c in fields])
        offered = leaf_digest([(presented or {}).get(c, F.col(c)) for c in fields])
        rows = self.scratch.put(
            docs.select(
                grp.alias("grp"), F.col(key).alias("key"), leaf.alias("node"),
                offered.alias("offered") if presented else F.lit(None).cast("string").alias("offered"),
                F.monotonically_increasing_id().alias("tie"),
            ).withColumn("offered", F.nullif("offered", "node"))
        )
        ordered = _numbered(rows, self.scratch, ["key", "node", "tie"])
        self.layers = _layers(ordered, self.scratch, ["key", "offered"])
        self.subroots = self.scratch.put(
            self.layers[0].filter("runs = 1").select("grp", F.col("root").alias("subroot")).unionByName(
                self._upper("runs = 1")
            )
        )
        above = self.subroots.select(
            F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("node")
        )
        self.top = _layers(_numbered(above, self.scratch, ["key"]), self.scratch, ["key"])
        found = self.top[-1].filter("runs = 1").first()
        self.root = found["root"] if found else None

    def _upper(self, condition: str) -> DataFrame:
        """Roots of the groups that end above the first layer."""
        none = self.layers[0].limit(0).select("grp", F.col("root").alias("subroot"))
        for layer in self.layers[1:]:
            none = none.unionByName(
                layer.filter(condition).select("grp", F.col("root").alias("subroot"))
            )
        return none

    def _paths(self) -> DataFrame:
        """Runs of leaves with the steps from their root to the root of the table."""
        start = self.top[-1].filter("runs = 1").select(
            "grp", F.array().cast(_LOG).alias("path")
        )
        schema = f"grp string, path {_LOG}"

        def groups(row):
            steps = [
                proof(row["log"], i, row["n"], row["height"]) + row["path"] for i in range(row["n"])
            ]
            return pa.record_batch(
                [pa.array(row["key"], pa.string()), pa.array(steps, pa.list_(pa.string()))],
                names=["grp", "path"],
            )

        tops = self.scratch.put(_over_rows(_descend(self.top, start), groups, schema))
        return _descend(self.layers, tops).join(self.subroots, "grp")

    def proofs(self, steps: bool = True) -> DataFrame:
        """``key, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]`` per row.

        ``proof_sha256`` hashes the siblings. ``folded_root`` is what the presented row and the
        siblings of the original lead to; ``verified`` says whether that is the root.
        """
        root, key = self.root, self.key
        kind = dict(self.layers[0].dtypes)["key"][len("array<"):-1]
        key_type = self.layers[0].schema["key"].dataType.elementType
        schema = (
            f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, "
            f"folded_root string, verified boolean" + (f", proof {_LOG}" if steps else "")
        )
        arrow_key = to_arrow_type(key_type)

        def prove(row):
            n, height, log = row["n"], row["height"], row["log"]
            out = {name: [] for name in ("leaf", "sha", "folded", "proof")}
            for i in range(n):
                path = proof(log, i, n, height) + row["path"]
                leaf = log[position(0, i, n)]
                out["leaf"].append(leaf)
                out["sha"].append(digest("".join(step[1:] for step in path)))
                out["folded"].append(fold(row["offered"][i] or leaf, path))
                if steps:
                    out["proof"].append(path)
            columns = [
                pa.array(row["key"], arrow_key), pa.array(out["leaf"]),
                pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array(out["sha"]),
                pa.array(out["folded"]), pa.array([x == root for x in out["folded"]]),
            ]
            names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            if steps:
                columns.append(pa.array(out["proof"], pa.list_(pa.string())))
                names.append("proof")
            return pa.record_batch(columns, names=names)

        return _over_rows(self._paths(), prove, schema)

    def nodes(self) -> DataFrame:
        """``grp, position, level, digest``: the logs of the groups as one table.

        ``grp`` is empty for the null group, else ``=`` and the name.
        """
        sizes = self.layers[0].groupBy("grp").agg(F.sum("n").alias("leaves"))
        schema = "grp string, position long, level long, digest string"
        out = None
        for depth, layer in enumerate(self.layers):

            def place(row, depth=depth):
                n, height = row["n"], row["height"]
                found = []
                for level in range(1 if depth else 0, height + 1):
                    for index in range(-(-n >> level)):
                        at = (row["run"] << (HEIGHT - level)) + index
                        whole = position(depth * HEIGHT + level, at, row["leaves"])
                        found.append((whole, depth * HEIGHT + level,
                                      row["log"][position(level, index, n)]))
                columns = list(zip(*found)) or [(), (), ()]
                return pa.record_batch(
                    [pa.array([row["grp"]] * len(found), pa.string()),
                     pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.string())],
                    names=["grp", "position", "level", "digest"],
                )

            part = _over_rows(layer.join(sizes, "grp"), place, schema)
            out = part if out is None else out.unionByName(part)
        return out


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str | None = "lang",
    fields: Sequence[str] = FIELDS, presented: dict[str, Column] | None = None,
    steps: bool = False,
) -> DataFrame:
    """Proofs of all rows of ``docs`` against the root of the table, see ``Manifest.proofs``.

    A null field is hashed as ``-``, and so differs from an empty text. Null groups make a group
    that comes before the others, null keys come first in their group. Rows with one key follow
    each other by their leaf; equal rows are leaves of their own. A table of one row has its
    leaf as root and an empty proof. An empty table gives no rows. Other columns are not read.
    """
    return Manifest(docs, key, group, fields, presented).proofs(steps)
