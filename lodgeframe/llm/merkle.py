"""A Merkle tree over a table's rows, of which only every few levels are kept; proofs make the others again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.llm.common import numbered, written

#: Levels from one that is written to the next. A task holds the 2 ** LEVELS nodes below a kept one at a time.
LEVELS = 10
#: The only tree of the upper forest, whose leaves are the roots of the others.
ROOT_TREE = ""

NODES = "tree string, place long, digest string"
PATHS = "tree string, place long, root string, path array<string>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as ``-`` if missing, else the number of its UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def levels_above(nodes: list[str], of_tree: int, levels: int) -> list[list[str]]:
    """The given level of an aligned subtree and those above it, up to ``levels`` or the root of its tree.

    ``of_tree`` is how many nodes the whole tree has in the given level: a node on its own has one above it as long as
    the tree has others beside it.
    """
    out = [nodes]
    while len(out) <= levels and of_tree > 1:
        below, of_tree = out[-1], (of_tree + 1) // 2
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(above: list[list[str]], at: int) -> list[str]:
    """For each level but the last, the sibling on the way up: its side (``<`` or ``>``) and digest, or nothing."""
    path = []
    for nodes in above[:-1]:
        other = at ^ 1
        path.append(("<" if other < at else ">") + nodes[other] if other < len(nodes) else "")
        at >>= 1
    return path


def fold(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        if not step:
            leaf = digest(leaf)
        else:
            leaf = digest(step[1:], leaf) if step[0] == "<" else digest(leaf, step[1:])
    return leaf


def proof_digest(path: Sequence[str]) -> str:
    return digest(*[step[1:] for step in path])


def _subtree(table: pa.Table, levels: int) -> tuple[pa.Table, list[list[str]]]:
    """One aligned subtree's nodes in order and its levels."""
    table = table.sort_by("place")
    above = levels_above(table.column("digest").to_pylist(), table.column("of_tree")[0].as_py(), levels)
    return table, above


def _kept(levels: int):
    """The node that is written for a subtree."""

    def of_subtree(table: pa.Table) -> pa.Table:
        table, above = _subtree(table, levels)
        place = table.column("place")[0].as_py() >> levels
        return pa.table({"tree": table.column("tree")[:1], "place": [place], "digest": above[-1]})

    return of_subtree


def _paths(emit: Callable[[pa.Table, dict, list[list[str]]], pa.Table], levels: int):
    def of_subtree(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        # the levels between the written ones live in this call only
        nodes, above = _subtree(nodes, levels)
        node = upper.to_pylist()[0]
        return emit(nodes, node, [siblings(above, at) + node["path"] for at in range(nodes.num_rows)])

    return of_subtree


def _path_table(tree: pa.Array, place: pa.Array, root: list[str], paths: list[list[str]]) -> pa.Table:
    kinds = [("tree", pa.string()), ("place", pa.int64()), ("root", pa.string()), ("path", pa.list_(pa.string()))]
    return pa.table({"tree": tree, "place": place, "root": root, "path": paths}, pa.schema(kinds))


def _inner(nodes: pa.Table, upper: dict, paths: list[list[str]]) -> pa.Table:
    return _path_table(nodes.column("tree"), nodes.column("place"), [upper["root"]] * len(paths), paths)


def _root_paths(nodes: pa.Table, upper: dict, paths: list[list[str]]) -> pa.Table:
    """Of leaves that are the roots of other trees: those trees and their way on."""
    return _path_table(nodes.column("of"), pa.array([0] * len(paths)), nodes.column("digest"), paths)


class Forest:
    """Trees over rows ``tree``, ``place`` (gapless from 0 in each tree) and ``digest``, with any further columns.

    Two neighbours make the node above them, a last one without a neighbour makes it alone, until one is left.
    Kept are the leaves and every ``levels``-th level, each a table 2 ** levels times smaller than the one below.
    """

    def __init__(self, leaves: DataFrame, levels: int = LEVELS):
        self.kept, self.levels = [], levels
        nodes = leaves
        while True:
            nodes = nodes.withColumn("block", F.shiftright("place", levels))
            # a tree's nodes are counted by way of its subtrees, so that no join has a tree as its key
            held = nodes.groupBy("tree", "block").agg(F.count("*").alias("of_block"))
            of_tree = F.sum("of_block").over(Window.partitionBy("tree")).alias("of_tree")
            nodes = written(nodes.join(held.select("tree", "block", of_tree), ["tree", "block"]), "merkle-level")
            self.kept.append(nodes)
            if len(self.kept) > 1 and nodes.where("of_tree > 1").isEmpty():
                break
            nodes = nodes.groupBy("tree", "block").applyInArrow(_kept(levels), NODES)

    @property
    def roots(self) -> DataFrame:
        """``tree`` and ``digest``, one row a tree."""
        return self.kept[-1].select("tree", "digest")

    def proofs(self, rest: DataFrame, emit: Callable, schema: str) -> DataFrame:
        """What ``emit`` makes of each subtree's leaves, their tree's row of ``rest`` and their paths.

        A path has one entry a level, from the leaf up (siblings()), and goes on with ``path`` of ``rest``, which has one row
        ``tree``, ``root``, ``path`` a tree. From the top down, the levels between two kept ones are made again from the
        lower of the two, one aligned subtree at a time, and thrown away with it.
        """
        paths = rest.select("tree", F.lit(0).cast("long").alias("place"), "root", "path")
        for number in range(len(self.kept) - 2, -1, -1):
            each, kind = (_inner, PATHS) if number else (emit, schema)
            below = self.kept[number].groupBy("tree", "block")
            upper = paths.withColumnRenamed("place", "block").groupBy("tree", "block")
            paths = below.cogroup(upper).applyInArrow(_paths(each, self.levels), kind)
        return paths


def ordered_tree(value: Column) -> Column:
    """A tree's name that is never missing and sorts as its value does, a missing one first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def manifest(
    docs: DataFrame, fields: Sequence[str], tree: str, order: str, altered: Column | None = None, levels: int = LEVELS
) -> tuple[Forest, Forest]:
    """The forest of a table's rows by ``tree`` and the forest of its roots: ``(rows, roots)``.

    Each row is a leaf over ``fields`` in their order; a tree's leaves ascend by ``order``, missing ones first, ties by the leaf.
    ``altered``, if given, is kept beside each leaf. Only these narrow rows are sorted and shuffled: leaves get their
    places by ranges, so a tree may hold any share of the rows.
    """
    rows = docs.select(
        ordered_tree(F.col(tree)).alias("tree"),
        F.col(order).alias("id"),
        leaf(*[F.col(c) for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered"),
    )
    placed = numbered(written(rows, "merkle-leaves"), ["tree"], ["id", "digest", "altered"], "place")
    lower = Forest(placed, levels)
    upper = lower.roots.select(F.lit(ROOT_TREE).alias("tree"), F.col("tree").alias("of"), "digest")
    return lower, Forest(numbered(upper, ["tree"], ["of"], "place"), levels)


def _verified(root: str):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def emit(nodes: pa.Table, tree: dict, paths: list[list[str]]) -> pa.Table:
        leaves, altered = (nodes.column(c).to_pylist() for c in ("digest", "altered"))
        folded = [fold(other or one, path) for one, other, path in zip(leaves, altered, paths)]
        columns = [
            leaves,
            [tree["root"]] * len(leaves),
            [root] * len(leaves),
            [proof_digest(path) for path in paths],
            folded,
        ]
        return pa.table(
            [
                nodes.column("id"),
                *[pa.array(c, pa.string()) for c in columns],
                pa.array([f == root for f in folded], pa.bool_()),
            ],
            names=names,
        )

    return emit


def verified_rows(
    docs: DataFrame, fields: Sequence[str], tree: str, key: str, altered: Column | None = None, levels: int = LEVELS
) -> DataFrame:
    """Every row with its leaf, its tree's root ``subroot``, the ``root`` of all trees and its proof, folded again.

    ``proof_sha256`` is the digest of the siblings from the leaf up, ``folded_root`` the root that they give with ``altered``, the
    leaf of a changed row, where it is not missing and with the leaf itself elsewhere; ``verified`` tells
    whether that is ``root``. Trees are ordered by ``tree``, a missing one first. Rows are neither dropped nor merged: repeated
    rows are leaves of their own, and a missing key is a value like others. An empty table gives no rows. Other
    columns are ignored, whatever their names. Texts are hashed where they are read, and go nowhere.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
        "verified boolean"
    )
    rows, roots = manifest(docs, fields, tree, key, altered, levels)
    top = roots.roots.first()
    if top is None:
        return docs.sparkSession.createDataFrame([], schema)
    none = F.lit(None).cast("string")
    rest = roots.roots.select("tree", none.alias("root"), F.expr("cast(array() as array<string>)").alias("path"))
    return rows.proofs(roots.proofs(rest, _root_paths, PATHS), _verified(top["digest"]), schema)
