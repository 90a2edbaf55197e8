"""Review of a proposal: its folder tree, edits on that tree, and their confirmation.

Folders are few beside files, so edits work on a small tree on the driver; what they come to is a remap table that Spark
applies to all rows.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import common_prefix, prefixes
from ..functions.times import format_day_range, parse_day_range
from ..operators.naming import reclaim
from ..operators.tree import rewrite_prefix, roll_up
from ..schema import APPROVED, PROPOSED


class EditError(ValueError):
    """An edit that the tree doesn't allow."""


@dataclass
class Node:
    id: str
    name: str
    files: int = 0
    samples: list = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    lat: float | None = None
    lon: float | None = None
    merged: list[str] = field(default_factory=list)
    given: bool = False  # named by hand


def folder_table(entries: DataFrame, metadata: DataFrame | None = None, inside: Column | None = None) -> DataFrame:
    """A row for every folder of the reviewable proposal, with files, samples and a location's coordinates."""
    rows = entries.filter(F.col("status").isin(PROPOSED, APPROVED))
    if inside is not None:
        rows = rows.filter(inside)
    if metadata is None:
        return roll_up(rows, path="target_path", id="file_id", sample="source_path")
    m = metadata.select("file_id", "exif_gps_latitude", "exif_gps_longitude")
    return roll_up(rows.join(m, "file_id", "left"), path="target_path", id="file_id", sample="source_path", lat="exif_gps_latitude", lon="exif_gps_longitude")


def build_tree(folders: DataFrame) -> list[Node]:
    nodes, top = {}, []
    for r in folders.orderBy("depth", "node_id").collect():  # one row a folder
        n = Node(r["node_id"], r["name"], r["file_count"], list(r["samples"]), lat=r["lat"], lon=r["lon"])
        nodes[n.id] = n
        (nodes[r["parent_id"]].children if r["parent_id"] in nodes else top).append(n)
    return sort_tree(top)


def sort_tree(tree: list[Node]) -> list[Node]:
    tree.sort(key=lambda n: n.name)
    for n in tree:
        sort_tree(n.children)
    return tree


def find(tree: list[Node], id: str) -> Node | None:
    for n in tree:
        if n.id == id:
            return n
        if got := find(n.children, id):
            return got
    return None


def parent_of(tree: list[Node], id: str) -> Node | None:
    for n in tree:
        if any(c.id == id for c in n.children):
            return n
        if got := parent_of(n.children, id):
            return got
    return None


def _leaves(tree: list[Node]) -> set[str]:
    out = set()
    for n in tree:
        out |= _leaves(n.children) if n.children else {n.id}
    return out


def _fold(into: Node, other: Node) -> None:
    into.files += other.files
    into.samples += other.samples
    into.merged += [other.id, *other.merged]
    for c in other.children:
        same = next((x for x in into.children if x.name == c.name), None)
        if same:
            _fold(same, c)
        else:
            into.children.append(c)


def _prune(tree: list[Node], leaves: set[str]) -> list[Node]:
    out = []
    for n in tree:
        if n.children:
            n.children = _prune(n.children, leaves)
            if not n.children:
                continue
            n.files = sum(c.files for c in n.children)
        elif n.id not in leaves:
            continue
        out.append(n)
    return out


def merge(tree: list[Node], ids: list[str]) -> tuple[list[Node], Node]:
    """One folder for all of ``ids`` under their nearest common ancestor, named as the first, or for plain days by their span."""
    if len(ids) < 2:
        raise EditError("a merge takes two folders or more")
    tree = copy.deepcopy(tree)
    if len(set(ids)) < len(ids):
        raise EditError("a folder to merge is named twice")
    if any(b.startswith(a + "/") for a in ids for b in ids):
        raise EditError("a folder can't be merged with one inside it")
    picked = [find(tree, i) for i in ids]
    if None in picked:
        raise EditError("a folder to merge isn't there")
    above = ids[0]
    for i in ids[1:]:
        above = common_prefix(above, i)
    home = find(tree, above) if above else None
    if home is None:
        raise EditError("the folders have no folder above them in common")
    leaves = _leaves(tree)
    for i in ids:
        if p := parent_of(tree, i):
            p.children = [c for c in p.children if c.id != i]
    first = picked[0]
    days = [parse_day_range(n.name) for n in picked]
    for n in picked[1:]:
        _fold(first, n)
    if all(days):
        first.name = format_day_range(min(d[0] for d in days), max(d[1] for d in days))
    home.children.append(first)
    return sort_tree(_prune(tree, leaves)), first


def drop(tree: list[Node], ids: list[str]) -> list[Node]:
    """Without these folders; what was in them moves up one."""
    tree = copy.deepcopy(tree)
    for i in ids:
        p, n = parent_of(tree, i), find(tree, i)
        if n is None:
            raise EditError("a folder to drop isn't there")
        if p is None:
            raise EditError("a top folder can't be dropped")
        p.children = [c for c in p.children if c.id != i] + n.children
        p.merged += [n.id, *n.merged]
    return sort_tree(tree)


def flatten(tree: list[Node], ids: list[str]) -> tuple[list[Node], int]:
    """All folders below these become part of them; how many did."""
    tree, gone = copy.deepcopy(tree), 0

    def below(n: Node) -> list[str]:
        out = []
        for c in n.children:
            out += [c.id, *c.merged, *below(c)]
        return out

    def count(n: Node) -> int:
        return sum(1 + count(c) for c in n.children)

    for i in ids:
        n = find(tree, i)
        if n is None:
            raise EditError("a folder to flatten isn't there")
        if not n.children:
            raise EditError("there is nothing below to flatten")
        gone += count(n)
        n.merged += below(n)
        n.children = []
    return tree, gone


def plain_name(name: str) -> str:
    """A name as folders bear it: separators, colons, spaces and commas become one hyphen, none at either end."""
    return re.sub(r"-+", "-", re.sub(r"[/\\: ,]", "-", name)).strip(" ._-") or "-"


def rename(tree: list[Node], id: str, name: str) -> list[Node]:
    name = name.strip()
    if not name or "/" in name or name in (".", ".."):
        raise EditError("that isn't a folder name")
    tree = copy.deepcopy(tree)
    n = find(tree, id)
    if n is None:
        raise EditError("the folder isn't there")
    n.name, n.given = plain_name(name), True
    return sort_tree(tree)


class History:
    """Edits that can be undone, the last hundred."""

    def __init__(self, tree: list[Node], most: int = 100):
        self.tree, self._past, self._most = tree, [], most

    def apply(self, edit, *args) -> list[Node]:
        got = edit(self.tree, *args)
        self._past = [*self._past, self.tree][-self._most :]
        self.tree = got[0] if isinstance(got, tuple) else got
        return self.tree

    def undo(self) -> bool:
        if not self._past:
            return False
        self.tree = self._past.pop()
        return True


def remap(tree: list[Node], above: str = "") -> dict[str, str]:
    """Old folder to new folder, of all folders in the tree and those merged into them."""
    out = {}
    for n in tree:
        new = f"{above}/{n.name}" if above else n.name
        for old in (n.id, *n.merged):
            out[old] = new
        out |= remap(n.children, new)
    return out


def given_names(tree: list[Node]) -> list[str]:
    """Names given by hand that aren't days, each once, in order."""
    out = set()
    for n in tree:
        if n.given and not parse_day_range(n.name):
            out.add(n.name)
        out.update(given_names(n.children))
    return sorted(out)


def files_under(entries: DataFrame, node: str) -> DataFrame:
    """file_id, source_path, target_path and status of what can be reviewed below a folder, in order of paths."""
    rows = entries.filter(F.col("status").isin(PROPOSED, APPROVED) & F.col("target_path").startswith(node.rstrip("/") + "/"))
    return rows.select("file_id", "source_path", "target_path", "status").orderBy("target_path", "file_id")


def moved_entries(entries: DataFrame, change: DataFrame, inside: Column | None = None) -> DataFrame:
    """Entries with folders rewritten by a table (old, new): rows that move take names that others leave free, and the rows
    of the slice are approved."""
    open_rows = entries.filter(F.col("status").isin(PROPOSED, APPROVED))
    moved = rewrite_prefix(open_rows, change, path="target_path", out="_new").withColumn("_new", F.coalesce("_new", "target_path"))
    moved = moved.withColumn("_moved", (F.col("_new") != F.col("target_path")).cast("int"))
    named = reclaim(moved.drop("target_path"), path="_new", moved="_moved", order=["file_id"], out="target_path").drop("_new", "_moved")
    cond = (inside if inside is not None else F.lit(True)) & (F.col("status") == PROPOSED)
    named = named.withColumn("status", F.when(cond, APPROVED).otherwise(F.col("status")))
    return named.select(*entries.columns).unionByName(entries.filter(~F.col("status").isin(PROPOSED, APPROVED)))


def confirm(entries: DataFrame, tree: list[Node], inside: Column | None = None) -> DataFrame:
    """Entries after review: every reviewable row's folder rewritten, and the rows of the slice approved.

    An error where nothing can be reviewed, or the tree has a folder that no reviewable row lies in, or a name that isn't one.
    """
    table = remap(tree)
    for old, new in table.items():
        if not old or not new or any(p in ("", ".", "..") for p in new.split("/")):
            raise EditError(f"{old!r} can't become {new!r}")
    spark = entries.sparkSession
    open_rows = entries.filter(F.col("status").isin(PROPOSED, APPROVED))
    if not open_rows.limit(1).count():
        raise EditError("there is no proposal to confirm")
    change = spark.createDataFrame(sorted(table.items()), "old string, new string")
    above = open_rows.select(F.regexp_replace("target_path", r"/?[^/]*\z", "").alias("_dir")).distinct().select(F.explode(prefixes(F.col("_dir"))).alias("old")).distinct()
    unknown = change.join(above, "old", "left_anti").orderBy("old").limit(1).collect()
    if unknown:
        raise EditError(f"{unknown[0]['old']!r} is no folder of the proposal")
    return moved_entries(entries, change, inside)
