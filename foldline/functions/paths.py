"""Paths as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def under(dir_: Column, root: str) -> Column:
    """The folder itself or anything below it, as a range that storage statistics can prune."""
    root = root.rstrip("/")
    return (dir_ == root) | ((dir_ >= root + "/") & (dir_ < root + "0"))


def prefixes(path: Column, sep: str = "/") -> Column:
    """Every ancestor of a path and the path itself, shortest first."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def common_prefix(a: str, b: str) -> str:
    """The deepest folder above two paths, or nothing."""
    out = []
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        out.append(x)
    return "/".join(out)
