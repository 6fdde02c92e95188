"""Scopes: stable keys and labels of project roots, and the scope that a path belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of_root(root: Column) -> Column:
    """`p:` and 16 hexadecimal digits of a hash of the root; `global` for the scope without one."""
    return F.when(root.isNull(), "global").otherwise(F.concat(F.lit("p:"), F.substring(F.sha2(root, 256), 1, 16)))


def label_of_root(root: Column) -> Column:
    """The last part of the root's path, whichever slash divides it; `global` for the scope without one."""
    parts = F.filter(F.split(root, r"[/\\]+"), lambda p: p != "")
    return F.when(root.isNull(), "global").otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), root))


def scope_of_path(paths: DataFrame, scopes: DataFrame, path: str = "path") -> DataFrame:
    """paths with scope_id: the scope with the nearest root above the path; null where none is.

    Every ancestor of a path is looked up by an equi-join, so that no path is held against every root.
    """
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    roots = scopes.where("root IS NOT NULL").select(F.col("id").alias("_scope"), F.regexp_replace("root", r"\\", "/").alias("_root"))
    found = paths.select(path, F.explode(F.array_distinct(above)).alias("_root")).distinct().join(roots, "_root")
    best = found.groupBy(path).agg(F.max_by("_scope", F.length("_root")).alias("scope_id"))
    return paths.join(best, path, "left")
