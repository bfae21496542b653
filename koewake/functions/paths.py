"""Paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(path: Column) -> Column:
    """The steps of a path taken one by one: ``.`` stays where it is, ``..`` goes one back, never above the root."""
    rooted = path.startswith("/")
    none = F.array().cast("array<string>")

    def step(taken: Column, x: Column) -> Column:
        can = F.try_element_at(taken, F.lit(-1)) != ".."  # null of none
        back = F.when(can, F.slice(taken, F.lit(1), F.size(taken) - 1)).when(rooted, taken).otherwise(F.concat(taken, F.array(x)))
        return F.when(x.isin("", "."), taken).when(x == "..", back).otherwise(F.concat(taken, F.array(x)))

    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


def clean_dir(path: Column) -> Column:
    """One spelling for a directory: no doubled or closing slashes, no ``.`` and ``..`` steps, however many.

    Null and blank paths give null, and so does a relative path that leads back to where it starts.
    """
    p = F.trim(path)
    plain = F.regexp_replace(F.regexp_replace(p, r"/+", "/"), r"(?<=.)/$", "")
    p = F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), _fold(p)).otherwise(plain)  # few paths have such steps
    return F.when(F.length(p) > 0, p)
