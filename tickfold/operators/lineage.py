"""Snapshot algebra: which micro-clusters descend from which, and differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.operators.features import SUMMED
from tickfold.operators.nearest import matrix_of

VECTORS = ("cf1x", "cf2x")


def lineage(newer: DataFrame, older: DataFrame, by: list[str]) -> DataFrame:
    """Pairs ``pos, old_pos`` whose id lists share an id, within equal ``by``.

    An equi-join on the exploded ids: rows meet only where they match.
    """
    a = newer.select(*by, "pos", F.explode("ids").alias("id"))
    b = older.select(*by, F.col("pos").alias("old_pos"), F.explode("ids").alias("id"))
    return a.join(b, [*by, "id"]).select(*by, "pos", "old_pos").distinct()


def _relatives(newer: list, older: list) -> list[list[int]]:
    """For each list of ids of ``newer``, the places in ``older`` that share one."""
    owners: dict[int, list[int]] = {}
    for i, ids in enumerate(newer):
        for one in set(ids or ()):
            owners.setdefault(one, []).append(i)
    found: list[list[int]] = [[] for _ in newer]
    for j, ids in enumerate(older):
        for i in {i for one in ids or () for i in owners.get(one, ())}:
            found[i].append(j)
    return found


def _less(column: pa.Array, other: pa.Array, related: list[list[int]], vector: bool) -> pa.Array:
    """A feature minus the sum of that of the relatives."""
    if vector:
        left, right = matrix_of(column).copy(), matrix_of(other)
    else:
        left, right = column.to_numpy().copy(), other.to_numpy()
    for i, places in enumerate(related):
        if places:
            left[i] -= right[places].sum(axis=0)
    return pa.array(list(left), column.type) if vector else pa.array(left, column.type)


def subtract_related(
    newer: DataFrame, older: DataFrame, by: list[str], dims: int, drop_ids: bool = True
) -> DataFrame:
    """``newer`` minus the features of the related micro-clusters of ``older``.

    With ``drop_ids`` the ids of those are taken out as well, which leaves what
    was founded or absorbed since. Rows without relatives stay as they are.

    The two sides of one ``by`` are two sets of micro-clusters, each no larger than a
    model that fits every task, so they are compared as one group: every row moves once,
    with its list of ids as it is.
    """
    names = [c for c in newer.columns if c in SUMMED]

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        if not new.num_rows or not old.num_rows:
            return new.select(columns)
        old = old.sort_by("o_pos")
        mine, theirs = new["ids"].to_pylist(), old["o_ids"].to_pylist()
        related = _relatives(mine, theirs)
        for c in names:
            done = _less(new[c].combine_chunks(), old[f"o_{c}"].combine_chunks(), related, c in VECTORS)
            new = new.set_column(new.schema.get_field_index(c), c, done)
        if drop_ids:
            for i, places in enumerate(related):
                gone = {one for j in places for one in theirs[j]}
                if gone:
                    mine[i] = [one for one in dict.fromkeys(mine[i]) if one not in gone]
            at = new.schema.get_field_index("ids")
            new = new.set_column(at, "ids", pa.array(mine, new.schema.field(at).type))
        return new.select(columns)

    columns = newer.columns
    # Without ``by`` both sides are one set each.
    keys = by or ["_all"]
    if not by:
        newer, older = (df.withColumn("_all", F.lit(0)) for df in (newer, older))
    slim = older.select(*[F.col(c).alias(f"o_{c}") for c in (*keys, "pos", "ids", *names)])
    schema = newer.select(*columns).schema
    sides = newer.groupBy(*keys).cogroup(slim.groupBy(*[f"o_{k}" for k in keys]))
    return sides.applyInArrow(run, schema)
