"""Joining a per-group table back onto its rows.

Several operators aggregate per group (stage, sector, partition id) and
join the result back. The group side has one row per group; how many there
are depends on the data, so the join carries no hint: AQE broadcasts it if
its measured bytes are small, and splits a hot group's partition otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def join_group_table(
    rows: DataFrame,
    groups: DataFrame,
    on: list[str],
    how: str = "left",
    null_safe: bool = True,
) -> DataFrame:
    """``rows`` joined with the per-group table ``groups`` on ``on``.

    ``null_safe`` matches NULL keys with NULL keys (a NULL group is a
    group). The join columns appear once, from ``rows``.
    """
    right = groups
    if null_safe:
        cond: Column | None = None
        for c in on:
            e = rows[c].eqNullSafe(right[c])
            cond = e if cond is None else cond & e
        out = rows.join(right, cond, how)
        for c in on:
            out = out.drop(right[c])
        return out
    return rows.join(right, on, how)
