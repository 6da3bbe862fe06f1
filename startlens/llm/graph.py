"""Connected components of a link table.

Alternating large-star and small-star steps (Kiveris et al., 2014): each
step is a keyed minimum with map-side combine and a join, so a node that a
third of all links touch is summed before the shuffle and its join partition
can be split. Every round is written once to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from startlens.session import materialize


def _links(df: DataFrame) -> DataFrame:
    return df.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is the
    smallest node that links reach. Self-links and repeats change nothing;
    links with a null end are ignored. No links give no rows.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    e = materialize(_links(e).distinct(), "links")
    seen = None
    while True:
        # large star: every larger neighbour of u moves to the least of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: u and its smaller neighbours all move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = materialize(_links(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))).distinct(), "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def same_id_links(members: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes of each id; members: (id, node)."""
    spans = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", "a")
    return members.join(spans, "id").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()


def least_ids(members: DataFrame, components: DataFrame) -> DataFrame:
    """(id, component_id): the least id of each id's component; a node without
    links is a component of its own. All nodes of an id must be in one component."""
    of = members.join(components, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("id").alias("component_id"))
    return of.join(least, "component").groupBy("id").agg(F.min("component_id").alias("component_id"))
