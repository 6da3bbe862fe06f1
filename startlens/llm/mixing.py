"""Mixing sources to target weights by Pareto order sampling (operator 8).

Target words per source come from weights by water-filling: no source gets
more than ``max_repeat`` times its own size, and what a full source leaves is
shared among the others by weight, until none is above.

A source at ``f = target / size`` gives every document ``floor(f)`` certain
whole copies. The rest, a share of the source's words, is one more copy of an
unequal-probability sample: a document of class k has ``2 ** k`` times the
inclusion odds of one of class 0. By default k is the number of times that 4
divides into its words, so a document of four times the length has twice the odds.
The inclusion probabilities are ``p / (1 - p) = 2 ** (level + k)``, at the level
where the words expected, the sum of ``p * size``, are the rest. Documents are ranked
by ``(U / (1 - U)) / (p / (1 - p))``, random odds over inclusion odds (Rosen,
1997), and the first of them whose words come nearest to the rest are taken. U
is a hash of the doc_id and a seed, so reruns agree. Documents longer than
``big_share`` of the rest are sampled first, for their share of it; the others
then fill what is missing, at a level that makes up for the words the long
ones took too many or too few. So the sum ends within half a short document of
the target wherever short documents have the words.

The order inside a source is never sorted in one task: documents fall in
``bins`` fixed ranges of the ranking ratio, word sums of groups of about
``sqrt(bins)`` ranges, then of the ranges of one group, find the range where the
rest is reached, and only that range's documents are ordered.

Null sources are one source, after all others. A null text has size 0. Rows
that repeat a doc_id are separate rows of equal rank, told apart by size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from startlens.operators.rank import rank_rows
from startlens.session import materialize


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: str, seed: str) -> Column:
    """52 bits of md5(doc_id:seed) as a double strictly inside (0, 1)."""
    h = F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 13)
    return (F.conv(h, 16, 10).cast("double") + 0.5) / F.lit(float(2**52 + 1))


def size_class(size: str) -> Column:
    """How often 4 divides into a size, rounding down; 0 for sizes under 4."""
    return F.shiftright(F.length(F.bin(F.col(size))) - 1, 1)


def inclusion_level(classes: str, goal: str) -> Column:
    """The level at which documents with inclusion odds ``2 ** (level + k)`` are
    expected to have ``goal`` words; ``classes`` is an array of (k, words)."""

    def expected(level: Column) -> Column:
        odds = lambda c: F.pow(F.lit(2.0), level + c["k"])
        return F.aggregate(classes, F.lit(0.0), lambda s, c: s + c["words"] * odds(c) / (1 + odds(c)))

    steps = F.array(*[F.lit(128.0 / 2**i) for i in range(1, 50)])
    return F.aggregate(steps, F.lit(0.0), lambda x, step: x + F.when(expected(x) < F.col(goal), step).otherwise(-step))


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_repeat: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size) rows.

    Sources in code-point order, null last, take the weights in turn.
    """
    ranked = materialize(rank_rows(sizes, "source", "source", ascending=True, rank_col="__k"), "sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("__k") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = ranked.select("source", "source_size", w.alias("__w"), (F.col("source_size") * max_repeat).alias("__most"))
    goal = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, last = 0.0, None
    while level != last:  # each round fills up the sources that the level is above
        last = level
        full = F.col("__w") * F.lit(level) > F.col("__most")
        got, rest = table.agg(F.sum(F.when(full, F.col("__most"))), F.sum(F.when(~full, F.col("__w")))).first()
        if not rest:
            break
        level = (goal - (got or 0.0)) / rest
    return table.select("source", "source_size", F.least(F.col("__most"), F.col("__w") * F.lit(level)).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: str = "mix",
    big_share: float = 0.05,
    bins: int = 65536,
    keep_rows: bool = False,
    odds_class: Column | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of
    ``docs``. ``odds_class`` gives other whole numbers k (held within -30 and
    30, null as 0) for the inclusion odds, 0 for equal ones. With ``keep_rows`` all columns of ``docs`` in front of size,
    source_size, target, copies and taken, which replace columns so named."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if keep_rows else []
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
            uniform(id_col, seed).alias("__u"),
            *([] if odds_class is None else [odds_class.cast("int").alias("__k")]),
            *row,
        ),
        "mix_rows",
    )
    k = size_class("size") if odds_class is None else F.coalesce("__k", F.lit(0))
    rows = rows.withColumn("__k", F.greatest(F.lit(-30), F.least(F.lit(30), k)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    targets = source_targets(sizes, list(weights), share, max_repeat).withColumn("__whole", whole)
    targets = materialize(targets.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size")), "mix_targets")

    big = F.col("size") > F.lit(big_share) * F.col("__rest")
    rows = rows.join(_small(targets.withColumnRenamed("source", "__s"), "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("__big", big & (F.col("__rest") > 0))
    # long documents first, for their own share of the rest; short ones fill what is then missing
    words = rows.where("__big").groupBy("source", "__rest", "source_size").agg(F.sum("size").alias("__w"))
    long_rest = words.select("source", (F.col("__rest") * F.col("__w") / F.col("source_size")).alias("__goal"))
    first = materialize(_take(rows.where("__big"), long_rest, bins), "mix_long")
    got = first.groupBy("source").agg(F.sum(F.col("size") * F.col("__more")).alias("__got"), F.sum("size").alias("__w"))
    got = targets.join(got.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    missing = F.col("__rest") - F.coalesce(F.col("__got"), F.lit(0))
    room = F.col("source_size") - F.coalesce(F.col("__w"), F.lit(0))
    short_rest = got.select("source", F.greatest(F.lit(0.0), F.least(missing, room.cast("double"))).alias("__goal"))
    out = first.unionByName(_take(rows.where(~F.col("__big")), short_rest, bins))
    copies = F.col("__whole") + F.col("__more")
    added = ["size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    if keep_rows:
        names = ("size", "source_size", "target", "copies", "taken")
        return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in names], *added)
    return out.select("doc_id", "source", *added)


def _small(table: DataFrame, name: str, max_bytes: int = 8 << 20) -> DataFrame:
    """``table`` (stored, a row per source) marked for broadcast if its rows are
    measured to fit; beyond that it joins by shuffle."""
    used = table.agg(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + 128)).first()[0] or 0
    return F.broadcast(table) if used <= max_bytes else table


def _take(rows: DataFrame, goals: DataFrame, bins: int) -> DataFrame:
    """``rows`` with ``__more`` = 1 for the Pareto sample of each source whose
    words come nearest to its goal, 0 for the others."""
    cols = rows.columns
    classes = rows.groupBy(F.col("source").alias("__c"), "__k").agg(F.sum("size").alias("words"))
    classes = classes.groupBy("__c").agg(F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), "words"))).alias("__classes"))
    goals = goals.select(F.col("source").alias("__s"), "__goal").join(classes, F.col("__s").eqNullSafe(F.col("__c")))
    goals = materialize(goals.select("__s", "__goal", inclusion_level("__classes", "__goal").alias("__level")), "mix_goals")
    rows = rows.join(_small(goals, "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # random odds over inclusion odds: the level is one for all of a source, so the
    # ratio without it has the same order; with it the goal is reached near 1
    rows = rows.withColumn("__ratio", (F.col("__u") / (1 - F.col("__u"))) / F.pow(F.lit(2.0), F.col("__k")))
    pareto = F.col("__ratio") / F.pow(F.lit(2.0), F.col("__level"))
    rows = rows.withColumn("__bin", F.floor((1 - 1 / (1 + pareto)) * bins).cast("int"))  # every step keeps the order
    binned = materialize(rows.groupBy("source", "__goal", "__bin").agg(F.sum("size").alias("__words")), "mix_bins")
    # the bin in which the goal is reached; none if the goal is 0 or all words
    side = math.isqrt(bins - 1) + 1
    group = F.floor(F.col("__bin") / side)
    groups = binned.groupBy("source", "__goal", group.alias("__group")).agg(F.sum("__words").alias("__words"))
    groups = _reached(groups, "__group", F.lit(0)).select(F.col("source").alias("__s"), "__group", F.col("__before").alias("__start"))
    inside = binned.join(groups, F.col("source").eqNullSafe(F.col("__s")) & (group == F.col("__group")))
    edges = _reached(inside, "__bin", F.col("__start"))
    edges = materialize(edges.select(F.col("source").alias("__e"), F.col("__bin").alias("__edge"), "__before"), "mix_edges")
    rows = rows.join(_small(edges, "__e"), F.col("source").eqNullSafe(F.col("__e")), "left")
    at_edge = F.coalesce(F.col("__bin") == F.col("__edge"), F.lit(False))
    inside = Window.partitionBy("source", "__bin").orderBy("__ratio", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # the document in which the goal is reached is taken if that brings the sum nearer
    edge = rows.where(at_edge).withColumn("__more", (start + F.col("size") / 2.0 <= F.col("__goal")).cast("long"))
    taken = (F.col("__goal") > 0) & (F.col("__edge").isNull() | (F.col("__bin") < F.col("__edge")))
    other = rows.where(~at_edge).withColumn("__more", taken.cast("long"))
    return edge.select(*cols, "__more").unionByName(other.select(*cols, "__more"))


def _reached(sums: DataFrame, place: str, start: Column) -> DataFrame:
    """Of each source's rows in the order of ``place`` the one in which its words,
    counted from ``start``, reach the goal, with ``__before``, the words before it."""
    before = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", start + F.coalesce(F.sum("__words").over(before), F.lit(0)))
    reached = (F.col("__before") <= F.col("__goal")) & (F.col("__before") + F.col("__words") > F.col("__goal"))
    return sums.where((F.col("__goal") > 0) & reached)
