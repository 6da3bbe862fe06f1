"""Conversation structure repair by auction shortest paths (operator 12).

Rows of a conversation, by turn (nulls first), become a lattice: column i and
a state say that i rows are done and what the repaired roles so far are -
nothing, one s, ending in u, or ending in a. Edits are arcs: Keep the row if
its role may follow, Rerole it to the role that may follow, Delete it, or
Insert an empty row (the column stays). Costs are integers. The repaired role
initials must read ``(s?(ua)+)?``.

The cheapest edits are found by the auction algorithm (Bertsekas, 1991): a
path grows from the origin; while its last node's price is less than the
cheapest arc plus the price behind it, the price is raised to that and the path
contracts by a node; once they are equal, the path extends along that arc. At
the sink, prices are dual: price <= cost + price behind on every arc, with equality on
every arc of every shortest path. Among such tight arcs that lead to the
sink, the ASCII-least label is followed, so ties fall to the least audit.

The lattice is solved in windows of ``WINDOW`` rows from the last to the
first: a window's sink arcs cost the prices that the next window's entry nodes
ended with, and four auctions, one from each entry node, share the window's
prices. Prices then rise by a few units only, whatever the conversation's length,
so the work is linear in the rows. Windows recur, so solved ones are kept in a bounded cache.

No conversation has to fit in a task: rows are numbered by a range sort,
blocks of ``BLOCK`` rows are grouped by (conversation, block). For a
conversation of more blocks, each block first gives its 4 x 4 costs from
entry to exit states; these (16 numbers a block) are chained per
conversation to the prices behind every block; every block is then solved for each
entry state, and the exits are chained forwards. Texts never take part: they meet
their edits again by row number.

Faults, the first of which counts: blank (no character but white space),
duplicate (role and text of an earlier row), truncated (last such character
is not one of ``.!?``). Nulls in role and text count as one space, null ids
are one conversation, rows of equal turn are ordered by role and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startlens.operators.rank import rank_rows
from startlens.session import materialize

WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
WINDOW, BLOCK = 12, 4096
FAR = 1 << 40

#: State after a kept initial (0 other, 1 s, 2 u, 3 a) in a state, if it may follow.
_KEEP = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}
#: State after the one role that a Rerole or an Insert can give there.
_NEXT = (2, 2, 3, 2)
_ENDS = (0, FAR, FAR, 0)


def _arcs(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """(label, columns on, state, cost) of the arcs that use up a row. A code
    is 3 * initial + fault (0 none, 1 blank or duplicate, 2 truncated)."""
    initial, fault = divmod(code, 3)
    out = [("D", 1, state, DELETE)]
    if fault != 1:
        cut = CUT if fault == 2 else 0
        if (state, initial) in _KEEP:
            out.append(("K", 1, _KEEP[state, initial], cut))
        out.append(("R", 1, _NEXT[state], REROLE + cut))
    return out


@lru_cache(maxsize=1 << 16)
def _window(codes: bytes, exits: tuple[int, ...], last: bool) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Prices of the four entry nodes, and from each the least shortest path's
    labels and exit state. ``exits``: prices behind the window (FAR: no way).
    Inserts after the last row belong to the last window."""
    n = len(codes)
    sink = 4 * (n + 1)
    arcs: list[list[tuple[str, int, int]]] = []
    for k in range(n + 1):
        for state in range(4):
            own = [(label, 4 * (k + on) + to, cost) for label, on, to, cost in _arcs(codes[k], state)] if k < n else []
            if k < n or last:
                own.append(("I", 4 * k + _NEXT[state], INSERT))
            if k == n and exits[state] < FAR:
                own.append(("", sink, exits[state]))
            arcs.append(own)
    leads = {sink}
    for _ in range(3):  # at most two inserts stand in one column
        for i in reversed(range(sink)):
            if any(j in leads for _, j, _ in arcs[i]):
                leads.add(i)
    arcs = [[a for a in own if a[1] in leads] for own in arcs]
    price = [0] * sink + [0]
    for origin in range(4):
        if origin not in leads:
            price[origin] = FAR
            continue
        path = [origin]
        while path[-1] != sink:
            i = path[-1]
            best, behind = min((cost + price[j], j) for _, j, cost in arcs[i])
            if price[i] < best:
                price[i] = best
                if i != origin:
                    path.pop()
            else:
                path.append(behind)
    tight = [[(label, j) for label, j, cost in own if price[i] == cost + price[j]] for i, own in enumerate(arcs)]
    ends = {sink}
    for _ in range(3):
        for i in reversed(range(sink)):
            if any(j in ends for _, j in tight[i]):
                ends.add(i)
    traces = []
    for origin in range(4):
        labels, i = [], origin
        while i in leads:
            label, j = min((x for x in tight[i] if x[1] in ends))
            if j == sink:
                break
            labels.append(label)
            i = j
        traces.append(("".join(labels), i % 4))
    return tuple(price[:4]), tuple(traces)


def solve(codes: bytes, exits: tuple[int, ...] = _ENDS, last: bool = True) -> tuple[tuple[int, ...], list]:
    """Entry prices of a run of rows, and its windows' traces, first to last."""
    base, traces = 0, []
    for at in reversed(range(0, max(1, len(codes)), WINDOW)):
        least = min(exits)
        exits, own = _window(codes[at : at + WINDOW], tuple(x - least if x < FAR else FAR for x in exits), last)
        base += least
        last = False
        traces.append(own)
    return tuple(x + base if x < FAR else FAR for x in exits), traces[::-1]


def follow(traces: list, state: int) -> tuple[str, int]:
    """Labels and exit state of the path that enters in ``state``."""
    labels = []
    for own in traces:
        part, state = own[state]
        labels.append(part)
    return "".join(labels), state


def steps(codes: bytes, labels: str, state: int) -> Iterator[tuple[int, int, str, str | None, int]]:
    """(row, place before it, label, new role, cost) of every edit."""
    row = place = 0
    for label in labels:
        if label == "I":
            yield row, place, "I", "user" if _NEXT[state] == 2 else "assistant", INSERT
            state, place = _NEXT[state], place + 1
            continue
        cost = next(cost for name, _, _, cost in _arcs(codes[row], state) if name == label)
        new = ("user" if _NEXT[state] == 2 else "assistant") if label == "R" else None
        yield row, 2, label, new, cost
        state = next(to for name, _, to, _ in _arcs(codes[row], state) if name == label)
        row, place = row + 1, 0


# ---- Spark side ----


def numbered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, row, fault, code, block): rows in order, with
    their first fault. ``row`` is a number over the whole table."""
    own = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        F.col(turn_col).isNotNull().alias("__dated"),
    )
    ranked = rank_rows(own, "conv", ["__dated", "turn", "role", "text"], ascending=True, rank_col="row").drop("__dated")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    ranked = materialize(ranked.withColumn("__same", same), "turns")
    again = ranked.groupBy("conv", "__same").agg(F.min("row").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    again = again.select(F.col("conv").alias("__c"), F.col("__same").alias("__s"), "__first")
    convs = ranked.groupBy("conv").agg(F.min("row").alias("__start")).withColumnRenamed("conv", "__k")
    out = ranked.join(again, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("__same") == F.col("__s")), "left")
    out = out.join(convs, F.col("conv").eqNullSafe(F.col("__k")))
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = (
        F.when(end == "", "blank")
        .when(F.col("row") > F.col("__first"), "duplicate")
        .when(~end.isin(".", "!", "?"), "truncated")
    )
    head = F.left("role", F.lit(1))
    initial = F.when(head == "s", 1).when(head == "u", 2).when(head == "a", 3).otherwise(0)
    weight = F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
    out = out.withColumn("fault", fault).withColumn("code", (3 * initial + weight).cast("int"))
    block = F.floor((F.col("row") - F.col("__start")) / BLOCK).cast("long")
    out = out.withColumn("block", block).withColumn("opens", (F.col("row") - F.col("__start")) % BLOCK == 0)
    return materialize(out.select("conv", "turn", "role", "text", "row", "fault", "code", "block", "opens"), "faults")


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv, block, n_blocks, first row, codes, next): the codes of each block's
    rows in order, and the code of the next block's first row."""
    block = F.explode(F.when(F.col("opens") & (F.col("block") > 0), F.array("block", F.col("block") - 1)).otherwise(F.array("block")))
    cells = rows.select("conv", F.col("block").alias("own"), block.alias("block"), "row", "code")
    cell = F.when(F.col("own") == F.col("block"), F.struct("row", "code"))
    out = cells.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"), F.max(F.when(F.col("own") > F.col("block"), F.col("code"))).alias("next")
    )
    last = rows.groupBy("conv").agg((F.max("block") + 1).alias("n_blocks")).withColumnRenamed("conv", "__k")
    out = out.join(last, F.col("conv").eqNullSafe(F.col("__k"))).drop("__k")
    first = F.col("cells")[0]["row"].alias("first")
    return materialize(out.select("conv", "block", "n_blocks", first, F.col("cells.code").alias("codes"), "next"), "blocks")


def _illegal(codes: bytes, after: int | None) -> int:
    own = [c // 3 for c in codes] + ([] if after is None else [after // 3])
    return sum((a, b) not in ((1, 2), (2, 3), (3, 2)) for a, b in zip(own, own[1:]))


def _transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from each entry state (rows) to each exit state of a block."""
    for b in batches:
        out = []
        for codes in b.column("codes").to_pylist():
            exits = [tuple(0 if k == j else FAR for k in range(4)) for j in range(4)]
            cols = [solve(bytes(codes), x, False)[0] for x in exits]
            out.append([cols[j][i] for i in range(4) for j in range(4)])
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(out, pa.list_(pa.int64()))], ["conv", "block", "costs"])


def _prices(table: pa.Table) -> pa.Table:
    """Prices behind each block of one conversation, from its blocks' costs."""
    table = table.sort_by("block")
    exits, out = _ENDS, []
    for costs in reversed(table["costs"].to_pylist()):
        out.append(list(exits))
        if len(out) == 1:  # inserts after the last row
            exits = solve(b"")[0]
        exits = tuple(min(min(c + x, FAR) for c, x in zip(costs[4 * i : 4 * i + 4], exits)) for i in range(4))
    return pa.table({"__k": table["conv"], "__b": table["block"], "exits": pa.array(out[::-1], pa.list_(pa.int64()))})


STEP = "array<struct<row:long,place:int,edit:string,role:string>>"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block and entry state it can have: exit state, audit, cost and edits."""
    kinds = pa.struct([("row", pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("role", pa.string())])
    for b in batches:
        got: list[tuple] = []
        rows = zip(*[b.column(c).to_pylist() for c in ("block", "n_blocks", "first", "codes", "next", "exits")])
        for at, (block, n_blocks, first, codes, after, exits) in enumerate(rows):
            own, last = bytes(codes), block == n_blocks - 1
            _, traces = solve(own, _ENDS if last else tuple(exits), last)
            for state in range(4) if block else (0,):
                labels, out = follow(traces, state)
                edits = list(steps(own, labels, state))
                cells = [(first + row, place, edit, role) for row, place, edit, role, _ in edits]
                got.append((at, state, out, labels, sum(e[4] for e in edits), _illegal(own, after), cells))
        cols = list(zip(*got)) or [[]] * 7
        at = pa.array(cols[0], pa.int32())
        edits = pa.array([[dict(zip(("row", "place", "edit", "role"), c)) for c in cell] for cell in cols[6]], pa.list_(kinds))
        yield pa.RecordBatch.from_arrays(
            [b.column("conv").take(at), b.column("block").take(at), b.column("n_blocks").take(at), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
             pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()), edits],
            ["conv", "block", "n_blocks", "entry", "leave", "audit", "cost", "illegal", "edits"],
        )


def _entries(table: pa.Table) -> pa.Table:
    """The entry state of each block of one conversation, from all blocks' exits."""
    table = table.sort_by([("block", "ascending"), ("entry", "ascending")])
    state, blocks, out = 0, [], []
    for block, entry, leave in zip(*[table[c].to_pylist() for c in ("block", "entry", "leave")]):
        if len(blocks) <= block and entry == state:
            blocks.append(block)
            out.append(entry)
            after = leave
        if entry == 3 or block == 0:
            state = after
    return pa.table({"__k": table["conv"].slice(0, len(out)), "__b": pa.array(blocks, pa.int64()), "__e": pa.array(out, pa.int32())})


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables from :func:`numbered` rows: per conversation (conv, gaps,
    blank, duplicate, truncated, illegal, cost, audit), and per edit (conv,
    row, place, edit, role, text) in the order of row and place, with the
    repaired role and text (null for Delete)."""
    conv_type = rows.schema["conv"].dataType.simpleString()
    blocks = _blocks(rows)
    long_ones = blocks.where("n_blocks > 1")
    costs = long_ones.select("conv", "block", "codes").mapInArrow(_transfer, f"conv {conv_type}, block long, costs array<long>")
    prices = costs.groupBy("conv").applyInArrow(_prices, f"__k {conv_type}, __b long, exits array<long>")
    here = F.col("conv").eqNullSafe(F.col("__k")) & (F.col("block") == F.col("__b"))
    priced = blocks.join(prices, here, "left").select(*blocks.columns, "exits")
    schema = f"conv {conv_type}, block long, n_blocks long, entry int, leave int, audit string, cost long, illegal long, edits {STEP}"
    paths = materialize(priced.mapInArrow(_paths, schema), "paths")
    several = paths.where("n_blocks > 1").select("conv", "block", "entry", "leave")
    entries = several.groupBy("conv").applyInArrow(_entries, f"__k {conv_type}, __b long, __e int")
    chosen = paths.where("n_blocks > 1").join(entries, here & (F.col("entry") == F.col("__e")), "left_semi")
    chosen = paths.where("n_blocks = 1").unionByName(chosen)

    def count(kind: str) -> Column:
        return F.count_if(F.coalesce(F.col("fault") == kind, F.lit(False))).alias(kind)

    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    faults = rows.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), *[count(k) for k in ("blank", "duplicate", "truncated")])
    parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
    edits = chosen.groupBy(F.col("conv").alias("__k")).agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(parts["audit"], "").alias("audit")
    )
    summary = faults.join(edits, F.col("conv").eqNullSafe(F.col("__k"))).drop("__k")
    steps_ = chosen.select(F.col("conv").alias("__k"), F.explode("edits").alias("e")).select("__k", "e.*")
    kept = steps_.where("place = 2").select(F.col("row").alias("__r"), "edit", F.col("role").alias("new"))
    kept = rows.join(kept, F.col("row") == F.col("__r"))
    gone = F.col("edit") == "D"
    kept = kept.select("conv", "row", F.lit(2).alias("place"), "edit", F.when(~gone, F.coalesce("new", "role")).alias("role"), F.when(~gone, F.col("text")).alias("text"))
    inserted = steps_.where("place < 2").select(F.col("__k").alias("conv"), "row", "place", "edit", "role", F.lit("").alias("text"))
    return summary, kept.unionByName(inserted)
