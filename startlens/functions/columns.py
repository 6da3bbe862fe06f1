"""Null-safe, ANSI-safe column helpers.

All helpers return native ``Column`` expressions, so they stay inside
whole-stage codegen. Spark 4 runs in ANSI mode: a plain ``a / 0`` or a bad
cast throws, and ``greatest``/``least`` skip NULLs (``greatest(NULL, 1)`` is
1). The helpers below keep NULL as NULL, the way column arithmetic on
missing values behaves in the published method.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (unlike bare greatest/least)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b with a zero or NULL divisor giving NULL (never an error)."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0)))


def round_half_even(c: str | Column, digits: int = 2) -> Column:
    """Round like numpy: rint(x * 10^d) / 10^d (0.125 -> 0.12)."""
    f = float(10 ** digits)
    return F.rint(col(c) * F.lit(f)) / F.lit(f)


def nan_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


# Whitespace as Python's str.strip() sees it (ASCII and Unicode spaces,
# plus the information separators 0x1c-0x1f).
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_ws(c: str | Column) -> Column:
    """Strip leading/trailing whitespace (F.trim strips spaces only)."""
    return F.regexp_replace(col(c), rf"^{_WS}+|{_WS}+$", "")


def py_title(c: str | Column) -> Column:
    """Title case the way Python's ``str.title`` does it.

    Every run of cased letters starts upper case and continues lower case;
    any other character ends a word (``series-g`` -> ``Series-G``), which
    ``F.initcap`` (space-separated words only) does not do.
    """
    parts = F.regexp_extract_all(col(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1)
    titled = F.transform(
        parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))
    )
    return F.when(col(c).isNotNull(), F.array_join(titled, ""))


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return repr(v)


@functools.lru_cache(maxsize=256)
def _map_expr(items: tuple) -> str:
    return "map(" + ", ".join(f"{_sql_literal(k)}, {_sql_literal(v)}" for k, v in items) + ")"


def literal_map(mapping: Mapping) -> Column:
    """A constant ``map<k, v>`` literal (folded by Catalyst, no join).

    Built from one SQL literal so the driver makes a single call per use.
    """
    return F.expr(_map_expr(tuple(mapping.items())))


def lookup(mapping: Mapping, key: str | Column, default=None) -> Column:
    """``mapping.get(key, default)`` as a column; NULL key gives default."""
    got = F.try_element_at(literal_map(mapping), col(key))
    return got if default is None else F.coalesce(got, F.lit(default))


def py_round_exact(c: str | Column, digits: int) -> Column:
    """Round to ``digits`` decimals the way Python's ``f"{x:.{d}f}"`` does:
    half-to-even on the *exact* binary value of x (2.675 -> 2.67, since the
    stored double is 2.67499...; 0.125 -> 0.12, an exact tie).

    p = fl(x * 10^d) alone can land on a half (2.675 * 100 -> 267.5), so the
    rounding error e of that product is recovered exactly with Dekker's
    product (Veltkamp split; doubles only, stays in codegen) and decides
    which side of the half the exact product lies.
    """
    x = col(c)
    b = float(10 ** digits)
    split = x * F.lit(134217729.0)  # 2^27 + 1
    x_hi = split - (split - x)
    x_lo = x - x_hi
    p = x * F.lit(b)
    e = (x_hi * F.lit(b) - p) + x_lo * F.lit(b)
    fl = F.floor(p).cast("double")
    on_half = p == fl + F.lit(0.5)
    odd = F.pmod(fl, F.lit(2.0)) == F.lit(1.0)
    up = (e > 0) | ((e == 0) & odd)
    r = F.when(on_half, F.when(up, fl + F.lit(1.0)).otherwise(fl)).otherwise(F.rint(p))
    # a negative value rounding to zero keeps its sign (-0.5 -> "-0")
    r = F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)
    return r / F.lit(b)


def _round_exact_sql(x: str, digits: int) -> str:
    """SQL text of :func:`py_round_exact` for a column reference ``x``
    (same arithmetic; parsed by Spark in one call)."""
    b = f"{float(10 ** digits)!r}D"
    hi = f"(({x} * 134217729.0D) - (({x} * 134217729.0D) - {x}))"
    p = f"({x} * {b})"
    e = f"(({hi} * {b} - {p}) + ({x} - {hi}) * {b})"
    fl = f"CAST(floor({p}) AS DOUBLE)"
    r = (f"CASE WHEN {p} = {fl} + 0.5D THEN CASE WHEN {e} > 0 OR ({e} = 0 AND pmod({fl}, 2.0D) = 1.0D) "
         f"THEN {fl} + 1.0D ELSE {fl} END ELSE rint({p}) END")
    return f"(CASE WHEN ({r}) = 0 AND {x} < 0 THEN -0.0D ELSE ({r}) END / {b})"


def py_format_fixed(c: str | Column, digits: int) -> Column:
    """Python ``f"{x:.{d}f}"``: exact half-to-even rounding (above), then
    printing the already-rounded double (Java's formatter rounds half up on
    the shortest decimal form, so it must not do the rounding).

    A column name goes through the SQL-text form (one parse on the driver);
    any other expression through the column form.
    """
    if isinstance(c, str):
        x = "`" + c.replace("`", "``") + "`"
        return F.expr(f"format_string('%.{digits}f', {_round_exact_sql(x, digits)})")
    return F.format_string(f"%.{digits}f", py_round_exact(c, digits))
