"""DuckDB SQL for the correctness oracle.

Independent SQL forms of the registered queries, written against the
driver's pre-registered views (customer, orders, lineitem, ...). The fixed
parameter tables are rendered into CASE expressions; every numeric literal
is cast to DOUBLE (DuckDB keeps decimal literals as DECIMAL), and every
division is guarded with NULLIF (DuckDB returns inf for x/0.0).
"""

from __future__ import annotations

from startlens.functions import params as P
from startlens.sources.fixtures import FIXTURE_CTES, SNAPSHOT_YEAR_FIXTURE


def d(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default=None, as_double: bool = False) -> str:
    val = d if as_double else (lambda v: q(v) if isinstance(v, str) else repr(v))
    parts = " ".join(f"WHEN {q(k)} THEN {val(v)}" for k, v in mapping.items())
    els = "NULL" if default is None else val(default)
    return f"CASE {expr} {parts} ELSE {els} END"


def clip(expr: str, lo=None, hi=None) -> str:
    e = expr
    if lo is not None:
        e = f"greatest({e}, {d(lo)})"
    if hi is not None:
        e = f"least({e}, {d(hi)})"
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE {e} END)"


def tidy_cols(cols: dict[str, str], digits: int = 6) -> str:
    """Render a select list applying the same rules as plans.present.tidy.

    ``cols`` maps output name -> kind: 'd' double, 'i' integer, 's' text,
    'date' date, or 'dN' a double rounded to N places.
    """
    out = []
    for name, kind in cols.items():
        if kind == "d":
            out.append(f"round(CAST({name} AS DOUBLE), {digits}) AS {name}")
        elif kind.startswith("d") and kind[1:].isdigit():
            out.append(f"round(CAST({name} AS DOUBLE), {kind[1:]}) AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "date":
            out.append(f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}")
        else:
            out.append(f"CAST({name} AS VARCHAR) AS {name}")
    return ", ".join(out)


def _stage_param_case(idx: int, default) -> str:
    return case_map("stage", {k: v[idx] for k, v in P.STAGE_PARAMS.items()}, default, as_double=True)


# --- CTE chain: fixtures -> enriched -> kpis -> scored ----------------------

def enrich_ctes() -> str:
    stage = case_map("rt", P.ROUND_TYPE_STAGE_MAP)
    return f"""{FIXTURE_CTES},
ty AS (SELECT object_id, lower(trim(funding_round_type)) AS rt FROM (
  SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY CASE WHEN funded_at IS NULL THEN 1 ELSE 0 END DESC,
         funded_at DESC, round_id DESC) AS rn
  FROM funding_rounds WHERE funding_round_type IS NOT NULL) t WHERE rn = 1),
dt AS (SELECT object_id, max(funded_at) AS last_funding_date FROM funding_rounds GROUP BY object_id),
ic AS (SELECT funded_object_id, count(DISTINCT investor_object_id) AS investors_count
       FROM investments WHERE funded_object_id IS NOT NULL GROUP BY funded_object_id),
enr AS (
  SELECT id, name AS company, {stage} AS stage, country_code AS country, category_code AS sector,
         CAST(funding_total_usd AS DOUBLE) AS funding_amount, investors_count,
         year(TRY_CAST(founded_at AS DATE)) AS founded_year, status, last_funding_date
  FROM objects LEFT JOIN ty ON id = ty.object_id LEFT JOIN dt ON id = dt.object_id
       LEFT JOIN ic ON id = ic.funded_object_id
  WHERE entity_type = 'Company' AND funding_total_usd > 0)"""


def kpi_chain(src: str, snapshot_year: int = SNAPSHOT_YEAR_FIXTURE, prefix: str = "k", out: str = "kpis",
              bounds: tuple[str, str] | None = None) -> str:
    """CTEs computing the population KPIs of ``src`` into ``out``.

    ``bounds`` = (lo_sql, hi_sql) scales traction by given bounds (stored
    bounds of another population); default: min/max over ``src`` itself.
    """
    s = snapshot_year
    raw = (
        f"log10({clip('funding_amount', lo=1)}) * {clip('coalesce(CAST(investors_count AS DOUBLE), 1.0)', lo=1)}"
        f" * {_stage_param_case(0, P.DEFAULT_STAGE_WEIGHT)}"
        f" * ({d(1.0)} / {clip(f'{d(float(s))} - coalesce(CAST(founded_year AS DOUBLE), {d(float(s))})', lo=1)})"
    )
    lo, hi = bounds if bounds else ("min(raw_traction) OVER ()", "max(raw_traction) OVER ()")
    return f"""{prefix}1 AS (SELECT *, funding_amount * {_stage_param_case(1, P.DEFAULT_REVENUE_MULTIPLE)} AS estimated_revenue,
         funding_amount / {_stage_param_case(2, P.DEFAULT_BURN_MONTHS)} AS monthly_burn,
         {raw} AS raw_traction,
         {_stage_param_case(3, P.DEFAULT_RULE40_BASE)} AS r40_base
       FROM {src}),
{prefix}2 AS (SELECT *, estimated_revenue / nullif(funding_amount, 0) AS capital_efficiency,
         (funding_amount * {d(P.CASH_SHARE_OF_FUNDING)}) / nullif(monthly_burn, 0) AS runway_months,
         {clip('(monthly_burn * 12) / nullif(estimated_revenue, 0)', hi=P.BURN_MULTIPLE_CAP)} AS burn_multiple,
         (raw_traction - {lo}) / nullif({hi} - {lo}, 0) * 100 AS traction_index
       FROM {prefix}1),
{out} AS (SELECT *, {clip(f'r40_base + (capital_efficiency - {d(P.RULE40_EFFICIENCY_PIVOT)}) * {d(float(P.RULE40_EFFICIENCY_SLOPE))}', *P.RULE40_CLIP)} AS rule_of_40
       FROM {prefix}2)"""


def score_chain(src: str, weights: dict | None = None, prefix: str = "n", out: str = "scored") -> str:
    """CTEs computing the normalised components and the rounded score."""
    w = dict(P.DEFAULT_WEIGHTS if weights is None else weights)
    blo, bhi = P.BURN_NORM_BOUNDS
    rlo, rhi = P.RUNWAY_NORM_BOUNDS
    inv = f"({d(1.0)} / {clip('burn_multiple', lo=P.BURN_NORM_FLOOR)})"
    burn_norm = clip(f"({inv} - {d(blo)}) / ({d(bhi)} - {d(blo)}) * 100", 0, 100)
    runway_norm = clip(f"({clip('runway_months', rlo, rhi)} - {d(float(rlo))}) / ({d(float(rhi))} - {d(float(rlo))}) * 100", 0, 100)
    total = d(0.0)
    for comp in ("rule_of_40", "traction_index", "capital_efficiency", "burn_multiple", "runway_months"):
        total = f"({total} + {comp}_norm * {d(float(w.get(comp, 0.0)))})"
    return f"""{prefix}1 AS (SELECT *, {clip('rule_of_40', 0, 100)} AS rule_of_40_norm,
         {clip('traction_index', 0, 100)} AS traction_index_norm,
         {clip('capital_efficiency', 0, 1.0)} * 100 AS capital_efficiency_norm,
         {burn_norm} AS burn_multiple_norm,
         {runway_norm} AS runway_months_norm
       FROM {src}),
{out} AS (SELECT *, round_even({total} * 100, 0) / 100 AS investment_score FROM {prefix}1)"""


def kpi_ctes(snapshot_year: int = SNAPSHOT_YEAR_FIXTURE) -> str:
    return f"{enrich_ctes()},\n{kpi_chain('enr', snapshot_year)}"


def score_ctes(weights: dict | None = None, snapshot_year: int = SNAPSHOT_YEAR_FIXTURE) -> str:
    return f"{kpi_ctes(snapshot_year)},\n{score_chain('kpis', weights)}"


SCORED_KINDS = {
    "id": "i", "company": "s", "stage": "s", "country": "s", "sector": "s", "funding_amount": "d",
    "investors_count": "i", "founded_year": "i", "status": "s", "last_funding_date": "date",
    "estimated_revenue": "d", "capital_efficiency": "d", "monthly_burn": "d", "runway_months": "d",
    "burn_multiple": "d", "traction_index": "d", "rule_of_40": "d",
    "rule_of_40_norm": "d", "traction_index_norm": "d", "capital_efficiency_norm": "d",
    "burn_multiple_norm": "d", "runway_months_norm": "d", "investment_score": "d",
}


# --- random forest as tables -------------------------------------------------

def forest_ctes(src: str, drop_first: bool = True, trees: int = 100, max_depth: int = 10, min_leaf: int = 10, min_split: int = 20,
                bins: int = 32, seed: int = 42) -> str:
    """CTEs (after WITH RECURSIVE) that train the table forest on the rows of
    ``src`` (id, success, is_test, ...) that aren't test rows: ``fe``
    (features), ``xl`` (feature values of all rows), ``grown`` (every training row in
    every node it reaches) and ``nodes``."""
    from startlens.operators.forest import POISSON_LIMITS

    nums = " UNION ALL ".join(f"SELECT {i} AS f, {q(c)} AS name, {q(c)} AS col, CAST(NULL AS VARCHAR) AS v" for i, c in enumerate(P.NUMERIC_FEATURES))
    vocab = " UNION ALL ".join(f"SELECT DISTINCT {i} AS k, {q(c)} AS col, {c} AS v FROM {src} WHERE NOT is_test AND {c} IS NOT NULL"
                               for i, c in enumerate(P.CATEGORICAL_FEATURES))
    keep = "WHERE rn > 1" if drop_first else ""
    draws = " + ".join(f"(h >= {x})::INT" for x in POISSON_LIMITS)
    pure = lambda n, y: f"(({y} * {y} + ({n} - {y}) * ({n} - {y}))::DOUBLE / {n}::DOUBLE)"

    def best(rows: str) -> str:
        """The best split per node of ``rows`` (tree, node, id, w, y)."""
        return f"""
  SELECT tree, node, f, b, "limit", gain, nl, yl FROM (
    SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, f, b) AS pick FROM (
      SELECT *, {pure("nl", "yl")} + {pure("(nt - nl)", "(yt - yl)")} AS score, {pure("nl", "yl")} + {pure("(nt - nl)", "(yt - yl)")} - {pure("nt", "yt")} AS gain FROM (
        SELECT tree, node, f, b, sum(sum(w)) OVER l AS nl, sum(sum(w * y)) OVER l AS yl, sum(sum(w)) OVER a AS nt, sum(sum(w * y)) OVER a AS yt
        FROM {rows} JOIN (
          SELECT tree, node, f FROM (SELECT tree, node, f, row_number() OVER (PARTITION BY tree, node
              ORDER BY md5(tree || ':' || node || ':' || f || ':{seed}')) AS k FROM (SELECT DISTINCT tree, node FROM {rows}), fe)
          WHERE k <= greatest(1, (SELECT floor(sqrt(count(*))) FROM fe))) USING (tree, node) JOIN bl USING (id, f)
        GROUP BY tree, node, f, b
        WINDOW l AS (PARTITION BY tree, node, f ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY tree, node, f))
      WHERE nl >= {min_leaf} AND nt - nl >= {min_leaf} AND nt >= {min_split} AND yt > 0 AND yt < nt) WHERE gain > 0)
  JOIN th USING (f, b) WHERE pick = 1"""

    return f"""v0 AS ({vocab}),
fe AS ({nums} UNION ALL SELECT {len(P.NUMERIC_FEATURES) - 1} + row_number() OVER (ORDER BY k, v), col || '_' || v, col, v
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v) AS rn FROM v0) {keep}),
xl AS ({feature_long(src, "id, is_test")}),
dv AS (SELECT f, x, sum(count(*)) OVER (PARTITION BY f ORDER BY x) AS upto, sum(count(*)) OVER (PARTITION BY f) AS n, count(*) AS c
  FROM xl JOIN fe USING (f) WHERE NOT is_test AND v IS NULL GROUP BY f, x),
th AS (SELECT f, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS b, x AS "limit" FROM dv
    WHERE (upto * {bins} // n) * n > (upto - c) * {bins} AND upto < n
  UNION ALL SELECT f, 0, 0.0 FROM fe WHERE v IS NOT NULL),
bl AS (SELECT id, f, (SELECT count(*) FROM th WHERE th.f = xl.f AND xl.x > th."limit") AS b FROM xl WHERE NOT is_test),
dr AS (SELECT tree, id, {draws} AS w, success AS y FROM (
  SELECT id, success, tree, ('0x' || substr(md5(id || ':' || tree || ':{seed}'), 1, 8))::BIGINT AS h
  FROM (SELECT id, success FROM {src} WHERE NOT is_test), (SELECT unnest(range({trees})) AS tree))),
grown AS (SELECT 0 AS depth, tree, CAST(1 AS BIGINT) AS node, id, w, y FROM dr WHERE w > 0
  UNION ALL
  SELECT r.depth + 1, r.tree, 2 * r.node + CASE WHEN bl.b > s.b THEN 1 ELSE 0 END, r.id, r.w, r.y
  FROM grown r JOIN ({best("grown")}) s ON s.tree = r.tree AND s.node = r.node JOIN bl ON bl.id = r.id AND bl.f = s.f
  WHERE r.depth < {max_depth}),
nodes AS (SELECT tree, node, depth, sum(w) AS weight, sum(w * y) AS positives, sum(w * y)::DOUBLE / sum(w)::DOUBLE AS prediction FROM grown GROUP BY tree, node, depth),
inner_ AS (SELECT * FROM grown WHERE depth < {max_depth}),
splits AS ({best("inner_")})"""


def feature_long(src: str, keys: str) -> str:
    """(keys, f, x): every feature of ``fe`` for every row of ``src``."""
    from startlens.operators.forest import DIGITS

    value = "CASE " + " ".join(f"WHEN col = {q(c)} AND v IS NULL THEN round(coalesce({c}::DOUBLE, 0), {DIGITS})" for c in P.NUMERIC_FEATURES)
    value += " " + " ".join(f"WHEN col = {q(c)} THEN coalesce({c} = v, false)::INT" for c in P.CATEGORICAL_FEATURES) + " END"
    return f"SELECT {keys}, f, ({value})::DOUBLE AS x FROM {src}, fe"


def forest_scores(keys: str, long: str) -> str:
    """CTEs that walk ``long`` (keys, f, x) down the trees: ``scores`` (keys, p)."""
    return f"""walk AS (SELECT {keys}, tree, node FROM (SELECT DISTINCT {keys} FROM {long}), (SELECT tree, node FROM nodes WHERE node = 1)
  UNION ALL
  SELECT {", ".join("walk." + k for k in keys.split(", "))}, walk.tree, 2 * walk.node + CASE WHEN l.x > s."limit" THEN 1 ELSE 0 END
  FROM walk JOIN splits s ON s.tree = walk.tree AND s.node = walk.node JOIN {long} l ON l.f = s.f AND {" AND ".join(f"l.{k} = walk.{k}" for k in keys.split(", "))}),
scores AS (SELECT {keys}, round(avg(prediction), 9) AS p FROM walk JOIN nodes USING (tree, node)
  WHERE NOT EXISTS (FROM splits s WHERE s.tree = walk.tree AND s.node = walk.node) GROUP BY {keys})"""
