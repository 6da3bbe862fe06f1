"""Fixed parameter tables of the startup-evaluation model.

Everything in the block below is a fixed value that must stay equal to the
published method for results to match (stage multipliers, benchmark
constants, score weights, band edges, stage spellings). They are stated
plainly, in natural order, and turned into Spark literal maps by
:mod:`startlens.functions.columns`, so every lookup compiles into the
projection (no join, no shuffle, no broadcast of data-dependent size).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the published method)
# ---------------------------------------------------------------------------

# Stage table of the column (population) KPI definition:
# stage -> (traction weight, revenue multiple, burn months, Rule-of-40 base)
STAGE_PARAMS = {
    "Pre-Seed": (0.5, 0.05, 12, 80),
    "Seed": (1.0, 0.10, 18, 100),
    "Angel": (0.8, 0.08, 18, 90),
    "Series A": (1.5, 0.30, 24, 100),
    "Series B": (2.0, 0.50, 30, 80),
    "Series C": (2.5, 0.80, 36, 50),
    "Series D+": (3.0, 1.00, 36, 40),
}
# Values used when the stage is missing or not in the table above.
DEFAULT_STAGE_WEIGHT = 1.0
DEFAULT_REVENUE_MULTIPLE = 0.20
DEFAULT_BURN_MONTHS = 24
DEFAULT_RULE40_BASE = 60

# Stage table of the prospect (single-record) KPI definition:
# stage -> (burn months, revenue multiple, Rule-of-40 base, traction weight).
# Unknown stages fall back to the "Series A" row.
PROSPECT_STAGE_PARAMS = {
    "Seed": (18, 0.10, 100, 1.0),
    "Angel": (18, 0.08, 90, 1.0),
    "Series A": (24, 0.30, 100, 1.5),
    "Series B": (30, 0.50, 80, 2.0),
    "Series C": (36, 0.80, 50, 2.5),
    "Series D+": (36, 1.00, 40, 3.0),
}
PROSPECT_FALLBACK_STAGE = "Series A"
PROSPECT_STAGES = ["Seed", "Angel", "Series A", "Series B", "Series C", "Series D+"]
PROSPECT_DEFAULTS = {
    "stage": "Series A",
    "sector": "saas",
    "country": "USA",
    "investors_count": 3,
    "founded_year": 2020,
}
PROSPECT_VALID_YEARS = (1990, 2025)
PROSPECT_CURRENT_YEAR = 2025
PROSPECT_MIN_FUNDING_FOR_LOG = 100_000

# Generic-loader stage spellings (lower-cased, stripped) -> canonical stage.
# Anything else is title-cased.
GENERIC_STAGE_MAP = {
    "pre-seed": "Pre-Seed",
    "seed": "Seed",
    "angel": "Angel",
    "series a": "Series A",
    "series b": "Series B",
    "series c": "Series C",
    "series d": "Series D+",
    "series e": "Series D+",
    "series f": "Series D+",
}

# Funding-round type (lower-cased, stripped) -> canonical stage.
# Anything else maps to NULL.
ROUND_TYPE_STAGE_MAP = {
    "seed": "Seed",
    "angel": "Angel",
    "series-a": "Series A",
    "series-a+": "Series A",
    "series-b": "Series B",
    "series-b+": "Series B",
    "series-c": "Series C",
    "series-c+": "Series C",
    "series-d": "Series D+",
    "series-e": "Series D+",
    "series-f": "Series D+",
    "series-g": "Series D+",
    "venture": "Series A",
    "private-equity": "Series D+",
}

# Investment-score weights (not re-normalised when customised).
DEFAULT_WEIGHTS = {
    "rule_of_40": 0.25,
    "traction_index": 0.25,
    "capital_efficiency": 0.20,
    "burn_multiple": 0.15,
    "runway_months": 0.15,
}

# Score bands, half-open [low, high): (low, high, label)
SCORE_BANDS = [
    (80, 100, "Excellent (Top Tier)"),
    (60, 80, "Strong (High Potential)"),
    (40, 60, "Moderate (Average)"),
    (20, 40, "Weak (Below Average)"),
    (0, 20, "Poor (High Risk)"),
]

# Snapshot year of the company data set.
SNAPSHOT_YEAR = 2013

# Runway assumes this share of total funding is still in the bank.
CASH_SHARE_OF_FUNDING = 0.50
# Burn multiple cap.
BURN_MULTIPLE_CAP = 10.0
# Rule-of-40 capital-efficiency pivot and slope, and the clip range.
RULE40_EFFICIENCY_PIVOT = 0.3
RULE40_EFFICIENCY_SLOPE = 50
RULE40_CLIP = (-50, 150)

# Normalisation bounds of the score components.
BURN_NORM_FLOOR = 0.1
BURN_NORM_BOUNDS = (0.1, 3.0)
RUNWAY_NORM_BOUNDS = (0, 24)

# Outcome labels.
SUCCESS_STATUSES = ["acquired", "ipo"]
FAILURE_STATUSES = ["closed"]
KNOWN_OUTCOMES = ["acquired", "ipo", "closed"]

# Data-quality grades by missing percentage.
QUALITY_GRADES = [(0, "complete"), (20, "good"), (50, "fair")]
QUALITY_GRADE_WORST = "poor"

# Prospect interpretation thresholds.
CONFIDENCE_HIGH = (0.8, 0.2)
CONFIDENCE_MEDIUM = (0.65, 0.35)
RECOMMENDATIONS = [
    (0.75, "STRONG INVEST - High success probability"),
    (0.60, "CONSIDER - Above average potential"),
    (0.45, "CAUTIOUS - Average risk/reward"),
]
RECOMMENDATION_ELSE = "PASS - Below average probability"
PERCENTILE_CONTEXT = [
    (0.80, "top 5%"),
    (0.70, "top 15%"),
    (0.60, "top 30%"),
    (0.50, "above median"),
]
PERCENTILE_CONTEXT_ELSE = "below median"
STRONG_FUNDING_BY_STAGE = [
    ("Seed", 2_000_000, "Strong seed funding"),
    ("Series A", 8_000_000, "Strong Series A"),
    ("Series B", 20_000_000, "Strong Series B"),
]

# Missing-data analysis.
SIGNIFICANCE_LEVEL = 0.001
SECTOR_MIN_COMPANIES = 100

# Canonical columns of the generic loader, and accepted source names in
# priority order.
CANONICAL_COLUMNS = [
    "company", "stage", "country", "sector",
    "funding_amount", "investors_count", "founded_year",
]
COMPANY_ALIASES = ["company", "organization", "startup", "name"]
SECTOR_ALIASES = ["sector", "category_code", "category", "industry"]
COUNTRY_ALIASES = ["country", "country_code", "hq_country"]
FUNDING_ALIASES = ["funding_amount", "funding_total_usd", "raised_amount_usd", "funding_total"]
INVESTORS_ALIASES = ["investors_count", "investor_count", "participants"]
YEAR_ALIASES = ["founded_year", "founded_at"]

# Numeric model features, in the order the models see them.
NUMERIC_FEATURES = [
    "rule_of_40", "traction_index", "capital_efficiency", "burn_multiple",
    "runway_months", "funding_amount", "investors_count", "investment_score",
]
CATEGORICAL_FEATURES = ["stage", "sector", "country"]
# ---------------------------------------------------------------------------
