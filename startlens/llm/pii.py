"""Personal data spans by candidate gradient boosting (operator 10).

All work on texts is DataFrame expressions; no Python runs on executors.

1. High-recall generators propose spans, which may overlap: e-mail
   addresses, dotted quads, long digit runs and ``+`` numbers, and beside
   them spelled-out addresses (``name [at] host [dot] org``), digit groups
   with other separators, national telephone forms and plain numbers.
   Offsets come from splitting a text at the matches and summing lengths.
2. Strict checks (octets up to 255, the Luhn sum, digit counts) accept the
   base spans, which always stay. All e-mail addresses are base spans; as
   examples they count as accepted if their ending (the last part, letters only)
   is one that at least 1 % of the corpus's addresses have, else as refused.
   Handles (``name@word``) and spelled-out addresses with another ending are refused
   too, and never added.
3. Gradient-boosted trees (MLlib) learn from proposals of those generators
   that have a strict check, accepted against refused, over features of the
   span's body and of its context. They see at most ``max_fit`` proposals, as
   many of each stratum (a generator's accepted or refused ones), the least by
   a hash, without a fifth of them. All other proposals of the corpus
   calibrate: each kind's threshold is the least score from which they reach
   ``min_precision``, every stratum weighted to its size in the corpus; a kind
   where none do adds nothing. A stratum so small that no proposal was left
   out calibrates with those learned from.
4. The trees become one column expression. Other proposals that reach their
   kind's threshold and overlap no base span are added.

Every pattern is written so that it takes linear time: runs are possessive
and begin only where a run can begin. Null text is empty. Rows that repeat
are each given their spans; texts of any length are searched whole.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from startlens.session import materialize

KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"[A-Za-z0-9._%+-]"
_HOST = r"[A-Za-z0-9-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

CHUNK = 128

#: generator: (kind, pattern, what a text must contain, whether a strict check applies)
GENERATORS = {
    # a run may also begin where the address before it ended
    "email": (0, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@", True),
    "ip": (1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", True),
    "card": (2, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", "[0-9]", True),
    "phone": (3, r"\+[0-9][\x20().0-9-]+[0-9]", "[+]", True),
    "spelled_email": (
        0,
        rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?{_HOST}++(?:\x20?(?:\.|[\[(]dot[\])])\x20?{_HOST}++)++",
        r"[\[(]at[\])]",
        False,
    ),
    "handle": (0, rf"(?<!{_LOCAL}){_LOCAL}*+@{_HOST}++(?!\.{_HOST})", "@", True),
    "parted_card": (2, r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])", "[0-9]", False),
    "national_phone": (3, r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]", False),
    "number": (3, r"(?<![0-9A-Za-z.+])[0-9]++(?:[.,:/-][0-9]++)++(?![0-9A-Za-z])", "[0-9]", False),
}
FEATURES = (
    "kind", "chars", "digits", "groups", "longest", "spaces", "dots", "dashes", "parens", "luhn", "low_octets", "letters",
    "letter_before", "letter_after", "cue", "ending",
)
CUES = r"(?i)(?:mail|contact|phone|tel|call|mobile|fax|card|visa|pay|account|server|host|address|ip)[^A-Za-z0-9]{0,4}(?:is|no|at)?[^A-Za-z0-9]{0,3}$"


def _spans(text: Column, generator: str) -> Column:
    """array<struct<start, end, value, left, right>> of all matches, in order."""
    kind, pattern, needs, _ = GENERATORS[generator]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none_type = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
    none = F.array().cast(none_type)
    parts = F.zip_with(
        F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(24)).alias("left"), v.alias("value"))
    )
    parts = F.zip_with(parts, F.slice(gaps, 2, F.size(found)), lambda p, g: F.struct(p["gap"].alias("gap"), p["left"].alias("left"), p["value"].alias("value"), F.left(g, F.lit(1)).alias("right")))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        span = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), p["left"].alias("left"), p["right"].alias("right"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def add_chunk(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        both = F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))
        return both[0]

    # an array is copied whole when it grows, so a long one grows by chunks
    chunks = F.transform(F.sequence(F.lit(1), F.size(found), F.lit(CHUNK)), lambda k: F.slice(parts, k, CHUNK))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{none_type}>").alias("out"))
    spans = F.flatten(F.aggregate(chunks, begin, add_chunk, lambda acc: acc["out"]))
    return F.when(F.contains(text, F.lit("@")) if needs == "@" else text.rlike(needs), F.when(F.size(found) > 0, spans).otherwise(none)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of ``value`` have a Luhn sum of 0 modulo 10."""
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10 == 0


def _low_octets(value: Column) -> Column:
    return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def _strict(generator: str, value: Column) -> Column:
    if generator == "ip":
        return _low_octets(value)
    if generator == "card":
        return _luhn(value)
    if generator == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(generator == "email")


def _count(value: Column, chars: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, chars, ""))


def common_endings(docs: DataFrame, text_col: str) -> list[str]:
    """Lower-case last parts that at least 1 % of all addresses end in, of two
    letters or more: at most 100, whatever the corpus."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(GENERATORS["email"][1]), F.lit(0))
    ends = docs.where(F.contains(F.col(text_col), F.lit("@"))).select(F.explode(found).alias("a"))
    ends = ends.groupBy(_last_part(F.col("a")).alias("end")).agg(F.count(F.lit(1)).alias("n"))
    ends = materialize(ends, "endings")
    total = ends.agg(F.sum("n")).scalar()
    common = ends.where((F.col("n") * 100 >= total) & F.col("end").rlike("^[a-z]{2,24}$"))
    return sorted(r["end"] for r in common.select("end").collect())


def _last_part(value: Column) -> Column:
    return F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))


def _features(generator: str, s: Column, endings: list[str]) -> Column:
    """Features of a span's body (without a leading +) and its context."""
    body = F.ltrim(s["value"], F.lit("+"))
    digits = F.length(_digits(body))
    groups = F.filter(F.split(body, "[^0-9]+"), lambda g: g != "")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = {
        "kind": F.lit(float(GENERATORS[generator][0])),
        "chars": F.length(body),
        "digits": digits,
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "spaces": _count(body, r"\x20"),
        "dots": _count(body, r"\."),
        "dashes": _count(body, "-"),
        "parens": _count(body, "[()]"),
        "luhn": flag(F.when(digits.between(12, 19), _luhn(body)).otherwise(False)),
        "low_octets": flag(_low_octets(body)),
        "letters": _count(body, "[A-Za-z]"),
        "letter_before": flag(s["left"].rlike(r"\p{L}$")),
        "letter_after": flag(s["right"].rlike(r"\p{L}")),
        "cue": flag(s["left"].rlike(CUES)),
        "ending": flag(_plausible(generator, s["value"], endings)),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def _plausible(generator: str, value: Column, endings: list[str]) -> Column:
    return _last_part(value).isin(*endings) if GENERATORS[generator][0] == 0 and generator != "handle" and endings else F.lit(False)


def _proposals(endings: list[str]) -> Column:
    """All proposals of all generators, with kind, strict result and features."""

    def of(generator: str) -> Column:
        kind, _, _, checked = GENERATORS[generator]

        def label(s: Column) -> Column:
            """What the proposal teaches: accepted or refused."""
            return _plausible(generator, s["value"], endings) if kind == 0 else _strict(generator, s["value"])

        def teaches(s: Column) -> Column:
            # plain numbers teach what is no telephone number
            return ~label(s) if generator == "spelled_email" else F.lit(checked or generator == "number")

        def offered(s: Column) -> Column:
            return label(s) if generator == "spelled_email" else F.lit(generator not in ("number", "handle"))

        return F.transform(
            F.col(f"__{generator}"),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(kind).alias("kind"),
                F.lit(list(GENERATORS).index(generator)).alias("generator"),
                s["end"].alias("end"),
                _strict(generator, s["value"]).alias("base"),
                label(s).alias("label"),
                teaches(s).alias("checked"),
                offered(s).alias("offered"),
                _features(generator, s, endings).alias("f"),
            ),
        )

    return F.concat(*[of(g) for g in GENERATORS])


def proposals(docs: DataFrame, text_col: str, out_col: str, endings: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumns({f"__{g}": _spans(text, g) for g in GENERATORS})
    return docs.withColumn(out_col, _proposals(endings)).drop(*[f"__{g}" for g in GENERATORS])


# ---- boosted trees --------------------------------------------------------


def _tree(lines: list[str], f: Column) -> Column:
    """A column for one tree of MLlib's ``toDebugString`` (lines are consumed)."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    feature, limit = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
    low = _tree(lines, f)
    lines.pop(0)  # Else
    return F.when(f[FEATURES[int(feature)]] <= float(limit), low).otherwise(_tree(lines, f))


class SpanModel:
    """Trees as text, their weights, the kinds' thresholds and the common endings."""

    def __init__(self, trees: list[tuple[float, str]], thresholds: list[float | None], endings: list[str]):
        self.trees, self.thresholds, self.endings = trees, thresholds, endings

    def score(self, f: Column) -> Column:
        sums = [F.lit(w) * _tree([x for x in t.splitlines() if x.strip()][1:], f) for w, t in self.trees]
        return 1.0 / (1.0 + F.exp(F.lit(-2.0) * reduce(lambda a, b: a + b, sums)))


def fit(docs: DataFrame, text_col: str, id_col: str, max_fit: int, trees: int, depth: int, min_precision: float) -> SpanModel | None:
    """None if the corpus has no accepted or no refused proposals to learn from."""
    endings = common_endings(docs, text_col)
    found = proposals(docs.select(id_col, text_col), text_col, "__p", endings).select(id_col, F.explode("__p").alias("p")).where("p.checked")
    order = F.xxhash64(F.col(id_col), "p.start", "p.kind")
    found = materialize(found.select("p.f", F.col("p.label").cast("double").alias("label"), "p.kind", "p.generator", order.alias("h")), "proposals")
    sizes = {(r["generator"], r["label"]): r["count"] for r in found.groupBy("generator", "label").count().collect()}
    if len({label for _, label in sizes}) < 2:
        return None
    quota = max_fit if sum(sizes.values()) <= max_fit else max(max_fit // len(sizes), 1)

    def of_stratum(values: dict) -> Column:
        return reduce(lambda c, k: c.when((F.col("generator") == k[0]) & (F.col("label") == k[1]), F.lit(values[k])), values, F.when(F.lit(False), F.lit(None)))

    # a bound of the hash leaves about twice the quota of each stratum to sort
    top = 1 << 40
    found = found.withColumn("u", F.pmod("h", F.lit(top)))
    least = found.where(F.col("u") < of_stratum({k: top if n <= 2 * quota else top * 2 * quota // n for k, n in sizes.items()}))
    least = least.withColumn("place", F.row_number().over(Window.partitionBy("generator", "label").orderBy("u"))).where(F.col("place") <= quota)
    rows = sorted(least.select("f", "label", "kind", "generator", "h", "u").collect())  # at most max_fit rows
    last = {k: max((r["u"] for r in rows if (r["generator"], r["label"]) == k), default=-1) for k in sizes}
    learned = (F.col("u") <= of_stratum(last)) & (F.pmod("h", F.lit(5)) != 0)
    spark = docs.sparkSession
    sample = spark.createDataFrame(
        [(float(r["label"]), *r["f"]) for r in rows if r["h"] % 5 != 0], "label double, " + ", ".join(f"x_{f} double" for f in FEATURES)
    ).coalesce(1)
    learn = VectorAssembler(inputCols=[f"x_{f}" for f in FEATURES], outputCol="features").transform(sample).select("label", "features")
    if learn.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, subsamplingRate=1.0).fit(learn)
    fitted = SpanModel(list(zip(model.treeWeights, [t.toDebugString for t in model.trees])), [], endings)
    # trees of bounded depth have a bounded number of scores
    scored = found.select("kind", "generator", "label", learned.alias("learned"), fitted.score(F.col("f")).alias("score"))
    counts = scored.groupBy("kind", "generator", "label", "learned", "score").count().collect()
    out: dict = {}
    for r in counts:
        if not r["learned"]:
            out[r["generator"], r["label"]] = out.get((r["generator"], r["label"]), 0) + r["count"]
    for kind in range(len(KINDS)):
        by_score: dict = {}
        for r in counts:
            k = r["generator"], r["label"]
            if r["kind"] == kind and (k not in out or not r["learned"]):
                by_score.setdefault(r["score"], [0.0, 0.0])[int(r["label"])] += r["count"] * sizes[k] / out.get(k, sizes[k])
        hits, n, least_score = 0.0, 0.0, None
        for score in sorted(by_score, reverse=True):
            hits, n = hits + by_score[score][1], n + sum(by_score[score])
            if hits / n >= min_precision:
                least_score = score
        fitted.thresholds.append(least_score)
    return fitted


def find_spans(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    max_fit: int = 5000,
    trees: int = 6,
    depth: int = 3,
    min_precision: float = 0.99,
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: array<struct<start, kind,
    end>> in order, kind a place in ``KINDS``, offsets in code points. Other
    columns pass through, whatever their names; columns by these two names are
    replaced. Added spans overlap no base span; two added ones of different
    kinds may overlap each other, and both stay."""
    kept = [c for c in docs.columns if c.lower() not in ("base_spans", "spans")]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = _found_spans(docs, fit(docs, "text", "id", max_fit, trees, depth, min_precision))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "base_spans", "spans")


def _found_spans(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    out = proposals(docs, "text", "__p", model.endings if model else [])
    plain = lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))
    out = out.withColumn("base_spans", F.array_sort(F.transform(F.filter("__p", lambda p: p["base"]), plain)))
    if model is None:
        return out.withColumn("spans", F.col("base_spans")).drop("__p")
    limit = F.array(*[F.lit(x).cast("double") for x in model.thresholds])
    others = F.filter("__p", lambda p: ~p["base"] & p["offered"])
    scored = F.transform(others, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"), model.score(p["f"]).alias("score")))
    out = out.withColumn("__s", scored)
    clear = lambda p: ~F.exists("base_spans", lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"]))
    more = F.filter("__s", lambda p: F.coalesce(p["score"] >= F.get(limit, p["kind"]), F.lit(False)) & clear(p))
    spans = F.array_sort(F.array_union(F.col("base_spans"), F.transform(more, plain)))
    return out.withColumn("spans", spans).drop("__p", "__s")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with the characters of every span replaced by one mark per
    run of overlapping spans."""
    keep = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[PII]")))
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    return F.concat(keep["out"], F.substring(text, keep["at"] + 1, F.length(text)))
