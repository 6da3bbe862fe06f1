"""The ``opN_<name>`` queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.llm import (
    conversations,
    divergence,
    langid,
    line_dedup,
    metric_join,
    minhash,
    mixing,
    periodic,
    pii,
    pst,
    quality,
    suffix_decon,
    token_counts,
)
from startlens.llm.text import doc_bucket


#: A public rank file of byte pieces; every query that needs one takes its path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _held_out(n: int, k: int):
    return F.coalesce(doc_bucket("doc_id", n) == k, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of those not held out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality").where(doc_bucket("doc_id", 4) != 2)
    voter = quality.train(docs, labels)
    out = docs.withColumn("score", quality.predict(spark, voter, F.col("text")))
    return out.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Unigram tokens and pre-tokens of every document."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = docs.withColumn("r", token_counts.token_counts(spark, F.col("text"), vocabulary))
    return out.select("doc_id", F.col("r.n_tokens").alias("n_tokens"), F.col("r.n_pretokens").alias("n_pretokens"))


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the same label with cosine 0.93 or more, and their components."""
    return metric_join.range_join(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node AND r.seen < l.b),
c AS (SELECT node AS vec_id, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents over 2-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), width=2)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node AND r.seen < e.b),
c AS (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.where(doc_bucket("doc_id", 5) != 0))
    out = docs.withColumn("r", langid.predict(spark, model, F.col("text")))
    return out.select("doc_id", _held_out(5, 0), F.col("r.lang_pred").alias("lang_pred"), F.col("r.score").alias("score"))


def op6_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a suffix tree of those not held out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = pst.score_texts(docs, doc_bucket("doc_id", 5) != 1)
    return out.select("doc_id", _held_out(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside verbatim matches with the benchmark."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = suffix_decon.find_matches(spark, docs, _table(spark, sf_dir, "benchmark", "item_id", "text"), "c")
    c = F.col("c")
    return out.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(c["matches"], lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest"),
    )


OP7_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id::VARCHAR AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', coalesce(item_id::VARCHAR, ''), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
i AS (SELECT id, ws, least(len(ws), 10) AS n FROM w WHERE kind = 'b' AND len(ws) > 0),
iw AS (SELECT id AS item, n, j, array_to_string(ws[j : j + n - 1], ' ') AS win
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS j FROM i)),
dw AS (SELECT id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS win
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM i) WHERE kind = 'd' AND len(ws) >= n)),
hit AS (SELECT dw.id, p, iw.item, iw.j, n FROM dw JOIN iw USING (n, win)),
cov AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY id),
its AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id),
run AS (SELECT id, n, j - row_number() OVER (PARTITION BY id, item, p - j ORDER BY p) AS r, item, p - j AS diag FROM (SELECT DISTINCT * FROM hit)),
lon AS (SELECT id, max(c) AS longest FROM (SELECT id, count(*) + any_value(n) - 1 AS c FROM run GROUP BY id, item, diag, r) GROUP BY id)
SELECT w.id::BIGINT AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM w LEFT JOIN cov USING (id) LEFT JOIN its USING (id) LEFT JOIN lon USING (id) WHERE kind = 'd'
"""


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150% of all words takes of every document."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370497.0 AS u
  FROM documents),
q AS (SELECT *, u / (1 - u) / (1::BIGINT << ((length(bin(size)) - 1) // 2))::DOUBLE AS ratio FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
c AS (SELECT *, 2.0 * source_size / w AS full_at,
    coalesce(sum(2.0 * source_size) OVER o, 0) AS got, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest,
    1.5 * sum(source_size) OVER () AS goal, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS i
  FROM k WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((goal - got) / rest, i) FILTER (WHERE full_at >= (goal - got) / rest) AS level FROM c),
t AS (SELECT source, source_size, least(2.0 * source_size, w * level)::DOUBLE AS target FROM k, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest
  FROM q d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
b AS (SELECT *, rest > 0 AND size > 0.05 * rest AS big FROM r),
g AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, big ORDER BY ratio, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(size) FILTER (WHERE big) OVER (PARTITION BY source) AS long_words FROM b),
h AS (SELECT *, CASE WHEN big AND start + size / 2.0 <= rest * long_words / source_size THEN 1 ELSE 0 END AS long_more FROM g),
j AS (SELECT *, greatest(0.0, least(rest - coalesce(sum(size * long_more) OVER (PARTITION BY source), 0),
    source_size - coalesce(long_words, 0))) AS goal FROM h),
x AS (SELECT *, whole + CASE WHEN big THEN long_more WHEN goal > 0 AND start + size / 2.0 <= goal THEN 1 ELSE 0 END AS copies FROM j)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM x
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses to the least document that holds them."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    sha = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_dropped", sha)


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, k.key IS NOT NULL AND k.owner <> l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    out = pii.find_spans(_table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def _crc_sql(text: str) -> str:
    """crc32 of an ASCII string, bit by bit, as DuckDB SQL: a number of 0 or
    more is a byte to add, -1 one of the eight shifts that follow it."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), {step}), 4294967295)"


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one in ten of which gets a repeated end."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # only the words of documents to be looped are laid out
    docs = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("w"), F.floor(h / 10)
    docs = docs.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    docs = docs.withColumn("p", F.when(n > 0, (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")))
    a, p = F.col("a"), F.col("p")
    looped = F.transform("w", lambda x, i: F.when(i >= a, F.get("w", a + (i - a) % p)).otherwise(x))
    text = F.when(n > 0, F.array_join(looped, " ")).otherwise(F.col("text"))
    out = docs.select("doc_id", text.alias("text")).withColumn("r", periodic.find_runs(spark, F.col("text")))
    out = out.select("doc_id", F.col("r.runs").alias("runs"), F.col("r.collapsed").alias("collapsed"))
    # the first of the runs (by start, then period) with the greatest length / period
    first = F.get("runs", F.lit(0))
    longer = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    out = out.withColumn("best", F.aggregate("runs", first, longer))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP11_SQL = (
    r"""
WITH h AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, """
    + _crc_sql("doc_id::VARCHAR")
    + r""" AS h FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS loops FROM h),
a AS (SELECT *, CASE WHEN loops THEN g % n END AS a FROM g),
p AS (SELECT *, CASE WHEN loops THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
x AS (SELECT doc_id, n, i, CASE WHEN loops AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
m AS (SELECT u.doc_id, v.i - u.i AS q, v.i AS i FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.w = v.w AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
s AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
b AS (SELECT doc_id, start, length, q AS period, (1000 * length) // q AS exponent_milli,
    row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / q DESC, start, q) AS k FROM r),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN dropped ON dropped.doc_id = x.doc_id AND dropped.i = x.i GROUP BY x.doc_id)
SELECT h.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
  b.exponent_milli::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM h LEFT JOIN b ON b.doc_id = h.doc_id AND b.k = 1 LEFT JOIN l ON l.doc_id = h.doc_id LEFT JOIN k ON k.doc_id = h.doc_id
"""
)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults dealt out by the hash of conv_id and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = out.withColumn("h", h).where("h <> 0")
    out = out.select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    summary, edits = conversations.repair(conversations.numbered(damaged(rows)))
    kept = edits.where("edit <> 'D'").groupBy(F.col("conv").alias("k"))
    lines = F.array_sort(F.collect_list(F.struct("row", "place", F.concat("role", F.lit(":"), "text").alias("line"))))
    repaired = kept.agg(F.array_join(lines["line"], "\n").alias("repaired"))
    out = rows.select("conv_id").distinct().join(summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    out = out.join(repaired, F.col("conv_id").eqNullSafe(F.col("k")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"),
    )


def _op12_sql() -> str:
    """Dynamic programming over rows from the last, with the least (cost,
    audit) and its repaired lines per state."""

    def step(v: str, cost: str, label: str, line: str = "''") -> str:
        return f"{{'c': {v}.c + {cost}, 'a': '{label}' || {v}.a, 't': {line} || {v}.t}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def insert(v: str, role: str) -> str:
        return step(v, "5", "I", f"'{role}:' || chr(10)")

    def closed(x: list[str]) -> str:
        both = f"{{'c': {x[3]}.c + 10, 'a': 'II' || {x[3]}.a, 't': 'user:' || chr(10) || 'assistant:' || chr(10) || {x[3]}.t}}"
        return ", ".join([
            f"{least(x[0], insert(x[2], 'user'), both)} AS v0",
            f"{least(x[1], insert(x[2], 'user'), both)} AS v1",
            f"{least(x[2], insert(x[3], 'assistant'))} AS v2",
            f"{least(x[3], insert(x[2], 'user'))} AS v3",
        ])

    def keep(v: str, initial: str) -> str:
        ok = f"fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate' AND left(role, 1) = '{initial}'"
        return step(v, f"CASE WHEN {ok} THEN cut ELSE 1000000 END", "K", "role || ':' || text || chr(10)")

    def rerole(v: str, role: str) -> str:
        ok = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'"
        return step(v, f"CASE WHEN {ok} THEN 1 + cut ELSE 1000000 END", "R", f"'{role}:' || text || chr(10)")

    end = ["{'c': 0, 'a': '', 't': ''}", "{'c': 1000000, 'a': '', 't': ''}"]
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql(key)} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE h <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, right(rtrim(text, {white}), 1) AS e FROM d),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN min(k) OVER (PARTITION BY conv_id, role, text) < k THEN 'duplicate'
    WHEN e NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, CASE WHEN e NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS cut,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM k),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
s AS (SELECT conv_id, n + 1 AS k, {closed([end[0], end[1], end[1], end[0]])} FROM n
  UNION ALL
  SELECT conv_id, k, {closed(["x0", "x1", "x2", "x3"])} FROM (
    SELECT s.conv_id, f.k, {least(step("v0", "2", "D"), keep("v1", "s"), keep("v2", "u"), rerole("v2", "user"))} AS x0,
      {least(step("v1", "2", "D"), keep("v2", "u"), rerole("v2", "user"))} AS x1,
      {least(step("v2", "2", "D"), keep("v3", "a"), rerole("v3", "assistant"))} AS x2,
      {least(step("v3", "2", "D"), keep("v2", "u"), rerole("v2", "user"))} AS x3
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k - 1)),
o AS (SELECT conv_id, v0 FROM s WHERE k = 1)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit,
  sha256(coalesce(left(v0.t, length(v0.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM i.conv_id
"""


OP12_SQL = _op12_sql()


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and distances to the language references of every document."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    references = divergence.learn(docs)
    out = docs.select("doc_id", divergence.assess(spark, references, F.col("text")).alias("r"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in names])


def _op13_sql() -> str:
    kinds = list(divergence.CLASSES.items())
    counts = ", ".join(f"length(regexp_replace(text, '[^{m}]', '', 'g')) AS {k}" for k, m in kinds)
    names = [k for k, _ in kinds]
    other = f"word_chars - {' - '.join(names)} AS other"
    shares = ", ".join(f"avg({k} / word_chars::DOUBLE) AS r_{k}" for k in [*names, "other"])

    def half(p: str, r: str) -> str:
        term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {r}) / 2)) ELSE 0 END"
        return f"({term(p)} + {term(r)}) / 2"

    chars = " + ".join(half(f"{k} / word_chars::DOUBLE", f"r_{k}") for k in [*names, "other"])
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    {counts}, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
x AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM x) WHERE c >= 2) GROUP BY doc_id),
b AS (SELECT w.*, {other}, len(ws) AS n_words, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws) AS base_failed FROM w LEFT JOIN rep USING (doc_id)),
rc AS (SELECT lang, {shares}, count(*) AS texts FROM b WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang),
v AS (SELECT doc_id, lang, n_words, base_failed, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM b),
vc AS (SELECT doc_id, lang, n_words, base_failed, word, count(*) AS c FROM v GROUP BY ALL),
rl AS (SELECT lang, word, sum(c) AS n, sum(c / n_words::DOUBLE) AS x FROM vc WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang, word),
rw AS (SELECT rl.lang, word, x / texts AS r FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM rl) rl JOIN rc USING (lang) WHERE 200 * n >= total),
dl AS (SELECT b.doc_id, b.n_words, rc.*, sqrt(greatest(0, {chars})) AS d_chars FROM b, rc WHERE n_words > 0),
dw AS (SELECT dl.doc_id, dl.lang, sum(coalesce(c, 0)) / any_value(dl.n_words)::DOUBLE AS p, sum(r) AS r,
    sum({half("coalesce(c, 0) / dl.n_words::DOUBLE", "r")}) AS known
  FROM dl JOIN rw ON rw.lang = dl.lang LEFT JOIN vc ON vc.doc_id = dl.doc_id AND vc.word = rw.word GROUP BY dl.doc_id, dl.lang),
do_ AS (SELECT doc_id, lang, sqrt(greatest(0, known + {half("(1 - p)", "greatest(0, 1 - r)")})) AS d_words FROM dw),
near AS (SELECT doc_id, min(d_chars) AS d_chars, min(coalesce(d_words, 0)) AS d_words FROM dl LEFT JOIN do_ USING (doc_id, lang) GROUP BY doc_id)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= 50 AND d_chars > 0.32, false) AND NOT coalesce(n_words >= 80 AND d_words > 0.3, false) AS kept
FROM b LEFT JOIN near USING (doc_id)
"""


OP13_SQL = _op13_sql()


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_links": op3_embedding_links,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_language_id": op5_language_id,
    "op6_suffix_tree_score": op6_suffix_tree_score,
    "op7_decontamination": op7_decontamination,
    "op8_source_mix": op8_source_mix,
    "op9_line_dedup": op9_line_dedup,
    "op10_personal_data": op10_personal_data,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE = {
    "op3_embedding_links": OP3_SQL,
    "op4_minhash_dedup": OP4_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_source_mix": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_quality_rules": OP13_SQL,
}
