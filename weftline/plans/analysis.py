"""Queries of run analysis, evaluation, tokenizers, mixing and schedules.

``events`` stands for run logs: run_id is user_id, line_no the place by time, val_loss the value of ``view`` events, train_loss any value.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import schedules as L
from weftline.functions import text as X
from weftline.functions.session import materialise, table
from weftline.operators import corpus as C
from weftline.operators import mixing as M
from weftline.operators import runs as R
from weftline.operators import scores as S
from weftline.operators import tokenizer as K

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_RUNS = """WITH m AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, CASE WHEN event_type = 'view' THEN value END AS val_loss,
  CASE WHEN event_id % 997 = 0 THEN 'nan'::DOUBLE ELSE value END AS train_loss, value * 100 AS tok_s, event_type, value, ts, event_id FROM events) """


def _metrics(spark, d):
    e = table(spark, d, "events")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    m = e.select(F.col("user_id").alias("run_id"), line.alias("line_no"), F.when(F.col("event_type") == "view", F.col("value")).alias("val_loss"), F.when(F.col("event_id") % 997 == 0, float("nan")).otherwise(F.col("value")).alias("train_loss"), (F.col("value") * 100).alias("tok_s"), "event_type", "value")
    return m.withColumn("step", F.col("line_no"))


_SUMMARY = """s AS (SELECT run_id, min(val_loss) AS best, arg_min(line_no, (val_loss, line_no)) AS best_step, arg_min(val_loss, line_no) AS first, arg_max(val_loss, line_no) AS final, avg(val_loss) AS mean, count(*) AS points FROM m WHERE val_loss IS NOT NULL GROUP BY run_id)"""


@query(_RUNS + ", " + _SUMMARY + " SELECT run_id, best, CAST(best_step AS INTEGER) AS best_step, first, final, round(mean, 9) AS mean, points, round(final - best, 9) AS overfit_gap, round(final - first, 9) AS drift, round(100 * (final - first) / first, 9) AS drift_percent FROM s")
def run_summary(spark, d):
    """Best, first and final loss of each run and the gaps between them."""
    s = R.summary(_metrics(spark, d))
    return s.select("run_id", "best", "best_step", "first", "final", *(F.round(c, 9).alias(c) for c in ("mean", "overfit_gap", "drift", "drift_percent")), "points")


@query(_RUNS + "SELECT run_id, line_no AS step, round(val_loss - first_value(val_loss) OVER (PARTITION BY run_id ORDER BY line_no), 9) AS forgetting FROM m WHERE val_loss IS NOT NULL")
def forgetting_curve(spark, d):
    m = _metrics(spark, d).where("val_loss IS NOT NULL")
    first = m.groupBy("run_id").agg(F.min_by("val_loss", "line_no").alias("first"))
    return m.join(first, "run_id").select("run_id", F.col("step").cast("bigint").alias("step"), F.round(F.col("val_loss") - F.col("first"), 9).alias("forgetting"))


@query(_RUNS + ", w AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM m) SELECT run_id, round(avg(tok_s), 6) AS steady, count(*) AS points FROM w WHERE n <= 4 OR k > 2 GROUP BY run_id")
def steady_throughput(spark, d):
    return R.steady(_metrics(spark, d)).withColumn("steady", F.round("steady", 6))


@query(_RUNS + """, b AS (SELECT run_id, bool_or(isnan(train_loss) OR isinf(train_loss)) AS diverged, min(val_loss) AS best FROM m GROUP BY run_id), c AS (SELECT run_id, diverged, CASE WHEN NOT diverged THEN best END AS best FROM b)
SELECT *, run_id = (SELECT run_id FROM c WHERE best IS NOT NULL ORDER BY best, run_id LIMIT 1) AS winner FROM c""")
def run_leaderboard(spark, d):
    """Best loss of the runs that never diverged, and the winner."""
    return R.leaderboard(_metrics(spark, d), ["train_loss", "val_loss"])


@query(_RUNS + ", " + _SUMMARY + """, g AS (SELECT CAST(run_id // 3 AS BIGINT) AS config, avg(best) AS mean, stddev_pop(best) AS std, max(best) - min(best) AS spread, count(*) AS runs FROM s GROUP BY 1), f AS (SELECT *, mean - first_value(mean) OVER (ORDER BY config) AS delta FROM g)
SELECT config, round(mean, 9) AS mean, round(std, 9) AS std, round(spread, 9) AS spread, runs, round(delta, 9) AS delta, CASE WHEN abs(delta) <= 0.015 THEN 'noise' WHEN delta < 0 THEN 'better' ELSE 'worse' END AS verdict FROM f""")
def noise_floor(spark, d):
    """Runs in groups of three as seeds of one configuration, against the first configuration."""
    g = R.noise_floor(R.summary(_metrics(spark, d)).withColumn("config", F.expr("run_id div 3")), "config")
    base = g.agg(F.min_by("mean", "config").alias("base"))
    g = g.crossJoin(F.broadcast(base)).withColumn("delta", F.col("mean") - F.col("base"))  # one row
    return g.select("config", *(F.round(c, 9).alias(c) for c in ("mean", "std", "spread", "delta")), "runs", R.verdict(F.col("delta")).alias("verdict"))


@query(_RUNS + ", " + _SUMMARY + " SELECT run_id, best, (SELECT best FROM s WHERE run_id = 1) AS control, round(best - (SELECT best FROM s WHERE run_id = 1), 9) AS delta FROM s")
def control_delta(spark, d):
    out = R.against(R.summary(_metrics(spark, d)).select("run_id", "best"), 1)
    return out.withColumn("delta", F.round("delta", 9))


@query(_RUNS + """, p AS (SELECT run_id, line_no AS k, tok_s AS rate, coalesce(tok_s < 1.05 * max(tok_s) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS flat FROM m),
q AS (SELECT *, coalesce(sum(flat::INT) OVER (PARTITION BY run_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM p)
SELECT run_id, count(*) AS tried, CAST(arg_max(k, (rate, -k)) AS INTEGER) AS sweet_spot, max(rate) AS rate FROM q WHERE stopped = 0 GROUP BY run_id""")
def plateau_sweet_spot(spark, d):
    return R.plateau(_metrics(spark, d).select("run_id", F.col("line_no").alias("k"), F.col("tok_s").alias("rate")))


@query("""
WITH p AS (SELECT l_linenumber + 0.0 AS n, avg(l_extendedprice) / 10000 + 2.0 / l_linenumber AS loss FROM lineitem GROUP BY l_linenumber), k AS (SELECT range AS k, (SELECT min(loss) FROM p) * 0.98 * range / 399 AS c FROM range(400)),
f AS (SELECT k, c, regr_slope(ln(loss - c), ln(n)) AS s, regr_intercept(ln(loss - c), ln(n)) AS i FROM p, k WHERE loss > c GROUP BY k, c),
e AS (SELECT k, c, s, i, sum((exp(i) * pow(n, s) + c - loss) ** 2) AS sse FROM p, f GROUP BY k, c, s, i)
SELECT round(exp(i), 5) AS a, round(-s, 5) AS alpha, round(c, 5) AS c, round(sse, 6) AS sse FROM e ORDER BY e.sse, k LIMIT 1""")
def scaling_fit(spark, d):
    """Power law of a loss that falls with the line number: a, alpha and the irreducible part c."""
    p = table(spark, d, "lineitem").groupBy("l_linenumber").agg((F.avg("l_extendedprice") / 10000).alias("p")).select(F.col("l_linenumber").cast("double").alias("n"), (F.col("p") + 2.0 / F.col("l_linenumber")).alias("loss"))
    return R.power_law(p).select(F.round("a", 5).alias("a"), F.round("alpha", 5).alias("alpha"), F.round("c", 5).alias("c"), F.round("sse", 6).alias("sse"))


@query("""
SELECT event_type AS backend, count(*) AS calls, CAST(sum(k) AS BIGINT) AS hit, round(sum((k * 0.07 + (100 + value - k) * 0.27 + value * 1.1) / 1e6), 9) AS usd, round(100.0 * sum(k) / greatest(1, sum(100 + value)), 6) AS hit_percent
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def usage_totals(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    e = table(spark, d, "events").select(F.col("event_type").alias("backend"), "value", k.alias("k"))
    cost = L.usage_cost(F.col("k"), 100 + F.col("value"), F.col("value"), (0.07, 0.27, 1.1))
    return e.groupBy("backend").agg(F.count("*").alias("calls"), F.sum("k").alias("hit"), F.round(F.sum(cost), 9).alias("usd"), F.round(100.0 * F.sum("k") / F.greatest(F.lit(1), F.sum(100 + F.col("value"))), 6).alias("hit_percent"))


@query("""
WITH r AS (SELECT user_id AS run_id, CASE user_id % 2 WHEN 0 THEN 's' ELSE 'm' END AS tier, sum(value) * 1e6 AS tokens, avg(value) * 1000 AS tok_s, 0.25 + user_id % 3 AS usd_hour FROM events GROUP BY user_id)
SELECT run_id, tier, round(tokens / tok_s / 3600, 6) AS hours, round(tokens / tok_s / 3600 * usd_hour, 6) AS usd, round(tok_s / min(tok_s) OVER (PARTITION BY tier), 6) AS speed_up FROM r""")
def cost_table(spark, d):
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg((F.sum("value") * 1e6).alias("tokens"), (F.avg("value") * 1000).alias("tok_s"))
    r = r.withColumn("tier", F.when(F.col("run_id") % 2 == 0, "s").otherwise("m")).withColumn("usd_hour", 0.25 + F.col("run_id") % 3)
    return R.costs(r).select("run_id", "tier", *(F.round(c, 6).alias(c) for c in ("hours", "usd", "speed_up")))


@query("SELECT user_id % 3 AS variant, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{e}'), 6) AS {e}" for e in ("view", "click", "error", "purchase", "signup")) + " FROM events GROUP BY 1")
def variant_table(spark, d):
    """Mean value by variant and kind, kinds as columns."""
    kinds = ["view", "click", "error", "purchase", "signup"]
    t = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("variant")).pivot("event_type", kinds).agg(F.round(F.avg("value"), 6))
    return t


@query(_RUNS + ", " + _SUMMARY + " SELECT s.run_id, s.best, c.c_name AS config FROM s LEFT JOIN customer c ON c.c_custkey = s.run_id")
def runs_with_config(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("config"))
    return R.summary(_metrics(spark, d)).select("run_id", "best").join(c, "run_id", "left")


@query(_RUNS + """, b AS (SELECT run_id, (line_no - 1) // 8 AS batch, avg(value) AS m, sum(value) AS s, count(value) AS n FROM m GROUP BY 1, 2)
SELECT run_id, round(avg(m), 9) AS mean_of_batches, round(sum(s) / sum(n), 9) AS mean FROM b GROUP BY run_id""")
def batch_mean_loss(spark, d):
    m = _metrics(spark, d).withColumn("batch", F.expr("(line_no - 1) div 8"))
    out = S.mean_of_batches(m, "batch", "value", ["run_id"])
    return out.select("run_id", F.round("mean_of_batches", 9).alias("mean_of_batches"), F.round("mean", 9).alias("mean"))


_TOKENS = r"t AS (SELECT doc_id, lower(trim(source)) AS source, regexp_extract_all(lower(text), '[a-z'']+') AS words, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL)"
_LM = f"WITH {_TOKENS}" + """, p AS (SELECT doc_id, source, unnest(words[:len(words) - 1]) AS a, unnest(words[2:]) AS b FROM t WHERE len(words) > 1), ab AS (SELECT a, b, count(*) AS ab FROM p GROUP BY a, b), na AS (SELECT a, sum(ab) AS na FROM ab GROUP BY a),
l AS (SELECT p.doc_id, p.source, p.b AS word, ln((ab.ab + 1) / (na.na + (SELECT count(DISTINCT b) FROM p))) AS logprob FROM p JOIN ab USING (a, b) JOIN na USING (a)) """


def _words(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", C.source_name(F.col("source")).alias("source"), X.letters_words(F.col("text")).alias("words"), F.octet_length("text").alias("bytes"))


@query(_LM + "SELECT l.source, count(*) AS tokens, round(exp(-sum(logprob) / count(*)), 6) AS perplexity, round(-sum(logprob) / ln(2) / any_value(z.bytes), 6) AS bits_per_byte FROM l JOIN (SELECT source, sum(bytes) AS bytes FROM t GROUP BY source) z USING (source) GROUP BY l.source")
def perplexity_by_source(spark, d):
    """Perplexity and bits a byte of a bigram model over the documents' words."""
    t = _words(spark, d)
    out = S.perplexities(S.bigram_model(t), "source", t.groupBy("source").agg(F.sum("bytes").alias("bytes")))
    return out.select("source", "tokens", F.round("perplexity", 6).alias("perplexity"), F.round("bits_per_byte", 6).alias("bits_per_byte"))


_CHOICES = f"WITH {_TOKENS}" + r""", u AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM t) GROUP BY w), z AS (SELECT sum(n) AS n FROM u),
c AS (SELECT item_id, category, correct_idx, unnest(choices) AS choice, unnest(range(len(choices))) AS k FROM domain_probes), x AS (SELECT item_id, category, correct_idx, k, unnest(regexp_extract_all(lower(choice), '[a-z'']+')) AS w FROM c),
s AS (SELECT item_id, category, correct_idx, k, round(avg(ln((coalesce(u.n, 0) + 1) / (z.n + 1))), 9) AS score FROM x LEFT JOIN u USING (w), z GROUP BY ALL),
b AS (SELECT item_id, any_value(category) AS category, any_value(correct_idx) AS correct_idx, arg_max(k, (score, -k)) AS picked FROM s GROUP BY item_id) """


def _picked(spark, d):
    u = _words(spark, d).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    z = u.agg(F.sum("n").alias("z"))
    p = table(spark, d, "domain_probes").select("item_id", "category", "correct_idx", F.posexplode("choices").alias("choice", "text"))
    x = p.select("item_id", "choice", F.explode(X.letters_words(F.col("text"))).alias("w")).join(u, "w", "left").crossJoin(F.broadcast(z))  # one row
    scored = x.groupBy("item_id", "choice").agg(F.round(F.avg(F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("z") + 1))), 9).alias("score"))
    return S.choose(scored).join(p.select("item_id", "category", "correct_idx").distinct(), "item_id")


@query(_CHOICES + "SELECT CASE WHEN GROUPING(category) = 1 THEN 'TOTAL' ELSE category END AS category, count(*) AS items, round(avg((picked = correct_idx)::INT), 6) AS accuracy FROM b GROUP BY ROLLUP(category)")
def choice_accuracy(spark, d):
    """Multiple-choice items answered by the greatest mean log-probability, by category and over all."""
    out = S.accuracy(_picked(spark, d).withColumn("correct", F.col("picked") == F.col("correct_idx")), "category")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(r"""SELECT item_id, list_max(list_transform(choices, lambda c: len(regexp_extract_all(c, '[^\s\p{Z}]+')))) < 20 AS scored FROM domain_probes""")
def choice_length_guard(spark, d):
    """Items are scored only if every choice is shorter than the window."""
    n = F.array_max(F.transform("choices", lambda c: F.size(X.words(c))))
    return table(spark, d, "domain_probes").select("item_id", (n < 20).alias("scored"))


@query(r"""
WITH g AS (SELECT task, list_position(regexp_extract_all(lower(response), '[a-z'']+')[:32], 'the') AS k FROM generated_rows WHERE response IS NOT NULL)
SELECT task, count(*) AS n, round(avg((k IS NOT NULL)::INT), 6) AS stop_rate, round(avg(coalesce(k - 1, 32)), 6) AS mean_length FROM g GROUP BY task""")
def stop_rate(spark, d):
    """How often, and after how many words, an end mark (here the word ``the``) comes within the budget, by task."""
    g = table(spark, d, "generated_rows").where("response IS NOT NULL").select("task", X.letters_words(F.col("response")).alias("tokens"))
    out = S.stops(g, F.lit("the"), 32, ["task"])
    return out.select("task", "n", F.round("stop_rate", 6).alias("stop_rate"), F.round("mean_length", 6).alias("mean_length"))


@query("""
WITH p AS (SELECT value - floor(value) AS c, event_id % 3 = 0 AS ok FROM events), b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS confidence, avg(ok::INT) AS accuracy FROM p GROUP BY 1)
SELECT CAST(bin AS BIGINT) AS bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(abs(confidence - accuracy) * n / sum(n) OVER (), 6) AS error FROM b""")
def calibration_bins(spark, d):
    p = table(spark, d, "events").select((F.col("value") - F.floor("value")).alias("confidence"), (F.col("event_id") % 3 == 0).alias("correct"))
    return S.calibration(p).select("bin", "n", *(F.round(c, 6).alias(c) for c in ("confidence", "accuracy", "error")))


@query("""
WITH p AS (SELECT l_returnflag AS flag, -l_quantity AS pc, -l_extendedprice / 2000 AS pr, -l_quantity * (1 + l_tax) AS fc, -l_extendedprice / 2000 * (1 - l_discount) AS fr FROM lineitem), r AS (SELECT *, 0.1 * (pc - fc) AS rc, 0.1 * (pr - fr) AS rr FROM p)
SELECT flag, count(*) AS pairs, round(avg(CASE WHEN rc >= rr THEN ln(1 + exp(rr - rc)) ELSE rr - rc + ln(1 + exp(rc - rr)) END), 6) AS loss, round(avg(rc - rr), 6) AS margin, round(avg((rc > rr)::INT), 6) AS accuracy,
  round(avg(pc - fc), 6) AS kl_chosen, round(avg(pr - fr), 6) AS kl_rejected, round(avg((pc > pr)::INT), 6) AS preferred, round(avg(pc - pr), 6) AS gap FROM r GROUP BY flag""")
def preference_metrics(spark, d):
    """Rewards of pairs by return flag, the four log-probabilities taken from the order lines' numbers."""
    chosen, rejected = -F.col("l_quantity"), -F.col("l_extendedprice") / 2000
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), chosen.alias("policy_chosen"), rejected.alias("policy_rejected"), (chosen * (1 + F.col("l_tax"))).alias("ref_chosen"), (rejected * (1 - F.col("l_discount"))).alias("ref_rejected"))
    out = S.preference(p, "flag")
    return out.select("flag", "pairs", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query(f"WITH {_TOKENS}" + """, g AS (SELECT doc_id, words, list_transform(range(1, greatest(len(words), 1)), lambda i: words[i:i + 1]) AS g2, list_transform(range(1, greatest(len(words) - 2, 1)), lambda i: words[i:i + 3]) AS g4 FROM t)
SELECT doc_id, round(CASE WHEN len(words) > 0 THEN len(list_distinct(words)) / len(words) ELSE 0 END, 9) AS distinct_1, round(CASE WHEN len(g2) > 0 THEN len(list_distinct(g2)) / len(g2) ELSE 0 END, 9) AS distinct_2, round(CASE WHEN len(words) >= 4 THEN 1 - len(list_distinct(g4)) / len(g4) ELSE 0 END, 9) AS seq_rep_4 FROM g""")
def diversity(spark, d):
    t = _words(spark, d)
    w = F.col("words")
    return t.select("doc_id", F.round(X.distinct_share(w, 1), 9).alias("distinct_1"), F.round(X.distinct_share(w, 2), 9).alias("distinct_2"), F.round(F.when(F.size(w) >= 4, 1 - X.distinct_share(w, 4)).otherwise(0.0), 9).alias("seq_rep_4"))


@query(f"WITH {_TOKENS}" + """, c AS (SELECT source, flatten(list(words ORDER BY doc_id)) AS w FROM t GROUP BY source), g AS (SELECT source, len(w) AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM c)
SELECT source, round(count(DISTINCT g) / count(*), 9) AS distinct_2 FROM g GROUP BY source""")
def aggregate_diversity(spark, d):
    """Different word pairs over all word pairs of each source's documents laid end to end, pairs across documents included."""
    out = S.diversity_of_groups(_words(spark, d).select("source", "doc_id", F.col("words").alias("tokens")), "source", "doc_id", 2)
    return out.where("distinct_2 > 0").withColumn("distinct_2", F.round("distinct_2", 9))  # the SQL has no row for a source without pairs


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(k AS BIGINT) AS k, md5(array_to_string(words[k * 64 + 1:k * 64 + 64], ' ')) AS x, md5(array_to_string(words[k * 64 + 2:k * 64 + 65], ' ')) AS y FROM (SELECT doc_id, words, unnest(range((len(words) - 1) // 64)) AS k FROM t)")
def token_windows(spark, d):
    """Windows of 64 words without overlap, targets shifted by one; the rest is dropped."""
    n = F.expr("(size(words) - 1) div 64")
    w = _words(spark, d).where(n >= 1).select("doc_id", "words", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("k"))
    part = lambda o: F.md5(F.array_join(F.slice("words", F.col("k") * 64 + o, F.lit(64)), " "))
    return w.select("doc_id", F.col("k").cast("bigint").alias("k"), part(1).alias("x"), part(2).alias("y"))


_SPANS = f"WITH {_TOKENS}" + ", n AS (SELECT doc_id, source, len(words) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_no FROM t WHERE len(words) + 1 > 64), cnt AS (SELECT source, count(*) AS docs FROM n GROUP BY source), "
_DRAWS = """wt AS (SELECT source, weight / (SELECT sum(weight) FROM source_weights WHERE source IN (SELECT lower(trim(source)) FROM documents WHERE text IS NOT NULL)) AS p FROM source_weights WHERE source IN (SELECT lower(trim(source)) FROM documents WHERE text IS NOT NULL)), cum AS (SELECT source, sum(p) OVER (ORDER BY source) AS hi, row_number() OVER (ORDER BY source DESC) AS last FROM wt),
g AS (SELECT range // 8 AS step, range % 8 AS slot FROM range(1600)), u AS (SELECT step, slot, CAST('0x' || substr(sha1('7:' || step || ':' || slot), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM g),
dr AS (SELECT step, slot, (SELECT min(source) FROM cum WHERE u.u < cum.hi OR cum.last = 1) AS source FROM u) """


def _draws(spark, d):
    """Only sources with documents take part."""
    there = table(spark, d, "documents").where("text IS NOT NULL").select(C.source_name(F.col("source")).alias("source")).distinct()
    return M.draws(table(spark, d, "source_weights").join(there, "source", "left_semi"), 200, 8, 7)


@query("WITH " + _DRAWS + "SELECT CAST(step AS BIGINT) AS step, CAST(slot AS BIGINT) AS slot, source FROM dr")
def mix_draws(spark, d):
    return _draws(spark, d)


@query("WITH " + _DRAWS + "SELECT source, count(*) AS n, round(count(*) / 1600.0, 9) AS share FROM dr GROUP BY source")
def mix_ratio(spark, d):
    return _draws(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.count("*") / 1600.0, 9).alias("share"))


@query(_SPANS + _DRAWS + """, v AS (SELECT dr.*, cnt.docs, CAST('0x' || substr(sha1('8:' || step || ':' || slot), 1, 13) AS BIGINT) / 4503599627370496.0 AS u1, CAST('0x' || substr(sha1('9:' || step || ':' || slot), 1, 13) AS BIGINT) / 4503599627370496.0 AS u2 FROM dr JOIN cnt USING (source))
SELECT CAST(step AS BIGINT) AS step, CAST(slot AS BIGINT) AS slot, v.source, n.doc_id, CAST(floor(u2 * (n.tokens - 64)) AS BIGINT) AS start FROM v JOIN n ON n.source = v.source AND n.doc_no = floor(v.u1 * v.docs)""")
def mix_windows(spark, d):
    """A window within one document for each draw; documents without room are left out."""
    w = _words(spark, d).select("doc_id", "source", F.size("words").alias("tokens")).where("tokens + 1 > 64")
    return M.windows(_draws(spark, d), C.running_before(w, F.lit(1), ["doc_id"], ["source"], "doc_no"), 64, 7)


@query(f"WITH {_TOKENS}" + r""", w AS (SELECT d.doc_id, unnest(string_split(d.text, ' ')) AS chunk FROM documents d WHERE text IS NOT NULL), c AS (SELECT chunk, count(*) AS freq, hex(encode(chunk)) AS h FROM w WHERE chunk <> '' GROUP BY chunk),
p AS (SELECT freq, unnest(list_transform(range(0, length(h) // 2 - 1), lambda i: substr(h, 2 * i + 1, 4))) AS ab FROM c)
SELECT CAST('0x' || substr(ab, 1, 2) AS INTEGER) AS a, CAST('0x' || substr(ab, 3, 2) AS INTEGER) AS b, CAST(sum(freq) AS BIGINT) AS n FROM p GROUP BY ab""")
def byte_pair_counts(spark, d):
    """Pairs of neighbouring bytes within parts between spaces."""
    t = K.chunks(table(spark, d, "documents").select("doc_id", "text"), "whitespace")
    return K.pair_counts(t).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n")


# Vocabularies at which the reference measures compression; the largest one is trained.
VOCABULARIES = (256, 500, 1000, 2000, 3000, 4000, 6000, 8000)


def _bpe(spark, d, merges=VOCABULARIES[-1] - 256):
    t = materialise(K.chunks(table(spark, d, "documents").select("doc_id", "text")), "chunks")
    return t, K.train(t, merges)


@query()
def bpe_merges(spark, d):
    """The merges of a vocabulary of 8000 trained on all documents (iterative, so without SQL; tested against a plain trainer)."""
    _, m = _bpe(spark, d)
    v = K.vocabulary(m)
    return spark.createDataFrame([(*x, v[x[3]].hex()) for x in m], "rank int, left int, right int, new_id int, n bigint, bytes string")


@query()
def bpe_fertility(spark, d):
    """Tokens a word and bytes a token by source, as ratios of sums."""
    t, m = _bpe(spark, d)
    ids = K.encode_documents(table(spark, d, "documents").select("doc_id", "text"), m)
    size = table(spark, d, "documents").select("doc_id", C.source_name(F.col("source")).alias("source"), X.n_words(F.col("text")).alias("words"), F.octet_length("text").alias("bytes"))
    each = ids.select("doc_id", F.size("ids").alias("tokens")).join(size, "doc_id")
    return each.groupBy("source").agg(F.round(F.sum("tokens") / F.sum("words"), 6).alias("fertility"), F.round(F.sum("bytes") / F.sum("tokens"), 6).alias("bytes_per_token"))


@query()
def bpe_compression(spark, d):
    """Bytes a token at each vocabulary, with only so many of the merges."""
    t, m = _bpe(spark, d)
    return K.compression(t, m, [v - 256 for v in VOCABULARIES])


def _rare_words(spark, d):
    w = table(spark, d, "seeds").where("seed_kind = 'dictionary'").select(F.col("raw")["word"].alias("word")).distinct()
    return w.where(F.col("word").rlike("^[a-zA-Z]+$") & (F.length("word") >= 12)).orderBy(X.order_key(7, F.col("word")), "word").limit(20)


@query()
def vocabulary_utilisation(spark, d):
    """Different token ids used of the trained vocabulary, by source (iterative, so without SQL)."""
    docs = table(spark, d, "documents")
    _, m = _bpe(spark, d)
    ids = K.encode_documents(docs.select("doc_id", "text"), m).select("doc_id", F.explode(F.array_distinct("ids")).alias("id"))
    used = ids.join(docs.select("doc_id", C.source_name(F.col("source")).alias("source")), "doc_id").groupBy("source").agg(F.countDistinct("id").alias("used"))
    return used.withColumn("utilisation", F.round(F.col("used") / float(256 + len(m)), 9))


@query()
def rare_word_pieces(spark, d):
    """Mean pieces of twenty long headwords (a sampled report) under the trained merges (iterative, so without SQL)."""
    _, m = _bpe(spark, d)
    pieces = K.encode_chunks(_rare_words(spark, d).select(F.col("word").alias("chunk"), F.lit(1).cast("bigint").alias("freq")), m)
    return pieces.agg(F.count("*").alias("words"), F.round(F.avg(F.size("ids")), 6).alias("mean_pieces"))


_UP = "WHEN s < 20 THEN (s + 1) / 20.0"
_COS = "0.1 + 0.5 * (1 + cos(pi() * {})) * 0.9"


@query(f"""SELECT range AS step, round(CASE {_UP.replace("s", "range", 1).replace("(s", "(range")} WHEN range >= 100 THEN 0.1 ELSE {_COS.format("(range - 20) / 80.0")} END, 9) AS cosine, round(CASE WHEN range < 20 THEN (range + 1) / 20.0 ELSE 1.0 END, 9) AS constant,
  round(CASE WHEN range < 20 THEN (range + 1) / 20.0 WHEN range < 80 THEN 1.0 WHEN range >= 100 THEN 0.1 ELSE 1.0 - (range - 80) / 20.0 * 0.9 END, 9) AS wsd, round(CASE WHEN range < 20 THEN (range + 1) / 20.0 ELSE {_COS.format("least(1.0, (range - 20) / 80.0)")} END, 9) AS finetune FROM range(121)""")
def rate_schedules(spark, d):
    s = F.col("step")
    out = spark.range(121).select(F.col("id").alias("step"))
    shape = {k: L.multiplier(s, k, 20, 100) for k in ("cosine", "constant", "wsd")} | {"finetune": L.finetune_multiplier(s, 20, 100)}
    return out.select("step", *(F.round(c, 9).alias(k) for k, c in shape.items()))


@query("""
WITH a(attention, kv_heads) AS (VALUES ('mha', 8), ('gqa', 2), ('mqa', 1), ('mla', 8)), l(layers) AS (VALUES (4), (8))
SELECT attention, layers, CAST(CASE attention WHEN 'mla' THEN (96 + 32) * 2 ELSE 2 * kv_heads * 32 * 2 END AS BIGINT) AS cache_bytes, CAST(6 * (1000000 * layers + 16000 * 256) + 12 * layers * 256 * 512 AS BIGINT) AS flops, CAST(12 * 1000000 * layers AS BIGINT) AS optimizer_bytes FROM a, l""")
def model_sizes(spark, d):
    """Cache, compute and optimizer memory of some model shapes."""
    rows = [(a, k, n) for a, k in (("mha", 8), ("gqa", 2), ("mqa", 1), ("mla", 8)) for n in (4, 8)]
    m = spark.createDataFrame(rows, "attention string, kv_heads bigint, layers bigint")
    params = 1_000_000 * F.col("layers")
    big = lambda x: F.lit(x).cast("bigint")
    return m.select("attention", F.col("layers").cast("int").alias("layers"), L.cache_bytes(F.col("attention"), F.col("kv_heads"), big(32), big(96), big(32)).alias("cache_bytes"), L.flops_per_token(params, big(16000), big(256), F.col("layers"), big(512)).alias("flops"), L.optimizer_bytes(params).alias("optimizer_bytes"))


@query("SELECT event_id, round(exp(value / 100), 9) AS perplexity, round(value / 100 / ln(2), 9) AS bits FROM events")
def loss_units(spark, d):
    loss = F.col("value") / 100
    return table(spark, d, "events").select("event_id", F.round(L.perplexity(loss), 9).alias("perplexity"), F.round(L.bits(loss), 9).alias("bits"))


@query(r"""
SELECT task, 'run-' || task AS run_id, CAST(max(CAST(regexp_extract(batch_id, '_(\d+)$', 1) AS BIGINT)) + 1 AS BIGINT) AS next_index, task || '_b' || lpad(CAST(max(CAST(regexp_extract(batch_id, '_(\d+)$', 1) AS BIGINT)) + 1 AS VARCHAR), 4, '0') AS next_batch FROM ledger GROUP BY task""")
def next_batch_ids(spark, d):
    i = (F.max(F.regexp_extract("batch_id", r"_(\d+)$", 1).cast("bigint")) + 1).alias("next_index")
    out = table(spark, d, "ledger").groupBy("task").agg(i)
    return out.select("task", F.concat(F.lit("run-"), "task").alias("run_id"), "next_index", F.concat("task", F.lit("_b"), F.lpad(F.col("next_index").cast("string"), 4, "0")).alias("next_batch"))


_SCORES = "WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS position, unnest(embedding)::DOUBLE * 8 AS score FROM embeddings), e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS x FROM s), p AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM e) "


def _scores(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("position", "s")).select("vec_id", "position", (F.col("s").cast("double") * 8).alias("score"))


def _top2(scores):
    t = S.softmax_top(scores, 2)
    return t.select("vec_id", "position", F.round("p", 6).alias("p"), F.round("gate", 6).alias("gate"))


@query(_SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, position) AS rank FROM p) SELECT vec_id, CAST(position AS INTEGER) AS position, round(p, 6) AS p, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS gate FROM r WHERE rank <= 2")
def gate_top2(spark, d):
    """Softmax over the whole vector."""
    return _top2(_scores(spark, d))


@query(_SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, position) AS rank FROM p), k AS (SELECT position, count(*) AS n FROM r WHERE rank <= 2 GROUP BY 1) SELECT CAST(position AS INTEGER) AS expert, round(n / (2.0 * (SELECT count(*) FROM embeddings)), 9) AS load, CAST(sign(2.0 * (SELECT count(*) FROM embeddings) / (SELECT max(len(embedding)) FROM embeddings) - n) AS INTEGER) AS bias_step FROM k")
def gate_load(spark, d):
    """Load of each expert of the whole vector, against an even share of all of them."""
    t = S.softmax_top(_scores(spark, d), 2).groupBy(F.col("position").alias("expert")).agg(F.count("*").alias("n"))
    total = table(spark, d, "embeddings").agg((2.0 * F.count("*")).alias("t"), F.max(F.size("embedding")).alias("experts"))
    t = t.crossJoin(F.broadcast(total))  # one row
    return t.select("expert", F.round(F.col("n") / F.col("t"), 9).alias("load"), F.signum(F.col("t") / F.col("experts") - F.col("n")).cast("int").alias("bias_step"))


@query(_SCORES + ", r AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT vec_id, count(*) AS kept FROM r WHERE before <= 0.9 GROUP BY vec_id")
def nucleus_sizes(spark, d):
    """Nucleus over the whole vector."""
    return S.nucleus(_scores(spark, d), 0.9).groupBy("vec_id").agg(F.count("*").alias("kept"))


@query("SELECT label, CAST(e.pos AS INTEGER) AS expert, round(avg(e.load), 6) AS load FROM (SELECT label, unnest(embedding) AS load, unnest(range(len(embedding))) AS pos FROM embeddings) e GROUP BY 1, 2")
def expert_load(spark, d):
    """Mean of each number of the whole vectors by label."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("expert", "load"))
    return e.groupBy("label", "expert").agg(F.round(F.avg(F.col("load").cast("double")), 6).alias("load"))


@query(_RUNS + "SELECT run_id, round(avg(tok_s), 6) AS mean_rate, round(avg(CASE WHEN event_type <> 'view' THEN value / 8 END), 6) AS mean_memory, round(max(CASE WHEN event_type <> 'view' THEN value / 8 END), 6) AS peak_memory FROM m GROUP BY run_id")
def run_usage(spark, d):
    """Rate and memory of each run; points without a memory figure don't count for it."""
    m = _metrics(spark, d).withColumn("mem_gb", F.when(F.col("event_type") != "view", F.col("value") / 8))
    return R.usage(m).select("run_id", *(F.round(c, 6).alias(c) for c in ("mean_rate", "mean_memory", "peak_memory")))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings), l AS (SELECT label, pos // 8 AS layer, pos % 8 AS expert, avg(x) AS m, sum(x) AS s, count(x) AS n FROM e GROUP BY ALL)
SELECT label, CAST(expert AS INTEGER) AS expert, round(sum(s) / sum(n), 6) AS load, round(max(m) - min(m), 6) AS spread, count(*) AS layers FROM l GROUP BY label, expert""")
def expert_load_layers(spark, d):
    """Each vector as eight experts in each of its layers: mean load over the layers, and how far the layers differ."""
    at = F.sequence(F.lit(0), F.expr("size(embedding) div 8 - 1"))
    e = table(spark, d, "embeddings").select("label", F.transform(at, lambda k: F.transform(F.slice("embedding", k * 8 + 1, F.lit(8)), lambda x: x.cast("double"))).alias("load"))
    return R.expert_loads(e, ["label"]).select("label", "expert", F.round("load", 6).alias("load"), F.round("spread", 6).alias("spread"), "layers")
