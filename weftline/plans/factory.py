"""Queries over generated rows, seeds, tasks and the ledger: validation, dedup, batches, chats and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.session import table
from weftline.operators import chat as H
from weftline.operators import corpus as C
from weftline.operators import factory as G

# Longest conversation of a seed (eight pairs of the reference's 128) and longest side of a preference pair (the reference's).
CONVERSATION, PAIR = 1024, 640

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark, d):
    return table(spark, d, "generated_rows")


def _t(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


_MARKS = " OR ".join("contains(lower(response), '" + m.replace("'", "''") + "')" for m in G.REFUSAL_MARKERS)
_COUNTS = {k: f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in v)})))" for k, v in G.FUNCTION_WORDS.items()}
_CHECKED = rf"""
WITH r AS (SELECT g.*, t.dedup_key, t.quality AS q, {_t("g.instruction")} AS ask, {_t("g.response")} AS reply,
  list_transform(regexp_extract_all(lower(g.response), '[^\s\p{{Z}}]+'), lambda w: regexp_replace(w, '[^\p{{L}}]', '', 'g')) AS ws
  FROM generated_rows g JOIN task_spec t ON g.task = t.name),
l AS (SELECT *, {", ".join(f"{c} AS n_{k}" for k, c in _COUNTS.items())} FROM r),
m AS (SELECT *, greatest({", ".join(f"n_{k}" for k in _COUNTS)}) AS best FROM l),
v AS (SELECT *, CASE WHEN best <= 0 THEN NULL {" ".join(f"WHEN n_{k} = best THEN '{k}'" for k in _COUNTS)} END AS lang,
  array_to_string(list_transform(string_split(dedup_key, '+'), lambda p: lower({_t("coalesce(CASE trim(p) WHEN 'meta.word' THEN meta.word WHEN 'meta.style' THEN meta.style WHEN 'style' THEN meta.style WHEN 'instruction' THEN instruction END, 'none')")})), '||') AS signature FROM m),
c AS (SELECT *, CASE WHEN instruction IS NULL OR response IS NULL THEN 'missing_field' WHEN meta IS NULL THEN 'meta_not_object'
  WHEN coalesce(meta.word, '') = '' OR coalesce(meta.style, '') = '' THEN 'missing_meta'
  WHEN NOT length(ask) BETWEEN q.min_instruction_chars AND q.max_instruction_chars THEN 'instruction_length'
  WHEN NOT length(reply) BETWEEN q.min_response_chars AND q.max_response_chars THEN 'response_length'
  WHEN q.forbid_refusals AND ({_MARKS}) THEN 'refusal'
  WHEN q.require_seed_term_in_response AND lower({_t("meta.word")}) <> '' AND NOT contains(lower(response), lower({_t("meta.word")})) THEN 'grounding'
  WHEN q.require_lang IS NOT NULL AND lang IS NOT NULL AND lang <> q.require_lang THEN 'language' END AS reason_code FROM v)
"""


@query(
    _CHECKED
    + """SELECT row_id, reason_code, CASE reason_code WHEN 'missing_field' THEN 'missing field ''' || CASE WHEN instruction IS NULL THEN 'instruction' ELSE 'response' END || ''''
  WHEN 'meta_not_object' THEN 'meta is not an object' WHEN 'missing_meta' THEN 'missing meta.' || CASE WHEN coalesce(meta.word, '') = '' THEN 'word' ELSE 'style' END
  WHEN 'instruction_length' THEN 'instruction length ' || length(ask) || ' out of bounds' WHEN 'response_length' THEN 'response length ' || length(reply) || ' out of bounds'
  WHEN 'refusal' THEN 'response looks like a refusal' WHEN 'grounding' THEN 'grounding term ''' || meta.word || ''' absent from response' WHEN 'language' THEN 'response not detected as ''' || q.require_lang || '''' END AS reason FROM c"""
)
def validate_rows(spark, d):
    return _checked(spark, d).select("row_id", "reason_code", "reason")


def _checked(spark, d):
    return G.validated(_rows(spark, d), table(spark, d, "task_spec"))


_DEDUPED = (
    _CHECKED
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY task, signature, reason_code IS NULL ORDER BY ingested_at, row_id) AS k FROM c),
x AS (SELECT *, CASE WHEN reason_code IS NULL AND k > 1 THEN 'duplicate' ELSE reason_code END AS code FROM f)
"""
)


@query(_DEDUPED + "SELECT row_id, signature, code AS reason_code FROM x")
def signature_dedup(spark, d):
    return G.dedup_valid(_checked(spark, d)).select("row_id", "signature", "reason_code")


@query(
    _CHECKED
    + """, h AS (SELECT DISTINCT task, signature FROM c WHERE reason_code IS NULL AND ingested_at < TIMESTAMPTZ '2025-05-01 00:00:00+00'),
n AS (SELECT *, row_number() OVER (PARTITION BY task, signature, reason_code IS NULL ORDER BY ingested_at, row_id) AS k FROM c WHERE ingested_at >= TIMESTAMPTZ '2025-05-01 00:00:00+00')
SELECT row_id, CASE WHEN reason_code IS NULL AND (k > 1 OR (task, signature) IN (SELECT (task, signature) FROM h)) THEN 'duplicate' ELSE reason_code END AS reason_code FROM n"""
)
def history_dedup(spark, d):
    """Rows from May on against the valid rows before."""
    checked = _checked(spark, d)
    old = checked.where("ingested_at < TIMESTAMP '2025-05-01 00:00:00+00:00' AND reason_code IS NULL")
    return G.dedup_valid(checked.where("ingested_at >= TIMESTAMP '2025-05-01 00:00:00+00:00'"), old).select("row_id", "reason_code")


@query(_DEDUPED + "SELECT task, coalesce(code, 'valid') AS outcome, count(*) AS n FROM x GROUP BY 1, 2")
def failure_taxonomy(spark, d):
    out = G.dedup_valid(_checked(spark, d))
    return out.groupBy("task", F.coalesce("reason_code", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    _DEDUPED
    + """SELECT t.name AS task, count(*) FILTER (WHERE x.row_id IS NOT NULL AND code IS NULL) AS valid, count(*) FILTER (WHERE code IS NOT NULL) AS invalid,
  CASE WHEN any_value(t.target_count) <> 0 THEN round(100.0 * count(*) FILTER (WHERE x.row_id IS NOT NULL AND code IS NULL) / any_value(t.target_count), 6) END AS percent FROM task_spec t LEFT JOIN x ON x.task = t.name GROUP BY 1"""
)
def task_progress(spark, d):
    out = G.dedup_valid(_checked(spark, d)).withColumn("ok", F.col("reason_code").isNull()).groupBy("task").agg(F.sum(F.col("ok").cast("bigint")).alias("valid"), F.sum((~F.col("ok")).cast("bigint")).alias("invalid"))
    spec = table(spark, d, "task_spec").select(F.col("name").alias("task"), "target_count")
    valid = F.coalesce("valid", F.lit(0))
    return spec.join(out, "task", "left").select("task", valid.alias("valid"), F.coalesce("invalid", F.lit(0)).alias("invalid"), F.when(F.col("target_count") != 0, F.round(100.0 * valid / F.col("target_count"), 6)).alias("percent"))


@query(
    _DEDUPED
    + """, e AS (SELECT task, row_id, row_number() OVER (PARTITION BY task ORDER BY sha1('1337:' || row_id), row_id) AS k, count(*) OVER (PARTITION BY task) AS n FROM x WHERE code IS NULL)
SELECT task, row_id, CASE WHEN k <= round_even(n * 95 / 100.0, 0) THEN 'train' ELSE 'val' END AS side FROM e"""
)
def export_split(spark, d):
    """Valid rows of each task, 95 of 100 to train, by a seeded order."""
    valid = G.dedup_valid(_checked(spark, d)).where("reason_code IS NULL").select("task", "row_id").withColumn("key", X.order_key(1337, F.col("row_id")))
    sizes = valid.groupBy("task").agg(F.count("*").alias("n"))  # one row a task
    ranked = C.running_before(valid, F.lit(1), ["key", "row_id"], ["task"], "rank").join(sizes, "task")
    return ranked.select("task", "row_id", F.when(F.col("rank") < F.bround(F.col("n") * 95 / 100), "train").otherwise("val").alias("side"))


@query("""
SELECT batch_id, """ + ", ".join(f"coalesce(arg_max({c}, ledger_seq) FILTER (WHERE coalesce({c}, '') <> ''), '') AS {c}" for c in G.LEDGER) + " FROM ledger GROUP BY batch_id")
def ledger_upsert(spark, d):
    return G.ledger_state(table(spark, d, "ledger"))


_STATE = "(SELECT batch_id, " + ", ".join(f"coalesce(arg_max({c}, ledger_seq) FILTER (WHERE coalesce({c}, '') <> ''), '') AS {c}" for c in G.LEDGER) + " FROM ledger GROUP BY batch_id)"


@query(f"""
SELECT task, count(*) AS batches, count(*) FILTER (WHERE valid = '0' AND invalid = 'all') AS unparsed, CAST(coalesce(sum(TRY_CAST(valid AS BIGINT)), 0) AS BIGINT) AS valid, CAST(coalesce(sum(TRY_CAST(invalid AS BIGINT)), 0) AS BIGINT) AS invalid FROM {_STATE} GROUP BY task""")
def ledger_status(spark, d):
    s = G.ledger_state(table(spark, d, "ledger"))
    n = lambda c: F.coalesce(F.sum(F.expr(f"try_cast({c} AS bigint)")), F.lit(0)).alias(c)
    return s.groupBy("task").agg(F.count("*").alias("batches"), F.sum(F.expr("int(valid = '0' AND invalid = 'all')")).alias("unparsed"), n("valid"), n("invalid"))


@query(f"""SELECT batch_id FROM {_STATE} WHERE batch_id NOT IN (SELECT batch_id FROM generated_rows)""")
def pending_batches(spark, d):
    """Batches in the ledger without any row received."""
    return G.ledger_state(table(spark, d, "ledger")).select("batch_id").join(_rows(spark, d).select("batch_id").distinct(), "batch_id", "left_anti")


@query(f"""SELECT g.row_id, coalesce(nullif(g.meta.style, ''), s.style, '') AS style FROM generated_rows g LEFT JOIN {_STATE} s USING (batch_id)""")
def batch_style(spark, d):
    """A row's own style, or else its batch's."""
    s = G.ledger_state(table(spark, d, "ledger")).select("batch_id", F.col("style").alias("batch"))
    return _rows(spark, d).join(s, "batch_id", "left").select("row_id", F.coalesce(F.when(F.col("meta.style") != "", F.col("meta.style")), F.col("batch"), F.lit("")).alias("style"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events""")
def json_paths(spark, d):
    """Paths of a JSON column: found at the top level, else under ``meta``, else null."""
    v = F.try_parse_json("props")
    at = lambda p, t: F.coalesce(F.try_variant_get(v, f"$.{p}", t), F.try_variant_get(v, f"$.meta.{p}", t))
    return table(spark, d, "events").select("event_id", at("k", "bigint").alias("k"), at("style", "string").alias("missing"))


@query("""
SELECT CAST(row_id AS VARCHAR) AS batch_id, CASE WHEN row_id % 5 = 0 THEN NULL ELSE row_id END AS row_id, CASE WHEN row_id % 5 = 0 THEN NULL ELSE translate(instruction, '“”‘’▁″′', '""''''' || ' "''') END AS instruction, row_id % 5 <> 0 AS ok
FROM generated_rows""")
def reply_parse(spark, d):
    """Each row wrapped as a model's reply with prose, fence, an item that is no object and trailing commas; every fifth can't be read."""
    return _replies(_rows(spark, d))


def _replies(r):
    body = F.to_json(F.struct("row_id", "instruction"))
    reply = F.when(F.col("row_id") % 5 == 0, F.lit("I'm sorry, there is nothing to give.")).otherwise(F.concat(F.lit("Here it is:\n```json\n[\n▁"), body, F.lit(", 2,\n]\n```\nBye.")))
    parsed = G.parse_replies(r.select(F.col("row_id").cast("string").alias("batch_id"), reply.alias("reply")))
    get = lambda p, t: F.try_variant_get("value", f"$.{p}", t)
    return parsed.select("batch_id", get("row_id", "bigint").alias("row_id"), get("instruction", "string").alias("instruction"), "ok")


@query("""
WITH s AS (SELECT DISTINCT id FROM seeds WHERE seed_kind = 'dictionary' AND id NOT IN (SELECT seed_id FROM generated_rows WHERE seed_id IS NOT NULL)),
r AS (SELECT id, row_number() OVER (ORDER BY sha1('1337:' || id), id) - 1 AS k FROM s)
SELECT id, k // 12 AS batch_no, ['formal', 'casual', 'kid-friendly'][(k // 12) % 3 + 1] AS style FROM r""")
def seed_batches(spark, d):
    """Seeds that have no row yet, shuffled by seed, in batches of twelve whose styles rotate."""
    seeds = table(spark, d, "seeds").where("seed_kind = 'dictionary'").select("id").distinct()
    done = _rows(spark, d).where("seed_id IS NOT NULL").select(F.col("seed_id").alias("id"))
    left = G.select_seeds(seeds, done, None).withColumn("key", X.order_key(1337, F.col("id"))).withColumn("all", F.lit(0))
    b = C.batches(left, ["key", "id"], ["all"], 12)
    style = F.element_at(F.array(*map(F.lit, ("formal", "casual", "kid-friendly"))), (F.pmod("batch_no", F.lit(3)) + 1).cast("int"))
    return b.select("id", "batch_no", style.alias("style"))


@query("""
WITH r AS (SELECT id, coalesce(term, '') AS term, coalesce(text, '') AS text, row_number() OVER (ORDER BY seed_key) - 1 AS k FROM seeds WHERE seed_kind = 'dictionary')
SELECT k // 12 AS batch_no, count(*) AS n_seeds, ['formal', 'casual'][(k // 12) % 2 + 1] AS style,
  'Write one object for each source item.' || chr(10) || 'Style: ' || ['formal', 'casual'][(k // 12) % 2 + 1] || chr(10) || 'Items (' || count(*) || '):' || chr(10) || string_agg('[' || id || '] ' || term || ': ' || text, chr(10) ORDER BY k) AS prompt FROM r GROUP BY 1, 3""")
def prompts(spark, d):
    seeds = table(spark, d, "seeds").where("seed_kind = 'dictionary'").select("seed_key", "id", F.coalesce("term", F.lit("")).alias("term"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("all"))
    return G.render_prompts(C.batches(seeds, ["seed_key"], ["all"], 12), F.array(F.lit("formal"), F.lit("casual")))


_TURNS = """
WITH n AS (SELECT seed_id, instruction, response, row_number() OVER (PARTITION BY seed_id ORDER BY ingested_at, row_id) - 1 AS k FROM generated_rows WHERE seed_id IS NOT NULL),
t AS (SELECT seed_id AS conv_id, k * 2 AS turn, 'user' AS role, instruction AS text FROM n UNION ALL SELECT seed_id, k * 2 + 1, 'assistant', response FROM n)
"""


@query(_TURNS + "SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN '<|user|>' || text ELSE '<|assistant|>' || text || '<|endoftext|>' END, '' ORDER BY turn)) AS chat, CAST(0 AS BIGINT) AS dropped_turns FROM t GROUP BY conv_id")
def chat_render(spark, d):
    return H.render(H.pairs_from_rows(_rows(spark, d))).withColumn("chat", F.md5("chat"))


_MASKED = (
    _TURNS
    + r""", w AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN ['<|user|>'] || regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}]+') ELSE ['<|assistant|>'] || regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}]+') || ['<|endoftext|>'] END AS ids,
  CASE role WHEN 'user' THEN list_transform(range(len(regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}]+')) + 1), lambda z: 0) ELSE [0] || list_transform(range(len(regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}]+')) + 1), lambda z: 1) END AS sup FROM t),
e AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS tokens, flatten(list(sup ORDER BY turn)) AS mask FROM w GROUP BY conv_id)
"""
)


@query(_MASKED + "SELECT conv_id, md5(array_to_string(tokens, ' ')) AS tokens, array_to_string(mask, '') AS mask FROM e")
def chat_mask(spark, d):
    m = H.masked(H.pairs_from_rows(_rows(spark, d)))
    return m.select("conv_id", F.md5(F.array_join("tokens", " ")).alias("tokens"), F.array_join("mask", "").alias("mask"))


def _examples(spark, d, longest):
    e = H.truncated(H.masked(H.pairs_from_rows(_rows(spark, d))), longest)
    return e.select("conv_id", F.size("tokens").cast("bigint").alias("length"), F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("supervised"))


@query(_MASKED + "SELECT conv_id, CAST(len(tokens[:1024]) AS BIGINT) AS length, CAST(list_sum(mask[:1024]) AS BIGINT) AS supervised FROM e WHERE list_sum(mask[:1024]) > 0")
def sft_examples(spark, d):
    """Examples of whole conversations: the limit of 1024 tokens (128 a pair, for eight pairs) only guards against outliers."""
    return _examples(spark, d, CONVERSATION)


def _batches(spark, d, longest):
    e = H.truncated(H.masked(H.pairs_from_rows(_rows(spark, d))), longest)
    b = H.collated_shuffle(e, "conv_id", 1337, 0, 8)
    join = lambda c: F.md5(F.array_join(F.transform(c, lambda v: F.coalesce(v, F.lit("-1"))), " ")).alias(c)
    return b.select("conv_id", "batch_no", "width", join("x"), join("y"))


@query(
    _MASKED
    + """, c AS (SELECT conv_id, tokens[:1024] AS t, mask[:1024] AS m, (row_number() OVER (ORDER BY sha1('1337:' || conv_id), conv_id) - 1) // 8 AS batch_no FROM e WHERE list_sum(mask[:1024]) > 0),
b AS (SELECT *, max(len(t)) OVER (PARTITION BY batch_no) - 1 AS width FROM c)
SELECT conv_id, batch_no, CAST(width AS BIGINT) AS width, md5(array_to_string(t[:len(t) - 1] || list_transform(range(width - len(t) + 1), lambda z: '<|endoftext|>'), ' ')) AS x,
  md5(array_to_string(list_transform(range(1, len(t)), lambda i: CASE WHEN m[i + 1] = 1 THEN t[i + 1] ELSE '-1' END) || list_transform(range(width - len(t) + 1), lambda z: '-1'), ' ')) AS y FROM b"""
)
def sft_batches(spark, d):
    """Seeded batches of eight whole conversations."""
    return _batches(spark, d, CONVERSATION)


@query(_TURNS + "SELECT a.conv_id, a.turn, md5(string_agg(b.role || coalesce(b.text, ''), '|' ORDER BY b.turn)) AS so_far FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY 1, 2")
def chat_history(spark, d):
    h = H.history(H.pairs_from_rows(_rows(spark, d)))
    return h.select("conv_id", "turn", F.md5(F.array_join(F.transform("so_far", lambda s: F.concat(s["role"], F.coalesce(s["text"], F.lit("")))), "|")).alias("so_far"))


@query(r"""
SELECT row_id, md5('<|user|>' || instruction || '<|assistant|>') AS prompt, CAST(len(regexp_extract_all(instruction, '[^\s\p{Z}]+')) + 2 AS BIGINT) AS tokens FROM generated_rows""")
def chat_prompts(spark, d):
    """Inference prompts: a user's turn and the assistant's mark."""
    m = _rows(spark, d).select(F.col("row_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("instruction").alias("text"))
    out = H.render(m, generation_prompt=True).join(H.masked(m, generation_prompt=True), "conv_id")
    return out.select(F.col("conv_id").alias("row_id"), F.md5("chat").alias("prompt"), F.size("tokens").cast("bigint").alias("tokens"))


_PAIRS = rf"""
WITH c AS (SELECT seed_id, arg_max(instruction, row_id) AS instruction, arg_max(response, row_id) AS chosen, arg_max(coalesce(meta.word, ''), row_id) AS word FROM generated_rows WHERE task = 'sft_dictionary_qa' AND seed_id IS NOT NULL AND response IS NOT NULL GROUP BY seed_id),
p AS (SELECT r.row_id, c.instruction, c.chosen, {_t("r.response")} AS rejected, c.word, coalesce(r.meta.style, '?') AS failure_mode FROM generated_rows r LEFT JOIN c USING (seed_id) WHERE r.task = 'dpo_dictionary_pairs'),
s AS (SELECT *, CASE WHEN chosen IS NULL THEN 'unmatched' WHEN rejected IS NULL THEN 'no_response' WHEN lower(rejected) = lower({_t("chosen")}) THEN 'identical' ELSE 'kept' END AS state FROM p)
"""


def _pairs(spark, d):
    r = _rows(spark, d)
    chosen = r.where("task = 'sft_dictionary_qa' AND seed_id IS NOT NULL AND response IS NOT NULL").select("seed_id", F.col("row_id").alias("line_no"), "instruction", "response", F.coalesce("meta.word", F.lit("")).alias("word"))
    return H.preference_pairs(chosen, r.where("task = 'dpo_dictionary_pairs'").select("row_id", "seed_id", "response", F.col("meta.style").alias("style")))


@query(_PAIRS + "SELECT row_id, md5(instruction || '|' || chosen || '|' || rejected) AS triple, word, failure_mode FROM s WHERE state = 'kept'")
def preference_pairs(spark, d):
    return _pairs(spark, d)[0].select("row_id", F.md5(F.concat_ws("|", "instruction", "chosen", "rejected")).alias("triple"), "word", "failure_mode")


@query(_PAIRS + "SELECT state, count(*) AS n FROM s GROUP BY state")
def preference_counts(spark, d):
    return _pairs(spark, d)[1]


@query(_PAIRS + ", n AS (SELECT length(rejected) AS x, row_number() OVER (ORDER BY length(rejected)) - 1 AS k, count(*) OVER () AS n FROM s WHERE state = 'kept') SELECT max(CASE WHEN k = n // 2 THEN x END) AS p50, max(CASE WHEN k = floor(n * 0.99) THEN x END) AS p99, max(x) AS largest FROM n")
def rejected_lengths(spark, d):
    kept = _pairs(spark, d)[0].select(F.length("rejected").cast("bigint").alias("x"))
    return H.element_percentile(kept, "x", [0.5, 0.99])


def _preferences(spark, d, longest):
    kept = _pairs(spark, d)[0]

    def side(c, name):
        turns = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("instruction").alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col(c).alias("text")))
        m = kept.select(F.col("row_id").alias("conv_id"), F.explode(turns).alias("m")).select("conv_id", "m.*")
        e = H.truncated(H.masked(m), longest)
        return e.select(F.col("conv_id").alias("row_id"), F.size("tokens").cast("bigint").alias(name), (F.array_position("mask", 1) - 1).alias("shared_prefix"))

    a, b = side("chosen", "chosen_length"), side("rejected", "rejected_length").drop("shared_prefix")
    return a.join(b, "row_id").select("row_id", "shared_prefix", "chosen_length", "rejected_length")


@query(
    _PAIRS
    + r""", w AS (SELECT row_id, ['<|user|>'] || regexp_extract_all(instruction, '[^\s\p{Z}]+') || ['<|assistant|>'] AS head, regexp_extract_all(chosen, '[^\s\p{Z}]+') || ['<|endoftext|>'] AS a, regexp_extract_all(rejected, '[^\s\p{Z}]+') || ['<|endoftext|>'] AS b FROM s WHERE state = 'kept'),
x AS (SELECT row_id, len(head) AS h, least(640, len(head || a)) AS la, least(640, len(head || b)) AS lb FROM w)
SELECT row_id, CAST(h AS BIGINT) AS shared_prefix, CAST(la AS BIGINT) AS chosen_length, CAST(lb AS BIGINT) AS rejected_length FROM x WHERE la > h AND lb > h"""
)
def preference_examples(spark, d):
    """Both sides whole: 640 tokens is the reference's limit for pairs, above its longest rejected reply."""
    return _preferences(spark, d, PAIR)


@query("""SELECT row_id, turn, CASE WHEN role IS NULL THEN 'missing role' WHEN role NOT IN ('user', 'assistant') THEN 'unknown role ''' || role || '''' WHEN text IS NULL THEN 'missing text' END AS problem
FROM (SELECT row_id, 0 AS turn, meta.style AS role, instruction AS text FROM generated_rows UNION ALL SELECT row_id, 1, 'assistant', response FROM generated_rows)""")
def role_validation(spark, d):
    """Why a turn can't be rendered; the first turn of each row has its style for a role."""
    r = _rows(spark, d)
    turns = F.array(F.struct(F.lit(0).alias("turn"), F.col("meta.style").alias("role"), F.col("instruction").alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("response").alias("text")))
    return H.role_problems(r.select("row_id", F.explode(turns).alias("m")).select("row_id", "m.*")).select("row_id", "turn", "problem")
