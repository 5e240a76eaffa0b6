"""Queries of seeds from books and pairs, probe items with distractors, continuations, preference batches and places of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.session import table
from weftline.operators import corpus as C
from weftline.operators import probes as P
from weftline.operators import scores as S
from weftline.operators import seeds as D
from weftline.operators import tokenizer as K
from weftline.plans import factory as G

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_S = r"\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # blanks besides the common ones
_TRIM = rf"regexp_replace(x, '^[\s\v{_S}]+|[\s\v{_S}]+$', '', 'g')"
_PACKED = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n[\s\v{_S}]*\n', chr(1) || chr(1), 'g'), chr(1) || chr(1)), lambda x: {_TRIM}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, ps, CAST(1 AS BIGINT) AS i, '' AS buf, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS passage FROM d WHERE len(ps) > 0
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(nb) >= 1200 OR i = len(ps) THEN '' ELSE nb END, k + CASE WHEN length(nb) >= 1200 THEN 1 ELSE 0 END, CASE WHEN length(nb) >= 1200 OR i = len(ps) THEN nb END
  FROM (SELECT *, CASE WHEN buf = '' THEN ps[i] ELSE buf || chr(10) || chr(10) || ps[i] END AS nb FROM w WHERE i <= len(ps))),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, passage FROM w WHERE passage IS NOT NULL) """


def _books(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("book"), "text")


@query(_PACKED + "SELECT doc_id, chunk_no, length(passage) AS chars, md5(passage) AS hash FROM c")
def chunk_pack_1200(spark, d):
    """Paragraphs of each document packed in order into passages of at least 1,200 characters."""
    p = D.book_passages(_books(spark, d))
    return p.select(F.col("book").cast("bigint").alias("doc_id"), "chunk_no", F.length("passage").cast("bigint").alias("chars"), F.md5("passage").alias("hash"))


@query(_PACKED + "SELECT 'book-' || substr(sha1(doc_id || ':' || substr(passage, 1, 64)), 1, 8) AS id, CAST(doc_id AS VARCHAR) AS term, md5(passage) AS hash FROM c")
def book_chunk_seeds(spark, d):
    return D.seeds_of("book_chunks", _books(spark, d)).select("id", "term", F.md5("text").alias("hash"))


@query(rf"""WITH r AS (SELECT {G._t("instruction")} AS i, {G._t("response")} AS r, {G._t("meta.word")} AS w FROM generated_rows WHERE task = 'sft_dictionary_qa')
SELECT 'dpo-' || substr(sha1(w || ':' || i), 1, 8) AS id, w AS term, md5('Instruction: ' || i || chr(10) || 'Good answer (do NOT reuse this — write a WORSE one): ' || r) AS hash FROM r WHERE i <> '' AND r <> '' AND w <> ''""")
def pair_seeds(spark, d):
    """Seeds made of finished pairs, whose good answer is to be made worse."""
    r = table(spark, d, "generated_rows").where("task = 'sft_dictionary_qa'").select("instruction", "response", F.col("meta.word").alias("word"))
    return D.seeds_of("sft_pairs", r).select("id", "term", F.md5("text").alias("hash"))


def _h(seed, *ids):
    return f"CAST('0x' || substr(sha1('{seed}' || {' || '.join(chr(39) + ':' + chr(39) + ' || ' + i for i in ids)}), 1, 13) AS BIGINT)"


@query(f"""
WITH e AS (SELECT seed_key AS item_id, text AS definition FROM seeds WHERE seed_kind = 'dictionary' AND text IS NOT NULL),
ring AS (SELECT definition, row_number() OVER (ORDER BY sha1('1337:' || definition), definition) - 1 AS pos FROM (SELECT DISTINCT definition FROM e)), z AS (SELECT count(*) AS size FROM ring),
o AS (SELECT item_id, pos, size, unnest(range(4)) AS k, {_h(1338, "item_id")} % (size - 1) AS start, {_h(1339, "item_id")} % ((size - 2) // 3) + 1 AS step FROM e JOIN ring USING (definition), z),
p AS (SELECT item_id, k, CASE WHEN k = 0 THEN pos ELSE (pos + 1 + (start + (k - 1) * step) % (size - 1)) % size END AS pos FROM o)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY sha1('1340:' || item_id || ':' || k), k) - 1 AS INTEGER) AS choice, md5(definition) AS definition, k = 0 AS gold FROM p JOIN ring USING (pos)""")
def distractor_items(spark, d):
    """Each dictionary entry's definition among three of other entries."""
    e = table(spark, d, "seeds").where("seed_kind = 'dictionary' AND text IS NOT NULL").select(F.col("seed_key").alias("item_id"), F.col("text").alias("definition"))
    return P.with_distractors(e, 1337).withColumn("definition", F.md5("definition"))


@query("""
WITH p AS (SELECT item_id, prompt, unnest(choices) AS choice, unnest(range(len(choices))) AS k FROM domain_probes),
t AS (SELECT item_id, k, list_filter(string_split(prompt, ' '), lambda x: x <> '') AS head, list_filter(string_split(prompt || ' ' || choice, ' '), lambda x: x <> '') AS whole FROM p)
SELECT item_id, CAST(k AS INTEGER) AS choice, CAST(len(head) AS BIGINT) AS prompt_tokens, whole[len(head) + 1:] AS tokens FROM t""")
def probe_continuations(spark, d):
    """The tokens of each choice as they come behind the prompt."""
    p = table(spark, d, "domain_probes").select("item_id", "prompt", F.posexplode("choices").alias("choice", "text"))
    head, rest = P.continuation(lambda c: K.pretokenized(c, "whitespace"), F.col("prompt"), F.concat(F.lit(" "), "text"))
    return p.select("item_id", "choice", F.size(head).cast("bigint").alias("prompt_tokens"), rest.alias("tokens"))


@query(
    G._PAIRS
    + r""", w AS (SELECT row_id, ['<|user|>'] || regexp_extract_all(instruction, '[^\s\p{Z}]+') || ['<|assistant|>'] AS head, regexp_extract_all(chosen, '[^\s\p{Z}]+') || ['<|endoftext|>'] AS a, regexp_extract_all(rejected, '[^\s\p{Z}]+') || ['<|endoftext|>'] AS b FROM s WHERE state = 'kept'),
x AS (SELECT row_id, len(head) AS h, (head || a)[:640] AS c, (head || b)[:640] AS r FROM w), y AS (SELECT * FROM x WHERE len(c) > h AND len(r) > h),
n AS (SELECT *, (row_number() OVER (ORDER BY sha1('1337:' || row_id), row_id) - 1) // 8 AS batch_no FROM y),
m AS (SELECT *, max(len(c)) OVER (PARTITION BY batch_no) - 1 AS wc, max(len(r)) OVER (PARTITION BY batch_no) - 1 AS wr FROM n)
SELECT row_id, batch_no, CAST(wc AS BIGINT) AS width_chosen, CAST(wr AS BIGINT) AS width_rejected, """
    + ", ".join(
        f"md5(array_to_string({t}[:len({t}) - 1] || list_transform(range({w} - len({t}) + 1), lambda z: '<|endoftext|>'), ' ')) AS x_{n}, md5(array_to_string(list_transform(range(1, len({t})), lambda i: CASE WHEN i >= h THEN {t}[i + 1] ELSE '-1' END) || list_transform(range({w} - len({t}) + 1), lambda z: '-1'), ' ')) AS y_{n}"
        for t, w, n in (("c", "wc", "chosen"), ("r", "wr", "rejected"))
    )
    + " FROM m"
)
def preference_batches(spark, d):
    """Seeded batches of eight pairs, each side padded to its own longest, targets of the answer only."""
    b = G.H.preference_batches(G._pairs(spark, d)[0], G.PAIR, 1337, 0, 8)
    join = lambda c: F.md5(F.array_join(F.transform(c, lambda v: F.coalesce(v, F.lit("-1"))), " ")).alias(c)
    return b.select("row_id", "batch_no", "width_chosen", "width_rejected", *map(join, ("x_chosen", "y_chosen", "x_rejected", "y_rejected")))


_STARTS = r"WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^\s\p{Z}]+')) + 1 AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) - n AS start, sum(n) OVER (ORDER BY doc_id) AS e FROM t) "


@query(_STARTS + ", o AS (SELECT event_id, event_id * 7919 % (SELECT max(e) FROM s) AS token_at FROM events) SELECT event_id, CAST(token_at AS BIGINT) AS token_at, doc_id, CAST(token_at - start AS BIGINT) AS place FROM o ASOF JOIN s ON o.token_at >= s.start")
def offset_documents(spark, d):
    """The document, and the place in it, that a place of the whole token stream falls into."""
    n = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (F.size(C.X.words(F.col("text"))) + 1).alias("n"), F.lit(0).alias("all"))
    s = C.running_before(n, F.col("n"), ["doc_id"], ["all"], "start").select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"))
    total = s.agg(F.max("end").alias("total"))
    o = table(spark, d, "events").select("event_id").crossJoin(F.broadcast(total)).select("event_id", (F.col("event_id") * 7919 % F.col("total")).alias("at"))  # one row
    return P.documents_at(o, s).select("event_id", F.col("at").alias("token_at"), "doc_id", (F.col("at") - F.col("start")).alias("place"))


@query("""WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS position, unnest(embedding)::DOUBLE * 8 AS score FROM embeddings),
l AS (SELECT vec_id, position, score - max(score) OVER (PARTITION BY vec_id) AS c FROM s), z AS (SELECT vec_id, position, c - ln(sum(exp(c)) OVER (PARTITION BY vec_id)) AS logprob FROM l)
SELECT vec_id // 16 AS sequence, round(coalesce(sum(logprob) FILTER (WHERE vec_id % 5 <> 0), 0), 6) AS logprob, count(*) FILTER (WHERE vec_id % 5 <> 0) AS tokens FROM z WHERE position = vec_id % 64 GROUP BY 1""")
def sequence_logprobs(spark, d):
    """Log-probability of sequences of sixteen vectors, every fifth of which doesn't count."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("logits"), (F.col("vec_id") % 64).alias("id"))
    t = v.select(F.expr("vec_id div 16").alias("sequence"), S.log_softmax_at(F.col("logits"), F.col("id")).alias("logprob"), F.when(F.col("vec_id") % 5 != 0, F.col("id")).alias("target"))
    return P.sequence_logprobs(t, ["sequence"]).withColumn("logprob", F.round("logprob", 6))


@query("""WITH r AS (SELECT CAST(128 << CAST(event_id % 4 AS INTEGER) AS BIGINT) AS seq_len, value / 100 AS loss, event_id % 7 + 1 AS tokens FROM events), e AS (SELECT seq_len, sum(loss * tokens) / sum(tokens) AS loss FROM r GROUP BY 1)
SELECT seq_len, round(exp(loss), 6) AS perplexity, round(exp(loss - (SELECT arg_min(loss, seq_len) FROM e)), 6) AS ratio FROM e""")
def loss_by_length(spark, d):
    e = table(spark, d, "events").select(F.expr("bigint(128 << int(event_id % 4))").alias("seq_len"), (F.col("value") / 100).alias("loss"), (F.col("event_id") % 7 + 1).alias("tokens"))
    return P.loss_by_length(e).select("seq_len", F.round("perplexity", 6).alias("perplexity"), F.round("ratio", 6).alias("ratio"))
