"""Queries over documents, manifest and dictionary seeds: cleaning, dedup, statistics, budgets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.session import table
from weftline.operators import corpus as C
from weftline.operators import dictionary as D

QUERIES: dict = {}
SQL: dict[str, str] = {}

WORDS = r"len(regexp_extract_all(text, '[^\s\p{Z}]+'))"
TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(rf"""
SELECT CASE WHEN GROUPING(s) = 1 THEN 'TOTAL' ELSE s END AS source, count(*) AS documents,
  CAST(sum(c) AS BIGINT) AS chars, CAST(sum(w) AS BIGINT) AS words, CAST(sum(c) // 4 AS BIGINT) AS est_tokens
FROM (SELECT lower(trim(source)) AS s, coalesce(length(text), 0) AS c, coalesce({WORDS}, 0) AS w FROM documents) GROUP BY ROLLUP(s)""")
def corpus_stats_by_source(spark, d):
    return C.stats_by_source(_docs(spark, d))


_PARAS = rf"""
WITH p AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM
  (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL))),
t AS (SELECT doc_id, pos, {TRIM.format("raw")} AS paragraph FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(paragraph) ORDER BY pos) = 1 AS kept FROM t WHERE paragraph <> '')
"""


@query(_PARAS + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(paragraph) AS hash, kept FROM k")
def paragraph_dedup(spark, d):
    docs = _docs(spark, d).withColumn("text", X.unify_newlines(F.col("text")))
    return C.dedup_paragraphs(docs).select("doc_id", "pos", F.md5("paragraph").alias("hash"), "kept")


@query(
    _PARAS
    + "SELECT doc_id, sha256(string_agg(paragraph, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE kept)) AS text_sha256, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS dropped FROM k GROUP BY doc_id"
)
def paragraph_dedup_rebuilt(spark, d):
    docs = _docs(spark, d).withColumn("text", X.unify_newlines(F.col("text")))
    return C.rebuild(C.dedup_paragraphs(docs)).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "kept", "dropped")


@query(rf"""
SELECT doc_id, sha256({TRIM.format("regexp_replace(regexp_replace(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g')), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')").replace(chr(92) * 2, chr(92))}) AS text_sha256 FROM documents""")
def text_clean(spark, d):
    return C.clean(_docs(spark, d)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(b, '(?is)^.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*', ''),
  '(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*$', ''), '^\n+|\n+$', '', 'g')) AS text_sha256
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Front matter' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK ' || slug || ' ***' || chr(10) || text || chr(10) || '*** END OF THIS PROJECT GUTENBERG EBOOK ***' || chr(10) || 'licence' END AS b FROM documents)""")
def boilerplate_strip(spark, d):
    """Banners are put around two documents of three and cut again; the others show that a text without banner stays."""
    framed = F.concat(
        F.lit("Front matter\n*** START OF THE PROJECT GUTENBERG EBOOK "), "slug", F.lit(" ***\n"), "text", F.lit("\n*** END OF THIS PROJECT GUTENBERG EBOOK ***\nlicence")
    )
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(framed)
    return _docs(spark, d).select("doc_id", F.sha2(X.strip_banners(text), 256).alias("text_sha256"))


@query("""SELECT doc_id, 'doc-' || substr(sha1(slug || ':' || doc_id), 1, 8) AS id, sha256(text) AS text_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(length(text) // 4 AS BIGINT) AS est_tokens FROM documents""")
def document_ids(spark, d):
    key = F.concat("slug", F.lit(":"), F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", X.stable_id("doc", key).alias("id"), F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("bigint").alias("bytes"), F.expr("length(text) div 4").alias("est_tokens"))


@query("""SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def exact_copies(spark, d):
    docs = _docs(spark, d).where(F.col("text").isNotNull())
    return docs.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def top_words(spark, d):
    return _docs(spark, d).select(F.explode(X.letters_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(rf"""
SELECT CAST(least(30, floor(w * 30.0 / 3000) + 1) AS BIGINT) AS bin, count(*) AS documents FROM (SELECT {WORDS} AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def words_histogram(spark, d):
    """30 bins of document length up to 3,000 words; longer ones are in the last."""
    w = _docs(spark, d).where(F.col("text").isNotNull()).select(X.n_words(F.col("text")).alias("w"))
    return w.groupBy(F.least(F.lit(30), F.width_bucket("w", F.lit(0.0), F.lit(3000.0), F.lit(30))).cast("bigint").alias("bin")).agg(F.count("*").alias("documents"))


@query(rf"""
SELECT slug, CAST(sum({WORDS}) AS BIGINT) AS words FROM documents WHERE text IS NOT NULL GROUP BY slug ORDER BY words DESC, slug LIMIT 5""")
def longest_files(spark, d):
    return _files(spark, d).orderBy(F.desc("words"), "slug").limit(5)


@query(rf"""
SELECT slug, CAST(sum({WORDS}) AS BIGINT) AS words FROM documents WHERE text IS NOT NULL GROUP BY slug ORDER BY words, slug LIMIT 5""")
def shortest_files(spark, d):
    return _files(spark, d).orderBy("words", "slug").limit(5)


def _files(spark, d):
    return _docs(spark, d).where(F.col("text").isNotNull()).select("slug", X.n_words(F.col("text")).alias("w")).groupBy("slug").agg(F.sum("w").alias("words"))


@query("""
SELECT lower(trim(source)) AS source, round(sum(length(text)) / (SELECT sum(length(text)) FROM documents), 9) AS share FROM documents GROUP BY 1""")
def source_share(spark, d):
    each = _docs(spark, d).groupBy(C.source_name(F.col("source")).alias("source")).agg(F.sum(F.length("text")).alias("n"))
    return each.select("source", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 9).alias("share"))


@query("""SELECT lower(trim(split)) AS split, type, count(*) AS files FROM manifest GROUP BY 1, 2""")
def manifest_counts(spark, d):
    return table(spark, d, "manifest").groupBy(F.lower(F.trim("split")).alias("split"), "type").agg(F.count("*").alias("files"))


@query(rf"""
SELECT doc_id, sha256({TRIM.format("regexp_replace(text, '\\n\\s*\\n+', chr(10), 'g')").replace(chr(92) * 2, chr(92))}) AS text_sha256 FROM documents WHERE {TRIM.format("text")} <> ''""")
def blank_line_collapse(spark, d):
    docs = _docs(spark, d).where(X.strip(F.col("text")) != "")
    return docs.select("doc_id", F.sha2(X.one_block(F.col("text")), 256).alias("text_sha256"))


@query("""
WITH s AS (SELECT doc_id, coalesce(sum(octet_length(encode(text)) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(b AS BIGINT) AS bytes_before FROM s WHERE b < 500000""")
def byte_budget_prefix(spark, d):
    return C.byte_budget(_docs(spark, d).where(F.col("text").isNotNull()), 500_000).select("doc_id", "bytes_before")


@query(rf"""
SELECT doc_id, lower(trim(source)) AS source, CAST(coalesce(sum({WORDS} + 1) OVER (PARTITION BY lower(trim(source)) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS doc_start
FROM documents WHERE text IS NOT NULL""")
def document_starts(spark, d):
    """Where each document starts in its source's stream of words, one end mark after each."""
    docs = _docs(spark, d).where(F.col("text").isNotNull()).select("doc_id", C.source_name(F.col("source")).alias("source"), X.n_words(F.col("text")).alias("n"))
    return C.running_before(docs, F.col("n") + 1, ["doc_id"], ["source"], "doc_start").select("doc_id", "source", "doc_start")


@query(r"""
WITH seen AS (SELECT type, slug, built_at, row_number() OVER (PARTITION BY type, slug ORDER BY built_at DESC, split DESC NULLS LAST) AS k FROM manifest)
SELECT type, slug, built_at, FALSE AS rebuilt FROM manifest WHERE type NOT IN ('dictionary', 'supplement')
UNION ALL SELECT type, slug, built_at, TRUE FROM seen WHERE type IN ('dictionary', 'supplement') AND k = 1""")
def manifest_upsert(spark, d):
    """The latest rows of two types replace all rows of these types."""
    old = table(spark, d, "manifest").select("type", "slug", "built_at", "split")
    newest = old.where(F.col("type").isin("dictionary", "supplement")).groupBy("type", "slug").agg(F.max("built_at").alias("built_at"))
    new = newest.withColumn("rebuilt", F.lit(True))
    return C.upsert_manifest(old.drop("split").withColumn("rebuilt", F.lit(False)), new)


def _markup(spark, d):
    """Dictionary seeds written as tagged blocks, some lacking a headword, a definition or closing tags."""
    s = table(spark, d, "seeds").where("seed_kind = 'dictionary'")
    w, part, text = F.coalesce(F.col("raw")["word"], F.lit("")), F.coalesce(F.col("raw")["pos"], F.lit("")), F.coalesce("text", F.lit(""))
    ent = F.when(F.col("seed_key") % 7 == 0, "").otherwise(w)
    return s.select(
        F.col("seed_key").alias("page_id"),
        F.concat(F.lit("<p><ent>"), ent, F.lit("</ent> <hw>*"), w, F.lit("`</hw><br/ <pos>"), part, F.lit("</pos>\n<def>"), text, F.lit("</def> <def> </def></p>\n<p><ent>none</ent></p><p>plain</p>")).alias("html"),
    )


_MARKUP = """
WITH m AS (SELECT seed_key AS page_id, '<p><ent>' || CASE WHEN seed_key % 7 = 0 THEN '' ELSE w END || '</ent> <hw>*' || w || '`</hw><br/ <pos>' || part || '</pos>' || chr(10) || '<def>' || x || '</def> <def> </def></p>' || chr(10) || '<p><ent>none</ent></p><p>plain</p>' AS html
  FROM (SELECT seed_key, coalesce(raw['word'], '') AS w, coalesce(raw['pos'], '') AS part, coalesce(text, '') AS x FROM seeds WHERE seed_kind = 'dictionary'))"""
_STRIP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '<[a-zA-Z]+/', ' ', 'g'), '[ \t]+', ' ', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(_MARKUP + f" SELECT page_id, {_STRIP.format('html')} AS text FROM m")
def markup_strip(spark, d):
    return _markup(spark, d).select("page_id", X.strip_tags(F.col("html")).alias("text"))


_ENTRIES = (
    _MARKUP
    + rf""", b AS (SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS block FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS x FROM m)),
f AS (SELECT page_id, pos, {_STRIP.format("regexp_extract(block, '(?s)<ent>(.*?)</ent>', 1)")} AS e, {_STRIP.format("regexp_extract(block, '(?s)<hw>(.*?)</hw>', 1)")} AS h, {_STRIP.format("regexp_extract(block, '(?s)<pos>(.*?)</pos>', 1)")} AS part,
  list_filter(list_transform(regexp_extract_all(block, '(?s)<def>(.*?)</def>', 1), lambda z: {_STRIP.format("z")}), lambda z: z <> '') AS defs FROM b WHERE regexp_matches(block, '(?s)<ent>.*?</ent>')),
g AS (SELECT page_id, pos, regexp_replace(regexp_replace(CASE WHEN e <> '' THEN e ELSE h END, '[`*]', '', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS word, part, defs FROM f)"""
)


@query(_ENTRIES + "SELECT page_id, CAST(pos AS INTEGER) AS pos, word, part AS part_of_speech, array_to_string(defs, ' | ') AS definitions FROM g WHERE word <> '' AND len(defs) > 0")
def markup_entries(spark, d):
    return D.parse_entries(_markup(spark, d)).withColumn("definitions", F.array_join("definitions", " | "))


@query(_ENTRIES + "SELECT page_id, '**' || word || '**' || CASE WHEN part <> '' THEN ' (' || part || ')' ELSE '' END || ': ' || array_to_string(defs, '; ') AS prose FROM g WHERE word <> '' AND len(defs) > 0")
def entry_prose(spark, d):
    e = D.parse_entries(_markup(spark, d))
    return e.select("page_id", D.prose(F.col("word"), F.col("part_of_speech"), F.col("definitions")).alias("prose"))


_ENTRY_ROWS = "SELECT seed_key AS entry_id, raw['word'] AS word FROM seeds WHERE seed_kind = 'dictionary' AND raw['word'] IS NOT NULL"


def _entry_rows(spark, d):
    s = table(spark, d, "seeds").where("seed_kind = 'dictionary'")
    return s.select(F.col("seed_key").alias("entry_id"), F.col("raw")["word"].alias("word")).where("word IS NOT NULL")


@query(rf"""
WITH e AS ({_ENTRY_ROWS}), r AS (SELECT *, row_number() OVER (ORDER BY sha1('1337:' || entry_id), entry_id) AS k FROM e), n AS (SELECT CAST(floor(count(*) * 0.02) AS BIGINT) AS n FROM e)
SELECT entry_id, word, 'train' AS side FROM e WHERE word IN (SELECT word FROM r, n WHERE k > n.n)
UNION ALL SELECT entry_id, word, 'val' FROM e WHERE word IN (SELECT word FROM r, n WHERE k <= n.n)""")
def holdout_by_word(spark, d):
    return C.holdout_by_word(_entry_rows(spark, d), 0.02, 1337).select("entry_id", "word", "side")


@query(rf"""
SELECT entry_id, word, CASE WHEN CAST('0x' || substr(sha1('1337:' || word), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.02 THEN 'val' ELSE 'train' END AS side FROM ({_ENTRY_ROWS})""")
def holdout_by_key(spark, d):
    return C.holdout_by_key(_entry_rows(spark, d), 0.02, 1337)


@query("SELECT doc_id FROM documents ORDER BY sha1('7:' || doc_id), doc_id LIMIT 100")
def sampled_documents(spark, d):
    return _docs(spark, d).select("doc_id").orderBy(X.order_key(7, F.col("doc_id")), "doc_id").limit(100)


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('1337:' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, CASE WHEN k <= (SELECT round_even(count(*) * 95 / 100.0, 0) FROM documents) THEN 'train' ELSE 'val' END AS side FROM r""")
def train_val_cut(spark, d):
    return C.seeded_cut(_docs(spark, d).select("doc_id"), ["doc_id"], 95, 1337)


@query("""
WITH r AS (SELECT e.range AS epoch, row_id, row_number() OVER (PARTITION BY e.range ORDER BY sha1('1337:' || e.range || ':' || row_id), row_id) - 1 AS k FROM generated_rows, range(2) e)
SELECT CAST(epoch AS BIGINT) AS epoch, row_id, k // 8 AS batch_no FROM r""")
def epoch_batches(spark, d):
    """Every row once an epoch, in an order of the epoch's own, in batches of eight."""
    rows = table(spark, d, "generated_rows").select("row_id").crossJoin(F.broadcast(spark.range(2).withColumnRenamed("id", "epoch")))  # two rows
    rows = rows.withColumn("key", X.order_key(1337, F.col("epoch"), F.col("row_id")))
    return C.batches(rows, ["key", "row_id"], ["epoch"], 8).select("epoch", "row_id", "batch_no")


@query(r"""
SELECT seed_key, word, length(word) >= 3 AND regexp_matches(substr(word, 1, 1), '^\p{L}') AND length(regexp_replace(word, '\P{L}', '', 'g')) >= greatest(3, length(word) - 1) AS real FROM (SELECT seed_key, raw['word'] AS word FROM seeds WHERE raw['word'] IS NOT NULL)""")
def real_words(spark, d):
    s = table(spark, d, "seeds").select("seed_key", F.col("raw")["word"].alias("word")).where("word IS NOT NULL")
    return s.withColumn("real", X.is_real_word(F.col("word")))


@query(r"""
SELECT 'dict-' || substr(sha1(word || ':' || def), 1, 8) AS id, word || CASE WHEN pos <> '' THEN ' (' || pos || ')' ELSE '' END AS term, def AS text, word
FROM (SELECT raw['word'] AS word, coalesce(raw['pos'], '') AS pos, raw['definition'] AS def FROM seeds WHERE seed_kind = 'dictionary')
WHERE word <> '' AND length(def) >= 5 AND length(word) >= 3 AND regexp_matches(substr(word, 1, 1), '^\p{L}') AND length(regexp_replace(word, '\P{L}', '', 'g')) >= greatest(3, length(word) - 1)""")
def dictionary_seeds(spark, d):
    s = table(spark, d, "seeds").where("seed_kind = 'dictionary'")
    return D.dictionary_seeds(s.select(F.col("raw")["word"].alias("word"), F.col("raw")["pos"].alias("part_of_speech"), F.col("raw")["definition"].alias("definition")))


@query(r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\n', ' ', 'g'), '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1))) AS x FROM documents),
t AS (SELECT doc_id, regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS sentence FROM s)
SELECT doc_id, md5(sentence) AS hash, regexp_extract_all(sentence, '[^\s\p{Z}]+')[-1] AS last_word, CAST(len(regexp_extract_all(sentence, '[^\s\p{Z}]+')) - 1 AS BIGINT) AS prompt_words FROM t WHERE len(regexp_extract_all(sentence, '[^\s\p{Z}]+')) >= 8""")
def cloze_items(spark, d):
    """Sentences of eight words or more, with the last word as the answer."""
    s = _docs(spark, d).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("sentence"))
    w = X.words(F.col("sentence"))
    return s.select("doc_id", F.md5("sentence").alias("hash"), F.element_at(w, -1).alias("last_word"), (F.size(w) - 1).cast("bigint").alias("prompt_words"))
