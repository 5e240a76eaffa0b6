"""Generated rows: prompts in batches, tolerant parsing of replies, validation with reasons, dedup, ledger and export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.session import materialise
from weftline.functions.text import order_key, strip, words

# Phrases of a refusal, in lower case.
REFUSAL_MARKERS = ("i'm sorry", "i am sorry", "i cannot", "i can't", "i can not", "as an ai", "i'm unable", "i am unable", "i apologize", "cannot assist")
# Quotes that stand for straight ones.
STRAIGHT_QUOTES = {"“": '"', "”": '"', "″": '"', "‘": "'", "’": "'", "′": "'"}
# Frequent function words, for the language gate.
FUNCTION_WORDS = {
    "en": ("the", "a", "of", "and", "to", "in", "is", "that", "which", "who", "with", "for"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "den", "mit", "war", "aber"),
    "fr": ("le", "la", "les", "et", "est", "une", "un", "des", "dans", "pour", "mais", "car"),
    "es": ("el", "la", "los", "las", "y", "es", "una", "un", "pero", "para", "pues", "era"),
}


@dataclass(frozen=True)
class Quality:
    min_response_chars: int = 10
    max_response_chars: int = 2000
    min_instruction_chars: int = 5
    max_instruction_chars: int = 500
    require_lang: str | None = None
    forbid_refusals: bool = True
    require_seed_term_in_response: bool = False


@dataclass(frozen=True)
class Task:
    """A generation task; ``dedup_key`` is a list of paths joined by plus signs."""

    name: str
    style_axes: tuple[str, ...] = ("neutral",)
    fields: tuple[str, ...] = ("instruction", "response")
    meta_fields: tuple[str, ...] = ("word", "style")
    dedup_key: str = "meta.word + meta.style"
    seed_term_field: str = "word"
    seeds_per_prompt: int = 12
    target_count: int = 0
    instructions: str = ""
    quality: Quality = field(default_factory=Quality)

    @property
    def dedup_paths(self) -> list[str]:
        return [p.strip() for p in self.dedup_key.split("+") if p.strip()]

    @classmethod
    def from_dict(cls, d: dict) -> Task:
        """From a parsed YAML or a table row; unknown keys are left out, missing ones take their defaults."""
        q = dict(d.get("quality") or {})
        known = {k: v for k, v in d.items() if k in cls.__dataclass_fields__ and k != "quality" and v is not None}
        if isinstance(schema := d.get("schema"), dict):
            known["fields"] = tuple(k for k in schema if k != "meta")
            known["meta_fields"] = tuple(schema["meta"]) if isinstance(schema.get("meta"), dict) else ()
        for k in ("style_axes", "fields", "meta_fields"):
            if k in known:
                known[k] = tuple(known[k])
        return cls(**known, quality=Quality(**{k: v for k, v in q.items() if k in Quality.__dataclass_fields__}))


def row_values(schema: T.StructType) -> Column:
    """A map from each path of a row (``response``, ``meta.word``) to its value as text. A field of ``meta`` also goes by its bare name, unless a column has that."""
    out: dict[str, Column] = {}

    def add(prefix: str, fields: list[T.StructField]) -> None:
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                add(f"{prefix}{f.name}.", f.dataType.fields)
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.BinaryType, T.VariantType)):
                out[prefix + f.name] = F.col(".".join(f"`{p}`" for p in f"{prefix}{f.name}".split("."))).cast("string")

    add("", schema.fields)
    for name in [k for k in out if k.startswith("meta.")]:
        out.setdefault(name.removeprefix("meta."), out[name])
    return F.create_map(*(x for k, v in out.items() for x in (F.lit(k), v)))


def signature(paths: list[Column]) -> Column:
    """Trimmed lower-case values with two bars between; a missing value counts as the text ``none``."""
    return F.concat_ws("||", *(F.lower(strip(F.coalesce(p.cast("string"), F.lit("none")))) for p in paths))


def with_language(rows: DataFrame, text: str, alias: str = "lang") -> DataFrame:
    """Adds the language most of whose function words occur, null where none does; ties go to the first listed.

    Words and counts are columns of their own, so each is computed once however often the language is used.
    """
    every = sorted({w for v in FUNCTION_WORDS.values() for w in v})
    ws = F.filter(F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: w.isin(*every))
    count = lambda listed: F.size(F.filter("_ws", lambda w: w.isin(*listed)))
    counted = rows.withColumn("_ws", ws).withColumn("_n", F.array(*(count(v) for v in FUNCTION_WORDS.values())))
    names = F.array(*(F.lit(k) for k in FUNCTION_WORDS))
    best = F.array_max("_n")
    return counted.withColumn(alias, F.when(best > 0, F.element_at(names, F.array_position("_n", best).cast("int")))).drop("_ws", "_n")


def reason(quality: dict[str, Column], term: Column) -> tuple[Column, Column, Column]:
    """Number of the first rule a row breaks (as ``_rule``), then from it the stable code and the reason; all null for a valid row.

    The row has instruction, response and meta, ``_ask`` and ``_reply`` (trimmed), ``_low`` (response in lower case) and ``_lang``; ``_no_field`` and
    ``_no_meta`` are the first of the task's required fields and meta keys without a value. ``quality`` has a column for each setting.
    """
    ask, reply, low, lang = (F.col(c) for c in ("_ask", "_reply", "_low", "_lang"))
    refusal = low.rlike("|".join(REFUSAL_MARKERS))  # no character of the phrases is special in a pattern
    wanted = F.lower(strip(term))
    lit = F.lit
    rules = [
        (F.col("_no_field").isNotNull(), "missing_field", F.concat(lit("missing field '"), "_no_field", lit("'"))),
        (F.col("meta").isNull() & F.col("_has_meta"), "meta_not_object", lit("meta is not an object")),
        (F.col("_no_meta").isNotNull(), "missing_meta", F.concat(lit("missing meta."), "_no_meta")),
        (F.col("instruction").isNull() | F.col("response").isNull(), "not_strings", lit("instruction/response not strings")),
        (~F.length(ask).between(quality["min_instruction_chars"], quality["max_instruction_chars"]), "instruction_length", F.concat(lit("instruction length "), F.length(ask).cast("string"), lit(" out of bounds"))),
        (~F.length(reply).between(quality["min_response_chars"], quality["max_response_chars"]), "response_length", F.concat(lit("response length "), F.length(reply).cast("string"), lit(" out of bounds"))),
        (quality["forbid_refusals"] & refusal, "refusal", lit("response looks like a refusal")),
        (quality["require_seed_term_in_response"] & (wanted != "") & ~low.contains(wanted), "grounding", F.concat(lit("grounding term '"), term, lit("' absent from response"))),
        (quality["require_lang"].isNotNull() & lang.isNotNull() & (lang != quality["require_lang"]), "language", F.concat(lit("response not detected as '"), quality["require_lang"], lit("'"))),
    ]
    code = F.coalesce(*(F.when(holds, lit(k)) for k, (holds, _, _) in enumerate(rules)))
    name = F.element_at(F.array(*(lit(n) for _, n, _ in rules)), F.col("_rule") + 1)
    text = F.coalesce(*(F.when(F.col("_rule") == k, why) for k, (_, _, why) in enumerate(rules)))
    return code, name, text


def validated(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows with signature, reason_code and reason.

    specs: name, dedup_key, quality, and where given seed_term_field (the meta key of the grounding term), fields and meta_fields (what the
    task's schema asks for; instruction, response, meta.word and meta.style by default). A dedup path may be any column or field of a
    struct; one that the row lacks counts as ``none``.
    """
    given = lambda c, default: F.coalesce(F.col(c), default).alias(f"_{c}") if c in specs.columns else default.alias(f"_{c}")
    names = lambda xs: F.array(*map(F.lit, xs))
    settings = given("seed_term_field", F.lit("word")), given("fields", names(Task.fields)), given("meta_fields", names(Task.meta_fields))
    spec = specs.select(F.col("name").alias("task"), "dedup_key", F.col("quality").alias("_q"), *settings)
    full = rows.join(spec, "task")
    quality = {k: F.coalesce(F.col(f"_q.{k}"), F.lit(v)) if v is not None else F.col(f"_q.{k}") for k, v in Quality().__dict__.items()}
    full = with_language(full, "response", "_lang").withColumns({"_ask": strip(F.col("instruction")), "_reply": strip(F.col("response")), "_low": F.lower("response")})
    full = full.withColumn("_values", row_values(rows.schema))
    at = lambda p: F.try_element_at(F.col("_values"), p)
    paths = F.filter(F.transform(F.split("dedup_key", r"\+"), strip), lambda p: p != "")
    sig = F.array_join(F.transform(paths, lambda p: F.lower(strip(F.coalesce(at(p), F.lit("none"))))), "||")
    meta = lambda k: at(F.concat(F.lit("meta."), k))
    full = full.withColumns({
        "signature": sig, "_term": meta(F.col("_seed_term_field")), "_has_meta": F.size("_meta_fields") > 0,
        "_no_field": F.try_element_at(F.filter("_fields", lambda f: at(f).isNull()), F.lit(1)),
        "_no_meta": F.try_element_at(F.filter("_meta_fields", lambda k: F.coalesce(meta(k), F.lit("")) == ""), F.lit(1)),
    })
    rule, code, why = reason(quality, F.col("_term"))
    out = full.withColumn("_rule", rule).withColumn("reason_code", F.when(F.col("_rule").isNotNull(), code)).withColumn("reason", why)
    return out.drop("_q", "dedup_key", "_rule", "_ask", "_reply", "_low", "_lang", "_values", "_term", "_has_meta", "_no_field", "_no_meta", "_seed_term_field", "_fields", "_meta_fields")


def dedup_valid(checked: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Mark valid rows whose task and signature a row before them has (by ingested_at, row_id), or the history (task, signature).

    The earliest row of each signature comes from a partial aggregate, so a signature that very many rows share is no single task.
    The checked rows are written once, as both the aggregate and the join need them.
    """
    checked = materialise(checked, "checked")
    order = F.struct("ingested_at", "row_id")
    first = checked.where("reason_code IS NULL").groupBy("task", "signature").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    if history is not None:
        known = history.select("task", "signature").distinct().withColumn("_known", F.lit(True))
        first = first.join(known, ["task", "signature"], "left")
    else:
        first = first.withColumn("_known", F.lit(None).cast("boolean"))
    first = first.where("_n > 1 OR _known").drop("_n")  # signatures of one row need no partner
    out = checked.join(first, ["task", "signature"], "left")
    again = F.col("reason_code").isNull() & (F.coalesce("_known", F.lit(False)) | F.coalesce(order != F.col("_first"), F.lit(False)))
    return (
        out.withColumn("reason", F.when(again, F.concat(F.lit("duplicate ("), "signature", F.lit(")"))).otherwise(F.col("reason")))
        .withColumn("reason_code", F.when(again, "duplicate").otherwise(F.col("reason_code")))
        .drop("_first", "_known")
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """batch_id, pos and the object (variant) of each object in a reply's outermost array, and ``ok``; one row without object where nothing can be read.

    Fences, prose around, curly quotes, the meta-space and trailing commas are repaired; items that are no objects are left out.
    """
    text = F.translate("reply", "▁" + "".join(STRAIGHT_QUOTES), " " + "".join(STRAIGHT_QUOTES.values()))
    start = F.instr(text, "[")
    end = F.length(text) - F.instr(F.reverse(text), "]") + 1
    span = F.when((start > 0) & F.contains(text, F.lit("]")) & (end >= start), F.substring(text, start, end - start + 1))
    repaired = F.regexp_replace(span, r",(\s*[}\]])", "$1")
    data = replies.select("batch_id", F.coalesce(F.try_parse_json(span), F.try_parse_json(repaired)).alias("data"))
    data = data.withColumn("data", F.when(F.schema_of_variant("data").startswith("ARRAY"), F.col("data")))
    data.createOrReplaceTempView("_weftline_replies")
    items = data.sparkSession.sql("SELECT batch_id, v.pos, v.value FROM _weftline_replies, LATERAL variant_explode(data) AS v")
    items = items.where(F.schema_of_variant("value").startswith("OBJECT")).withColumn("ok", F.lit(True))
    failed = replies.select("batch_id").join(items.select("batch_id").distinct(), "batch_id", "left_anti")
    return items.unionByName(failed.withColumn("ok", F.lit(False)), allowMissingColumns=True)


LEDGER = ("task", "style", "backend", "n_seeds", "status", "created", "received", "ingested", "valid", "invalid")


def ledger_state(log: DataFrame) -> DataFrame:
    """One row a batch: of each field the last value that is not empty, '' if there is none."""
    last = [F.coalesce(F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ledger_seq"))), F.lit("")).alias(c) for c in LEDGER]
    return log.groupBy("batch_id").agg(*last)


def render_prompts(batched: DataFrame, styles: Column, head: str = "Write one object for each source item.") -> DataFrame:
    """One prompt a batch: the same head first, then the batch's style and its items in order.

    batched: batch_no, row_no, id, term, text. Batches rotate through ``styles``.
    """
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "id", "term", "text"))), lambda s: F.concat(F.lit("["), s["id"], F.lit("] "), s["term"], F.lit(": "), s["text"])), "\n")
    style = F.element_at(styles, (F.pmod(F.col("batch_no"), F.size(styles)) + 1).cast("int"))
    out = batched.groupBy("batch_no").agg(F.count("*").alias("n_seeds"), items.alias("items")).withColumn("style", style)
    return out.withColumn("prompt", F.concat(F.lit(head), F.lit("\nStyle: "), "style", F.lit("\nItems ("), F.col("n_seeds").cast("string"), F.lit("):\n"), "items")).drop("items")


def select_seeds(seeds: DataFrame, done: DataFrame, seed: int | None, n: int | None = None) -> DataFrame:
    """Seeds whose id isn't done, in a reproducible order (with None as they come), the first n of them."""
    left = seeds.join(done.select("id").distinct(), "id", "left_anti")
    if seed is not None:
        left = left.orderBy(order_key(seed, F.col("id")), "id")
    return left if n is None else left.limit(n)
