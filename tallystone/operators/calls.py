"""Model-call logs: prices, cost rollup, replay by fingerprint, reasoning, JSON answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone import schemas
from tallystone import vocabulary as V
from tallystone.functions.json_spans import first_value
from tallystone.functions.text import strip

USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")


# ------------------------------------------------------------------ scan
def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Cached call records, one JSON file per key; unreadable files are marked, not fatal."""
    raw = (
        spark.read.schema(schemas.MODEL_CALL + ", _corrupt_record string")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .json(path)
    )
    usable = (
        F.col("_corrupt_record").isNull()
        & F.col("response.text").isNotNull()
        & F.col("response.model").isNotNull()
        & F.col("response.usage").isNotNull()
    )
    key = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return raw.select(key.alias("key"), usable.alias("usable"), "response.*")


# ------------------------------------------------------------------ prices
def normalize_model_id(model: Column | str) -> Column:
    """Lower case without one routing prefix."""
    cleaned = F.lower(F.trim(F.col(model) if isinstance(model, str) else model))
    prefixes = "|".join(p.replace(".", r"\.") for p in V.ROUTING_PREFIXES)
    return F.regexp_replace(cleaned, f"^({prefixes})", "")


def price_of(model: Column | str) -> Column:
    """struct<input, output, cached_input> of the longest matching prefix, NULL when unknown.

    The price list is short and fixed, so it is a chain of tests, longest prefix first.
    """
    cleaned = normalize_model_id(model)
    chain = None
    for prefix, inp, out, cached in sorted(V.MODEL_PRICES, key=lambda p: -len(p[0])):
        value = F.struct(
            F.lit(inp).alias("input"), F.lit(out).alias("output"), F.lit(cached).alias("cached_input")
        )
        test = cleaned.startswith(prefix)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def cache_write_price(input_price: Column, ttl: str = "5m") -> Column:
    if ttl not in V.CACHE_WRITE_MULTIPLIERS:
        raise ValueError(f"unknown cache TTL {ttl!r}")
    return input_price * V.CACHE_WRITE_MULTIPLIERS[ttl]


def call_cost(price: Column) -> Column:
    """Dollars of one call. Cached input is apart from input; reasoning is inside output."""
    rate = lambda field: F.coalesce(price[field], F.lit(0.0))
    return (
        F.col("input_tokens") * rate("input")
        + F.col("cached_input_tokens") * rate("cached_input")
        + F.col("output_tokens") * rate("output")
    ) / 1_000_000


def priced_calls(calls: DataFrame) -> DataFrame:
    priced = calls.withColumn("price", price_of("model"))
    return priced.withColumns(
        {"known_model": F.col("price").isNotNull(), "cost_usd": call_cost(F.col("price"))}
    ).drop("price")


def cost_by_stage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and dollars per stage, and in total where the stage is NULL."""
    staged = priced_calls(calls).withColumn("stage", F.coalesce("stage", F.lit("unattributed")))
    return staged.rollup("stage").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(c).alias(c) for c in USAGE],
        F.sum("cost_usd").alias("cost_usd"),
    )


def unknown_models(calls: DataFrame) -> DataFrame:
    missing = priced_calls(calls).where(~F.col("known_model")).groupBy("model")
    text = F.concat(F.lit("No price for model '"), "model", F.lit("'; counted as $0.00."))
    return missing.agg(F.count(F.lit(1)).alias("calls")).withColumn("warning", text)


# ------------------------------------------------------------------ fingerprints
def _json_value(value: Column) -> Column:
    """JSON text of one value, null included."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, 6, 2_000_000_000).substr(F.lit(1), F.length(text) - 6)


def fingerprint() -> Column:
    """sha256 of compact JSON with sorted keys over everything that can change an answer.

    ``json_schema`` is canonical JSON text and goes in as it is.
    """
    fields = {
        "effort": _json_value(F.col("effort")),
        "json_schema": F.coalesce("json_schema", F.lit("null")),
        "max_tokens": _json_value(F.col("max_tokens")),
        "messages": F.to_json(
            F.transform(
                "messages",
                lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")),
            )
        ),
        "model": _json_value(F.col("model")),
        "output_mode": _json_value(F.col("output_mode")),
        "prompt_version": _json_value(F.col("prompt_version")),
        "provider": _json_value(F.col("provider")),
        "schema_name": _json_value(F.col("schema_name")),
        "temperature": _json_value(F.col("temperature")),
    }
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def replay(calls: DataFrame, stored: DataFrame) -> DataFrame:
    """Calls with the stored answer of the same fingerprint; unusable records do not count."""
    keyed = calls.withColumn("key", fingerprint())
    answers = stored.where("usable").select("key", F.col("text").alias("answer"))
    return keyed.join(answers, "key", "left").withColumn("hit", F.col("answer").isNotNull())


def replay_stats(replayed: DataFrame) -> DataFrame:
    return replayed.agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("hit_rate"),
    )


def replay_misses(calls: DataFrame, stored: DataFrame) -> DataFrame:
    """Calls that have to be made again."""
    keyed = calls.withColumn("key", fingerprint())
    return keyed.join(stored.where("usable").select("key").distinct(), "key", "left_anti")


# ------------------------------------------------------------------ reasoning
PAIR = r"(?is)<think>(.*?)</think>"


def split_reasoning(responses: DataFrame) -> DataFrame:
    """content and reasoning of chat messages, whichever of four places the thinking is in.

    Input columns: content, reasoning_content, reasoning, thinking. An answer that is empty
    gets an error class instead of being passed on.
    """
    c = F.coalesce("content", F.lit(""))
    low = F.lower(c)
    opened, closed = F.instr(low, "<think>"), F.instr(low, "</think>")
    orphan = (closed > 0) & ((opened == 0) | (closed < opened))
    rest = F.when(orphan, c.substr(closed + 8, F.length(c))).otherwise(c)
    staged = responses.withColumns(
        {
            "__orphan": F.when(orphan, c.substr(F.lit(1), closed - 1)),
            "__rest": rest,
        }
    )
    bodies = F.regexp_extract_all("__rest", F.lit(PAIR), F.lit(1))
    without = F.regexp_replace("__rest", PAIR, "")
    tail = r"(?is)<think>(.*)\z"
    staged = staged.withColumns({"__bodies": bodies, "__without": without}).withColumns(
        {
            "__tail": F.regexp_extract("__without", tail, 1),
            "__answer": F.regexp_replace("__without", tail, ""),
        }
    )
    parts = F.concat(
        F.array("reasoning_content", "reasoning", "thinking", "__orphan"),
        F.col("__bodies"),
        F.array("__tail"),
    )
    kept = F.filter(F.transform(F.array_compact(parts), strip), lambda x: x != "")
    merged = F.nullif(F.array_join(F.array_distinct(kept), "\n\n"), F.lit(""))
    answer = strip(F.col("__answer"))
    error = F.when(
        answer == "",
        F.when(merged.isNotNull(), F.lit("reasoning_without_answer")).otherwise(
            F.lit("empty_response")
        ),
    )
    plain = [x for x in responses.columns if x not in ("content", "reasoning_content", "reasoning", "thinking")]
    return staged.select(
        *plain, answer.alias("content"), merged.alias("reasoning"), error.alias("error")
    )


# ------------------------------------------------------------------ JSON answers
@F.pandas_udf(T.StringType())
def embedded_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """First object or array in prose that decodes; NULL input is passed through.

    Brackets nested beyond what the decoder can follow hold no answer.
    """
    for batch in texts:
        yield batch.map(first_value)


def strip_inline_reasoning(text: Column) -> Column:
    """Answer part of a text that still carries its thinking."""
    cleaned = F.regexp_replace(text, r"(?is)<think\b[^>]*>.*?</think\s*>", "")
    cleaned = F.regexp_replace(cleaned, r"(?is)\A.*</think\s*>", "")
    return F.regexp_replace(cleaned, r"(?is)<think\b[^>]*>.*\z", "")


def extract_json(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add json_text: the whole answer, else a fenced block, else the first value in prose."""
    valid = lambda c: (c != "") & F.try_parse_json(c).isNotNull()
    answer = strip_inline_reasoning(F.col(text))
    fence = r"(?s)```[ \t]*[A-Za-z0-9_+-]*[ \t]*\r?\n(.*?)```"
    staged = responses.withColumn("__a", answer)
    blocks = F.transform(F.regexp_extract_all("__a", F.lit(fence), F.lit(1)), strip)
    direct = F.when(valid(strip(F.col("__a"))), strip(F.col("__a"))).otherwise(
        F.get(F.filter(blocks, valid), 0)
    )
    staged = staged.withColumn("__direct", direct)
    prose = embedded_json(F.when(F.col("__direct").isNull(), F.col("__a")))
    return (
        staged.withColumn("__prose", prose)
        .withColumn("json_text", F.coalesce("__direct", "__prose"))
        .drop("__a", "__direct", "__prose")
    )


# ------------------------------------------------------------------ validity
FINDINGS = (
    "struct<findings:array<struct<category:string, claim:string, quoted_span:string, "
    "source_accession:string, severity:string>>, notes:string>"
)
VIEW = "struct<stance:string, points:array<string>>"
MEMO = (
    "struct<entity_id:string, headline:string, thesis:string, verdict:string, "
    "veto_reasons:array<string>>"
)


def filled(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def finding_rows(answers: DataFrame, keys: list[str], payload: str = "json_text") -> DataFrame:
    """Findings of extraction answers, trimmed, each with whether it is valid."""
    parsed = answers.select(*keys, F.from_json(payload, FINDINGS).alias("p"))
    rows = parsed.select(*keys, F.posexplode("p.findings").alias("position", "f"))
    f = F.col("f")
    valid = (
        F.coalesce(f["category"].isin(*V.FINDING_CATEGORIES), F.lit(False))
        & F.coalesce(f["severity"].isin(*V.SEVERITIES), F.lit(False))
        & filled(f["claim"])
        & filled(f["quoted_span"])
        & filled(f["source_accession"])
    )
    return rows.select(
        *keys,
        "position",
        f["category"].alias("category"),
        strip(f["claim"]).alias("claim"),
        strip(f["quoted_span"]).alias("quoted_span"),
        strip(f["source_accession"]).alias("source_accession"),
        f["severity"].alias("severity"),
        valid.alias("valid"),
    )


def analyst_views(answers: DataFrame, keys: list[str], payload: str = "json_text") -> DataFrame:
    """Debate sides: blank points dropped, at least one point and at most eight kept."""
    parsed = answers.select(*keys, F.from_json(payload, VIEW).alias("p"))
    points = F.slice(
        F.filter(F.transform("p.points", strip), lambda x: x != ""), 1, V.MAX_POINTS
    )
    valid = F.coalesce(F.col("p.stance").isin(*V.STANCES), F.lit(False)) & F.coalesce(
        F.size(points) > 0, F.lit(False)
    )
    return parsed.select(*keys, "p.stance", points.alias("points"), valid.alias("valid"))


def memo_rows(answers: DataFrame, keys: list[str], payload: str = "json_text") -> DataFrame:
    """Memos with blank veto reasons dropped."""
    parsed = answers.select(*keys, F.from_json(payload, MEMO).alias("p"))
    reasons = F.filter(F.transform("p.veto_reasons", strip), lambda x: x != "")
    valid = (
        F.coalesce(F.col("p.verdict").isin("veto", "no_veto"), F.lit(False))
        & F.col("p.headline").isNotNull()
        & F.col("p.thesis").isNotNull()
    )
    return parsed.select(
        *keys,
        "p.headline",
        "p.thesis",
        "p.verdict",
        F.coalesce(reasons, F.array().cast("array<string>")).alias("veto_reasons"),
        valid.alias("valid"),
    )
