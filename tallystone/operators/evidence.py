"""Evidence per candidate: newest filings, anonymized text, excerpts, checked quotes, vetoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions import text as T
from tallystone.functions.columns import significant
from tallystone.functions.number_text import percent
from tallystone.operators import containment as C
from tallystone.session import materialize

FINDING_KEY = ["entity_id", "finding_ordinal"]


# ------------------------------------------------------------------ filings
def newest_filings(filings: DataFrame, k: int = V.FILINGS_PER_ENTITY) -> DataFrame:
    """The newest filings of each entity with their place; the limit also runs before the shuffle."""
    w = Window.partitionBy("entity_id").orderBy(
        F.coalesce(F.col("filing_date").cast("string"), F.lit("")).desc(),
        F.col("harvest_day").desc(),
        F.col("position").asc(),
    )
    return filings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def filings_from_manifest(manifest: DataFrame, k: int = V.FILINGS_PER_ENTITY) -> DataFrame:
    """The newest archived SEC filings of each company, by the company key the harvest recorded."""
    company = F.col("entity")["cik"]
    rows = manifest.where((F.col("source") == "sec") & company.isNotNull())
    return newest_filings(rows.withColumn("entity_id", company), k)


def anonymized_texts(filings: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """Filing texts with company name and tickers replaced. Empty texts are dropped."""
    if identities is None:
        return filings.where(F.col("text") != "")
    named = filings.where(F.col("text") != "").join(
        identities.select("entity_id", "name", "tickers"), "entity_id", "left"
    )
    hidden = T.anonymize(F.col("text"), T.redactions(F.col("name"), F.col("tickers")))
    return named.withColumn("text", hidden).drop("name", "tickers")


def excerpt_rows(texts: DataFrame) -> DataFrame:
    """Red-flag passages with their offsets, at most four per filing and category."""
    rows = texts.select("entity_id", "accession", F.posexplode(T.excerpts(F.col("text"))).alias("n", "e"))
    return rows.select("entity_id", "accession", "n", "e.category", "e.char_start", "e.text")


# ------------------------------------------------------------------ quotes
def folded_texts(texts: DataFrame) -> DataFrame:
    """Texts with their folded form, stored once; ``tokens``, its distinct words, where ``split`` asks for them."""
    return materialize(_with_folded(texts).drop("split"), "folded")


def _with_folded(texts: DataFrame) -> DataFrame:
    folded = texts.withColumn("folded", T.fold(F.col("text")))
    return folded.withColumn("tokens", F.when(F.col("split"), F.array_distinct(T.words(F.col("folded")))))


def folded_match(fq: Column, quote: Column, folded: Column, tokens: Column) -> Column:
    """How a quote that a text doesn't hold word for word matches its folded form, or NULL."""
    return F.when(F.contains(folded, fq), F.lit("match after whitespace normalisation")).when(
        T.token_overlap(quote, tokens) >= V.OVERLAP_THRESHOLD, F.lit("high token-overlap match")
    )


def verify_findings(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings with verified and reason. ``texts`` holds the filings of each entity.

    Word-for-word quotes are settled by one join with the cited filings. Only filings of the other
    quotes are folded, once each, and split into words. A quote that cites an unknown filing meets
    the entity's filings through ``containment``.
    """
    asked = findings.withColumn("quote", T.strip(F.col("quoted_span")))
    cited = texts.select("entity_id", F.col("accession").alias("source_accession"), "text")
    long_enough = F.length("quote") >= V.MIN_QUOTE_CHARS
    first = materialize(
        asked.join(cited, ["entity_id", "source_accession"], "left").withColumns(
            {"has_text": F.col("text").isNotNull(), "exact": long_enough & F.contains(F.col("text"), F.col("quote"))}
        ).drop("text"),
        "cited_quotes",
    )
    keyed = first.select(*FINDING_KEY, "source_accession", "has_text", "exact", "quote", T.fold(F.col("quote")).alias("fq"))
    open_quotes = keyed.where(F.col("has_text") & ~F.col("exact") & long_enough)
    stray = keyed.where(~F.col("has_text") & long_enough)
    # Filings cited by open quotes are split into words too; those of companies with stray quotes are folded.
    split = open_quotes.select("entity_id", F.col("source_accession").alias("accession")).distinct().withColumn("split", F.lit(True))
    astray = stray.select("entity_id").distinct().withColumn("astray", F.lit(True))
    keys = texts.select("entity_id", "accession").join(split, ["entity_id", "accession"], "left").join(astray, "entity_id", "left")
    wanted = texts.select("entity_id", "accession", "text").join(
        keys.where(F.col("split") | F.col("astray")).drop("astray"), ["entity_id", "accession"]
    )
    # Whoever reads the folded texts doesn't read the texts: these are not stored again.
    folded = materialize(_with_folded(wanted).drop("text", "split"), "folded")
    asked_of = stray.select(*FINDING_KEY, "fq")
    pairs = C.candidates(asked_of, folded, ["entity_id"], ["finding_ordinal"], "accession")
    # Open quotes ask the filing they cite, stray ones each filing that may hold them, in one join: folded texts move once.
    requests = open_quotes.select(
        *FINDING_KEY, F.col("source_accession").alias("accession"), "fq", "quote", F.lit(True).alias("is_cited")
    ).unionByName(
        pairs.join(asked_of, FINDING_KEY).select(
            *FINDING_KEY, "accession", "fq", F.lit(None).cast("string").alias("quote"), F.lit(False).alias("is_cited")
        )
    )
    is_cited = F.col("is_cited")
    answers = (
        requests.join(folded, ["entity_id", "accession"])
        .select(
            *FINDING_KEY,
            F.when(is_cited, folded_match(F.col("fq"), F.col("quote"), F.col("folded"), F.col("tokens"))).alias("other"),
            F.when(~is_cited, F.contains("folded", "fq")).alias("elsewhere"),
        )
        .groupBy(*FINDING_KEY)
        .agg(F.max("other").alias("other"), F.bool_or("elsewhere").alias("elsewhere"))
    )
    checked = first.join(answers, FINDING_KEY, "left").withColumn(
        "match", F.when(F.col("exact"), F.lit("exact match")).otherwise(F.col("other"))
    )
    shown = F.concat(F.lit("'"), "source_accession", F.lit("'"))
    reason = (
        F.when(
            F.length("quote") < V.MIN_QUOTE_CHARS,
            F.format_string("quote too short to verify (%d chars)", F.length("quote")),
        )
        .when(
            ~F.col("has_text") & F.coalesce("elsewhere", F.lit(False)),
            F.concat(F.lit("quote found but attributed to wrong/absent accession "), shown),
        )
        .when(
            ~F.col("has_text"),
            F.concat(F.lit("cited accession "), shown, F.lit(" not in evidence pack")),
        )
        .otherwise(F.coalesce("match", F.lit("quote not found in cited filing")))
    )
    return checked.select(
        *findings.columns, F.col("match").isNotNull().alias("verified"), reason.alias("reason")
    )


def fabrication_rates(verified: DataFrame) -> DataFrame:
    """Share of dropped findings per entity with a warning above the threshold."""
    rates = verified.groupBy("entity_id").agg(
        F.count_if("verified").alias("verified"),
        F.count_if(~F.col("verified")).alias("dropped"),
        F.avg((~F.col("verified")).cast("int")).alias("rate"),
    )
    text = F.concat(
        F.lit("high citation-failure rate ("), percent(F.col("rate")),
        F.lit("): the extractor invented quotes for this candidate -- treat its findings with extra caution"),
    )
    return rates.withColumn("warning", F.when(F.col("rate") > V.FABRICATION_WARNING, text))


def veto_decisions(verified: DataFrame, skeptic: DataFrame) -> DataFrame:
    """Verdict per entity: a verified critical finding or a disqualifying skeptic is a veto."""
    critical = F.col("verified") & (F.col("severity") == "critical")
    counts = verified.groupBy("entity_id").agg(F.count_if(critical).alias("critical_findings"))
    joined = skeptic.join(counts, "entity_id", "left").withColumn(
        "critical_findings", F.coalesce("critical_findings", F.lit(0))
    )
    veto = (F.col("critical_findings") > 0) | F.col("disqualifying")
    return joined.select(
        "entity_id",
        F.when(veto, F.lit("veto")).otherwise(F.lit("no_veto")).alias("verdict"),
        "critical_findings",
        "disqualifying",
    )


def veto_reasons(verified: DataFrame, skeptic: DataFrame) -> DataFrame:
    """Reasons as rows: critical claims in finding order, then the skeptic's reasoning.

    Rows, not one array per entity, so that no entity is gathered in one place.
    """
    claims = verified.where(F.col("verified") & (F.col("severity") == "critical")).select(
        "entity_id",
        F.lit(0).alias("part"),
        F.col("finding_ordinal").alias("position"),
        T.strip(F.col("claim")).alias("reason"),
    )
    doubts = skeptic.where("disqualifying").select(
        "entity_id",
        F.lit(1).alias("part"),
        F.lit(0).cast("long").alias("position"),
        T.strip(F.col("reasoning")).alias("reason"),
    )
    return claims.unionByName(doubts).where(F.col("reason") != "")


# ------------------------------------------------------------------ brief findings
def union_sources(filings: DataFrame, pages: DataFrame) -> DataFrame:
    """Sources of a run by id; a web page replaces a filing of the same id."""
    both = filings.select("run_id", "source", "text", F.lit(0).alias("priority")).unionByName(
        pages.select("run_id", "source", "text", F.lit(1).alias("priority"))
    )
    w = Window.partitionBy("run_id", "source").orderBy(F.col("priority").desc())
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def verify_brief_findings(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """A quote counts when its cited source, or any other source of the run, holds it.

    The cited source is tried first, by equality and word for word. Only quotes it does not hold meet
    the sources of their run, through ``containment``; sources of runs without such quotes are not
    folded.
    """
    keys = ["run_id", "finding_ordinal"]
    asked = findings.withColumn("quote", T.strip(F.col("quoted_span")))
    long_enough = F.length("quote") >= V.MIN_QUOTE_CHARS
    first = materialize(
        asked.join(sources.select("run_id", "source", "text"), ["run_id", "source"], "left").withColumn(
            "in_cited", F.coalesce(long_enough & F.contains(F.col("text"), F.col("quote")), F.lit(False))
        ).select(*findings.columns, "quote", "in_cited"),
        "cited",
    )
    open_quotes = first.where(~F.col("in_cited") & long_enough).select(*keys, "quote", T.fold(F.col("quote")).alias("fq"))
    met = sources.select("run_id", "source", "text").join(open_quotes.select("run_id").distinct(), "run_id", "left_semi")
    texts = folded_texts(met.withColumn("split", F.lit(True)))
    pairs = C.candidates(
        open_quotes, texts, ["run_id"], ["finding_ordinal"], "source", missing_share=1 - V.OVERLAP_THRESHOLD
    )
    match = F.contains(F.col("text"), F.col("quote")) | folded_match(
        F.col("fq"), F.col("quote"), F.col("folded"), F.col("tokens")
    ).isNotNull()
    elsewhere = (
        pairs.join(open_quotes, keys)
        .join(texts, ["run_id", "source"])
        .where(match)
        .select(*keys, F.lit(True).alias("elsewhere"))
        .distinct()
    )
    verified = F.col("in_cited") | F.coalesce("elsewhere", F.lit(False))
    return first.join(elsewhere, keys, "left").select(
        *findings.columns,
        verified.alias("verified"),
        F.when(~verified, F.lit("quote not found in any fetched source")).alias("reason"),
    )


def evidence_catalog(sources: DataFrame) -> DataFrame:
    """One line per source a run may cite."""
    kind = F.when(F.col("priority") == 0, F.lit("SEC filing")).otherwise(F.lit("web page"))
    line = F.concat(
        F.lit("- "), "source", F.lit(": "), kind,
        F.format_string(" (%,d chars)", F.length("text")),
    )
    return sources.select("run_id", "source", line.alias("line"))


# Lines of runs that have nothing to show.
NO_SOURCES = "(no sources fetched -- you have no basis for any finding)"
NO_STEPS = "(no tools were called)"
DIGEST_HEAD = 140


def run_catalog(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Catalog lines of every run; a run without sources has one line that says so."""
    lines = evidence_catalog(sources)
    bare = runs.select("run_id").join(sources.select("run_id").distinct(), "run_id", "left_anti")
    nothing = bare.select("run_id", F.lit(None).cast("string").alias("source"), F.lit(NO_SOURCES).alias("line"))
    return lines.join(runs.select("run_id"), "run_id", "left_semi").unionByName(nothing)


def step_digest(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """One line for each step of a run: tool, input, outcome and the head of what came back.

    ``steps``: run_id, position (from 1), tool, tool_input, observation, ok.
    """
    first_line = F.regexp_extract(F.coalesce("observation", F.lit("")), r"^[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*", 0)
    line = F.concat(
        F.col("position").cast("string"), F.lit(". "), "tool", F.lit("("), "tool_input", F.lit(")"),
        F.when(F.col("ok"), F.lit("")).otherwise(F.lit(" [failed]")),
        F.lit(" -> "), F.substring(first_line, 1, DIGEST_HEAD),
    )
    bare = runs.select("run_id").join(steps.select("run_id").distinct(), "run_id", "left_anti")
    nothing = bare.select("run_id", F.lit(0).cast("long").alias("position"), F.lit(NO_STEPS).alias("line"))
    return steps.select("run_id", F.col("position").cast("long").alias("position"), line.alias("line")).unionByName(nothing)


# ------------------------------------------------------------------ prompts
# Labels that the prompt table uses.
METRICS_LABEL = "COMPUTED METRICS (authoritative — do not recompute)"
EVIDENCE_LABEL = (
    "FILING EVIDENCE\nEach filing is labelled with its accession id. When you cite a quote, "
    "put that exact id in `source_accession`."
)
NO_EVIDENCE = (
    "(No narrative filing text is available for this candidate. Base any finding only on text "
    "you can quote; if there is none, return an empty findings list.)"
)


def metrics_block(metrics: DataFrame) -> DataFrame:
    """Compact text block of the computed metrics of each entity."""
    q = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    head = F.concat(
        F.lit("Period: "), F.col("period_end").cast("string"), F.lit(" ("), q("fiscal_period"),
        F.lit("), currency "), q("currency"),
    )
    # One array of the metrics, so that a plan holds the number format once.
    rows = F.array(
        *[
            F.struct(
                F.lit(f"  {n} = ").alias("label"), F.col(n)["value"].alias("value"),
                F.col(n)["basis"].alias("basis"), F.col(n)["ok"].alias("ok"),
            )
            for n in V.REPORT_METRICS
        ]
    )
    shown = F.filter(rows, lambda m: m["ok"] & m["value"].isNotNull())
    line = lambda m: F.concat(m["label"], significant(m["value"]), F.lit(" ["), m["basis"], F.lit("]"))
    body = F.array_compact(F.transform(shown, line))
    return metrics.select(
        "entity_id",
        F.concat_ws(
            "\n",
            head,
            F.when(F.size(body) == 0, F.lit("  (no metrics computed)")).otherwise(
                F.concat_ws("\n", body)
            ),
        ).alias("metrics_block"),
    )


def render_filings(texts: DataFrame) -> DataFrame:
    """Each filing as the model reads it: whole when short, else excerpts, else clipped."""
    parts = F.transform(
        T.excerpts(F.col("text")),
        lambda e: F.concat(F.lit("[excerpt: "), e["category"], F.lit("]\n"), e["text"]),
    )
    body = (
        F.when(F.length("text") <= V.FULL_TEXT_LIMIT, F.col("text"))
        .when(F.size("parts") > 0, F.array_join("parts", "\n\n"))
        .otherwise(
            F.concat(
                F.lit("[text truncated for length]\n"),
                F.substring("text", 1, V.FULL_TEXT_LIMIT),
            )
        )
    )
    block = F.concat(F.lit("=== FILING "), "accession", F.lit(" ===\n"), body)
    return texts.withColumn("parts", parts).select("entity_id", "place", block.alias("block"))


def prompt_rows(metrics: DataFrame, texts: DataFrame, redaction_note: str = "") -> DataFrame:
    """One extraction prompt per entity. The filings of an entity are at most three."""
    filings = render_filings(texts).groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "block"))).alias("blocks")
    )
    joined = metrics_block(metrics).join(filings, "entity_id", "left")
    bodies = F.transform("blocks", lambda b: b["block"])
    return joined.select(
        "entity_id",
        F.concat_ws(
            "\n\n",
            F.concat(F.lit(METRICS_LABEL + "\n"), "metrics_block"),
            F.nullif(F.lit(redaction_note), F.lit("")),
            F.lit(EVIDENCE_LABEL),
            F.coalesce(F.array_join(bodies, "\n\n"), F.lit(NO_EVIDENCE)),
        ).alias("prompt"),
    )


def finding_lines(verified: DataFrame) -> DataFrame:
    """Verified findings as prompt lines, in finding order, for the debate stages."""
    return verified.where("verified").select(
        *FINDING_KEY,
        F.concat(
            F.lit("["), "category", F.lit(" / "), "severity", F.lit("] "), "claim",
            F.lit("\n     quote ("), "source_accession", F.lit('): "'), "quoted_span", F.lit('"'),
        ).alias("debate_line"),
        F.concat(
            F.lit("- ["), "severity", F.lit("] "), "category", F.lit(": "), "claim"
        ).alias("memo_line"),
    )
