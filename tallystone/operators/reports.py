"""Research output: run index, JSON and Markdown reports, report tree.

Markdown is built as ordered lines and written sorted, so no report is gathered in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone import schemas
from tallystone.functions.columns import slug
from tallystone.functions.number_text import percent
from tallystone.functions.text import strip

DISCLAIMER = (
    "> *Not investment advice. The LLM can veto a screened candidate; it can never recommend "
    "buying one. Every number is computed in code.*"
)
NO_FINDINGS = "_None survived citation verification._"
BRIEF_DISCLAIMER = (
    "> *Not investment advice. The agent may surface a candidate; the veto is decided in code and "
    "every number is code-computed.*"
)
BRIEF_NO_FINDINGS = "_No finding survived citation verification._"
BRIEF_NO_STEPS = "_No tools were called._"


# ------------------------------------------------------------------ run index
def report_base(entity_id: str = "entity_id", name: str = "name") -> Column:
    return F.concat(F.col(entity_id), F.lit("-"), slug(F.coalesce(name, entity_id)))


def run_entries(requested: DataFrame, done: DataFrame, finished: bool = False) -> DataFrame:
    """One row per requested candidate: done, or pending, or skipped once the run is over."""
    base = report_base()
    finished_rows = done.select(
        "run_id",
        "entity_id",
        "name",
        "verdict",
        (F.col("verdict") == "veto").alias("vetoed"),
        "findings",
        F.concat(base, F.lit(".md")).alias("markdown"),
        F.concat(base, F.lit(".json")).alias("json"),
        F.lit("done").alias("status"),
    )
    waiting = "skipped" if finished else "pending"
    return requested.select("run_id", "entity_id").join(
        finished_rows, ["run_id", "entity_id"], "left"
    ).select(
        "run_id",
        "entity_id",
        "name",
        "verdict",
        F.coalesce("vetoed", F.lit(False)).alias("vetoed"),
        F.coalesce("findings", F.lit(0)).cast("long").alias("findings"),
        "markdown",
        "json",
        F.coalesce("status", F.lit(waiting)).alias("status"),
    )


def run_index(entries: DataFrame) -> DataFrame:
    done = F.col("status") == "done"
    return entries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(done).alias("researched"),
        F.count_if(done & F.col("vetoed")).alias("vetoed"),
    )


# ------------------------------------------------------------------ report as JSON
def report_json(reports: DataFrame) -> DataFrame:
    """One JSON document per report row."""
    fields = [c for c in reports.columns if c != "day"]
    return reports.select(
        "day",
        "entity_id",
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"),
    )


def write_report_json(reports: DataFrame, path: str) -> None:
    report_json(reports).select("day", "value").write.mode("append").partitionBy("day").text(path)


# ------------------------------------------------------------------ report as Markdown
def line_rows(
    rows: DataFrame, section: int, part: int | Column, position: Column | None, *texts: Column | str,
    key: str = "entity_id",
) -> DataFrame:
    """Rows of (key, section, part, position, line_no, line); a NULL text is no line."""
    lines = F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])
    return rows.select(
        key,
        F.lit(section).alias("section"),
        (F.lit(part) if isinstance(part, int) else part).cast("int").alias("part"),
        (F.lit(0) if position is None else position).cast("long").alias("position"),
        F.posexplode(lines).alias("line_no", "line"),
    ).where(F.col("line").isNotNull())


LINE_ORDER = ["entity_id", "section", "part", "position", "line_no"]


def markdown_lines(
    memos: DataFrame,
    verified: DataFrame,
    veto_reasons: DataFrame,
    points: DataFrame,
    refuted: DataFrame,
    warnings: DataFrame,
    run_id: str,
    model: str,
    generated: str,
) -> DataFrame:
    """The report of every entity as lines, ordered by LINE_ORDER.

    ``memos``: entity_id, name, verdict, headline, thesis, disqualifying, reasoning.
    ``verified``: findings with verified and reason. ``points``: entity_id, stance, position, point.
    ``refuted`` and ``warnings``: entity_id, position, text.
    """
    veto = F.col("verdict") == "veto"
    entities = memos.select("entity_id")
    bullet = F.concat(F.lit("- "), F.col("text"))
    title = line_rows(
        memos, 0, 0, None,
        F.concat(F.lit("# "), F.coalesce("name", "entity_id")),
        "",
        F.concat(F.lit("**Entity:** `"), "entity_id", F.lit("`  ")),
        F.concat(
            F.lit("**Verdict:** "),
            F.when(veto, F.lit("🚫 VETO")).otherwise(F.lit("✅ no veto")),
            F.lit("  "),
        ),
        f"**Model:** {model}  ",
        f"**Generated:** {generated}  ",
        f"**Run:** `{run_id}`",
        "",
        DISCLAIMER,
        "",
        "## Headline", "", F.col("headline"), "",
        "## Thesis", "", F.col("thesis"), "",
    )
    vetoed = memos.where(veto)
    veto_head = line_rows(vetoed, 1, 0, None, "## Veto reasons", "")
    reasons = veto_reasons.join(vetoed.select("entity_id"), "entity_id", "left_semi")
    veto_rows = line_rows(
        reasons, 1, F.col("part") + 1, F.col("position"), F.concat(F.lit("- ❌ "), "reason")
    )
    veto_end = line_rows(vetoed, 1, 9, None, "")
    kept = verified.where("verified")
    counts = entities.join(
        verified.groupBy("entity_id").agg(
            F.count_if("verified").alias("kept"), F.count_if(~F.col("verified")).alias("dropped")
        ),
        "entity_id",
        "left",
    ).select("entity_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "dropped")])
    none = F.col("kept") == 0
    findings_head = line_rows(
        counts, 2, 0, None,
        F.format_string("## Cited findings (%d)", "kept"),
        "",
        F.when(none, F.lit(NO_FINDINGS)),
        F.when(none, F.lit("")),
    )
    finding_rows = line_rows(
        kept, 2, 1, F.col("finding_ordinal"),
        F.concat(F.lit("### ["), "severity", F.lit("] "), "category"),
        "",
        strip(F.col("claim")),
        "",
        F.concat(F.lit("> "), "quoted_span"),
        ">",
        F.concat(F.lit("> — filing `"), "source_accession", F.lit("`")),
        "",
    )
    debate = line_rows(memos, 3, 0, None, "## Debate", "", "**Bull**")
    bull = F.col("stance") == "bull"
    debate_rows = line_rows(
        points, 3, F.when(bull, 1).otherwise(3), F.col("position"), F.concat(F.lit("- "), "point")
    )
    bear_head = line_rows(memos, 3, 2, None, "", "**Bear**")
    debate_end = line_rows(memos, 3, 4, None, "")
    skeptic = line_rows(
        memos, 4, 0, None,
        F.concat(
            F.lit("**Skeptic** — "),
            F.when(F.col("disqualifying"), F.lit("disqualifying")).otherwise(
                F.lit("not disqualifying")
            ),
        ),
        "",
        F.col("reasoning"),
    )
    refuted_head = line_rows(
        entities.join(refuted, "entity_id", "left_semi"), 4, 1, None, "", "Refuted claims:"
    )
    refuted_rows = line_rows(refuted, 4, 2, F.col("position"), bullet)
    skeptic_end = line_rows(memos, 4, 3, None, "")
    warned = counts.join(
        warnings.select("entity_id").distinct().withColumn("warned", F.lit(True)), "entity_id", "left"
    ).where((F.col("dropped") > 0) | F.col("warned"))
    rate = F.col("dropped") / (F.col("kept") + F.col("dropped"))
    quality_head = line_rows(
        warned, 5, 0, None,
        "## Data quality",
        "",
        F.when(
            F.col("dropped") > 0,
            F.concat(
                F.lit("- "), F.col("dropped").cast("string"),
                F.lit(" finding(s) dropped: the quote was not found in the cited filing (fabrication rate "),
                percent(rate), F.lit(")."),
            ),
        ),
    )
    quality_rows = line_rows(warnings, 5, 1, F.col("position"), bullet)
    quality_end = line_rows(warned, 5, 2, None, "")
    parts = [
        title, veto_head, veto_rows, veto_end, findings_head, finding_rows, debate, debate_rows,
        bear_head, debate_end, skeptic, refuted_head, refuted_rows, skeptic_end, quality_head,
        quality_rows, quality_end,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief_lines(
    briefs: DataFrame, findings: DataFrame, steps: DataFrame, warnings: DataFrame,
    veto_reasons: DataFrame, generated: str,
) -> DataFrame:
    """Investigation briefs as lines, ordered by LINE_ORDER with run_id in place of the entity.

    ``briefs``: run_id, subject, entity_id, verdict, model, headline, thesis, recommendation,
    metrics_block. ``findings``: run_id, finding_ordinal, claim, quoted_span, source, is_red_flag,
    verified, reason. ``steps``: run_id, position (from 1), tool, thought, ok. ``warnings``: run_id,
    position, text. ``veto_reasons``: run_id, position, reason.
    """
    rows = lambda *a: line_rows(*a, key="run_id")
    runs, veto = briefs.select("run_id"), F.col("verdict") == "veto"
    kept, dropped = findings.where("verified"), findings.where("not verified")
    counts = runs.join(kept.groupBy("run_id").agg(F.count("*").alias("n")), "run_id", "left")
    n = F.coalesce("n", F.lit(0))
    vetoed = briefs.where(veto)
    reasons = veto_reasons.join(vetoed.select("run_id"), "run_id", "left_semi")
    metrics = briefs.where(F.coalesce("metrics_block", F.lit("")) != "")
    poor = runs.join(dropped.select("run_id").union(warnings.select("run_id")), "run_id", "left_semi")
    flag = F.when(F.col("is_red_flag"), F.lit("🚩 ")).otherwise(F.lit(""))
    parts = [
        rows(
            briefs, 0, 0, None,
            F.concat(F.lit("# "), "subject"),
            "",
            F.when(F.col("entity_id") != "", F.concat(F.lit("**Entity:** `"), "entity_id", F.lit("`  "))),
            F.concat(
                F.lit("**Verdict:** "),
                F.when(veto, F.lit("🚫 VETO")).otherwise(F.lit("✅ no veto")),
                F.lit("  "),
            ),
            F.concat(F.lit("**Model:** "), "model", F.lit("  ")),
            f"**Generated:** {generated}  ",
            F.concat(F.lit("**Run:** `"), "run_id", F.lit("`")),
            "",
            BRIEF_DISCLAIMER,
            "",
            "## Headline", "", F.col("headline"), "",
            "## Thesis", "", F.col("thesis"), "",
            "## Recommendation", "", F.col("recommendation"), "",
        ),
        rows(vetoed, 1, 0, None, "## Veto reasons (code-decided)", ""),
        rows(reasons, 1, 1, F.col("position"), F.concat(F.lit("- ❌ "), "reason")),
        rows(vetoed, 1, 2, None, ""),
        rows(
            counts, 2, 0, None, F.format_string("## Findings (%d verified)", n), "",
            F.when(n == 0, F.lit(BRIEF_NO_FINDINGS)), F.when(n == 0, F.lit("")),
        ),
        rows(
            kept, 2, 1, F.col("finding_ordinal"),
            F.concat(F.lit("### "), flag, "claim"), "", F.concat(F.lit("> "), "quoted_span"), ">",
            F.concat(F.lit("> — source `"), "source", F.lit("`")), "",
        ),
        rows(metrics, 3, 0, None, "## Code-computed metrics", "", "```", F.col("metrics_block"), "```", ""),
        rows(runs, 4, 0, None, "## What the agent did", ""),
        rows(
            steps.join(runs, "run_id", "left_semi"), 4, 1, F.col("position"),
            F.concat(
                F.col("position").cast("string"), F.lit(". **"), "tool", F.lit("**"),
                F.when(F.col("ok"), F.lit("")).otherwise(F.lit(" (failed)")), F.lit(" — "), "thought",
            ),
        ),
        rows(runs.join(steps.select("run_id"), "run_id", "left_anti"), 4, 2, None, BRIEF_NO_STEPS),
        rows(runs, 4, 3, None, ""),
        rows(poor, 5, 0, None, "## Data quality", ""),
        rows(
            dropped, 5, 1, F.col("finding_ordinal"),
            F.concat(F.lit('- dropped: "'), "claim", F.lit('" — '), "reason"),
        ),
        rows(warnings, 5, 2, F.col("position"), F.concat(F.lit("- "), "text")),
        rows(poor, 5, 3, None, ""),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief_json(
    briefs: DataFrame, findings: DataFrame, steps: DataFrame, warnings: DataFrame,
    veto_reasons: DataFrame, generated: str,
) -> DataFrame:
    """One JSON document a brief; what one run found and did is what one document holds."""
    finding = F.struct("claim", "quoted_span", "source", "is_red_flag")

    def listed(rows: DataFrame, order: str, item: Column, name: str) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))))
        return rows.groupBy("run_id").agg(F.transform(packed, lambda p: p["x"]).alias(name))

    dropped = F.struct(finding.alias("finding"), "reason")
    lists = [
        listed(findings.where("verified"), "finding_ordinal", finding, "verified_findings"),
        listed(findings.where("not verified"), "finding_ordinal", dropped, "dropped_findings"),
        listed(steps, "position", F.struct("tool", "tool_input", "thought", "ok"), "steps"),
        listed(warnings, "position", F.col("text"), "warnings"),
        listed(veto_reasons, "position", F.col("reason"), "veto_reasons"),
    ]
    out = briefs
    for one in lists:
        name, kind = one.columns[1], one.schema[1].dataType
        out = out.join(one, "run_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    out = out.withColumns({"generated": F.lit(generated), "vetoed": F.col("verdict") == "veto"})
    fields = [
        "subject", "entity_id", "run_id", "model", "generated", "verdict", "vetoed", "headline", "thesis",
        "recommendation", "veto_reasons", "verified_findings", "dropped_findings", "metrics_block", "steps",
        "warnings",
    ]
    return out.select("run_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_markdown(lines: DataFrame, path: str) -> None:
    """One folder ``entity_id=<id>`` with one text file for each report, its lines in order."""
    ordered = lines.repartition("entity_id").sortWithinPartitions(*LINE_ORDER)
    ordered.select("entity_id", "line").write.partitionBy("entity_id").text(path)


# ------------------------------------------------------------------ report tree
def read_report_tree(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents under <day>/ folders with their day and file name.

    Spark skips files whose name starts with an underscore, so run indexes are landed as
    run-<id>.json; tables that hold the _run-<id>.json names are understood as well.
    """
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(
        F.element_at(parts, -2).alias("day"), F.element_at(parts, -1).alias("file"), "value"
    ).where(F.col("file").endswith(".json"))


def tree_snapshot(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of run indexes with their details, stand-alone briefs), newest day first."""
    is_index = F.col("file").rlike("^_?run-")
    index = documents.where(is_index).select(
        "day", F.col("file").alias("index_file"), F.from_json("value", schemas.RUN_INDEX).alias("r")
    ).where(F.col("r").isNotNull())
    entries = index.select("day", "index_file", "r.run_id", F.explode("r.entries").alias("e")).select(
        "day", "index_file", "run_id", "e.entity_id", F.col("e.json").alias("json"),
        F.coalesce("e.status", F.lit("done")).alias("status"),
    )
    other = documents.where(~is_index).withColumn("doc", F.try_parse_json("value")).where(
        F.col("doc").isNotNull()
    )
    details = other.select("day", F.col("file").alias("json"), F.col("value").alias("detail"))
    full = entries.join(details, ["day", "json"], "left")
    referenced = entries.where(F.col("json").isNotNull()).select("day", "json").distinct()
    subject = F.try_variant_get("doc", "$.subject", "string")
    briefs = (
        other.select("day", F.col("file").alias("json"), "value", subject.alias("subject"))
        .where(F.col("subject").isNotNull())
        .join(referenced, ["day", "json"], "left_anti")
    )
    newest = [F.col("day").desc(), "json"]
    return full.orderBy(*newest), briefs.orderBy(*newest)
