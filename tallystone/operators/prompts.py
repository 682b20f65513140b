"""Prompt bodies of the debate and memo stages, as ordered lines.

Findings and excerpts of a company have no bound, so a prompt stays a table of lines ordered by
``reports.LINE_ORDER``; sections are separated by an empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.ranking import with_rank
from tallystone.operators.reports import line_rows
from tallystone.session import materialize

# Texts of the prompt bodies.
ANONYMISED = (
    "This evidence is ANONYMISED: [COMPANY] and [TICKER] tokens are redactions standing in for the "
    "real company name and tickers, removed on purpose."
)
METRICS = "COMPUTED METRICS (authoritative — use these numbers exactly, do not recompute):"
NO_FINDINGS = (
    "VERIFIED FINDINGS: none. The citation-checked extraction surfaced no red flags in the "
    "available filings."
)
FINDINGS = "VERIFIED FINDINGS (each quote is confirmed present in the cited filing):"
EXCERPTS = "EVIDENCE EXCERPTS (anonymised passages retrieved from the filings):"
BULL_TO_REVIEW = "BULL CASE TO REVIEW (the points you must try to refute):"
MEMO_METRICS = "METRICS (authoritative, code-computed -- quote these, invent nothing):"
MEMO_FINDINGS = "VERIFIED FINDINGS (each citation already confirmed against the filing):"
MEMO_NO_FINDINGS = "None verified."
DECIDED = "DECIDED VERDICT (authoritative, do not change): "


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lines(rows: DataFrame, *lines: tuple[int, int, Column | int, int, Column]) -> DataFrame:
    """Lines of several sections from one reading of the rows; each is (section, part, position, line_no, text).

    A NULL text is no line.
    """
    made = [
        F.when(
            text.isNotNull(),
            F.struct(
                F.lit(section).alias("section"),
                F.lit(part).alias("part"),
                (F.lit(position) if isinstance(position, int) else position).cast("long").alias("position"),
                F.lit(line_no).alias("line_no"),
                text.alias("line"),
            ),
        )
        for section, part, position, line_no, text in lines
    ]
    return rows.select("entity_id", F.inline(F.array_compact(F.array(*made))))


def _found(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("entity_id").distinct().withColumn(name, F.lit(True))


def _evidence_lines(blocks: DataFrame, verified: DataFrame, excerpts: DataFrame, *more: tuple) -> DataFrame:
    """The evidence body and more lines an entity. Findings are stored here; excerpts come from a stored table."""
    entities = blocks.select("entity_id")
    findings = verified.where("verified").select(
        "entity_id", "finding_ordinal", "category", "severity", "claim", "source_accession", "quoted_span"
    )
    kept = materialize(findings.join(entities, "entity_id", "left_semi"), "kept_findings")
    passages = excerpts.join(entities, "entity_id", "left_semi")
    numbered = with_rank(kept, ["entity_id"], [F.col("finding_ordinal")], "i")
    finding = F.concat(
        F.lit("  "), F.col("i").cast("string"), F.lit(". ["), "category", F.lit(" / "), "severity", F.lit("] "), "claim"
    )
    quote = F.concat(F.lit("     quote ("), "source_accession", F.lit('): "'), "quoted_span", F.lit('"'))
    passage = F.concat(F.lit("  ["), "accession", F.lit(" / "), "category", F.lit("] "), "text")
    heads = blocks.join(_found(kept, "has_kept"), "entity_id", "left").join(_found(passages, "has_passages"), "entity_id", "left")
    of_excerpts = lambda text: F.when(F.col("has_passages"), F.lit(text))
    return _union([
        _lines(
            heads,
            (0, 0, 0, 0, F.lit(ANONYMISED)), (0, 0, 0, 1, F.lit("")), (0, 0, 0, 2, F.lit(METRICS)),
            (0, 0, 0, 3, F.col("metrics_block")), (0, 0, 0, 4, F.lit("")),
            (1, 0, 0, 0, F.when(F.col("has_kept"), F.lit(FINDINGS)).otherwise(F.lit(NO_FINDINGS))),
            (2, 0, 0, 0, of_excerpts("")), (2, 0, 0, 1, of_excerpts(EXCERPTS)),
            *more,
        ),
        _lines(numbered, (1, 1, F.col("i"), 0, finding), (1, 1, F.col("i"), 1, quote)),
        _lines(passages, (2, 1, F.col("position"), 0, passage)),
    ])


def analyst_lines(blocks: DataFrame, verified: DataFrame, excerpts: DataFrame) -> DataFrame:
    """The evidence body that bull and bear share.

    ``blocks``: entity_id, metrics_block. ``verified``: findings with verified. ``excerpts``:
    entity_id, position, accession, category, text.
    """
    return _evidence_lines(blocks, verified, excerpts)


def skeptic_lines(blocks: DataFrame, verified: DataFrame, excerpts: DataFrame, points: DataFrame) -> DataFrame:
    """The evidence body and the bull's points, numbered, to refute."""
    bull = points.where("stance = 'bull'").join(blocks.select("entity_id"), "entity_id", "left_semi")
    point = F.concat(F.lit("  "), (F.col("position") + 1).cast("string"), F.lit(". "), "point")
    return _union([
        _evidence_lines(
            blocks, verified, excerpts, (3, 0, 0, 0, F.lit("")), (3, 0, 0, 1, F.lit(BULL_TO_REVIEW))
        ),
        _lines(bull, (3, 1, F.col("position"), 0, point)),
    ])


def memo_lines(
    blocks: DataFrame, verified: DataFrame, points: DataFrame, skeptic: DataFrame, refuted: DataFrame,
    verdicts: DataFrame, veto_reasons: DataFrame,
) -> DataFrame:
    """The memo's body: numbers, findings, both cases, the skeptic, and the verdict decided in code.

    ``skeptic``: entity_id, disqualifying, reasoning. ``refuted``: entity_id, position, text.
    ``verdicts``: entity_id, verdict. ``veto_reasons``: entity_id, part, position, reason.
    """
    entities = blocks.select("entity_id")
    own = lambda df: df.join(entities, "entity_id", "left_semi")
    kept, rows, said, refutes, reasons = map(own, (verified.where("verified"), points, skeptic, refuted, veto_reasons))
    finding = F.concat(F.lit("- ["), "severity", F.lit("] "), "category", F.lit(": "), "claim")
    bull = F.col("stance") == "bull"
    yes_no = F.when(F.col("disqualifying"), F.lit("True")).otherwise(F.lit("False"))
    return _union([
        line_rows(blocks, 0, 0, None, MEMO_METRICS, F.col("metrics_block"), "", MEMO_FINDINGS),
        line_rows(entities.join(kept, "entity_id", "left_anti"), 1, 0, None, MEMO_NO_FINDINGS),
        line_rows(kept, 1, 1, F.col("finding_ordinal"), finding),
        line_rows(entities, 2, 0, None, "", "BULL CASE:"),
        line_rows(rows, 2, F.when(bull, 1).otherwise(3), F.col("position"), F.concat(F.lit("- "), "point")),
        line_rows(entities, 2, 2, None, "", "BEAR CASE:"),
        line_rows(entities, 3, 0, None, "", "SKEPTIC:"),
        line_rows(said, 3, 1, None, F.concat(F.lit("Disqualifying: "), yes_no), F.concat(F.lit("Reasoning: "), "reasoning")),
        line_rows(entities.join(refutes, "entity_id", "left_semi"), 3, 2, None, "Refuted claims:"),
        line_rows(refutes, 3, 3, F.col("position"), F.concat(F.lit("- "), "text")),
        line_rows(own(verdicts), 4, 0, None, "", F.concat(F.lit(DECIDED), "verdict")),
        line_rows(entities.join(reasons, "entity_id", "left_semi"), 4, 1, None, "Veto reasons:"),
        line_rows(entities.join(reasons, "entity_id", "left_anti"), 4, 1, None, "Veto reasons: none"),
        line_rows(reasons, 4, F.col("part") + 2, F.col("position"), F.concat(F.lit("- "), "reason")),
    ])
