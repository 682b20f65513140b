"""The pick ledger: append-only JSON lines, read back in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone import schemas
from tallystone import vocabulary as V
from tallystone.functions.columns import is_finite
from tallystone.operators.evaluation import pick_id
from tallystone.operators.ranking import with_rank
from tallystone.session import materialize


class LedgerError(RuntimeError):
    """A batch that must not be written."""


def append_picks(picks: DataFrame, path: str) -> int:
    """Append a batch. One value that is not finite rejects all of it."""
    stored = materialize(picks, "picks")
    bad_number = lambda c: F.col(c).isNotNull() & ~is_finite(c)
    bad = (
        bad_number("reference_price")
        | bad_number("weight")
        | bad_number("score")
        | F.exists(F.map_values("features"), lambda v: ~is_finite(v))
    )
    check = stored.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(bad, pick_id())).alias("culprit"),
    ).first()
    if check.culprit is not None:
        raise LedgerError(f"pick {check.culprit!r} has a non-finite value; nothing was written")
    if check.n:
        stored.write.mode("append").json(path)
    return check.n


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their place in the ledger, counted across files and splits.

    Files count in the order they were written; inside a file the split offset and then the
    order in the split decide. No file is read as one value.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("written"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("seen"),
    )
    stored = materialize(raw.where(F.trim("line") != ""), "ledger")
    order = [F.col(c) for c in ("written", "file", "offset", "seen")]
    return with_rank(stored, [], order, "ordinal").select("ordinal", "line")


def parse_picks(lines: DataFrame) -> DataFrame:
    """Lines -> picks. A bad last line is a torn write and is dropped; any other is an error."""
    parsed = F.from_json(
        "line", schemas.PICK + ", _corrupt_record string",
        {"columnNameOfCorruptRecord": "_corrupt_record"},
    )
    p = F.col("p")
    usable = (
        p["_corrupt_record"].isNull()
        & p["as_of"].isNotNull()
        & p["strategy"].isin(*V.STRATEGIES)
        & p["entity_id"].isNotNull()
    )
    last = lines.agg(F.max("ordinal").alias("last"))
    marked = (
        lines.withColumn("p", parsed)
        .withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn("last", last.scalar())
    )
    guarded = marked.withColumn(
        "ordinal",
        F.when(
            ~F.col("usable") & (F.col("ordinal") < F.col("last")),
            F.raise_error(F.format_string("ledger line %d is not a valid pick", "ordinal")),
        ).otherwise(F.col("ordinal")),
    )
    fields = [f.split()[0] for f in schemas.PICK.split(", ")]
    defaults = {"cohort": F.lit(""), "weight": F.lit(0.0), "run_id": F.lit("")}
    defaults["features"] = F.create_map().cast("map<string,double>")
    return guarded.where(F.col("usable") | (F.col("ordinal") < F.col("last"))).select(
        "ordinal",
        *[
            (F.coalesce(p[f], defaults[f]) if f in defaults else p[f]).alias(f)
            for f in fields
        ],
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return parse_picks(materialize(ledger_lines(spark, path), "lines"))


def read_strategy(picks: DataFrame, strategy: str) -> DataFrame:
    return picks.where(F.col("strategy") == strategy)


def run_ids(picks: DataFrame) -> DataFrame:
    """Distinct run ids with the place they first appear, oldest first."""
    return (
        picks.where(F.col("run_id") != "")
        .groupBy("run_id")
        .agg(F.min("ordinal").alias("first_ordinal"))
        .orderBy("first_ordinal")
    )
