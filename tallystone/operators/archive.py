"""Versioned append-only document archive and keyed replacement of stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone import schemas
from tallystone.functions.columns import path_component
from tallystone.operators.ranking import with_rank
from tallystone.session import materialize
from tallystone.sources.keyed import KeyedTable, Version, without

DOC_KEY = ["source", "doc_id"]
CONTENT_KEY = [*DOC_KEY, "content_sha256"]


# ------------------------------------------------------------------ scans
def read_manifest(
    spark: SparkSession,
    path: str,
    source: str | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Manifest rows, filtered on the partition columns. An unreadable line fails the scan."""
    raw = (
        spark.read.schema(schemas.MANIFEST + ", _corrupt_record string")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    checked = F.when(
        F.col("_corrupt_record").isNotNull(),
        F.raise_error(F.concat(F.lit("not a valid manifest record: "), "_corrupt_record")),
    ).otherwise(F.col("doc_id"))
    rows = raw.withColumn("doc_id", checked).drop("_corrupt_record")
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if since is not None:
        rows = rows.where(F.col("harvest_day") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.where(F.col("harvest_day") <= F.lit(until).cast("date"))
    return rows


def read_payloads(spark: SparkSession, payload_path: str, manifest: DataFrame) -> DataFrame:
    """Payload bytes of manifest rows; the stored table is pruned by run, source and day.

    Payloads of a run that failed before its manifest rows were written are never read.
    """
    key = ["run", "source", "harvest_day", "doc_id", "version"]
    return manifest.join(spark.read.parquet(payload_path).select(*key, "content"), key)


def read_payload_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Payload bytes of documents that were landed as single files under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", r"^file:/*", "/")
    base = root.rstrip("/") + "/"
    keyed = files.select(
        F.substr(relative, F.lit(len(base) + 1)).alias("path"), "content", "length"
    )
    return manifest.join(keyed, "path")


# ------------------------------------------------------------------ versions
def digest(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def stored_versions(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(*DOC_KEY).agg(F.count(F.lit(1)).alias("held"))


def unseen(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed documents of which no version is stored."""
    return listed.join(manifest.select(*DOC_KEY).distinct(), DOC_KEY, "left_anti")


def new_versions(arrivals: DataFrame, manifest: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Version numbers for content not held yet, in order of arrival.

    Works on digests; the payload joins later. ``arrival`` is unique within the batch.
    """
    first = arrivals.groupBy(*CONTENT_KEY).agg(F.min("arrival").alias("arrival"))
    fresh = first.join(manifest.select(*CONTENT_KEY), CONTENT_KEY, "left_anti")
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    ranked = with_rank(fresh, DOC_KEY, [F.col("arrival")], "position", **options)
    return ranked.join(stored_versions(manifest), DOC_KEY, "left").select(
        *CONTENT_KEY,
        "arrival",
        (F.coalesce("held", F.lit(0)) + F.col("position")).cast("int").alias("version"),
    )


def stored_path(day: Column) -> Column:
    return F.concat_ws(
        "/",
        path_component("source"),
        F.date_format(day, "yyyy"),
        F.date_format(day, "MM"),
        F.date_format(day, "dd"),
        path_component("doc_id"),
        F.concat(F.lit("v"), F.col("version").cast("string")),
        path_component("filename"),
    )


def plan_documents(batch: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows to append: manifest fields plus content, for documents with new content only.

    ``batch`` has source, doc_id, content, filename, harvest_day and a unique arrival.
    """
    digested = batch.withColumn("content_sha256", digest("content"))
    narrow = digested.select(*CONTENT_KEY, "arrival")
    versions = new_versions(narrow, manifest)
    return digested.join(versions, [*CONTENT_KEY, "arrival"]).withColumns(
        {
            "size_bytes": F.octet_length("content").cast("long"),
            "path": stored_path(F.col("harvest_day")),
            "filename": path_component("filename"),
        }
    )


def put_documents(batch: DataFrame, manifest_path: str, payload_path: str, manifest: DataFrame) -> None:
    """Append new versions under a run of their own, which their manifest rows name.

    Payloads go first, with their manifest fields, so a manifest row never lacks its payload; the
    manifest is read back from them without their bytes. A rerun after a failure gets another run,
    so nothing is read twice.
    """
    run = uuid.uuid4().hex
    planned = plan_documents(batch, manifest).drop("arrival").withColumn("run", F.lit(run))
    planned.write.mode("append").partitionBy("run", "source", "harvest_day").parquet(payload_path)
    fields = ["run", *[c for c in planned.columns if c not in ("content", "run")]]
    stored = batch.sparkSession.read.schema(planned.schema).parquet(payload_path).where(F.col("run") == run)
    stored.select(
        *fields, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ingested_at")
    ).write.mode("append").partitionBy("source", "harvest_day").json(manifest_path)


# ------------------------------------------------------------------ counters
def archive_status(manifest: DataFrame) -> DataFrame:
    """Documents, bytes, days and revisions per source, and in total where source is NULL."""
    return manifest.rollup("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("size_bytes").alias("bytes"),
        F.count_distinct("harvest_day").alias("days"),
        F.min("harvest_day").alias("first_day"),
        F.max("harvest_day").alias("last_day"),
        F.count_if(F.col("version") > 1).alias("revisions"),
    )


def harvest_outcomes(
    listed: DataFrame, fetched: DataFrame, manifest: DataFrame, refetch_known: bool = False
) -> DataFrame:
    """Outcome of every listed document: skipped_known, failed, unchanged, stored or revision.

    ``fetched`` holds content_sha256 per arrival; a listed row without one failed.
    """
    seen = manifest.select(*DOC_KEY).distinct().withColumn("seen", F.lit(True))
    known = listed.join(seen, DOC_KEY, "left")
    skipped = F.coalesce("seen", F.lit(False)) & F.lit(not refetch_known)
    wanted = known.withColumn("skipped", skipped)
    digests = fetched.select("arrival", "content_sha256")
    got = wanted.join(digests, "arrival", "left")
    versions = new_versions(
        got.where(~F.col("skipped") & F.col("content_sha256").isNotNull()).select(
            *CONTENT_KEY, "arrival"
        ),
        manifest,
    ).select("arrival", "version")
    return got.join(versions, "arrival", "left").select(
        *DOC_KEY,
        "harvest_day",
        "arrival",
        F.when(F.col("skipped"), F.lit("skipped_known"))
        .when(F.col("content_sha256").isNull(), F.lit("failed"))
        .when(F.col("version").isNull(), F.lit("unchanged"))
        .when(F.col("version") > 1, F.lit("revision"))
        .otherwise(F.lit("stored"))
        .alias("outcome"),
    )


def day_counters(outcomes: DataFrame) -> DataFrame:
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy("source", "harvest_day").agg(
        F.count(F.lit(1)).alias("listed"),
        is_("stored", "revision").alias("stored"),
        is_("revision").alias("revisions"),
        is_("unchanged").alias("unchanged"),
        is_("skipped_known").alias("skipped_known"),
        is_("failed").alias("failed"),
    )


# ------------------------------------------------------------------ keyed replacement
def last_in_batch(batch: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row per key; the filter on the rank also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(ordinal).desc())
    return batch.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def replace_raw_facts(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """All facts of the accessions in the batch are replaced; other accessions stay."""
    return without(existing, batch, ["accession"]).unionByName(batch)


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Replace rows by key, NULL equal to NULL; the last row of the batch wins."""
    newest = last_in_batch(batch, keys, ordinal).drop(ordinal)
    return without(existing, newest, keys).unionByName(newest)


SNAPSHOT_KEY = ["entity_id", "period_end", "fiscal_period"]


def upsert_snapshots(existing: DataFrame, batch: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return upsert(existing, batch, SNAPSHOT_KEY, ordinal)


def upsert_canonical_facts(existing: DataFrame, batch_headers: DataFrame, batch_facts: DataFrame) -> DataFrame:
    """Replace the facts of every snapshot in the batch, so that vanished concepts go.

    ``batch_headers`` are the winning headers; facts of superseded filings are not kept.
    """
    winners = batch_headers.select(*SNAPSHOT_KEY, F.col("accession").alias("__a"))
    kept = batch_facts.join(
        winners.select("__a").distinct(), F.col("accession") == F.col("__a"), "left_semi"
    )
    return without(existing, batch_headers, SNAPSHOT_KEY).unionByName(kept)


def upsert_profiles(existing: DataFrame, batch: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return upsert(existing, batch, ["entity_id"], ordinal)


# ------------------------------------------------------------------ replacement in stored tables
# The same rules on tables in key-hash buckets: a write reads and rewrites the buckets of its keys.
def store_raw_facts(table: KeyedTable, batch: DataFrame) -> Version:
    """``table`` is keyed by accession."""
    return table.replace(batch.select("accession"), batch)


def store_snapshots(table: KeyedTable, batch: DataFrame, ordinal: str = "ordinal") -> Version:
    """``table`` is keyed by SNAPSHOT_KEY or, for profiles, by entity_id; the last row of the batch wins."""
    newest = materialize(last_in_batch(batch, table.keys, ordinal).drop(ordinal), "newest")
    return table.replace(newest, newest)


store_profiles = store_snapshots


def store_canonical_facts(table: KeyedTable, batch_headers: DataFrame, batch_facts: DataFrame) -> Version:
    """``table`` is keyed by SNAPSHOT_KEY; facts of superseded filings are not kept."""
    accessions = batch_headers.select("accession").distinct()
    return table.replace(batch_headers, batch_facts.join(accessions, "accession", "left_semi"))
