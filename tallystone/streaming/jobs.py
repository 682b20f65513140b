"""Incremental jobs: file streams whose micro-batches run the batch operators.

What a job must remember lies in tables of key-hash buckets (``sources.keyed``). A micro-batch opens
the buckets of its own keys only, whatever the stream has gathered before. Its number is published
with its rows, under the checkpoint's path, so a batch replayed after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallystone.operators import archive as A
from tallystone.operators import evaluation as E
from tallystone.operators import normalize as NZ
from tallystone.session import materialize
from tallystone.sources.keyed import KeyedTable


def _start(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


ARCHIVE_ROW = (
    "source string, doc_id string, content_sha256 string, arrival long, version int, "
    "harvest_day date, filename string, path string, size_bytes long, content string"
)
ARRIVAL_ROW = (
    "source string, doc_id string, content string, filename string, harvest_day date, arrival long"
)


HELD_KEYS = "source string, doc_id string, content_sha256 string"


def held_documents(spark: SparkSession, target: str, buckets: int = 64) -> KeyedTable:
    """Keys and digests of what an archive stream has stored. Spark skips its folder in a scan of the target."""
    return KeyedTable(spark, f"{target}/_held", HELD_KEYS, A.DOC_KEY, buckets)


def archive_stream(stream: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Store documents as they arrive, with their version; content held already is not stored again.

    A row holds the manifest fields and the payload, so one write stores both or neither. What is
    held is looked up in the buckets of the batch's documents, in keys and digests alone. Rows go to
    a folder of the next number of the table of keys: a batch that failed before its keys were
    published writes the same folder again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        held = held_documents(batch.sparkSession, target, buckets)
        if held.seen(checkpoint, batch_id):
            return
        fields = [f.split()[0] for f in ARCHIVE_ROW.split(", ")]
        folder = f"{target}/batch={held.current().number}"
        planned = A.plan_documents(batch, held.read_keys_of(batch))
        planned.select(*fields).write.mode("overwrite").parquet(folder)
        held.append(batch.sparkSession.read.schema(ARCHIVE_ROW).parquet(folder), checkpoint, batch_id)

    return _start(stream, step, checkpoint)


FACT_ROW = (
    "entity_id string, period_end date, fiscal_period string, concept string, value double, "
    "accession string"
)


def ingested_filings(spark: SparkSession, target: str, buckets: int = 64) -> KeyedTable:
    """Accessions an ingest stream has stored facts of."""
    return KeyedTable(spark, f"{target}/_ingested", "accession string", ["accession"], buckets)


def ingest_stream(
    stream: DataFrame, filings: DataFrame, target: str, checkpoint: str, buckets: int = 64
) -> StreamingQuery:
    """Normalize the facts of filings that were not ingested before.

    The facts of one accession arrive in one file, hence in one micro-batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        done = ingested_filings(batch.sparkSession, target, buckets)
        if done.seen(checkpoint, batch_id):
            return
        fresh = materialize(batch.join(done.read_keys_of(batch), "accession", "left_anti"), "facts")
        _, facts = NZ.normalize(fresh, filings)
        folder = f"{target}/batch={done.current().number}"
        facts.select(
            "entity_id", "period_end", "fiscal_period", "concept", "value", "accession"
        ).write.mode("overwrite").parquet(folder)
        stored = batch.sparkSession.read.schema(FACT_ROW).parquet(folder)
        done.append(stored.select("accession").distinct(), checkpoint, batch_id)

    return _start(stream, step, checkpoint)


PICK_KEY = ["as_of", "strategy", "entity_id"]


def ledger_table(spark: SparkSession, target: str, schema: str, buckets: int = 16) -> KeyedTable:
    """The last row of each pick; folding segments keeps it."""
    return KeyedTable(spark, target, schema, PICK_KEY, buckets, fold=E.dedup_last)


def ledger_stream(stream: DataFrame, target: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keep the last row of each pick. dropDuplicates would keep the first."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)

    def step(batch: DataFrame, batch_id: int) -> None:
        table = ledger_table(batch.sparkSession, target, schema, buckets)
        table.append(E.dedup_last(batch), checkpoint, batch_id)

    return _start(stream, step, checkpoint)


def ledger_state(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """Current ledger: last row per pick over all micro-batches."""
    return E.dedup_last(ledger_table(spark, target, schema).read())


RUN_ROW = "run_id string, requested long, researched long, vetoed long"


def _run_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("requested", "researched", "vetoed")])


def run_index_table(spark: SparkSession, target: str, buckets: int = 16) -> KeyedTable:
    """Counts per run; folding segments adds them."""
    return KeyedTable(spark, target, RUN_ROW, ["run_id"], buckets, fold=_run_sums)


def run_index_stream(stream: DataFrame, target: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Counts per run as candidates finish: each micro-batch stores those of the runs it touches."""
    done = F.col("status") == "done"

    def step(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("requested"),
            F.count_if(done).alias("researched"),
            F.count_if(done & F.col("vetoed")).alias("vetoed"),
        )
        run_index_table(batch.sparkSession, target, buckets).append(counts, checkpoint, batch_id)

    return _start(stream, step, checkpoint)


def run_index_state(spark: SparkSession, target: str) -> DataFrame:
    """The run index: sums over the micro-batches stored so far."""
    return _run_sums(run_index_table(spark, target).read())


def report_changes(spark: SparkSession, reports_path: str) -> DataFrame:
    """Change feed of a report tree: one row per new JSON file."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", "true")
        .load(reports_path)
        .select("path", "modificationTime", "length")
    )
