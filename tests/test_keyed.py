"""Tables in key-hash buckets: what a write touches, failures, replays, folding."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallystone.operators import archive as A
from tallystone.session import fresh_path
from tallystone.sources import keyed
from tallystone.sources.keyed import Conflict, KeyedTable
from tallystone.streaming import jobs as J

D = dt.date.fromisoformat
SNAP = "entity_id string, period_end date, fiscal_period string, v int"


def snap_rows(spark, rows, ordinal=False):
    return spark.createDataFrame(rows, SNAP + (", ordinal int" if ordinal else ""))


def snapshots(spark, n=40, buckets=8):
    table = KeyedTable(spark, fresh_path(spark, "snaps"), SNAP, A.SNAPSHOT_KEY, buckets)
    table.append(snap_rows(spark, [(f"e{i}", D("2025-12-31"), None if i % 2 else "FY", i) for i in range(n)]))
    return table


def values(table):
    return sorted((r["entity_id"] or "", r["fiscal_period"] or "", r["v"]) for r in table.read().collect())


def opened(df):
    """Buckets whose files a plan reads."""
    return {int(p.split("key_bucket=")[1].split("/")[0]) for p in df.inputFiles()}


def test_replacement_touches_the_buckets_of_its_keys(spark):
    table = snapshots(spark)
    before = table.current()
    batch = snap_rows(spark, [("e1", D("2025-12-31"), None, 100, 1), ("e1", D("2025-12-31"), None, 101, 2), (None, None, None, 5, 1)], True)
    touched = table.buckets_of(batch)
    assert 1 <= len(touched) <= 2 and opened(table.read_keys_of(batch)) <= touched
    after = A.store_snapshots(table, batch)
    assert {b for b in after.segments if after.segments[b] != before.segments.get(b)} == touched
    want = [(f"e{i}", "" if i % 2 else "FY", i) for i in range(40) if i != 1] + [("e1", "", 101), ("", "", 5)]
    assert values(table) == sorted(want)
    A.store_snapshots(table, snap_rows(spark, [(None, None, None, 6, 1)], True))  # a NULL key is replaced, not added
    assert values(table) == sorted([w for w in want if w[0]] + [("", "", 6)])


def test_a_failed_write_is_never_seen(spark, monkeypatch):
    table = snapshots(spark)
    before = values(table)
    batch = snap_rows(spark, [(f"e{i}", D("2025-12-31"), None, 900, 1) for i in range(1, 30, 2)], True)
    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):  # all buckets written, none published
            A.store_snapshots(table, batch)
    assert values(table) == before
    torn = batch.withColumn("v", F.when(F.col("entity_id") == "e29", F.raise_error(F.lit("torn"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="torn"):  # some buckets written
        table.replace(batch, torn.drop("ordinal"))
    assert values(table) == before
    A.store_snapshots(table, batch)
    assert [v for _, _, v in values(table)].count(900) == 15 and len(values(table)) == 40


def test_two_writers_do_not_overwrite_each_other(spark):
    table = snapshots(spark)
    held = table.current()
    table.append(snap_rows(spark, [("x", None, None, 1)]))
    with pytest.raises(Conflict):
        table._publish(held, held.segments, None, None)


def test_facts_of_replaced_snapshots_vanish(spark):
    facts = "entity_id string, period_end date, fiscal_period string, concept string, accession string"
    day = D("2025-12-31")
    table = KeyedTable(spark, fresh_path(spark, "facts"), facts, A.SNAPSHOT_KEY, 4)
    table.append(spark.createDataFrame([("a", day, "FY", c, "1") for c in ("x", "y")] + [("b", day, None, "x", "2")], facts))
    heads = spark.createDataFrame([("a", day, "FY", "3")], "entity_id string, period_end date, fiscal_period string, accession string")
    new = spark.createDataFrame([("a", day, "FY", "x", "3"), ("a", day, "FY", "z", "superseded")], facts)
    A.store_canonical_facts(table, heads, new)
    assert sorted((r["entity_id"], r["concept"], r["accession"]) for r in table.read().collect()) == [("a", "x", "3"), ("b", "x", "2")]
    raw = KeyedTable(spark, fresh_path(spark, "raw"), "accession string, n int", ["accession"], 4)
    raw.append(spark.createDataFrame([("1", 1), ("1", 2), (None, 3)], "accession string, n int"))
    A.store_raw_facts(raw, spark.createDataFrame([("1", 9), (None, 8), (None, 7)], "accession string, n int"))
    assert sorted(r["n"] for r in raw.read().collect()) == [7, 8, 9]


def test_segments_fold_and_replays_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(keyed, "FAN", 2)
    table = KeyedTable(spark, fresh_path(spark, "sums"), J.RUN_ROW, ["run_id"], 2, fold=J._run_sums)
    for n in range(20):
        rows = spark.createDataFrame([(f"r{n % 3}", 1, 1, n % 2), (None, 1, 0, 0)], J.RUN_ROW)
        version = table.append(rows, "checkpoint", n)
        assert all(len(held) <= 5 for held in version.segments.values())  # one a level
    assert table.append(rows, "checkpoint", 7).number == version.number == table.current().number
    got = {r["run_id"]: (r["requested"], r["vetoed"]) for r in J._run_sums(table.read()).collect()}
    assert got == {"r0": (7, 3), "r1": (7, 4), "r2": (6, 3), None: (20, 0)}
    folders = [n for n in table.files.names("data")]
    assert len(folders) <= 12 and len(table.files.names("published")) <= 2
    table.append(rows, "another checkpoint", 0)
    assert J._run_sums(table.read()).where("run_id is null").first()["requested"] == 21


def arrivals(spark, path, rows):
    spark.createDataFrame(rows, J.ARRIVAL_ROW).coalesce(1).write.mode("append").parquet(path)


def test_a_micro_batch_opens_the_state_of_its_own_keys(spark):
    landing, target, checkpoint = (fresh_path(spark, x) for x in ("landing", "archive", "cp"))
    day = D("2026-07-01")
    arrivals(spark, landing, [("sec", f"d{i}", f"text {i}", "f", day, i) for i in range(60)])

    def run(cp=checkpoint):
        J.archive_stream(J.file_stream(spark, landing, J.ARRIVAL_ROW), target, cp, 16).awaitTermination()

    run()
    held = J.held_documents(spark, target)
    assert held.buckets == 16 and held.read().count() == 60
    again = [("sec", "d3", "text 3", "f", day, 100), ("sec", "d3", "new text", "f", day, 101), ("sec", "d3", "text 3b", "f", day, 102)]
    own = held.buckets_of(spark.createDataFrame(again, J.ARRIVAL_ROW))
    for b, parts in held.current().segments.items():
        if b not in own:  # whoever opened these would fail
            for segment, _ in parts:
                held.files.delete(f"data/segment={segment}/key_bucket={b}")
    arrivals(spark, landing, again)
    run()
    stored = spark.read.schema(J.ARCHIVE_ROW).parquet(target)
    got = sorted((r["content"], r["version"]) for r in stored.where("doc_id = 'd3'").collect())
    assert got == [("new text", 2), ("text 3", 1), ("text 3b", 3)]
    assert stored.count() == 62


def test_archive_replays_and_lost_checkpoints_add_nothing(spark, monkeypatch):
    landing, target, checkpoint = (fresh_path(spark, x) for x in ("landing", "archive", "cp"))
    arrivals(spark, landing, [("sec", f"d{i % 7}", f"text {i}", "f", D("2026-07-01"), i) for i in range(20)])

    def run(cp):
        J.archive_stream(J.file_stream(spark, landing, J.ARRIVAL_ROW), target, cp, 4).awaitTermination()

    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):  # documents are written, their keys are not
            run(checkpoint)
    run(checkpoint)
    read = lambda: sorted(tuple(r) for r in spark.read.schema(J.ARCHIVE_ROW).parquet(target).collect())
    stored = read()
    assert len(stored) == 20
    run(fresh_path(spark, "cp"))
    assert read() == stored
