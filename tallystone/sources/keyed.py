"""Tables in key-hash buckets with published versions.

A row lies in the bucket of its key's hash. Data files never change: a write adds a numbered segment,
one folder for each bucket it touches, and then publishes a small list that names the segments of
every bucket. Readers follow the newest list, so a write that fails half way is never seen, and the
next write takes its number again. Of a list and its predecessor all segments are kept, for readers
that have begun; older ones are deleted.

``replace`` rewrites the touched buckets only. ``append`` adds rows to them; when FAN segments of one
bucket have the same level they are folded into one of the next level, so a bucket has at most
FAN - 1 segments a level and a row is rewritten once a level. ``fold`` combines the rows of a key and
must give the same result over any grouping of segments (a sum, the last row); without one, folding
only joins files.

Buckets bound the list (a few numbers each) and what one key's write has to read; their number is
fixed by the first write. A bucket larger than a task is written by several.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
BUCKET, SEGMENT = "key_bucket", "segment"


class Conflict(RuntimeError):
    """Another writer published first."""


# ------------------------------------------------------------------ files of any file system
class Folder:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._root = self._path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self._path(self._root, name) if name else self._root

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """A new file with all of its text; False when the name is taken."""
        draft = self._at(f".draft-{name.replace('/', '-')}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        return not self._fs.exists(self._at(name)) and self._fs.rename(draft, self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


# ------------------------------------------------------------------ tables
@dataclass
class Version:
    """What one published list says."""

    number: int = 0
    buckets: int = 0
    # Last batch of each writer that numbers its batches.
    batches: dict[str, int] = field(default_factory=dict)
    # Bucket -> [segment, level] of its segments, oldest first.
    segments: dict[int, list[list[int]]] = field(default_factory=dict)

    def written(self) -> set[tuple[int, int]]:
        return {(s, b) for b, held in self.segments.items() for s, _ in held}


class KeyedTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        keys: list[str],
        buckets: int = 64,
        fold: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.schema, self.keys, self.fold = spark, path.rstrip("/"), schema, keys, fold
        self.columns = spark.createDataFrame([], schema).columns
        if BUCKET in self.columns or SEGMENT in self.columns:
            raise ValueError(f"{BUCKET} and {SEGMENT} are names of the table's folders")
        self.files = Folder(spark, self.path)
        self.buckets = self.current().buckets or buckets

    # -------------------------------------------------------------- reading
    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("published"))

    def _version(self, number: int) -> Version:
        raw = json.loads(self.files.text(f"published/{number:012d}.json"))
        raw["segments"] = {int(b): held for b, held in raw["segments"].items()}
        return Version(**raw)

    def current(self) -> Version:
        numbers = self._numbers()
        return self._version(numbers[-1]) if numbers else Version()

    def bucket(self) -> Column:
        """Bucket of a row; equal keys share it, a NULL key is a key like others."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> set[int]:
        """Buckets of the keys of some rows: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def read(self, buckets: Iterable[int] | None = None, version: Version | None = None) -> DataFrame:
        """All rows, or those of some buckets; other folders are not listed or opened."""
        version = version or self.current()
        asked = version.segments if buckets is None else set(buckets) & set(version.segments)
        return self._rows((s, b) for b in asked for s, _ in version.segments[b])

    def read_keys_of(self, rows: DataFrame) -> DataFrame:
        """The rows that may share a key with the given ones: those of their buckets."""
        return self.read(self.buckets_of(rows))

    def _rows(self, written: Iterable[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/data/{SEGMENT}={s}/{BUCKET}={b}" for s, b in sorted(written)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).select(*self.columns)

    # -------------------------------------------------------------- writing
    def _write(self, rows: DataFrame, segment: int) -> set[int]:
        """Write a segment; the buckets that got rows. Large buckets are dealt to several tasks."""
        placed = rows.select(*self.columns, self.bucket().alias(BUCKET))
        even = self.spark.sql(f"SELECT /*+ REBALANCE({BUCKET}) */ * FROM {{placed}}", placed=placed)
        folder = f"data/{SEGMENT}={segment}"
        even.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        prefix = f"{BUCKET}="
        return {int(n.removeprefix(prefix)) for n in self.files.names(folder) if n.startswith(prefix)}

    def _next_segment(self, version: Version) -> int:
        return max((s for s, _ in version.written()), default=version.number) + 1

    def _publish(self, old: Version, segments: dict[int, list[list[int]]], writer: str | None, batch: int | None) -> Version:
        batches = dict(old.batches) if writer is None else {**old.batches, writer: batch}
        new = Version(old.number + 1, self.buckets, batches, {b: held for b, held in segments.items() if held})
        if not self.files.put(f"published/{new.number:012d}.json", json.dumps(new.__dict__)):
            raise Conflict(f"version {new.number} of {self.path} was published by another writer")
        self._sweep(old, new)
        return new

    def _sweep(self, old: Version, new: Version) -> None:
        """Delete what neither this version nor the one before names."""
        for number in self._numbers():
            if number < old.number:
                self.files.delete(f"published/{number:012d}.json")
        named = old.written() | new.written()
        for folder in self.files.names("data"):
            segment = int(folder.removeprefix(f"{SEGMENT}="))
            held = {b for s, b in named if s == segment}
            if not held:
                self.files.delete(f"data/{folder}")
            elif segment <= max(s for s, _ in named):
                for name in self.files.names(f"data/{folder}"):
                    if name.startswith(f"{BUCKET}=") and int(name.removeprefix(f"{BUCKET}=")) not in held:
                        self.files.delete(f"data/{folder}/{name}")

    def seen(self, writer: str, batch: int) -> bool:
        """Whether a numbered batch of a writer is published already."""
        return self.current().batches.get(writer, -1) >= batch

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> Version:
        """Add rows. A batch that is published already changes nothing."""
        old = self.current()
        if writer is not None and old.batches.get(writer, -1) >= batch:
            return old
        segment = self._next_segment(old)
        segments = {b: list(held) for b, held in old.segments.items()}
        for b in self._write(rows, segment):
            segments.setdefault(b, []).append([segment, 0])
        level = 0
        while full := {b for b, held in segments.items() if sum(x == level for _, x in held) >= FAN}:
            parts = [(s, b) for b in full for s, x in segments[b] if x == level]
            joined = self._rows(parts)
            segment += 1
            kept = self._write(self.fold(joined) if self.fold else joined, segment)
            for b in full:
                rest = [x for x in segments[b] if x[1] != level]
                segments[b] = rest + [[segment, level + 1]] if b in kept else rest
            level += 1
        return self._publish(old, segments, writer, batch)

    def replace(self, gone: DataFrame, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> Version:
        """Drop all rows of the keys in ``gone`` (NULL equal to NULL) and add ``rows``, at once.

        Buckets without a key in either keep their segments untouched.
        """
        old = self.current()
        if writer is not None and old.batches.get(writer, -1) >= batch:
            return old
        touched = self.buckets_of(gone) | self.buckets_of(rows)
        merged = without(self.read(touched, old), gone, self.keys).unionByName(rows.select(*self.columns))
        segment = self._next_segment(old)
        kept = self._write(merged, segment)
        segments = {b: held for b, held in old.segments.items() if b not in touched}
        segments.update({b: [[segment, 0]] for b in kept})
        return self._publish(old, segments, writer, batch)


def without(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those of ``gone``; NULL equals NULL."""
    renamed = gone.select(*[F.col(k).alias(f"__g_{k}") for k in keys]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys])
    return existing.join(renamed, on, "left_anti")
