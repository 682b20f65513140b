"""Exact removal of repeated 100-byte strings with a logarithmic family of sparse suffix arrays.

A window is any LENGTH consecutive bytes of one text. Its anchor is the position of its least hashed
ANCHOR-byte string, so equal windows have equal anchors at equal places. Runs of consecutive windows
with one anchor partition all windows of a text; one entry stands for a run: the anchor's hash, the
hash of all bytes the run spans, the document and the place. Entries sorted by (anchor, span) are a
suffix array that keeps only the anchored suffixes, about one in thirty-five.

The family holds such arrays in levels. A new batch of documents gets its array and is merge-scanned
with all levels in one sorted pass: an entry equal to an earlier one is a repeat as a whole and
leaves; an anchor met with different spans goes to the exact comparison; the first entries of the
batch and of the levels of equal rank become the merged level of the next rank, so that n batches
keep log n levels. The exact comparison fetches the spans of those entries from the texts and looks
at each window's bytes.

Balance: the scan is dealt by range of (anchor, span), which splits anchors that very many documents
share, and each task first drops repeats within its own blocks, so that a text copied a million
times sends one entry a block. Entries of an anchor with more than HOT_ENTRIES different spans are
cut into single windows, dealt by window.

"Earlier" is by (doc_id, start), a null doc_id before all others. Defined cases: null text is empty;
texts shorter than a window keep all bytes. Rows that share a doc_id are compared by start alone, so
equal starts of such rows are both kept. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import table
from tallystone.session import materialize

LENGTH, ANCHOR = 100, 24
BLOCK_BYTES = 1 << 20
HOT_ENTRIES = 4_096
NO_ID = -(1 << 63)
# A place packs start (31 bits), number of windows (7 bits) and a mark of the text (25 bits).
WINDOW_BITS, MARK_BITS = 7, 25
ENTRY = "mh bigint, ch bigint, doc bigint, place bigint"
REMOVED, OPEN, LEVEL = 0, 1, 2


# Entries of texts


def pack_place(start, windows, mark):
    return (start << (WINDOW_BITS + MARK_BITS)) | (windows << MARK_BITS) | mark


def unpack_place(place):
    return place >> (WINDOW_BITS + MARK_BITS), (place >> MARK_BITS) & ((1 << WINDOW_BITS) - 1), place & ((1 << MARK_BITS) - 1)


def mark_of(text: bytes) -> int:
    """Tells rows with one doc_id but different texts apart."""
    return xxhash.xxh3_64_intdigest(text) & ((1 << MARK_BITS) - 1)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed hashes of all `size`-byte strings, `size` being a sum of powers of two."""
    base = 0x9E3779B97F4A7C15
    power = lambda e: np.uint64(pow(base, e, 1 << 64))
    block, width, total, covered = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while size:
        if size & 1:
            if total is None:
                total = block
            else:
                n = len(block) - covered
                total = total[:n] * power(width) + block[covered : covered + n]
            covered += width
        size >>= 1
        if size:
            n = len(block) - width
            block = block[:n] * power(width) + block[width : width + n]
            width *= 2
    total = total ^ (total >> np.uint64(31))
    total = total * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def least_in_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each `width` neighbours and its first position, by doubling."""
    place, size = np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        n = len(values) - step
        left = values[:n] <= values[step : step + n]
        place = np.where(left, place[:n], place[step : step + n])
        values = np.where(left, values[:n], values[step : step + n])
        size += step
    return values, place


def entries_of(blocks: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(mh, ch, doc, place) of blocks (doc, mark, offset of the block, its bytes)."""
    joined = b"".join(b[3] for b in blocks)
    sizes = np.array([len(b[3]) for b in blocks])
    counts = np.maximum(sizes - LENGTH + 1, 0)
    if not counts.sum():
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    begins = np.cumsum(sizes) - sizes
    least, place = least_in_windows(rolling(np.frombuffer(joined, dtype=np.uint8), ANCHOR), LENGTH - ANCHOR + 1)
    owner = np.repeat(np.arange(len(blocks)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    anchor = place[window]
    fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(fresh)
    windows = np.diff(np.append(first, len(window)))
    begin, who = window[first], owner[first]
    end = begin + windows + LENGTH - 1
    digest = xxhash.xxh3_64_intdigest
    ch = np.fromiter((digest(joined[a:b]) for a, b in zip(begin.tolist(), end.tolist())), dtype=np.uint64, count=len(begin))
    docs, marks, offsets = (np.array([b[i] for b in blocks], dtype=np.int64) for i in range(3))
    start = begin - begins[who] + offsets[who]
    return least[begin].view(np.int64), ch.view(np.int64), docs[who], pack_place(start, windows, marks[who])


def later_in_order(first_doc, first_place, doc, place):
    """Strictly later by (doc, start)."""
    shift = WINDOW_BITS + MARK_BITS
    return (doc > first_doc) | ((doc == first_doc) & ((place >> shift) > (first_place >> shift)))


def sorted_entries(mh, ch, doc, place) -> tuple[np.ndarray, ...]:
    order = np.lexsort((place, doc, ch, mh))
    return mh[order], ch[order], doc[order], place[order]


def blocks_of(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Texts in groups of about BLOCK_BYTES; longer texts in pieces that overlap by a window less one."""
    group, held = [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        mark = mark_of(text)
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK_BYTES):
            piece = text[at : at + BLOCK_BYTES + LENGTH - 1]
            group.append((doc, mark, at, piece))
            held += len(piece)
            if held >= BLOCK_BYTES:
                yield group
                group, held = [], 0
    if group:
        yield group


def _map_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blocks in blocks_of(batch):
            mh, ch, doc, place = sorted_entries(*entries_of(blocks))
            if not len(mh):
                continue
            fresh = np.concatenate(([True], (mh[1:] != mh[:-1]) | (ch[1:] != ch[:-1])))
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            repeat = later_in_order(doc[first], place[first], doc, place)
            # Repeats within the block need no scan: kind REMOVED; they are dealt by their own place.
            own = ((doc.view(np.uint64) ^ place.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield _rows(np.where(repeat, REMOVED, OPEN), np.where(repeat, own, mh), np.where(repeat, 0, ch), doc, place)


def _rows(kind, mh, ch, doc, place) -> pa.RecordBatch:
    kind = np.broadcast_to(kind, mh.shape)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (mh, ch, doc, place))],
        names=["kind", "mh", "ch", "doc", "place"],
    )


ROWS = f"kind int, {ENTRY}"


# Merge scan


def _scanner(keep_level: bool):
    """One pass over rows sorted by (mh, ch, doc, place).

    Input kinds: REMOVED passes through, OPEN belongs to the batch or to a level that will merge,
    LEVEL to a level that stays. State between Arrow batches is one row: the first entry of the
    last span. The first and the last anchor of a task may go on in its neighbours, so they count as
    having several spans; the exact comparison puts that right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (kind, mh, ch, doc, place) of the last span's first entry
        several = True  # whether the last anchor has several spans
        sent = False  # whether the held entry has been sent as OPEN
        for batch in batches:
            kind, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            known = kind == REMOVED
            if known.any():
                yield _rows(REMOVED, *(c[known] for c in cols))
                kind, cols = kind[~known], [c[~known] for c in cols]
            if not len(kind):
                continue
            carried = held is not None
            if carried:
                kind = np.concatenate(([held[0]], kind))
                cols = [np.concatenate(([h], c)) for h, c in zip(held[1:], cols)]
            mh, ch, doc, place = cols
            new_anchor = np.concatenate(([True], mh[1:] != mh[:-1]))
            new_span = new_anchor | np.concatenate(([True], ch[1:] != ch[:-1]))
            first = np.flatnonzero(new_span)[np.cumsum(new_span) - 1]
            repeat = later_in_order(doc[first], place[first], doc, place)
            group = np.cumsum(new_anchor) - 1
            many = np.bincount(group, new_span) > 1
            many[0] |= several
            several = bool(many[-1])
            fresh = ~repeat
            if carried:
                fresh[0] = False  # it went to its level when it came
            if repeat.any():
                yield _rows(REMOVED, mh[repeat], ch[repeat], doc[repeat], place[repeat])
            out = many[group] & ~repeat
            if carried and sent:
                out[0] = False
            if out.any():
                yield _rows(OPEN, mh[out], ch[out], doc[out], place[out])
            if keep_level:
                stay = fresh & (kind == OPEN)
                if stay.any():
                    yield _rows(LEVEL, mh[stay], ch[stay], doc[stay], place[stay])
            at = first[-1]
            sent = bool(many[-1])
            held = (kind[at], mh[at], ch[at], doc[at], place[at])
        if held is not None and not sent:
            yield _rows(OPEN, *(np.array([x]) for x in held[1:]))

    return run


@dataclass
class IndexFamily:
    """Levels of sorted entries; `removed` and `open` are what the scans have found."""

    levels: dict[int, DataFrame] = field(default_factory=dict)
    removed: list[DataFrame] = field(default_factory=list)
    open: DataFrame | None = None

    def add(self, texts: DataFrame, keep_level: bool = True) -> None:
        """Scan a batch (doc, text as bytes) with all levels; merge levels of equal rank.

        Without `keep_level` the batch is the last: its entries are not kept for later ones.
        """
        rank = 0
        while rank in self.levels:
            rank += 1
        rows = texts.mapInArrow(_map_entries, ROWS)
        for r, level in self.levels.items():
            rows = rows.union(level.select(F.lit(OPEN if r < rank else LEVEL).alias("kind"), "mh", "ch", "doc", "place"))
        dealt = rows.repartitionByRange("mh", "ch").sortWithinPartitions("mh", "ch", "doc", "place")
        found = materialize(dealt.mapInArrow(_scanner(keep_level), ROWS), "suffixes")
        self.removed.append(found.where(f"kind = {REMOVED}").select("doc", "place"))
        self.open = found.where(f"kind = {OPEN}").select("mh", "doc", "place")  # of all levels so far
        self.levels = {r: x for r, x in self.levels.items() if r > rank}
        self.levels[rank] = found.where(f"kind = {LEVEL}").select("mh", "ch", "doc", "place")


# Exact comparison


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs = [squeeze.compress(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["doc", "blob"])


def packed_texts(texts: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""
    return texts.mapInArrow(_pack_texts, "doc bigint, blob binary")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of open entries: rows (key, doc, place, span); hot anchors one window a row."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple[int, int, int, bytes]] = []
        seen: dict[bytes, tuple[int, int]] = {}
        known: list[tuple[int, int]] = []
        for doc, blob, entries in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = unpack.decompress(blob, max_output_size=0) if len(blob) else b""
            mark = mark_of(text)
            for e in entries:
                start, windows, of = unpack_place(e["place"])
                if of != mark:
                    continue
                if not e["hot"]:
                    out.append((e["mh"], doc, e["place"], text[start : start + windows + LENGTH - 1]))
                    continue
                for i in range(start, start + windows):
                    w = text[i : i + LENGTH]
                    if (first := seen.setdefault(w, (doc, i))) < (doc, i):
                        known.append((doc, pack_place(i, 1, mark)))
                    else:
                        seen[w] = (doc, i)
                        key = xxhash.xxh3_64_intdigest(w)
                        out.append((key - (1 << 64) if key >> 63 else key, doc, pack_place(i, 1, mark), w))
        # Repeats found here travel on without a span.
        out += [(place, doc, place, None) for doc, place in known]
        for at in range(0, len(out), 4096):
            columns = list(zip(*out[at : at + 4096]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["key", "doc", "place", "span"],
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows seen before, from rows sorted by (key, doc, place): rows (doc, place)."""
    last, seen = None, {}
    for batch in batches:
        docs: list[int] = []
        places: list[int] = []
        for key, doc, place, span in zip(*(c.to_pylist() for c in batch.columns)):
            if span is None:
                docs.append(doc)
                places.append(place)
                continue
            if key != last:
                last, seen = key, {}
            start, windows, mark = unpack_place(place)
            run = 0  # windows repeated up to here
            for i in range(windows):
                if seen.setdefault(span[i : i + LENGTH], (doc, start + i)) < (doc, start + i):
                    run += 1
                elif run:
                    docs.append(doc)
                    places.append(pack_place(start + i - run, run, mark))
                    run = 0
            if run:
                docs.append(doc)
                places.append(pack_place(start + windows - run, run, mark))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64())], names=["doc", "place"])


def compare_open(entries: DataFrame, texts: DataFrame, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """Removed places (doc, place) among open entries, by their windows' bytes."""
    counts = entries.groupBy("mh").agg(F.count("*").alias("n")).where(F.col("n") > hot_entries)
    flagged = entries.join(counts.select("mh", F.lit(True).alias("is_hot")), "mh", "left")
    item = F.struct("mh", "place", F.coalesce("is_hot", F.lit(False)).alias("hot")).alias("e")
    per_doc = flagged.select("doc", item).groupBy("doc").agg(F.collect_list("e").alias("entries"))
    fetched = packed_texts(texts).join(per_doc, "doc").select("doc", "blob", "entries")
    spans = fetched.mapInArrow(_fetch, "key bigint, doc bigint, place bigint, span binary")
    dealt = spans.repartition("key").sortWithinPartitions("key", "doc", "place")
    return dealt.mapInArrow(_compare, "doc bigint, place bigint")


# Results


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, blob, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = unpack.decompress(blob)
                kept, removed, spans = cut_text(text, places or ())
                row = (doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None)
                out.append(row)
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def cut_text(text: bytes, places) -> tuple[bytes, int, int]:
    """Remaining bytes, bytes removed, maximal removed runs."""
    if not len(places):
        return text, 0, 0
    start, windows, mark = unpack_place(np.array(places, dtype=np.int64))
    own = mark == mark_of(text)
    change = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(change, start[own], 1)
    np.add.at(change, (start + windows + LENGTH - 1)[own], -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum())
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, with_text: bool = False
) -> DataFrame:
    """One row a document: doc_id, counts, digest, and with `with_text` the remaining bytes.

    Documents go into the index family in `batches`, dealt by a hash of their ids.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    texts = docs.select(key.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    family = IndexFamily()
    for i in range(batches):
        family.add(texts.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == i), keep_level=i < batches - 1)
    found = materialize(compare_open(family.open, texts), "windows")
    removed = found
    for part in family.removed:
        removed = removed.union(part)
    per_doc = removed.groupBy("doc").agg(F.collect_list("place").alias("places"))
    joined = packed_texts(texts).join(per_doc, "doc", "left").select("doc", "blob", "places")
    out = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    cut = joined.mapInArrow(_cut(with_text), out)
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return cut.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS d, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT *, length(h) // 2 AS n FROM docs
), windows AS (
  SELECT rid, d, i, substr(h, 2 * i - 1, 200) AS w FROM (SELECT rid, d, h, unnest(range(1, n - 98)) AS i FROM sized WHERE n >= 100)
), firsts AS (
  SELECT w, min((d, i)) AS f FROM windows GROUP BY w HAVING count(*) > 1
), later AS (
  SELECT rid, i FROM windows JOIN firsts USING (w) WHERE (d, i) > f
), marked AS (
  SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later
), numbered AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked
), runs AS (
  SELECT rid, min(i) AS s, max(i) + 99 AS e FROM numbered GROUP BY rid, run
), edges AS (
  SELECT rid, s, e FROM runs UNION ALL SELECT rid, n + 1, n + 1 FROM sized
), kept AS (
  SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) + 1 AS a, s - 1 AS b FROM edges
), texts AS (
  SELECT k.rid, coalesce(string_agg(substr(h, 2 * a - 1, 2 * (b - a + 1)), '' ORDER BY a), '') AS t FROM kept k JOIN docs USING (rid) GROUP BY k.rid
), removed AS (
  SELECT rid, sum(e - s + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM sized JOIN texts USING (rid) LEFT JOIN removed USING (rid)
"""
