"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits, each the majority over the hashes of a text's word shingles. Two
fingerprints link when at most TAU bits differ. The bits are dealt into m parts, correlated bits
together, and part i gets a threshold t_i >= -1 with sum(t_i) = TAU - m + 1: if every part differed
in more than t_i bits, more than TAU bits would differ. So each link shows in some part at distance
t_i or less. Dynamic programming picks the thresholds, and the number of parts, of least estimated
cost: probes sent plus candidates met, the latter from the distances within a bounded sample. Any
choice finds every link; the estimate only decides how fast.

A part of threshold t sends a fingerprint under its own value and under every value up to t bits
away. Rows with equal values meet, are verified on all 64 bits, and leave a spanning forest of the
links found, never all pairs. Groups of more than GROUP_ROWS rows are cut into blocks, and pairs of
blocks become tasks of their own. Equal fingerprints are one row before all this.

Defined cases: null and empty texts have fingerprint zero and link like any other. Repeated rows
and equal texts share a component. Null ids never name a component unless it has no other id. An
empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import add_from_text, free_name, table
from tallystone.llm.components import components
from tallystone.session import materialize

TAU, BITS = 4, 64
SHINGLE, SEED = 4, 42
SAMPLE_ROWS = 2_000
GROUP_ROWS = 4_096
SMALL_GROUP = 16


# Fingerprints


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, dtype=np.int64), len(last)
    bounds = list(zip(starts[:total].tolist(), last.tolist()))
    for at in range(0, total, 8192):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in bounds[at : at + 8192]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist()))


def with_fingerprint(docs: DataFrame, text_col: str = "text", size: int = SHINGLE) -> tuple[DataFrame, str]:
    """Documents with a struct holding `fp`, the fingerprint as a signed long; and that column's name."""
    name = free_name(docs, "simhash")

    def maker():
        return lambda texts: [{"fp": x - (1 << 64) if (x := fingerprint(t, size)) >> 63 else x} for t in texts]

    return add_from_text(docs, text_col, name, "fp bigint", maker), name


# Parts and thresholds


def deal_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, strongly correlated bits together."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        link = np.abs(np.nan_to_num(np.corrcoef(bits, rowvar=False))) if len(sample) > 1 else np.eye(BITS)
    np.fill_diagonal(link, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: (link[b, sorted(free)].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (link[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def close_share(sample: np.ndarray, group: list[int]) -> list[float]:
    """Estimated share of pairs within 0..TAU bits in a part, never below that of random bits."""
    mask = np.uint64(sum(1 << b for b in group))
    values = sample & mask
    seen = np.zeros(BITS + 1)
    for i in range(len(values) - 1):
        seen += np.bincount(np.bitwise_count(values[i + 1 :] ^ values[i]), minlength=BITS + 1)
    measured = np.cumsum(seen) / max(1.0, seen.sum())
    w = len(group)
    random = np.cumsum([math.comb(w, k) / 2**w for k in range(TAU + 1)])
    return [max(float(measured[t]), float(random[t])) for t in range(TAU + 1)]


def allocate(sample: np.ndarray, rows: int, probe_cost: float = 4.0) -> list[tuple[list[int], int]]:
    """Groups of bits with thresholds of least estimated cost for `rows` fingerprints.

    A probe costs a shuffled row, a candidate one comparison.
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, TAU + 2):
        groups = deal_bits(sample, parts)
        costs = []
        for g in groups:
            share, w = close_share(sample, g), len(g)
            probes = [sum(math.comb(w, j) for j in range(t + 1)) for t in range(TAU + 1)]
            costs.append([0.0] + [rows * (probe_cost * probes[t] + rows * share[t] / 2) for t in range(TAU + 1)])
        # least[s] is the least cost of the parts so far with thresholds that sum to s - parts so far.
        least = {0: (0.0, [])}
        for cost in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in least.items():
                for up in range(TAU + 2):
                    if cost[up] + c < nxt.get(used + up, (math.inf,))[0]:
                        nxt[used + up] = (cost[up] + c, [*ts, up - 1])
            least = nxt
        total, thresholds = least[TAU + 1]
        if best is None or total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return best[1]


# Candidates and verification


def probe_rows(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (key, fp, own): a fingerprint under its own part values and those nearby."""
    rows = fps.select("fp", F.lit(0).alias("part"), F.lit(0).cast("long").alias("value"), F.lit(True).alias("own")).limit(0)
    for part, (group, t) in enumerate(plan):
        flips = [sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(group, k)]
        mask = F.lit(_signed(sum(1 << b for b in group)))
        array = F.from_json(F.lit("[" + ",".join(str(_signed(f)) for f in flips) + "]"), "array<bigint>")
        exploded = fps.select("fp", F.explode(array).alias("flip"))
        rows = rows.union(
            exploded.select(
                "fp", F.lit(part), F.col("fp").bitwiseAND(mask).bitwiseXOR(F.col("flip")), F.col("flip") == 0
            )
        )
    return rows.select(F.xxhash64("part", "value").alias("key"), "fp", "own")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Keeps links that join two trees and drops the rest."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[x] = y
            self.kept.append((a, b))


def link_group(fp: np.ndarray, own: np.ndarray, forest: Forest) -> None:
    """Spanning forest of one group: visit, link to what is near and not yet visited, go on."""
    waiting = np.arange(len(fp))
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            u = queue.pop()
            near = (np.bitwise_count(fp[waiting] ^ fp[u]) <= TAU) & (own[waiting] | own[u])
            found = waiting[near]
            waiting = waiting[~near]
            for v in found.tolist():
                forest.add(int(fp[u]), int(fp[v]))
                queue.append(v)


def link_sorted(key: np.ndarray, fp: np.ndarray, own: np.ndarray, forest: Forest) -> None:
    """Links of whole groups that lie side by side; small groups all at once, others one by one."""
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(edges)
    small = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    left = np.flatnonzero(small)
    for step in range(1, SMALL_GROUP):
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        a, b = fp[left], fp[left + step]
        good = (own[left] | own[left + step]) & (np.bitwise_count(a ^ b) <= TAU) & (a != b)
        for x, y in zip(a[good].tolist(), b[good].tolist()):
            forest.add(x, y)
    for i in np.flatnonzero(sizes > SMALL_GROUP).tolist():
        link_group(fp[edges[i] : edges[i + 1]], own[edges[i] : edges[i + 1]], forest)


def _linker(group_rows: int):
    """Links within runs of equal key; runs of more than `group_rows` rows are passed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        held_rows, passing = 0, None

        def out(keys, a, b, own) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(own, pa.bool_())],
                names=["key", "a", "b", "own"],
            )

        def links(parts) -> pa.RecordBatch:
            forest = Forest()
            key, fp, own = (np.concatenate(x) for x in zip(*parts))
            link_sorted(key, fp, own, forest)
            pairs = np.array(forest.kept, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return out([None] * len(pairs), pairs[:, 0], pairs[:, 1], [None] * len(pairs))

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            own = batch.column(2).to_numpy(zero_copy_only=False)
            while len(key):
                if passing is not None:
                    stop = int(np.searchsorted(key != passing, True)) if (key != passing).any() else len(key)
                    if stop:
                        yield out(key[:stop], fp[:stop].view(np.int64), [None] * stop, own[:stop])
                        key, fp, own = key[stop:], fp[stop:], own[stop:]
                    if len(key):
                        passing = None
                    continue
                held.append((key, fp, own))
                key, fp, own = (np.concatenate(x) for x in zip(*held))
                held = []
                # The last run may go on in the next batch.
                cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
                big = _big_runs(key[:cut], group_rows)
                if len(big):
                    yield out(key[:cut][big], fp[:cut][big].view(np.int64), [None] * len(big), own[:cut][big])
                    rest = np.setdiff1d(np.arange(cut), big, assume_unique=True)
                else:
                    rest = slice(0, cut)
                if cut and len(key[:cut][rest]):
                    yield links([(key[:cut][rest], fp[:cut][rest], own[:cut][rest])])
                tail = (key[cut:].copy(), fp[cut:].copy(), own[cut:].copy())
                if len(tail[0]) > group_rows:
                    passing = tail[0][0]
                    yield out(tail[0], tail[1].view(np.int64), [None] * len(tail[0]), tail[2])
                else:
                    held = [tail]
                break
        if held and len(held[0][0]):
            yield links(held)

    return run


def _big_runs(key: np.ndarray, limit: int) -> np.ndarray:
    if not len(key):
        return np.zeros(0, dtype=np.int64)
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(edges)
    return np.flatnonzero(np.repeat(sizes > limit, sizes))


LINKS = "key bigint, a bigint, b bigint, own boolean"


def find_links(fps: DataFrame, plan: list[tuple[list[int], int]], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep every connection of the links."""
    rows = probe_rows(fps, plan)
    met = rows.repartition("key").sortWithinPartitions("key")
    first = materialize(met.mapInArrow(_linker(group_rows), LINKS), "links")
    small = first.where("key is null").select("a", "b")
    # Groups too large for one task: blocks of half that size, each pair of blocks a group of its own.
    big = first.where("key is not null").select("key", F.col("a").alias("fp"), "own")
    counts = big.groupBy("key").agg(F.count("*").alias("n"))
    blocks = big.join(counts, "key").withColumn("blocks", F.ceil(F.col("n") / F.lit(group_rows / 4)))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp", "own"
    )
    rest = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(1 << 60), LINKS)
    return small.union(rest.select("a", "b"))


def fingerprint_components(docs_fp: DataFrame, with_root: bool = False) -> DataFrame:
    """Rows (fp, component_id), or (fp, root), for a stored table of doc_id and fp.

    A root is the least fingerprint of a component, a component_id its smallest doc_id.
    """
    per_fp = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    fps = materialize(per_fp, "fingerprints")
    sample = fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).toPandas()["fp"].to_numpy(dtype=np.int64)
    plan = allocate(sample.view(np.uint64), max(1, fps.count()))
    roots = components(find_links(fps.select("fp"), plan))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    if with_root:
        return rooted.select("fp", "root")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(names, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each document."""
    made, name = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", size)
    docs_fp = materialize(made.select("doc_id", F.col(f"{name}.fp").alias("fp")), "simhash")
    return docs_fp.join(fingerprint_components(docs_fp), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Documents with all their columns, one of each component: that of the smallest id.

    Rows equal in id and text are one document. A component of null ids alone keeps one of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    made, name = with_fingerprint(narrow, "text", size)
    marks = [F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("text_hash")]
    docs_fp = materialize(made.select("doc_id", F.col(f"{name}.fp").alias("fp"), *marks), "simhash")
    named = docs_fp.join(fingerprint_components(docs_fp, with_root=True), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "id_hash")
    least = named.groupBy("root").agg(F.min(order).alias("x"))
    hashes = [free_name(docs, "text_hash"), free_name(docs, "id_hash")]
    stay = least.select(F.col("x.text_hash").alias(hashes[0]), F.col("x.id_hash").alias(hashes[1]))
    hashed = docs.withColumns({hashes[0]: F.xxhash64(text), hashes[1]: F.xxhash64(id_col)})
    return hashed.join(stay, hashes, "left_semi").dropDuplicates(hashes).drop(*hashes)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
