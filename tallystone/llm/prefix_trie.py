"""The trie of conversation prefixes, from double arrays of prefix shards.

Conversations are rebuilt first (see `rebuild`): in each hundred of ids the first turns come from the
hundred's first conversation. A turn is the 128-bit hash of (role, text), with the text's length; a
conversation is the list of its turns. Equal conversations are one list with a number of members.

The lists are range-partitioned and sorted, so that every prefix is one stretch of the order and a
list comes right before its extensions. Stretches of about SHARD_TURNS turns are the prefix shards.
In a shard turns get dense ids; BASE and CHECK are packed level by level, the children of a node at
the first free slots that fit all of them; then all lists traverse the arrays together, and counts,
least ids and sums gather at the slots. BASE may be negative, as slots are not offset by the ids.

Shards share only upper nodes: the common prefix of one shard's last list and the next one's first.
The lengths of these common prefixes, one number a shard, are found before the arrays are built. A
node belongs to the first shard that has it, and a list has no child if the next shard's first list
doesn't extend it; so the sums of a node over the shards are those of the whole trie, subtrees
included, and merging is one grouping of the shared nodes by key. All other nodes are final where
they are made.

Members' ids are sorted over all tasks by (list, id) and joined in pieces of PIECE ids, so a list of
very many members is hashed from few rows. The exchange of lists works on their first RANGE_TURNS
turns: lists that share more than those meet in one task, in shards of bounded size.

Defined cases: rows without conv_id are left out. Null role or text is empty. Rows of equal turn
stand by role and text; repeated rows are turns of their own. Null turns come first. Without
conversations there is no root. Other columns are not read. Long texts are read once for their hash;
a conversation's turns take 24 bytes each in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.llm.common import crc32_of_id, table
from tallystone.session import materialize

GROUP, MOST_SHARED = 100, 6
SHARD_TURNS, RANGE_TURNS, PIECE = 200_000, 64, 1_024
TURN = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("tokens", "<i8")])
ROOT_KEY = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


# Rebuilt conversations


def turn_lists(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turns), the turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("h2"),
        F.char_length("text").cast("long").alias("tokens"),
    )
    placed = F.sort_array(F.collect_list(F.struct("place", "h1", "h2", "tokens")))
    return rows.groupBy("conv_id").agg(placed.alias("placed")).select(
        "conv_id", F.transform("placed", lambda x: F.struct(x["h1"], x["h2"], x["tokens"])).alias("turns")
    )


def rebuild(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, k1, k2): the first h turns of the hundred's first conversation, then the own ones.

    h is the checksum of the id modulo MOST_SHARED; k1, k2 hash the whole list.
    """
    own = materialize(turn_lists(turns), "turn_lists")
    heads = own.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, MOST_SHARED - 1).alias("head")
    )
    h = (crc32_of_id("conv_id") % MOST_SHARED).cast("int")
    keyed = own.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first_id"), h.alias("h"))
    both = keyed.join(heads, "first_id", "left")
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    lists = both.select("conv_id", F.concat(F.coalesce(F.slice("head", 1, F.col("h")), none), rest).alias("turns"))
    return lists.select("conv_id", "turns", F.xxhash64("turns").alias("k1"), F.xxhash64(F.lit("second"), "turns").alias("k2"))


# Members


def member_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by (list, id) to joined pieces of at most PIECE ids."""

    def piece(key, ids):
        return (*key, ids[0], len(ids), ",".join(map(str, ids)))

    key, ids, out = None, [], []
    names = ("k1", "k2", "low", "n", "joined")
    for batch in batches:
        for k1, k2, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if ids and ((k1, k2) != key or len(ids) == PIECE):
                out.append(piece(key, ids))
                ids = []
            key = (k1, k2)
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
            out = []
    if ids:
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*[piece(key, ids)])))))


def member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (list, least id) to one row a list."""
    names = ("k1", "k2", "low", "n", "ends")
    held, digest, out = None, None, []
    for batch in batches:
        for k1, k2, low, n, joined in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held is not None and held[:2] == [k1, k2]:
                digest.update(b"," + joined.encode())
                held[3] += n
            else:
                if held is not None:
                    out.append((*held, digest.hexdigest()))
                held, digest = [k1, k2, low, n], hashlib.sha256(joined.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
            out = []
    if held is not None:
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*[(*held, digest.hexdigest())])))))


def distinct_lists(lists: DataFrame) -> DataFrame:
    """One row a distinct list: (turns, low, n, ends), its least member, their number and digest."""
    ids = lists.select("k1", "k2", "conv_id")
    ids = ids.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = ids.mapInArrow(member_pieces, "k1 bigint, k2 bigint, low bigint, n bigint, joined string")
    pieces = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "low")
    members = pieces.mapInArrow(member_digests, "k1 bigint, k2 bigint, low bigint, n bigint, ends string").drop("k1", "k2")
    return members.join(lists.select(F.col("conv_id").alias("low"), "turns"), "low")


# Shards


def shards(distinct: DataFrame) -> DataFrame:
    """Stored rows of consecutive lists, numbered in order, with the common prefixes at their borders."""
    key = F.slice("turns", 1, RANGE_TURNS)
    placed = distinct.select("turns", "low", "n", "ends").repartitionByRange(key).sortWithinPartitions("turns")
    names = ("part", "at", "first", "last", "sizes", "flat", "low", "n", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        sizes, flat, others, held = [], [], ([], [], []), 0

        def row():
            joined = np.concatenate(flat)
            one = lambda x: [t.tobytes() for t in x]
            first, last = one(joined[: sizes[0]]), one(joined[len(joined) - sizes[-1] :])
            values = [part, at, first, last, sizes, joined.tobytes(), *others]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=list(names))

        for batch in batches:
            column = batch.column(0)
            lengths = np.asarray(column.value_lengths()).astype(np.int64)
            struct = column.flatten()
            turns = np.empty(len(struct), TURN)
            for i, name in enumerate(TURN.names):
                turns[name] = np.asarray(struct.field(i))
            ends = np.cumsum(lengths)
            for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
                if sizes and held + b - a > SHARD_TURNS:
                    yield row()
                    at, sizes, flat, others, held = at + 1, [], [], ([], [], []), 0
                sizes.append(b - a)
                flat.append(turns[a:b])
                held += b - a
                for have, c in zip(others, (1, 2, 3)):
                    have.append(batch.column(c)[i].as_py())
        if sizes:
            yield row()

    binaries = pa.list_(pa.binary())
    kinds = [pa.int64(), pa.int64(), binaries, binaries, pa.list_(pa.int64()), pa.binary()] + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.string())]
    schema = (
        "part bigint, at bigint, first array<binary>, last array<binary>, sizes array<bigint>, flat binary, "
        "low array<bigint>, n array<bigint>, ends array<string>"
    )
    stored = materialize(placed.mapInArrow(run, schema), "prefix_shards")
    # Numbers of shards of each task: two numbers a task.
    counts = sorted(tuple(r) for r in stored.groupBy("part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    numbers = stored.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    numbered = stored.join(F.broadcast(numbers), "part").withColumn("no", F.col("before") + F.col("at"))
    borders = numbered.select("no", "first").join(numbered.select((F.col("no") + 1).alias("no"), "last"), "no")
    same = F.zip_with("first", "last", lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = borders.select("no", (F.array_position(same, False) - 1).alias("common"))
    after = common.select((F.col("no") - 1).alias("no"), F.col("common").alias("with_next"))
    return numbered.join(common.withColumnRenamed("common", "with_previous"), "no", "left").join(after, "no", "left")


# Double arrays


class DoubleArray:
    """BASE and CHECK of a set of lists of ids from 1; the child of slot s by id c is slot BASE[s] + c."""

    def __init__(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: int):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.ids, self.first_free = ids, 1
        by_size = np.argsort(-sizes, kind="stable")
        state = np.zeros(len(sizes), np.int64)
        for depth in range(int(sizes.max(initial=0))):
            by_size = by_size[: np.searchsorted(-sizes[by_size], -depth, "left")]
            codes = flat[begins[by_size] + depth]
            pairs, back = np.unique(state[by_size] * (ids + 1) + codes, return_inverse=True)
            parents, children = pairs // (ids + 1), pairs % (ids + 1)
            slots = np.empty(len(pairs), np.int64)
            cuts = np.flatnonzero(np.diff(parents, prepend=-1))
            counts = np.diff(np.append(cuts, len(parents)))
            for cut, n in zip(cuts[counts > 1].tolist(), counts[counts > 1].tolist()):
                slots[cut : cut + n] = self._place(children[cut : cut + n])
                self.check[slots[cut : cut + n]] = parents[cut]
            alone = cuts[counts == 1]
            slots[alone] = self._free(len(alone))
            self.check[slots[alone]] = parents[alone]
            self.base[parents] = slots - children
            state[by_size] = slots[back]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        found = np.flatnonzero(self.check[self.first_free :] < 0) + self.first_free
        if len(found) < n:
            self._grow(len(self.check) + n)
            found = np.flatnonzero(self.check[self.first_free :] < 0) + self.first_free
        if n:
            self.first_free = int(found[n - 1]) + 1 if len(found) == n else int(found[n])
        return found[:n]

    def _place(self, codes: np.ndarray) -> np.ndarray:
        """The first slots at which all codes of a node find room."""
        away = codes - codes[0]
        start, step = self.first_free, 256
        while True:
            self._grow(start + step + int(away[-1]) + 1)
            fits = np.arange(start, start + step)
            for a in away:
                fits = fits[self.check[fits + a] < 0]
                if not len(fits):
                    break
            if len(fits):
                return fits[0] + away
            start += step

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of slots; all must exist."""
        children = self.base[slots] + codes
        if not np.array_equal(self.check[children], slots):
            raise ValueError("no such child")
        return children


NODE = (
    "key binary, parent_key binary, depth bigint, low bigint, parent_low bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends string, shared boolean, parent_shared boolean"
)


def nodes_of_shard(sizes, flat, low, n, ends, with_previous: int, with_next: int) -> dict[str, list]:
    """Columns of NODE; -1 as common prefix: no such neighbour."""
    turns = np.frombuffer(flat, TURN)
    sizes, weights, low = (np.array(x, np.int64) for x in (sizes, n, low))
    begins = np.cumsum(sizes) - sizes
    known, codes = np.unique(turns.view("V24"), return_inverse=True)
    codes = codes.reshape(-1).astype(np.int64) + 1
    array = DoubleArray(codes, begins, sizes, len(known))
    slots = len(array.check)
    count, least = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    depth, tokens, end_of = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
    keys: dict[int, bytes] = {0: ROOT_KEY}
    state, active, levels = np.zeros(len(sizes), np.int64), np.argsort(-sizes, kind="stable"), []
    sharing = np.zeros(slots, bool)
    at = 0
    while len(active):
        at_slots = state[active]
        np.add.at(count, at_slots, weights[active])
        np.minimum.at(least, at_slots, low[active])
        here = np.unique(at_slots)
        depth[here] = at
        levels.append(here)
        sharing[state[0]] |= sizes[0] >= at <= with_previous
        sharing[state[-1]] |= sizes[-1] >= at <= with_next
        ended = active[sizes[active] == at]
        end_of[state[ended]] = ended
        active = active[sizes[active] > at]
        places = begins[active] + at
        state[active] = array.step(state[active], codes[places])
        new, where = np.unique(state[active], return_index=True)
        tokens[new] = turns["tokens"][places[where]]
        for slot, place in zip(new.tolist(), places[where].tolist()):
            keys[slot] = xxhash.xxh3_128_digest(keys[int(array.check[slot])] + turns[place].tobytes())
        at += 1
    # Upper nodes that the previous shard has are its own: they are not counted again here.
    owned = np.ones(slots, bool)
    path, code_path = 0, codes[: sizes[0]]
    for d in range(min(with_previous, int(sizes[0])) + 1):
        owned[path] = False
        if d < sizes[0]:
            path = int(array.base[path] + code_path[d])
    children = np.zeros(slots, np.int64)
    for here in levels[1:]:
        np.add.at(children, array.check[here], owned[here])
    has_child = np.zeros(slots, bool)
    for here in levels[1:]:
        has_child[array.check[here]] = True
    if with_next == sizes[-1]:
        has_child[state[-1]] = True
    nodes = np.concatenate(levels)
    leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    leaves[nodes] = ~has_child[nodes]
    saved[nodes] = (count[nodes] - owned[nodes]) * tokens[nodes]
    for here in levels[:0:-1]:
        np.add.at(leaves, array.check[here], leaves[here])
        np.add.at(saved, array.check[here], saved[here])
    parents = array.check[nodes]
    root = nodes == 0
    return {
        "key": [keys[s] for s in nodes.tolist()],
        "parent_key": [None if r else keys[s] for s, r in zip(parents.tolist(), root.tolist())],
        "depth": depth[nodes],
        "low": least[nodes],
        "parent_low": [None if r else x for x, r in zip(least[parents].tolist(), root.tolist())],
        "n_convs": count[nodes],
        "n_children": children[nodes],
        "n_leaves": leaves[nodes],
        "saved_tokens": saved[nodes],
        "ends": [None if e < 0 else ends[e] for e in end_of[nodes].tolist()],
        "shared": sharing[nodes],
        "parent_shared": sharing[parents] & ~root,
    }


def shard_nodes(numbered: DataFrame) -> DataFrame:
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.bool_(), pa.bool_()]
    names = [f.split()[0] for f in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                got = nodes_of_shard(*(batch.column(c)[row].as_py() for c in range(7)))
                made = pa.RecordBatch.from_arrays([pa.array(got[c], k) for c, k in zip(names, kinds)], names=names)
                for start in range(0, made.num_rows, 8192):
                    yield made.slice(start, 8192)

    none = F.lit(-1).cast("bigint")
    columns = ["sizes", "flat", "low", "n", "ends"]
    borders = [F.coalesce(c, none).cast("bigint").alias(c) for c in ("with_previous", "with_next")]
    return numbered.select(*columns, *borders).mapInArrow(run, NODE)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations."""
    lists = materialize(rebuild(turns), "rebuilt")
    nodes = materialize(shard_nodes(shards(distinct_lists(lists))), "trie_nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = materialize(
        nodes.where("shared").groupBy("key").agg(
            F.min("low").alias("low"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
            F.max("ends").alias("ends"), *sums,
        ),
        "upper_nodes",
    )
    above = merged.select(F.col("key").alias("parent_key"), F.col("low").alias("upper_low"))
    figures = ["depth", "low", "parent_low", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    final = nodes.where(~F.col("shared") & ~F.col("parent_shared")).select(*figures)
    under = nodes.where(~F.col("shared") & F.col("parent_shared")).drop("parent_low")
    upper = merged.join(above, "parent_key", "left")
    joined = under.join(above, "parent_key").unionByName(upper, allowMissingColumns=True)
    out = final.unionByName(joined.withColumnRenamed("upper_low", "parent_low").select(*figures))
    return out.select(
        F.col("low").alias("conv_id"),
        "depth",
        F.col("parent_low").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), checked AS (
  SELECT *, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                  lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(list_slice(f.turns, 1, o.h), []), coalesce(list_slice(o.turns, o.h + 1, len(o.turns)), [])) AS turns
  FROM checked o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE list_slice(turns, 1, d) END AS p, d = len(turns) AS ended
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(p[d].text) END) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
), above AS MATERIALIZED (
  SELECT *, CASE WHEN d <= 1 THEN [] ELSE list_slice(p, 1, d - 1) END AS parent FROM nodes
), children AS (
  SELECT parent AS p, count(*) AS n_children FROM above WHERE d > 0 GROUP BY parent
), counted AS MATERIALIZED (
  SELECT above.*, coalesce(n_children, 0) AS n_children FROM above LEFT JOIN children USING (p)
), subtrees AS (
  SELECT CASE WHEN k = 0 THEN [] ELSE list_slice(p, 1, k) END AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.d::BIGINT AS depth, u.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
       c.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s USING (p) LEFT JOIN nodes u ON c.d > 0 AND u.p = c.parent
"""
