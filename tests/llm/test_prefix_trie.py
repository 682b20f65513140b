"""The prefix trie against a plain one, on awkward rows and in tiny shards."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallystone.llm import prefix_trie
from tallystone.llm.queries import QUERIES
from tests.llm.data import write


def plain(rows):
    """op13 for rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(first, [])[:h] + turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def turns(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 130), *range(205, 230), -7, -100, -150, 1000]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "𝒳é"])))
    rows += [(300 + i, t, "user", "x" * t) for i in range(40) for t in range(6)]  # copies
    rows += [(400, None, None, None), (400, 1, None, "late"), (400, None, "user", "early"), (400, 1, None, "late")]
    rows += [(None, 1, "user", "nobody's"), (401, 5, "user", ""), (402, 1, "user", None), (402, 1, "system", "tie")]
    rows += [(500, t, "user", "long" * (t % 3)) for t in range(700)]  # deeper than the range keys
    rows += [(501, t, "user", "long" * (t % 3)) for t in range(650)] + [(501, 651, "user", "other")]
    rows += [(600, 1, "user", "w " * 2_500_000)]
    return rows


@pytest.mark.parametrize("shard_turns,piece", [(prefix_trie.SHARD_TURNS, prefix_trie.PIECE), (12, 3)])
def test_op13_matches_brute_force(spark, tmp_path, shard_turns, piece, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = turns()
    folder = write(spark, str(tmp_path), turns=rows, extra=True)
    got = Counter(tuple(r) for r in QUERIES["op13_conversation_prefix_trie"](spark, folder).collect())
    assert got == plain(rows)


def test_shards_agree_with_the_whole(spark):
    """Nodes of two halves of a sorted set of lists add up to those of the whole."""
    rng = np.random.default_rng(2)
    lists = sorted({tuple(rng.integers(1, 4, rng.integers(0, 6)).tolist()) for _ in range(200)})

    def shard(part, before, after):
        flat = np.array([(t, 0, t) for x in part for t in x], prefix_trie.TURN).tobytes()
        n = len(part)
        return prefix_trie.nodes_of_shard([len(x) for x in part], flat, list(range(n)), [1] * n, ["e"] * n, before, after)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    def totals(*got):
        out = Counter()
        for g in got:
            for row in zip(g["key"], g["depth"], g["n_convs"], g["n_children"], g["n_leaves"], g["saved_tokens"]):
                for name, value in zip(("n", "c", "l", "s"), row[2:]):
                    out[bytes(row[0]), int(row[1]), name] += int(value)
        return out

    whole = shard(lists, -1, -1)
    assert not any(whole["shared"])
    for cut in range(1, len(lists)):
        same = common(lists[cut - 1], lists[cut])
        halves = shard(lists[:cut], -1, same), shard(lists[cut:], same, -1)
        assert totals(*halves) == totals(whole)
        assert sum(halves[0]["shared"]) == sum(halves[1]["shared"]) == same + 1


def test_double_array_keeps_children_apart():
    rng = np.random.default_rng(3)
    lists = [tuple(rng.integers(1, 50, rng.integers(1, 9)).tolist()) for _ in range(3000)]
    sizes = np.array([len(x) for x in lists])
    flat = np.array([c for x in lists for c in x])
    array = prefix_trie.DoubleArray(flat, np.cumsum(sizes) - sizes, sizes, 49)
    seen = {}
    for x in lists:
        slot = np.zeros(1, np.int64)
        for d, c in enumerate(x):
            slot = array.step(slot, np.array([c]))
            assert seen.setdefault(int(slot[0]), x[: d + 1]) == x[: d + 1]
    assert len(seen) == len({x[:d] for x in lists for d in range(1, len(x) + 1)})
    with pytest.raises(ValueError):
        array.step(np.zeros(1, np.int64), np.array([77]))
