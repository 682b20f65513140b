"""Plain versions of the operators, one text at a time, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LEAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(rows, length=100):
    """op1 for rows (doc_id, text): list of results in the order of the rows."""
    first = {}
    texts = [((-1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for doc, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, (doc, i)), (doc, i))
    out = []
    for (d, _), (doc, b) in zip(rows, texts):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (doc, i):
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def quality(text):
    """op2's counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def leaks(text, items, size=10):
    """op3: n_words, n_hit, n_items, digest, contaminated; items are (item_id, text)."""
    words, hit, found = LEAK.findall(lower(text)), set(), set()
    for item, item_text in items:
        w = LEAK.findall(lower(item_text))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            window = w[i : i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add("null" if item is None else str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def fingerprint(text):
    words = SPACED.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def link(prints, tau=4):
    """Class number of each fingerprint."""
    names = list(range(len(prints)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= tau:
                a, b = root(i), root(j)
                names[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


RULES = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile("AKIA[A-Z0-9]+")),
    ("hex", re.compile("[0-9a-f]+")),
)


def secrets(text):
    """op6's base spans in order."""
    spans = []
    for k, (name, pattern) in enumerate(RULES):
        for m in pattern.finditer(text or ""):
            size = (len(m[2]) if k == 0 else len(m[0]))
            if size >= (8, 16, 32)[k]:
                spans.append((m.start(), k, m.end(), name))
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(spans)]


def line_drops(rows, least=10):
    """op11 for rows (doc_id, text): doc_id, number of lines, number dropped, digest of the rest."""
    space = " \t\n\x0b\x0c\r"
    number = lambda d: -(1 << 63) if d is None else d
    first, holders = {}, {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(space))
            if len(k) >= least:
                holders.setdefault(k, set()).add(number(d))
    first = {k: min(v) for k, v in holders.items()}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(lower(x.strip(space)), number(d)) == number(d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out
