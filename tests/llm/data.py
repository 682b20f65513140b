"""Small tables with awkward rows, written as a folder the queries can read."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in is on by it or be at as an we us he do so no go me my up if".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def documents(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    shared = sentence(rng, 40)
    long_text = sentence(rng, 12_000)
    base = [sentence(rng, 70) for _ in range(12)]
    rows = [(i, t, "en", f"h{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [
        (20, base[0], "en", "h0", 1),  # exact copy
        (21, base[1].replace(base[1].split()[5], "changed", 1), None, "h1", None),  # near copy
        (22, base[2] + "\n" + shared, "en", "h2", 1),
        (23, shared + "\n" + base[3], "en", None, 1),
        (24, "", "en", "h0", 0),
        (25, None, None, None, None),
        (26, "   \n\t ", "en", "h0", 6),
        (27, "é ñ ß 漢字 𝒳 x", "fr", "h1", 9),
        (28, long_text, "en", "h1", len(long_text)),
        (29, "aba " * 400, "en", "h1", 1600),
        (30, base[4], "en", "h1", 1),
        (30, base[4], "en", "h1", 1),  # repeated row
        (31, base[5], "en", "h1", 1),
        (31, base[6] + " tail", "en", "h1", 1),  # one id, two texts
        (None, base[7], "en", "h2", 1),  # no id
        (32, "a b c", "en", "h1", 5),
    ]
    return rows


LABELS = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None), (999, 1, 0), (4, 0, 1)]
BENCHMARK = [
    (0, "one two three four five six seven eight nine ten eleven"),
    (1, "short item"),
    (1, "short item"),
    (2, None),
    (3, ""),
    (None, "nameless words here"),
    (4, "One, TWO three; four five six seven eight nine TEN"),
]


def write(
    spark, folder: str, docs=None, labels=LABELS, benchmark=BENCHMARK, pages=(), embeddings=(), turns=(), extra: bool = False
) -> str:
    def save(name, rows, schema):
        df = spark.createDataFrame(list(rows), schema)
        if extra:  # names that operators use themselves
            for c in ("words", "fp", "key", "ch", "mh", "leaks", "simhash", "quality", "vector", "features", "host"):
                if c not in df.columns:
                    df = df.selectExpr("*", f"'x' as {c}")
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    save("documents", documents() if docs is None else docs, DOC_SCHEMA)
    save("labels", labels, "doc_id long, quality int, toxic int")
    save("benchmark", benchmark, "item_id long, text string")
    save("embeddings", embeddings, "vec_id long, embedding array<float>, label int")
    save("conversations", turns, "conv_id long, turn long, role string, text string")
    save("pages", pages, "page_id long, url string, html string")
    return folder
