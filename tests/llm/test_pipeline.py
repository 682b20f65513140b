"""The pipeline against a plain version built from the plain operators."""

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.data import DOC_SCHEMA, documents, write

LEAK = "one two three four five six seven eight nine ten"


def plain_run(docs, items):
    """Rows (doc_id, text) after all stages but packing; no host here has frequent lines."""
    rows = [r for r in docs if not brute.quality(r[1])[5]]
    classes = brute.link([brute.fingerprint(r[1]) for r in rows])
    best = {}
    for r, c in zip(rows, classes):
        if c not in best or (r[0] is None, r[0] or 0) < (best[c][0] is None, best[c][0] or 0):
            best[c] = r
    rows = [r for r in best.values() if not brute.leaks(r[1], items)[4]]
    out = []
    for r in rows:
        text, cut = r[1], len(r[1])
        spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in brute.secrets(text)))
        for a, b in reversed(spans):
            text = text[:a] + "[SECRET]" + text[b:] if b <= cut else text
            cut = a
        out.append((r[0], text))
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_matches_plain_stages(spark, tmp_path, extra):
    docs = documents() + [
        (40, " ".join(f"w{i} v{i}" for i in range(60)) + " " + LEAK, "en", "h0", 1),
        (41, " ".join(f"q{i} z{i}" for i in range(60)) + " token = abcdefgh12345 end", "en", "h0", 1),
    ]
    items = [(0, LEAK + " eleven")]
    folder = write(spark, str(tmp_path), docs, benchmark=items, extra=extra)
    kept = plain_run(docs, items)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in kept)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == want
    assert sum(r["length"] for r in pieces) == sum(n for _, n in want.elements())
    assert 40 not in {d for d, _ in want} and 41 in {d for d, _ in want}


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    folder = write(spark, str(tmp_path), [])
    docs = spark.createDataFrame([], DOC_SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
