"""Packing: concatenate and cut, with global offsets from two passes of prefix sums.

Pass one tokenizes each document once and stores its ids with the position inside its task's
output. The totals of the tasks, one row each, give every task's first global position. Pass two
cuts at multiples of the sequence length: a document that crosses a boundary leaves one piece in
each sequence it touches. Every sequence but the last is full, so padding is less than one sequence
for the whole table.

Defined cases: a null or empty text is its end id alone. Repeated rows and tied ids are packed row
by row. An empty table gives no pieces. Other columns are left out.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallystone.llm.common import table
from tallystone.session import materialize

LENGTH = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
# Characters of words kept with their ids in a worker; the table starts afresh when full.
MEMO_CHARS = 8_000_000
# Characters of texts whose words are looked up together.
CHUNK_CHARS = 6_000_000
# A letter, then marks up to the end of the word: tokens end between them.
CLOSING = r"(\pL)([!-/:-@\[-`{-~]+)( |$)"


class Encoder:
    """Ids of whole texts as bytes, 16 bits each.

    No token crosses a blank or a line break, nor runs from letters into a closing mark, and letters
    count without case, so the ids of words are kept and put together. Texts are split into words by
    the chunk; a word is looked up once a chunk, and its ids are copied to all its places at once.
    """

    def __init__(self, path: str, memo_chars: int = MEMO_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits; this vocabulary has more than 65,536")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 << 16, dtype=bool)
        self.ends_word[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.memo_chars, self.held = memo_chars, 0

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without the end id."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for i, ids in zip(owners, self.words(parts)):
                out[i].append(ids)
            parts.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            plain = (text or "").lower() if (text or "").isascii() else text
            if any(s in plain for s in self.special):  # special tokens count before letters lose their case
                out[i].append(self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            for part in cut_at_blanks(plain.replace("\n", " "), CHUNK_CHARS):
                parts.append(part)
                owners.append(i)
                size += len(part)
                if size >= CHUNK_CHARS:
                    flush()
        if parts:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def words(self, parts: list[str]) -> list[bytes]:
        """Ids of texts whose words stand between blanks."""
        if self.held > self.memo_chars:
            self.memo, self.held = {}, 0
        split = pc.split_pattern(pc.replace_substring_regex(pa.array(parts, pa.large_string()), CLOSING, r"\1 \2\3"), " ")
        coded = pc.dictionary_encode(split.flatten())
        known = coded.dictionary.to_pylist()
        self.learn([w for w in known if w not in self.memo])
        ids = [self.memo[w] for w in known]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        starts = np.cumsum(lengths) - lengths
        at = np.asarray(coded.indices)
        sizes = lengths[at]
        ends = np.cumsum(sizes)
        # Place in the joined ids of known words: the word's start, then one further each time.
        places = np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        whole = np.frombuffer(b"".join(ids), "<u2")[places].tobytes()
        borders = 2 * np.concatenate([[0], ends])[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return [whole[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]

    def learn(self, fresh: list[str]) -> None:
        self.held += sum(map(len, fresh))
        self.learn_letters([w for w in fresh if w.isalpha()])
        self.learn_each([w for w in fresh if not w.isalpha()])

    def learn_letters(self, words: list[str]) -> None:
        """Many words in one call; each ends with the only token of it that ends a word."""
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u2")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(some):
                self.learn_each(some)
                continue
            whole, stops = ids.tobytes(), (2 * stops).tolist()
            self.memo.update(zip(some, map(whole.__getitem__, map(slice, [0, *stops[:-1]], stops))))

    def learn_each(self, words: list[str]) -> None:
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            for word, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.memo[word] = self.packed(coded.ids)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return array("H", ids).tobytes()


def cut_at_blanks(text: str, most: int) -> Iterator[str]:
    """Parts of about `most` characters, cut at blanks, which are left out; a longer word stays whole."""
    start = 0
    while len(text) - start > most:
        stop = text.find(" ", start + most)
        if stop < 0:
            break
        yield text[start:stop]
        start = stop + 1
    yield text[start:]


ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, with what it knows from earlier tasks."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def tokenize(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None
) -> DataFrame:
    """One row a document: id, task, position in the task's output, 16-bit ids with the end id."""
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        part, seen = TaskContext.get().partitionId(), 0
        end = encoder.packed([END_ID])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                ids = [x + end for x in encoder.batch(rows.column(1).to_pylist())]
                sizes = [len(x) // 2 for x in ids]
                starts = seen + np.cumsum([0, *sizes[:-1]])
                seen += sum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([part] * rows.num_rows, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "part", "part_start", "doc_tokens", "ids"],
                )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, part bigint, part_start bigint, doc_tokens bigint, ids binary"
    return narrow.mapInArrow(run, schema)


def with_global_start(tokens: DataFrame) -> DataFrame:
    """Add each document's first global position; `tokens` must be a stored table."""
    totals = tokens.groupBy("part").agg(F.max(F.col("part_start") + F.col("doc_tokens")).alias("total"))
    # One row of 16 bytes for each task of pass one: the bound of the ordered sum and the broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(bases), "part").withColumn("global_start", F.col("base") + F.col("part_start"))


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens, from documents with global positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out: dict[str, list] = {k: [] for k in COLUMNS}
            for doc, first, total, stored in zip(rows["doc_id"], rows["global_start"], rows["doc_tokens"], rows["ids"]):
                ids = np.frombuffer(stored, dtype="<u2").astype("<u4")
                start = 0
                while start < total:
                    sequence, offset = divmod(first + start, length)
                    size = min(total - start, length - offset)
                    crc = zlib.crc32(ids[start : start + size].tobytes())
                    for k, v in zip(COLUMNS, (doc, start, size, crc, total, sequence, offset)):
                        out[k].append(v)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], batch.schema.field("doc_id").type)]
                + [pa.array(out[k], pa.int64()) for k in COLUMNS[1:]],
                names=list(COLUMNS),
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    narrow = tokens.select("doc_id", "global_start", "doc_tokens", "ids")
    return narrow.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in COLUMNS[1:]))


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Tokenize once into a stored table, number the tokens, cut."""
    tokens = materialize(tokenize(docs, id_col, text_col), "tokens")
    return cut(with_global_start(tokens), length)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
