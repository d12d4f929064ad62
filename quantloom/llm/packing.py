"""Pack documents into training sequences: binary-length pieces, equal lengths together, no sequence across documents.

A document of n tokens is cut into whole sequences of the greatest length and, for the rest, one piece for each binary digit
of what is left, longest first. Every piece is a power of two long and a sequence of its own, so nothing is padded and
attention never crosses documents. Sequences of a length stand together: a batch takes as many of them as fill its budget
of tokens.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, small_batches, table, worker_state
from quantloom.llm.token_store import byte_alphabet

MAX_LENGTH = 2048
END_ID = 1
CACHE_STRETCHES = 700_000
#: Tokens of an Arrow batch of pieces.
BATCH_TOKENS = 1 << 20
#: The parts of a tokenizer's file under which a text may be cut before white space, and the split that they stand for.
SPLIT_BY_SPACE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: What is or may be white space to the library or to Python.
WHITE = r"\s\x1c-\x1f\x85\u180e\u200b\ufeff"
#: Where a text may be cut.
CUT = re.compile(f"(?=[ \n][^{WHITE}])")
#: Stretches of characters whose kinds the library and Python agree on.
LATIN = re.compile(" ?[!-~\xa1-\xac\xae-\u024e]+")


class Stretches(dict):
    """The ids of stretches of text, each with `lead` before it, found when they are first asked for."""

    def __init__(self, lead: str, find: Callable[[str], bytes]) -> None:
        super().__init__()
        self.lead, self.find = lead, find

    def __missing__(self, stretch: str) -> bytes:
        self[stretch] = ids = self.find(self.lead + stretch)
        return ids


class ByteEncoder:
    """Encodes whole texts with a byte-level BPE tokenizers file and remembers the ids of stretches between white space.

    The last white-space character before a visible one always starts a word of the file's split or is a word, and no word
    goes beyond it. So a text may be cut before each such blank or line feed, and its ids are those of the stretches one
    after another; a line feed is a word, so the line after it starts anew. A stretch of Latin letters, digits and marks
    goes through the file's split and the library's BPE model, any other through the library as it stands. Texts with a
    special token in them, before which white space is split as at a text's end, are encoded whole, as are all texts where
    a file normalises or splits otherwise.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_alphabet()
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_space = (spec["normalizer"] is None and spec["pre_tokenizer"] == SPLIT_BY_SPACE and spec["truncation"] is None and spec["padding"] is None
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]))
        self.words, self.starts, self.spaced = Stretches("", self.word), Stretches("", self.stretch), Stretches(" ", self.stretch)
        self.feed = self.stretch("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def stretch(self, text: str) -> bytes:
        if not LATIN.fullmatch(text):
            return self.whole(text)
        if text.lstrip(" ").isalpha():
            return self.words[text]
        return b"".join(map(self.words.__getitem__, SPLIT.findall(text)))

    def __call__(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        if not self.by_space or any(t in text for t in self.special):
            return self.whole(text)
        for known in (self.words, self.starts, self.spaced):
            if len(known) > CACHE_STRETCHES:
                known.clear()
        flat = text.replace("\n", " ")
        if not flat.isprintable() or "  " in flat or flat.startswith(" ") or flat.endswith(" "):
            return b"".join(map(self.starts.__getitem__, CUT.split(text)))
        starts, spaced, out = self.starts, self.spaced.__getitem__, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out += [self.feed, starts[first], *map(spaced, rest)]
        return b"".join(out[1:])


def pieces_of(tokens: int, most: int) -> list[int]:
    """The lengths of a document's pieces: whole sequences, then the binary digits of the rest, longest first."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, most: int = MAX_LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, start, length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset: the pieces.

    `most`, the greatest length, is a power of two. Each piece is a sequence: its offset is 0 and its length a power of two.
    Sequences are numbered from 0 without gaps, longest first, in the order in which the table is read; so those of a
    length are a stretch of numbers, and a reader that keeps a length to a batch needs no padding.

    Texts are encoded where they are read and their ids written once; nothing is shuffled but counts, a row a partition and
    length, which is also what is broadcast. Null text counts as empty: a document of the end id alone. Null ids, repeated
    ids and repeated rows are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the greatest length is a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    names = ["part", "at", "doc_id", "start", "length", "doc_tokens", "ids"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            encode = worker_state(("bytes", tokenizer), lambda: ByteEncoder(tokenizer))
            rows, data, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end_id.to_bytes(4, "little")
                tokens, start = len(ids) // 4, 0
                for length in pieces_of(tokens, most):
                    at = counts.get(length, 0)
                    counts[length] = at + 1
                    rows.append((part, at, doc_id, start, length, tokens))
                    data.append(ids[4 * start:4 * (start + length)])
                    start += length
                    held += length
                    if held >= BATCH_TOKENS:
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(data, pa.binary())], names)
                        rows, data, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(data, pa.binary())], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "part long, at long, doc_id long, start long, length long, doc_tokens long, ids binary"
    made = materialize(slim.mapInArrow(task, kinds), "packed-pieces")
    counts = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))  # a row a length, a dozen
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("__base"))
    placed = made.join(F.broadcast(firsts.join(F.broadcast(bases), "length")), ["length", "part"])
    return placed.select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("__base") + F.col("__first") + F.col("at")).alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
