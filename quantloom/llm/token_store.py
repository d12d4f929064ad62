"""Token ids in binary files: one zstandard frame a document, a seek table at the end, a checksum for each frame.

A file follows the public zstandard seekable layout. First come the documents' frames, each the ids as little-endian
unsigned 32-bit integers; then a skippable frame with the documents' ids and token counts; last a skippable frame with
the seek table: compressed size, plain size and checksum of each frame, and the footer. A reader takes the table from
the end and decompresses only the frames it wants.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import fresh_path, materialize, small_batches, table, worker_state

SEEK_MAGIC, FOOTER_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
NO_ID = -(1 << 63)
END_ID = 2
CACHE_WORDS = 1_000_000
#: Visible characters of the Latin blocks, for which the library's normal form and Python's agree.
LATIN = re.compile("[!-~\xa1-\xac\xae-\u024e]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normal form and the split that words may be taken through one by one, as a tokenizer's file has them.
NORMAL_FORM = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes whole texts with a tokenizers file that drops white space, word by word, and remembers words.

    ASCII white space never joins with what stands beside it, so a text's ids are its words' ids one after another.
    Words of Latin letters go to the library's BPE model after the file's own normal form and split; any other word,
    and every word with a special token's opening, goes through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pattern = self.tokenizer.model, regex.compile(SPLIT)
        self.letters = byte_alphabet()
        self.cache: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        self.simple = spec["normalizer"] == NORMAL_FORM and spec["pre_tokenizer"] == WORD_SPLIT

    def piece(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        got = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(self.pieces) >= CACHE_WORDS:
            self.pieces.clear()
        self.pieces[word] = got
        return got

    def learn(self, words: list[bytes]) -> None:
        whole, cache, piece, known = [], self.cache, self.piece, self.pieces.get
        for word in words:
            text = word.decode()
            if self.simple and LATIN.fullmatch(text) and b"<|" not in word:
                text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
                if text.isalpha():
                    cache[word] = known(text) or piece(text)
                    continue
                if "\u0307" not in text:
                    cache[word] = b"".join([known(x) or piece(x) for x in self.pattern.findall(text)])
                    continue
            whole.append(word)
        for word, got in zip(whole, self.tokenizer.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)):
            cache[word] = array("I", got.ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode() for t in texts]
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]
        need = set().union(*split)
        new = need.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = need
        if new:
            self.learn(list(new))
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, kept between tasks."""
    return worker_state(("words", path), lambda: WordEncoder(path))


class FrameWriter:
    def __init__(self, stream, level: int = 1) -> None:
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries, self.ids, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.stream.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // 4)

    def close(self) -> None:
        index = np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes()
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        rows = b"".join(struct.pack("<III", *e) for e in [*self.entries, (len(index) + 8, 0, 0)])
        footer = struct.pack("<IBI", len(self.entries) + 1, 0x80, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(rows) + len(footer)) + rows + footer)
        self.stream.close()


class FrameReader:
    """Random access to one file; read(k) decompresses frame k alone and checks it."""

    def __init__(self, stream) -> None:
        self.stream, end = stream, stream.size()
        count, flags, magic = struct.unpack("<IBI", self.at(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        rows = np.frombuffer(self.at(end - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.sizes, self.sums = rows[:-1, 1], rows[:-1, 2]
        self.starts = np.concatenate([[0], np.cumsum(rows[:, 0])])
        index = self.at(int(self.starts[-2]) + 8, 16 * (count - 1))
        self.doc_ids, self.counts = np.frombuffer(index, "<i8", count - 1), np.frombuffer(index, "<i8", count - 1, 8 * (count - 1))

    def at(self, start: int, size: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(size)

    def read(self, k: int) -> bytes:
        frame = self.at(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))
        ids = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.sizes[k]))
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return ids


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs into files under folder in ascending order of the id, and return the manifest, a row a file:
    file_no, path, n_docs, n_tokens, first_token.

    Rows are dealt by ranges of (id, hash of the text), so an id that many rows share is split too; each partition is
    one file, streamed document by document. Each attempt of a task writes a file by a name of its own, and the manifest
    names those of the attempts that count, so nothing is moved or overwritten. Null text counts as empty, null ids come
    first and are stored as the least 64-bit integer. Rows that share an id are all stored. An empty table gives no
    files. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "tokens")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = slim.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = pafs.FileSystem.from_uri(folder)
        writer = None
        for batch in batches:
            if batch.num_rows and writer is None:
                store.create_dir(root, recursive=True)
                name = f"tokens-{part:06d}-{attempt}.zst"
                writer = FrameWriter(store.open_output_stream(f"{root}/{name}", compression=None))  # else the name decides
            ids = encoder(tokenizer)(batch.column(1).to_pylist())
            for doc_id, got in zip(batch.column(0).to_pylist(), ids):
                writer.add(doc_id, got + struct.pack("<I", end_id))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "file_no": pa.array([part], pa.int64()), "path": [f"{folder}/{name}"],
                "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([sum(writer.counts)], pa.int64())})

    made = materialize(dealt.mapInArrow(task, "file_no long, path string, n_docs long, n_tokens long"), "token-manifest")
    return made.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(
        Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, want: Callable[[int], bool] | None = None, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 (and ids, as bytes) from the files of a manifest.

    want, given a document's id, says which frames to decompress; without it all are read.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64()] * 4 + [pa.binary()] * with_ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = pafs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as stream:
                    reader, rows = FrameReader(stream), []
                    starts = row["first_token"] + np.concatenate([[0], np.cumsum(reader.counts)])
                    for k, doc_id in enumerate(reader.doc_ids.tolist()):
                        known = None if doc_id == NO_ID else doc_id
                        if want is None or want(known):
                            ids = reader.read(k)
                            rows.append((known, int(starts[k]), len(ids) // 4, zlib.crc32(ids), *[ids] * with_ids))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = manifest.select("path", "first_token")
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(width).mapInArrow(
        task, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))
