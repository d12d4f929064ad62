"""SentencePiece encoding and decoding by the tokenizers library; the sentencepiece library is what parity is judged by."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import give_back, small_batches, table, worker_state

MARK = "▁"
#: Units that a worker keeps, and of those before them as many again.
CACHE_UNITS = 60_000
TEXTS_AT_ONCE = 100
JOINED_UNITS = 128
#: Units that are learnt at once.
LEARNT_UNITS = 32 * JOINED_UNITS
#: Kinds of pieces in the model's protobuf, fixed values.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def parse_model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def build_tokenizer(model):
    """A tokenizers pipeline of a parsed model: normaliser, space marker, unigram scores or BPE merges, byte fallback.

    Control pieces in a text are ordinary text, and decoding leaves their ids out."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = [(p.piece, p.score) for p in model.pieces]
    bytes_too = any(p.type == BYTE for p in model.pieces)
    if model.trainer_spec.model_type == 1:
        core = models.Unigram(pieces, unk_id=model.trainer_spec.unk_id, byte_fallback=bytes_too)
    else:
        vocab = {p: i for i, (p, _) in enumerate(pieces)}
        merges = []
        for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][1], i)):
            piece = pieces[i][0]
            if model.pieces[i].type == NORMAL and len(piece) > 1:
                cuts = [k for k in range(1, len(piece)) if piece[:k] in vocab and piece[k:] in vocab]
                merges += [(piece[:k], piece[k:]) for k in sorted(cuts, key=lambda k: vocab[piece[:k]])]
        core = models.BPE(vocab, merges, unk_token=pieces[model.trainer_spec.unk_id][0], fuse_unk=True, byte_fallback=bytes_too)
    out = Tokenizer(core)
    spec = model.normalizer_spec
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if model.trainer_spec.model_type == 1:  # names of bytes and controls are ordinary text: part them behind the first letter
        names = {p.piece for p in model.pieces if p.type not in (NORMAL, USER) and len(p.piece) > 1}
        after = "|".join(f"{re.escape(n[0])}(?={re.escape(n[1:])})" for n in sorted(names))
        if names:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(after), "merged_with_previous")
    unknown = decoders.Replace(pieces[model.trainer_spec.unk_id][0], model.trainer_spec.unk_surface)
    out.decoder = decoders.Sequence([unknown, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * spec.add_dummy_prefix])
    out.add_special_tokens([AddedToken(p.piece, special=True, normalized=False) for p in model.pieces if p.type == CONTROL])
    out.encode_special_tokens = True
    return out


class PieceCodec:
    """Encodes and decodes with the tokenizer rebuilt from one model file; the sentencepiece library only judges parity.

    A unit is a run of markers with the text up to the next marker. Where no piece goes on past such a border, or over a
    line end, a text's ids are its units' ids one after another; each new unit is encoded once, among
    others, and compared with the sentencepiece library. Models whose pieces do cross borders, or that change text
    otherwise than by the marker, are encoded and compared text by text.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        proto = parse_model(path)
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.normalizer_spec
        crossing = any(MARK in p.piece.lstrip(MARK) or ("\n" in p.piece and len(p.piece) > 1) for p in proto.pieces)
        self.by_unit = not crossing and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
        self.whole = build_tokenizer(proto)
        ids = lambda x: self.whole.encode(x, add_special_tokens=False).ids
        self.line_end = ids("x\n")[len(ids("x")):]
        self.by_unit = self.by_unit and len(self.line_end) == 1 and self.judge.encode("x\n")[-1:] == self.line_end
        self.split = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.prefix = spec.add_dummy_prefix
        self.sizes, self.starts, self.flat = self.piece_bytes(proto)

    def piece_bytes(self, proto) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each piece adds to a text, as the rebuilt decoder gives it behind another piece; byte pieces are their byte."""
        anchor = next((i for i, p in enumerate(proto.pieces) if p.type == NORMAL), 0)
        skip = len(self.whole.decode([anchor]))
        texts = self.whole.decode_batch([[anchor, i] for i in range(len(proto.pieces))], skip_special_tokens=True)
        table = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else t[skip:].encode() for p, t in zip(proto.pieces, texts)]
        sizes = np.array([len(x) for x in table])
        return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), np.uint8)

    def learn(self, units: list[str]) -> None:
        """Encode new units, many a text: a line end in front of each keeps them apart; and hold them against the other
        library's ids."""
        words = [u for u in units if u and u != "\n"]
        groups = [words[at:at + JOINED_UNITS] for at in range(0, len(words), JOINED_UNITS)]
        texts = ["\n" + "\n".join(g) for g in groups]
        ours = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        theirs = self.judge.encode(texts, num_threads=1)
        alike = self.decoded_alike([array("I", e.ids).tobytes() for e in ours])
        for group, mine, other, fine in zip(groups, ours, theirs, alike):
            got, want = self.apart(mine.ids), self.apart(other)
            if len(got) != len(group):  # a unit holds a line end's id otherwise
                got = [array("I", e.ids[e.ids.index(self.line_end[0]) + 1:]).tobytes() for e in self.whole.encode_batch_fast(["\n" + w for w in group], add_special_tokens=False)]
            self.cache.update(zip(group, got))
            if not fine:
                self.odd.update(w for w, same in zip(group, self.decoded_alike(got)) if not same)
            if got != want:
                self.odd.update(w for k, (w, own) in enumerate(zip(group, got)) if len(want) != len(group) or own != want[k])
        self.cache["\n"], self.cache[""] = array("I", self.line_end).tobytes(), b""

    def apart(self, ids: list[int]) -> list[bytes]:
        """The ids after each line end."""
        (end,) = self.line_end
        places = [k for k, x in enumerate(ids) if x == end]
        whole = array("I", ids).tobytes()
        return [whole[4 * (a + 1):4 * b] for a, b in zip(places, [*places[1:], len(ids)])]

    def units(self, text: str) -> list[str]:
        if "  " in text or MARK in text or text[:1] == " ":
            return self.split.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """Little-endian ids of each text, and whether both libraries agreed on all of it. Null counts as empty.

        Texts are taken a few at a time, so that what a batch holds besides its texts stays small."""
        ids: list[bytes] = []
        same: list[bool] = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            some = self._encode([t or "" for t in texts[at:at + TEXTS_AT_ONCE]])
            ids += some[0]
            same += some[1]
        return ids, same

    def _encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        if not self.by_unit:
            mine = self.whole.encode_batch_fast(texts, add_special_tokens=False)
            theirs = self.judge.encode(texts, num_threads=1)
            got = [array("I", m.ids).tobytes() for m in mine]
            return got, [m.ids == t and fine for m, t, fine in zip(mine, theirs, self.decoded_alike(got))]
        split = [self.units(t) if t else [] for t in texts]
        need = set().union(*split)
        new = need.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_UNITS:  # what came since the last time stays within reach, what came before goes
            self.older, self.cache = self.cache, {}
            self.odd.intersection_update(self.older)
            give_back()
            new = need
        seen = new.intersection(self.older)
        self.cache.update((u, self.older[u]) for u in seen)
        unknown = list(new - seen)
        for at in range(0, len(unknown), LEARNT_UNITS):
            self.learn(unknown[at:at + LEARNT_UNITS])
        known = self.cache.__getitem__
        return [b"".join(map(known, units)) for units in split], [not self.odd or self.odd.isdisjoint(units) for units in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of little-endian ids: what the rebuilt decoder gives for each piece, put together; ids whose bytes
        make up no text go through the decoder whole."""
        out: list[str] = []
        for at in range(0, len(ids), TEXTS_AT_ONCE):
            some = ids[at:at + TEXTS_AT_ONCE]
            pieces = np.frombuffer(b"".join(some), "<u4")
            sizes = self.sizes[pieces]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            raw = self.flat[np.repeat(self.starts[pieces] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
            cuts = ends[np.cumsum([0, *(len(x) // 4 for x in some)])].tolist()
            for own, a, b in zip(some, cuts, cuts[1:]):
                text = raw[a:b].decode(errors="replace")
                if "\ufffd" in text:
                    text = self.whole.decode(array("I", own).tolist(), skip_special_tokens=True)
                elif self.prefix and text[:1] == " ":
                    text = text[1:]
                out.append(text)
        return out

    def decoded_alike(self, ids: list[bytes]) -> list[bool]:
        """Whether putting pieces together gives what the rebuilt decoder gives for the whole."""
        whole = self.whole.decode_batch([array("I", x).tolist() for x in ids], skip_special_tokens=True)
        return [a == b for a, b in zip(self.decode(ids), whole)]


def codec(path: str) -> PieceCodec:
    """One codec a Python worker, kept between tasks. A task has one core; threads of the library's own would each keep memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_state(("pieces", path), lambda: PieceCodec(path))


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """docs with piece_ids (array of int, from the tokenizers library) and piece_parity (whether sentencepiece gives
    the same ids, and the rebuilt decoder's text of them is what decode gives).

    Null text counts as empty, an empty text has no ids. Repeated rows are encoded alike. Columns of docs by the new
    names are replaced. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("piece_ids", "piece_parity")
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, same = codec(model).encode(batch.column(at).to_pylist())
            edges = [0]
            for x in ids:
                edges.append(edges[-1] + len(x) // 4)
            flat = pa.Array.from_buffers(pa.int32(), edges[-1], [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(same)], [*batch.schema.names, "piece_ids", "piece_parity"])

    return docs.mapInArrow(task, T.StructType([
        *docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("piece_parity", T.BooleanType())]))


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """rows with piece_text, the text of the ids by the rebuilt decoder; a column by that name is replaced.

    Null ids give a null text, no ids an empty one; ids of control pieces add nothing. Repeated rows decode alike, an
    empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    rows = rows.drop("piece_text")
    at = rows.columns.index(ids_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at).to_pylist()
            texts = [None if x is None else t for x, t in zip(ids, codec(model).decode([array("I", x or ()).tobytes() for x in ids]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "piece_text"])

    return rows.mapInArrow(task, T.StructType([*rows.schema.fields, T.StructField("piece_text", T.StringType())]))


def digest_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip, parity: what encoding and decoding each text gives,
    without the ids leaving the task.

    Null text counts as empty: no pieces, an empty decoded text. Null ids and repeated rows come out as they are, one row
    a row; other columns are ignored; an empty table gives no rows. A text that holds the space marker itself decodes
    to spaces there, so it is no round trip.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip", "parity"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, same = codec(model).encode(texts)
            back = codec(model).decode(ids)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([(t or "") == b for t, b in zip(texts, back)]), pa.array(same)], names)

    return slim.mapInArrow(task, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
