"""Whitening, packing and phrases against plain versions, and their defined results for odd rows."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quantloom.llm import packing, phrases, whitening
from tests.conftest import SMALL

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# ---- whitening ----------------------------------------------------------------------------------------------------
def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, width int")


def plain_whitening(rows, wanted):
    """By eigenvectors of the whole covariance, of each length of vectors: (id, n, deviation) and whitened rows, explained."""
    out = {}
    for width in {len(v) for _, v in rows}:
        own = [(i, v) for i, v in rows if len(v) == width]
        x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in own]
        n, sums = len(x), [sum(c) for c in zip(*x)]
        apart = [[n * a - s for a, s in zip(row, sums)] for row in x]
        y = np.array(apart, np.float64) / n
        values, turn = np.linalg.eigh(y.T @ y / n)
        values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
        keep = values > 1e-9 * max(values[0], 1e-300)
        whitened = y @ turn[:, keep] / np.sqrt(values[keep])
        out[width] = ([i for i, _ in own], n, [sum(a * a for a in row) for row in apart], whitened, values[keep] / np.trace(y.T @ y / n))
    return out


def check_whitening(got, plain, wanted):
    for ids, n, deviation, whitened, explained in plain.values():
        if not whitened.size:
            continue
        rows = got[got.n == n].sort_values(["vec_id", "component"])
        count = whitened.shape[1]
        assert rows.component.tolist() == list(range(1, count + 1)) * len(ids)
        order = np.argsort(ids, kind="stable")
        assert rows.vec_id.tolist() == np.repeat(np.array(ids)[order], count).tolist()
        assert rows.deviation.tolist() == np.repeat(np.array(deviation)[order], count).tolist()
        mine, other = rows.whitened.to_numpy().reshape(-1, count), whitened[order]
        assert np.abs(mine * np.sign((mine * other).sum(axis=0)) - other).max() < 1e-6
        assert np.allclose(rows.explained.to_numpy().reshape(-1, count)[0], explained, rtol=1e-9)
        assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-8


def test_whitening_query(spark):
    got = whitening.op11_whitening(spark, SMALL).toPandas()
    rows = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    rows = [(i, v) for i, v in zip(rows.vec_id, rows.embedding) if v is not None and np.isfinite(np.array(v, float)).all()]
    check_whitening(got, plain_whitening(rows, 32), 32)


@pytest.mark.parametrize("size, width, wanted", [(400, 6, 4), (300, 60, 5), (30, 40, 32)])
def test_whitening_of_spectra(spark, size, width, wanted):
    """Steep and flat spectra, fewer rows than components, repeated rows, a vector that a third of all rows share."""
    draw = np.random.default_rng(width)
    scale = np.concatenate([[40.0, 40.0], 20.0 * 0.8 ** np.arange(width - 2)])
    made = (draw.standard_normal((size, width)) * scale).astype(np.float32)
    made[: size // 3] = made[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(made)] + [(size + 5, [1.0]), (size + 6, [2.5]), (size + 7, [3.0])]
    got = whitening.whiten(vectors_of(spark, rows), wanted).toPandas()
    plain = plain_whitening(rows, wanted)
    own = got[got.n == size]
    check = plain[width]
    count = min(wanted, check[3].shape[1])
    assert own.component.max() == count and len(own) == size * count
    assert np.allclose(own[own.vec_id == 0].sort_values("component").explained, check[4][:count], rtol=1e-7)
    assert own.identity_error.iloc[0] < 1e-8
    w = own.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(size, -1)
    assert np.allclose(w.T @ w / size, np.eye(count), atol=1e-8) and np.allclose(w.mean(axis=0), 0, atol=1e-8)
    # each direction spans what the plain one of its value does: equal values may turn within their plane
    for low, high in ((0, 2), (2, 3)):
        a, b = w[:, low:high], check[3][:, low:high]
        assert np.allclose(np.linalg.svd(a.T @ b / size)[1], 1, atol=1e-5)
    assert len(got[got.n == 3]) == 3  # the vectors of one component


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (None, [3.0, -1.0]), (3, [0.5, 0.25]), (3, [0.5, 0.25]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [])]
    got = whitening.whiten(vectors_of(spark, rows)).toPandas()
    assert len(got) == 8 and set(got.n) == {4} and got.vec_id.isna().sum() == 2
    same = whitening.whiten(vectors_of(spark, [(1, [2.0, 2.0]), (2, [2.0, 2.0])]))
    assert same.count() == 0 and whitening.whiten(vectors_of(spark, [(1, [2.0, 2.0])])).count() == 0
    empty = whitening.whiten(vectors_of(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 1.0]), (2, [1.0, 1.0]), (3, [-3e38, 2.0])])).toPandas().sort_values("vec_id")
    assert huge.deviation.isna().tolist() == [True, False, True] and np.isfinite(huge.whitened).all()


def test_missed_component_is_found(monkeypatch):
    """A block that starts without the greatest direction gets it from the vectors that certify the result."""
    values = np.array([50.0, 40.0, 30.0, 5.0, 4.0, 3.0, 2.0, 1.0])

    class Blind:
        def __init__(self):
            self.calls, self.real = 0, np.random.default_rng(1)

        def standard_normal(self, shape):
            out, self.calls = self.real.standard_normal(shape), self.calls + 1
            if self.calls == 1:
                out[0] = 0.0
            return out

    blind = Blind()
    monkeypatch.setattr(whitening.np.random, "default_rng", lambda seed: blind)
    found, vectors = whitening.components(lambda q: values[:, None] * q, 8, 2, guard=2)
    assert np.allclose(found, [50.0, 40.0]) and np.allclose(np.abs(vectors[[0, 1], [0, 1]]), 1.0)


# ---- packing --------------------------------------------------------------------------------------------------------
ODD = [None, "", " ", "a", "\n\n x", "a  b   c", "<|endoftext|> in <|endoftext|>text", "it's 12's 'll", "tab\there\r\nnew", "é ß x​z \u0085", "zero\0byte \0", "日本 語 テスト",
       "word " * 5000, "x" * 3000, "end ", "\nlead", "a\nb\n\nc", "ﬁ ² ½ ª1"]


def test_byte_encoder_equals_the_library():
    encode, rnd = packing.ByteEncoder(BYTES), random.Random(2)
    assert encode.by_space
    letters = ["a", "B", " ", " ", "\n", "  ", "\t", "é", "'s", "12", "...", "<|endoftext|>", "　", "\x1c", "ok", "\0"]
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    for text in texts * 2:
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rows = [(i if i != 3 else None, t, "x", 1, 2) for i, t in enumerate(ODD)] + [(5, ODD[5], "y", 1, 2), (5, ODD[5], "y", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, at int, length int")
    got = [r.asDict() for r in packing.pack(docs, BYTES, most=64).collect()]
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] for r in got)
    # numbers without gaps, longest first
    assert [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])] == sorted((r["length"] for r in got), reverse=True)
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    whole = Counter()
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        whole[i, struct.pack(f"<{len(ids)}I", *ids)] += 1
    pieces = defaultdict(lambda: defaultdict(list))
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]][r["start"]].append(r["ids"])
    found = Counter()
    for (i, tokens), by_start in pieces.items():
        copies = {len(x) for x in by_start.values()}
        assert len(copies) == 1 and sum(len(x[0]) for x in by_start.values()) == 4 * tokens * 1
        found[i, b"".join(by_start[s][0] for s in sorted(by_start))] += copies.pop()
    assert found == whole
    assert packing.pack(docs.limit(0), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BYTES, most=100)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    want = []
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    for i, text in zip(docs.doc_id, docs.text):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        start = 0
        for length in packing.pieces_of(len(ids), 2048):
            piece = ids[start:start + length]
            want.append((i, start, length, zlib.crc32(struct.pack(f"<{length}I", *piece)), len(ids), 0))
            start += length
        assert start == len(ids)
    got = packing.op12_packing(spark, SMALL)
    assert sorted(tuple(r) for r in got.drop("sequence_id").collect()) == sorted(want)
    assert got.select("sequence_id").distinct().count() == len(want)


# ---- phrases --------------------------------------------------------------------------------------------------------
def against_sql(spark, rows, **kinds):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, code long, id int, words string")
    got = sorted(tuple(r) for r in phrases.mine(docs, **kinds).collect())
    con = duckdb.connect()
    frame = pd.DataFrame([(r[1], r[2]) for r in rows], columns=["text", "lang"], dtype="string")  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT text::VARCHAR AS text, lang::VARCHAR AS lang FROM frame")
    return got, sorted(con.sql(phrases.OP13_SQL).fetchall())


def text_of(rnd, n):
    words = ["the", "The", "new", "york", "city", "of", "é", "É", "x", "ab c", "\x00z", "q" * 50]
    weights = [9, 2, 6, 5, 4, 6, 1, 1, 1, 1, 1, 1]
    joints = [" ", " ", " ", "  ", "\t", ". ", "\n", ";", "\r", "\x1c", " "]
    return "".join(rnd.choices(words, weights)[0] + rnd.choices(joints, [20, 20, 20, 1, 1, 2, 1, 1, 1, 1, 1])[0] for _ in range(n))


@pytest.mark.parametrize("most", [500_000, 7])
def test_phrases(spark, most):
    """Against the SQL, with one trie and with many; odd characters, repeated rows, null and unknown languages."""
    rnd = random.Random(9)
    rows = [(i, text_of(rnd, rnd.randint(1, 200)), rnd.choice(["en", "de", None, "und", "e:n"]), 1, 2, "x") for i in range(120)]
    rows += [rows[0]] * 3 + [(None, None, "en", 1, 2, "x"), (7, "", "fr", 1, 2, "x"), (8, "word " * 20_000, "en", 1, 2, "x"), (9, "a b c d", None, 1, 2, None)]
    got, want = against_sql(spark, rows, most=most)
    assert len(got) > 50 and got == want


def test_phrases_of_little(spark):
    for rows in ([], [(1, None, "en", 1, 2, "x")], [(1, "a b c", "en", 1, 2, "x")], [(1, ". , ;", None, 1, 2, "x")], [(1, "solo. " * 40, None, 1, 2, "x")]):
        got, want = against_sql(spark, rows)
        assert got == want == []


def test_scores_are_exact(spark):
    """Counts whose products pass 64 bits."""
    a, l, r = 9_000_000_000_000_000_003, 9_100_000_000_000_000_001, 9_050_000_000_000_000_007
    counted = spark.createDataFrame([(0, "en", ["x", "y"], [1, 2], a), (1, "en", ["x"], [1], l), (2, "en", ["y"], [2], r)], "id long, lang string, words array<string>, codes array<long>, a long")
    totals = spark.createDataFrame([("en", l)], "lang string, n long")
    row = phrases.ranked(counted, totals, 10, 80).collect()[0]
    assert row["score"] == 2_000_000 * a // (l + r) and (row["a"], row["l"], row["r"]) == (a, l, r)


def test_equal_codes_are_dealt_anew(spark, monkeypatch):
    """Two frequent words of one code would be one word: the next seed tells them apart."""
    real = phrases.encode

    def clumsy(texts, seed):
        out = real(texts, seed)
        return out if seed else out.withColumn("code", F.when(F.col("word").isin("a", "b"), F.lit(5).cast("long")).otherwise(F.col("code")))

    seeds = []
    monkeypatch.setattr(phrases, "encode", lambda texts, seed: seeds.append(seed) or clumsy(texts, seed))
    got, want = against_sql(spark, [(1, "a b. " * 40, "en", 1, 2, "x")])
    assert got == want and len(got) == 1 and seeds == [0, 1]


def test_trie():
    """Every phrase of a random set, and of a wide one, is found; all others are not."""
    rnd = random.Random(4)
    for words, count in ((5, 40), (700, 4000)):
        codes = [rnd.getrandbits(63) for _ in range(words)]
        some = sorted({tuple(rnd.choice(codes[: 1 + rnd.randrange(words)]) for _ in range(rnd.randint(1, 4))) for _ in range(count)})
        trie = phrases.Trie.of(np.array([c for p in some for c in p], np.int64), np.array([len(p) for p in some]))
        text = [rnd.choice([0, *codes, 77]) for _ in range(3000)] + [c for p in some[:300] for c in (*p, 0)]
        plain = Counter(tuple(text[i:i + k]) for i in range(len(text)) for k in range(1, 5) if i + k <= len(text))
        assert trie.counts(np.array(text, np.int64)).tolist() == [plain[p] for p in some]


def test_long_texts_are_cut_at_breaks():
    ids = np.array([1, 2, 0, 3, 4, 5, 6, 0, 0, 7, 8], np.int32)
    assert [p.tolist() for p in phrases.parts(ids, 3)] == [[1, 2, 0, 3, 4, 5, 6], [0, 7, 8]]
    assert [p.tolist() for p in phrases.parts(ids, 100)] == [ids.tolist()]


def test_vectors_are_small_rows(spark):
    """Tables are written and read a hundred rows at a time and more, so a vector of codes stays under a megabyte."""
    docs = spark.createDataFrame([("en", "one two. " * 20_000)] * 20, "lang string, text string").coalesce(1)
    sizes = [len(r["codes"]) for r in phrases.encode(docs, 0).filter("codes IS NOT NULL").collect()]
    words = phrases.encode(docs, 0).filter("codes IS NULL").collect()
    assert max(sizes) < 1 << 20 and sum(sizes) >= 8 * 20 * 60_000
    assert {(r["word"], r["n"]) for r in words} == {("one", 400_000), ("two", 400_000)}


@pytest.mark.parametrize("single", [True, False])
def test_extensions_over_stretches(single):
    """What follows a phrase is counted over stretches together, and again from nothing after each count."""
    rnd = random.Random(5)
    some = [(1,), (2,), (3,)]
    trie = phrases.Trie.of(np.array([c for p in some for c in p], np.int64), np.array([1, 1, 1]))
    seen = phrases.Extensions(trie, 1, 10, single)
    for _ in range(2):
        texts = [[rnd.choice([0, 1, 2, 3, 9]) for _ in range(500)] + [0] for _ in range(3)]
        for text in texts:
            seen.add(np.array(text, np.int64))
        want = Counter((10 + a - 1, b) for t in texts for a, b in zip(t, t[1:]) if a in (1, 2, 3) and b and (b != 9 or not single))
        got = seen.counted().to_pylist()
        assert {(r["id"], r["code"]): r["n"] for r in got} == want and len(got) == len(want) and seen.places == 0
