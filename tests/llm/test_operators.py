"""Each operator against a plain version of itself, and its defined results for nulls, empty tables, ties and clashes."""

import hashlib
import random
import struct
import zlib
from array import array
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quantloom.llm import chat_tree, common, line_dedup, media, mixing, near_copies, permutation_index, piece_codec, simhash, substring_dedup, token_store, toxicity

#: Columns by names that operators use inside, rows repeated, nulls in every column.
DOC_SCHEMA = "doc_id long, text string, source string, row string, id int, fp int, anchor int, key int, mask int, at int, gone int, part int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], DOC_SCHEMA)


def sample_texts(seed=3, n=60):
    rnd = random.Random(seed)
    words = ["ab", "the", "q", "zz é", "of", "night", "ocean"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(4, 120))) for _ in range(12)]
    out = [None, "", " \n\t ", "a" * 700, "a" * 199, "a" * 200, "line\n" * 9]
    for i in range(n):
        a, b = rnd.choice(base), rnd.choice(base)
        out.append(a[rnd.randint(0, len(a)):] + rnd.choice(["", "\n", f" # {i}\n"]) + b[: rnd.randint(0, len(b))])
    return out + out[:9]


@pytest.fixture(scope="module")
def mixed_rows():
    rows = [(i if i % 9 else None, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(sample_texts())]
    return rows + [rows[8], rows[8], (None, None, None)]


@pytest.fixture(scope="module")
def documents(spark, mixed_rows):
    return docs_of(spark, mixed_rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, [])


def plain_substrings(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        gone = np.cumsum(hit[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [substring_dedup.HOT_STRETCHES, 3])
def test_substrings_match_plain_version(documents, mixed_rows, hot):
    got = substring_dedup.dedup_substrings(documents, hot=hot).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(plain_substrings([r[1] for r in mixed_rows], 200))


def test_substrings_of_nothing(nothing):
    assert substring_dedup.dedup_substrings(nothing).count() == 0


def test_merged_shards_find_what_sorting_finds(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 150)
    rnd = random.Random(1)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 90))) for _ in range(30)]
    seen = Counter(s[i:i + 16] for s in strings for i in range(len(s) - 15))
    want = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - 15) if seen[s[i:i + 16]] > 1}
    runs = substring_dedup.repeated_runs(strings, 16)
    assert {(s, p + i) for s, p, n in zip(*(x.tolist() for x in runs)) for i in range(n)} == want


def test_long_texts_are_cut_without_loss(monkeypatch):
    data = np.frombuffer(b"abcdefgh" * 500 + bytes(range(200)) * 4, np.uint8)
    starts, ends = np.array([0, 4000, 4000]), np.array([4000, 4000, len(data)])
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    covered = 0
    for first, last, lo, hi in substring_dedup.pieces(starts, ends, 200):
        b, e = np.maximum(starts[first:last], lo) - lo, np.minimum(ends[first:last], hi) - lo
        covered += substring_dedup.stretches(data[lo:hi], b[e > b], e[e > b], 200, 50)[2].sum()
    assert covered == 4000 - 199 + len(data) - 4000 - 199


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))


def hard_texts(n=800):
    rnd = random.Random(2)
    letters = [*"ab the  \n\t.é😀한<s></s>▁\x00", "   ", " \n", "on", "tion", "<unk>", "<0x0A>"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + [None, "", "x " * 5000]


def test_pieces_agree_with_sentencepiece(pieces):
    texts = hard_texts()
    ids, same = pieces.encode(texts)
    assert [array("I", x).tolist() for x in ids] == pieces.judge.encode([t or "" for t in texts]) and all(same)
    assert pieces.decode(ids) == [(t or "").replace("▁", " ") for t in texts]
    assert pieces.decode([array("I", [1, *array("I", x), 2]).tobytes() for x in ids[:50]]) == [(t or "").replace("▁", " ") for t in texts[:50]]
    assert [e.ids for e in pieces.whole.encode_batch([t or "" for t in texts if t], add_special_tokens=False)] == pieces.judge.encode([t for t in texts if t])


def test_ids_and_texts_come_from_the_rebuilt_tokenizer(monkeypatch):
    """With the other library's ids spoilt, ids stay and parity says so; with another decoder, texts change."""
    from tokenizers import decoders

    path = public_tokenizers.path("piece_bpe_32k.model")
    fine, spoilt = piece_codec.PieceCodec(path), piece_codec.PieceCodec(path)
    judge = spoilt.judge

    class Wrong:
        def encode(self, texts, **how):
            return [[9 if x == judge.piece_to_id("▁night") else x for x in ids] for ids in judge.encode(texts, **how)]

    spoilt.judge = Wrong()
    texts = ["a night", "a day", None, "night\nnight"]
    assert spoilt.encode(texts)[0] == fine.encode(texts)[0]
    assert fine.encode(texts)[1] == [True] * 4 and spoilt.encode(texts)[1] == [False, True, True, False]
    shouting = piece_codec.PieceCodec(path)
    shouting.whole.decoder = decoders.Fuse()
    shouting.sizes, shouting.starts, shouting.flat = shouting.piece_bytes(piece_codec.parse_model(path))
    assert shouting.decode(fine.encode(texts)[0])[0] == "▁a▁night"
    assert fine.decode([array("I", [3 + 0xE9, 3 + 0x41]).tobytes()]) == [fine.whole.decode([3 + 0xE9, 3 + 0x41])]
    fine.flat = np.where(fine.flat == ord("z"), ord("x"), fine.flat)  # a decoder that differs shows in the parity
    assert fine.encode(["a zebra", "a lion"])[1] == [False, True]


def test_units_that_were_seen_lately_outlast_a_full_cache(pieces, monkeypatch):
    """What came since the last turn is not learnt again, units are learnt some at a time, and two caches of units are kept at most."""
    monkeypatch.setattr(piece_codec, "CACHE_UNITS", 60)
    monkeypatch.setattr(piece_codec, "LEARNT_UNITS", 10)
    monkeypatch.setattr(piece_codec, "TEXTS_AT_ONCE", 1)
    small = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    learnt, learn = [], small.learn
    monkeypatch.setattr(small, "learn", lambda units: (learnt.append(list(units)), learn(units)))
    always = " ".join(f"w{i}" for i in range(20))
    texts = [x for k in range(30) for x in (always, " ".join(f"{k}x{i}" for i in range(15)))]
    assert small.encode(texts)[0] == pieces.encode(texts)[0]
    assert max(map(len, learnt)) <= 10
    assert sum(u.lstrip(piece_codec.MARK) == "w7" for units in learnt for u in units) == 1
    assert len(small.cache) + len(small.older) <= 2 * 60 + 2 * 2


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_models(tmp_path, squeeze):
    """A unigram model written out by hand: scores decide, bytes stand for what no piece covers."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    kinds = {"<unk>": piece_codec.UNKNOWN, "<s>": piece_codec.CONTROL, "</s>": piece_codec.CONTROL}
    names = [*kinds, *(f"<0x{b:02X}>" for b in range(256)), "▁", *"abehnot.", "on", "▁a", "▁the", "the", "th", "an", "▁an", "▁on", "ton", "bb"]
    for k, name in enumerate(names):
        kind = kinds.get(name) or (piece_codec.BYTE if name[:3] == "<0x" else piece_codec.NORMAL)
        model.pieces.add(piece=name, score=0 if kind != piece_codec.NORMAL else -8 + 0.137 * len(name) * (k % 7) + 0.0131 * (k % 11), type=kind)
    spec = model.trainer_spec
    spec.model_type, spec.unk_id, spec.bos_id, spec.eos_id, spec.byte_fallback, spec.vocab_size = 1, 0, 1, 2, True, len(names)
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, squeeze
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    codec = piece_codec.PieceCodec(str(path))
    assert codec.by_unit is not squeeze
    texts = ["another one on the boat", "bbbb é 한", "", " ton ", "x"] if squeeze else hard_texts(300)
    ids, same = codec.encode(texts)
    assert [array("I", x).tolist() for x in ids] == codec.judge.encode([t or "" for t in texts]) and all(same)
    assert codec.decode(ids) == [codec.judge.decode(array("I", x).tolist()) for x in ids]


def test_piece_columns(documents, nothing, mixed_rows):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_codec.decode_pieces(piece_codec.encode_pieces(documents.withColumn("piece_text", documents["row"]), model), model)
    assert rows.columns == [*documents.columns, "piece_ids", "piece_parity", "piece_text"]
    rows = rows.collect()
    assert len(rows) == len(mixed_rows) and all(r["piece_text"] == (r["text"] or "") for r in rows)
    assert piece_codec.encode_pieces(nothing, model).count() == 0


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == toxicity.GRADES - 1
    held = docs.join(labels.filter("doc_id % 3 = 0").selectExpr("doc_id", "toxic AS truth"), "doc_id")
    rows = toxicity.score(held, model).select("truth", "p_toxic", "severity").toPandas()
    found = rows.p_toxic >= toxicity.REJECT
    assert (found & (rows.truth == 1)).sum() >= 0.85 * (rows.truth == 1).sum()
    assert (found & (rows.truth == 0)).sum() <= 0.02 * (rows.truth == 0).sum()
    assert rows.severity.between(0, toxicity.GRADES - 1).all()


def test_toxicity_without_both_labels(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(documents, labels)
    assert toxicity.score(documents, model).filter("p_toxic >= 0.5 OR grade <> 0").count() == 0
    assert toxicity.score(nothing, model).count() == 0


def test_scores_are_those_of_a_plain_version(spark, documents, mixed_rows):
    model = toxicity.OrdinalModel({"night": 1.5, "ocea*": -0.7, "of": 0.3}, (0.2, 1.1, 2.0))
    got = Counter()
    for r in toxicity.score(documents, model).collect():
        got[r["doc_id"], r["text"], round(r["p_toxic"], 9), round(r["severity"], 9), r["grade"]] += 1
    want = Counter()
    for doc, text, _ in mixed_rows:
        bare = [w.strip(".,;:!?\"'()*#&$%-") for w in (text or "").lower().split()]
        counts = {"night": bare.count("night"), "ocea*": sum(w[:4] == "ocea" and len(w) > 4 for w in bare), "of": bare.count("of")}
        x = sum(model.weights[f] * (1 + np.log(n)) for f, n in counts.items() if n)
        above = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
        chances = [a - b for a, b in zip([1, *above], [*above, 0])]
        want[doc, text, round(above[0], 9), round(sum(above), 9), int(np.argmax(chances))] += 1
    assert got == want


def test_severity_follows_the_amount_of_abuse(spark):
    """Documents with a known number of abusive words, of which labels tell only whether there are any: on documents kept
    out of the training, expected severity rises with that number. Ids repeat, and each of their texts is a row."""
    rnd = random.Random(7)
    abuse, plain = [f"vile{c}" for c in "abcdefgh"], [f"word{i}" for i in range(200)]
    rows, truth = [], {}
    for k in range(900):
        n = 0 if k % 3 else rnd.choice([1, 2, 4, 8, 16])
        words = [rnd.choice(plain) for _ in range(60)] + [rnd.choice(abuse) for _ in range(n)]
        rnd.shuffle(words)
        rows.append((k // 2 if k < 20 and k % 3 else k, " ".join(words), None))
        truth[" ".join(words)] = n
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, rows), labels)
    assert set(model.weights) >= set(abuse) and not set(model.weights) & set(plain)
    held = [(truth[r["text"]], r["severity"], r["grade"]) for r in toxicity.score(docs_of(spark, rows[600:]), model).collect()]
    mean = [np.mean([s for n, s, _ in held if n == k]) for k in (0, 1, 2, 4, 8, 16)]
    assert mean == sorted(mean) and mean[-1] - mean[1] > 0.5
    assert all(g == 0 for n, _, g in held if n == 0) and np.mean([g >= 2 for n, _, g in held if n >= 8]) > 0.8


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    strength = rng.uniform(0, 4, 600)
    grades = np.digitize(strength, [1, 2, 3])
    weights, cuts = toxicity.fit_ordinal(np.arange(600), np.zeros(600, int), strength, grades, 1)
    assert weights[0] > 0 and (np.diff(cuts) > 0).all()
    above = toxicity.OrdinalModel({}, tuple(cuts)).above(strength * weights[0])
    assert np.corrcoef(above.sum(axis=1), grades)[0, 1] > 0.95


def test_token_files(spark, documents, mixed_rows, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    manifest = token_store.write_tokens(documents, path, f"file://{tmp_path}/out")
    rows = token_store.read_tokens(manifest, with_ids=True).toPandas().sort_values("start", kind="stable")
    ids = [np.frombuffer(x, "<u4").tolist() for x in rows.ids]
    want = Counter((r[0], tuple(plain.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in mixed_rows)
    assert Counter((None if np.isnan(d) else int(d), tuple(x)) for d, x in zip(rows.doc_id.astype(float), ids)) == want
    assert rows.start.tolist() == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()
    known = rows.doc_id.dropna().tolist()
    assert known == sorted(known)
    some = token_store.read_tokens(manifest, want=lambda d: d == 7).collect()
    assert {r["doc_id"] for r in some} == {7}
    assert token_store.read_tokens(token_store.write_tokens(nothing, path)).count() == 0


def test_token_file_checksum(tmp_path):
    import pyarrow.fs as pafs

    store = pafs.LocalFileSystem()
    writer = token_store.FrameWriter(store.open_output_stream(str(tmp_path / "a")))
    for k in range(3):
        writer.add(k, struct.pack("<3I", k, 5, 6))
    writer.close()
    raw = (tmp_path / "a").read_bytes()
    assert token_store.FrameReader(store.open_input_file(str(tmp_path / "a"))).read(1) == struct.pack("<3I", 1, 5, 6)
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(struct.pack("<3I", k, 5, 6) for k in range(3))
    start = writer.entries[0][0]
    (tmp_path / "b").write_bytes(raw[:start + 9] + bytes([raw[start + 9] ^ 1]) + raw[start + 10:])
    with pytest.raises(Exception):
        token_store.FrameReader(store.open_input_file(str(tmp_path / "b"))).read(1)


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, ours = Tokenizer.from_file(path), token_store.WordEncoder(path)
    rnd = random.Random(1)
    letters = [chr(c) for c in range(0x250)] + [*"́̇İſΣςı­ﬁⅷ한你😀\x1c\u2028"] + ["<|endoftext|>", "<|ENDOFTEXT|>", "'LL", "'s"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    assert ours(texts) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_lowers_beside_openings():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, texts = Tokenizer.from_file(path), ["Hello <| World", "HELLO <|endoftext|> World", "IT'S <|x A1B", "hello Hello"]
    assert token_store.WordEncoder(path)(texts) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"),
    (2, 2, "user", "\\<|im_end|>\n\\<|x"), (2, 3, "assistant", "<|im_start|>assistant\n<"), (3, 0, "user", "hi"), (3, 1, "assistant", None),
    (4, 0, "us\ner", ""), (4, 0, "us\ner", ""), (4, None, None, "first"), (None, 1, "assistant", "é😀"),
]


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
TURN_SCHEMA = "conv_id long, turn long, role string, text string, node string, page int"


def turns_of(spark, turns):
    return spark.createDataFrame([(*t, "x", 1) for t in turns], TURN_SCHEMA)


def check_tree(tree):
    """The nodes by key; their places, positions and intervals are what walking up from each says."""
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    assert sorted(x for r in nodes.values() for x in range(r["start"], r["stop"])) == list(range(sum(r["n_tokens"] for r in nodes.values())))
    below = defaultdict(int)
    for r in nodes.values():
        up, parent = [], r["parent"]
        below[r["node"]] += r["n_tokens"]
        while parent:
            below[parent] += r["n_tokens"]
            up = [*range(nodes[parent]["start"], nodes[parent]["stop"]), *up]
            parent = nodes[parent]["parent"]
        assert [k for s, e in r["ancestors"] for k in range(s, e)] == up and r["position"] == len(up)
    for r in nodes.values():
        assert r["subtree_stop"] == r["start"] + below[r["node"]]
    return nodes


def test_chat_tree_reads_back(spark):
    tree = chat_tree.build_tree(turns_of(spark, TURNS), BYTE_BPE)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_tree.read_back(tree).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in TURNS:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        assert got[conv][:4] == (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(check_tree(tree)) == 9
    form = chat_tree.Template(BYTE_BPE)
    pages = tree.pages.orderBy("page").collect()
    ids, loss = [x for r in pages for x in r["ids"]], [x for r in pages for x in r["loss"]]
    for r in tree.nodes.collect():
        assert (ids[r["start"]], ids[r["stop"] - 2]) == (form.start, form.end)
        assert sum(loss[r["start"]:r["stop"]]) == ((r["loss_to"] - r["loss_from"]) if r["role"] == "assistant" else 0)
    empty = chat_tree.build_tree(turns_of(spark, []), BYTE_BPE)
    assert chat_tree.read_back(empty).count() == 0 and empty.pages.count() == 0 and empty.nodes.count() == 0


def test_reading_back_depends_on_the_emitted_order_and_intervals(spark):
    from dataclasses import replace

    tree = chat_tree.build_tree(turns_of(spark, TURNS), BYTE_BPE)
    want = sorted(map(str, chat_tree.read_back(tree).collect()))
    bare = replace(tree, nodes=tree.nodes.withColumn("ancestors", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    assert sorted(map(str, chat_tree.read_back(bare).collect())) != want
    with pytest.raises(Exception):
        chat_tree.read_back(replace(tree, pages=tree.pages.withColumn("ids", F.reverse("ids")))).collect()
    loud = replace(tree, pages=tree.pages.withColumn("loss", F.transform("loss", lambda x: ~x)))
    assert sorted(map(str, chat_tree.read_back(loud).collect())) != want


def test_trees_of_many_forks(spark, monkeypatch):
    """Random trees, long conversations that others leave at each turn, and turns longer than a page."""
    monkeypatch.setattr(chat_tree, "PAGE", 16)
    rnd = random.Random(3)
    turns = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(120)]
    for k in range(60):  # leaves the first conversation at turn 2 * k
        turns += [(100 + k, i, ("user", "assistant")[i % 2], f"t{i}" if i < 2 * k else f"own {k} {i}") for i in range(2 * k + rnd.randint(1, 3))]
    for k in range(80):
        turns += [(1000 + k, i, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b é", "long " * 30])) for i in range(rnd.randint(1, 6))]
    tree = chat_tree.build_tree(turns_of(spark, turns), BYTE_BPE)
    nodes = check_tree(tree)
    assert max(len(r["ancestors"]) for r in nodes.values()) <= 1 + np.log2(141)
    groups = defaultdict(list)
    for conv, turn, role, text in turns:
        groups[conv].append((turn, role, text))
    want = {conv: (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in sorted(ts)).encode()).hexdigest()) for conv, ts in groups.items()}
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for limit in (before, "300"):  # down to less than a turn a batch
        spark.conf.set(key, limit)
        assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in chat_tree.read_back(tree).collect()} == want
    spark.conf.set(key, before)


def test_a_join_with_hot_keys_is_split(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", 5)
    many = common.materialize(spark.createDataFrame([(k % 7 if k > 400 else 3, k) for k in range(500)] + [(None, 1), (99, 1)], "key int, x int"), "many")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(7)] + [(None, "n")], "key int, v string")
    for how in ("inner", "left"):
        got = common.join_split(many, one, ["key"], ["x"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one, "key", how).collect())) and got.columns == ["key", "x", "v"]
    assert common.join_split(many.limit(0), one, ["key"], ["x"]).count() == 0


def filled(spark, sizes, weights, cap=3):
    """Targets by the operator, of sources in order."""
    rows = spark.createDataFrame([(f"s:{i:03d}", s, 1) for i, s in enumerate(sizes)], "key string, size long, n long")
    return [r["target"] for r in mixing.water_fill(rows, weights, cap).orderBy("key").collect()]


def test_water_fill(spark):
    assert filled(spark, [10, 10, 100], [5, 2, 1]) == [30.0, 30.0, 60.0]
    assert filled(spark, [0, 0], [1, 2]) == [0.0, 0.0]
    rnd = random.Random(0)
    for n in (1, 2, 5, 9, 40):
        sizes = [rnd.randint(0, 50) for _ in range(n)]
        got, weights = filled(spark, sizes, (5, 2, 1)), [(5, 2, 1)[i % 3] for i in range(n)]
        assert sum(got) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes))
        free = {round(g / w, 6) for g, s, w in zip(got, sizes, weights) if g < 3 * s - 1e-6}
        assert len(free) <= 1


def test_mixes_agree_on_reruns(spark):
    """Rows that share size and id but not text, null ids, and any order of the input; another seed gives another draw."""
    rows = [(k % 5 if k % 3 else None, f"w{k:03d} x", "a" if k % 4 else "b") for k in range(300)]
    draws = []
    for seed, order in (("", 1), ("", -1), ("other", 1)):
        docs = docs_of(spark, rows[::order]).repartition(3)
        draws.append(sorted((r["text"], r["mix_copies"]) for r in mixing.mix(docs, weights=(1, 7), bucket_rows=40, seed=seed).collect()))
    assert draws[0] == draws[1] != draws[2]


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_mix(documents, nothing, mixed_rows, bucket_rows):
    rows = mixing.mix(documents, bucket_rows=bucket_rows).collect()
    assert len(rows) == len(mixed_rows) and documents.columns == rows[0].__fields__[:-4]
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        rate = own[0]["mix_target"] / own[0]["mix_source_size"]
        assert all(int(rate) <= r["mix_copies"] <= int(rate) + 1 for r in own)
        assert abs(sum(r["mix_copies"] for r in own) - rate * len(own)) < 1
    assert all(r["mix_size"] == len((r["text"] or "").split()) for r in rows if "\x1c" not in (r["text"] or ""))
    assert Counter(map(str, mixing.mix(documents, bucket_rows=bucket_rows).collect())) == Counter(map(str, rows))
    assert mixing.mix(nothing).count() == 0
    again = mixing.mix(mixing.mix(documents))
    assert again.columns == mixing.mix(documents).columns and again.count() == len(mixed_rows)


def plain_neighbours(rows, top=5):
    """Of each id that divides by 50, the greatest cosines in double precision among rows with another id."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    units = np.array([np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for _, v in good])
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    ids = np.array([i for i, _ in good])
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = min((tuple(v), k) for k, (i, v) in enumerate(good) if i == q)[1]
        score = np.where(ids == q, -9, units @ units[own])
        best = np.lexsort([ids, -np.round(score, 12)])[:top]
        yield q, [(int(ids[k]), float(score[k])) for k in best if ids[k] != q]


def neighbours(frame, **how):
    got = defaultdict(list)
    for r in permutation_index.search(frame, **how).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("n", [1500, 4000])
def test_permutation_index(spark, n, monkeypatch):
    monkeypatch.setattr(permutation_index, "BLOCK_ROWS", 900)
    monkeypatch.setattr(permutation_index, "QUERY_ROWS", 20)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(n, 16)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(50, vectors[3]), (100, vectors[100]), (100, vectors[100]), (7, vectors[7]), (50, vectors[8])]
    rows += [(k, vectors[5]) for k in range(1001, 1300)]  # one very common vector, of queries too
    rows += [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9050, [None] * 16), (None, vectors[0]), (9100, [1.0, 2.0])]
    got, hits, total = neighbours(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, block int")), 0, 0
    want = dict(plain_neighbours(rows))
    assert set(got) == set(want)
    for q, best in want.items():
        total += len(best)
        hits += len({i for i, _ in got[q]} & {i for i, _ in best})
        assert len(got[q]) == 5 and [x[1] for x in got[q]] == sorted((x[1] for x in got[q]), reverse=True)
    assert hits >= 0.9 * total
    # with all of each block reranked nothing is approximate
    every = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), share=1.0)
    for q, best in want.items():
        assert [i for i, _ in every[q]] == [i for i, _ in best] and [s for _, s in every[q]] == pytest.approx([s for _, s in best], abs=1e-12)


def test_neighbours_of_few_and_repeated_ids(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert neighbours(few) == {0: [(1, 1.0), (2, 0.0)]}
    assert permutation_index.search(few.filter("vec_id > 5")).count() == 0
    rows = [(0, [1.0, float(k)]) for k in range(7)] + [(k, [1.0, 10.0 * k]) for k in range(1, 8)]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    rows = [(0, [1.0, 1.0])] * 4 + [(k, [1.0, float(k)]) for k in (1, 2, 3)] + [(3, [1.0, 3.0])]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [i for i, _ in got[0]] == [1, 2, 3, 3]
    tiny = [(0, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e300, 0.0]), (3, [0.0, 5e-324])]
    got = neighbours(spark.createDataFrame(tiny, "vec_id long, embedding array<double>"))
    assert [i for i, _ in got[0]] == [2, 1, 3] and [s for _, s in got[0]] == pytest.approx([1, 0.5 ** 0.5, 0])


def test_footrule_from_posting_lists():
    rng = np.random.default_rng(0)
    lists = np.array([rng.permutation(9)[:4] for _ in range(20)])
    file = permutation_index.PivotFile(lists, 9)
    place = lambda own, p: list(own).index(p) if p in own else 4
    for query in lists:
        rule = [sum(abs(place(query, p) - place(own, p)) for p in range(9)) for own in lists]
        assert (np.array(rule) == 2 * sum(range(1, 5)) - 2 * file.shared(query)).all()
    for pivot in range(9):
        posted = file.row[file.ends[pivot]:file.ends[pivot + 1]].tolist()
        assert posted == [k for k, own in enumerate(lists) if pivot in own]


def test_media_payloads(documents, mixed_rows, nothing):
    stored = media.store_texts(documents)
    rows = media.media_features(stored, tile_side=4).collect()
    want = Counter()
    for _, text, _ in mixed_rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want[len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["payload_sha256"]].add((r["media_sha256"], r["feature"], bytes(r["tile"])))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.media_features(media.store_texts(nothing)).count() == 0


def test_media_query_writes_tiles(spark):
    from quantloom.llm.queries import queries

    rows = queries()["op8_media"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    kinds = set()
    for r in rows:
        _, data = media.text_to_media(texts[r["doc_id"]])
        tile = media.npy_tile(media.to_gray(media.decode(data)), media.TILE_SIDE)
        kinds.add(data[:2])
        assert (r["media_sha256"], r["tile_sha256"], r["tile_bytes"]) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(tile).hexdigest(), len(tile))
    assert kinds == {b"P6", b"BM"} and len(rows) == len(texts)


def test_malformed_media_give_nulls(spark):
    good = media.encode_bmp(np.zeros((2, 3, 3), np.uint8))
    palette = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 66, 0, 0, 58, 40, 4, 1, 1, 8, 0, 4, 0, 0, 1, 0) + b"\1\2\3\0" + b"\0\0\0\7"
    bad = [None, b"", b"P5 0 0 255\n", b"P5 99999999999999999999 1 255\n1", b"P5 999999999 999999999 255\n1", b"P6 2 2 0\n" + bytes(12), b"P2 2 1 9\n10 1",
           b"P3 1 1 255\n1 2", b"BM", good[:40], good[:-1], palette, b"GIF89a", b"P5 2 1 70000\n1234"]
    rows = spark.createDataFrame([(k, 1, x) for k, x in enumerate(bad)] + [(99, 1, good)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.media_features(rows).collect()}
    assert all(set(got[k][2:]) == {None} for k in range(len(bad))) and None not in got[99][2:]


def test_bit_fields_and_maxima():
    head = lambda bits, packing, extra: struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + len(extra), 40, 2, 1, 1, bits, packing, 0, 0, 0, 0, 0) + extra
    fields = struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)  # red in the lowest byte
    assert media.decode(head(32, 3, fields) + bytes([1, 2, 3, 0, 4, 5, 6, 0])).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode(head(16, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F)) + struct.pack("<HH", 0xF800, 0x07FF)).tolist() == [[[255, 0, 0], [0, 255, 255]]]
    assert media.decode(head(16, 0, b"") + struct.pack("<HH", 0x7FFF, 0x001F)).tolist() == [[[255, 255, 255], [0, 0, 255]]]
    assert media.decode(b"P5 2 1 15\n\x0f\x05")[0, :, 0].tolist() == [255, 85]
    assert media.decode(b"P2 2 1 1000\n1000 500")[0, :, 0].tolist() == [65535, 32768]
    assert media.to_gray(media.decode(b"P2 1 1 1000\n1000"))[0, 0] == 255


def test_media_formats():
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(pixels)) == pixels).all() and (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert media.decode(b"P2 # c\n3 1 255\n1 2 3")[0, :, 0].tolist() == [1, 2, 3]
    assert media.decode(b"P1\n3 2\n1 0 1\n010")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5\n2 1\n65535\n\x01\x00\x00\x02")[0, :, 0].tolist() == [256, 2]
    gray = media.to_gray(pixels)
    assert media.area_resize(gray, 5, 7) == pytest.approx(gray)
    assert media.area_resize(gray, 1, 1)[0, 0] == pytest.approx(gray.mean())
    small = media.area_resize(np.arange(12.0).reshape(2, 6), 1, 4)
    assert small[0] == pytest.approx([(3 + 4 / 2) / 1.5, (4 / 2 + 5) / 1.5, (6 + 7 / 2) / 1.5, (7 / 2 + 8) / 1.5])


def plain_lines(rows, size):
    lines = {k: [(i, x.strip(" \t\r\v\f")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\v\f")] for k, (_, t, _) in enumerate(rows)}
    order = sorted(lines, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, gone = set(), Counter()
    for k in order:
        drop = set()
        for i in range(len(lines[k]) - size + 1):
            window = tuple(x for _, x in lines[k][i:i + size])
            if window in seen:
                drop |= set(range(i, i + size))
            seen.add(window)
        gone[len(drop)] += 1
    return gone


def test_line_dedup(spark, nothing):
    rnd = random.Random(4)
    rows = [(i, "\n".join(rnd.choice(["a", "b", " b ", "", "c", "long line"]) for _ in range(rnd.randint(0, 9))), None) for i in range(80)] + [(None, None, None)]
    got = line_dedup.dedup_lines(docs_of(spark, rows))
    assert got.columns[:-1] == docs_of(spark, []).columns
    out = got.collect()
    assert Counter(r["line_dedup_removed"] for r in out) == plain_lines(rows, 3)
    assert [r["text"] for r in out if r["doc_id"] is None] == [None]
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    body = "one\ntwo\nthree\nfour"
    out = line_dedup.dedup_lines(docs_of(spark, [(1, body, None), (2, body, None), (3, body + "\nfive", "x")]), drop_emptied=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, body), (3, "five")]
    for key in (1, None):  # rows equal in all columns, one of which is a map
        same = docs_of(spark, [(key, body, None)] * 3).withColumn("row", F.create_map(F.lit("a"), F.lit(1)))
        assert sorted(r["text"] for r in line_dedup.dedup_lines(same).collect()) == ["", "", body]


def test_winnowed_fingerprints():
    rng = np.random.default_rng(2)
    for n, window in ((0, 3), (2, 3), (3, 3), (200, 3), (200, 5), (50, 1)):
        hashes = rng.integers(0, 40, n).astype(np.uint64)
        place, first, many = line_dedup.winnow(hashes, window)
        want = [(int(np.argmin(hashes[i:i + window])) + i, i) for i in range(n - window + 1)]
        assert [(p, a + k) for p, a, m in zip(place.tolist(), first.tolist(), many.tolist()) for k in range(m)] == want
        assert n < 200 or window == 1 or len(place) < 0.8 * len(want)  # fewer fingerprints than windows


def test_line_dedup_rests_on_fingerprints_and_their_stretches(spark, monkeypatch):
    """Without the join of fingerprints, or with stretches that aren't grown, runs stay."""
    docs = docs_of(spark, [(k, f"a{k}\none\ntwo\nthree\nfour\nb{k}", None) for k in range(3)])
    assert [r["line_dedup_removed"] for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 4, 4]
    whole = line_dedup.winnow
    monkeypatch.setattr(line_dedup, "winnow", lambda *how: tuple(x[:1] for x in whole(*how)))
    assert [r["line_dedup_removed"] for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] != [0, 4, 4]


def test_long_passages_on_one_and_two_lines(spark):
    long, half, rest = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 30), ("c", 25)))
    rows = [(1, long, None), (2, f"head\n{long}", None), (3, f"x\n{half}\n\n {rest}\ny", None), (4, f"{half}\n{rest}\nz", None),
            (5, f"{half}\nx", None), (6, f"head\n{long}\nx", None), (7, "", None), (None, f"x\n{long}", None), (8, None, None)]
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: (r["text"], r["line_dedup_removed"]) for r in line_dedup.dedup_lines(docs, long_words=50).collect()}
    assert got == {1: (long, 0), 2: ("head", 1), 3: (rows[2][1], 0), 4: ("z", 2), 5: (f"{half}\nx", 0), 6: ("x", 2), 7: ("", 0), None: ("x", 1), 8: (None, 0)}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {k: t for k, (t, _) in got.items()}
    assert sum(r["line_dedup_removed"] for r in line_dedup.dedup_lines(docs).collect()) == 0


def plain_groups(values, budget):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= budget) + i + 1:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize(("n", "budget"), [(2, 4), (300, 4), (900, 4), (400, 9)])
def test_trie_join(n, budget):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, max(1, n // 20), dtype=np.uint64)
    values = base[rng.integers(0, len(base), n)]
    for _ in range(6):
        values = np.where(rng.random(n) < 0.6, values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), values)
    values = np.unique(values)
    assert simhash.trie_join(values, budget).tolist() == plain_groups(values, budget)
    cut = len(values) // 2
    both = simhash.trie_join(values, budget, np.array([0, cut, len(values)]))
    assert both.tolist() == plain_groups(values[:cut], budget) + [cut + x for x in plain_groups(values[cut:], budget)]


def plain_fingerprint(text, words):
    import xxhash

    split = (text or "").encode().lower().split()
    shingles = [b" ".join(split[i:i + words]) for i in range(max(1, len(split) - words + 1))] if split else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_simhash_components(documents, mixed_rows, group_rows):
    rows = simhash.link_documents(documents, group_rows=group_rows).collect()
    values = np.array([plain_fingerprint(t, 4) for _, t, _ in mixed_rows], np.uint64)
    groups = defaultdict(list)
    for k, g in enumerate(plain_groups(values, 4)):
        groups[g].append(k)
    want = Counter()
    for members in groups.values():
        least = min((mixed_rows[k][0] for k in members if mixed_rows[k][0] is not None), default=None)
        want.update((mixed_rows[k][0], int(values[k]), least) for k in members)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows) == want


def test_trie_pairs():
    rng = np.random.default_rng(4)
    for n, budget in ((2, 4), (200, 22), (600, 6)):
        base = rng.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64)
        values = base[rng.integers(0, len(base), n)]
        for _ in range(8):
            values = np.where(rng.random(n) < 0.5, values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), values)
        cut = n // 3  # two tries, values may repeat
        values = np.concatenate([np.sort(values[:cut]), np.sort(values[cut:])])
        roots = rng.integers(0, n // 2 + 1, n)
        want = {(i, j) for lo, hi in ((0, cut), (cut, n)) for i in range(lo, hi) for j in range(i + 1, hi)
                if roots[i] != roots[j] and (int(values[i]) ^ int(values[j])).bit_count() <= budget}
        got = []
        simhash.trie_walk(values, budget, np.array([0, cut, n]), roots, lambda i, j: got.extend(zip(i.tolist(), j.tolist())))
        assert set(got) == want and len(got) == len(want)
    got = []
    simhash.trie_walk(np.zeros(300, np.uint64), 0, np.array([0, 300]), np.arange(300), lambda i, j: got.extend(i.tolist()))
    assert len(got) == 300 * 299 // 2


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 102), (102, 101)] + [(200, k) for k in range(201, 240)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and {got[k] for k in (100, 101, 102)} == {100} and {got[k] for k in range(200, 240)} == {200}


def plain_shingles(text, words):
    split = (text or "").encode().lower().split()
    return {b" ".join(split[i:i + words]) for i in range(max(1, len(split) - words + 1))} if split else set()


def near_texts():
    """Texts of which some are copies with a few words changed, near 0.8 and on both sides of it, in chains too."""
    rnd = random.Random(5)
    out = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(25):
        own = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(30, 300))]
        for _ in range(rnd.randint(1, 6)):
            out.append(" ".join(own))
            for at in rnd.sample(range(len(own)), max(1, len(own) * rnd.choice([1, 2, 3, 4]) // 100)):
                own[at] = f"x{rnd.randint(0, 10**6)}"
    return out


def test_near_copies_are_those_of_brute_force(spark, nothing):
    texts = near_texts()
    sets = [plain_shingles(t, 5) for t in texts]
    parent, near, apart = list(range(len(texts))), 0, 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            both, whole = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or 10 * both >= 8 * whole:
                parent[max(root(i), root(j))] = min(root(i), root(j))
                near += both < 0.9 * whole
            apart += 0.6 * whole <= both < 0.8 * whole
    assert near >= 15 and apart >= 15
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    for kept in (near_copies.keep_one(docs, group_rows=7), corpus_pipeline.near_dedup(spark, docs, "")):
        assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if root(i) == i]
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if root(i) == i]
    assert corpus_pipeline.near_dedup(spark, nothing, "").count() == 0


def test_near_copies_of_equal_ids(spark):
    docs = docs_of(spark, [(None, "a b", None), (3, "A b", None), (3, "a b", None), (None, "c", None)])
    assert sorted((r["doc_id"] or 0) for r in near_copies.keep_one(docs).collect()) == [0, 3]


def test_emptied_documents_go(spark):
    """What line dedup leaves of a copy may be white space of any kind."""
    lines = "\n".join(f"line {i} of a run" for i in range(4))
    docs = docs_of(spark, [(0, lines, None), (1, f"{lines}\n", None), (2, f"\t\n{lines}", None), (3, f"\v\n{lines}\n \r", None), (4, f"{lines}\nown", None), (5, "\n", None), (6, "\t", None), (7, None, None)])
    kept = line_dedup.dedup_lines(docs, drop_emptied=True)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {0: lines, 4: "own", 5: "\n", 6: "\t", 7: None}


def test_very_long_text_among_near_copies(spark):
    """A text of 200,000 words and its near copy, a band of many members, all in parts bounded by bytes."""
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(200_000)]
    near = [*long[:1000], "other", *long[1001:]]
    base = [f"v{i}" for i in range(60)]
    rows = [(0, " ".join(long), None), (1, " ".join(near), None)]
    rows += [(i, " ".join([*base[:k], f"x{i}", *base[k + 1:]]), None) for i, k in enumerate([58, 59] * 300, 2)]
    kept = near_copies.keep_one(docs_of(spark, rows), group_rows=50)
    plain = [0]
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t, _ in rows[2:]}
    linked, todo = set(), [2]
    while todo:
        a = todo.pop()
        linked.add(a)
        todo += [b for b in sets if b not in linked and b not in todo and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert linked == set(sets)
    assert sorted(r["doc_id"] for r in kept.collect()) == [*plain, 2]


def test_training_is_bounded_with_repeated_ids(spark):
    """Very many rows of one labelled id are one text of the sample."""
    rows = [(i, "vile filth idiot" if i % 2 else f"a calm note {i}", None) for i in range(300)] + [(1, f"row {i} of one id", None) for i in range(2000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    kept: list[int] = []
    real = common.materialize

    def seen(df, name):
        out = real(df, name)
        if name == "toxicity-sample":
            kept.append(out.count())
        return out

    toxicity.materialize, before = seen, toxicity.materialize
    try:
        toxicity.train(docs_of(spark, rows), labels)
    finally:
        toxicity.materialize = before
    assert kept == [300]


def test_netpbm_numbers_with_leading_zeros():
    got = media.decode(b"P2 2 1 255 0000255 00000001")
    assert np.asarray(got).reshape(-1).tolist() == [255, 1]


@pytest.mark.parametrize("bucket_rows", [30, 50_000])
def test_mixing_of_very_many_equal_rows(spark, bucket_rows):
    """Rows that no hash takes apart are dealt over parts of a bucket, and the mix keeps its sums."""
    rows = [(None, "same words here", "a", k) for k in range(700)] + [(k, " ".join(["w"] * (k % 9)), "ab"[k % 2], k) for k in range(300)] + [(None, None, None, k) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    got = mixing.mix(docs, weights=(1, 3), bucket_rows=bucket_rows)
    assert got.columns == [*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    got = got.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(r[:3] for r in rows)
    assert sorted(r["extra"] for r in got) == sorted(r[3] for r in rows)  # each row once
    for source in ("a", "b"):
        own = [r for r in got if r["source"] == source]
        assert {r["mix_source_size"] for r in own} == {sum(r["mix_size"] for r in own)}
        target, taken = own[0]["mix_target"], sum(r["mix_size"] * r["mix_copies"] for r in own)
        assert abs(taken - target) <= 0.1 * target + 9
        assert max(r["mix_copies"] for r in own) <= 3
    dealt = docs.select(F.lit("s").alias("k"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("doc_id") % 7 + 1).alias("b"), "extra")
    laid, counts = mixing.split_buckets(dealt, ["k", "b"], "p", bucket_rows)
    sizes = Counter((r["k"], r["b"], r["p"]) for r in laid.collect())
    assert sizes == {(r["k"], r["b"], r["p"]): r["__mix_rows"] for r in counts.collect()}
    assert max(sizes.values()) <= 2 * bucket_rows and sum(sizes.values()) == len(rows)
