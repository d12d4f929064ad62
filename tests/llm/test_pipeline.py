import corpus_pipeline

import __spark_entry__
from tests.conftest import SMALL


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline_runs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "piece_ids", "piece_parity"]
    rows = out.collect()
    assert rows and all(r["piece_parity"] for r in rows)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}


def test_tables_on_the_way_are_removed(spark):
    from quantloom.llm import common

    before = list(common._made)
    out = corpus_pipeline.run(spark, SMALL)
    left = [p for p in common._made if p not in before]
    assert len(left) == 1 and "stage-mixing" in left[0] and out.count() > 0


def test_stages_leave_only_what_their_results_read(spark):
    from quantloom.llm import common

    docs, stages = spark.read.parquet(f"{SMALL}/documents.parquet"), dict(corpus_pipeline.STAGES)
    wanted = {"toxicity": [], "line_dedup": ["line-cut", "line-texts"], "near_dedup": ["near-kept", "near-texts"]}
    for name, tables in wanted.items():
        before = len(common._made)
        out = stages[name](spark, docs, SMALL)
        left = [p.split("/")[-1].rpartition("-")[0] for p in common._made[before:]]
        assert sorted(left) == tables and out.count() > 0


def test_each_stage_is_what_a_plain_version_gives(spark):
    """On the smallest documents, every stage after the other, each on what its predecessor gave."""
    from collections import Counter

    import public_tokenizers
    import sentencepiece

    from tests.llm import test_operators as plain

    docs, stages = spark.read.parquet(f"{SMALL}/documents.parquet"), dict(corpus_pipeline.STAGES)
    given = docs.collect()

    # toxicity: the scores of the trained model by plain arithmetic
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = corpus_pipeline.train(docs, labels)

    def chance(text):
        words = Counter(f for w in (text or "").lower().split() for f in plain.toxicity.word_features(w) if f in model.weights)
        x = sum(model.weights[f] * (1 + plain.np.log(n)) for f, n in words.items())
        return 1 / (1 + plain.np.exp(model.thresholds[0] - x))

    clean = common_table(stages["toxicity"](spark, docs, SMALL), "t-toxicity")
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in given if chance(r["text"]) < corpus_pipeline.REJECT)

    # line dedup: all windows of three lines, and shorter ones of fifty words, by their text
    lined = common_table(stages["line_dedup"](spark, clean, SMALL), "t-lines")
    seen, want = set(), {}
    for r in sorted(clean.collect(), key=lambda r: r["doc_id"]):
        lines = (r["text"] or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r\v\f")]
        bare, drop = [lines[i].strip(" \t\r\v\f") for i in at], set()
        for size in (1, 2, 3):
            for i in range(len(at) - size + 1):
                window = (size, *bare[i:i + size])
                if size == 3 or sum(len(x.encode().split()) for x in window[1:]) >= corpus_pipeline.LONG_WORDS:
                    if window in seen:
                        drop |= set(at[i:i + size])
                    seen.add(window)
        left = "\n".join(x for i, x in enumerate(lines) if i not in drop)
        if not drop or left.strip(" \t\n\v\f\r"):
            want[r["doc_id"]] = left if r["text"] is not None else None
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == want

    # near dedup: all pairs by Jaccard
    near = common_table(stages["near_dedup"](spark, lined, SMALL), "t-near")
    ids, groups = sorted(want), {}
    sets = {k: plain.plain_shingles(want[k], 5) for k in ids}
    for n, k in enumerate(ids):
        groups[k] = k
        for j in ids[:n]:
            if sets[j] == sets[k] or 10 * len(sets[j] & sets[k]) >= 8 * len(sets[j] | sets[k]):
                low, high = sorted((groups[j], groups[k]))
                groups = {x: low if g == high else g for x, g in groups.items()}
    assert sorted(r["doc_id"] for r in near.collect()) == [k for k in ids if groups[k] == k]

    # mixing: whole copies at the source's rate
    mixed = common_table(stages["mixing"](spark, near, SMALL), "t-mixed")
    plan = {r["doc_id"]: r["mix_copies"] for r in corpus_pipeline.mix(near).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == {k: n for k, n in plan.items() if n}
    by_source = {}
    for r in corpus_pipeline.mix(near).collect():
        by_source.setdefault(r["source"], []).append((r["mix_size"], r["mix_copies"], r["mix_target"]))
    assert all(n <= 3 for rows in by_source.values() for _, n, _ in rows)
    assert all(abs(sum(n for _, n, _ in rows) - len(rows) * rows[0][2] / max(1, sum(s for s, _, _ in rows))) < 1 for rows in by_source.values())

    # pieces: the ids of the other library
    judge = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = stages["sentencepiece"](spark, mixed, SMALL).collect()
    assert len(rows) == sum(plan.values()) and all(r["piece_ids"] == judge.encode(r["text"] or "") for r in rows)


def common_table(df, name):
    from quantloom.llm.common import materialize

    return materialize(df, name)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_queries_match_sql(spark, duck):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("op5_chat_tree", "op6_mixing", "op9_line_dedup"):
        got = queries[name](spark, SMALL).toPandas()
        want = duck.sql(sql[name]).df()[list(got.columns)]
        keys = list(got.columns)
        assert got.sort_values(keys).values.tolist() == want.sort_values(keys).values.tolist(), name
