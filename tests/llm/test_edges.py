"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import chat, decontaminate, exact, jaccard, lm, mixing, quality, substring, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, sha string, n long, rank int, part int, key string, level double, component_id long"
LONG = " ".join(f"w{i % 977}" for i in range(120_000))


def documents(spark, tmp_path, name="d", empty=False):
    rows = [
        (1, "a b c d e f g h", "en", "s"), (2, "a b c d e f g h", "en", "s"), (3, "a  b\tc d e f\ng h", "en", None), (3, "a  b\tc d e f\ng h", "en", None),
        (4, None, None, None), (5, "", "en", "t"), (6, " \t\n", "en", "t"), (7, LONG, "en", "s"), (8, LONG + " x", "de", "u"), (None, "a b c d e f g h", "en", "s"), (None, None, None, None),
        (9, "É ß 日本   x", "fr", "t"), (10, "one", "en", "s"), (11, "one", "en", "ß"),
    ]
    full = [(*r, len(r[1] or ""), 1, 0.5, "x", 2, 3, 4, "k", 1.0, 5) for r in rows]
    spark.createDataFrame([] if empty else full, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def labels(spark, n=60):
    return spark.createDataFrame([(i, i % 2, None, "x") for i in range(n)] + [(None, 1, 0, "x"), (3, None, 0, "x")], "doc_id long, quality int, toxic int, text string")


def benchmark(spark):
    return spark.createDataFrame([(1, "b c d e f g", "x"), (2, None, "x"), (3, "", "x"), (None, "q r s t u v w", "x"), (4, "one", "x")], "item_id long, text string, doc_id string")


@pytest.fixture
def model(spark, tmp_path):
    return quality.train(documents(spark, tmp_path), labels(spark))


OPERATORS = {
    "quality": lambda s, d, m: quality.score_quality(d, m),
    "mixing": lambda s, d, m: mixing.mix(d),
    "lm": lambda s, d, m: lm.score_texts(d, F.col("doc_id") % 5 == 1),
    "exact": lambda s, d, m: exact.exact_dedup(d),
    "leaks": lambda s, d, m: decontaminate.find_leaks(d, benchmark(s)),
    "substring": lambda s, d, m: substring.remove_repeats(d, width=5),
    "jaccard": lambda s, d, m: jaccard.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, tmp_path, model, name):
    full = OPERATORS[name](spark, documents(spark, tmp_path), model)
    rows = full.collect()
    if name != "leaks":
        assert len(rows) == 14
    none = OPERATORS[name](spark, documents(spark, tmp_path, "none", empty=True), model)
    assert none.columns == full.columns and none.count() == 0
    if name == "jaccard":
        got = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 10}
        assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    if name == "exact":
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] is not None}
        assert got[1] == got[2] == got[3] == (3, 5) or got[1] == (1, 5)
        assert got[4] == got[5] == got[6] == (6, 4) and got[10] == got[11] == (10, 2)
    if name == "leaks":
        assert sorted({(r["doc_id"], r["item_id"]) for r in rows}, key=str) == sorted({(i, 1) for i in (None, 1, 2, 3)}, key=str)
    if name == "lm":
        empty = next(r for r in rows if r["doc_id"] == 5)
        assert empty["n_tokens"] == 1 and empty["n_known"] == 1
    if name == "substring":
        assert {r["doc_id"]: r["n_removed"] for r in rows if r["doc_id"] in (1, 2, 5, 7)} == {1: 0, 2: 8, 5: 0, 7: 0}
    if name == "mixing":
        sizes = {r["doc_id"]: r["size"] for r in rows}
        assert sizes[5] == 0 and sizes[7] == 120_000 and all(r["taken"] <= 3 * r["size"] for r in rows)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, stage):
    sf = str(tmp_path / "sf")
    labels(spark).write.parquet(f"{sf}/labels.parquet")
    benchmark(spark).write.parquet(f"{sf}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    for empty in (False, True):
        docs = documents(spark, tmp_path, f"d{empty}", empty)
        out = run(spark, docs, sf)
        rows = out.collect()
        assert not (empty and rows)
        if stage != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if stage == "exact dedup" and not empty:
            assert sorted((r["doc_id"] for r in rows), key=str) == [10, 3, 6, 7, 8, 9] and len(rows) == 6
        if stage == "n-gram Jaccard join" and not empty:
            assert {r["doc_id"] for r in rows} == {1, 4, 5, 6, 7, 9, 10, None}
        if stage == "benchmark decontamination" and not empty:
            assert {r["doc_id"] for r in rows} == {4, 5, 6, 7, 8, 9, 10, 11, None}


def test_training_without_labels(spark, tmp_path):
    docs = documents(spark, tmp_path)
    for some in (labels(spark).filter("false"), labels(spark).filter("quality = 1")):
        scores = [r["score"] for r in quality.score_quality(docs, quality.train(docs, some)).collect()]
        assert len(set(scores)) == 1 and 0 <= scores[0] <= 1


def test_no_benchmark(spark, tmp_path):
    docs = documents(spark, tmp_path)
    none = benchmark(spark).filter("text IS NULL OR text = ''")
    assert decontaminate.find_leaks(docs, none).count() == 0 and decontaminate.keep_clean(docs, none).count() == 14


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, segment string, example_no long"
    rows = [(1, 1, "assistant", "x", "?", 1), (1, 0, "user", None, "?", 1), (1, 1, "assistant", "x", "?", 1), (2, None, None, "a", "?", 1), (2, 3, "tool", "[/ROLE]", "?", 1), (None, 0, "assistant", "", "?", 1), (3, 0, "user", "u" * 3_000_000, "?", 1), (3, 1, "assistant", "v", "?", 1)]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand_prefix_targets(df)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"], r["n_examples"]) for k, r in got.items()} == {1: (3, 2, 2), 2: (2, 0, 0), None: (1, 0, 1), 3: (2, 1, 1)}
    assert chat.read_back(chat.expand_prefix_targets(df.filter("false"))).count() == 0


def test_pages(spark):
    """A record and a row a page row, repeated ones too."""
    rows = [(1, "u", "x" * 200_000, "?"), (2, "u", "x" * 200_000, "?"), (2, "u", "x" * 200_000, "?"), (2, "v", "x" * 200_000, "?"), (2, None, "x" * 200_000, "?"), (1, "u", "x" * 200_000, "?"), (3, None, None, "?"), (4, "u\r\nX: 1", "", "?"), (None, "u", "é" * 50_000, "?"), (None, None, "é" * 50_000, "?"), (None, None, "é" * 50_000, "?"), (-5, "u", "z", "?")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=repr)
    want = [(1, 200_000, "revisit", 2)] * 2 + [(2, 200_000, "response", None)] + [(2, 200_000, "revisit", 2)] * 3 + [(3, 0, "revisit", 4), (4, 0, "response", None), (-5, 1, "response", None)]
    assert got == sorted([*want, (None, 100_000, "response", None), *[(None, 100_000, "revisit", None)] * 2], key=repr)
    path = warc.shared_path(spark, "ids")
    warc.write_archives(df, path)
    heads = [h for r in spark.read.parquet(path).collect() for h, _ in warc.parse_records(bytes(r["data"]))]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads)
    assert warc.round_trip(df.filter("false")).count() == 0


def test_token_counts(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    docs = documents(spark, tmp_path)
    rows = tokens.prefix_token_counts(docs, path).collect()
    assert len(rows) == 14 and {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {0}
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)
    assert tokens.prefix_token_counts(docs.filter("false"), path).count() == 0
