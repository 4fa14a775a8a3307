"""The pipeline against a plain version of its later stages, on documents with planted cases."""

import random

import corpus_pipeline
from spanforge.llm import quality
from spanforge.llm.common import table

WORDS = [f"word{i}" for i in range(3000)]


def write(spark, path):
    rng = random.Random(11)
    items = [" ".join(rng.choices(WORDS, k=30)) for _ in range(4)]
    docs, labels, clean = [], [], set()
    for i in range(240):
        good = i % 6 != 0
        words = rng.choices(WORDS, k=rng.randrange(60, 120))
        text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) if good else " ".join(w.upper() + "!!" for w in words[:12] * 6)
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(good), 0))
        if good:
            clean.add(i)
    base = docs[1][1]
    docs += [(1000, base.replace(". ", ".  "), "en", "s0", 0), (1001, base, "en", "s1", 0)]
    near = docs[2][1].split()
    docs += [(2000 + k, " ".join([*near[:20], f"new{k}", *near[21:]]), "en", "s2", 0) for k in range(5)]
    docs.append((3000, docs[3][1] + " " + items[2], "en", "s3", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return clean


def test_pipeline(spark, tmp_path):
    clean = write(spark, tmp_path)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = set(got)
    assert kept & {i for i in range(240) if i % 6 == 0} == set()  # rejected by quality
    assert kept & {1, 1000, 1001} == {1000}  # most code points stay
    assert kept & {2, 2000, 2001, 2002, 2003, 2004} == {2}
    assert 3000 not in kept  # leaks, if it is not already a near copy of 3
    assert clean - {1, 3} <= kept
    source = {r["doc_id"]: r["source"] for r in table(spark, str(tmp_path), "documents").collect()}
    taken, target = {}, {}
    for i, r in got.items():
        assert r["taken"] <= 3 * r["size"]
        taken[source[i]] = taken.get(source[i], 0) + r["taken"]
        target[source[i]] = r["target"]
    assert all(abs(target[s] - taken[s]) <= 1 for s in taken)
    assert abs(sum(target.values()) - sum(r["size"] for r in got.values())) < 0.01


def test_stages_keep_what_they_are_given(spark, tmp_path):
    write(spark, tmp_path)
    docs = table(spark, str(tmp_path), "documents")
    good = dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, str(tmp_path))
    model = quality.train(docs, table(spark, str(tmp_path), "labels"))
    want = {r["doc_id"] for r in quality.score_quality(docs, model).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
