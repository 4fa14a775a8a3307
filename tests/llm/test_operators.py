"""Each operator against a brute-force version or an exact round trip."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import chat, decontaminate, exact, exchange, graph, jaccard, lm, mixing, quality, queries, substring, tokens, warc

from ..oracle import both

VOCABULARY = [f"w{i}" for i in range(900)]


def stored(spark, tmp_path, rows, parts=4):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def some(rng, n, words=VOCABULARY):
    return [rng.choice(words) for _ in range(n)]


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        i, kind = rng.randrange(len(words) or 1), rng.random()
        if kind < 0.4 and words:
            words[i] = rng.choice(VOCABULARY)
        elif kind < 0.7:
            words.insert(i, rng.choice(VOCABULARY))
        elif words:
            words.pop(i)
    return words


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf, name):
    got, want = both(spark, sf, queries.QUERIES[name], queries.ORACLE[name])
    assert got == want


def test_trie_owns_the_best_and_spills():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(0, 9))) + bytes([rng.randrange(4)]) * rng.randrange(30) for _ in range(3000)]
    for budget in (1 << 20, 4000):
        trie, want = exact.Trie(budget), {}
        for i, k in enumerate(keys):
            value = (-rng.randrange(3), i, 1)
            trie.insert(k, value, None)
            old = want.get(k)
            want[k] = value if old is None else (*min(old[:2], value[:2]), old[2] + 1)
        assert {k: tuple(v) for k, v, _ in trie.items()} == want


def test_a_trie_spills_into_few_files(monkeypatch):
    """Thousands of lengths, long common beginnings and repeated strings over a tiny budget."""
    rng = random.Random(6)
    keys = [b"x" * k for k in range(5000)] + [b"same beginning " * 40 + bytes(rng.choices(b"abc", k=8)) for _ in range(3000)] + [b"", b"y" * 300_000, b"z" * 300_000]
    keys += rng.choices(keys, k=2000)
    rng.shuffle(keys)
    most, opened = 0, exact.open if hasattr(exact, "open") else open

    def counting(*args):
        nonlocal most
        most = max(most, len(os.listdir("/proc/self/fd")))
        return opened(*args)

    monkeypatch.setattr(exact, "open", counting, raising=False)
    before = len(os.listdir("/proc/self/fd"))
    trie, want = exact.Trie(256 << 10), {}
    for i, k in enumerate(keys):
        trie.insert(k, (-1, i, 1), None)
        old = want.get(k)
        want[k] = (-1, i, 1) if old is None else (-1, old[1], old[2] + 1)
    assert trie.turn > trie.FILES
    assert {k: tuple(v) for k, v, _ in trie.items()} == want and most - before < 300


def test_repeated_rows_and_reserved_names(spark):
    """A keeper's doc_id given twice with other columns, and columns named like the operator's own."""
    rows = [(1, "a b", "x", 1), (1, "a b", "w", 2), (2, "ab", "v", 3), (3, "c", "u", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _keep int")
    found = [sorted(map(tuple, exact.keep_exact(df.repartition(part)).collect())) for part in (1, 2, 4)]
    assert found[0] == found[1] == found[2] and [r[:2] for r in found[0]] == [(1, "a b"), (3, "c")]
    assert {r["doc_id"] for r in jaccard.keep_one(df).collect()} == {1, 2, 3}


def test_links_and_components(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    docs = []
    for n in (3, 5, 8, 15, 30, 80, 200):
        base = some(rng, n)
        docs += [base] + [edited(rng, base, rng.choice([0, 1, 2, max(1, n // 30)])) for _ in range(5)]
    base = some(rng, 150)
    docs += [base] + [edited(rng, base, rng.choice([1, 2, 4])) for _ in range(110)]  # a large group, unlinked members among them
    passage = some(rng, 60)
    docs += [passage + some(rng, rng.choice([4, 40])) for _ in range(40)]
    rng.shuffle(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    monkeypatch.setattr(jaccard, "FLUSH", 2000)
    frame = stored(spark, tmp_path, rows)
    for words, num, den in ((4, 85, 100), (5, 80, 100)):
        sets, parent = [], list(range(len(rows)))
        for _, t in rows:
            w = t.split()
            sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(rows)):
            for b in range(a):
                same = len(sets[a] & sets[b])
                if same and same * den >= num * (len(sets[a]) + len(sets[b]) - same):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame, words, num, den).collect()}
        assert got == {i: (len(sets[i]), root(i)) for i in range(len(rows))}


def test_sketch_blocks_agree():
    """Similar sets share as many block keys of a band as must agree, whatever their sizes."""
    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        b = jaccard.bands(num, den)
        for n in [*range(2, 40), 100, 500, 3000]:
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = (den - num) * n // den
            y = np.unique(np.concatenate((x[rng.permutation(len(x))[most // 2 :]], rng.integers(0, 1 << 63, most - most // 2, dtype=np.uint64))))
            same = len(np.intersect1d(x, y))
            if same * den >= num * (len(x) + len(y) - same) and len(x) + len(y) > 2 * same:
                shared = (np.intersect1d(jaccard.block_keys(x, b), jaccard.block_keys(y, b)) & jaccard._BAND).astype(int)
                assert any((shared == k).sum() >= b.spare[k] for k in set(shared.tolist()))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(300)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for x in nodes}


def test_repeats(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    passages = [some(rng, n) for n in (12, 13, 14, 20, 40)] + [["a"] * 30, ["a", "b"] * 12, ["a"] * 6 + ["q"] + ["a"] * 6]
    rows = []
    for i in range(150):
        d = []
        for _ in range(rng.randint(0, 5)):
            d += some(rng, rng.randint(0, 25)) if rng.random() < 0.5 else rng.choice(passages)
            d += some(rng, rng.randint(0, 20), ["a", "b"]) if rng.random() < 0.2 else []
        rows.append((i, " ".join(d)))
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = collections.Counter()
    for i, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    frame = stored(spark, tmp_path, rows)
    monkeypatch.setattr(exchange, "UNIT_BYTES", 3000)
    assert collections.Counter(map(tuple, substring.remove_repeats(frame).collect())) == want


def test_recompression_is_local():
    """A symbol whose words lie inside a passage is the same wherever the passage is."""
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 6, 40).astype(np.uint64)
    for rounds in (1, 2, 3):
        found = []
        for _ in range(2):
            before = rng.integers(0, 6, 17).astype(np.uint64)
            text = np.concatenate((before, passage, rng.integers(0, 6, 9).astype(np.uint64)))
            name, first, last, _ = substring.recompress(text, np.array([0, len(text)]), rounds)
            inside = (first >= 17) & (last <= 57)
            found.append(set(zip(name[inside].tolist(), (first[inside] - 17).tolist(), (last[inside] - 17).tolist(), strict=True)))
        assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_against_plain_counts(spark, sf, order):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    token = {d: [*re.findall(r"[^\x20\x09-\x0D]+", x.translate(lower)), "</end>"] for d, x in docs}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    uni, grams, total, kinds = (collections.Counter() for _ in range(4))
    before = lambda t, i, k: tuple((["<s>"] * k + t)[i : i + k])
    for d, t in token.items():
        if not out[d]:
            uni.update(t)
            grams.update((before(t, i, k), w) for i, w in enumerate(t) for k in range(1, order))
    for (a, _), n in grams.items():
        total[a] += n
        kinds[a] += 1
    n, v = sum(uni.values()), len(uni)
    step = lambda p: 10 ** (-0.05 * min(254, max(0, round(-math.log10(p) / 0.05))))
    better = base_sum = 0
    found = lm.score_texts(spark.read.parquet(f"{sf}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1, order)
    if order == 3:
        assert sorted(found.collect()) == sorted(queries.QUERIES["op4_lm_scoring"](spark, sf).collect())
    for r in found.collect():
        t = token[r["doc_id"]]
        own = [(uni[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        base = sum(map(math.log10, own))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(t), sum(uni[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        score = 0
        for i, (w, p) in enumerate(zip(t, own, strict=True)):
            for a in (before(t, i, k) for k in range(1, order)):
                if total[a]:
                    p = (step((grams[a, w] - 0.75) / total[a]) if grams[a, w] else 0) + step(0.75 * kinds[a] / total[a]) * p
            score += math.log10(min(p, 1))
        assert math.isclose(r["score"], score, rel_tol=1e-9)
        if r["held_out"]:
            better, base_sum = better + r["score"], base_sum + base
    assert better > base_sum or order == 1


def test_elias_fano():
    rng = np.random.default_rng(3)
    for universe in (1 << 32, 5000, 1 << 45):
        v = np.unique(rng.integers(0, universe, 3000, dtype=np.uint64))
        e = lm.EliasFano(v, universe)
        assert (e.get(np.arange(len(v))) == v).all()
        q = np.concatenate((v, rng.integers(0, universe, 3000, dtype=np.uint64)))
        at, found = e.successor(q)
        assert (found == np.isin(q, v)).all() and (at[found] == np.searchsorted(v, q[found])).all()


def test_squeezing():
    rng = np.random.default_rng(4)
    v = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    for a in (v, v[:0]):
        assert (exchange.expand_sorted(exchange.squeeze_sorted(a)) == a).all()
        assert exchange.parted(exchange.join([b"x", b"", a.tobytes()])) == [b"x", b"", a.tobytes()]


def test_prefix_token_counts():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), tokens.PrefixCounter(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ▁\n\tÅ日é<s>/ee the") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["the quick brown foxes", "</s><unk> x", "x" * 300]
    for t in texts:
        n, steps = counter.count(t)
        assert n == len(library.encode(t))
        counts = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        assert [tokens.count_at(steps, k) for k in range(len(t) + 1)] == counts
        for budget in (0, 3, 10):
            assert tokens.fits(steps, budget) == max((k for k, c in enumerate(counts) if c <= budget), default=0)


def test_token_counts_are_the_librarys(spark, sf, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_token_counts"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    rng = random.Random(2)
    for d, t in texts.items():
        r = got[d]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096)
        k = rng.randrange(len(t) + 1)
        assert tokens.count_at(r["steps"], k) == len(library.encode(t[:k])) and tokens.count_at(r["steps"], len(t)) == r["n_tokens"]
    counter = tokens.PrefixCounter(public.path("piece_bpe_32k.model"))
    monkeypatch.setattr(counter, "_counts", lambda segments: ((s, [0] * (len(s) + 1)) for s in segments))
    assert counter.count("some text")[0] == 0  # the counts are those of the programme


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op1_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_pairs_of_features_matter():
    """An exclusive-or of two features, which no sum over single features can tell."""
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    m = quality.fit(x[:2000], y[:2000], rounds=20)
    assert (2, 0) in m.pairs and ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_leaks_exact_edited_and_clean(spark, tmp_path):
    rng = random.Random(9)
    items = [(k, " ".join(some(rng, rng.randrange(20, 50)))) for k in range(6)]
    rows, want = [], set()
    for i in range(120):
        d = some(rng, 80)
        if i % 4 == 0:
            k = i // 4 % 6
            words = items[k][1].split()
            for _ in range(len(words) // 7 if i % 8 else 0):
                words[rng.randrange(len(words))] = "other"
            d[30:30] = [w.upper() + "," for w in words]
            want.add((i, k))
        rows.append((i, " ".join(d)))
    got = decontaminate.find_leaks(stored(spark, tmp_path, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(28 <= r["first_word"] <= 36 for r in got)


def test_leaks_in_hundreds_of_edited_copies(spark, tmp_path):
    rng = random.Random(10)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(40))) for k in range(3)]
    copies = {k: ["other" if j % 4 == 3 else w for j, w in enumerate(items[k][1].split())] for k in (0, 1)}
    rows = []
    for i in range(600):
        d = some(rng, 60)
        if i % 2:
            d[20:20] = copies[0]
        elif i % 100 == 0:
            d[20:20] = copies[1]
        elif i % 4 == 0:
            d[20:20] = items[2][1].split()[:6]  # a common phrase of an item is no copy of it
        rows.append((i, " ".join(d)))
    number = collections.defaultdict(lambda: len(number))
    plain = [(k, np.array([number[w] for w in text.split()])) for k, text in items]
    want = {}
    for i, text in rows:
        doc = np.array([number[w] for w in text.split()])
        for k, item in plain:
            score, lo, hi = decontaminate.align(item, doc)
            if score / len(item) >= 0.6:
                want[i, k] = (round(score / len(item), 9), lo, hi)
    assert len(want) == 306
    docs, bench = stored(spark, tmp_path, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["score"], 9), r["first_word"], r["last_word"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_every_passage_that_aligns_is_found(spark, tmp_path):
    """Copies with words put in, taken out, replaced or paraphrased by synonyms at every rate, common words among them, against the alignment of each
    item with each whole text."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(6)]
    items = [(k, " ".join(rng.choice(common) if rng.random() < 0.5 else f"i{k}x{j}" for j in range(n))) for k, n in enumerate((8, 9, 12, 20, 40, 40, 60))]
    items.append((7, " ".join(["la"] * 10)))
    rows = []
    for i in range(400):
        words, kind, rate = items[i % 7][1].split(), rng.randrange(4), rng.random() * 0.7
        if kind == 0:
            words = [x for w in words for x in ([w, *some(rng, rng.randrange(1, 4))] if rng.random() < rate else [w])]
        elif kind == 1:
            words = [w for w in words if rng.random() >= rate / 2]
        elif kind == 2:
            words = [rng.choice(VOCABULARY) if rng.random() < rate / 2 else w for w in words]
        else:
            words = [x for j, w in enumerate(words) for x in ([w, "foreign"] if j % 2 else [w])]
        around = lambda: [rng.choice(common + VOCABULARY[:20]) for _ in range(rng.randrange(40))]
        rows.append((i, " ".join([*around(), *words, *around()])))
    rows += [(400, "la " * 30), (401, "la " * 9), (402, " ".join(common * 200))]
    number = collections.defaultdict(lambda: len(number))
    plain = [(k, np.array([number[w] for w in text.split()])) for k, text in items]
    want = {}
    for i, text in rows:
        doc = np.array([number[w] for w in text.split()])
        for k, item in plain:
            score, _, _ = decontaminate.align(item, doc)
            if score / len(item) >= 0.6:
                want[i, k] = round(score / len(item), 9)
    docs, bench = stored(spark, tmp_path, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want and 200 < len(want) < 600
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_long_repetitive_text_needs_little_memory(monkeypatch):
    """A text of 1 MB of one word and an item of 100 times that word: hits are never rows, and go through in parts."""
    import tracemalloc

    import pyarrow as pa

    bench = decontaminate._words(pa.array(["ab " * 100, "ab cd " * 30]))
    seeds = decontaminate.Seeds([(k, bench.hash[bench.rows[k] : bench.rows[k + 1]].copy()) for k in range(2)])
    texts = decontaminate._words(pa.array(["ab " * 350_000, "x"]))
    tracemalloc.start()
    found = list(seeds.matches(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[:3] for f in found] == [(0, 0, 1.0)] and peak < 200 << 20
    whole = list(seeds.windows(texts))
    monkeypatch.setattr(decontaminate, "HITS", 5000)
    assert list(seeds.windows(texts)) == whole


def test_short_items_are_searched_whole(spark, tmp_path):
    """Items of one and two words, against plain search; they condemn documents only on request."""
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "one two three four"), (4, " "), (5, None)]
    texts = ["x alpha, y", "beta x gamma", "a BETA gamma. b", "gamma beta", "alpha", "beta", "one two three four", None, ""]
    docs = stored(spark, tmp_path, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"], r["first_word"], r["last_word"]) for r in decontaminate.find_leaks(docs, bench, least_words=1).collect()}
    assert got == {(0, 1, 1.0, 1, 2), (2, 2, 1.0, 1, 3), (4, 1, 1.0, 0, 1), (6, 3, 1.0, 0, 4)}
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == set(range(9)) - {6}
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench, least_words=1).collect()} == {1, 3, 5, 7, 8}


def test_alignment():
    def plain(a, b):
        h, best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -0.25), h[i - 1][j] - 0.25, h[i][j - 1] - 0.25)
                best = max(best, h[i][j])
        return best

    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 30))
        score, lo, hi = decontaminate.align(a, b)
        assert math.isclose(score, plain(a, b)) and 0 <= lo <= hi <= len(b)
        assert score == 0 or math.isclose(plain(a, b[lo:hi]), score)


def test_chat_round_trip(spark, sf):
    for s in ["[INST]", "\\[INST]", "\\\\</s> <<SYS>>", "[ROLE:x] [/ROLE]", "<s", "a\\", "[/INST] \\ [/INST]", ""]:
        assert chat.unescape(chat.escape(s)) == s
        for role in ("user", "assistant", "system", "we]ird", ""):
            assert [x[:2] for x in chat.parse_turns(chat.format_turn(role, s)[0])] == [(role, s)]
    conv = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        conv[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    conv[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.QUERIES["op3_chat_formatting"](spark, sf).collect()}
    assert got.keys() == conv.keys()
    for c, turns in conv.items():
        turns.sort()
        reply = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(reply), hashlib.sha256(reply.encode()).hexdigest())


@pytest.mark.parametrize("whole_context", [0, 60, 1 << 14])
def test_examples_hold_their_whole_context(spark, whole_context):
    turns = [(c, k, "assistant" if k % 2 else "user", f"text {k} [INST]") for c, n in ((1, 7), (2, 2), (3, 1), (4, 12)) for k in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat.expand_prefix_targets(df, whole_context)
    written = {(r["conv_id"], r["example_no"]): r for r in examples.collect()}
    length = collections.Counter()
    rows = chat.materialise(examples).collect()
    assert len(rows) == 3 + 1 + 0 + 6
    for r in rows:
        c, k = r["conv_id"], r["example_no"]
        assert [t[1] for t in chat.parse_turns(r["text"])] == [f"text {i} [INST]" for i in range(2 * k + 2)]
        assert chat.unescape(r["text"][r["loss_start"] : r["loss_end"]]) == f"text {2 * k + 1} [INST]"
        context = sum(len(chat.format_turn(role, text)[0]) for d, i, role, text in turns if d == c and i < 2 * k)
        assert written[c, k]["context_chars"] == (0 if context <= whole_context else context)
        assert written[c, k]["text"] == r["text"][written[c, k]["context_chars"] :]
        length[c] += len(r["text"])
    got = {r["conv_id"]: r for r in chat.read_back(examples, whole_context).collect()}
    assert {c: r["formatted_chars"] for c, r in got.items()} == {c: length[c] for c in (1, 2, 3, 4)}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 7, 2: 2, 3: 1, 4: 12}


def test_warc_segments_and_chunks():
    body = bytes(range(256)) * 700
    assert warc.dechunked(warc.chunked(body)) == body and warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    sha = hashlib.sha1(body).hexdigest()
    records = [x for one in warc.response_records(7, "u", body, sha, 5000) for x in warc.parse_records(one)]
    assert len(records) > 30 and [int(h["WARC-Segment-Number"]) for h, _ in records] == list(range(1, len(records) + 1))
    assert {h["WARC-Segment-Origin-ID"] for h, _ in records[1:]} == {warc.record_id(7, sha)}
    assert int(records[-1][0]["WARC-Segment-Total-Length"]) == sum(len(b) for _, b in records)
    for p in (0, 5, -3, (1 << 63) - 1, -(1 << 63), None):
        assert warc.page_of(warc.record_id(p, sha)) == p


def test_warc_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    big = {}
    for r in pages:
        big[r["html"] or ""] = max(big.get(r["html"] or "", -1), r["page_id"])
    got = {r["page_id"]: r for r in queries.QUERIES["op7_warc"](spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        body, g, first = (r["html"] or "").encode(), got[r["page_id"]], big[r["html"] or ""]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(body), warc.base32(hashlib.sha1(body).hexdigest()))
        assert (g["record_type"], g["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))


def test_a_missing_segment_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 100_000)], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w", segment_bytes=20_000, block_bytes=1)
    blocks = spark.read.parquet(f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 1
    lost = blocks.filter(~F.col("data").cast("string").contains("WARC-Segment-Number: 3"))
    assert lost.count() == blocks.count() - 1
    lost.write.parquet(f"{tmp_path}/lost")
    with pytest.raises(Exception, match="segment 3 is missing"):
        warc.read_archives(spark, f"{tmp_path}/lost").collect()


def test_targets_fill_up(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(1, "a"), (50, "b"), (2, "c"), (40, None), (7, "é")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    sizes, weights = [1, 50, 2, 7, 40], [1, 2, 3, 1, 2]
    target, left = [None] * 5, 100.0
    while True:
        open_ = [i for i in range(5) if target[i] is None]
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
    for want, doc in zip(target, (0, 1, 2, 4, 3), strict=True):
        assert math.isclose(got[doc]["target"], want, abs_tol=1e-5) and abs(got[doc]["taken"] - want) <= 1


def test_every_pass_follows_the_curriculum(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 9)), s) for i, s in enumerate("a" * 150 + "b" * 20 + "c" * 12 + "d" * 90 + "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.schedule(df).collect()
    places = [(r["position"] is None, r["position"] or 0.0) for r in got]
    assert places == sorted(places)
    first = {r["doc_id"]: r.asDict() for r in mixing.mix(df).collect()}
    assert {r["doc_id"]: {k: r[k] for k in first[0]} for r in got if r["pass"] == 0} == first
    found = collections.defaultdict(dict)
    for r in got:
        assert r["pass"] not in found[r["doc_id"]]
        found[r["doc_id"]][r["pass"]] = (r["words"], r["position"])
    passes = set()
    for rank, source in enumerate("abcde"):
        docs = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, text.count("w")) for i, text, s in rows if s == source)
        target, (a, b), at = first[docs[0][1]]["target"], mixing.PACE[rank % 3], 0
        goal = round(target)
        for p in range(4):
            for _, i, size in docs:
                words = min(size, goal - at)
                if words > 0:
                    lo, hi = 0.0, 1.0  # the time at which the integral of the pace reaches this word
                    for _ in range(60):
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if target * (a * mid + (b - a) * mid * mid / 2) / ((a + b) / 2) < at else (lo, mid)
                    n, position = found[i].pop(p)
                    assert n == words and math.isclose(position, lo, abs_tol=1e-6)
                    passes.add(p)
                    at += words
        assert at == goal
    assert passes == {0, 1, 2}
    assert all(left in ({}, {0: (0, None)}) for left in found.values())


def test_the_pipeline_places_every_pass(spark):
    df = spark.createDataFrame([(i, "w " * 10, "en", "a" if i < 2 else "b", 0) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = [r for r in corpus_pipeline.mixing_stage(spark, df, "").collect() if r["doc_id"] < 2]
    assert {r["target"] for r in rows} == {60.0} and sum(r["words"] for r in rows) == 60
    assert [round(r["position"], 6) for r in rows] == [round(k / 6, 6) for k in range(6)]


@pytest.mark.parametrize("whole", [1024, 20])
def test_pairs_grow_with_a_group_and_not_with_its_square(spark, tmp_path, monkeypatch, whole):
    """Two groups of near copies on one template, whose members all share buckets."""
    monkeypatch.setattr(jaccard, "WHOLE", whole)
    counted, verified = [], jaccard._Search.verified

    def counting(self, pairs, star=False):
        counted.append(pairs.distinct().count())
        return verified(self, pairs, star)

    monkeypatch.setattr(jaccard._Search, "verified", counting)
    rng = random.Random(8)
    template, own = some(rng, 200), [[f"{c}{k}" for k in range(60)] for c in "ab"]
    found = {}
    for size in (24, 48):
        rows = [(2 * i + c, " ".join(template + edited(rng, own[c], 2))) for i in range(size) for c in (0, 1)]
        counted.clear()
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(stored(spark, tmp_path, rows), 5, 80, 100).collect()}
        assert got == {i: i % 2 for i, _ in rows}
        found[size] = sum(counted)
    assert found[48] < 3 * found[24] and found[48] < 12 * 96
