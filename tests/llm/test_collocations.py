"""Phrase collocations against plain counting, with few buckets so that they collide."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spanforge.llm import collocations


def plain(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    many = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    found = collections.defaultdict(list)
    for (lang, w), a in many.items():
        if any(o == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), b in many.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, ps in found.items() for i, (s, a, p, left, right) in enumerate(sorted(ps)[:top], 1))


def texts(rng, n):
    words = ["the", "The", "cat", "dög", "sat", "on", "a", "mat", "New", "York", "Ünder", "e f"]
    set_phrases = ["New York City hall", "once upon a time there", "by and large"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append(rng.choice(set_phrases) if rng.random() < 0.2 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]))
        out.append(("".join(parts), rng.choice(["en", "en", "en", "de", None])))
    return out


@pytest.mark.parametrize(("least", "longest", "top", "buckets"), [(5, 5, 2000, 512), (2, 3, 7, 1 << 14), (40, 4, 50, 512), (1, 2, 2000, 4096)])
def test_as_plain_counting(spark, least, longest, top, buckets):
    rows = texts(random.Random(least), 150) + [(None, "en"), ("", None), (" ", "xx"), ("a b a b a b a b", "zz"), ("a b a b a b a b", "zz")]
    docs = spark.createDataFrame([(t, l, 1, "x") for t, l in rows], "text string, lang string, rank int, phrase string").repartition(3)
    got = collocations.collocations(docs, least, longest, top, buckets)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, longest, top)


def test_counts_sent_in_parts_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 20)
    monkeypatch.setattr(collocations, "MERGED", 2)
    rows = [*texts(random.Random(3), 60), ("so it goes " * 200_000, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    got = sorted(map(tuple, collocations.collocations(docs, 3, 4, 100, 512).collect()))
    assert got == plain(rows, 3, 4, 100)


def test_edges(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), 1).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        collocations.collocations(empty, buckets=1000)
    with pytest.raises(ValueError, match="least"):
        collocations.collocations(empty, least=1 << 20)


def test_pruning_leaves_few_phrases_to_count(spark):
    """Phrases of rare words, or in rare buckets, are never counted."""
    rng = random.Random(8)
    rows = [(" ".join(f"w{rng.randrange(400)}" for _ in range(50)) + " a fixed phrase of five", "en") for _ in range(100)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    text = collocations.Pieces(pa.array([t for t, _ in rows]), pa.array(["en"] * 100))
    hashes, n = np.unique(text.grams(text.runs(2), 2), return_counts=True)
    bucket_rows = docs.mapInArrow(collocations._pass(1, 5, 50, 1 << 14, "text", "lang", None, None), collocations.ROWS)
    bitmap, again = collocations._bitmaps([bucket_rows, bucket_rows], 50, 1 << 14)
    assert (bitmap == again).all()
    passed = collocations._has(bitmap, hashes)
    assert passed[n >= 50].all() and passed.sum() < 40 and len(hashes) > 3000
