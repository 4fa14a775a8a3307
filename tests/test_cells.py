"""Work on all pairs goes by blocks, and a table is not copied once a few rows."""

import numpy as np

from spanforge.operators import graph as G


def some(spark, n=90):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, int(i % 3), rng.normal(size=4).tolist()) for i in range(n)], "row_idx long, label int, vec array<double>")


def test_blocks_of_anchors_do_not_shrink_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(G, "KEPT", 90)  # one anchor's distances at a time
    assert G.mine_all(some(spark), 0.1).rdd.getNumPartitions() == 1


def test_pairwise_goes_by_cells(spark):
    df = some(spark).unionByName(spark.createDataFrame([(90, None, [0.0] * 4), (91, 1, None)], "row_idx long, label int, vec array<double>"))
    found = G.pairwise_squared(df, 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    rows = {r["row_idx"]: (r["label"], np.array(r["vec"])) for r in df.filter("vec IS NOT NULL").collect()}
    got = {(r["i"], r["j"]): (r["same"], r["d"]) for r in found.collect()}
    assert got.keys() == {(i, j) for i in rows for j in rows if i != j} and found.count() == len(got)
    for (i, j), (same, d) in got.items():
        assert same == (None if 90 in (i, j) else rows[i][0] == rows[j][0]) and abs(d - ((rows[i][1] - rows[j][1]) ** 2).sum()) < 1e-12


def test_gdst_is_over_all_pairs(spark, tmp_path):
    import duckdb

    from spanforge.plans import registry

    con = duckdb.connect()
    con.execute("SELECT setseed(0.5)")
    con.execute(f"COPY (SELECT i::BIGINT AS vec_id, list_transform(range(64), lambda k: (hash(i * 64 + k) % 1000 / 1000.0)::FLOAT) AS embedding, 1 AS label FROM range(300) t(i)) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"COPY (SELECT i::BIGINT AS event_id, (i % 40 // 38)::BIGINT AS user_id, 'a' AS event_type, (i % 17)::DOUBLE AS value, TIMESTAMP '2024-01-01' + to_seconds(i * 6737) AS ts FROM range(300) t(i)) TO '{tmp_path}/events.parquet'")
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    from spanforge.operators.embedding_stats import gdst_all
    from spanforge.plans import views

    want = con.execute(registry.ORACLE["gdst"]).fetchone()
    assert tuple(registry.QUERIES["gdst"](spark, str(tmp_path)).first()) == want
    small = gdst_all(views.vec_iv(spark, str(tmp_path)), 32).first()
    assert want[0] > 20_000 and small[0] == want[0] and abs(small[1] - want[1]) < 1e-6 and abs(small[2] - want[2]) < 1e-6
    assert tuple(gdst_all(views.vec_iv(spark, str(tmp_path)).filter("false")).first()) == (0, None, None)


def test_examples_have_one_form_at_any_length(spark):
    from spanforge.llm import chat

    turns = [(c, k, ("user", "assistant")[k % 2], "x" * n) for c, n in ((1, 5), (2, 9000)) for k in range(8)]
    rows = chat.expand_prefix_targets(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for c in (1, 2):
        before = 0
        for r in sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["example_no"]):
            assert r["context_chars"] == before
            before += len(r["text"])


def test_a_key_of_many_rows_is_not_one_task(spark):
    from pyspark.sql import functions as F

    from spanforge.operators.joins import upper_pairs

    df = spark.range(200).select("id", F.lit(1).alias("k")).unionByName(spark.createDataFrame([(None, 1), (5, None)], "id long, k int"))
    found = upper_pairs(df, "id", "k", block=20)
    assert sorted((r["a_id"], r["b_id"]) for r in found.collect()) == [(i, j) for i in range(200) for j in range(i + 1, 200)]
    assert "__own" in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_in_small_pieces(spark, monkeypatch):
    import numpy as np

    from spanforge.operators import knn as K

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 5)).round(1)
    v[100:140] = v[3]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "id long, vec array<double>")
    for metric in ("l2", "ip"):
        score = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) if metric == "l2" else -(v @ v.T), 9)
        want = {(i, r + 1, j) for i in range(300) for r, j in enumerate([j for j in np.lexsort((np.arange(300), score[i])).tolist() if j != i][:7])}
        best = K._Best(np.arange(300), v, 7, metric, True)
        for lo in range(0, 300, 37):
            best._add(np.arange(lo, min(lo + 37, 300)), v[lo : lo + 37])
        assert {(i, r + 1, int(j)) for i in range(300) for r, j in enumerate(best.found[i])} == want
        assert {(r["query"], r["rank"], r["found"]) for r in K.knn(df, df, 7, metric, skip_self=True).collect()} == want


def test_two_blocks_of_all_pairs_meet_once(spark, monkeypatch):
    from spanforge.operators import graph as G

    made, square = [], G.square
    monkeypatch.setattr(G, "square", lambda *a: made.append(square(*a)) or made[-1])
    df = spark.createDataFrame([(i % 190, i % 3 or None, [float(i % 7), 1.0]) for i in range(200)], "row_idx long, label int, vec array<double>")
    found = G.pairwise_squared(df, block=20).collect()
    want = [(i % 190, j % 190, None if not (i % 3 and j % 3) else i % 3 == j % 3, float((i % 7 - j % 7) ** 2)) for i in range(200) for j in range(200) if i % 190 != j % 190]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert made[0].count() == 200 * 10 and made[0].select("__p", "__q").distinct().count() == 55
