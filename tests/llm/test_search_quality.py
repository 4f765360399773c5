import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import neighbours, quality

SCHEMA = "vec_id long, embedding array<float>, rank int"


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((900, 24)).astype(np.float32)
    vectors[100:140] = vectors[0]  # ties at distance 0
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1100, [], 1), (1200, [0.0] * 24, 1), (1300, [float("nan")] + [1.0] * 23, 1), (1400, [None] + [1.0] * 23, 1), (None, [1.0] * 24, 1), (1500, [1.0, 2.0], 1), (1600, [1.0, 2.5], 1)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {*range(0, 900, 100), 1500, 1600}
    assert by[1500] == [(1, 1600, pytest.approx(0.5))]
    hit = 0
    wide = vectors.astype(np.float64)
    for q in range(0, 900, 100):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        order = sorted((x for x in range(900) if x != q), key=lambda x: (d[x], x))[:10]
        mine = sorted(by[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(order))
    assert hit >= 0.97 * 90
    assert [v for _, v, _ in sorted(by[0])] == list(range(100, 110))


def test_stopping_saves_work_on_clusters():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32)) * 20
    points = (centres[:, None, :] + rng.standard_normal((40, 100, 32))).reshape(-1, 32)
    projection = np.random.default_rng(3).standard_normal((32, 8))
    tree = neighbours.KdTree(points @ projection, 32)
    assert sorted(tree.order.tolist()) == list(range(4000)) and (tree.last - tree.first).max() <= 32 and (tree.last[:-1] == tree.first[1:]).all()
    gap = tree.gaps((points @ projection)[:50])
    for k, (a, b) in enumerate(zip(tree.first, tree.last, strict=True)):  # boxes are never farther than their points
        d = (((points @ projection)[tree.order[a:b]][None] - (points @ projection)[:50, None]) ** 2).sum(axis=2).min(axis=1)
        assert (gap[:, k] <= d + 1e-9).all()
    block = neighbours.Block(np.arange(4000), points, projection)
    asked = np.arange(0, 4000, 50)
    qs, ids, scores = block.search(asked, points[asked], 10, 0.95)
    hit = 0
    for q in asked:
        d = ((points - points[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        order = np.lexsort((np.arange(4000), d))[:10]
        hit += len(set(ids[qs == q].tolist()) & set(order.tolist()))
        assert np.allclose(np.sqrt(d[ids[qs == q]]), scores[qs == q], rtol=0, atol=1e-12)
    assert hit >= 0.95 * 10 * len(asked)
    assert block.verified < 0.4 * 4000 * len(asked)


def test_recall_of_the_query(spark):
    """The registered query against brute force over all rows of the table."""
    from tessitura.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    got = QUERIES["op4_neighbours"](spark, sf).collect()
    hit = asked = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == ids[q])
        assert [r for r, _ in mine] == list(range(1, 11))
        hit, asked = hit + len({i for _, i in mine} & set(best)), asked + 10
    assert asked == len(got) and hit >= 0.9 * asked


def test_chi_square():
    assert neighbours.chi_square_cdf(neighbours.chi_square_quantile(0.95, 16), 16) == pytest.approx(0.95)
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))


def test_no_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


DOCS = "doc_id long, text string, lang string, source string, score double"


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    known = labels.where("doc_id % 3 <> 0")
    model = quality.fit(docs, known)
    scored = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = [(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in scored]
    assert len(right) > 100 and np.mean(right) > 0.97
    again = quality.fit(docs.repartition(5), known)
    assert all(np.array_equal(getattr(model, n), getattr(again, n)) for n in ("content", "metadata", "combine"))


def test_quality_odd_rows(spark):
    rows = [(i, ("good text here. " if i % 2 else "@@@ ### $$$ ") * (1 + i % 5), "en", "s", 0.5) for i in range(60)]
    rows += [(None, None, None, None, None), (100, "", "en", None, 1.0), (100, "", "en", None, 1.0), (101, "x" * 200_000, None, "s", 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (7, None), (999, 0), (8, 5)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(60) if i % 2} <= ids and not ids & {i for i in range(60) if i % 2 == 0}
    assert quality.score(docs.limit(0), model).count() == 0
    for few in (labels.where("quality = 1"), labels.limit(0)):
        assert {r.score for r in quality.score(docs, quality.fit(docs, few)).collect()} == {0.5}
    none = quality.fit(docs.limit(0), labels)
    assert quality.keep_good(docs, none).count() == len(rows) and quality.keep_good(docs.limit(0), none).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([("a text", "en", "s", 1, "x"), (None, None, None, None, None)], "text string, lang string, source string, quality_text int, `quality.lang` string")
    model = quality.Model(np.zeros(quality.CONTENT + 1), np.zeros(quality.META + 1), np.zeros(quality.META), np.ones(quality.META), np.array([0, 0, 1.0]))
    assert sorted(map(str, quality.keep_good(docs, model).collect())) == sorted(map(str, docs.collect()))


def plain_co_train(docs, known, rounds, hand_over, sample_of, held_of):
    """Co-training as a plain loop over lists: who is handed what, and the fits after each round."""
    feats = {i: tuple(x[0].astype(np.float32) for x in quality._features([t], [lang], [source])) for i, t, lang, source in docs}
    fit_ids = [i for i in sorted(feats) if i in sample_of]
    train = [i for i in fit_ids if not held_of[i]]
    mean = np.mean([feats[i][1] for i in train], axis=0)
    dev = np.std([feats[i][1] for i in train], axis=0) + 1e-3
    view = lambda i, me: feats[i][0] if me == 0 else (feats[i][1] - mean) / dev
    pool = [i for i in sorted(feats) if i not in known]
    taught = [{}, {}]

    def refit(me):
        ids = [*train, *sorted(taught[me])]
        ys = [known[i] for i in train] + [taught[me][i] for i in sorted(taught[me])]
        return quality.fit_logistic(np.array([view(i, me) for i in ids]), np.array(ys), np.array([1.0] * len(train) + [0.5] * len(taught[me])))

    w = [refit(0), refit(1)]
    goods = round(hand_over * float(np.mean([known[i] for i in train])))
    for _ in range(rounds):
        before = [dict(t) for t in taught]
        for me in (0, 1):
            p = {i: float(quality.sigmoid(quality.logit(w[me], view(i, me)[None]))[0]) for i in pool}
            for c, n in ((0, hand_over - goods), (1, goods)):
                ranked = sorted(pool, key=lambda i: (-(p[i] if c else 1 - p[i]), i))
                fresh_ones = [i for i in ranked if (p[i] if c else 1 - p[i]) >= quality.CONFIDENT and i not in taught[1 - me]]
                taught[1 - me].update(dict.fromkeys(fresh_ones[:n], c))
        w = [refit(0), refit(1)]
        if taught == before:
            break
    return w, view, taught


def test_against_a_plain_loop(spark):
    """The two views' decisions and weights equal those of the plain loop, over every document."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in table.select("doc_id", "text", "lang", "source").collect()]
    known = {i: int("@" in (t or "") or len(t or "") % 3 > 0) for i, t, _, _ in docs if i % 3 == 0}
    labels = spark.createDataFrame(list(known.items()), "doc_id long, quality int")
    model = quality.fit(table, labels, rounds=3, hand_over=10)
    marks = {r.doc_id: r.h for r in labels.select("doc_id", (F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(quality.HELD_OUT)) == 0).alias("h")).collect()}
    w, view, taught = plain_co_train(docs, known, 3, 10, set(known), marks)
    assert any(taught)
    # calibrated weights are the plain ones times a slope, and a constant
    for me, mine in ((0, model.content), (1, model.metadata)):
        slope = float(mine[:-1] @ w[me][:-1] / (w[me][:-1] @ w[me][:-1]))
        assert slope > 0 and np.allclose(mine[:-1], slope * w[me][:-1], rtol=1e-3, atol=1e-4)
    scored = quality.score(table, model).collect()
    order = sorted(scored, key=lambda r: (r.content_score, r.doc_id))
    plain = {i: float(quality.logit(w[0], view(i, 0)[None])[0]) for i, *_ in docs}
    gaps = [plain[b.doc_id] - plain[a.doc_id] for a, b in zip(order, order[1:], strict=False)]
    assert min(gaps) > -1e-2


def test_views_teach_each_other():
    rng = np.random.default_rng(4)
    n = 2000
    y = rng.integers(0, 2, n)
    content = (rng.standard_normal((n, 20)) + y[:, None] * 0.9).astype(np.float32)
    metadata = (rng.standard_normal((n, 10)) + y[:, None] * 0.9).astype(np.float32)
    known, test = np.arange(60), np.arange(1000, n)

    def surest(model, wanted):
        pool = np.arange(60, 1000)
        p = quality.sigmoid(model.views(content[pool], metadata[pool]))
        sure = {(me, c): p[:, me] if c else 1 - p[:, me] for me, c in wanted}
        return {k: [(int(pool[i]), content[pool[i]], metadata[pool[i]], sure[k][i]) for i in np.argsort(-sure[k], kind="stable")[:m]] for k, m in wanted.items()}

    right = lambda m: float(((m.score(content[test], metadata[test]) >= 0.5) == (y[test] == 1)).mean())
    alone, taught = (right(quality.co_train(content[known], metadata[known], y[known], known % 5 == 0, surest, r, 50)) for r in (0, 4))
    assert taught > 0.9 and taught >= alone - 0.02
