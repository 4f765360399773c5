import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessitura.llm import mixing, sharding


def jump(key, shards):
    """The published loop."""
    key %= 2**64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 100, 5000])
def test_jump_hash(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 256, 12345678901, *range(1000, 1150)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(sharding.jump_hash(F.col("k"), shards)).collect()
    assert [r[0] for r in got] == [jump(k, shards) for k in keys]


def test_published_value(spark):
    assert spark.range(1).select(sharding.jump_hash(F.lit(256).cast("long"), 1024)).first()[0] == jump(256, 1024) == 520


def test_shards(spark):
    rows = [(i, f"text {i}é", "a", 1) for i in range(400)] + [(7, None, "a", 1), (None, "", "b", 2), (7, None, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SHARD string, slot int")
    got = sharding.shard(df, 8, grown=9).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"SHARD", "slot", "_shard", "_slot", "grown_shard"}
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert r.grown_shard in (r["_shard"], 8)
        if r.doc_id is not None:
            assert r["_shard"] == jump(r.doc_id, 8)
    for s, n in Counter(r["_shard"] for r in got).items():
        assert sorted(r["_slot"] for r in got if r["_shard"] == s) == list(range(n))
    assert sharding.shard(df.limit(0), 8).count() == 0


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by the rule itself: reshare what is over the caps until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
        free -= over
    return out


def words(n):
    return " ".join(["w"] * n)


def corpus(spark):
    rows = [(i, words(i % 37), "big", 0) for i in range(700)] + [(1000 + i, words(20), s, 0) for i in range(30) for s in ("a", "z", "tiny", None)]
    rows += [(None, words(3), "a", 1), (5000, None, "a", 1), (5001, "", "nothing", 1), (1001, words(20), "a", 1), (1001, words(20), "a", 1), (9, words(30_000), "z", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, TAKEN int")


def test_mix(spark):
    rows, df = corpus(spark)
    got = mixing.mix(df, block_words=64).collect()
    assert len(got) == len(rows) and "TAKEN" in got[0].asDict()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    goal, taken = water(sizes), Counter()
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source])
        assert r["_taken"] == sum(d.words for d in r.draws) <= 3 * r.size
        taken[r.source] += r["_taken"]
    for s, t in goal.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(df.repartition(7), block_words=64, keep=["doc_id", "text"]).collect()
    key = lambda rows: sorted(str((r.doc_id, r.size, r["_taken"] if "_taken" in r.asDict() else r.taken)) for r in rows)
    assert key(got) == key(again)


def plain_mix(rows, upto, quota, most, block_words, seed_places, start_of):
    """What each row gives, word by word: blocks at the places that shards take, the last one cut."""
    out = {}
    for i, (source, size) in enumerate(rows):
        n = sum(z for x, z in rows if x == source)
        blocks = [list(range(b, min(b + block_words, most * n))) for b in range(0, most * n, block_words)]
        taken, left = set(), quota[source]
        for place in range(len(blocks)):
            if place < upto[source][-1]:
                words = blocks[seed_places[source].index(place)][:left]
                taken |= set(words)
                left -= len(words)
        out[i] = sum(c * n + start_of[i] + k in taken for c in range(most) for k in range(size))
    return out


def test_mix_against_word_by_word(spark):
    """Each document's words against a plain walk over the blocks, places and quotas of the tree."""
    block_words, seed = 16, mixing.SEED
    given = [(i, words(1 + i * 7 % 40), "ab"[i % 3 > 0]) for i in range(60)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df, block_words=block_words).collect()}
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "source").alias("h")).collect()}
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len(t.split())
    goal = {s: round(t) for s, t in water(sizes).items()}
    start, at = {}, Counter()
    for i, t, s in sorted(given, key=lambda r: h[r[0]] % 2**64):
        start[i] = at[s]
        at[s] += len(t.split())
    frame = spark.createDataFrame([("=" + s, s, n) for s, n in sizes.items()], "key string, source string, source_size long")
    goals = {r.key[1:]: r for r in mixing._goals(frame, mixing.WEIGHTS, 3, 8, block_words, seed).collect()}
    places = {s: [r[0] for r in spark.range(g.blocks).select(mixing.permuted(F.col("id"), F.lit(g.blocks), seed + 1000, F.lit(g.rank))).collect()] for s, g in goals.items()}
    want = plain_mix([(s, len(t.split())) for _, t, s in given], {s: g.upto for s, g in goals.items()}, goal, 3, block_words, places, start)
    assert {i: r.taken for i, r in got.items()} == want
    for s in goal:
        assert sum(want[i] for i, _, x in given if x == s) == goal[s]


def test_the_tree_decides(spark, monkeypatch):
    """What shards take changes if the permutation, or the quotas, are replaced by stubs; the quotas'
    stub keeps every source's sum, so that what a document gives in all stays."""
    df = corpus(spark)[1].drop("TAKEN")

    def take():
        rows = mixing.mix(df, block_words=64, keep=["doc_id"]).select("*", mixing.shard_words(F.col("draws")).alias("shard_words")).collect()
        assert all(sum(r.shard_words) == r.taken and len(r.shard_words) == 8 for r in rows)
        return sorted((str(r.doc_id), r.taken) for r in rows), sorted((str(r.doc_id), r.shard_words) for r in rows)

    taken, shards = take()
    with monkeypatch.context() as m:
        m.setattr(mixing, "permuted", lambda number, size, seed, key: number)
        assert take()[0] != taken
    real = mixing.quotas
    with monkeypatch.context() as m:
        m.setattr(mixing, "quotas", lambda blocks, n, seed: real(blocks, n, seed).withColumn("upto", F.array_repeat(F.element_at("upto", -1), n)))
        stub = take()
        assert stub[0] == taken and stub[1] != shards and all(sum(w[1:]) == 0 for _, w in stub[1])


def test_whole_documents(spark):
    rows, df = corpus(spark)
    got = mixing.mix(df, block_words=64, cut=False).collect()
    taken, sizes = Counter(), Counter()
    for r in got:
        assert all(d.words == r.size for d in r.draws) and len(r.draws) <= 3
        taken[r.source] += r["_taken"]
        sizes[r.source] += r.size
    for s, t in water(sizes).items():
        longest = max([len((r[1] or "").split()) for r in rows if r[2] == s], default=0)
        assert abs(taken[s] - t) <= longest + 0.1 * t
    out = mixing.shuffled(mixing.mix(df, block_words=64, cut=False)).collect()
    assert len(out) == sum(len(r.draws) for r in got) and {r.shard for r in out} == set(range(8))


def test_shards_hold_their_quotas(spark):
    rows, df = corpus(spark)
    got = mixing.mix(df, block_words=16, shards=8, keep=["source"])
    blocks = got.select("source", F.explode("draws").alias("d")).select("source", "d.block", "d.shard").distinct().groupBy("source", "block").count()
    assert blocks.where("count > 1").count() == 0  # a block is in one shard
    by = got.select(F.explode("draws").alias("d")).groupBy("d.shard").agg(F.sum("d.words").alias("w")).collect()
    total = sum(r.w for r in by)
    assert len(by) == 8 and all(abs(r.w - total / 8) < 200 for r in by)


def test_quotas_are_exact(spark):
    given = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 5)], "rank int, blocks long")
    got = {r.rank: r.upto for r in mixing.quotas(given).collect()}
    counts = {k: [b - a for a, b in zip([0, *v], v, strict=False)] for k, v in got.items()}
    assert {k: sum(v) for k, v in counts.items()} == {1: 1000, 2: 37, 3: 0, 4: 5}
    assert all(n >= 0 for v in counts.values() for n in v)
    totals = [sum(v[i] for v in counts.values()) for i in range(8)]
    assert max(totals) - min(totals) <= 1 and sum(totals) == 1042


def test_hypergeometric_has_its_distribution(spark):
    df = spark.range(4000).select(mixing.hypergeometric(F.lit(20), F.lit(8), F.lit(10), F.rand(1)).alias("k")).groupBy("k").count()
    from math import comb

    got = {r.k: r["count"] / 4000 for r in df.collect()}
    for k in range(9):
        assert got.get(k, 0) == pytest.approx(comb(8, k) * comb(12, 10 - k) / comb(20, 10), abs=0.03)


def test_permutation(spark):
    for n in (1, 2, 17, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), 3, F.lit(5))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_empty_mix(spark):
    _, df = corpus(spark)
    assert mixing.mix(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    r = mixing.mix(only).first()
    assert (r.size, r.target, r.taken) == (0, 0.0, 0)
