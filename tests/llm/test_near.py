import random

import numpy as np
import pytest

from tessitura.llm import near

SCHEMA = "doc_id long, text string, kept string"


def plain_sets(text, words):
    import re

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def plain_components(rows, words, percent):
    """All pairs, no shortcuts; rows that share an id are one document."""
    sets = [(i, plain_sets(t, words)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    shared = text(60)
    for g in range(6):
        base = text(rng.choice([6, 40, 120])).split()
        for _ in range(rng.randint(2, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            cut = rng.choice([0, 0, 0, len(copy) // 12, len(copy) // 6])
            rows.append(" ".join(copy[: len(copy) - cut]).title())
    rows += [f"{shared} {text(rng.randint(5, 60))}" for _ in range(25)]
    rows += ["", None, " \t", "one", "One", "two words", "TWO\nwords", "É é", "é é", text(30_000)]
    rng.shuffle(rows)
    return [(i * 3 - 20, t, "clash") for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 80), (2, 5, 80), (3, 3, 60)])
def test_against_all_pairs(spark, seed, words, percent):
    rows = corpus(seed)
    rows += [rows[0], (None, rows[0][1], "null"), (rows[1][0], "another text of that id", "x"), (10_000, "another text of that id", "x")]
    got = near.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=words, percent=percent).collect()
    want = plain_components(rows, words, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)
    sizes = sorted((str(i), len(plain_sets(t, words))) for i, t, _ in rows)
    assert sizes == sorted((str(r.doc_id), r.n_shingles) for r in got)


def test_truncated_copies_reach_each_other(spark):
    """Partners that are similar by what they share with a longer center alone."""
    words = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join(words[:n]), "") for k, n in enumerate([200, 190, 150, 140, 131, 120, 110, 101])]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=4).collect()}
    assert got == plain_components(rows, 4, 80)


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, None, "x"), (None, "a b c d e f", "x")], SCHEMA)
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert near.near_duplicates(df.limit(0)).count() == 0 == near.keep_one(df.limit(0)).count()


def test_sketch_agreement_is_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.8):
        n = 400
        both = int(2 * n * share / (1 + share))
        pool = np.unique(rng.integers(0, 2**63, 5 * n, dtype=np.uint64))
        agree = []
        for _ in range(30):
            x = rng.permutation(pool)[: 2 * n - both]
            a, b = np.sort(x[:n]), np.sort(x[n - both :])
            s = near.sketches([a, b])
            assert not (s == 2**64 - 1).any()
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - share) < 0.02
    one = near.sketches([np.array([7], np.uint64), np.empty(0, np.uint64)])
    assert not (one[0] == 2**64 - 1).any() and (one[1] == 2**64 - 1).all()


def test_components_of_a_chain(spark):
    from tessitura.llm.common import Scratch

    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)]
    got = {r.v: r.root for r in near.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}


def test_pairs_within_a_component_and_far_pairs_are_not_named(spark, monkeypatch):
    """Texts put together from one pool of sentences and near copies of some: all meet in bands and share rare shingles."""
    rng = random.Random(7)
    pool = [" ".join(f"s{k}w{j}" for j in range(10)) for k in range(16)]
    rows = [(i, " ".join(pool[k] for k in sorted(rng.sample(range(16), 11))), "") for i in range(40)]
    for i in range(40, 100):
        words = rows[i % 4][1].split()
        for _ in range(3):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), ""))
    named, confirmed = [], near._confirmed
    monkeypatch.setattr(near, "_confirmed", lambda pairs, *rest: named.append(pairs.count()) or confirmed(pairs, *rest))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=4).collect()}
    assert got == plain_components(rows, 4, 80)
    assert sum(named) <= len(rows), named


def test_parities_differ_in_no_more_places_than_sets_in_items():
    rng = np.random.default_rng(3)
    for n, apart in ((0, 1), (50, 0), (300, 40), (5000, 700), (3, 3)):
        items = np.unique(rng.integers(0, 2**64, n + 2 * apart, dtype=np.uint64))
        a, b = items[: n + apart], np.concatenate([items[:n], items[n + apart :]])
        differ = sum(int(x).bit_count() for x in (near.parities(a) ^ near.parities(b)).view(np.uint64))
        assert differ <= 2 * apart and (apart == 0 or differ > 0)
        assert len(near.parities(a)) == near.MARKS // 64
