import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessitura.llm import collocations
from tessitura.llm.common import Scratch

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for m in range(1, min(4, len(words) - i) + 1):
                    f[lang or "und"][tuple(words[i : i + m])] += 1
    return f, n


def plain_mine(rows, least, top):
    f, n = plain_counts(rows)
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in kept.items():
            holds = [b for q, b in kept.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in holds):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(map(str, out))


def texts(rng):
    words = ["a", "B", "the", "of", "é", "日本", "x-y", "\x01q", "zz", "A b", "~"] + [f"w{i}" for i in range(30)]
    made = []
    for _ in range(250):
        parts = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 80))
        made.append("".join(x + rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "! "]) for x in parts))
    return made


@pytest.mark.parametrize(("block", "partitions"), [(1 << 21, 2), (300, 3), (7, 1)])
def test_against_plain(spark, monkeypatch, block, partitions):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "en", "en", "de", "d", "de\0", None]), t) for t in texts(rng)]
    rows += [("en", "of the first kind of the first kind")] * 20 + [("en", None), (None, ""), ("fr", "..."), ("fr", "one"), ("en", "the " * 40_000 + "end")]
    monkeypatch.setattr(collocations, "BLOCK_TOKENS", block)
    monkeypatch.setattr(collocations, "RANGE_TOKENS", 500)
    monkeypatch.setattr(collocations, "SAMPLE_EVERY", 5)
    monkeypatch.setattr(collocations, "_SLICE", 1000)
    df = spark.createDataFrame([(la, t, 1) for la, t in rows], "lang string, text string, phrase int").repartition(partitions)
    got = collocations.mine(df, min_count=4, top=60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_mine(rows, 4, 60)
    if block == 300:
        f, n = plain_counts(rows)
        table = {(r.lang, r.phrase): r.f for r in collocations.phrases(df, Scratch(spark, "t"), min_count=4).collect()}
        want = {(la, " ".join(p)): a for la, counts in f.items() for p, a in counts.items() if a >= 4} | {(la, ""): a for la, a in n.items() if a}
        assert table == want


def test_empty_and_rare(spark):
    df = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert collocations.mine(df).count() == 0 == collocations.mine(df.limit(0)).count()


def test_trie_round_trip_and_cuts():
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 6, 4000).astype(np.uint64)
    high, low, counts = collocations.merged(*collocations.paths_of(tokens))
    paths = collocations.columns_of(high, low)
    assert counts.sum() == (tokens > 0).sum() and (np.diff(high.astype(object)) >= 0).all()
    again, n = collocations.deserialised(collocations.serialised(paths, counts))
    assert (again == paths).all() and (n == counts).all()
    words = [b"", b"b", b"d", b"f", b"h", b"j"]
    named = [tuple(words[i] for i in p) for p in paths.tolist()]
    for end in [(b"a",), (b"b",), (b"c",), (b"d", b"e"), (b"d", b"f", b"h"), (b"j", b"j", b"j", b"j"), (b"z",), named[7]]:
        full = end + (b"",) * (4 - len(end))
        assert collocations.place(words, high, low, end) == sum(p < full for p in named)
