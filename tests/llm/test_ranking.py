import math
import random
import re
from collections import Counter

import numpy as np

from tessitura.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, rank string"


def plain_rank(docs, items, k=10):
    bags = [(i, Counter(TERM.findall(t.translate(FOLD)))) for i, t in docs if t]
    bags = [(i, b, b.total()) for i, b in bags if b]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(x for _, b, _ in bags for x in b)
    out = []
    for item, text in items:
        found = []
        for i, b, n in bags:
            m = 100 - 75 + (75 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * b[x]) // (1000 * b[x] + 8 * m)) for x in TERM.findall((text or "").translate(FOLD)) if x in b)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


def made(rng, n, words):
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))) for _ in range(n)]


def test_against_plain(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)] + ["Éa", "日本", "x_y", "A1"]
    docs = list(enumerate(made(rng, 500, words)))
    docs += [(i, docs[3][1]) for i in range(900, 960)] + [(None, docs[3][1]), (3, docs[3][1]), (970, None), (971, ""), (972, "... !"), (973, "w1 " * 30_000)]
    items = list(enumerate(made(rng, 30, words))) + [(40, None), (41, ""), (42, "nowhere"), (None, "w3 w3 w149"), (43, docs[3][1]), (44, "É É日本 日本 X-y"), (45, " ".join(words))]
    frame, asked = spark.createDataFrame([(i, t, "c") for i, t in docs], SCHEMA).repartition(3), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    want = plain_rank(docs, items)
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert plain(ranking.rank(frame, asked).collect()) == want
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 150)  # many blocks of queries
    monkeypatch.setattr(ranking, "SEGMENT_DOCS", 50)
    assert plain(ranking.rank(frame, asked).collect()) == want
    none = ranking.rank(frame.limit(0), asked)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0 == ranking.rank(frame, asked.limit(0)).count()


def test_segment_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    docs = 5000
    doc, term = np.arange(docs), np.zeros(docs, np.int64)
    rare = rng.choice(docs, 30, replace=False)
    impact = np.append(rng.integers(1, 40, docs), rng.integers(500, 1000, 30))
    segment = ranking.Segment(np.arange(docs) * 7, np.append(doc, rare), np.append(term, np.ones(30, np.int64)), impact)
    full = np.zeros(docs, np.int64)
    np.add.at(full, np.append(doc, rare), impact * np.append(np.ones(docs, np.int64), np.full(30, 5)))
    best = np.lexsort((doc, -full))[:10]
    for bar in (0, int(full[best[-1]])):
        found, score = segment.search([(0, 1), (1, 5)], 10, bar)
        assert found.tolist() == best.tolist() and score.tolist() == full[best].tolist()
    assert segment.taken < 0.1 * segment.postings
    assert len(segment.search([(0, 1)], 10, 10**9)[0]) == 0 == len(segment.search([(9, 1)], 10)[0]) == len(segment.search([(0, 0)], 10)[0])


def test_terms_are_those_of_the_pattern():
    for t in ("Ab1_c-É x", "\x7f\x80 0:9;Z[`a{", "", "日本 語。"):
        assert [x.decode() for x in ranking.terms_of(t)] == TERM.findall(t.translate(FOLD))
