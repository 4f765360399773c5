import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from tessitura.llm import fingerprints, lines

SCHEMA = "doc_id long, source string, text string, n_lines int"


def plain_strip(rows, min_sites):
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    sites, texts = defaultdict(set), defaultdict(set)
    for _, s, t, _ in rows:
        for x in [] if t is None else t.split("\n"):
            sites[trim(x)].add((s is not None, s or ""))
            texts[trim(x)].add(t)
    out = []
    for i, _, t, _ in rows:
        parts = [] if t is None else t.split("\n")
        gone = [bool(trim(x)) and min(len(sites[trim(x)]), len(texts[trim(x)])) >= min_sites for x in parts]
        kept = "\n".join(x for x, g in zip(parts, gone, strict=True) if not g)
        out.append((i, None if t is None else kept, sum(bool(trim(x)) for x in parts), sum(gone)))
    return sorted(map(repr, out))


def test_lines_against_plain(spark):
    body = "\n".join(f"body {i}" for i in range(300))
    rows = [(i, f"s{i % 12}", f"common \nown {i}\n\nfew {i % 5}\ncommon\n\tnear {i % 3} ", 1) for i in range(90)]
    rows += [(200 + i, f"s{i}", f"seven\nown text {i}\nmore of it {i}", 1) for i in range(7)] + [(300 + i, f"s{i}", f"eight\nown words {i}\nmore of it {i}", 1) for i in range(8)]
    rows += [(400 + i, f"s{i % 15}", "copy of a page\nits second line", 1) for i in range(60)]
    rows += [(500 + i, f"s{i}", "only common lines\ncommon" + "\n" * i, 1) for i in range(9)]
    rows += [(None, None, "common\nx\ny", 1), (600, None, None, 1), (601, "s1", "", 1), (602, "s1", "\n\n", 1), (603, "s2", body + "\ncommon\n" + body, 1), (604, None, "eight\nz", 1)]
    for min_sites in (3, 8):
        got = lines.strip_boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=min_sites)
        assert got.columns == ["doc_id", "source", "text", "n_lines", "_n_lines", "n_removed"]
        assert sorted(repr((r.doc_id, r.text, r._n_lines, r.n_removed)) for r in got.collect()) == plain_strip(rows, min_sites)
    assert lines.strip_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_articles_that_each_stand_on_many_sites(spark):
    rows = [(20 * a + s, f"s{s}", f"article {a}\nsubscribe to our newsletter\nits own end {a}", 1) for a in range(100) for s in range(20)]
    rows += [(5000 + s, f"s{s}", "one page\nthat is copied", 1) for s in range(20)]
    got = lines.strip_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_removed for r in got) == 2000
    assert all(r.n_removed == (r.doc_id < 5000) and "newsletter" not in r.text for r in got)


ROWS = [(5, "First paragraph here. And more of it!\n\nSecond one. " * 9), (2, "short"), (9, None), (None, "null id text"), (7, ""), (2, "short"), (11, "é👍" * 300), (3, "word " * 20_000), (-1, "x\ny")]


def plain_root(text):
    """The tree's root by plain recursion over its levels."""
    digest = lambda kind, body: hashlib.blake2b(kind + body, digest_size=16).digest()
    sections, run = [], []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        run.append(digest(b"P", line.encode()))
        if run[-1][0] < 32 or k == len(lines) - 1:
            sections.append(digest(b"S", b"".join(run)))
            run = []
    return digest(b"R", b"".join(sections)).hex()


M = 2**64 - 1


def plain_mixed(x):
    x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & M
    return x ^ (x >> 29)


def plain_heights(text):
    seen = [plain_mixed(ord(c) + 1) for c in text]
    out = []
    for i, c in enumerate(text):
        rolling = plain_mixed(sum(seen[i - k] * int(fingerprints._ODD[k]) for k in range(4) if i >= k) & M)
        zeros = (rolling & -rolling).bit_length() - 1 if rolling else 0
        out.append(63 if c == "\n" or i == len(text) - 1 else zeros)
    return out


def plain_leaves(text, level):
    out, leaf = [], ""
    for c, h in zip(text, plain_heights(text), strict=True):
        leaf += c
        if h >= level:
            out.append(leaf)
            leaf = ""
    return out


def plain_level(text):
    n = len(text)
    enough = max(math.isqrt(n) // 2, min(n, 8))
    return max((h for h in {0, *plain_heights(text)} if n * n >= enough * sum(len(x) ** 2 for x in plain_leaves(text, h))), default=0)


def plain_likeness(a, b):
    """Equal leaves, as texts, at the higher of two texts' levels."""
    if a == b:
        return 1.0
    level = max(plain_level(a), plain_level(b))
    left, right = Counter(plain_leaves(a, level)), Counter(plain_leaves(b, level))
    return 2 * sum(len(x) * n for x, n in (left & right).items()) / (len(a) + len(b))


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edit_probe(spark, ranges):
    df = spark.createDataFrame([(i, t, "c") for i, t in ROWS], "doc_id long, text string, n_chars string")
    got = sorted(fingerprints.edit_probe(df, ranges=ranges).collect(), key=str)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_root(t), plain_root(edited), plain_likeness(t, edited), plain_likeness(t, after)))
    assert sorted(map(repr, ((*r[:3], *(f.split(":")[0] for f in r[3:5]), *r[5:7]) for r in got))) == sorted(map(repr, want))


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    r = fingerprints.edit_probe(df).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    assert fingerprints.edit_probe(df.limit(0)).count() == 0
    assert fingerprints.fingerprint(df).first().fingerprint == r.fingerprint


def like(a, b):
    return fingerprints.likeness(fingerprints.Tree(a).fingerprint, fingerprints.Tree(b).fingerprint)


def test_tree_locates_edits():
    text = "\n".join(f"Paragraph {i} says something of its own. It goes on." for i in range(80))
    at = text.index("Paragraph 40")
    changed = text[:at] + "Changed!!! 40" + text[at + 12 :]
    a, b = fingerprints.Tree(text), fingerprints.Tree(changed)
    spans = fingerprints.edits(a, b)
    assert spans and all(at - 60 <= s and e <= at + 80 for s, e in spans) and any(s <= at < e for s, e in spans)
    assert 0.95 < like(text, changed) < 1
    assert like(text, text) == 1 == like("", "")
    assert like(text, "") == 0 and fingerprints.edits(a, fingerprints.Tree(text)) == []
    assert len({fingerprints.Tree(x).fingerprint for x in ("a\nb", "ab", "a b")}) == 3


def test_likeness_of_shifted_texts_in_any_script():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    long = " ".join(rng.choices(words, k=4000))[:20_000]  # without marks or line feeds
    assert like("x" + long, long) > 0.95 and like(long[:9000] + "an insertion" + long[9000:], long) > 0.95
    cjk = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(3000))
    assert like("天" + cjk, cjk) > 0.9 and 0.65 < like(cjk, cjk[:2250] + cjk[:750]) < 0.85
    other = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(3000))
    assert like(cjk, other) < 0.05 > like(long, " ".join(rng.choices(["".join(rng.choices("klmnopqrst", k=5)) for _ in range(500)], k=3000)))
    for x, y, least in (("abcd", "abcz", 0.75), ("zbcd", "abcd", 0.75), ("abcdefgh", "abcdefxy", 0.7), ("short text", "short test", 0.6)):
        assert least <= like(x, y) < 1 and like(x, y) == like(y, x)
    for run in ("word " * 4000, "a" * 20_000):  # periods of any length
        assert like("x" + run, run) > 0.99
    for n in (40, 120, 250, 255, 256, 257, 300, 490, 5000):
        assert like(long[:n], long[: n * 9 // 10]) > 0.75


def test_against_plain_versions():
    rng = random.Random(8)
    parts = ["One. ", "two! ", "three", " ", "\n", "\n\n", "...", "?", "é👍", "a longer run of words without any mark ", "\t"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "\n", "x", "\0" * 40]
    for a in made:
        tree = fingerprints.Tree(a)
        assert tree.fingerprint.split(":")[:2] == [plain_root(a), str(plain_level(a))]
        leaves = fingerprints.Leaves.parse(tree.fingerprint)
        assert leaves.size.tolist() == [len(x) for x in plain_leaves(a, plain_level(a))] and str(leaves) == tree.fingerprint
        for b in rng.sample(made, 12):
            assert like(a, b) == plain_likeness(a, b)
