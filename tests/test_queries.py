import os

import pytest

from tessitura.queries import ORACLE_SQL, QUERIES
from tests.helpers import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_unicode_normalizer(spark):
    from tessitura.functions.text import basic_normalize, normalize

    df = spark.createDataFrame([("  Hello, WORLD！  ",), ("Straße",), (None,)], "t string")
    assert [r[0] for r in df.select(normalize("t")).collect()] == ["hello world", "strasse", None]
    assert basic_normalize("a b") == "a b"


def _levenshtein(a, b):
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        last, row[0] = row[0], j
        for i, x in enumerate(a, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors_against_plain_table(spark):
    from tessitura.plans import views

    pairs = {(r.id, r.turn): (r.ref.split(), r.hyp.split()) for r in views.asr_pairs(spark, SF).collect()}
    got = QUERIES["t_6_7_word_errors"](spark, SF).collect()
    assert len(got) == len(pairs) > 0
    for r in got:
        ref, hyp = pairs[r.id, r.turn]
        assert r.edits == _levenshtein(ref, hyp) and r.n_ref == len(ref)


def _backtrace(a, b):
    """(substitutions, deletions, insertions) by the whole table, walked back from its last cell."""
    table = [list(range(len(b) + 1))]
    for x in a:
        row = [table[-1][0] + 1]
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, table[-1][j + 1] + 1, table[-1][j] + (x != y)))
        table.append(row)
    i, j, subs, dels, ins = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and table[i - 1][j - 1] + 1 == table[i][j]:
            subs, i, j = subs + 1, i - 1, j - 1
        elif i and table[i - 1][j] + 1 == table[i][j]:
            dels, i = dels + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return subs, dels, ins


def test_edit_counts_of_all_pairs(spark):
    from tessitura.plans import views

    pairs = {(r.id, r.turn): (r.ref, r.hyp) for r in views.asr_pairs(spark, SF).collect()}
    got = QUERIES["t_7_edit_counts"](spark, SF).collect()
    assert len(got) == len(pairs) > 0
    by_turn = {}
    for r in got:
        ref, hyp = pairs[r.id, r.turn]
        want = _backtrace(ref.split(), hyp.split())
        assert (r.substitutions, r.deletions, r.insertions) == want and sum(want) == _levenshtein(ref.split(), hyp.split())
        by_turn.setdefault(r.turn, []).append((want, len(ref.split())))
    for r in QUERIES["agg_9_evaluation"](spark, SF).collect():
        rows = by_turn.get(r.turn, [])
        assert r.scored == len(rows) <= r.n and r.coverage == round(len(rows) / r.n, 9) and r.words == sum(n for _, n in rows)
        assert [r.substitutions, r.deletions, r.insertions] == [sum(c[k] for c, _ in rows) for k in range(3)]
        if rows:
            assert r.edits == sum(sum(c) for c, _ in rows)
            assert r.macro == round(sum(sum(c) / max(n, 1) for c, n in rows) / len(rows), 9) and r.corpus == round(r.edits / r.words, 9)


def test_alignment_against_the_whole_table():
    import random

    from tessitura.functions.alignment import distance, edit_counts

    rng = random.Random(1)
    for _ in range(600):
        a, b = ([rng.choice(["a", "b", "c", 4, "日"]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert edit_counts(a, b) == _backtrace(a, b) and distance(a, b) == _levenshtein(a, b)
    long = [rng.randint(0, 9000) for _ in range(20_000)]
    heard = [x if rng.random() < 0.9 else -1 for x in long if rng.random() < 0.97]
    assert sum(edit_counts(long, heard)) == distance(long, heard) == distance(heard, long)
    assert edit_counts([], list("ab")) == (0, 0, 2) and edit_counts(list("ab"), []) == (0, 2, 0)


def test_evaluation_with_failures(spark):
    from pyspark.sql import functions as F

    from tessitura.operators import groups

    rows = [("a", "one two", "one three", True), ("a", "x", None, True), ("a", "cut off", "cut", False), ("b", "q", None, None), ("a", "", "extra", True), ("a", None, "w", True)]
    df = spark.createDataFrame(rows, "part string, ref string, hyp string, whole boolean")
    a, b = sorted(groups.evaluation(df, "ref", "hyp", F.col("whole"), by=("part",)).collect())
    assert (a.n, a.scored, a.coverage, a.words, a.substitutions, a.deletions, a.insertions, a.edits) == (5, 3, 0.6, 2, 1, 0, 2, 3)
    assert a.corpus == 1.5 and round(a.macro, 9) == round((0.5 + 1 + 1) / 3, 9)
    assert (b.n, b.scored, b.coverage, b.edits, b.macro, b.corpus) == (1, 0, 0.0, 0, None, None)
    nulls = spark.createDataFrame([(["a"], None), (None, ["a"]), (["a", None], ["a"])], "a array<string>, b array<string>")
    from tessitura.functions.alignment import token_distance

    assert [r[0] for r in nulls.select(token_distance(F.col("a"), F.col("b"))).collect()] == [None, None, 1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    same_start = " ".join(f"w{i}" for i in range(60))
    turns = [(1, 0, "user", same_start + " one two three four"), (1, 1, "assistant", same_start + " one 2 three"), (2, 0, "user", "a b"), (2, 1, "assistant", "a b")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["t_6_7_word_errors"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 2, 64, round(2 / 64, 9)), (2, 0, 0, 2, 0.0)]
    total = QUERIES["agg_9_error_rates"](spark, str(tmp_path)).first()
    assert (total.macro, total.corpus, total.n) == (1 / 64, 2 / 66, 2)


def test_character_errors_of_unaltered_texts(spark, tmp_path):
    same_start = "é" * 3 + " ab" * 70
    pairs = {(1, 0): (same_start + " naïve 日本語", same_start + " naive 日本"), (2, 0): ("Straße", "Strasse"), (3, 0): ("ok", "ok")}
    turns = [(i, t + k, role, x) for (i, t), p in pairs.items() for k, (role, x) in enumerate(zip(("user", "assistant"), p, strict=True))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    bare = lambda x: "".join(x.split())
    want = {k: round(_levenshtein(bare(r), bare(h)) / len(bare(r)), 9) for k, (r, h) in pairs.items()}
    got = {(r.id, r.turn): r.cer for r in QUERIES["t_8_character_errors"](spark, str(tmp_path)).collect()}
    assert got == want and want[1, 0] > 0 and want[2, 0] > 0


def test_prompts_by_a_tokenizer(spark):
    import hashlib

    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from tessitura.plans import views
    from tessitura.queries import LFM

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r for r in views.table(spark, SF, "documents").collect()}
    got = QUERIES["prm_1_subword_prompts"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        d = docs[r.doc_id]
        if d.text is not None:
            ids = [LFM.start_of_human, *library.encode(d.text if d.source is None else f"{d.source}: {d.text}").ids, LFM.end_of_text, LFM.end_of_human]
            assert (r.n, r.prompt) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
