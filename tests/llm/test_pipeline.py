import os

import pytest

import corpus_pipeline
from tessitura.llm import lines, near, quality
from tessitura.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (_, classify), (_, dedup_lines), (_, dedup_docs), (_, mix), (_, encode) = corpus_pipeline.STAGES
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    one = classify(spark, docs, SF).toPandas()
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert list(one.columns) == columns and set(one.doc_id) == {i for i, s in scores.items() if s >= quality.THRESHOLD}

    two = dedup_lines(spark, spark.createDataFrame(one), SF).toPandas()
    from tests.llm.test_lines_fingerprints import plain_strip

    rows = [(r.doc_id, r.source, r.text, 0) for r in one.itertuples()]
    stripped = sorted(repr(eval(x)[:2]) for x in plain_strip(rows, lines.MIN_SITES))
    assert sorted(repr((r.doc_id, r.text)) for r in two.itertuples()) == stripped and (two.n_chars == two.text.str.len()).all()

    three = dedup_docs(spark, spark.createDataFrame(two), SF).toPandas()
    from tests.llm.test_near import plain_components

    groups = plain_components([(r.doc_id, r.text, 0) for r in two.itertuples()], 5, near.PERCENT)
    assert set(three.doc_id) == {i for i, root in groups.items() if i == root}

    four = mix(spark, spark.createDataFrame(three), SF).toPandas()
    from tests.llm.test_sharding_mixing import water

    size = {r.doc_id: len(r.text.split()) for r in three.itertuples()}
    totals = three.assign(n=three.doc_id.map(size)).groupby("source").n.sum().to_dict()
    taken = four.assign(n=four.doc_id.map(size)).groupby("source").n.sum().to_dict()
    for s, t in water(totals).items():
        assert abs(taken.get(s, 0) - t) <= 0.1 * t + 2 * max(n for i, n in size.items() if three.source[three.doc_id == i].iloc[0] == s)
    assert four.groupby("doc_id").size().max() <= 3 and list(four.columns) == columns

    five = encode(spark, spark.createDataFrame(four), SF).toPandas()
    from tokenizers import Tokenizer

    from tests.llm.test_tokens import BYTE

    tok, seen = Tokenizer.from_file(BYTE), {r.doc_id: r.n_tokens for r in five.itertuples()}
    assert len(five) == len(four)
    assert all(seen[r.doc_id] == len(tok.encode(r.text, add_special_tokens=False).ids) for r in four.drop_duplicates("doc_id").itertuples())
    assert len(corpus_pipeline.run(spark, SF).toPandas()) == len(five)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, slot int, `line 1` string"


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns, no rows."""
    rows = [(i, f"some words of text {i % 4} and more {i}\nline {i % 2}", "en", f"s{i % 3}", 40, 0.1, 1, "x") for i in range(30)]
    rows += [(None, None, None, None, None, None, None, None), (5, "", "en", "s1", 0, 1.0, 1, "x"), (3, *rows[3][1:]), (3, *rows[3][1:]), (90, "long text " * 30_000, "en", None, 1, 1.0, 1, "x")]
    for given in (rows, rows[30:31], []):
        docs, size = spark.createDataFrame(given, ODD), len(given)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            got = docs.collect()
            if i < 4:
                assert docs.columns == corpus_pipeline.COLUMNS
                docs = spark.createDataFrame(got, docs.schema)
            assert len(got) <= (3 if i == 3 else 1) * size and (size or not got)
            if i == 1:
                assert len(got) == size
            size = len(got)


@pytest.mark.parametrize("name", ["op3_quality", "op13_pii", "pipeline"])
def test_registered_queries_run(spark, name):
    """A row for each document, or for each of the rows that the query's contract names."""
    rows = QUERIES[name](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name != "pipeline":
        assert len(rows) == docs == len({r.doc_id for r in rows})
