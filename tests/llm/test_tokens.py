import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from tessitura.llm import bpe, token_files
from tessitura.llm.tokenization import ChunkEncoder, TreeEncoder, encoder_for, pieces

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = ["a", "The", " ", "  ", "\n", "\t", "'s", "'re", "!!", ".", ",", "é", "漢字", "👍", "<|endoftext|>", "12", "\xa0", "\x1c", "\x85", "᠎", "é", "İ", "Σ", "ΑΣ", "<|ENDOFTEXT|>", "J̌", "\x00", "_", "<|startoftext|>", "\r\n", "x.", "٣", "²"]


def texts(n, seed, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)]


def encoder_of(path):
    with open(path, "rb") as f:
        return ChunkEncoder(f.read())


def equal_to_the_library(encode, raw, given):
    ids, sizes = encode(given)
    right = raw([t or "" for t in given])
    assert sizes.tolist() == list(map(len, right))
    assert ids.tolist() == [i for r in right for i in r]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_equal_the_library(path):
    encoder = encoder_of(path)
    given = [*texts(3000, 1), None, "", "a", "\n", "\x02", " \x02a", "x\n\ny", "Don't", "H\u0331", "I\u0307", "word,", "(word)", "word" * 40 + ",", "\u00b2x"]
    equal_to_the_library(encoder.encode, encoder.raw, given)
    equal_to_the_library(encoder.encode, encoder.raw, given[::-1])
    assert encoder.encode([])[0].tolist() == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_merges_equal_the_library(path):
    encoder = encoder_of(path)
    rng = random.Random(4)
    words = ["".join(rng.choice("aabethsnig\u00e9\u6f22") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert encoder.merges is not None
    equal_to_the_library(encoder.encode, encoder.raw, words)


def test_tree_concatenation():
    tree = TreeEncoder(encoder_of(BYTE), 128)
    rng = random.Random(2)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(6000))
    given = [letters, "ab" * 3000, "1234567890" * 400, "-" * 3000, "\n" * 3000, "漢字" * 1500, "👍" * 700, "x<|endoftext|>" * 200, "'s'm" * 700, "Zoë's" * 500, "".join(rng.choice(PIECES) for _ in range(4000)), *texts(300, 6, 200), None, ""]
    equal_to_the_library(tree.encode, tree.encoder.raw, given)
    assert tree.windows >= tree.joins > 300


def test_the_query_goes_through_the_tree(spark, monkeypatch):
    """Texts of the table are joined by windows, and a wrong join shows in the query's ids."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    tree = TreeEncoder(encoder_of(BYTE))
    equal_to_the_library(tree.encode, tree.encoder.raw, docs)
    assert tree.windows >= tree.joins > len(docs) / 4
    monkeypatch.setattr(TreeEncoder, "_join", lambda self, pairs: [(x + y, np.concatenate([a, b])) for (x, a), (y, b) in pairs])
    ids, _ = TreeEncoder(encoder_of(BYTE)).encode(docs)
    assert ids.tolist() != [i for r in tree.encoder.raw([t or "" for t in docs]) for i in r]


def test_small_table_keeps_results(monkeypatch):
    from tessitura.llm import tokenization

    monkeypatch.setattr(tokenization, "CACHE_ENTRIES", 50)
    encoder = encoder_of(BYTE)
    given = [f"word{i} other{i % 7}, end{i}." for i in range(500)] * 2
    for i in range(0, len(given), 100):
        equal_to_the_library(encoder.encode, encoder.raw, given[i : i + 100])
    assert len(encoder.table.index) < 500


def test_pieces():
    given = pa.array(["aaaa", None, "bb", "", "c" * 50, "d"])
    assert list(pieces(given, 6)) == [slice(0, 4), slice(4, 5), slice(5, 6)]
    assert list(pieces(pa.array([], pa.string()), 6)) == []


ROWS = [(1, "Hello, world", 5), (2, None, 1), (3, "", 1), (None, "null id", 1), (1, "Hello, world", 5), (1, "another text", 5), (9, "long " * 40_000 + "z" * 9000, 1), (-4, "<|endoftext|> é\n\n  x", 0)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_bpe(spark):
    tok = Tokenizer.from_file(BYTE)
    out = bpe.bpe(frame(spark), BYTE, ("token_ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(r[0]) for r in ROWS)
    expected = {}
    for i, t, _ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected.setdefault(i, []).append((ids, tok.decode(ids, skip_special_tokens=False)))
    for r in out:
        assert (r.token_ids, r.decoded) in expected[r.doc_id] and r.n_tokens == len(r.token_ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.bpe(frame(spark, []), BYTE).count() == 0
    with pytest.raises(ValueError):
        bpe.bpe(frame(spark), BYTE, ("x",))


def test_token_files(spark, tmp_path):
    tok = Tokenizer.from_file(WORD)
    out = f"file://{tmp_path}/out"
    manifest = token_files.write_token_files(frame(spark), out, WORD, 2, ranges=3)
    rows = token_files.read_token_files(spark, out, with_ids=True).orderBy("start").collect()
    given = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in given]
    assert [(r.id, r.token_ids) for r in rows] == [(g[0], x) for g, x in zip(given, ids, strict=True)]
    assert [r.start for r in rows] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(ROWS)
    # by the index, in a shuffled order
    read = []
    for r in manifest.collect():
        file = token_files.TokenFile(f"{out}/{r.path}")
        read += [(i, x.tolist()) for i, x in file.shuffled(1)]
    assert sorted(map(repr, read)) == sorted(repr((g[0], x)) for g, x in zip(given, ids, strict=True))


def test_damage_is_found(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    r = token_files.write_token_files(frame(spark), out, WORD, 2, ranges=1).first()
    path = os.path.join(tmp_path, "out", r.path)
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="bad payload"):
        token_files.read_token_files(spark, out).collect()
    with pytest.raises(ValueError, match="bad length"):
        token_files.unframe(bytes(20))


def test_no_rows_no_files(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    assert token_files.write_token_files(frame(spark, []), out, WORD, 2).count() == 0
    assert token_files.read_token_files(spark, out).count() == 0


def test_wide_ids_and_ranges(spark):
    from pyspark.sql import functions as F

    assert token_files.parse_payload(token_files.payload_of(None, np.array([70_000], "<u4").tobytes(), True))[1].tolist() == [70_000]
    ends = [3, 5, 9, 20, 21]
    df = spark.createDataFrame([(x,) for x in (None, -1, 3, 4, 5, 8, 9, 19, 20, 21, 99)], "x long")
    got = [r[0] for r in df.select(token_files.range_of(F.col("x"), ends)).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 5]
    assert fs is not None and encoder_for is not None


def test_workers_give_memory_back(monkeypatch):
    """Before the first text, every so many bytes and at the end; the table keeps to the operator's own bound."""
    import pyarrow as pa

    from tessitura.llm import bpe, tokenization

    with open(BYTE, "rb") as f:
        data = f.read()
    trims = []
    monkeypatch.setattr(bpe, "trim", lambda: trims.append(len(tokenization._KEPT)))
    monkeypatch.setattr(bpe, "TRIM_BYTES", 20_000)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 10_000)
    monkeypatch.setattr(bpe, "TABLE", 500)
    monkeypatch.setattr(tokenization, "_KEPT", {})
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(40)] + [None, ""]
    made = list(bpe.encoded(iter([pa.record_batch([pa.array(range(42)), pa.array(texts)], names=["id", "text"])]), data, ("token_ids", "decoded"), 2048))
    assert trims[0] == 0 and len(trims) >= 2 + sum(len(t or "") for t in texts) // 40_000
    encoder = tokenization.encoder_for(data, 500)
    encoder.table.forget()
    assert len(encoder.table.index) <= 500
    assert [r for b in made for r in b.column(3).to_pylist()] == [t or "" for t in texts]
    whole = [e.ids for e in encoder.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [r for b in made for r in b.column(2).to_pylist()] == whole


def test_released_workers_keep_nothing(monkeypatch):
    from tessitura.llm import tokenization

    calls = []
    monkeypatch.setattr(tokenization, "release", lambda: calls.append("release"))

    def run(batches):
        calls.append("run")
        yield from batches

    assert list(tokenization.released(run)(iter([1, 2]))) == [1, 2] and calls == ["release", "run", "release"]
