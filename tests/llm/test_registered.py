"""The registered queries over whole tables against plain versions of their contracts."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessitura.llm import fingerprints
from tessitura.llm.queries import QUERIES
from tests.llm.test_sharding_mixing import water

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], np.float64)
    by = {}
    for r in run(spark, "op4_neighbours"):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(ids[ids % 100 == 0].tolist())
    hit = 0
    for q, found in by.items():
        d = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(axis=1))
        order = sorted((x for x in range(len(ids)) if ids[x] != q), key=lambda x: (d[x], ids[x]))[:10]
        assert [k for k, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in found) and [(s, v) for _, v, s in sorted(found)] == sorted((s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(ids[order].tolist()))
    assert hit >= 0.9 * 10 * len(by)


def test_mix(spark, docs):
    rows = run(spark, "op5_mix_sources")
    sizes, taken = {}, {}
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len((d.text or "").split()) and 0 <= r.taken <= 3 * r.size and sum(r.shard_words) == r.taken
        sizes[d.source] = sizes.get(d.source, 0) + r.size
        taken[d.source] = taken.get(d.source, 0) + r.taken
    goals = water(sizes)
    assert len(rows) == len(docs) and all(r.source_size == sizes[docs[r.doc_id].source] and abs(r.target - goals[docs[r.doc_id].source]) < 1e-6 for r in rows)
    assert all(abs(taken[s] - t) <= 1 for s, t in goals.items())
    assert rows and sorted(map(tuple, run(spark, "op5_mix_sources")), key=str) == sorted(map(tuple, rows), key=str)


def test_bpe(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    rows = run(spark, "op6_bpe")
    for r in rows:
        ids = library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    assert len(rows) == len(docs)


def test_token_files(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, rows = 0, {r.doc_id: r for r in run(spark, "op7_token_files")}
    assert len(rows) == len(docs)
    for i in sorted(docs):
        ids = [*library.encode(docs[i].text or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_sharding(spark, docs):
    rows = run(spark, "op8_sharding")
    slots = {}
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op10_fingerprints")}
    order = sorted(docs)
    assert len(rows) == len(docs)
    for k, i in enumerate(order):
        text, following = docs[i].text or "", docs[order[(k + 1) % len(order)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + (following.text or "")[:q]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited)) and r.edited_fingerprint == fingerprints.Tree(edited).fingerprint
        # from the strings alone
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprints.likeness(r.fingerprint, rows[following.doc_id].fingerprint)
    by_text = {}
    for i in order:
        by_text.setdefault(docs[i].text or "", set()).add(rows[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and len({f for s in by_text.values() for f in s}) == len(by_text)
