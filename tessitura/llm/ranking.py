"""Ranked lexical search by impact-ordered, score-at-a-time processing.

Every document's postings for the terms that are asked for are written once. Statistics of the whole
table (documents, terms, documents of a term) come from aggregates over them. Documents are then dealt
to segments, and each segment is an index of its own: the postings of a term are grouped by exact
impact, the highest first. A query takes groups of postings from all of its terms in descending order
of what they add to a score, into one accumulator a document, and stops when the bounds of the
groups that are left prove that the best ``k`` are among a few documents; only then are the scores of these
completed, from their own postings, and ranked. A task hands on the ``k`` best scores it has seen for a query as
the bar for its later segments, and one ``k``-best aggregate over all tasks ends it.

No row of one term or one query meets in one task: segments are runs of a task's documents, whatever
their terms. What a task holds is one segment, and a block of queries with ``BLOCK_TERMS`` terms at most
(or one longer query); more queries take more passes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.common import Scratch, at, require
from tessitura.llm.tokenization import pieces

#: Bytes that are part of a term: ASCII letters and digits, and all of other characters.
_TERM = bytes(c if c > 0x7F or chr(c).isalnum() else 32 for c in range(256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in _TERM)
#: Terms of a block of queries.
BLOCK_TERMS = 1 << 18
#: Postings and documents of a segment.
SEGMENT_POSTINGS = 1 << 21
SEGMENT_DOCS = 1 << 16
#: A query goes down by this factor from its largest addition to this share of it, then takes the rest.
FALL, LAST = 0.7, 0.01
#: It may stop when this many times ``k`` documents can still be among the best; only they are completed.
COMPLETED = 4
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters and digits and of all other than ASCII
    characters, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a posting is worth, before its term's weight: 64-bit integers, division rounding down."""
    m = 25 + (75 * n * docs) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * with_term + 1)))


class Segment:
    """An index of some documents: for each term, its postings by descending impact.

    ``ids`` are the documents' ids, ``doc``, ``term`` and ``impact`` have an entry for each posting.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids = ids
        forward = np.argsort(doc, kind="stable")
        self.ends = np.searchsorted(doc[forward], np.arange(len(ids) + 1))
        self.own_term, self.own_impact = term[forward], impact[forward]
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.falling = doc[order], impact[order], -impact[order]
        names, starts = np.unique(term[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        self.place = {int(t): (int(a), int(b)) for t, a, b in zip(names, starts, ends, strict=True)}
        self.taken = self.postings = 0

    def search(self, query: list[tuple[int, int]], k: int, bar: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents (positions) with a score above 0 that reach ``bar``, with their
        scores. ``query`` has (term, what one unit of impact adds), each term once."""
        lists = [(*self.place[t], by) for t, by in query if by > 0 and t in self.place]
        self.postings += sum(b - a for a, b, _ in lists)
        at_ = [a for a, _, _ in lists]
        ahead = [int(self.impact[a]) * by for a, _, by in lists]  # what the next group of each list adds
        score = np.zeros(len(self.ids), np.int64)
        first = level = max(ahead, default=0)
        while sum(ahead):
            level = level * FALL if level > first * LAST else 0
            docs, adds = [], []
            for i, (_, b, by) in enumerate(lists):
                if ahead[i] and ahead[i] >= level:
                    # groups of one impact are taken whole: all that add the level at least
                    stop = at_[i] + int(np.searchsorted(self.falling[at_[i] : b], -math.ceil(level / by), side="right"))
                    docs.append(self.doc[at_[i] : stop])
                    adds.append(self.impact[at_[i] : stop] * by)
                    at_[i] = stop
                    ahead[i] = int(self.impact[stop]) * by if stop < b else 0
            if docs:
                every = np.concatenate(docs)
                self.taken += len(every)
                np.add.at(score, every, np.concatenate(adds))
            rest = sum(ahead)
            if not rest:
                break
            best = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0
            able = np.flatnonzero(score >= max(int(best), bar, 1) - rest)
            if len(able) <= COMPLETED * k:
                return self.ranked(able, self.completed(able, dict(query)), k, bar)
        found = np.flatnonzero(score)
        return self.ranked(found, score[found], k, bar)

    def completed(self, docs: np.ndarray, adds: dict[int, int]) -> np.ndarray:
        """The whole scores of a few documents, from their own postings."""
        out = np.zeros(len(docs), np.int64)
        for i, d in enumerate(docs.tolist()):
            own = slice(self.ends[d], self.ends[d + 1])
            out[i] = sum(adds.get(t, 0) * x for t, x in zip(self.own_term[own].tolist(), self.own_impact[own].tolist(), strict=True))
        return out

    def ranked(self, docs: np.ndarray, score: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        docs, score = docs[score >= max(bar, 1)], score[score >= max(bar, 1)]
        order = np.lexsort((self.ids[docs], -score))[:k]
        return docs[order], score[order]


def _postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each document with a term: its id, its number of terms and its postings of ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in pieces(batch.column(1)):
                ids, sizes, terms, tfs, ends = [], [], [], [], [0]
                for doc_id, text in zip(batch.column(0)[part].to_pylist(), batch.column(1)[part].to_pylist(), strict=True):
                    words = terms_of(text or "")
                    if not words:
                        continue
                    counts = Counter(map(known.get, words))
                    counts.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms += counts.keys()
                    tfs += counts.values()
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(at(docs, id_col).cast("long").alias("id"), at(docs, text_col).alias("text")).mapInArrow(run, POSTINGS)


def _best(postings: DataFrame, queries: list[list[tuple[int, int]]], docs: int, length: int, k: int) -> DataFrame:
    """(query, doc_id, score): the ``k`` best of each task's documents for each query, by number."""
    sent = postings.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        top: list[list[tuple[int, bool, int]]] = [[] for _ in asked]  # (-score, null id, id), best first
        held: list[tuple[np.ndarray, ...]] = []
        n_docs = n_postings = 0

        def close() -> None:
            ids, null, n, size, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            doc = np.repeat(np.arange(len(ids)), size)
            segment = Segment(np.where(null, np.iinfo(np.int64).max, ids), doc, term, impacts(tf, n[doc], docs, length))
            for query, best in zip(asked, top, strict=True):
                bar = -best[-1][0] if len(best) == k else 0
                found, score = segment.search(query, k, bar)
                if len(found):
                    best += [(-int(s), bool(null[d]), int(ids[d])) for d, s in zip(found, score, strict=True)]
                    best.sort()
                    del best[k:]

        for batch in batches:
            for start in range(0, len(batch), 8192):
                part = batch.slice(start, 8192)
                lists, counts = part.column(2), part.column(3)
                size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), size, lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)))
                n_docs += len(part)
                n_postings += int(size.sum())
                if n_docs >= SEGMENT_DOCS or n_postings >= SEGMENT_POSTINGS:
                    close()
                    held, n_docs, n_postings = [], 0, 0
        if held:
            close()
        rows = [(i, None if null else doc, -less) for i, best in enumerate(top) for less, null, doc in best]
        if rows:
            number, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    return postings.mapInArrow(run, "query int, doc_id long, score long")


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[Row, Counter]]]:
    """The queries in blocks of ``BLOCK_TERMS`` different terms at most, or of one longer query, read
    one partition after the other."""
    block: list[tuple[Row, Counter]] = []
    many = 0
    for row in items.select(at(items, id_col).alias("item"), at(items, text_col).alias("text")).toLocalIterator():
        counts = Counter(terms_of(row["text"] or ""))
        if block and many + len(counts) > BLOCK_TERMS:
            yield block
            block, many = [], 0
        block.append((row["item"], counts))
        many += len(counts)
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """Returns the ``k`` best documents of each item: the item's id, ``rank`` (from 1), the document's id
    and ``score``, highest first, ties by ascending document id, null ids last.

    A document without terms (null, empty, marks only) is no document of the statistics and is never
    found; an item without terms finds nothing. Rows that repeat an id are documents, or items, of their own;
    document ids are integers. Scores are exact 64-bit integers, over whole texts. Columns of other
    names take no part. Without documents or items the result is empty.
    """
    require(docs, id_col, text_col)
    require(items, item_col, query_col)
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranking")
    kind = items.schema[item_col].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    parts: list[DataFrame] = []
    for number, block in enumerate(_blocks(items, item_col, query_col)):
        vocabulary = {term: i for i, term in enumerate(sorted({t for _, counts in block for t in counts}))}
        postings = scratch.save(_postings(docs, id_col, text_col, vocabulary), f"postings-{number}")
        total = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
        if not total["docs"]:
            continue
        held = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a number a term of the block
        weights = {t: weight(total["docs"], held[i]) for t, i in vocabulary.items() if i in held}
        queries = [[(vocabulary[t], tf * weights[t]) for t, tf in counts.items() if t in weights] for _, counts in block]
        best = scratch.save(_best(postings, queries, total["docs"], total["length"], k), f"best-{number}")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item_id {kind}")
        parts.append(scratch.save(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), f"ranked-{number}"))
        scratch.drop(f"postings-{number}", f"best-{number}")
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.withColumnsRenamed({"item_id": item_col, "doc_id": id_col})
