"""Quality classification by co-training two views of a document.

The text-content view sees hashed byte pairs, kinds of bytes and word shapes of the whole text; the
page-metadata view sees language, source, length and the layout of lines, and never which
characters there are. Each view has a logistic classifier. In each round each one scores all
unlabelled documents and hands the ``HAND_OVER`` that it is surest of, in the share of the classes, to the
other one's training set. Both are then calibrated on labelled documents that were held out, and
the calibrated views are combined by a logistic rule fitted on the same rows, which scores
every document.

The labelled documents to fit on are at most ``SAMPLE``, those with the smallest hashes of the id:
the one bound on rows. The pool is every document without a label: features of all rows are
written once, and each round is a pass over them by all tasks. The driver gets the features of
the labelled sample and of the documents handed over, whose numbers do not grow with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm.common import Scratch, at, require
from tessitura.llm.tokenization import pieces, released

SAMPLE = 4000
ROUNDS = 4
#: Pseudo-labels that a view hands over in a round, at most.
HAND_OVER = 300
CONFIDENT = 0.95
HELD_OUT = 5  # one in so many labelled documents calibrates
THRESHOLD = 0.5
PAIRS = 512
CONTENT = PAIRS + 14
META = 60

#: The kind of each byte: capital, digit, mark between words, other mark, control, part of a longer character.
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!#$%&*+/<=>?@[\\]^_`{|}~", bytes([*range(9), *range(11, 32), 127]), bytes(range(128, 256))), 1):
    _KIND[list(_bytes)] = _k


def content_features(text: str) -> np.ndarray:
    """Log counts of hashed byte pairs over the whole text, and shares of kinds of bytes and words."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(CONTENT, np.float32)
    if len(data) > 1:
        pair = (data[:-1].astype(np.uint32) * 31 + data[1:]) * np.uint32(2654435761) >> np.uint32(23)
        out[:PAIRS] = np.log1p(np.bincount(pair, minlength=PAIRS))
        out[:PAIRS] /= max(1e-6, float(np.linalg.norm(out[:PAIRS])))
    words = text.split()
    n = max(1, len(words))
    out[PAIRS : PAIRS + 8] = (
        sum(map(str.isupper, words)) / n,
        sum(map(str.isdigit, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        sum(not w[0].isalnum() for w in words) / n,
        len(set(words)) / n,
        min(1.0, sum(map(len, words)) / n / 20),
        1.0 if not words else 0.0,
    )
    out[PAIRS + 8 :] = np.bincount(_KIND, np.bincount(data, minlength=256), minlength=7)[1:] / max(1, len(data)) * 5
    return out


def metadata_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source, hashed, and the length and lines of the page."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32(b"l" + (lang or "").encode()) % 16] = 1
    out[16 + zlib.crc32(b"s" + (source or "").encode()) % 32] = 1
    lines = text.split("\n")
    lengths = np.array([len(x) for x in lines])
    words = np.array([x.count(" ") + 1 for x in lines])
    out[48:] = (
        np.log1p(len(text)) / 10,
        np.log1p(len(lines)) / 10,
        np.log1p(lengths.mean()) / 10,
        np.log1p(lengths.max()) / 10,
        (lengths < 40).mean(),
        (lengths == 0).mean(),
        len(set(lines)) / len(lines),
        np.log1p(words.mean()) / 10,
        float(lengths.sum() / words.sum()) / 20,
        float(lengths.std() / (lengths.mean() + 1)),
        float(not text),
        1,
    )
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights, the constant last, by gradient descent with momentum; classes count alike."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    weight = np.ones(len(y)) if weight is None else weight
    sides = [max(1e-9, float(weight[y == c].sum())) for c in (0, 1)]
    weight = weight * np.where(y == 1, 0.5 / sides[1], 0.5 / sides[0])
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 2.0 / max(1e-6, float((weight[:, None] * x * x).sum()) / 4 + ridge)
    best = (np.inf, w)
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = (weight * (p - y)).astype(np.float32) @ x + ridge * w
        v = min(0.98, 1 - 3 / (i + 5)) * v - rate * g
        w = w + v
        loss = float(-(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum())
        if loss < best[0]:
            best = (loss, w.copy())
    return best[1]


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    centre: np.ndarray  # of the metadata features
    spread: np.ndarray
    combine: np.ndarray  # of the two calibrated logits, and a constant

    def views(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return np.stack([logit(self.content, content), logit(self.metadata, (metadata - self.centre) / self.spread)], axis=1)

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return sigmoid(logit(self.combine, np.clip(self.views(content, metadata), -20, 20)))


#: Gives, for the weights of both views and how many to ask for, the surest documents of the pool
#: for each view and class: (id, content, metadata, sureness), surest first, ties to the smaller id.
Surest = Callable[["Model", dict[tuple[int, int], int]], dict[tuple[int, int], list[tuple]]]


def co_train(content: np.ndarray, metadata: np.ndarray, labels: np.ndarray, held_out: np.ndarray, surest: Surest, rounds: int = ROUNDS, hand_over: int = HAND_OVER) -> Model:
    """Fits on labelled rows (1 or 0); ``held_out`` marks those kept for calibration. Without
    labels of both classes nothing can be told apart: every document's score is then a half."""
    train = np.flatnonzero(~held_out)
    y = labels[train]
    if len(np.unique(y)) < 2:
        train, y = np.arange(len(labels)), labels
    if len(np.unique(y)) < 2:
        return Model(np.zeros(CONTENT + 1), np.zeros(META + 1), np.zeros(META), np.ones(META), np.zeros(3))
    centre, spread = metadata[train].mean(axis=0), metadata[train].std(axis=0) + 1e-3
    rows = [content[train], (metadata[train] - centre) / spread]
    given: list[dict] = [{}, {}]  # by id, what each view was handed: (class, features)
    weights = [fit_logistic(v, y) for v in rows]
    share = float(y.mean())
    good = round(hand_over * share)
    for _ in range(rounds):
        model = Model(weights[0], weights[1], centre, spread, np.zeros(3))
        found = surest(model, {(me, c): n + len(given[1 - me]) for me in (0, 1) for c, n in ((1, good), (0, hand_over - good))})
        handed = 0
        for (me, c), documents in sorted(found.items()):
            other, left = given[1 - me], good if c else hand_over - good
            for key, *features, sure in documents:
                if left and sure >= CONFIDENT and key not in other:
                    other[key] = (c, features[0] if me else (features[1] - centre) / spread)
                    left -= 1
                    handed += 1
        for me in (0, 1):
            more = [given[me][k] for k in sorted(given[me])]
            x = np.concatenate([rows[me], [f for _, f in more]]) if more else rows[me]
            weights[me] = fit_logistic(x, np.concatenate([y, [c for c, _ in more]]), np.concatenate([np.ones(len(y)), np.full(len(more), 0.5)]))
        if not handed:
            break
    hold = np.flatnonzero(held_out)
    if len(np.unique(labels[hold])) < 2:
        hold = np.arange(len(labels))
    views = [content[hold], (metadata[hold] - centre) / spread]
    raw = np.stack([logit(w, v) for w, v in zip(weights, views, strict=True)], axis=1)
    scaled = []
    for me in (0, 1):  # each view is calibrated by a slope and a constant, at the rate of the classes
        a, b = calibrate(raw[:, me], labels[hold])
        weights[me] = np.concatenate([weights[me][:-1] * a, [weights[me][-1] * a + b]])
        scaled.append(raw[:, me] * a + b)
    combine = fit_newton(np.clip(np.stack(scaled, axis=1), -20, 20), labels[hold])
    return Model(weights[0], weights[1], centre, spread, combine)


def fit_newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """A small logistic fit at the classes' own rate, the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step / max(1.0, float(np.abs(step).max()))
        if float(np.abs(step).max()) < 1e-8:
            break
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = fit_newton(np.clip(z, -30, 30)[:, None], y)
    return max(float(a), 1e-3), float(b)


def _features(texts: list, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray]:
    """Both views of documents, at half precision, as they are kept between rounds."""
    content = [content_features(t or "") for t in texts]
    metadata = [metadata_features(t or "", lang, source) for t, lang, source in zip(texts, langs, sources, strict=True)]
    half = lambda x, n: np.array(x, np.float32).reshape(-1, n).astype(np.float16)
    return half(content, CONTENT), half(metadata, META)


def _wide(data: pa.Array | list, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(data if isinstance(data, list) else data.to_pylist()), np.float16).reshape(-1, n).astype(np.float32)


def _batches(batch: pa.RecordBatch, text: str, lang: str, source: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch in bounded memory, with their features."""
    for part in pieces(batch.column(text)):
        piece = batch.slice(part.start, part.stop - part.start)
        content, metadata = _features(*(piece.column(n).to_pylist() for n in (text, lang, source)))
        yield piece, content, metadata


def _inputs(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> list:
    return [at(docs, text_col).cast("string").alias("text"), at(docs, lang_col).cast("string").alias("lang"), at(docs, source_col).cast("string").alias("source")]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS, hand_over: int = HAND_OVER) -> Model:
    """Fits on at most ``sample`` labelled documents and the whole pool of others.

    Labels other than 0 and 1, null ids and labels of absent documents are left out; a document
    with several labels counts by the smallest, an id with several rows by the least of their
    features. Labelled documents beyond the sample take no part in fitting. Nulls count as in
    ``score``. Of equally sure documents those with smaller ids are handed over. Without labels of
    both classes, as in an empty table, the model scores every document a half.
    """
    require(docs, id_col, text_col, lang_col, source_col)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    kind = dict(docs.dtypes)[id_col]
    known = labels.where(at(labels, label_col).isin(0, 1) & at(labels, id_col).isNotNull()).groupBy(at(labels, id_col).cast(kind).alias("id")).agg(F.min(at(labels, label_col).cast("int")).alias("y"))
    rows = docs.select(at(docs, id_col).alias("id"), *_inputs(docs, text_col, lang_col, source_col)).where("id IS NOT NULL")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, content, metadata in _batches(batch, "text", "lang", "source"):
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array([x.tobytes() for x in f], pa.binary()) for f in (content, metadata))], names=["id", "content", "metadata"])

    features = scratch.save(rows.mapInArrow(run, f"id {kind}, content binary, metadata binary"), "features")
    order = F.xxhash64(F.lit(3), F.col("id"))
    chosen = known.join(features.select("id").distinct(), "id", "left_semi").orderBy(order, "id").limit(sample)
    chosen = scratch.save(chosen.withColumn("hold", F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(HELD_OUT)) == 0), "chosen")
    pool = features.join(known.select("id"), "id", "left_anti")
    pool = scratch.save(pool.groupBy("id").agg(F.min(F.struct("content", "metadata")).alias("f")).select("id", "f.*"), "pool")
    # at most ``sample`` small rows: the bound above is the proof for the broadcast
    got = features.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("content", "metadata", "y", "hold")).alias("f")).select("id", "f.*").collect()
    got.sort(key=lambda r: r["id"])
    scratch.drop("features")

    def surest(model: Model, wanted: dict[tuple[int, int], int]) -> dict[tuple[int, int], list[tuple]]:
        @released
        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    piece = batch.slice(i, 1024)
                    p = sigmoid(model.views(_wide(piece.column(1), CONTENT), _wide(piece.column(2), META)))
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["id", "p0", "p1"])

        scored = scratch.save(pool.mapInArrow(scores, f"id {kind}, p0 double, p1 double"), "scored")
        best = {}
        for (me, c), n in wanted.items():
            sure = F.col(f"p{me}") if c else 1 - F.col(f"p{me}")
            # a bounded number of ids for each view and class
            best[me, c] = [tuple(r) for r in scored.select("id", sure.alias("sure")).where(F.col("sure") >= CONFIDENT).orderBy(F.desc("sure"), "id").limit(n).collect()]
        ids = sorted({i for b in best.values() for i, _ in b})
        rows = pool.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], f"id {kind}")), "id").collect() if ids else []
        by_id = {r["id"]: (_wide([bytes(r["content"])], CONTENT)[0], _wide([bytes(r["metadata"])], META)[0]) for r in rows}
        return {k: [(i, *by_id[i], sure) for i, sure in b] for k, b in best.items()}

    y, hold = np.array([r["y"] for r in got], np.int64), np.array([r["hold"] for r in got], bool)
    model = co_train(_wide([bytes(r["content"]) for r in got], CONTENT), _wide([bytes(r["metadata"]) for r in got], META), y, hold, surest, rounds, hand_over)
    scratch.drop()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The id, ``content_score``, ``metadata_score`` and ``score`` (probability of good quality)
    of every row. Null texts count as empty, null languages and sources as kinds of their own; ids
    are passed on, null or repeated. Other columns take no part. An empty table gives an empty table."""
    require(docs, id_col, text_col, lang_col, source_col)
    kind = docs.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, content, metadata in _batches(batch, "text", "lang", "source"):
                content, metadata = content.astype(np.float32), metadata.astype(np.float32)
                views = sigmoid(model.views(content, metadata))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(views[:, 0]), pa.array(views[:, 1]), pa.array(model.score(content, metadata))], names=["id", "content_score", "metadata_score", "score"])

    made = docs.select(at(docs, id_col).alias("id"), *_inputs(docs, text_col, lang_col, source_col)).mapInArrow(run, f"id {kind}, content_score double, metadata_score double, score double")
    return made.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rows whose score is under the threshold; columns as they are, whatever
    their names. Nulls count as in ``score``; repeated rows go or stay together; a row at the
    threshold stays. An empty table gives an empty table."""
    require(docs, text_col, lang_col, source_col)
    # by number, since names can hold dots or clash
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    columns = [f.name for f in fields]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, content, metadata in _batches(batch, "text", "lang", "source"):
                good = model.score(content.astype(np.float32), metadata.astype(np.float32)) >= threshold
                kept = piece.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(kept.columns[: len(columns)], names=columns)

    rows = docs.select(*(at(docs, c).alias(n) for c, n in zip(docs.columns, columns, strict=True)), *_inputs(docs, text_col, lang_col, source_col))
    return rows.mapInArrow(run, T.StructType(fields)).toDF(*docs.columns)
