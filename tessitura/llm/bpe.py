"""BPE encoding and decoding by tree concatenation.

Every text longer than a leaf is halved, and its halves are, down to leaves; all leaves of a piece
of the input are encoded together, and joined by encoding growing windows around each join
until both sides agree (``tokenization.TreeEncoder``). Leaves are encoded chunk by chunk from
a table of the chunks met so far. Vocabularies that are not byte-level have no tree: their texts
are encoded from the table alone. The result is exactly the library's for the whole text.

The work is one narrow pass: no shuffle, one row in and one row out, rows of any length; a lost
executor costs only the partitions it held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessitura.llm.common import at, require
from tessitura.llm.tokenization import TRIM_BYTES, Decoder, TreeEncoder, encoder_for, pieces, trim

#: Bytes of text that are encoded at once, and entries of a worker's table of chunks: the stage of a pipeline
#: shares its executors with what earlier stages left there, so it takes less than it could use.
PIECE_BYTES, TABLE = 512 << 10, 150_000

#: What ``bpe`` can return beside the id and ``n_tokens``.
OUTPUTS = {
    "token_ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def bpe(docs: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("token_ids",), id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 2048) -> DataFrame:
    """Encodes every whole text, and decodes it again where an output needs that.

    Returns the id, ``n_tokens`` and the named ``outputs`` (keys of ``OUTPUTS``), a row for each
    row of ``docs``. A null text counts as empty: no ids, empty decoded text. Ids are passed on
    as they are, null or repeated; other columns of ``docs``, whatever their names, take no part.
    An empty table gives an empty table. The vocabulary file is read on the driver and sent to
    the workers; it is a few MB at most whatever the input is.
    """
    require(docs, id_col, text_col)
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    with open(tokenizer_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, data.value, outputs, leaf_chars)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, OUTPUTS[n]) for n in outputs)])
    made = docs.select(at(docs, id_col).alias("id"), at(docs, text_col).alias("text")).mapInArrow(run, schema)
    return made.withColumnRenamed("id", id_col)


def encoded(batches: Iterator[pa.RecordBatch], data: bytes, outputs: tuple[str, ...], leaf_chars: int) -> Iterator[pa.RecordBatch]:
    """For batches of (id, text): the columns of ``bpe``. A worker's memory is its table of up to ``TABLE`` chunks and
    what a piece of text takes, since what earlier pieces and tasks left goes back to the system."""
    trim()
    encoder = encoder_for(data, TABLE)
    encode = (TreeEncoder(encoder, leaf_chars) if encoder.spaced and encoder.plain else encoder).encode
    decoder = Decoder(data) if {"decoded", "decoded_sha256"} & set(outputs) else None
    done = 0
    for batch in batches:
        for part in pieces(batch.column(1), PIECE_BYTES):
            texts = batch.column(1)[part]
            ids, sizes = encode(texts.to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            columns = [batch.column(0)[part], pa.array(sizes)]
            runs = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            if decoder is not None:
                decoded = [decoder.decode_bytes(ids[a:b].tolist()) for a, b in runs]
            for name in outputs:
                if name == "token_ids":
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                elif name == "ids_sha256":
                    columns.append(pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in runs]))
                elif name == "decoded":
                    columns.append(pa.array([d.decode(errors="replace") for d in decoded]))
                else:
                    columns.append(pa.array([hashlib.sha256(d.decode(errors="replace").encode()).hexdigest() for d in decoded]))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", *outputs])
            done += pc.sum(pc.binary_length(texts)).as_py() or 0
            if done >= TRIM_BYTES:
                trim()
                done = 0
    trim()
