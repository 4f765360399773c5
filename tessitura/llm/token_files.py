"""Token files: length-delimited binary records with masked checksums and an offset index.

A record file is a run of frames, each
``length: u64 | masked crc32 of those 8 bytes: u32 | payload | masked crc32 of the payload: u32``,
all little-endian. A payload is ``flags: u8 | document id: i64 | token ids``; bit 0 of the flags
says that the id is null, and the ids are unsigned integers of 2 or 4 bytes, as bit 1 says
(4 if set). The index beside it (``.idx``) has a 24-byte entry for each record, ``offset: u64 |
length of the frame: u64 | number of ids: u64``, so that any record can be read by itself.
A checksum's mask is a rotation by 15 bits and an added constant, as checksums of data that
hold checksums are otherwise weak.

The writer deals rows to ranges of ids, whose ends come from quantiles of the id column alone,
sorts each range and encodes while it writes. A file appears under its own name only when it is
whole, so a task that runs again leaves one good copy. The files hold all rows; the driver sees
the range ends only, whose number is the number of ranges.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessitura.llm.common import at, require
from tessitura.llm.tokenization import ChunkEncoder, encoder_for, pieces

#: Fixed value of the checksum mask.
MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8")])
#: A range's records go on in a new file beyond this size.
FILE_BYTES = 512 << 20


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked_crc(size).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def unframe(data: bytes, offset: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``offset`` and the offset of the next; checks both checksums."""
    size = data[offset : offset + 8]
    if len(size) < 8 or masked_crc(size) != int.from_bytes(data[offset + 8 : offset + 12], "little"):
        raise ValueError(f"bad length at offset {offset}")
    end = offset + 12 + int.from_bytes(size, "little")
    payload = data[offset + 12 : end]
    if masked_crc(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"bad payload at offset {offset}")
    return payload, end + 4


def payload_of(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return bytes([(doc_id is None) | (wide << 1)]) + (doc_id or 0).to_bytes(8, "little", signed=True) + ids


def parse_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    ids = np.frombuffer(payload, "<u4" if payload[0] & 2 else "<u2", offset=9)
    return (None if payload[0] & 1 else int.from_bytes(payload[1:9], "little", signed=True)), ids


def id_ranges(docs: DataFrame, id_col: str, n: int) -> list:
    """Up to ``n - 1`` ascending ids that part the rows into about equal ranges."""
    ends = docs.agg(F.percentile_approx(at(docs, id_col), [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    return sorted({e for e in ends or [] if e is not None})


def range_of(column: Column, ends: list) -> Column:
    """The number of the range: how many ends are at or below the id; null ids come first."""
    if not ends:
        return F.lit(0)
    array, size = F.array(*[F.lit(int(e)) for e in ends]), len(ends)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length()))])

    def halve(low: Column, step: Column) -> Column:
        there = (low + step <= size) & (F.get(array, F.least(low + step, F.lit(size)) - 1) <= column)
        return F.when(there, low + step).otherwise(low)

    low = F.aggregate(steps, F.lit(0), halve)
    return F.coalesce(low, F.lit(0)).cast("int")


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes all documents in ascending id order.

    Returns the manifest, a row for each file in order of its documents: ``shard`` (range),
    ``part`` (of the range), ``path``, ``n_records``, ``n_tokens``, ``n_bytes``. A null text
    counts as empty: its record holds the end id alone. Null ids come first; repeated ids stand
    beside each other, in order of their texts. Other columns take no part. An empty table writes no file.
    ``out_dir`` is a URI of a folder that all executors share. Ids must be integers.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    data = spark.sparkContext.broadcast(content)
    vocabulary = max(ChunkEncoder(content).tok.get_vocab(with_added_tokens=True).values())
    wide = max(vocabulary, end_id) > 0xFFFF
    rows = docs.select(at(docs, id_col).cast("long").alias("id"), at(docs, text_col).alias("text"))
    ends = id_ranges(rows, "id", ranges)
    dealt = rows.withColumn("shard", range_of(F.col("id"), ends)).repartitionById(len(ends) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_for(data.value)
        kind = np.dtype("<u4" if wide else "<u2")
        end = np.array([end_id], kind).tobytes()
        where, root = fs.FileSystem.from_uri(out_dir)
        where.create_dir(root)
        attempt = TaskContext.get().taskAttemptId()
        out, made = None, []

        def close() -> None:
            nonlocal out
            out["file"].close()
            with where.open_output_stream(f"{out['temp']}.idx") as f:
                f.write(np.array(out["index"], INDEX).tobytes())
            for tail in (".idx", ""):
                where.move(out["temp"] + tail, f"{root}/{out['name']}.rec{tail}")
            made.append((out["shard"], out["part"], f"{out['name']}.rec", len(out["index"]), sum(x[2] for x in out["index"]), out["at"]))
            out = None

        for batch in batches:
            for part in pieces(batch.column(1)):
                flat, sizes = encoder.encode(batch.column(1)[part])
                packed, ends = memoryview(flat.astype(kind).tobytes()), np.cumsum(sizes) * kind.itemsize
                last = 0
                for doc_id, upto, shard in zip(batch.column(0)[part].to_pylist(), ends.tolist(), batch.column(2)[part].to_pylist(), strict=True):
                    number = 0
                    if out is not None and (out["shard"] != shard or out["at"] >= FILE_BYTES):
                        number = out["part"] + 1 if out["shard"] == shard else 0
                        close()
                    if out is None:
                        name = f"shard-{shard:06d}-{number:04d}"
                        temp = f"{root}/.{name}-{attempt}"
                        out = {"shard": shard, "part": number, "name": name, "temp": temp, "file": where.open_output_stream(temp), "index": [], "at": 0}
                    record = frame(payload_of(doc_id, bytes(packed[last:upto]) + end, wide))
                    out["file"].write(record)
                    out["index"].append((out["at"], len(record), (upto - last + len(end)) // kind.itemsize))
                    out["at"] += len(record)
                    last = upto
        if out is not None:
            close()
        columns = list(zip(*made, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "part", "path", "n_records", "n_tokens", "n_bytes"])

    made = dealt.mapInArrow(run, "shard int, part int, path string, n_records long, n_tokens long, n_bytes long")
    made.write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.schema(made.schema).parquet(f"{out_dir}/manifest")


def read_token_files(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """Reads all files back: a row for each record, ``id``, ``start`` (ids of all records before
    it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian u32), and ``token_ids`` if asked.

    Raises if a checksum or the index does not fit. The running sum over files sees a row a file. Null
    ids come back null, records that share an id are rows of their own, and files of an empty table
    (a manifest without entries) give an empty table.
    """
    schema = "shard int, part int, path string, n_records long, n_tokens long, n_bytes long"
    files = spark.read.schema(schema).parquet(f"{out_dir}/manifest")
    ordered = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("n_tokens").over(ordered), F.lit(0)).alias("base"), F.row_number().over(Window.orderBy("shard", "part")).alias("k"))
    fields = [T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else fields)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = read_index(where, f"{root}/{path}")
                start, rows = base, []
                with where.open_input_stream(f"{root}/{path}") as f:
                    for entry in index:
                        payload, _ = unframe(f.read(int(entry["length"])))
                        doc_id, ids = parse_payload(payload)
                        if len(ids) != entry["n_tokens"]:
                            raise ValueError(f"the index of {path} does not fit")
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                        start += len(ids)
                        if len(rows) >= 4096:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

    return files.repartition(tasks, "k").select("path", "base").mapInArrow(run, schema)


def read_index(where: fs.FileSystem, path: str) -> np.ndarray:
    with where.open_input_stream(f"{path}.idx") as f:
        return np.frombuffer(f.read(), INDEX)


class TokenFile:
    """One record file, read by record number; ``shuffled`` goes through it in a seeded order."""

    def __init__(self, uri: str):
        self.where, self.path = fs.FileSystem.from_uri(uri)
        self.index = read_index(self.where, self.path)
        self.file = self.where.open_input_file(self.path)

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, k: int) -> tuple[int | None, np.ndarray]:
        entry = self.index[k]
        return parse_payload(unframe(self.file.read_at(int(entry["length"]), int(entry["offset"])))[0])

    def shuffled(self, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
        order = list(range(len(self)))
        random.Random(seed).shuffle(order)
        return (self[k] for k in order)
