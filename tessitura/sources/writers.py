"""Writers: datasets, JSON lines, whole-or-nothing sidecar files, wave files."""

from __future__ import annotations

import io
import json
import os
import tarfile
import tempfile
import uuid
import wave
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

TRAINING_COLUMNS = ("input_ids", "labels", "attention_mask", "reference_text", "speaker_id", "duration", "dnsmos")


def write_dataset(df: DataFrame, path: str, records_per_file: int = 0) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", records_per_file) if records_per_file else writer).parquet(path)


def write_training(df: DataFrame, path: str) -> None:
    """Training rows, with the known columns that are there."""
    write_dataset(df.select([c for c in TRAINING_COLUMNS if c in df.columns]), path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; characters beyond ASCII stay as they are."""
    df.write.mode("overwrite").json(path)


def write_pairs(pairs: DataFrame, path: str) -> tuple[int, int]:
    """Writes accepted pairs as JSON lines; returns how many were accepted and rejected. Both counts
    are seen by the one pass that writes."""
    seen = Observation()
    counted = pairs.observe(seen, F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
    write_lines(counted.where("reject_reason IS NULL").drop("reject_reason"), path)
    return int(seen.get["accepted"]), int(seen.get["rejected"])


def write_tars(rows: DataFrame, folder: str, archives: int) -> int:
    """(stem, audio binary, text, duration) as tar archives, ``stem.json`` and ``stem.wav`` side by
    side, dealt by stem; an archive appears when it is whole. Returns how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root)
        name, aside = None, f"{root}/.{uuid.uuid4().hex}"
        for batch in batches:
            for row in batch.to_pylist():
                if name is None:
                    name = f"{root}/{row['number']:06d}.tar"
                    stream = where.open_output_stream(aside)
                    tar = tarfile.open(fileobj=stream, mode="w|")
                meta = json.dumps({"text": row["text"], "duration": row["duration"]}, ensure_ascii=False).encode()
                for suffix, data in ((".json", meta), (".wav", row["audio"])):
                    info = tarfile.TarInfo(row["stem"] + suffix)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        if name is not None:
            tar.close()
            stream.close()
            where.move(aside, name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    dealt = rows.withColumn("number", F.pmod(F.xxhash64("stem"), F.lit(archives)).cast("int")).repartitionById(archives, F.col("number"))
    return dealt.select("number", "stem", "audio", "text", "duration").mapInArrow(run, "path string").count()


def save_waves(rows: DataFrame, folder: str, name: str, wave_column: str, rate: int = 24000) -> DataFrame:
    """Writes a WAV file for each row under its name, by all tasks; null waveforms are left out.
    Returns (name, samples) of what was written, when it is read; ``folder`` is a shared URI."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root)
        for batch in batches:
            done: list[tuple[str, int]] = []
            for own, samples in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if samples.is_valid:
                    aside = f"{root}/.{uuid.uuid4().hex}"
                    with where.open_output_stream(aside) as f:
                        f.write(wave_bytes(samples.values.to_numpy(zero_copy_only=False), rate))
                    where.move(aside, f"{root}/{own}.wav")
                    done.append((own, len(samples)))
            columns = list(zip(*done, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["name", "samples"])

    return rows.select(F.col(name).cast("string"), F.col(wave_column).cast("array<double>")).mapInArrow(run, "name string, samples long")


def publish(content: bytes, path: str) -> None:
    """A small driver-side file that is there whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def publish_json(value: Mapping, path: str) -> None:
    publish((json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode(), path)


def wave_bytes(samples, rate: int) -> bytes:  # noqa: ANN001
    """16-bit mono."""
    data = (np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).round().astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(data.tobytes())
    return out.getvalue()


def save_wave(samples, path: str, rate: int = 24000) -> bool:  # noqa: ANN001
    """One file on the driver; a null waveform writes nothing."""
    if samples is None:
        return False
    with open(path, "wb") as f:
        f.write(wave_bytes(samples, rate))
    return True
