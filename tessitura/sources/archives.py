"""Tar archives of any size: an index of their members from headers alone, and members read by offset.

One pass over an archive's 512-byte headers, which skips the contents, gives a row for each member. Members are
paired by stem as rows, and the pairs are dealt to tasks in ranges of archive and offset, so that one
archive is read by many tasks and none holds more than a few members. Archives that are compressed as a whole have
no offsets; each of those is read from end to end by one task, member by member. Files are opened
through Arrow's file systems.
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO_SUFFIXES = (".mp3", ".wav", ".flac")
#: Bytes of members that a task reads, about, and of a batch that it hands on.
TASK_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
INDEX = "path string, name string, offset long, size long, place int, compressed boolean"
ROWS = "path string, stem string, audio binary, audio_name string, text string, speaker string, duration double, dnsmos double"
_ARROW = pa.schema([("path", pa.string()), ("stem", pa.string()), ("audio", pa.binary()), ("audio_name", pa.string()), ("text", pa.string()), ("speaker", pa.string()), ("duration", pa.float64()), ("dnsmos", pa.float64())])
_BROKEN = (tarfile.TarError, EOFError, OSError)


def opened(path: str) -> pa.NativeFile:
    where, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(place.removeprefix("file:"))


def members(content: BinaryIO) -> Iterator[tuple[str, int, int]]:
    """(name, offset of its bytes, size) of the files in an archive, up to its end or a damaged place."""
    try:
        with tarfile.open(fileobj=content, mode="r:") as tar:
            for m in tar:
                if m.isfile() and not m.issparse():
                    yield m.name, m.offset_data, m.size
                tar.members = []  # nothing is kept of what was seen
    except _BROKEN:
        return


def tar_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file in the archives: name, offset, size and place in the archive; an archive that is
    compressed as a whole has one row, without them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[dict] = []
                with opened(name) as content:
                    packed = content.read(6)
                    content.seek(0)
                    if packed.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ")):
                        rows.append({"path": name, "compressed": True})
                    else:
                        for place, (member, offset, size) in enumerate(members(content)):
                            rows.append({"path": name, "name": member, "offset": offset, "size": size, "place": place, "compressed": False})
                            if len(rows) == 10_000:
                                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                                rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(scan, INDEX)


_INDEX = pa.schema([("path", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("place", pa.int32()), ("compressed", pa.bool_())])


def pairs_of(index: DataFrame) -> DataFrame:
    """A row for each ``stem.json`` with the first of its ``.mp3``, ``.wav`` and ``.flac``; of members with one
    name the last counts."""
    files = index.where(~F.col("compressed"))
    suffix = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    files = files.withColumns({"suffix": suffix, "stem": F.expr("left(name, length(name) - length(regexp_extract(name, '([.][^.]*)$', 1)))")}).where(F.col("suffix").isin(".json", *AUDIO_SUFFIXES))
    last = lambda s: F.max_by(F.struct("name", "offset", "size"), F.when(F.col("suffix") == s, F.col("place"))).alias(s[1:])
    there = files.groupBy("path", "stem").agg(*(last(s) for s in (".json", *AUDIO_SUFFIXES)))
    some = lambda s: F.when(F.col(s[1:])["name"].endswith(s), F.col(s[1:]))  # noqa: E731 - none had the suffix: any row
    there = there.select("path", "stem", some(".json").alias("json"), F.coalesce(*(some(s) for s in AUDIO_SUFFIXES)).alias("audio"))
    return there.where(F.col("json").isNotNull() & F.col("audio").isNotNull())


def row_of(path: str, stem: str, audio_name: str, meta: bytes, audio: bytes) -> dict | None:
    """An utterance, or None where its description is none or has no text."""
    try:
        said = json.loads(meta)
        text = said.get("text")
        if not isinstance(text, str) or not text.strip():
            return None
        number = lambda key: None if said.get(key) is None else float(said[key])
        speaker = said.get("speaker")
        return {"path": path, "stem": stem, "audio": audio, "audio_name": audio_name, "text": text.strip(), "speaker": None if speaker is None else str(speaker), "duration": number("duration"), "dnsmos": number("dnsmos")}
    except (ValueError, TypeError, AttributeError):
        return None


def pair_members(path: str, content: BinaryIO) -> Iterator[dict]:
    """Utterances of one archive that is read from end to end, by name."""
    found: dict[str, tarfile.TarInfo] = {}
    try:
        tar = tarfile.open(fileobj=content)
        for m in tar:
            if m.isfile():
                found[m.name] = m
    except _BROKEN:
        if not found:
            return
    for name in sorted(found):
        stem, dot, suffix = name.rpartition(".")
        audio = next((stem + s for s in AUDIO_SUFFIXES if stem + s in found), None)
        if not dot or suffix != "json" or audio is None:
            continue
        try:
            row = row_of(path, stem, audio, tar.extractfile(found[name]).read(), tar.extractfile(found[audio]).read())
        except _BROKEN:
            continue
        if row:
            yield row


def _batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["audio"])
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def _fetched(pairs: Iterator[dict]) -> Iterator[dict]:
    name, content = None, None
    try:
        for p in pairs:
            if p["path"] != name:
                if content is not None:
                    content.close()
                name, content = p["path"], opened(p["path"])
            parts = []
            for m in (p["json"], p["audio"]):
                content.seek(m["offset"])
                parts.append(content.read(m["size"]))
            if [len(x) for x in parts] == [p["json"]["size"], p["audio"]["size"]]:  # else the archive ends within it
                row = row_of(name, p["stem"], p["audio"]["name"], *parts)
                if row:
                    yield row
    finally:
        if content is not None:
            content.close()


def read_tars(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar archives paired by stem: ``stem.json`` with the first of its ``.mp3``, ``.wav`` and ``.flac``.
    Archives may be of any size; a task holds a pair at a time and a batch of small ones. Members
    that cannot be paired or parsed, texts that are blank or no text, and what follows a damaged place of an archive
    are left out. Texts come stripped."""
    index = tar_index(spark, path)
    pairs = pairs_of(index)
    total = pairs.agg(F.sum(F.col("json.size") + F.col("audio.size"))).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    dealt = pairs.repartitionByRange(int(tasks), "path", F.col("audio.offset")).sortWithinPartitions("path", "audio.offset")
    fetch = lambda batches: _batched(_fetched(row for b in batches for row in b.to_pylist()))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as content:
                    yield from _batched(pair_members(name, content))

    packed = index.where("compressed").select("path").mapInArrow(stream, ROWS)
    return dealt.mapInArrow(fetch, ROWS).unionAll(packed)
