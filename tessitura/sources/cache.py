"""The shard cache: what has been made of which source files under which settings.

Source files are a table with a key for each, from path, size and time of change, so a file
that is replaced is another shard. A cache is a folder named by the digest of all keys and of
the settings that its contents depend on. Rows go in by attempts, each in a folder of its own, and
count once the attempt's log entries are there: one for each shard that it made, with its number of rows, be
it none. What is left to do is an anti join with the log, so a shard all of whose rows were rejected is done, and
an attempt that broke off has left nothing that a reader sees. Of two attempts at a shard the later one holds.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.sources import shared

LAYOUT = 2
KEY_HEX = 20
LOG = "shard string, attempt long, rows long"


def source_files(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """(shard, path, length, modified) of all files under the paths; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(list(paths)).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.select(shard_key(F.col("path"), F.col("length"), F.col("modified")).alias("shard"), "path", "length", "modified")


def shard_key(path: Column, length: Column, modified: Column) -> Column:
    """A readable stem and the digest of all that identifies the file."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), r"[^0-9A-Za-z_.-]", "_")
    identity = F.concat_ws("\x1f", path, length.cast("string"), F.unix_micros(modified).cast("string"))
    return F.concat(stem, F.lit("-"), F.left(F.sha2(identity.cast("binary"), 256), F.lit(KEY_HEX)))


def digest(files: DataFrame, settings: Mapping[str, object]) -> str:
    """The digest of the set of shards and of the settings, in whatever order they come. Shards meet by the
    first digits of their keys, so no task sees them all at once."""
    bucket = F.substring(F.substring_index("shard", "-", -1), 1, 2).alias("bucket")
    parts = files.select("shard", bucket).distinct().groupBy("bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("shard")), "\n").cast("binary"), 256).alias("part"))
    rows = [f"{r['bucket']}={r['part']}" for r in parts.orderBy("bucket").collect()]  # 256 at most
    lines = [f"{k}={settings[k]!r}" for k in sorted(settings)]
    one = files.sparkSession.range(1).select(F.sha2(F.lit("\n".join([f"layout={LAYOUT}", *lines, *rows])).cast("binary"), 256))
    return one.first()[0]


class TokenCache:
    """Rows made of ``files`` under ``settings``, in ``root``. A folder whose record does not fit is an error."""

    def __init__(self, files: DataFrame, settings: Mapping[str, object], root: str):
        self.spark, self.files, self.settings = files.sparkSession, files, dict(settings)
        self.key = digest(files, settings)
        self.folder = f"{root.rstrip('/')}/cache-{self.key[:40]}"
        record = {"layout": LAYOUT, "key": self.key, "settings": {k: repr(v) for k, v in self.settings.items()}, "files": files.count()}
        place = f"{self.folder}/record.json"
        if not shared.exists(self.spark, place):
            shared.publish_json(self.spark, record, place)
        elif shared.read_json(self.spark, place) != record:
            raise RuntimeError(f"the record in {self.folder} is of something else")

    def log(self) -> DataFrame:
        """(shard, attempt, rows): the last finished attempt at each shard."""
        logs = [f"{self.folder}/log/{n}" for n in shared.folders(self.spark, f"{self.folder}/log") if shared.exists(self.spark, f"{self.folder}/log/{n}/_SUCCESS")]
        if not logs:
            return self.spark.createDataFrame([], LOG)
        entries = self.spark.read.schema(LOG).parquet(*logs)
        return entries.groupBy("shard").agg(F.max_by(F.struct("attempt", "rows"), "attempt").alias("last")).select("shard", "last.attempt", "last.rows")

    def finished(self) -> DataFrame:
        """(shard, rows) of the shards that are done, those without rows too."""
        return self.log().select("shard", "rows")

    def remaining(self) -> DataFrame:
        """Source files whose shard is not finished."""
        return remaining(self.files, self.log())

    def add(self, rows: DataFrame, shards: DataFrame) -> None:
        """Rows with a ``shard`` column, made of all of ``shards`` (a table with their keys), some of which may
        have no rows. A shard's rows come in one call; a later call for it replaces them. Rows of other
        shards are an error, found before anything counts."""
        numbers = [int(n.removeprefix("attempt=")) for kind in ("log", "rows") for n in shared.folders(self.spark, f"{self.folder}/{kind}")]
        attempt = max(numbers, default=0) + 1
        place = f"{self.folder}/rows/attempt={attempt:08d}"
        rows.write.partitionBy("shard").parquet(place)
        schema = f"{self.folder}/schema.json"
        if not shared.exists(self.spark, schema):
            shared.publish_json(self.spark, {"schema": rows.schema.json()}, schema)
        made = self.spark.read.schema(rows.schema).parquet(place).groupBy("shard").agg(F.count("*").alias("n"))
        both = shards.select("shard", F.lit(True).alias("asked")).distinct().join(made, "shard", "full")
        checked = F.when(F.col("asked"), F.coalesce("n", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("rows of another shard: "), F.col("shard"))).cast("long"))
        both.select("shard", F.lit(attempt).cast("long").alias("attempt"), checked.alias("rows")).write.parquet(f"{self.folder}/log/attempt={attempt:08d}")

    def rows(self) -> DataFrame:
        """All rows of finished shards; those of broken and replaced attempts are left out."""
        from pyspark.sql.types import LongType, StructField, StructType

        schema = StructType.fromJson(json.loads(shared.read_json(self.spark, f"{self.folder}/schema.json")["schema"]))
        whole = StructType([*schema.fields, StructField("attempt", LongType())])
        there = self.spark.read.schema(whole).option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")
        return there.join(self.log().where("rows > 0").select("shard", "attempt"), ["shard", "attempt"], "left_semi").select(*schema.names)


def remaining(shards: DataFrame, done: DataFrame, key: str = "shard") -> DataFrame:
    """Source shards without an output."""
    return shards.join(done.select(key).distinct(), key, "left_anti")


def worker_of(index: str, workers: int) -> Column:
    return F.pmod(F.col(index), F.lit(workers))


def shard_rows(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """Rows dealt to ``part`` 0 to parts - 1 in turn by a gapless number; sorted by (part, number) they
    come back as dealt, sorted by the number as they were."""
    return rows.withColumn("part", F.pmod(F.col(order), F.lit(parts)))


def skip_if_there(spark: SparkSession, path: str, make) -> DataFrame:  # noqa: ANN001
    """The table at ``path``: as it is where there is one, else made and written first."""
    if not shared.exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def join_workers(codes: Mapping[str, int]) -> None:
    """After all have ended: an error that names every one that failed."""
    bad = {k: c for k, c in codes.items() if c}
    if bad:
        raise RuntimeError("failed workers: " + ", ".join(f"{k} (exit code {c})" for k, c in bad.items()))
