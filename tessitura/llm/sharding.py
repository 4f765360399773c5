"""Sharding by jump consistent hashing: a stable key and the number of shards give the shard.

There is no ring table. When shards are appended, a row stays or goes to one of the new shards,
and only the necessary fraction goes. Everything is built-in column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import at, fresh, require

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
#: Jumps worked out in the first loop; keys that need more go on in a second one.
FIRST_JUMPS = 24
#: Numbering works on this many slices of each shard at once.
SLICES = 1024


def _times_plus_one(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2**64 in 64-bit steps that never overflow: the key's
    low 32 bits meet the multiplier's 16-bit pieces, and its high ones only the lowest 32 bits."""
    low, high = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32)
    m = [(MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    a0, a1, a2, a3 = (low * F.lit(x) for x in m)
    # sums of the pieces below 2**50, then carried; the top 32 bits are kept modulo 2**32
    bottom = a0 + F.shiftleft(a1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    top = F.shiftrightunsigned(bottom, 32) + F.shiftrightunsigned(a1, 16) + a2 + F.shiftleft(a3.bitwiseAND(F.lit(0xFFFF)), 16) + high * F.lit(m[0]) + F.shiftleft((high * F.lit(m[1])).bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftleft(top.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(bottom.bitwiseAND(F.lit(0xFFFFFFFF)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard from 0 to ``shards - 1`` of a long key, as the published algorithm has it.

    A null key has shard null. Each jump goes at least one shard on, so ``shards`` jumps always end.
    """
    if shards < 1:
        raise ValueError("there must be a shard")

    def jump(state: Column, _: Column) -> Column:
        # `at` is the last shard reached, `to` the next; once `to` is past the end nothing changes
        going = state["to"] < F.lit(shards)
        key = F.when(going, _times_plus_one(state["key"])).otherwise(state["key"])
        to = F.floor((state["to"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(key, 33) + 1).cast("double"))).cast("long")
        return F.struct(key.alias("key"), F.when(going, state["to"]).otherwise(state["at"]).alias("at"), F.when(going, to).otherwise(state["to"]).alias("to"))

    def jumps(state: Column, most: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, jump)

    first = jumps(F.struct(key.cast("long").alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to")), min(shards + 1, FIRST_JUMPS))
    if shards + 1 > FIRST_JUMPS:
        first = F.transform(F.array(first), lambda s: F.when(s["to"] >= shards, s).otherwise(jumps(s, shards)))[0]
    return F.when(key.isNotNull(), first["at"].cast("int"))


def string_key(column: Column) -> Column:
    """A long key for a column of any type."""
    return F.xxhash64(column.cast("string"))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", grown: int | None = None) -> DataFrame:
    """Puts every row into a shard by its id; returns ``docs`` with the columns ``size`` (bytes of
    the text and 1), ``text_crc32``, ``shard``, ``slot`` (from 0 in each shard, without gaps) and,
    for ``grown`` shards, ``grown_shard``.

    A null text has no bytes and the checksum 0. Rows with a null id go by the hash of null, like
    any other key; repeated rows share a shard and have slots of their own. Where ``docs`` has
    a column of one of these names, the new one gets underscores before it. An empty table gives
    an empty table. Slots follow slices of the key's hash, then the id: each slice is numbered by
    itself from the sum of the slices before it, so no task holds a shard, however large it is.
    """
    require(docs, id_col, text_col)
    names = {n: fresh(docs, n) for n in ("size", "text_crc32", "shard", "slot", "grown_shard")}
    key, text = at(docs, id_col), at(docs, text_col)
    key = F.coalesce(key.cast("long") if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else string_key(key), F.xxhash64(F.lit(None).cast("string")))
    rows = docs.withColumns({names["size"]: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, names["text_crc32"]: F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")), names["shard"]: jump_hash(key, shards)} | ({names["grown_shard"]: jump_hash(key, grown)} if grown else {}))
    return number(rows, names["shard"], id_col, [names["size"], names["text_crc32"]], names["slot"])


def number(rows: DataFrame, group: str, id_col: str, ties: list[str], slot: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps: slices by hash, sums of slices, ranks in slices."""
    from pyspark.sql.window import Window

    part, before, rank = (fresh(rows, n) for n in ("slice", "before", "rank"))
    rows = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(17), at(rows, id_col).cast("string")), F.lit(SLICES)).cast("int"))
    counts = rows.groupBy(group, part).count()
    counts = counts.select(group, part, (F.sum("count").over(Window.partitionBy(group).orderBy(part)) - F.col("count")).alias(before))
    inside = Window.partitionBy(group, part).orderBy(F.col("`" + id_col + "`").asc_nulls_first(), *ties)
    ranked = rows.withColumn(rank, F.row_number().over(inside))
    return ranked.join(counts, [group, part], "left").withColumn(slot, (F.col(before) + F.col(rank) - 1).cast("long")).drop(part, before, rank)
