"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand on a line in the order of a seeded hash, as many words long as the
source, and the line stands ``most`` times in a row: these are the words that a source has to
give. It is cut into blocks of ``block_words`` words, which a keyed permutation of their
numbers (swap-or-not rounds) deals out to places. A source gives as many words as its target: the
blocks at the first places, the last of them cut to fit. The tree says which shard gets which: it
halves the output shards, and at each node the blocks of every source go left or right by one draw
of the multivariate hypergeometric distribution, so each shard gets an exact quota of every
source's blocks, and takes a run of places of its own. What a document gives is what shards take
of the blocks that it lies in. Rows within a shard are ordered by another hash.

Everything is built-in column functions. Positions on a line come from sums of 1,024 slices of
each source's hash range and running sums inside a slice, so a source with a third of all rows
is spread over tasks; whole rows are shuffled once, to their slices. Tables by source and by slice
are aggregates; the quotas are worked out in one row that holds a number for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.common import WORD, Scratch, at, bound_to, fresh, require, unit

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK_WORDS = 4096
SHARDS = 8
SEED = 20240
ROUNDS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``rank`` (by code point, null last), ``weight`` and ``target`` to (source, source_size).

    Targets share the sum of the sizes by weight, none above ``most`` times its size: in order
    of room for its weight, a source is full if its share of what is left would overfill it.
    One task sees a row for each source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)  # the first that is not full has the highest
    return ranked.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))).drop("cap", "level", "full")


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are in a draw of ``drawn``, for a uniform ``u``.

    By inversion, with weights from the ratio of neighbouring probabilities. Values farther
    than 12 standard deviations and 12 from the mean, of probability under 1e-30, are left out.
    """
    share = good / F.greatest(total, F.lit(1))
    mean = drawn * share
    sd = F.sqrt(F.greatest(mean * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    low = F.greatest(F.lit(0), drawn - total + good, F.floor(mean - 12 * sd - 12)).cast("long")
    high = F.least(drawn, good, F.ceil(mean + 12 * sd + 12)).cast("long")

    def ratio(k: Column) -> Column:
        return (good - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (total - good - drawn + k + 1))

    steps = F.sequence(low, high - 1)
    whole = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")), lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"] * ratio(k)).alias("sum")), lambda s: s["sum"])

    def walk(s: Column, k: Column) -> Column:
        w = s["w"] * ratio(k)
        on = s["left"] > s["w"]
        return F.struct(w.alias("w"), F.when(on, s["left"] - s["w"]).otherwise(F.lit(0.0)).alias("left"), F.when(on, k + 1).otherwise(s["k"]).alias("k"))

    pick = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), (u * whole).alias("left"), low.alias("k")), walk, lambda s: s["k"])
    return F.when(high > low, pick).otherwise(low)


def quotas(blocks: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """For (rank, blocks) the sums of quotas: ``upto``, an array of ``shards`` numbers, where
    shard k takes the permuted blocks from ``upto[k - 1]`` to below ``upto[k]``."""
    one = blocks.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("sources"))
    one = one.withColumn("all", F.transform("sources", lambda s: s["blocks"])).withColumn("total", F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x))

    def bound(k: int) -> Column:  # shard sizes are at most one apart
        return F.floor(F.col("total") * k / shards).cast("long")

    leaves: dict[int, str] = {}

    def split(df: DataFrame, name: str, first: int, last: int) -> DataFrame:
        if last - first == 1:
            leaves[first] = name
            return df
        mid = (first + last) // 2
        left, right = f"n{first}_{mid}", f"n{mid}_{last}"

        def draw(s: Column, good: Column) -> Column:
            k = hypergeometric(s["total"], good, s["drawn"], unit(seed, F.lit(first * 65536 + last), F.size(s["out"])))
            return F.struct((s["total"] - good).alias("total"), (s["drawn"] - k).alias("drawn"), F.array_append(s["out"], k).alias("out"))

        start = F.struct((bound(last) - bound(first)).alias("total"), (bound(mid) - bound(first)).alias("drawn"), F.array().cast("array<bigint>").alias("out"))
        df = df.withColumn(left, F.aggregate(name, start, draw, lambda s: s["out"]))
        df = df.withColumn(right, F.zip_with(name, left, lambda a, b: a - b))
        return split(split(df, left, first, mid), right, mid, last)

    one = split(one, "all", 0, shards)
    sums: list[str] = []
    for k in range(shards):
        name = f"upto_{k}"
        one = one.withColumn(name, F.zip_with(sums[-1], leaves[k], lambda a, b: a + b) if sums else F.col(leaves[k]))
        sums.append(name)
    return one.select(F.posexplode("sources").alias("at", "s"), *sums).select(F.col("s.rank").alias("rank"), F.array(*(F.element_at(n, F.col("at") + 1) for n in sums)).alias("upto"))


def permuted(number: Column, size: Column, seed: int, key: Column) -> Column:
    """A keyed permutation of the numbers from 0 to below ``size``: swap-or-not rounds, each of
    which swaps a number with its mirror about a random point, or not, by a bit both share."""

    def step(n: Column, r: Column) -> Column:
        turn = F.floor(unit(seed, r, key) * size).cast("long")
        other = F.pmod(turn - n, size)
        return F.when(unit(seed + 1, r, key, F.greatest(n, other)) < 0.5, other).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), number, step)


def _goals(sizes: DataFrame, weights: tuple[float, ...], most: int, shards: int, block_words: int, seed: int) -> DataFrame:
    """For (key, source, source_size): the target, the number of ``blocks``, how many of them are
    ``given``, the words ``last_words`` of the last of those, and ``upto`` (see ``quotas``).

    All blocks but that of the highest number have ``block_words`` words. Where that one is at one of
    the places given, the words it lacks come from one place more.
    """
    goals = targets(sizes, weights, most)
    goals = goals.withColumn("quota", F.round("target").cast("long")).withColumn("blocks", F.ceil(most * F.col("source_size") / block_words).cast("long"))
    short = (F.col("blocks") * block_words - most * F.col("source_size")).cast("long")  # what the last number lacks
    goals = goals.withColumn("short_at", F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), seed + 1000, F.col("rank"))))
    plain = F.ceil(F.col("quota") / block_words).cast("long")
    goals = goals.withColumn("given", plain + ((F.col("short_at") < plain) & (plain * block_words - short < F.col("quota"))).cast("long"))
    goals = goals.withColumn("given", F.coalesce("given", F.lit(0).cast("long")))
    before = (F.col("given") - 1) * block_words - F.when(F.col("short_at") < F.col("given") - 1, short).otherwise(0)
    goals = goals.withColumn("last_words", F.col("quota") - before)
    return goals.join(quotas(goals.select("rank", F.col("given").alias("blocks")), shards, seed), "rank", "left").select("key", "source_size", "target", "blocks", "given", "last_words", "upto", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED, cut: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Returns the columns ``keep`` of ``docs`` (all by default), a row for each row, with
    ``size``, ``source_size``, ``target``, ``draws`` and ``taken``.

    ``draws`` has an entry for each piece of the document that a shard takes: ``copy`` (of the
    line), ``words``, ``block``, ``shard`` and ``order`` (to sort a shard by). ``taken`` is the sum
    of the words; those of a source come to its target, rounded. With ``cut=False`` documents are
    taken whole: as many copies as the words taken make, rounded up or down with the odds of the
    rest, each in the shard that takes its first piece.

    A null or empty text has size 0 and is taken as often as its place on the line, for 0 words.
    A null source is a source. Null ids and repeated rows are rows like others. Where ``docs``
    has a column of one of the new names, the new one gets underscores before it. An empty table
    gives an empty table. The same rows give the same mix.
    """
    require(docs, id_col, source_col, text_col)
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession, "mix")
    new = {n: fresh(docs, n) for n in ("size", "source_size", "target", "draws", "taken")}
    own = {n: fresh(docs, f"mix_{n}") for n in ("key", "size", "hash", "slice", "tie", "start")}
    key = F.coalesce(F.concat(F.lit("="), at(docs, source_col).cast("string")), F.lit(""))
    spread = F.xxhash64(F.lit(seed), at(docs, id_col).cast("string"), at(docs, source_col).cast("string"))
    rows = docs.withColumns({own["key"]: key, own["size"]: word_count(at(docs, text_col)), own["hash"]: spread, own["slice"]: F.shiftrightunsigned(spread, 54).cast("int")})
    slices = rows.groupBy(own["key"], own["slice"]).agg(F.sum(own["size"]).alias("words")).withColumnsRenamed({own["key"]: "key", own["slice"]: "slice"})
    slices = scratch.save(slices, "slices")
    sources = slices.groupBy("key").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)))
    goals = scratch.save(_goals(sources, weights, most, shards, block_words, seed), "goals")
    starts = slices.select("key", "slice", (F.sum("words").over(Window.partitionBy("key").orderBy("slice")) - F.col("words")).alias("before"))
    # a row for each slice of a source, with what holds for the source
    plan = scratch.save(starts.join(goals, "key"), "plan").withColumnsRenamed({n: f"mix plan {n}" for n in ("before", "source_size", "target", "blocks", "given", "last_words", "upto", "rank")})
    plan = plan.withColumnsRenamed({"key": own["key"], "slice": own["slice"]})
    # equal ids stand by the text; what is equal in all is taken alike
    rows = rows.withColumn(own["tie"], F.xxhash64(at(docs, text_col)))
    inside = Window.partitionBy(own["key"], own["slice"]).orderBy(own["hash"], own["size"], own["tie"]).rowsBetween(Window.unboundedPreceding, 0)
    line = rows.select(*("`" + c.replace("`", "``") + "`" for c in dict.fromkeys([*keep, *(own[n] for n in ("key", "slice", "size", "hash", "tie"))])), (F.sum(own["size"]).over(inside) - F.col(own["size"])).alias(own["start"]))
    line = line.join(plan, [own["key"], own["slice"]])
    p = {n: F.col(f"`mix plan {n}`") for n in ("before", "source_size", "target", "blocks", "given", "last_words", "upto", "rank")}
    start, size = p["before"] + F.col(own["start"]), F.col(own["size"])

    def pieces(copy: Column) -> Column:
        begin = copy * p["source_size"] + start
        last = p["blocks"] - 1
        first = F.least(F.floor(begin / block_words).cast("long"), last)
        numbers = F.sequence(first, F.greatest(first, F.least(F.floor((begin + size - 1) / block_words).cast("long"), last)))

        def piece(block: Column) -> Column:
            def dealt(place: Column) -> Column:
                shard = F.size(F.filter(p["upto"], lambda u: u <= place))
                upto = block * block_words + F.when(place == p["given"] - 1, p["last_words"]).otherwise(block_words)
                words = F.greatest(F.least(begin + size, upto) - F.greatest(begin, block * block_words), F.lit(0))
                order = F.xxhash64(F.lit(seed + 1), block, copy, F.col(own["hash"]), F.col(own["tie"]))
                return F.struct(copy.cast("int").alias("copy"), words.cast("long").alias("words"), block.alias("block"), shard.alias("shard"), order.alias("order"))

            return bound_to(permuted(block, p["blocks"], seed + 1000, p["rank"]), dealt)

        # places from the number of shards on are not given to any
        return F.filter(F.transform(numbers, piece), lambda d: (d["shard"] < shards) & ((d["words"] > 0) | (size == 0)))

    copies = F.sequence(F.lit(0), F.lit(most - 1))
    none = F.array().cast("array<struct<copy:int,words:bigint,block:bigint,shard:int,order:bigint>>")
    by_copy = F.when(p["blocks"] > 0, F.transform(copies, pieces)).otherwise(F.array(none))
    line = line.withColumn("mix plan pieces", by_copy)
    total = lambda d: F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    if cut:
        draws = F.flatten("mix plan pieces")
    else:
        given = F.filter("mix plan pieces", lambda d: F.size(d) > 0)
        ranked = F.sort_array(F.transform(given, lambda d: F.struct((-total(d)).alias("less"), d[0].alias("d"))))
        share = total(F.flatten(given)) / size
        many = F.when(size == 0, F.size(given)).otherwise(F.floor(F.when(size > 0, share) + unit(seed + 2, F.col(own["hash"]), F.col(own["tie"]))).cast("int"))
        draws = F.transform(F.slice(ranked, F.lit(1), F.least(many, F.size(given))), lambda r: r["d"].withField("words", size))
    line = line.withColumn("mix plan draws", draws)
    made = {"size": size, "source_size": p["source_size"], "target": p["target"], "draws": F.col("mix plan draws"), "taken": total(F.col("mix plan draws"))}
    return line.select(*("`" + c.replace("`", "``") + "`" for c in keep), *(c.alias(new[n]) for n, c in made.items()))


def shard_words(draws: Column, shards: int = SHARDS) -> Column:
    """How many of a document's words each shard takes: an array with a number for each shard."""
    words = lambda shard: F.aggregate(F.filter(draws, lambda d: d["shard"] == shard), F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), words)


def shuffled(mixed: DataFrame, draws: str = "draws", slices: int = 64) -> DataFrame:
    """A row for each draw of a mix: the row's own columns, with ``shard`` and ``order`` of the draw,
    in this order within partitions. A shard is dealt to tasks in ``slices`` ranges of the order.

    Rows whose ``draws`` are null or empty give none, copies give a row each, and an empty mix an empty
    table. Columns ``shard`` and ``order`` of the mix are replaced."""
    rows = mixed.select(*("`" + c.replace("`", "``") + "`" for c in mixed.columns if c.lower() not in (draws.lower(), "shard", "order")), F.explode(draws).alias("draw"))
    rows = rows.select("*", F.col("draw.shard").alias("shard"), F.col("draw.order").alias("order")).drop("draw")
    place = F.pmod(F.shiftright("order", 40), F.lit(slices)) if slices & (slices - 1) else F.shiftrightunsigned(F.col("order").bitwiseXOR(F.lit(-(2**63))), 64 - slices.bit_length() + 1)
    return rows.repartition("shard", place).sortWithinPartitions("shard", place, "order")
