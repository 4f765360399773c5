"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

Sketch: rounds of hashed bin placement. In round r every shingle goes to a hashed bin with a
hashed value that counts r first; a bin keeps the smallest. Rounds go on until every bin is full,
and from round t on all shingles go to bin r - t, so 2t rounds always fill all t bins. The
chance that two sets agree in a bin is their similarity, concentrated as for independent hashes.

Bands of ``ROWS`` bins make candidates; ``BANDS`` of them miss a pair at a similarity of 0.8 with
a chance of 1e-7. Candidates are confirmed on full sets, of 64-bit hashes of the shingles.

Documents with equal sets are one node, so copies make no pairs. A band's nodes are not paired
with each other. Its center, the node with most band neighbours, is compared with all of them;
who is similar to it is in its component. Two nodes u, v that are not both so can still be
similar to each other in one of two ways, by their overlaps with the center and their sizes:

- What they share with the center does not suffice, so they share a shingle that the center
  lacks. Prefixes of those residual shingles, rarest first, make an inverted index of groups that
  share one (the prefix principle of similarity joins).
- Or it may suffice, which takes a partner smaller than the center. Such nodes form a smaller
  band without the center.

Smaller bands of up to ``SMALL_BAND`` nodes, twice as many in each later round up to ``SMALL_GROUP``, and groups of
up to ``SMALL_GROUP`` that share a shingle, are confirmed pair by pair where sizes and overlaps allow it; larger
ones are the bands of the next round, with a center of their own, unless they are one component already.
Links to centers are merged first, and no pair within one component is named: it would add nothing to the
components. Two bounds on the overlap must allow the others: at a shared shingle, what both have from it on in
the order of rarity; and the parities of both sets by ``MARKS`` hashed places, since sets differ in at least
as many shingles as places (the bitmap filter of similarity joins).
Each round takes a center out of each band, so rounds end with the input.

So groups of near copies, and documents around one common passage, cost about a comparison a
node, and yet every pair of a band that could be similar is confirmed or refuted. Sets stream
past the center's set, which is sent once for a few hundred nodes (``PER_SALT``), whatever the group's size.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.common import Scratch, at, fresh, require
from tessitura.llm.tokenization import pieces, released

ROWS, BANDS = 5, 40
BINS = ROWS * BANDS
PERCENT = 80
SMALL_BAND = 64
SMALL_GROUP = 1024
#: Places of a set's parities, a power of two and whole longs.
MARKS = 1024
#: A center's set is sent again for about so many nodes, by its band neighbours in all bands.
PER_SALT = 8192
#: Nodes of a band that one task sees at most, about; how many ways bands are cut before their size is known.
PER_CUT, FIRST_CUTS = 1024, 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_ODD, _ROUND, _BAND = _odd(64, 1), _odd(2 * BINS, 2), _odd(ROWS, 3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words; A-Z are lower-cased and
    words stand between ASCII white space. With fewer words the whole sequence is one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    total = np.full(len(parts) - n + 1, n, np.uint64)
    for i in range(n):
        total += _mixed(h[i : len(parts) - n + 1 + i] + _ODD[i]) * _ODD[(i + 31) % 64]
    return np.unique(_mixed(total))


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of the sets, a row each; an empty set's is all ones."""
    out = np.full(len(sets) * bins, _U(2**64 - 1))
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    for r in range(2 * bins):
        if not len(values):
            break
        x = _mixed(values + _ROUND[r % len(_ROUND)])
        bin_ = ((x >> _U(40)) * _U(bins) >> _U(24)).astype(np.int64) if r < bins else np.full(len(values), r - bins)
        np.minimum.at(out, owner * bins + bin_, (_U(r) << _U(52)) | (_mixed(x) >> _U(12)))
        open_ = (out.reshape(len(sets), bins) == _U(2**64 - 1)).any(axis=1)[owner]
        owner, values = owner[open_], values[open_]
    return out.reshape(len(sets), bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    return _mixed((_mixed(parts) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[40]).view(np.int64)


def _sketched(rows: DataFrame, words: int) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column(1)):
                sets = [shingles(t, words) for t in batch.column(1)[part].to_pylist()]
                keys = band_keys(sketches(sets))
                digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(len(sets), 2)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands], names=["id", "n", "d1", "d2", "bands"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n long, d1 long, d2 long, bands array<long>")


def _full_sets(rows: DataFrame, words: int) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column(1)):
                sets = [shingles(t, words).tobytes() for t in batch.column(1)[part].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(sets, pa.binary())], names=["id", "items"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, items binary")


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs (a, b, salt): the set of each b, sorted by (a, salt), after a row with the set of a."""
    # by merge at every size: neither side has a bound
    rows = pairs.hint("merge").join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "items")
    heads = pairs.select("a", "salt").distinct().hint("merge").join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast(dict(rows.dtypes)["b"]).alias("b"), "items")
    return rows.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the sorted items of x are among those of y."""
    where = np.searchsorted(y, x)
    return y[np.minimum(where, len(y) - 1)] == x


def parities(items: np.ndarray) -> np.ndarray:
    """For each of ``MARKS`` places whether an odd number of the items falls on it, as longs."""
    odd = np.bincount((items >> _U(65 - MARKS.bit_length())).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near_enough(percent: int) -> Column:
    """Whether the sizes and parities of a pair allow that it is similar."""
    differ = sum(F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("o_marks")[i])) for i in range(MARKS // 64))
    both = F.col("n") + F.col("o_n")
    return (100 + percent) * (both - differ) >= 2 * percent * both


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, extra: bool) -> DataFrame:
    """For pairs (a, b): the size of b's set, the ``overlap`` of the sets, whether they are ``linked`` and,
    if asked, ``extra``, the shingles of b that a lacks, and ``marks``, the parities of b's set."""
    kind = dict(sets.dtypes)["id"]
    names = ["a", "b", "n", "overlap", "linked", *(["extra", "marks"] if extra else [])]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            for part in pieces(batch.column(3)):
                piece = batch.slice(part.start, part.stop - part.start)
                at, counts, rest, marks = [], [], [], []
                for k, (b, items) in enumerate(zip(piece.column(2), piece.column(3), strict=True)):
                    y = np.frombuffer(items.as_buffer(), np.uint64)
                    if not b.is_valid:
                        head = y.copy()
                        continue
                    own = _shared(y, head)
                    common = int(own.sum())
                    at.append(k)
                    counts.append((len(y), common, 100 * common >= percent * (len(head) + len(y) - common)))
                    if extra:
                        rest.append(y[~own].view(np.int64))
                        marks.append(parities(y))
                columns = list(zip(*counts, strict=True)) or [[]] * 3
                made = [piece.column(0).take(pa.array(at, pa.int64())), piece.column(2).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True))]
                if extra:
                    ends = np.cumsum([0, *map(len, rest)]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rest) if rest else np.empty(0, np.int64))))
                    each = np.arange(len(marks) + 1, dtype=np.int32) * (MARKS // 64)
                    made.append(pa.ListArray.from_arrays(pa.array(each), pa.array(np.concatenate(marks) if marks else np.empty(0, np.int64))))
                yield pa.RecordBatch.from_arrays(made, names=names)

    return _beside(pairs, sets).mapInArrow(run, f"a {kind}, b {kind}, n long, overlap long, linked boolean" + ", extra array<long>, marks array<long>" * extra)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as (u, v)."""
    return _compared(pairs.withColumn("salt", F.lit(0)), sets, percent, extra=False).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, root) for every end of the edges (u, v) that is not the smallest of its component.

    Large-star and small-star steps in turn, until neither changes an edge. Each is an
    aggregation and a join by node; nothing is gathered at a node or on the driver.
    """
    e = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    mark = None
    for i in itertools.count(1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.save(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        got = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if got == mark:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = got


def _cut(rows: DataFrame) -> DataFrame:
    """Rows with ``cut``: a band of m nodes is cut into about m / PER_CUT parts, by node."""
    return rows.withColumn("cut", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / PER_CUT)))


def _each_cut(bands: DataFrame) -> DataFrame:
    """A row a band becomes one for each part of it."""
    return bands.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / PER_CUT) - 1)))


def _prefixes(met: DataFrame, percent: int) -> DataFrame:
    """An entry for each (c, node, item) that the inverted index of residual shingles needs.

    A node's partners have at least percent of its size, and the least size around the center (``low``).
    So a similar pair shares at least t items beyond the center, t from the node's overlap alone,
    and one of any ``extra - t + 1``: the rarest ones around the center. Items of one node are no help.
    ``ahead`` counts the node's other items from this one on: a pair's first item has all that it shares ahead.
    """
    items = met.select("c", "node", "n", "low", "overlap", "linked", F.explode("extra").alias("item"))
    often = items.groupBy("c", "item").agg(F.count("*").alias("often")).where("often > 1")
    partner = F.greatest("low", F.ceil(F.col("n") * percent / 100))
    t = F.greatest(F.lit(1), F.ceil((F.col("n") + partner) * percent / (100 + percent)) - F.col("overlap"))
    # single items come first in the order; they are no longer here but count
    shared = Window.partitionBy("c", "node")
    ranked = items.join(often, ["c", "item"]).withColumn("t", t)
    ranked = ranked.withColumn("rank", F.row_number().over(shared.orderBy("often", "item"))).withColumn("many", F.count("*").over(shared))
    ranked = ranked.withColumn("ahead", F.col("many") - F.col("rank") + 1).where(F.col("ahead") >= F.col("t"))
    return ranked.select("c", "node", "n", "overlap", "item", "ahead").join(met.select("c", "node", "comp", "marks"), ["c", "node"])


def _merged(links: DataFrame, comps: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``comps`` (node, comp) with the components that the links (u, v) tie together made one."""
    left = comps.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
    right = comps.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    named = links.join(left, "u").join(right, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    roots = components(named, scratch, name)
    return comps.join(roots.withColumnRenamed("v", "comp"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT) -> DataFrame:
    """Links documents whose shingle sets A, B have 100 |A and B| >= percent |A or B|; returns the
    id, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` (whether
    the id is that), a row for each row.

    Texts without words, null or empty, have no shingles and are linked with nothing. A null id
    takes no part in links: its component is null and it is kept. Rows that share an id are one
    document with several texts, linked by each of them. Other columns take no part. An empty
    table gives an empty table.
    """
    require(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(at(docs, id_col).alias("id"), at(docs, text_col).alias("text"))
    sketched = scratch.save(_sketched(rows, words), "sketches")
    usable = sketched.where("n > 0 AND id IS NOT NULL")
    # one node for each distinct set, named by the smallest id that has it
    reps = scratch.save(usable.groupBy("d1", "d2").agg(F.min("id").alias("node")), "reps")
    nodes = usable.join(reps, (usable["id"] == reps["node"]) & (usable["d1"] == reps["d1"]) & (usable["d2"] == reps["d2"]), "left_semi")
    banded = nodes.select(F.explode("bands").alias("band"), F.col("id").alias("node"), "n")
    # a repeated row repeats its node here, which the joins below undo once bands are few
    live = scratch.save(banded.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("m")).where("x < y").select("band", "m"), "live")
    cuts = live.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(FIRST_CUTS - 1))))
    banded = banded.withColumn("cut", F.pmod(F.xxhash64("node"), F.lit(FIRST_CUTS)).cast("int"))
    state = scratch.save(banded.join(cuts, ["band", "cut"]).drop("cut").distinct(), "banded")
    central = state.groupBy("node").agg(F.sum("m").alias("central"))
    state = scratch.save(state.join(central, "node").withColumn("comp", F.col("node")), "state-0")
    scratch.drop("live", "banded")
    sets = scratch.save(_full_sets(rows.join(state.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi"), words), "sets")
    found: list[DataFrame] = []
    most = lambda o, n: F.floor((100 + percent) * F.col(o) / percent).cast("long") - F.col(n)
    for i in itertools.count():
        if state.isEmpty():
            break
        small = min(SMALL_GROUP, SMALL_BAND << min(i, 10))  # later rounds have few bands, which else lose little a round
        best = F.max(F.struct("central", F.xxhash64("node").alias("h"), "node")).alias("best")
        centers = state.groupBy("band").agg(best, F.min("n").alias("low"), F.max("m").alias("m")).select("band", F.col("best.node").alias("c"), F.ceil(F.col("best.central") / PER_SALT).alias("salts"), "low", "m")
        state = scratch.save(_cut(state).join(_each_cut(centers).drop("m"), ["band", "cut"]), f"centered-{i}")
        comps = state.select("node", "comp").distinct()
        state = state.where("node <> c")
        pairs = state.groupBy("c", "node").agg(F.max("salts").alias("salts"), F.min("low").alias("low"))
        salted = pairs.select(F.col("c").alias("a"), F.col("node").alias("b"), F.pmod(F.xxhash64("node"), "salts").alias("salt"))
        met = _compared(salted, sets, percent, extra=True).withColumnsRenamed({"a": "c", "b": "node"})
        met = scratch.save(met.join(pairs.select("c", "node", "low"), ["c", "node"]), f"met-{i}")
        linked = met.where("linked").select(F.col("c").alias("u"), F.col("node").alias("v"))
        comps = scratch.save(_merged(linked, comps, scratch, f"near-{i}"), f"comps-{i}")
        met = met.join(comps, "node")
        parts = scratch.save(_prefixes(met, percent), f"parts-{i}")
        sharing = parts.groupBy("c", "item").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").drop("x", "y")
        few = parts.join(sharing.where(F.col("m") <= SMALL_GROUP), ["c", "item"])
        other = few.select("c", "item", *(F.col(x).alias(f"o_{x}") for x in ("node", "n", "overlap", "comp", "ahead", "marks")))
        need = percent * (F.col("n") + F.col("o_n"))
        can = (100 + percent) * (F.least("overlap", "o_overlap") + F.least("ahead", "o_ahead")) >= need
        apart = (F.col("node") < F.col("o_node")) & (F.col("comp") != F.col("o_comp"))
        tried = few.join(other, ["c", "item"]).where(apart & can & _near_enough(percent)).select(F.col("node").alias("a"), F.col("o_node").alias("b"))
        many = parts.join(sharing.where(F.col("m") > SMALL_GROUP), ["c", "item"]).select(F.xxhash64("c", "item").alias("band"), "m", "node", "n", F.col("m").alias("central"))
        # nodes that could be similar to one another by what they share with the center alone
        open_ = ~F.col("linked")
        rest = state.drop("comp").join(met.select("c", "node", "overlap", "linked", "comp", "marks"), ["c", "node"]).withColumn("room", most("overlap", "n"))
        bounds = rest.groupBy("band").agg(F.min("n").alias("least"), F.min(F.when(open_, F.col("n"))).alias("open_low"), F.max(F.when(open_, F.col("room"))).alias("open_room"), F.max("m").alias("m"))
        rest = rest.join(_each_cut(bounds).drop("m"), ["band", "cut"]).where(F.when(open_, F.col("room") >= F.col("least")).otherwise((F.col("n") <= F.col("open_room")) & (F.col("room") >= F.col("open_low"))))
        rest = scratch.save(rest.select("band", "m", "cut", "node", "n", "central", "overlap", "comp", "marks"), f"rest-{i}")
        left = rest.groupBy("band").agg(F.count("*").alias("left"), F.max("m").alias("m")).where("left > 1")
        few = rest.join(left.where(F.col("left") <= small).drop("m"), "band")
        peer = few.select("band", *(F.col(x).alias(f"o_{x}") for x in ("node", "n", "overlap", "comp", "marks")))
        enough = (100 + percent) * F.least("overlap", "o_overlap") >= need
        tried = tried.unionByName(few.join(peer, "band").where(apart & enough & _near_enough(percent)).select(F.col("node").alias("a"), F.col("o_node").alias("b")))
        tried = scratch.save(tried.distinct(), f"tried-{i}")
        confirmed = scratch.save(_confirmed(tried, sets, percent), f"confirmed-{i}")
        found.append(scratch.save(linked.unionByName(confirmed), f"links-{i}"))
        large = _each_cut(left.where(F.col("left") > small)).select("band", "cut", F.col("left"))
        following = rest.join(large, ["band", "cut"]).select("band", F.col("left").alias("m"), "node", "n", "central").unionByName(many)
        following = scratch.save(following, f"following-{i}")
        if following.isEmpty():
            break
        renamed = following.join(_merged(confirmed, comps, scratch, f"merge-{i}"), "node").select("band", "m", "node", "n", "central", "comp")
        still = renamed.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band")
        state = scratch.save(renamed.join(still, "band", "left_semi"), f"state-{i + 1}")
        scratch.drop(*(n for n in scratch.names if n.endswith(f"-{i}") and n != f"links-{i}" and not n.startswith("state") or n.startswith((f"merge-{i}-", f"near-{i}-"))))
    out = sketched.select("id", "n", "d1", "d2").join(reps, ["d1", "d2"], "left")
    # a document with several texts ties the nodes that stand for them
    several = out.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("id")
    links = out.join(several, "id", "left_semi").select(F.col("id").alias("u"), F.col("node").alias("v"))
    for more in found:
        links = links.unionByName(more)
    roots = components(links, scratch, "all")
    out = out.join(roots.withColumnRenamed("v", "node"), "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "node")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    return scratch.last(out, "out")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their group; its columns as they are."""
    name = fresh(docs, "near_id")
    found = near_duplicates(docs, id_col, text_col, words, percent).where("NOT kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(found, at(docs, id_col) == found[name], "left_anti")
