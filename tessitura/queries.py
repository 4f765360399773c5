"""The engine's own operators as registered queries, each with the SQL that gives the same rows.

Keys follow the operator inventory. Computed floats are rounded to 9 decimals on both sides;
arrays are shown as comma-joined text, so that any engine compares them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import alignment, arrays, objectives, rewards, text
from tessitura.operators import batches, filters, groups, preferences, sequences
from tessitura.operators.numbering import numbered
from tessitura.plans import views
from tessitura.plans.layout import codec, layout
from tessitura.sources import archives, audio, cache, plugins, readers, shared, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LFM = layout("lfm2_5")
MIMI = codec("mimi")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def joined(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), ",")


def r9(x: Column) -> Column:
    return F.round(x.cast("double"), 9)


def _toy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences from frames, spoiled by kind: id % 7 says how."""
    df = views.frames(spark, sf_dir)
    raised = arrays.offset(F.col("codes"), 100)
    kind = F.col("id") % 7
    body = F.when(kind == 3, F.array().cast("array<int>")).when(kind == 4, F.slice(raised, 1, 61)).when(kind == 5, F.reverse(raised)).otherwise(raised)
    start = F.when(kind == 1, F.array(F.lit(5))).when(kind == 6, F.array(*map(F.lit, (7, 101, 7)))).otherwise(F.array(F.lit(7)))
    end = F.when(kind == 2, F.array(F.lit(9))).otherwise(F.array(F.lit(8), F.lit(9)))
    return df.select("id", F.concat(F.array(F.lit(99)), start, body, end).alias("tokens"))


_TOY = f"""frames AS ({views.FRAMES}), toy AS (SELECT id, [99] || CASE id % 7 WHEN 1 THEN [5] WHEN 6 THEN [7, 101, 7] ELSE [7] END
    || CASE id % 7 WHEN 3 THEN []::INTEGER[] WHEN 4 THEN r[1:61] WHEN 5 THEN list_reverse(r) ELSE r END || CASE id % 7 WHEN 2 THEN [9] ELSE [8, 9] END AS tokens
    FROM (SELECT id, list_transform(codes, lambda c: c + 100) AS r FROM frames))"""
_SPEECH = f"""{_TOY}, cut AS (SELECT id, tokens, CASE WHEN list_contains(tokens, 7) THEN tokens[len(tokens) - list_position(list_reverse(tokens), 7) + 2:] END AS rest FROM toy),
    speech AS (SELECT id, tokens, rest, list_contains(rest, 8) AS ended, CASE WHEN list_contains(rest, 8) THEN rest[1:list_position(rest, 8) - 1] ELSE rest END AS audio FROM cut),
    phased AS (SELECT *, len(list_filter(audio, lambda t, i: NOT (t >= 100 + (i - 1) % 8 * 2048 AND t < 100 + (i - 1) % 8 * 2048 + 2048))) AS wrong,
        len(list_filter(audio[1:len(audio) - len(audio) % 8], lambda t, i: NOT (t >= 100 + (i - 1) % 8 * 2048 AND t < 100 + (i - 1) % 8 * 2048 + 2048))) AS wrong_whole FROM speech)"""


# -- token arrays -------------------------------------------------------------------------------
@query(f"WITH l AS ({views.LAYERS}) SELECT id, array_to_string(flatten(list_transform(range(0, 10), lambda i: [coarse[i + 1], middle[2 * i + 1] + 4096, fine[4 * i + 1] + 8192, fine[4 * i + 2] + 12288, middle[2 * i + 2] + 16384, fine[4 * i + 3] + 20480, fine[4 * i + 4] + 24576])), ',') AS codes FROM l")
def arr_1_snac_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.layers(spark, sf_dir).select("id", joined(arrays.snac_interleave(F.col("coarse"), F.col("middle"), F.col("fine"))).alias("codes"))


_SHIFTED = f"s AS (SELECT id, list_transform(codes, lambda c: c + CAST((id % 3 - 1) * 3000 AS INTEGER)) AS codes FROM ({views.SNAC}))"
_LAYER = "array_to_string(list_transform(list_filter(list_zip(codes, range(0, 70)), lambda z: z[2] % 7 IN ({0})), lambda z: least(greatest(z[1] - z[2] % 7 * 4096, 0), 4095)), ',')"


@query(f"WITH {_SHIFTED} SELECT id, {_LAYER.format('0')} AS coarse, {_LAYER.format('1, 4')} AS middle, {_LAYER.format('2, 3, 5, 6')} AS fine FROM s")
def arr_2_snac_deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.snac(spark, sf_dir).withColumn("codes", F.transform("codes", lambda c: c + ((F.col("id") % 3 - 1) * 3000).cast("int")))
    made = arrays.snac_deinterleave(F.col("codes"))
    return df.select("id", *(joined(made[n]).alias(n) for n in ("coarse", "middle", "fine")))


@query(f"WITH f AS ({views.FRAMES}) SELECT id, array_to_string(codes, ',') AS codes FROM f")
def arr_3_mimi_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.frames(spark, sf_dir).withColumn("books", arrays.mimi_deinterleave(F.col("codes"), 8))
    return df.select("id", joined(arrays.mimi_interleave(F.col("books"))).alias("codes"))


@query(f"WITH f AS ({views.FRAMES}) SELECT id, array_to_string(flatten(list_transform(range(0, 8), lambda k: list_transform(range(0, 8), lambda t: least(greatest(codes[t * 8 + k + 1] + CAST((id % 3 - 1) * 1500 AS INTEGER) - k * 2048, 0), 2047)))), ',') AS books FROM f")
def arr_4_mimi_deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.frames(spark, sf_dir).withColumn("codes", F.transform("codes", lambda c: c + ((F.col("id") % 3 - 1) * 1500).cast("int")))
    return df.select("id", joined(F.flatten(arrays.mimi_deinterleave(F.col("codes"), 8))).alias("books"))


@query(f"WITH f AS ({views.FRAMES}) SELECT id, array_to_string(list_transform(codes, lambda c: c + {LFM.audio_start}), ',') AS codes FROM f")
def arr_5_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("id", joined(arrays.offset(F.col("codes"), LFM.audio_start)).alias("codes"))


_EVEN = f"r AS ({views.REPEATS}), e AS (SELECT user_id, codes, codes[1:len(codes) // 2 * 2] AS even FROM r)"


@query(f"""WITH {_EVEN} SELECT user_id,
    array_to_string(list_transform(list_filter(list_zip(codes, range(1, len(codes) + 1)), lambda z: z[2] = 1 OR z[1] <> codes[z[2] - 1]), lambda z: z[1]), ',') AS singles,
    array_to_string(list_transform(list_filter(list_zip(even, range(1, len(even) + 1)), lambda z: (z[2] + 1) // 2 = 1 OR even[((z[2] + 1) // 2 - 1) * 2 + 1] <> even[((z[2] + 1) // 2 - 2) * 2 + 1] OR even[((z[2] + 1) // 2 - 1) * 2 + 2] <> even[((z[2] + 1) // 2 - 2) * 2 + 2]), lambda z: z[1]), ',') AS couples,
    array_to_string(list_transform(list_filter(list_zip(even, range(1, len(even) + 1)), lambda z: (z[2] + 1) // 2 = 1 OR even[((z[2] + 1) // 2 - 1) * 2 + 1] <> even[((z[2] + 1) // 2 - 2) * 2 + 1]), lambda z: z[1]), ',') AS by_first,
    CASE WHEN len(codes) % 2 <> 0 THEN 'partial frame' END AS fault FROM e""")
def arr_6_drop_repeated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.repeats(spark, sf_dir)
    even = F.slice("codes", F.lit(1), (F.floor(F.size("codes") / 2) * 2).cast("int"))
    return df.select("user_id", joined(arrays.drop_repeated_frames(F.col("codes"), 1)).alias("singles"), joined(arrays.drop_repeated_frames(even, 2)).alias("couples"), joined(arrays.drop_repeated_frames(even, 2, by_first=True)).alias("by_first"), arrays.frames_fault(F.col("codes"), 2).alias("fault"))


_SPOILT = f"s AS (SELECT id, list_transform(codes, lambda c, i: c + CASE WHEN (id + i - 1) % 5 = 0 THEN 2048 ELSE 0 END)[1:64 - id % 3] AS codes FROM ({views.FRAMES}))"
_GOOD = "len(list_filter(list_zip(codes, range(0, len(codes))), lambda z: z[1] >= z[2] % 8 * 2048 AND z[1] < z[2] % 8 * 2048 + 2048 AND ({0} OR z[2] < len(codes) - len(codes) % 8)))"


@query(f"WITH {_SPOILT} SELECT id, round({_GOOD.format('false')} / len(codes), 9) AS share, round({_GOOD.format('true')} / len(codes), 9) AS with_partial, CASE WHEN {_GOOD.format('false')} = len(codes) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strict FROM s")
def arr_7_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.slice(F.transform("codes", lambda c, i: c + F.when((F.col("id") + i) % 5 == 0, 2048).otherwise(0)), F.lit(1), (64 - F.col("id") % 3).cast("int"))
    df = views.frames(spark, sf_dir).withColumn("codes", codes)
    v = lambda **k: arrays.validity(F.col("codes"), 8, 2048, **k)
    return df.select("id", r9(v()).alias("share"), r9(v(partial=True)).alias("with_partial"), v(strict=True).alias("strict"))


@query(f"""WITH {_SPEECH} SELECT id, CASE WHEN rest IS NULL THEN 'missing start' WHEN NOT ended THEN 'missing end' WHEN len(audio) = 0 THEN 'empty' WHEN len(audio) % 8 <> 0 THEN 'partial frame' WHEN wrong > 0 THEN 'phase' END AS fault,
    CASE WHEN rest IS NOT NULL AND ended AND len(audio) > 0 AND len(audio) % 8 = 0 AND wrong = 0 THEN array_to_string(list_transform(audio, lambda t: t - 100), ',') END AS codes,
    CASE WHEN rest IS NULL OR wrong_whole > 0 THEN '' ELSE array_to_string(list_transform(audio[1:len(audio) - len(audio) % 8], lambda t: t - 100), ',') END AS lenient FROM phased""")
def arr_8_extract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tokens")
    take = lambda strict: joined(arrays.extract_codes(t, 7, 8, 100, MIMI, strict))
    return _toy_pairs(spark, sf_dir).select("id", arrays.extract_fault(t, 7, 8, 100, MIMI).alias("fault"), take(True).alias("codes"), take(False).alias("lenient"))


_REASON = "CASE id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN 'EOS' END"
_MATCHED = "CASE WHEN id % 5 = 0 THEN 8 WHEN id % 5 = 1 THEN 3 END"


@query(f"WITH {_TOY} SELECT id, array_to_string(CASE WHEN NOT list_contains(tokens, 8) AND coalesce({_REASON} IN ('stop', 'EOS'), false) AND coalesce({_MATCHED} = 8, true) THEN tokens || [8] ELSE tokens END, ',') AS tokens FROM (SELECT id, list_filter(tokens, lambda t: t <> 8 OR id % 2 = 0) AS tokens FROM toy)")
def arr_9_restore_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _toy_pairs(spark, sf_dir).withColumn("tokens", F.filter("tokens", lambda t: (t != 8) | (F.col("id") % 2 == 0)))
    k, m = F.col("id") % 4, F.col("id") % 5
    reason = F.when(k == 0, "stop").when(k == 1, "length").when(k == 2, "EOS")
    return df.select("id", joined(arrays.restore_end(F.col("tokens"), 8, reason, F.when(m == 0, 8).when(m == 1, 3))).alias("tokens"))


_SUFFIX = f"""{_TOY}, x AS (SELECT id, CASE id % 6 WHEN 0 THEN []::INTEGER[] WHEN 1 THEN [6] WHEN 2 THEN [7] ELSE [6] || tokens[2:CAST(2 + id % 67 AS INTEGER)] || CASE WHEN id % 6 = 5 THEN [8] ELSE []::INTEGER[] END END AS s FROM toy),
    y AS (SELECT id, s, coalesce(list_position(s, 8), 0) AS stop, s[3:] AS audio, len(list_filter(s[3:], lambda t, i: NOT (t >= 100 + (i - 1) % 8 * 2048 AND t < 100 + (i - 1) % 8 * 2048 + 2048))) AS wrong FROM x),
    z AS (SELECT *, CASE WHEN len(s) > 0 AND s[1] <> 6 THEN 'no start of answer' WHEN len(s) > 1 AND s[2] <> 7 THEN 'no start of speech' WHEN stop > 0 AND (stop - 3 < 8 OR (stop - 3) % 8 <> 0) THEN 'early end' WHEN stop = 0 AND len(s) > 2 AND wrong > 0 THEN 'phase' END AS fault FROM y)"""


@query(f"""WITH {_SUFFIX} SELECT id, CASE WHEN fault IS NULL THEN CASE WHEN stop > 0 THEN 5 WHEN len(s) = 0 THEN 6 WHEN len(s) = 1 THEN 7 END END AS forced,
    CASE WHEN fault IS NULL AND stop = 0 AND len(s) > 1 THEN CAST(100 + len(audio) % 8 * 2048 AS INTEGER) END AS low, CASE WHEN fault IS NULL AND stop = 0 AND len(s) > 1 THEN CAST(2148 + len(audio) % 8 * 2048 AS INTEGER) END AS high,
    CASE WHEN fault IS NULL AND stop = 0 AND len(s) > 1 THEN len(audio) >= 8 AND len(audio) % 8 = 0 END AS end_ok, fault FROM z""")
def arr_10_next_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 6
    none = F.array().cast("array<int>")
    cut = F.concat(F.array(F.lit(6)), F.slice("tokens", F.lit(2), (1 + F.col("id") % 67).cast("int")), F.when(k == 5, F.array(F.lit(8))).otherwise(none))
    suffix = F.when(k == 0, none).when(k == 1, F.array(F.lit(6))).when(k == 2, F.array(F.lit(7))).otherwise(cut)
    df = _toy_pairs(spark, sf_dir).select("id", suffix.alias("s"))
    return df.select("id", arrays.next_tokens(F.col("s"), 6, 7, 8, 100, MIMI, pad=5).alias("n")).select("id", "n.*")


@query(f"""WITH {_TOY}, x AS (SELECT id, [6] || tokens[2:] AS s FROM toy), p AS (SELECT id, unnest(range(0, len(s) + 1)) AS position, s FROM x), c AS (SELECT id, position, s[1:position] AS s FROM p),
    y AS (SELECT id, position, s, coalesce(list_position(s, 8), 0) AS stop, s[3:] AS audio, len(list_filter(s[3:], lambda t, i: NOT (t >= 100 + (i - 1) % 8 * 2048 AND t < 100 + (i - 1) % 8 * 2048 + 2048))) AS wrong FROM c),
    z AS (SELECT *, CASE WHEN len(s) > 0 AND s[1] <> 6 THEN 'no start of answer' WHEN len(s) > 1 AND s[2] <> 7 THEN 'no start of speech' WHEN stop > 0 AND (stop - 3 < 8 OR (stop - 3) % 8 <> 0) THEN 'early end' WHEN stop = 0 AND len(s) > 2 AND wrong > 0 THEN 'phase' END AS fault FROM y)
    SELECT id, CAST(position AS INTEGER) AS position, CASE WHEN fault IS NULL THEN CASE WHEN stop > 0 THEN 5 WHEN len(s) = 0 THEN 6 WHEN len(s) = 1 THEN 7 END END AS forced,
    CASE WHEN fault IS NULL AND stop = 0 AND len(s) > 1 THEN CAST(100 + len(audio) % 8 * 2048 AS INTEGER) END AS low, CASE WHEN fault IS NULL AND stop = 0 AND len(s) > 1 THEN CAST(2148 + len(audio) % 8 * 2048 AS INTEGER) END AS high,
    CASE WHEN fault IS NULL AND stop = 0 AND len(s) > 1 THEN len(audio) >= 8 AND len(audio) % 8 = 0 END AS end_ok, fault FROM z""")
def arr_10_every_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the grammar lets follow at every position of every sequence, from one pass over each."""
    df = _toy_pairs(spark, sf_dir).select("id", F.concat(F.array(F.lit(6)), F.slice("tokens", 2, 2**30)).alias("s"))
    return df.select("id", F.inline(arrays.next_tokens_everywhere(F.col("s"), 6, 7, 8, 100, MIMI, pad=5)))


@query(f"WITH {_TOY} SELECT id, CASE WHEN NOT list_contains(tokens, 8) THEN 'missing marker' WHEN list_position(tokens, 8) = len(tokens) THEN 'empty completion' END AS fault, CASE WHEN list_contains(tokens, 8) THEN array_to_string(list_transform(tokens, lambda t, i: CASE WHEN i <= list_position(tokens, 8) THEN -100 ELSE t END), ',') END AS labels, array_to_string(list_transform(tokens, lambda t, i: CASE WHEN i <= id % 9 THEN -100 ELSE t END), ',') AS by_length, array_to_string(list_transform(tokens, lambda t: 1), ',') AS attention FROM toy")
def arr_11_13_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tokens")
    return _toy_pairs(spark, sf_dir).select("id", arrays.completion_fault(t, 8).alias("fault"), joined(arrays.completion_labels(t, 8)).alias("labels"), joined(arrays.prefix_labels(t, F.col("id") % 9)).alias("by_length"), joined(arrays.attention(t)).alias("attention"))


@query("""WITH s AS (SELECT vec_id AS id, CAST(10 + vec_id % 9 AS INTEGER) AS n, CAST(vec_id % 4 AS INTEGER) AS a, CASE WHEN vec_id % 3 > 0 THEN CAST(vec_id % 4 + vec_id % 3 AS INTEGER) END AS b, CASE vec_id % 5 WHEN 0 THEN ' Repetition' WHEN 1 THEN 'local' END AS kind FROM embeddings),
    m AS (SELECT *, list_transform(range(0, n), lambda i: i >= 2 + a * 3 AND i < CASE WHEN coalesce(lower(trim(kind)), 'local') = 'repetition' THEN n ELSE 2 + coalesce(b, a + 1) * 3 END) AS mask FROM s)
    SELECT id, CASE WHEN NOT list_contains(mask, true) THEN 'no token selected' END AS fault, CASE WHEN list_contains(mask, true) THEN array_to_string(mask, ',') END AS mask FROM m""")
def arr_14_span_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    span = F.struct((v % 4).cast("int").alias("start_frame"), F.when(v % 3 > 0, (v % 4 + v % 3).cast("int")).alias("end_frame"), F.when(v % 5 == 0, " Repetition").when(v % 5 == 1, "local").alias("type"))
    df = views.table(spark, sf_dir, "embeddings").select(v.alias("id"), (10 + v % 9).cast("int").alias("n"), F.array(span).alias("spans"))
    return df.select("id", arrays.span_fault(F.col("n"), F.col("spans"), 3).alias("fault"), joined(arrays.span_mask(F.col("n"), F.col("spans"), 3)).alias("mask"))


_LOGP = "list_transform(embedding, lambda x: round(-abs(x::DOUBLE), 6))"


def _logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four log-probability arrays from the quarters of each vector, and masks."""
    df = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(-F.abs(x.cast("double")), 6)).alias("v"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i + F.col("id")) % 4 != 0)
    picked = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i + F.col("id")) % 3 == 0)
    return df.select("id", *(F.slice("v", 16 * k + 1, 16).alias(n) for k, n in enumerate(("pc", "pr", "rc", "rr"))), mask.alias("mask"), picked.alias("picked"))


_LOGPS = f"l AS (SELECT vec_id AS id, {_LOGP}[1:16] AS pc, {_LOGP}[17:32] AS pr, {_LOGP}[33:48] AS rc, {_LOGP}[49:64] AS rr, list_transform(range(0, 16), lambda i: (i + vec_id) % 4 <> 0) AS mask, list_transform(range(0, 16), lambda i: (i + vec_id) % 3 = 0) AS picked FROM embeddings)"


@query(f"WITH {_LOGPS} SELECT id, array_to_string(list_transform(list_filter(range(1, 17), lambda i: mask[i]), lambda i: CAST(round(pc[i] * 1000000) AS BIGINT)), ',') || repeat(',0', CAST(16 - len(list_filter(mask, lambda m: m)) AS INTEGER)) AS packed, len(list_filter(range(1, 17), lambda i: mask[i] AND picked[i])) AS n_selected FROM l")
def arr_15_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = arrays.pack(F.col("pc"), F.col("mask"), F.col("picked"), F.lit(16))
    df = _logps(spark, sf_dir).select("id", packed.alias("p"))
    return df.select("id", joined(F.transform("p", lambda z: F.round(z["value"] * 1000000).cast("long"))).alias("packed"), F.size(F.filter("p", lambda z: z["selected"])).cast("long").alias("n_selected"))


@query(f"WITH {_TOY} SELECT id, array_to_string(list_transform(tokens, lambda t: CASE WHEN t = 8 THEN 3 WHEN t = 99 THEN 0 WHEN t >= 100 AND t < 100 + 8 * 2048 THEN 1 + (t - 100) // 2048 ELSE 1 END), ',') AS weights FROM toy")
def arr_16_phase_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = arrays.phase_weights(F.col("tokens"), 100, 2048, [1 + k for k in range(8)], {8: 3.0}, ignore=99)
    return _toy_pairs(spark, sf_dir).select("id", joined(F.transform(w, lambda x: x.cast("int"))).alias("weights"))


@query(f"SELECT i AS token, {LFM.length} + i AS token_id, CASE i WHEN 1 THEN 'start_of_speech' WHEN 2 THEN 'end_of_speech' WHEN 7 THEN 'pad' ELSE CASE WHEN i >= 10 THEN 'code' ELSE 'control' END END AS role FROM range(0, {LFM.codec.capacity + 11}) t(i)")
def arr_17_18_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    role = F.when(i == LFM.start_of_speech - LFM.length, "start_of_speech").when(i == LFM.end_of_speech - LFM.length, "end_of_speech").when(i == LFM.pad - LFM.length, "pad").when(i >= LFM.audio_start - LFM.length, "code").otherwise("control")
    return spark.range(LFM.codec.capacity + 11).select(i.alias("token"), (i + LFM.length).alias("token_id"), role.alias("role"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i > 14 THEN x::DOUBLE * (1 - (i - 15) / 49.0::DOUBLE) ELSE x::DOUBLE END)), 6) AS total, round(embedding[15]::DOUBLE, 6) AS first_faded FROM embeddings")
def arr_19_fade_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    faded = arrays.fade_out(F.col("embedding"), 1000)
    df = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), faded.alias("w"))
    return df.select("id", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("w")[14], 6).alias("first_faded"))


@query(f"WITH {_TOY}, b AS (SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN []::INTEGER[] WHEN 2 THEN tokens || [-1] ELSE tokens END AS t FROM toy) SELECT id, CASE WHEN t IS NULL THEN 'null' WHEN len(t) = 0 THEN 'empty' WHEN len(list_filter(t, lambda x: x < 0)) > 0 THEN 'bad token' END AS fault, coalesce(list_max(t), -1) AS max_token FROM b")
def arr_20_21_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 5
    t = F.when(k == 0, F.lit(None).cast("array<int>")).when(k == 1, F.array().cast("array<int>")).when(k == 2, F.array_append("tokens", F.lit(-1))).otherwise(F.col("tokens"))
    df = _toy_pairs(spark, sf_dir).select("id", t.alias("t"))
    return df.select("id", arrays.tokens_fault(F.col("t")).alias("fault"), arrays.max_token(F.col("t")).alias("max_token"))


# -- filters and sequences ----------------------------------------------------------------------
def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with the codes of the vector of the same number; documents beyond have none."""
    return views.utterances(spark, sf_dir).join(views.frames(spark, sf_dir).select("id", "codes"), "id", "left")


_SPOKEN = f"spoken AS (SELECT u.*, f.codes FROM ({views.UTTERANCES}) u LEFT JOIN ({views.FRAMES}) f USING (id))"
_OUTCOME = "CASE WHEN codes IS NULL OR len(codes) = 0 THEN 'empty codes' WHEN coalesce(dnsmos, 0) < 3 THEN 'quality' WHEN coalesce(duration, 0) < 30 THEN 'short' WHEN coalesce(duration, 0) > 300 THEN 'long' ELSE 'accepted' END"


@query(f"WITH {_SPOKEN} SELECT {_OUTCOME} AS outcome, count(*) AS n FROM spoken GROUP BY 1")
def flt_2_6_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _spoken(spark, sf_dir)
    return filters.count_reasons(df, filters.reject_reason(df, 3.0, 30.0, 300.0))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> ''")
def flt_1_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    spoilt = df.select(-1 - F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, " \t\xa0"))
    return filters.with_text(df.unionAll(spoilt)).select("doc_id", F.length("text").cast("long").alias("n"))


_SEQ = f"""ids AS (SELECT *, list_transform(string_split(speaker || ': ' || trim(text, ' ' || chr(9) || chr(10) || chr(13)), ''), lambda c: ord(c)) AS t FROM spoken WHERE {_OUTCOME} = 'accepted')"""


@query(f"""WITH {_SPOKEN}, {_SEQ}, seq AS (SELECT id, len(t) AS n_text, [{LFM.start_of_human}] || t || [{LFM.end_of_text}, {LFM.end_of_human}, {LFM.start_of_ai}, {LFM.start_of_speech}] || list_transform(codes, lambda c: c + {LFM.audio_start}) || [{LFM.end_of_speech}, {LFM.end_of_ai}] AS x, speaker, duration, dnsmos FROM ids)
    SELECT id, sha256(array_to_string(x, ',')) AS input_ids, sha256(array_to_string(list_transform(x, lambda v, i: CASE WHEN i <= n_text + 2 THEN -100 ELSE v END), ',')) AS labels, len(x) AS n, speaker AS speaker_id, round(duration, 9) AS duration, coalesce(dnsmos, 0) AS dnsmos FROM seq""")
def seq_1_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _spoken(spark, sf_dir).withColumn("codes", arrays.offset(F.col("codes"), LFM.audio_start))
    ids = text.code_points(text.prompt_text(F.col("text"), F.col("speaker")))
    rows = sequences.assemble(df, LFM, ids, min_quality=3.0, min_duration=30.0, max_duration=300.0)
    digest = lambda c: F.sha2(joined(F.col(c)).cast("binary"), 256).alias(c)
    return rows.select("id", digest("input_ids"), digest("labels"), F.size("attention_mask").cast("long").alias("n"), "speaker_id", r9(F.col("duration")).alias("duration"), "dnsmos")


_PROMPT = f"[{LFM.start_of_human}] || list_transform(string_split(p, ''), lambda c: ord(c)) || [{LFM.end_of_text}, {LFM.end_of_human}]"


@query(f"WITH u AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'v' || item_id || ': ' || text ELSE text END AS p FROM benchmark) SELECT item_id, sha256(array_to_string({_PROMPT}, ',')) AS prompt FROM u")
def prm_1_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.table(spark, sf_dir, "benchmark").withColumn("voice", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("v"), "item_id")))
    return sequences.prompts(df, LFM, "voice").select("item_id", F.sha2(joined(F.col("prompt")).cast("binary"), 256).alias("prompt"))


@query(f"""WITH f AS ({views.FRAMES}), r AS (SELECT f.id AS k, d.text AS p, f.codes FROM f JOIN benchmark d ON d.item_id = f.id), rr AS (SELECT k, {_PROMPT} || [{LFM.start_of_ai}, {LFM.start_of_speech}] || list_transform(codes, lambda c: c + {LFM.audio_start}) || [{LFM.end_of_speech}, {LFM.end_of_ai}] AS turn FROM r),
    t AS (SELECT item_id, item_id + 1 AS k, {_PROMPT} AS q FROM (SELECT item_id, text AS p FROM benchmark)) SELECT item_id, sha256(array_to_string(turn || q, ',')) AS prompt FROM t JOIN rr USING (k)""")
def prm_2_clone_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that has codes is the voice of the item before it."""
    items = views.table(spark, sf_dir, "benchmark")
    codes = views.frames(spark, sf_dir)
    refs = items.withColumnRenamed("text", "ref_text").join(codes, F.col("item_id") == F.col("id")).select(F.col("id").alias("k"), "ref_text", F.col("codes").alias("ref_codes"))
    out = sequences.clone_prompts(refs, items.withColumn("k", F.col("item_id") + 1), LFM, "k")
    return out.select("item_id", F.sha2(joined(F.col("prompt")).cast("binary"), 256).alias("prompt"))


@query()
def prm_1_subword_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's prompt in the ids of a vocabulary file, by the tokenizer plug-in."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = views.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("voice"))
    out = sequences.prompts(df, LFM, "voice", tokenizer=plugins.tokenize_with(lambda: plugins.LibraryTokenizer(path)))
    return out.select("doc_id", F.size("prompt").alias("n"), F.sha2(joined(F.col("prompt")).cast("binary"), 256).alias("prompt"))


@query(f"WITH {_SPOKEN}, {_SEQ} SELECT len(t) + 4 + len(codes) + 4 AS n, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS reference_text, speaker AS speaker_id, 7 AS columns FROM ids")
def snk_2_training_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows written with the known columns, and read back."""
    df = _spoken(spark, sf_dir).withColumn("codes", arrays.offset(F.col("codes"), LFM.audio_start))
    rows = sequences.assemble(df, LFM, text.code_points(text.prompt_text(F.col("text"), F.col("speaker"))), min_quality=3.0, min_duration=30.0, max_duration=300.0)
    folder = shared.shared_folder(spark, "training") + "/rows"
    writers.write_training(rows.withColumn("extra", F.lit(1)), folder)
    back = readers.read_dataset(spark, folder)
    return back.select((F.size("input_ids") + 1).cast("long").alias("n"), F.sha2(text.strip(F.col("reference_text")).cast("binary"), 256).alias("reference_text"), "speaker_id", F.lit(len(back.columns)).alias("columns"))


# -- text ---------------------------------------------------------------------------------------
@query(f"""WITH u AS (SELECT id, ' ' || text || chr(9) AS text, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE speaker END AS s FROM ({views.UTTERANCES})), v AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM u)
    SELECT id, md5(b) AS stripped, md5(CASE WHEN coalesce(s, '') <> '' THEN s || ': ' || b ELSE b END) AS sharded, md5(coalesce(s, 'None') || ': ' || text) AS generic, md5(coalesce(s, 'None') || ': ' || b) AS always, md5(CASE WHEN s IS NULL THEN text ELSE s || ': ' || text END) AS voice FROM v""")
def t_1_2_prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 3
    df = views.utterances(spark, sf_dir).select("id", F.concat(F.lit(" "), "text", F.lit("\t")).alias("text"), F.when(k == 1, "").when(k == 2, F.col("speaker")).alias("s"))
    modes = ("sharded", "generic", "always", "voice")
    return df.select("id", F.md5(text.strip(F.col("text")).cast("binary")).alias("stripped"), *(F.md5(text.prompt_text(F.col("text"), F.col("s"), m).cast("binary")).alias(m) for m in modes))


@query("SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c: ord(c)), ',') AS ids FROM benchmark")
def t_3_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "benchmark").select("item_id", joined(text.code_points(F.col("text"))).alias("ids"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[\\p{P}\\p{Z}]', ' ', 'g'), '[\\s\\v]+', ' ', 'g'))) AS plain FROM documents")
def t_4_5_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalizer("ascii")(F.col("text")).cast("binary")).alias("plain"))


@query()
def t_4_normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("plain"))


@query()
def t_6_7_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.asr_pairs(spark, sf_dir)
    ref, hyp = text.words(F.col("ref")), text.words(F.col("hyp"))
    df = df.select("id", "turn", text.token_distance(ref, hyp).alias("edits"), F.size(ref).alias("n_ref"))
    return df.withColumn("wer", r9(F.col("edits") / F.greatest(F.col("n_ref"), F.lit(1))))


@query()
def t_7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, deletions and insertions of every pair, by words and by characters without spaces."""
    df = views.asr_pairs(spark, sf_dir)
    bare = lambda c: F.split(F.regexp_replace(c, r"\s", ""), "")
    words, chars = alignment.token_edits(text.words(F.col("ref")), text.words(F.col("hyp"))), alignment.token_edits(bare("ref"), bare("hyp"))
    return df.select("id", "turn", words.alias("w"), chars.alias("c")).select("id", "turn", "w.*", *(F.col(f"c.{k}").alias(f"char_{k}") for k in ("substitutions", "deletions", "insertions")))


_ASCII = "regexp_replace({0}, '[^!-~]', '', 'g')"


@query(f"WITH p AS ({views.PAIRS}), a AS (SELECT id, turn, {_ASCII.format('ref')} AS r, {_ASCII.format('hyp')} AS h FROM p) SELECT id, turn, round(levenshtein(r, h) / greatest(length(r), 1), 9) AS cer FROM a")
def t_8_ascii_character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ASCII characters of whole texts, which is what SQL can count; the next one takes all."""
    clean = lambda c: F.regexp_replace(c, "[^!-~]", "")
    return views.asr_pairs(spark, sf_dir).select("id", "turn", r9(text.character_error_rate(clean("ref"), clean("hyp"))).alias("cer"))


@query()
def t_8_character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.asr_pairs(spark, sf_dir).select("id", "turn", r9(text.character_error_rate(F.col("ref"), F.col("hyp"))).alias("cer"))


# -- rewards ------------------------------------------------------------------------------------
_HARM = "CASE WHEN {0} = 0 OR {1} = 0 THEN 0 ELSE 1 / (0.6 / {0} + 0.4 / {1}) END"


@query(f"WITH e AS (SELECT event_id, value / 100 AS x, 1 - tanh(3 * value / 100) AS c, exp(-value / 300) AS n FROM events) SELECT event_id, round(exp(-2.5 * x), 9) AS wer, round(c, 9) AS cer, round(n, 9) AS nll, round({_HARM.format('round(c, 9)', 'round(n, 9)')}, 8) AS harmonic FROM e")
def r_1_6_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 100
    c, n = r9(rewards.cer_tanh(x)), r9(rewards.asr_nll(x))
    return views.table(spark, sf_dir, "events").select("event_id", r9(rewards.wer_exponential(x)).alias("wer"), c.alias("cer"), n.alias("nll"), F.round(rewards.weighted_harmonic(c, n), 8).alias("harmonic"))


@query("""WITH e AS (SELECT event_id, value AS v FROM events) SELECT event_id,
    round(least(greatest(CASE WHEN v <= 50 THEN 0.5 * v / 50 ELSE 0.5 + 0.5 * (v - 50) / 150 END, 0), 1), 9) AS up,
    round(CASE WHEN -v <= -50 THEN 0.5 * (200 - v) / 150 ELSE 0.5 + 0.5 * (50 - v) / 50 END, 9) AS down,
    round((least(greatest(v / 50 - 1, -1), 1) + 1) / 2, 9) AS speaker, round((0 - abs(v - 60)) / 60, 9) AS length, round(exp(-abs(v - 60) / 60), 9) AS similar,
    CASE WHEN v / 60 BETWEEN 0.8 AND 1.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS within, round(least(greatest(v / 20 / 4.5, 0), 1), 9) AS quality FROM e""")
def r_7_11_16_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return views.table(spark, sf_dir, "events").select(
        "event_id", r9(rewards.piecewise(v, 0, 50, 200)).alias("up"), r9(rewards.piecewise(v, 200, 50, 0, higher=False, clamped=False)).alias("down"), r9(rewards.speaker_cosine(v / 50 - 1)).alias("speaker"),
        r9(rewards.duration(v, F.lit(60.0))).alias("length"), r9(rewards.duration_similarity(v, F.lit(60.0))).alias("similar"), rewards.duration_tolerance(v, F.lit(60.0)).alias("within"), r9(rewards.quality(v / 20)).alias("quality"),
    )


_CV = "CASE WHEN len({0}) = 0 THEN NULL ELSE sqrt(list_sum(list_transform({0}, lambda x: (x - list_avg({0})) * (x - list_avg({0})))) / len({0})) / abs(list_avg({0})) END"


@query(f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding[1:32], lambda x: round(x::DOUBLE, 4)) AS f, list_transform(embedding[33:64], lambda x: round(abs(x::DOUBLE), 4)) AS g FROM embeddings), p AS (SELECT id, list_filter(f, lambda x: x > 0) AS f, g FROM e),
    c AS (SELECT id, {_CV.format('f')} AS cf, {_CV.format('g')} AS cg FROM p) SELECT id, round(cg, 7) AS variation, round(exp(-abs(cf - 0.5) / 0.5), 7) AS f0, round(exp(-abs(cg - 0.8) / 0.8), 7) AS energy, round(0.5 * exp(-abs(cf - 0.5) / 0.5) + 0.5 * exp(-abs(cg - 0.8) / 0.8), 7) AS prosody FROM c""")
def r_12_15_prosody(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.transform(F.slice("embedding", 1, 32), lambda x: F.round(x.cast("double"), 4))
    g = F.transform(F.slice("embedding", 33, 32), lambda x: F.round(F.abs(x.cast("double")), 4))
    df = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), f.alias("f"), g.alias("g"))
    r7 = lambda x: F.round(x, 7)
    a, b = F.lit(0.5), F.lit(0.8)
    return df.select("id", r7(rewards.variation(F.col("g"))).alias("variation"), r7(rewards.f0_variation(F.col("f"), a)).alias("f0"), r7(rewards.energy_variation(F.col("g"), b)).alias("energy"), r7(rewards.prosody(F.col("f"), a, F.col("g"), b)).alias("prosody"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 7) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def r_17_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.table(spark, sf_dir, "embeddings")
    other = df.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("e"))
    return df.join(other, F.col("vec_id") == F.col("a")).select("a", "b", F.round(rewards.cosine(F.col("embedding"), F.col("e")), 7).alias("similarity"))


# -- composite rewards and pairs ----------------------------------------------------------------
REWARD = rewards.CompositeReward({"clear": 0.5, "speaker": 0.2, "quality": 0.3}, pareto=("clear", "quality"), protected=("speaker",), thresholds={"clear": 0.1}, tolerances={"speaker": 0.5})
_CAND = f"cand AS (SELECT *, round(0.5 * clear + 0.2 * speaker + 0.3 * quality, 9) AS score FROM ({views.CANDIDATES}))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.candidates(spark, sf_dir).withColumn("score", r9(REWARD.aggregate(lambda n: F.col(n))))


@query(f"WITH {_CAND} SELECT g, i, score, clear >= 0.1 AS passes FROM cand")
def cr_1_4_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("g", "i", "score", REWARD.passes(lambda n: F.col(n)).alias("passes"))


_BETTER = "({0}clear >= 0.1 AND {0}speaker >= {1}speaker - 0.5 AND {0}clear >= {1}clear AND {0}quality >= {1}quality AND {0}score > {1}score)"


@query(f"WITH {_CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS k FROM cand) SELECT a.g, a.i, CASE WHEN {_BETTER.format('a.', 'b.')} = {_BETTER.format('b.', 'a.')} THEN 0 WHEN {_BETTER.format('a.', 'b.')} THEN 1 ELSE -1 END AS compared, a.clear >= b.clear AND a.quality >= b.quality AND (a.clear > b.clear OR a.quality > b.quality) AS dominates FROM n a JOIN n b ON a.g = b.g AND b.k = a.k + 1")
def cr_5_8_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("g").orderBy("i")
    names = ("clear", "speaker", "quality")
    df = _scored(spark, sf_dir).withColumns({f"o_{n}": F.lead(n).over(w) for n in names}).where("o_clear IS NOT NULL")
    a, b = (lambda n: F.col(n)), (lambda n: F.col(f"o_{n}"))
    return df.select("g", "i", REWARD.compare(a, b).alias("compared"), REWARD.dominates(a, b).alias("dominates"))


@query(f"WITH {_CAND} SELECT g, i FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.g = a.g AND b.clear >= a.clear AND b.quality >= a.quality AND (b.clear > a.clear OR b.quality > a.quality))")
def cr_6_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.skyline(_scored(spark, sf_dir), "g", "i", REWARD).select("g", "i")


_FRONT = "SELECT g, i FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.g = a.g AND {all} AND ({some}))"


def _over(*names: str) -> rewards.CompositeReward:
    return rewards.CompositeReward({"clear": 1.0}, pareto=names)


def _front(*names: str) -> str:
    return _FRONT.format(all=" AND ".join(f"b.{n} >= a.{n}" for n in names), some=" OR ".join(f"b.{n} > a.{n}" for n in names))


@query(f"WITH {_CAND} {_front('clear', 'quality', 'speaker')}")
def cr_6_skyline_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.skyline(_scored(spark, sf_dir), "g", "i", _over("clear", "quality", "speaker")).select("g", "i")


@query(f"WITH {_CAND}, wide AS (SELECT *, i % 17 AS late FROM cand) {_front('clear', 'quality', 'speaker', 'late').replace('FROM cand', 'FROM wide')}")
def cr_6_skyline_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scored(spark, sf_dir).withColumn("late", F.col("i") % 17)
    return preferences.skyline(df, "g", "i", _over("clear", "quality", "speaker", "late")).select("g", "i")


@query(f"""WITH {_CAND}, ok AS (SELECT * FROM cand WHERE clear >= 0.1), best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, i) AS r FROM ok),
    worst AS (SELECT o.g, b.i AS chosen, o.i AS rejected, b.score - o.score AS gap, row_number() OVER (PARTITION BY o.g ORDER BY o.score, o.i DESC) AS r FROM ok o JOIN best b ON o.g = b.g AND b.r = 1 AND b.i <> o.i
        WHERE b.score - o.score >= 0.3 AND b.score > o.score AND b.speaker >= o.speaker - 0.5 AND b.clear >= o.clear AND b.quality >= o.quality)
    SELECT g, chosen, rejected, round(gap, 9) AS reward_gap FROM worst WHERE r = 1""")
def pp_1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.pairs_from_rows(views.candidates(spark, sf_dir), "g", "i", REWARD, 0.3, decimals=9)
    return out.withColumn("reward_gap", F.round("reward_gap", 9))


@query(f"""WITH {_CAND}, m AS (SELECT *, CASE WHEN i % 7 = 0 THEN clear ELSE 1.5 END AS clear2 FROM cand)
    SELECT g, i, CASE WHEN i % 89 = 0 THEN 'reserved name' WHEN i % 83 = 0 THEN 'missing quality' WHEN i % 97 = 0 THEN 'not finite speaker' END AS fault,
        CASE WHEN i % 97 <> 0 AND i % 89 <> 0 AND i % 83 <> 0 THEN round(0.5 * clear2 + 0.2 * speaker + 0.3 * quality, 9) END AS total, CASE WHEN i % 97 <> 0 AND i % 89 <> 0 AND i % 83 <> 0 THEN 4 END AS n FROM m""")
def cr_3_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two scorers, with texts and a total among them, and extra metrics that go before them."""
    i = F.col("i")
    one = F.create_map(F.lit("clear"), F.col("clear").cast("string"), F.lit("transcript"), F.lit("some words"), F.lit("total"), F.lit("7"), F.lit("speaker"), F.lit("0"))
    two = F.create_map(F.lit("speaker"), F.when(i % 97 == 0, "NaN").otherwise(F.col("speaker").cast("string")), F.lit("quality"), F.when(i % 83 == 0, None).otherwise(F.col("quality").cast("string")))
    extra = F.when(i % 89 == 0, F.create_map(F.lit("total"), F.lit(1.0))).when(i % 7 != 0, F.create_map(F.lit("clear"), F.lit(1.5)))
    metrics, fault = REWARD.breakdown([one, two], extra)
    df = views.candidates(spark, sf_dir).select("g", "i", metrics.alias("m"), fault.alias("fault"))
    return df.select("g", "i", "fault", r9(F.col("m")["total"]).alias("total"), F.when(F.col("m").isNotNull(), F.size("m")).alias("n"))


def _groups(spark: SparkSession, sf_dir: str, bad: bool) -> DataFrame:
    """Candidates of each user as one row: an array in order of the event."""
    c = views.candidates(spark, sf_dir)
    clear = F.when(F.col("i") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("clear")) if bad else F.col("clear")
    metrics = F.create_map(F.lit("clear"), clear, F.lit("speaker"), "speaker", F.lit("quality"), "quality")
    own = F.struct(F.array(F.col("i").cast("int")).alias("completion_input_ids"), metrics.alias("metrics"), F.lit(None).cast("array<struct<start_frame:int,end_frame:int,type:string>>").alias("error_spans"), F.lit(None).cast("array<boolean>").alias("selection_mask"))
    rows = c.select("g", "i", own.alias("own")).groupBy("g").agg(F.collect_list(F.struct("i", "own")).alias("rows"))
    by_i = F.array_sort("rows", lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    return rows.select("g", F.array(F.col("g").cast("int")).alias("prompt_input_ids"), F.transform(by_i, lambda r: r["own"]).alias("candidates"))


_PAIR = """cand AS (SELECT *, 0.0::DOUBLE + 0.5 * clear + 0.2 * speaker + 0.3 * quality AS score FROM ({0})), ok AS (SELECT * FROM cand WHERE clear >= 0.1), best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, i) AS r FROM ok),
    worst AS (SELECT o.g, b.i AS chosen, o.i AS rejected, b.score - o.score AS gap, row_number() OVER (PARTITION BY o.g ORDER BY o.score, o.i DESC) AS r FROM ok o JOIN best b ON o.g = b.g AND b.r = 1 AND b.i <> o.i
        WHERE b.score - o.score >= 0.3 AND b.score > o.score AND b.speaker >= o.speaker - 0.5 AND b.clear >= o.clear AND b.quality >= o.quality),
    size AS (SELECT g, count(*) AS n, count(*) FILTER (clear >= 0.1) AS passing, count(*) FILTER (i % 97 = 0) AS odd FROM cand GROUP BY g)"""


@query(f"""WITH {_PAIR.format(views.CANDIDATES)}, x AS (SELECT s.g, CASE WHEN n < 2 THEN 'fewer than two candidates' WHEN odd > 0 THEN 'not finite clear' WHEN passing < 2 THEN 'fewer than two pass the thresholds' WHEN w.g IS NULL THEN 'no safe pair meets the gap' END AS reject_reason, chosen, rejected, gap FROM size s LEFT JOIN (SELECT * FROM worst WHERE r = 1) w ON s.g = w.g)
    SELECT g, reject_reason, CASE WHEN reject_reason IS NULL THEN chosen END AS chosen, CASE WHEN reject_reason IS NULL THEN rejected END AS rejected, CASE WHEN reject_reason IS NULL THEN round(gap, 9) END AS reward_gap FROM x""")
def pp_1_array_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.pairs_from_groups(_groups(spark, sf_dir, True), REWARD, 0.3)
    return out.select("g", "reject_reason", F.get("chosen_input_ids", F.lit(0)).cast("long").alias("chosen"), F.get("rejected_input_ids", F.lit(0)).cast("long").alias("rejected"), r9(F.col("reward_gap")).alias("reward_gap"))


@query(f"WITH {_PAIR.format(views.CANDIDATES)} SELECT g AS prompt, chosen, rejected FROM worst WHERE r = 1")
def src_5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected pairs saved as a dataset and loaded with its checks."""
    folder = shared.shared_folder(spark, "pairs")
    writers.write_lines(_groups(spark, sf_dir, False).drop("g"), f"{folder}/in.jsonl")
    preferences.build_pairs(spark, f"{folder}/in.jsonl", f"{folder}/out.jsonl", REWARD, gap=0.3)
    first = lambda c: F.get(c, F.lit(0)).cast("long")
    return readers.read_pairs(spark, f"{folder}/out.jsonl").select(first("prompt_input_ids").alias("prompt"), first("chosen_input_ids").alias("chosen"), first("rejected_input_ids").alias("rejected"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS source_line FROM documents")
def src_6_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines in three files of many parts, each a range of ids, read back with the number of each
    line in its file."""
    folder = shared.shared_folder(spark, "lines") + "/in"
    df = views.table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 3).alias("file"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(ranges, "file", "doc_id").sortWithinPartitions("file", "doc_id").write.partitionBy("file").json(folder)
    out = readers.numbered_lines(spark, folder, parts=True)
    return out.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "source_line")


@query(f"""WITH {_PAIR.format(views.CANDIDATES)}, n AS (SELECT count(*) AS accepted, (SELECT count(*) FROM size) - count(*) AS refused FROM worst WHERE r = 1)
    SELECT chosen, rejected, round(gap, 9) AS reward_gap, accepted, refused FROM worst, n WHERE r = 1""")
def pp_2_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate groups written as JSON lines, read, selected from, written and counted in one pass."""
    folder = shared.shared_folder(spark, "pairs")
    writers.write_lines(_groups(spark, sf_dir, False).drop("g"), f"{folder}/in.jsonl")
    accepted, refused = preferences.build_pairs(spark, f"{folder}/in.jsonl", f"{folder}/out.jsonl", REWARD, gap=0.3)
    first = lambda c: F.get(c, F.lit(0)).cast("long")
    out = readers.read_dataset(spark, f"{folder}/out.jsonl", schema="chosen_input_ids array<int>, rejected_input_ids array<int>, reward_gap double")
    return out.select(first("chosen_input_ids").alias("chosen"), first("rejected_input_ids").alias("rejected"), r9(F.col("reward_gap")).alias("reward_gap"), F.lit(accepted).cast("long").alias("accepted"), F.lit(refused).cast("long").alias("refused"))


# -- groups -------------------------------------------------------------------------------------
@query("SELECT event_id, round(value - avg(value) OVER w, 9) AS centred, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 9) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def agg_1_group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    both = groups.both_advantages(df, "user_id", "value")
    return both.select("event_id", F.round("centred", 9).alias("centred"), F.round("scaled", 9).alias("scaled"))


@query("""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY day) AS k, day, m FROM (SELECT CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY 1)),
    f AS (SELECT k, day, m, m AS b FROM d WHERE k = 1 UNION ALL SELECT d.k, d.day, d.m, 0.9 * f.b + 0.1 * f.m FROM f JOIN d ON d.k = f.k + 1) SELECT CAST(day AS VARCHAR) AS day, round(b, 6) AS baseline, round(m - b, 6) AS advantage FROM f""")
def agg_2_moving_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = views.table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("m"))
    out = groups.moving_baseline(days, "day", "m")
    return out.select(F.col("day").cast("string").alias("day"), F.round("baseline", 6).alias("baseline"), F.round(F.col("m") - F.col("baseline"), 6).alias("advantage"))


@query("""WITH RECURSIVE d AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS k, hour, m FROM (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS m FROM events GROUP BY 1, 2)),
    f AS (SELECT event_type, k, hour, m, m AS b FROM d WHERE k = 1 UNION ALL SELECT d.event_type, d.k, d.hour, d.m, 0.9 * f.b + 0.1 * f.m FROM f JOIN d ON d.event_type = f.event_type AND d.k = f.k + 1)
    SELECT event_type, strftime(hour, '%Y-%m-%d %H') AS hour, round(b, 6) AS baseline FROM f""")
def agg_2_baseline_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type as runs, hours as steps."""
    hours = views.table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("m"))
    out = groups.moving_baseline(hours, "hour", "m", run=["event_type"])
    return out.select("event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round("baseline", 6).alias("baseline"))


@query("SELECT event_type, round(avg(value), 6) AS reward_mean, min(value) AS reward_min, max(value) AS reward_max, round(stddev_pop(event_id % 7), 6) AS advantage_std, round(avg(CAST(props->>'$.k' AS DOUBLE)), 6) AS k_mean FROM events GROUP BY event_type")
def agg_3_rollout_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.table(spark, sf_dir, "events").withColumns({"a": F.col("event_id") % 7, "k": F.get_json_object("props", "$.k").cast("double")})
    out = groups.rollout_log(df, "event_type", "value", "a", ["k"])
    return out.withColumns({c: F.round(c, 6) for c in ("reward_mean", "advantage_std", "k_mean")})


@query("SELECT user_id, bool_or(value > 400) AS any_valid, count(*) FILTER (value > 400) AS n_valid, count(*) AS n FROM events GROUP BY user_id")
def agg_4_any_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.require_valid(views.table(spark, sf_dir, "events"), "user_id", F.col("value") > 400)


@query("SELECT event_type, event_id // 500 AS window, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def agg_5_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.window_means(views.table(spark, sf_dir, "events"), "event_type", "event_id", 500, ["value"]).withColumn("value", F.round("value", 6))


@query("SELECT event_type, round(sum(value * (1 + event_id % 5)) / sum(1 + event_id % 5), 6) AS mean FROM events GROUP BY 1")
def agg_6_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(groups.weighted_mean(F.col("value"), 1 + F.col("event_id") % 5), 6).alias("mean"))


@query(f"WITH {_TOY}, n AS (SELECT id, id // 16 AS batch, len(tokens) AS k FROM toy) SELECT id, max(k) OVER (PARTITION BY batch) AS longest FROM n")
def agg_8_longest_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _toy_pairs(spark, sf_dir).withColumn("batch", F.floor(F.col("id") / 16))
    return groups.longest_in_batch(df, "batch", "tokens").select("id", F.col("longest").cast("long").alias("longest"))


@query()
def agg_9_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.error_rates(t_6_7_word_errors(spark, sf_dir), "edits", "n_ref")


@query()
def agg_9_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that users say as references, by turn; what no assistant answers is a failed generation."""
    df = views.table(spark, sf_dir, "conversations")
    said = df.where("role = 'user'").select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("ref"))
    heard = df.where("role = 'assistant'").select(F.col("conv_id").alias("id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    out = groups.evaluation(said.join(heard, ["id", "turn"], "left"), "ref", "hyp", by=("turn",))
    return out.withColumns({c: r9(F.col(c)) for c in ("coverage", "macro", "corpus")})


# -- mixing and batches -------------------------------------------------------------------------
@query("SELECT i AS step, round(2 - 1.0::DOUBLE * least(i / 99.0::DOUBLE, 1), 9) AS ratio FROM range(0, 150) t(i)")
def mix_2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(150).select(F.col("id").alias("step"), r9(batches.ratio_at(F.col("id"), 2.0, 1.0, 100)).alias("ratio"))


_SCHEDULE = """n AS (SELECT (SELECT count(*) FROM conversations) AS n1, (SELECT count(*) FROM documents) AS n2), c AS (SELECT n1, n2, least(n1 // 16, n2 // 8) * 24 AS length FROM n),
    s AS (SELECT i AS index, CASE WHEN i // 8 % 3 < 2 THEN 1 ELSE 2 END AS source, CASE WHEN i // 8 % 3 < 2 THEN ((i // 8 // 3 * 2 + i // 8 % 3) * 8 + i % 8) % n1 ELSE ((i // 8 // 3 + i // 8 % 3 - 2) * 8 + i % 8) % n2 END AS row FROM c, range(0, 10000000) t(i) WHERE i < length)"""


@query(f"""WITH {_SCHEDULE}, qa AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row, length(text) AS n FROM conversations), tts AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, length(text) AS n FROM documents)
    SELECT index, source, row, n FROM s JOIN qa USING (row) WHERE source = 1 UNION ALL SELECT index, source, row, n FROM s JOIN tts USING (row) WHERE source = 2""")
def mix_4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = numbered(views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n")), "conv_id", "turn")
    tts = numbered(views.table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")
    plan = batches.mixture(spark, qa.count(), tts.count(), 8, 2.0, 1.0)
    both = qa.select("row", "n", F.lit(1).alias("source")).unionByName(tts.select("row", "n", F.lit(2).alias("source")))
    return plan.join(both, ["source", "row"]).select("index", "source", "row", "n")


@query("""WITH r AS (SELECT DISTINCT round(0.05 + abs(value) / 37, 3) AS ratio FROM events WHERE value IS NOT NULL), near AS (SELECT ratio, CAST(round(ratio * q) AS BIGINT) AS p, q FROM r, range(1, 17) t(q)
    QUALIFY row_number() OVER (PARTITION BY ratio ORDER BY abs(ratio - round(ratio * q) / q), q) = 1) SELECT ratio, p AS first, q AS second FROM near""")
def mix_3_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches in a cycle for every ratio that events' values make."""
    df = views.table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.round(0.05 + F.abs("value") / 37, 3).alias("ratio")).distinct()
    return df.select("ratio", batches.cycle(F.col("ratio")).alias("c")).select("ratio", "c.*")


_RUN = """n AS (SELECT (SELECT count(*) FROM conversations) AS n1, (SELECT count(*) FROM documents) AS n2), step AS (SELECT i AS step, 2 - 1.0::DOUBLE * (i / 99.0::DOUBLE) AS ratio FROM range(0, 100) t(i)),
    near AS (SELECT step, CAST(round(ratio * q) AS BIGINT) AS p, q FROM step, range(1, 17) t(q) QUALIFY row_number() OVER (PARTITION BY step ORDER BY abs(ratio - round(ratio * q) / q), q) = 1),
    batch AS (SELECT step, p, q, step % (p + q) AS place, step // (p + q) AS cycle FROM near),
    named AS (SELECT *, CASE WHEN place < p THEN 1 ELSE 2 END AS source, CASE WHEN place < p THEN cycle * p + place ELSE cycle * q + place - p END AS number FROM batch),
    plan AS (SELECT step, source, number, row_number() OVER (PARTITION BY source ORDER BY step) - 1 AS following FROM named),
    places AS (SELECT step, i AS inside, source, (number * 8 + i) % CASE source WHEN 1 THEN n1 ELSE n2 END AS row, (following * 8 + i) % CASE source WHEN 1 THEN n1 ELSE n2 END AS next_row FROM plan, n, range(0, 8) t(i))"""


@query(f"""WITH {_RUN}, qa AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row, length(text) AS n FROM conversations), tts AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, length(text) AS n FROM documents)
    SELECT step, inside, source, row, next_row, n FROM places JOIN qa USING (row) WHERE source = 1 UNION ALL SELECT step, inside, source, row, next_row, n FROM places JOIN tts USING (row) WHERE source = 2""")
def mix_4_7_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every one of 100 steps while the ratio moves from 2 to 1."""
    qa = numbered(views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n")), "conv_id", "turn")
    tts = numbered(views.table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")
    plan = batches.schedule(spark, qa.count(), tts.count(), 8, 2.0, 1.0, 100)
    both = qa.select("row", "n", F.lit(1).alias("source")).unionByName(tts.select("row", "n", F.lit(2).alias("source")))
    return plan.join(both, ["source", "row"]).select("step", "inside", "source", "row", "next_row", "n")


@query("SELECT doc_id // 8 AS block, count(*) AS n, min(doc_id % 8) AS low, max(doc_id % 8) AS high FROM documents GROUP BY 1")
def mix_5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = batches.shuffle_blocks(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8, seed=11)
    return df.groupBy("block", "block_key").agg(F.count("*").alias("n"), F.min("in_block").alias("low"), F.max("in_block").alias("high")).drop("block_key")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toy_pairs(spark, sf_dir).select("id", F.floor(F.col("id") / 16).alias("batch"), F.col("tokens").alias("input_ids"))


_PADDED = f"{_TOY}, b AS (SELECT id, tokens, CAST(max(len(tokens)) OVER (PARTITION BY id // 16) AS INTEGER) AS w FROM toy)"
_FILL = "list_transform(range(0, w - len(tokens)), lambda i: {0})"


@query(f"WITH {_PADDED} SELECT id, array_to_string(tokens || {_FILL.format('7')}, ',') AS input_ids, array_to_string(list_transform(tokens, lambda t: 1) || {_FILL.format('0')}, ',') AS attention_mask, array_to_string(tokens || {_FILL.format('-100')}, ',') AS labels FROM b")
def pad_1_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batches.collate(_rows(spark, sf_dir), "batch", 7)
    return out.select("id", *(joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")))


@query(f"WITH {_PADDED} SELECT id, array_to_string(list_transform(tokens || {_FILL.format('7')}, lambda t: CASE WHEN t = 7 THEN 0 ELSE 1 END), ',') AS attention_mask, array_to_string(list_transform(tokens, lambda t, i: CASE WHEN i = 1 THEN -100 ELSE t END) || {_FILL.format('-100')}, ',') AS labels FROM b")
def pad_2_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batches.collate_completions(_rows(spark, sf_dir), "batch", 7, marker=99)
    return out.select("id", *(joined(F.col(c)).alias(c) for c in ("attention_mask", "labels")))


@query(f"""WITH {_TOY}, p AS (SELECT id, id // 16 AS batch, tokens[1:3] AS p, tokens[4:] AS c, list_reverse(tokens)[1:3] AS r FROM toy), b AS (SELECT *, max(3 + greatest(len(c), len(r))) OVER (PARTITION BY batch) AS w FROM p)
    SELECT id, array_to_string(p || c || list_transform(range(0, w - 3 - len(c)), lambda i: 0), ',') AS chosen_ids, array_to_string(p || r || list_transform(range(0, w - 3 - len(r)), lambda i: 0), ',') AS rejected_ids, len(c) AS n_chosen FROM b""")
def pad_3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("input_ids")
    rows = _rows(spark, sf_dir).select("id", "batch", F.slice(t, 1, 3).alias("prompt_input_ids"), F.slice(t, F.lit(4), F.size(t)).alias("chosen_input_ids"), F.slice(F.reverse(t), 1, 3).alias("rejected_input_ids"))
    out = batches.collate_pairs(rows, "batch", 0)
    return out.select("id", joined(F.col("chosen_ids")).alias("chosen_ids"), joined(F.col("rejected_ids")).alias("rejected_ids"), F.size(F.filter("chosen_completion", lambda m: m)).cast("long").alias("n_chosen"))


@query(f"WITH {_PADDED} SELECT id, array_to_string({_FILL.format('7')} || tokens, ',') AS input_ids, array_to_string({_FILL.format('0')} || list_transform(tokens, lambda t: 1), ',') AS attention_mask FROM b")
def pad_4_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batches.collate(_rows(spark, sf_dir), "batch", 7, left=True)
    return out.select("id", *(joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask")))


# -- objectives ---------------------------------------------------------------------------------
_MASKED = "list_transform(list_filter(range(1, 17), lambda i: {1}), lambda i: {0}[i])"


@query(f"WITH {_LOGPS} SELECT id, round(list_sum({_MASKED.format('pc', 'mask[i]')}), 9) AS total, round(list_avg({_MASKED.format('pc', 'mask[i]')}), 9) AS mean, len({_MASKED.format('pc', 'mask[i]')}) AS tokens, round(list_sum({_MASKED.format('pc', 'mask[i] AND picked[i]')}), 9) AS selected FROM l")
def obj_1_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _logps(spark, sf_dir).select("id", objectives.completion_log_probs(F.col("pc"), F.col("mask"), F.col("picked")).alias("s"))
    return df.select("id", r9(F.col("s.total")).alias("total"), r9(F.col("s.mean")).alias("mean"), F.col("s.tokens").cast("long").alias("tokens"), r9(F.col("s.selected_total")).alias("selected"))


_LS = "(-(greatest(-({0}), 0) + ln(1 + exp(-abs({0})))))"


@query(f"""WITH {_LOGPS}, s AS (SELECT id, list_sum(pc) AS pc, list_sum(pr) AS pr, list_sum(rc) AS rc, list_sum(rr) AS rr FROM l), z AS (SELECT *, 0.2 * ((pc - pr) - (rc - rr)) AS z, -(2.5 * (pc / 16 - pr / 16) - 0.8) AS y FROM s)
    SELECT id, round(-(0.9 * {_LS.format('z')} + 0.1 * {_LS.format('-z')}), 7) AS dpo, round(0.2 * (pc - rc) - 0.2 * (pr - rr), 7) AS margin, round(y / (1 + exp(-y)), 7) AS spo FROM z""")
def obj_2_3_6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    pc, pr, rc, rr = (total(c) for c in ("pc", "pr", "rc", "rr"))
    df = _logps(spark, sf_dir).select("id", objectives.direct_preference(pc, pr, rc, rr, 0.2, 0.1).alias("d"), objectives.self_preference(pc / 16, pr / 16).alias("spo"))
    return df.select("id", F.round("d.loss", 7).alias("dpo"), F.round("d.margin", 7).alias("margin"), F.round("spo", 7).alias("spo"))


_ZI = "(0.1 * ((pc[i] - rc[i]) - (pr[i] - rr[i])))"
_CHOSEN = "list_filter(range(1, 17), lambda i: mask[i] OR picked[i])"


@query(f"WITH {_LOGPS} SELECT id, round(list_sum(list_transform({_CHOSEN}, lambda i: -{_LS.format(_ZI)})), 7) AS loss, len({_CHOSEN}) AS selected, round(len({_CHOSEN}) / 16, 9) AS fraction FROM l")
def obj_4_5_fine_grained(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = objectives.combine_masks(F.col("mask"), F.col("picked"), "union")
    df = _logps(spark, sf_dir).withColumn("places", places)
    df = df.select("id", objectives.fine_grained(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"), F.col("places")).alias("s"))
    return df.select("id", F.round("s.loss", 7).alias("loss"), F.col("s.selected").cast("long").alias("selected"), r9(F.col("s.fraction")).alias("fraction"))


_RATIO = "exp(pc[i] - pr[i])"
_ON = "list_filter(range(1, 17), lambda i: mask[i])"


@query(f"""WITH {_LOGPS} SELECT id, round((0 - list_sum(list_transform({_ON}, lambda i: least({_RATIO} * (id % 5 - 2), least(greatest({_RATIO}, 0.8), 1.2) * (id % 5 - 2))))) / len({_ON}), 7) AS loss,
    round(list_sum(list_transform({_ON}, lambda i: exp(rc[i] - pc[i]) - (rc[i] - pc[i]) - 1)) / len({_ON}), 7) AS kl, len(list_filter({_ON}, lambda i: abs({_RATIO} - 1) > 0.2)) AS clipped FROM l""")
def obj_7_8_clipped_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = objectives.clipped_policy(F.col("pc"), F.col("pr"), F.col("mask"), (F.col("id") % 5 - 2).cast("double"), 0.2, F.col("rc"))
    df = _logps(spark, sf_dir).select("id", made.alias("s"))
    return df.select("id", F.round("s.loss", 7).alias("loss"), F.round("s.kl", 7).alias("kl"), F.col("s.clipped").cast("long").alias("clipped"))


@query(f"WITH {_LOGPS} SELECT id, round(list_sum(list_transform(range(1, 17), lambda i: -pc[i] * (1 + i % 3))) / greatest(list_sum(list_transform(range(1, 17), lambda i: 1 + i % 3)), 1), 12) AS loss FROM l")
def obj_9_weighted_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (1 + i % 3).cast("double"))
    loss = objectives.weighted_cross_entropy(F.transform("pc", lambda x: -x), weights)
    return _logps(spark, sf_dir).select("id", F.round(loss, 12).alias("loss"))


# -- shards -------------------------------------------------------------------------------------
@query("SELECT p_partkey AS shard, p_partkey % 8 AS worker FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def cch_7_8_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("shard"))
    done = views.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("shard"))
    return cache.remaining(shards, done).withColumn("worker", cache.worker_of("shard", 8))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SAID = f"SELECT doc_id, trim(text, {_WS}) AS text, text AS sound, source, n_chars FROM documents WHERE text IS NOT NULL AND trim(text, {_WS}) <> ''"


def _sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as utterances whose audio bytes are the text's own, with blanks around the text."""
    df = views.table(spark, sf_dir, "documents")
    return df.select("doc_id", F.encode("text", "UTF-8").alias("bytes"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"), "source", "n_chars")


@query(f"SELECT md5(text) AS text, md5(sound) AS audio, source AS speaker, n_chars / 16.0::DOUBLE AS duration FROM ({_SAID})")
def src_1_parquet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with rows that have no bytes or a blank text beside all others."""
    folder = shared.shared_folder(spark, "shards")
    df = _sounds(spark, sf_dir)
    rows = df.select(F.struct(F.col("bytes"), F.lit("p").alias("path")).alias("mp3"), "text", F.col("source").alias("speaker"), (F.col("n_chars") / 16.0).alias("duration"))
    spoilt = rows.select(F.struct(F.lit(None).cast("binary").alias("bytes"), F.lit("p").alias("path")).alias("mp3"), "text", "speaker", "duration").unionAll(rows.select("mp3", F.lit(" \t"), "speaker", "duration"))
    writers.write_dataset(rows.unionAll(spoilt), f"{folder}/data")
    got = readers.read_shards(spark, f"{folder}/data")
    return got.select(F.md5(F.col("text").cast("binary")).alias("text"), F.md5("audio").alias("audio"), "speaker", "duration")


@query(f"SELECT 'd' || doc_id AS stem, md5(text) AS text, md5(sound) AS audio, n_chars / 16.0::DOUBLE AS duration FROM ({_SAID})")
def src_2_tar_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.shared_folder(spark, "tars")
    rows = _sounds(spark, sf_dir).where("bytes IS NOT NULL").select(F.concat(F.lit("d"), "doc_id").alias("stem"), F.col("bytes").alias("audio"), "text", (F.col("n_chars") / 16.0).alias("duration"))
    writers.write_tars(rows, folder, 16)
    got = archives.read_tars(spark, f"{folder}/*.tar")
    return got.select("stem", F.md5(F.col("text").cast("binary")).alias("text"), F.md5("audio").alias("audio"), "duration")


@query("SELECT doc_id, md5(text) AS text, lang, kind FROM documents, (VALUES ('json'), ('parquet'), ('split')) k(kind)")
def src_4_snk_1_3_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as JSON lines, as Parquet and as a saved data set with splits, and read back by suffix."""
    folder = shared.shared_folder(spark, "sets")
    df = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    writers.write_lines(df, f"{folder}/a.jsonl")
    writers.write_dataset(df, f"{folder}/b.parquet", records_per_file=500)
    writers.write_dataset(df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("test"))), f"{folder}/saved")
    parts = {"json": readers.read_dataset(spark, f"{folder}/a.jsonl", schema=df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), "parquet": readers.read_dataset(spark, f"{folder}/b.parquet"), "split": readers.read_dataset(spark, f"{folder}/saved", "test")}
    out = None
    for kind, part in parts.items():
        part = part.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "lang", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT vec_id AS id, 64 AS samples, round(embedding[1]::DOUBLE, 9) AS first FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) <= 1 UNION ALL SELECT vec_id, 64, round(least(greatest(embedding[1]::DOUBLE, -1), 1), 9) FROM embeddings WHERE NOT list_max(list_transform(embedding, lambda x: abs(x))) <= 1")
def src_9_audio_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays go before bytes, and come through without a change of rate."""
    df = views.table(spark, sf_dir, "embeddings")
    clipped = F.transform("embedding", lambda x: F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)))
    value = F.struct(F.encode(F.lit("no wave"), "UTF-8").alias("bytes"), F.lit(None).cast("string").alias("path"), clipped.alias("array"), F.lit(24000).alias("sampling_rate"))
    return df.select(F.col("vec_id").alias("id"), audio.waveform(value).alias("w")).select("id", F.size("w").alias("samples"), r9(F.col("w")[0]).alias("first"))


_RESAMPLED = """r AS (SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS BIGINT) AS base, embedding FROM embeddings),
    x AS (SELECT label, base + i AS place, embedding[i + 1]::DOUBLE AS x FROM r, range(0, 64) t(i)), whole AS (SELECT label, count(*) AS length FROM x GROUP BY label),
    o AS (SELECT label, unnest(range(0, CAST(ceil(length * {up} / {down}.0) AS BIGINT))) AS n FROM whole), w AS (SELECT label, n, n * {down} // {up} AS left_, n * {down} / {up}::DOUBLE AS at_ FROM o),
    tap AS (SELECT label, n, left_ + k AS place, at_ - (left_ + k) AS gap FROM w, range(1 - {width}, {width} + 1) t(k)),
    weight AS (SELECT label, n, place, {cut} * CASE WHEN gap = 0 THEN 1 ELSE sin(pi() * {cut} * gap) / (pi() * {cut} * gap) END * pow(cos(pi() * greatest(least(gap / {width}, 1), -1) / 2), 2) AS weight FROM tap)
    SELECT label, n, round(sum(weight * coalesce(x, 0)), 6) + 0.0 AS sample FROM weight LEFT JOIN x USING (label, place) GROUP BY label, n"""


def _resampled(spark: SparkSession, sf_dir: str, rate: int, target: int) -> DataFrame:
    """Vectors as the parts of a recording for each label, and its samples with their numbers."""
    df = views.table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    out = audio.resample_parts(df, "label", "vec_id", "embedding", rate, target)
    before = Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("base", F.sum(F.size("embedding")).over(before) - F.size("embedding"))
    return out.select("label", "base", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("base") + F.col("i")).alias("n"), (F.round("x", 6) + F.lit(0.0)).alias("sample"))


@query("WITH " + _RESAMPLED.format(up=3, down=2, width=16, cut=1.0))
def aud_2_resample_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir, 16_000, 24_000)


@query("WITH " + _RESAMPLED.format(up=1, down=2, width=32, cut=0.5))
def aud_2_resample_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir, 48_000, 24_000)


@query("SELECT CAST(vec_id AS VARCHAR) AS name, 64 AS samples, 64 AS read FROM embeddings")
def snk_5_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a WAV file, with rows of null between, and the files read back."""
    folder = shared.shared_folder(spark, "waves")
    df = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), "embedding")
    rows = df.unionAll(df.select(F.concat(F.lit("none"), "name"), F.lit(None).cast("array<float>")))
    written = folder + "/list"
    writers.write_dataset(writers.save_waves(rows, f"{folder}/out", "name", "embedding"), written)
    files = spark.read.format("binaryFile").load(f"{folder}/out/*.wav").select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("name"), F.col("content").alias("bytes"))
    value = F.struct("bytes", F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<float>").alias("array"), F.lit(24000).alias("sampling_rate"))
    files = files.select("name", F.size(audio.waveform(value)).alias("read"))
    return spark.read.parquet(written).select("name", F.col("samples").cast("int").alias("samples")).join(files, "name")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS part, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def cch_9_row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to five parts in turn, saved by part, and put together in their order again."""
    folder = shared.shared_folder(spark, "parts") + "/rows"
    rows = numbered(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", name="row")
    cache.shard_rows(rows, "row", 5).write.partitionBy("part").parquet(folder)
    back = spark.read.schema("doc_id long, row long, part long").parquet(folder)
    return numbered(back, "row", name="place").select("doc_id", "part", "place")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def cch_11_made_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is there is taken as it is: the second call would fail if it made it again."""
    folder = shared.shared_folder(spark, "once") + "/table"
    docs = views.table(spark, sf_dir, "documents")
    cache.skip_if_there(spark, folder, lambda: docs.select("source"))
    again = cache.skip_if_there(spark, folder, lambda: docs.select(F.raise_error(F.lit("made twice")).cast("string").alias("source")))
    return again.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1.5::DOUBLE ELSE len(embedding) / 24000.0::DOUBLE END AS duration FROM embeddings")
def aud_3_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.struct(F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("path"), F.col("embedding").alias("array"), F.lit(24000).alias("sampling_rate"))
    df = views.table(spark, sf_dir, "embeddings").select("vec_id", audio.waveform(value).alias("wave"))
    return df.select("vec_id", audio.duration(F.when(F.col("vec_id") % 3 == 0, 1.5), F.col("wave"), 24000).alias("duration"))


@query("SELECT source, count(*) AS n, 7 AS finished, 1 AS without_rows, 0 AS \"left\" FROM documents GROUP BY source")
def cch_1_6_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made into rows of a cache in two passes, the second one over what the first left; one of
    the files has no rows, and the first pass is made again for a file that it had done."""
    folder = shared.shared_folder(spark, "cache")
    df = views.table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 6).cast("int").alias("file"))
    df.repartition(6, "file").write.partitionBy("file").parquet(f"{folder}/in")
    df.limit(0).coalesce(1).drop("file").write.parquet(f"{folder}/in/file=6")
    files = cache.source_files(spark, f"{folder}/in", pattern="*.parquet")
    files = files.withColumn("file", F.regexp_extract("path", "file=([0-9]+)", 1).cast("int"))
    source = spark.read.schema("doc_id long, source string, file int").parquet(f"{folder}/in")
    for asked in (files.where("file % 2 = 0"), files.where("file = 2"), None):
        made = cache.TokenCache(files, {"codec": "toy", "start": 100}, f"{folder}/work")
        asked = made.remaining() if asked is None else asked
        made.add(source.join(asked.select("file", "shard"), "file").drop("file"), asked)
    done = made.finished().agg(F.count("*").alias("finished"), F.count_if(F.col("rows") == 0).alias("without_rows")).first()
    return made.rows().groupBy("source").agg(F.count("*").alias("n")).withColumns({"finished": F.lit(done["finished"]), "without_rows": F.lit(done["without_rows"]), "left": F.lit(made.remaining().count())})
