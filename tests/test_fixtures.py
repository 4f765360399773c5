"""Published cases of the operators: small inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tessitura.functions import arrays, objectives, rewards, text
from tessitura.operators import batches, preferences
from tessitura.plans.layout import Codec, layout


@pytest.fixture(scope="module")
def one(spark):
    return lambda *columns: list(spark.range(1).select(*columns).first())


def ints(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")


TOY = Codec("toy", 2, 3)


def test_layouts():
    lay = layout("lfm2_5")
    assert (lay.start_of_speech, lay.pad, lay.audio_start, lay.codec.capacity) == (64401, 64407, 64410, 16384)
    assert layout("qwen3").codec.capacity == 28672
    with pytest.raises(ValueError):
        layout("mimi")


def test_distances_and_rates(one):
    got = one(
        F.levenshtein(F.lit("kitten"), F.lit("sitting")),
        text.word_error_rate(F.lit("one two three"), F.lit("one four")),
        text.word_error_rate(F.lit(""), F.lit("two insertions")),
        text.word_error_rate(F.lit(""), F.lit("")),
        text.character_error_rate(F.lit("a b c"), F.lit("a x c")),
        text.character_error_rate(F.lit("a b"), F.lit("ab"), keep_space=True),
    )
    assert got == pytest.approx([3, 2 / 3, 2.0, 0.0, 1 / 3, 1 / 3])


def test_rewards(one):
    got = one(
        rewards.wer_exponential(F.lit(0.2)), rewards.cer_tanh(F.lit(0.2)), rewards.asr_nll(F.lit(1.5)),
        rewards.weighted_harmonic(F.lit(0.5), F.lit(0.25)), rewards.weighted_harmonic(F.lit(0.0), F.lit(0.25)),
        *(rewards.piecewise(F.lit(float(v)), 0, 5, 10) for v in (0, 5, 10, 20)),
        *(rewards.piecewise(F.lit(float(v)), 10, 5, 0, higher=False) for v in (10, 5, 0)),
        *(rewards.speaker_cosine(F.lit(float(v))) for v in (-1, 0, 1)),
        rewards.duration(F.lit(9.0), F.lit(10.0)), rewards.duration_similarity(F.lit(9.0), F.lit(10.0)),
        rewards.variation(ints(1, 3).cast("array<double>")), rewards.f0_variation(ints(0, 1, 3).cast("array<double>"), F.lit(0.5)), rewards.energy_variation(ints(1, 3).cast("array<double>"), F.lit(0.5)),
    )
    expected = [math.exp(-0.5), 1 - math.tanh(0.6), math.exp(-0.5), 1 / (0.6 / 0.5 + 0.4 / 0.25), 0, 0, 0.5, 1, 1, 0, 0.5, 1, 0, 0.5, 1, -0.1, math.exp(-0.1), 0.5, 1, 1]
    assert got == pytest.approx(expected)


def test_what_rewards_refuse(one):
    got = one(rewards.energy_variation(F.array(F.lit(-1.0), F.lit(1.0)), F.lit(0.5)), rewards.wer_exponential(F.lit(-0.1)), rewards.asr_nll(F.lit(float("nan"))))
    assert got == [None, None, None]
    with pytest.raises(Exception, match="out of range"):
        one(rewards.strict(rewards.wer_exponential(F.lit(-0.1)), "wer"))


def test_validity(one):
    v = lambda t, **k: arrays.validity(t, 3, 10, **k)
    got = one(v(ints(0, 10, 20, 9, 19, 29)), v(ints(0, 5, 20)), v(ints(0, 5, 20), strict=True), v(ints(0, 10)), v(ints(0, 10), partial=True), v(ints()))
    assert got == pytest.approx([1, 2 / 3, 0, 0, 1, 0])


@pytest.mark.parametrize(("suffix", "allowed"), [((), {6}), ((6,), {7}), ((6, 7), {20, 21, 22}), ((6, 7, 21), {23, 24, 25}), ((6, 7, 21, 24), {8, 20, 21, 22}), ((6, 7, 21, 8), "early end"), ((6, 7, 24), "phase"), ((6, 7, 21, 24, 8), {5})])
def test_grammar(one, suffix, allowed):
    n = one(arrays.next_tokens(ints(*suffix), 6, 7, 8, 20, TOY, pad=5))[0]
    if isinstance(allowed, str):
        assert n["fault"] == allowed
    else:
        assert n["fault"] is None
        assert allowed == ({n["forced"]} if n["forced"] is not None else set(range(n["low"], n["high"])) | ({8} if n["end_ok"] else set()))


def test_extraction_and_stop(one):
    take = lambda t, **k: arrays.extract_codes(t, 7, 8, 20, TOY, **k)
    got = one(take(ints(99, 7, 21, 24, 8, 10)), take(ints(7, 21, 21, 8)), arrays.extract_fault(ints(7, 21, 24), 7, 8, 20, TOY), take(ints(7, 21, 24, 22), strict=False), arrays.restore_end(ints(1), 8, F.lit("stop"), F.lit(8)), arrays.restore_end(ints(1), 8, F.lit("length")))
    assert got == [[1, 4], None, "missing end", [1, 4], [1, 8], [1]]


def test_spans_and_labels(one):
    span = lambda a, b, kind: F.array(F.struct(F.lit(a).alias("start_frame"), F.lit(b).cast("int").alias("end_frame"), F.lit(kind).alias("type")))
    got = one(arrays.span_mask(F.lit(12), span(1, 3, "pronunciation"), 2), arrays.span_mask(F.lit(10), span(2, None, "repetition"), 2), arrays.completion_labels(ints(1, 2, 3, 4, 5, 10, 11), 4), arrays.completion_fault(ints(1, 4), 4))
    assert got == [[False] * 4 + [True] * 4 + [False] * 4, [False] * 6 + [True] * 4, [-100] * 4 + [5, 10, 11], "empty completion"]


def test_frames_of_every_length(one):
    got = one(arrays.drop_repeated_frames(ints(1, 2, 1, 2, 3, 4), 2), arrays.drop_repeated_frames(ints(), 2), arrays.drop_repeated_frames(ints(1, 2, 3), 2), arrays.snac_deinterleave(ints(1, 2)), arrays.drop_repeated_frames(F.lit(None).cast("array<int>"), 2))
    assert got == [[1, 2, 3, 4], [], None, None, None]


def test_composite():
    with pytest.raises(ValueError):
        rewards.CompositeReward({})
    with pytest.raises(ValueError):
        rewards.build_composite({"weights": {"wer": 1.0}})
    r = rewards.build_composite({"weights": {"a": 1.0}, "protected_metrics": ["wer"], "protected_thresholds": {"wer": 0.2}})
    assert not r.higher("wer") and r.higher("a")


def test_compare(spark):
    r = rewards.CompositeReward({"i": 0.5, "s": 0.5}, protected=("i", "s"), thresholds={"i": 0.6})
    df = spark.createDataFrame([(0.8, 0.8, 0.7, 0.7), (0.9, 0.65, 0.7, 0.7)], "i double, s double, oi double, os double")
    got = df.select(r.compare(lambda n: F.col(n), lambda n: F.col("o" + n))).collect()
    assert [x[0] for x in got] == [1, 0]


GROUPS = f"prompt_input_ids array<int>, candidates {preferences.CANDIDATES}"


def test_pair_with_guard(spark):
    c = lambda ids, w, q, spans=None, mask=None: (ids, {"wer": w, "quality": q}, spans, mask)
    r = rewards.CompositeReward({"wer": 0.7, "quality": 0.3}, pareto=("wer", "quality"))
    df = spark.createDataFrame([([1, 2], [c([5, 6, 10], 0.9, 0.9), c([5, 6, 11], 0.2, 0.2, [(0, 1, "local")]), c([5, 6, 12], 0.95, 0.1)])], GROUPS)
    row = preferences.pairs_from_groups(df, r, 0.3, group_codes=1, weight_by_gap=True).first()
    assert (row.chosen_input_ids, row.rejected_input_ids) == ([5, 6, 10], [5, 6, 11])
    assert row.sample_weight == pytest.approx(0.7)
    assert (row.chosen_selection_mask, row.rejected_selection_mask) == ([False] * 3, [False, False, True])


def test_pair_reasons_and_ties(spark):
    c = lambda ids, s: (ids, {"s": s}, None, None)
    r = rewards.CompositeReward({"s": 1.0})
    rows = [([1], [c([1], 0.6), c([2], 0.5)]), ([1], [c([1], 0.6)]), ([], [c([1], 0.9), c([2], 0.1)]), ([1], [c([1], 0.9), c([2], 0.9), c([3], 0.1), c([4], 0.1)])]
    got = preferences.pairs_from_groups(spark.createDataFrame(rows, GROUPS).coalesce(1), r, 0.3).collect()
    assert [x.reject_reason for x in got] == ["no safe pair meets the gap", "fewer than two candidates", "bad prompt", None]
    assert (got[3].chosen_input_ids, got[3].rejected_input_ids) == ([1], [4])
    with pytest.raises(Exception, match="lacks a metric"):
        preferences.pairs_from_groups(spark.createDataFrame([([1], [([1], {"x": 1.0}, None, None)] * 2)], GROUPS), r).collect()


def test_bad_metrics_never_win(spark):
    nan = float("nan")
    c = lambda ids, **m: (ids, m, None, None)
    r = rewards.CompositeReward({"s": 1.0}, pareto=("p",), thresholds={"t": 0.1})
    rows = [([1], [c([i], s=s, p=0.5, t=0.5) for i, s in enumerate((nan, 0.9, 0.1))]), ([1], [c([i], s=s, p=p, t=0.5) for i, (s, p) in enumerate(((0.9, nan), (0.1, 0.1)))])]
    got = preferences.pairs_from_groups(spark.createDataFrame(rows, GROUPS).coalesce(1), r).collect()
    assert [x.reject_reason for x in got] == ["not finite s", "not finite p"]
    for missing in ("s", "p", "t"):
        given = [{k: v for k, v in {"s": s, "p": 0.5, "t": 0.5}.items() if k != missing} for s in (0.9, 0.1)]
        with pytest.raises(Exception, match=f"missing {missing}"):
            preferences.pairs_from_groups(spark.createDataFrame([([1], [([1], m, None, None) for m in given])], GROUPS), r).collect()
    lax = rewards.CompositeReward({"s": 1.0, "z": 0.0}, allow_missing=True)
    only = preferences.pairs_from_groups(spark.createDataFrame([([1], [c([1], z=1.0), c([2], s=0.1)])], GROUPS), lax).first()
    assert only.reject_reason == "nothing active"
    flat = spark.createDataFrame([(g, i, s, 0.5, 0.5) for g, scores in enumerate(((nan, 0.9, 0.1), (0.9, 0.1, 0.2))) for i, s in enumerate(scores)], "g int, i int, s double, p double, t double")
    assert [tuple(x)[:3] for x in preferences.pairs_from_rows(flat, "g", "i", r).collect()] == [(1, 0, 1)]
    with pytest.raises(Exception, match="missing s"):
        preferences.pairs_from_rows(flat.withColumn("s", F.when(F.col("i") > 0, F.col("s"))), "g", "i", r).collect()


def test_breakdown(spark):
    r = rewards.CompositeReward({"a": 0.5, "b": 0.5}, thresholds={"c": 0.1})
    rows = [({"a": "0.5", "b": "1", "transcript": "hello", "total": "9"}, {"c": 0.3}), ({"a": "nan", "b": "1"}, {"c": 1.0}), (None, {"a": 1.0, "b": 0.0, "c": 0.5}), ({"a": "1", "b": "1", "c": "2"}, {"total": 1.0}), ({"a": "1", "b": "1"}, None)]
    metrics, fault = r.breakdown([F.col("m")], F.col("e"))
    got = spark.createDataFrame(rows, "m map<string,string>, e map<string,double>").coalesce(1).select(metrics.alias("metrics"), fault.alias("fault")).collect()
    assert got[0].metrics == {"a": 0.5, "b": 1.0, "c": 0.3, "total": 0.75} and got[2].metrics["total"] == 0.5
    assert [x.fault for x in got] == [None, "not finite a", None, "reserved name", "missing c"]
    assert rewards.scorers_needed({"weights": {"wer_reward": 1.0, "quality_reward": 1.0}, "quality": False}) == ["asr"]
    with pytest.raises(ValueError, match="finite"):
        rewards.CompositeReward({"a": float("nan")})


def test_prosody_needs_both_halves(one):
    a, none = ints(1, 3).cast("array<double>"), F.lit(None).cast("double")
    values = F.lit(None).cast("array<double>")
    got = one(rewards.prosody(a, F.lit(0.5), a, F.lit(0.5)), rewards.prosody(a, none, a, F.lit(0.5)), rewards.prosody(values, none, a, F.lit(0.5)), rewards.prosody(values, none, values, none), rewards.prosody(values, F.lit(0.5), a, F.lit(0.5)), rewards.speaker_cosine(F.lit(1.5), clamped=False))
    assert got == [1.0, None, 1.0, None, None, None]


@pytest.mark.parametrize("names", [("x",), ("x", "y"), ("x", "y", "z")])
def test_skyline(spark, names):
    import random

    rng = random.Random(len(names))
    rows = [(i % 3, i, float(rng.randint(0, 8)), float(rng.randint(0, 8)), float(rng.randint(0, 8))) for i in range(240)] + [(0, 900, None, 1.0, 1.0)]
    r = rewards.CompositeReward({"x": 1.0}, maximize={"y": "min"}, pareto=names)
    up = lambda row: [(-v if n == "y" else v) for n, v in zip("xyz", row[2:], strict=True) if n in names]
    beats = lambda a, b: None not in (a[2], b[2]) and up(a) != up(b) and all(p >= q for p, q in zip(up(a), up(b), strict=True))
    want = sorted(b[1] for b in rows if not any(a[0] == b[0] and beats(a, b) for a in rows))
    got = preferences.skyline(spark.createDataFrame(rows, "g int, i int, x double, y double, z double"), "g", "i", r, buckets=4)
    assert sorted(x.i for x in got.collect()) == want


def test_random_voices(spark):
    from tessitura.operators import sequences

    df = spark.createDataFrame([(k, f"text {k}", "own" if k % 2 else None) for k in range(40)], "k long, text string, v string")
    lay = layout("lfm2_5")
    draw = lambda seed: {r.k: "".join(map(chr, r.prompt[1:-2])) for r in sequences.prompts(df, lay, "v", ("ann", "bob"), seed).collect()}
    got = draw(1)
    assert got == draw(1) != draw(2)
    assert {got[k].split(": ")[0] for k in got if k % 2} == {"own"} and {got[k].split(": ")[0] for k in got if not k % 2} == {"ann", "bob"}


def test_edit_distance_beyond_letters(spark):
    import random

    rng = random.Random(2)

    def plain(a, b):
        row = list(range(len(a) + 1))
        for t in b:
            new = [row[0] + 1]
            for i in range(1, len(a) + 1):
                new.append(min(row[i - 1] + (a[i - 1] != t), row[i] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rows = [tuple([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2)) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for x in df.select("a", "b", text.token_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert x.d == plain(x.a, x.b)


def test_mixture(spark):
    assert (batches.parse_ratio("3:2"), batches.parse_ratio(2)) == (1.5, 2.0)
    with pytest.raises(ValueError):
        batches.parse_ratio("2:0")
    at = lambda step: [r.source for r in batches.mixture(spark, 12, 8, 2, 2.0, 1.0, step, 3).orderBy("index").collect()]
    assert at(0)[:6] == [1] * 4 + [2] * 2
    assert at(2)[:8] == [1, 1, 2, 2] * 2
    assert (batches.total_steps(101, 4, 2, 2, 3), batches.total_steps(1, 1, 1, 1, 1, 9), batches.total_steps(16, 4, 2, 1, 1, drop_last=True)) == (21, 9, 2)


def test_blocks_stay_whole(spark):
    def order(epoch):
        return [r.id for r in batches.shuffle_blocks(spark.range(24), "id", 4, 11, epoch).orderBy("block_key", "in_block").collect()]

    first = order(0)
    assert first == order(0) != order(1)
    assert all(first[i : i + 4] == list(range(first[i], first[i] + 4)) for i in range(0, 24, 4))


def test_collate(spark):
    df = spark.createDataFrame([(0, 0, [1, 2], [-100, 2]), (1, 0, [3], [3])], "k int, b int, input_ids array<int>, labels array<int>")
    got = batches.collate(df, "b", 9).orderBy("k").collect()
    assert [(r.input_ids, r.attention_mask, r.labels) for r in got] == [([1, 2], [1, 1], [-100, 2]), ([3, 9], [1, 0], [3, -100])]


def test_collate_pairs(spark):
    df = spark.createDataFrame([(0, [1, 2], [3, 4], [5])], "b int, prompt_input_ids array<int>, chosen_input_ids array<int>, rejected_input_ids array<int>")
    r = batches.collate_pairs(df, "b", 99).first()
    assert (r.chosen_ids, r.rejected_ids, r.rejected_attention) == ([1, 2, 3, 4], [1, 2, 5, 99], [1, 1, 1, 0])
    with pytest.raises(Exception, match="too long"):
        batches.collate_pairs(df, "b", 99, max_length=3).collect()


def test_objectives(one):
    d = F.lit
    got = one(objectives.direct_preference(d(-1.0), d(-2.0), d(-1.5), d(-1.5), 0.2)["loss"], objectives.self_preference(d(-1.0), d(-2.0)), objectives.sampled_kl(d(-1.0), d(-1.0)), objectives.log_sigmoid(d(-800.0)))
    assert got == pytest.approx([math.log1p(math.exp(-0.2)), -1.7 / (1 + math.exp(1.7)), 0, -800])
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    fine = one(objectives.fine_grained(arr(0, 0, 2), arr(0, 0, 0), arr(0, 0, 0), arr(0, 0, 0), F.array(F.lit(False), F.lit(False), F.lit(True)), beta=1.0))[0]
    assert (fine["loss"], fine["fraction"]) == pytest.approx((math.log1p(math.exp(-2)), 1 / 3))
    weights = one(arrays.phase_weights(ints(10, 13, 5, 6), 10, 3, [2.0, 0.5], {5: 3.0}))[0]
    assert weights == [2.0, 0.5, 3.0, 1.0]


def test_schedule_of_a_run(spark):
    # the states at the first and the third step of three, batches of two
    plan = batches.schedule(spark, 12, 8, 2, 2, 1, 3).orderBy("step", "inside").collect()
    assert [(r.step, r.source, r.row, r.next_row) for r in plan] == [(0, 1, 0, 0), (0, 1, 1, 1), (1, 1, 2, 2), (1, 1, 3, 3), (2, 1, 2, 4), (2, 1, 3, 5)]
    for moved in ((2.0, 1.0, 40), (1.0, 3.0, 33), (1.5, 1.5, 10)):
        rows = batches.schedule(spark, 90, 70, 4, *moved, accumulation=2).orderBy("step", "micro", "inside").collect()
        used = [0, 0]
        for number in range(2 * moved[2]):
            step = number // 2
            a, b = batches.batch_counts(moved[0] + (moved[1] - moved[0]) * step / (moved[2] - 1))
            cycle, place = divmod(number, a + b)
            source, own, size = (1, cycle * a + place, 90) if place < a else (2, cycle * b + place - a, 70)
            for inside in range(4):
                r = rows[number * 4 + inside]
                assert (r.step, r.micro, r.inside, r.source, r.row, r.next_row) == (step, number % 2, inside, source, (own * 4 + inside) % size, (used[source - 1] * 4 + inside) % size)
            used[source - 1] += 1


def test_grammar_at_every_position(spark):
    from tessitura.plans.layout import codec

    mimi = codec("mimi")
    good = [6, 7, *(100 + i % 8 * 2048 for i in range(24))]
    rows = [good, [*good, 8], [*good, 8, 5, 5], [*good[:-3], 8], [6], [], [7, 6], [6, 6, 100], [*good[:12], 99, *good[13:], 8], [*good, 100 + 2048], [6, 7, 8], [6, 8]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s array<int>")
    fields = ("forced", "low", "high", "end_ok", "fault")
    every = df.select("i", F.inline(arrays.next_tokens_everywhere(F.col("s"), 6, 7, 8, 100, mimi, pad=5))).collect()
    prefixes = df.select("i", F.explode(F.sequence(F.lit(0), F.size("s"))).alias("position"), "s").withColumn("s", F.slice("s", F.lit(1), F.col("position")))
    single = prefixes.select("i", "position", arrays.next_tokens(F.col("s"), 6, 7, 8, 100, mimi, pad=5).alias("n")).select("i", "position", "n.*").collect()
    key = lambda r: (r.i, r.position, *(r[f] for f in fields))
    assert sorted(map(key, every), key=str) == sorted(map(key, single), key=str) and len(every) == sum(len(r) + 1 for r in rows)


def _plain_front(points):
    return sorted(i for i, p in enumerate(points) if not any(q != p and all(a >= b for a, b in zip(q, p, strict=True)) for q in points))


@pytest.mark.parametrize("metrics", [3, 4])
def test_fronts_against_all_pairs(spark, metrics):
    import random

    rng = random.Random(metrics)
    names = ("a", "b", "c", "d")[:metrics]
    r = rewards.CompositeReward({"a": 1.0}, pareto=names)
    groups = {g: [tuple(float(rng.randint(0, top)) for _ in names) for _ in range(400)] for g, top in (("x", 3), ("y", 40), (None, 12))}
    rows = [(g, i, *p) for g, points in groups.items() for i, p in enumerate(points)] + [("x", 900, *[float("nan")] * metrics)]
    df = spark.createDataFrame(rows, "g string, i int, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    for buckets in (1, 5, 256):
        got = preferences.skyline(df, "g", "i", r, buckets=buckets).collect()
        for g, points in groups.items():
            assert sorted(x.i for x in got if x.g == g and x.i < 900) == _plain_front(points)
        assert sum(x.i == 900 for x in got) == 1


def test_front_of_one_large_group(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    values = np.round(rng.random((100_000, 4)), 4)
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(values)], "g int, i int, a double, b double, c double, d double").repartition(8)
    for names in (("a", "b", "c"), ("a", "b", "c", "d")):
        got = sorted(x.i for x in preferences.skyline(df, "g", "i", rewards.CompositeReward({"a": 1.0}, pareto=names)).select("i").collect())
        own = values[:, : len(names)]
        order = np.lexsort(tuple(-own[:, k] for k in reversed(range(len(names)))))
        front = np.zeros((0, len(names)))
        want = []
        for i in order.tolist():
            p = own[i]
            over = (front >= p).all(axis=1)
            if not (over & (front > p).any(axis=1)).any():
                want.append(i)
                front = np.concatenate([front, p[None]])
        assert got == sorted(want)
