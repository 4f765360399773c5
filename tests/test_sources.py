import io
import json
import math
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.plans import stages
from tessitura.plans.layout import Codec
from tessitura.sources import archives, audio, cache, plugins, readers, shared, writers


def test_tar_pairs_by_stem(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in {"x.json": json.dumps({"text": "hi", "duration": 2}).encode(), "x.wav": b"w", "x.mp3": b"m", "y.json": b"{bad", "y.wav": b"w", "z.json": b'{"text": " "}', "z.flac": b"f", "n.json": b'{"text": "t"}'}.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = archives.read_tars(spark, f"file://{tmp_path}/*.tar").collect()
    assert [(r.stem, r.audio_name, r.audio, r.text, r.duration) for r in rows] == [("x", "x.mp3", bytearray(b"m"), "hi", 2.0)]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([((bytearray(b"a"), "p"), " hi "), ((None, "p"), "x"), ((bytearray(b"b"), None), "\t")], "audio struct<bytes:binary,path:string>, text string")
    df.write.parquet(str(tmp_path / "s"))
    got = readers.read_shards(spark, str(tmp_path / "s")).collect()
    assert [(r.audio, r.text, r.speaker) for r in got] == [(bytearray(b"a"), "hi", None)]


def test_candidate_lines(spark, tmp_path):
    line = json.dumps({"prompt_input_ids": [1], "candidates": [{"completion_input_ids": [2], "metrics": {"s": 1.0}}]})
    (tmp_path / "c.jsonl").write_text(f"{line}\n\n{line}\n")
    got = readers.read_candidates(spark, str(tmp_path / "c.jsonl")).orderBy("source_line").collect()
    assert [r.source_line for r in got] == [1, 3]
    assert got[0].candidates[0].metrics == {"s": 1.0}


def test_dataset_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "train"), (2, "b", "test")], "k long, t string, split string")
    writers.write_lines(df.coalesce(1), str(tmp_path / "d.jsonl"))
    assert "é" in next(tmp_path.glob("d.jsonl/part-*")).read_text(encoding="utf-8")
    assert readers.read_dataset(spark, str(tmp_path / "d.jsonl")).count() == 2
    writers.write_dataset(df, str(tmp_path / "saved"))
    assert [r.k for r in readers.read_dataset(spark, str(tmp_path / "saved"), "test").collect()] == [2]
    with pytest.raises(KeyError):
        readers.read_dataset(spark, str(tmp_path / "saved"), "dev")
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.txt")


def test_pairs_are_checked(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([([1], [2], [3])], "prompt_input_ids array<int>, chosen_input_ids array<int>, rejected_input_ids array<int>").write.parquet(path)
    assert readers.read_pairs(spark, path).count() == 1
    with pytest.raises(ValueError):
        readers.read_pairs(spark, path, fine_grained=True)


def test_speaker_folders(spark, tmp_path):
    for who, said in (("ann", "hello "), ("bob", "there")):
        os.makedirs(tmp_path / who)
        (tmp_path / who / "t.txt").write_text(said)
        (tmp_path / who / "b.wav").write_bytes(b"2")
        (tmp_path / who / "a.wav").write_bytes(b"1")
    got = readers.read_speakers(spark, str(tmp_path)).orderBy("speaker").collect()
    assert [(r.speaker, r.transcript, r.audio_path[-5:]) for r in got] == [("ann", "hello", "a.wav"), ("bob", "there", "a.wav")]


def test_prune():
    assert readers.prune(["data/a.parquet", "Emilia/EN/b.tar", "x"], ["emilia"]) == ["Emilia/EN/b.tar"]
    with pytest.raises(ValueError):
        readers.prune([], ["other"])


SETTINGS = {"dataset": "d", "subsets": ("a", "b"), "model": "m", "codec": "snac", "codec_model": "c", "audio_start": 1, "rate": 24000}


def test_cache(spark, tmp_path):
    for d in ("one", "two"):
        os.makedirs(tmp_path / "in" / d)
        (tmp_path / "in" / d / "part.parquet").write_bytes(b"x")
    files = cache.source_files(spark, str(tmp_path / "in"))
    names = sorted(r.shard for r in files.collect())
    assert len(set(names)) == 2 and all(n.startswith("part-") for n in names)
    key = cache.digest(files, SETTINGS)
    assert key == cache.digest(files.orderBy(F.desc("path")).repartition(3), dict(reversed(SETTINGS.items())))
    for k in SETTINGS:
        assert key != cache.digest(files, SETTINGS | {k: "other"})
    root = f"file://{tmp_path}/work"
    made = cache.TokenCache(files, SETTINGS, root)
    done = lambda c: sorted((r.shard, r.rows) for r in c.finished().collect())
    assert done(made) == [] and made.remaining().count() == 2
    tokens = lambda *rows: spark.createDataFrame(list(rows), "shard string, token int")
    shards = lambda *own: spark.createDataFrame([(n,) for n in own], "shard string")
    made.add(tokens((names[0], 1), (names[0], 2)), shards(names[0]))
    again = cache.TokenCache(files, SETTINGS, root)
    assert again.folder == made.folder and done(again) == [(names[0], 2)]
    assert [r.shard for r in again.remaining().collect()] == names[1:] and again.rows().count() == 2
    # an attempt that breaks off, whatever it has written, leaves nothing that is read, and the shard to do
    broken = tokens((names[1], 3), (names[1], 4)).withColumn("token", F.when(F.col("token") > 3, F.raise_error(F.lit("disk full")).cast("int")).otherwise(F.col("token")))
    with pytest.raises(Exception, match="disk full"):
        again.add(broken, shards(names[1]))
    with pytest.raises(Exception, match="another shard"):
        again.add(tokens((names[0], 8), (names[1], 9)), shards(names[1]))
    assert [r.shard for r in again.remaining().collect()] == names[1:] and sorted(r.token for r in again.rows().collect()) == [1, 2]
    # a shard whose rows were all rejected is done
    again.add(tokens(), shards(names[1]))
    assert done(again) == [(names[0], 2), (names[1], 0)] and again.remaining().count() == 0
    # a second attempt replaces the first
    again.add(tokens((names[0], 5)), shards(names[0]))
    assert done(again)[0] == (names[0], 1) and [tuple(r) for r in again.rows().collect()] == [(names[0], 5)] and again.rows().columns == ["shard", "token"]
    shared.publish_json(spark, {}, f"{made.folder}/record.json")
    with pytest.raises(RuntimeError, match="something else"):
        cache.TokenCache(files, SETTINGS, root)
    (tmp_path / "in" / "one" / "part.parquet").write_bytes(b"longer")  # a replaced file is another shard
    later = cache.source_files(spark, str(tmp_path / "in"))
    assert len({r.shard for r in later.collect()} & set(names)) == 1 and cache.digest(later, SETTINGS) != key


def test_coarse_skip_and_row_shards(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(7)
    for _ in range(2):
        assert cache.skip_if_there(spark, f"file://{tmp_path}/t", make).count() == 7
    assert len(calls) == 1
    dealt = cache.shard_rows(spark.range(7), "id", 3).collect()
    assert [[r.id for r in dealt if r.part == p] for p in range(3)] == [[0, 3, 6], [1, 4], [2, 5]]


def test_publish_is_whole_or_not(tmp_path):
    path = tmp_path / "f.json"
    writers.publish_json({"a": "é"}, str(path))
    with pytest.raises(TypeError):
        writers.publish("text", str(path))
    assert json.loads(path.read_text()) == {"a": "é"} and os.listdir(tmp_path) == ["f.json"]


def test_workers():
    cache.join_workers({"a": 0})
    with pytest.raises(RuntimeError, match=r"b \(exit code 7\)"):
        cache.join_workers({"a": 0, "b": 7, "c": 0})


def test_mono_rules():
    x = np.arange(6.0).reshape(2, 3)
    assert audio.mono(x, "smaller").tolist() == [1.5, 2.5, 3.5] == audio.mono(x, "first").tolist()
    assert audio.mono(x, "second").tolist() == [1.0, 4.0] == audio.mono(x, "last").tolist()
    with pytest.raises(ValueError):
        audio.mono(np.zeros((9, 9)), "strict")


def _member(tar, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    tar.addfile(info, io.BytesIO(data))


def test_archives_are_split_and_may_be_packed(spark, tmp_path, monkeypatch):
    said = lambda k: json.dumps({"text": f"t{k}", "duration": k}).encode()
    for kind, mode in (("plain", "w"), ("packed", "w:gz")):
        with tarfile.open(tmp_path / f"{kind}.tar", mode) as tar:
            for k in range(40):
                _member(tar, f"d.x/{'n' * 120}{k}.json", said(k))
                _member(tar, f"d.x/{'n' * 120}{k}.{('mp3', 'wav', 'flac')[k % 3]}", bytes([k]) * (1000 + k))
            _member(tar, f"d.x/{'n' * 120}3.json", said(333))  # the last of one name counts
            _member(tar, "alone.json", said(1))
            _member(tar, "bad.json", b"{")
            _member(tar, "bad.mp3", b"x")
    monkeypatch.setattr(archives, "TASK_BYTES", 4096)
    for kind in ("plain", "packed"):
        df = archives.read_tars(spark, f"file://{tmp_path}/{kind}.tar")
        got = sorted(df.collect(), key=lambda r: r.audio[0])
        assert [(r.audio[0], len(r.audio), r.text, r.duration) for r in got] == [(k, 1000 + k, "t333" if k == 3 else f"t{k}", 333.0 if k == 3 else float(k)) for k in range(40)]
        if kind == "plain":
            assert df.groupBy(F.spark_partition_id()).count().count() >= 4  # tasks that read one archive


def test_archive_over_two_gigabytes(spark, tmp_path):
    """A sparse file: its first member, a hole of 2.5 GB, is skipped by its header and never read."""
    size = 5 << 29
    path = tmp_path / "large.tar"
    with open(path, "wb") as f:
        info = tarfile.TarInfo("hole.mp3")
        info.size = size
        f.write(info.tobuf())
        f.seek(512 + size)
        tail = io.BytesIO()
        with tarfile.open(fileobj=tail, mode="w") as tar:
            _member(tar, "a.json", b'{"text": " far "}')
            _member(tar, "a.wav", b"sound")
        f.write(tail.getvalue()[:2240])  # the end is damaged too
    assert os.path.getsize(path) > 2**31 and os.stat(path).st_blocks * 512 < 1 << 20
    assert [(r.stem, bytes(r.audio), r.text) for r in archives.read_tars(spark, f"file://{path}").collect()] == [("a", b"sound", "far")]
    index = {r.name: (r.offset, r.size) for r in archives.tar_index(spark, f"file://{path}").collect()}
    assert index["hole.mp3"] == (512, size) and index["a.json"][0] > 2**31


def _convolved(x, rate, target, zeros=16):
    """Every output by its own sum over a windowed sinc."""
    cut = min(1.0, target / rate)
    width = math.ceil(zeros / cut)
    out = []
    for n in range(math.ceil(len(x) * target / rate)):
        at, total = n * rate / target, 0.0
        left = n * rate // target
        for k in range(left - width + 1, left + width + 1):
            if 0 <= k < len(x):
                gap = at - k
                sinc = 1.0 if gap == 0 else math.sin(math.pi * cut * gap) / (math.pi * cut * gap)
                total += x[k] * cut * sinc * math.cos(math.pi * max(-1, min(1, gap / width)) / 2) ** 2
        out.append(total)
    return np.array(out)


def test_resampling_in_parts(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(700)
    cuts = [0, 5, 6, 6, 40, 300, 301, 690, 700]
    rows = [(r, k, x[a:b].tolist()) for r in ("one", "two") for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [("two", 99, None), ("three", 0, [1.0])]
    df = spark.createDataFrame(rows, "r string, k int, x array<double>").repartition(3)
    for rate, target in ((16_000, 24_000), (48_000, 24_000), (44_100, 24_000), (22_050, 24_000)):
        whole = audio.resample(x, rate, target)
        assert np.allclose(whole, _convolved(x, rate, target), atol=1e-12)
        got = audio.resample_parts(df, "r", "k", "x", rate, target).orderBy("k").collect()
        for r in ("one", "two"):
            assert np.concatenate([np.array(g.x) for g in got if g.r == r and g.x is not None]).tolist() == whole.tolist()
        assert [g.x for g in got if g.k == 99] == [None] and len(got) == len(rows)


def test_resample_keeps_a_tone():
    t = np.arange(4800) / 48000
    out = audio.resample(np.sin(2 * np.pi * 440 * t), 48000, 24000)
    assert len(out) == 2400
    assert np.abs(out - np.sin(2 * np.pi * 440 * np.arange(2400) / 24000))[50:-50].max() < 1e-2


def test_waveform_and_toy_codec(spark, tmp_path):
    path = str(tmp_path / "w.wav")
    assert writers.save_wave([0.0, 0.5, -0.5, 0.25], path) and not writers.save_wave(None, path + "x")
    data = open(path, "rb").read()
    df = spark.createDataFrame([((data, None, None, None),), ((b"bad", None, None, None),), ((None, None, [0.5, 0.5], 24000),)], "audio struct<bytes:binary,path:string,array:array<float>,sampling_rate:int>").coalesce(1)
    out = df.select(audio.waveform(F.col("audio")).alias("w"))
    waves = [r.w for r in out.collect()]
    assert waves[0] == pytest.approx([0, 0.5, -0.5, 0.25], abs=1e-3) and waves[1] is None and waves[2] == [0.5, 0.5]
    codec = Codec("toy", 2, 11)
    codes = [r[0] for r in out.select(plugins.encode_with(lambda: plugins.ToyCodec(codec), F.col("w"))).collect()]
    assert codes == [[5, 18, 2, 17], None, [7, 18]]


def test_audio_by_path_and_plug_in(spark, tmp_path):
    path = str(tmp_path / "w.wav")
    writers.save_wave([0.0, 0.5], path)
    rows = [((None, path, None, None),), ((None, f"file://{path}", None, None),), ((b"xy", "a.mp3", None, None),), ((b"xy", "a.flac", None, None),), ((None, "gone.wav", None, None),), ((None, None, None, None),)]
    df = spark.createDataFrame(rows, "audio struct<bytes:binary,path:string,array:array<float>,sampling_rate:int>").coalesce(1)
    w = audio.waveform(F.col("audio"), decoders={".mp3": lambda data: (np.array([float(len(data))]), 24000)})
    got = df.select("audio", w.alias("w")).select("w", audio.fault(F.col("audio"), F.col("w")).alias("f")).collect()
    assert [len(r.w) if r.w else None for r in got] == [2, 2, 1, None, None, None]
    assert [r.f for r in got] == [None, None, None, "cannot decode", "cannot decode", "no audio"]


def test_resample_in_blocks():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(30_000)
    whole = audio.resample(x, 3, 2)
    assert len(whole) == 20_000 and np.allclose(audio.resample(x[:9000], 3, 2)[:5000], whole[:5000])


def test_damaged_archives(spark, tmp_path):
    def member(tar, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))

    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for k, meta in enumerate((b'{"text": " said "}', b'{"text": 5}', b'[1]', b'{"text": "x", "duration": "long"}')):
            member(tar, f"{k}.json", meta)
            member(tar, f"{k}.wav", b"w")
    (tmp_path / "b.tar").write_bytes(b"no archive at all" * 100)
    (tmp_path / "c.tar").write_bytes((tmp_path / "a.tar").read_bytes()[:1600])
    rows = archives.read_tars(spark, f"file://{tmp_path}/*.tar").collect()
    assert [(r.stem, r.text) for r in rows if r.path.endswith("a.tar")] == [("0", "said")] and len(rows) <= 2


def test_stages(tmp_path):
    seen = []
    given = [{"name": "a"}, {"name": "off", "enabled": False}, {"name": "b"}, {"name": "c", "input_from": "a"}, {"name": "d", "input_from": "initial"}]
    out = stages.run(given, str(tmp_path), "base", seen.append)
    assert [(s["name"], os.path.basename(s["input"])) for s in seen] == [("a", "base"), ("b", "a"), ("c", "a"), ("d", "base")]
    assert json.loads((tmp_path / "pipeline_state.json").read_text())["completed"] == out
    assert json.loads((tmp_path / "c" / "resolved.json").read_text()) == {"name": "c", "input": out["a"], "output": out["c"], "config": {}}
    for bad in ([{"name": "a"}, {"name": "a"}], [{"name": "../x"}], [{"name": "a", "input_from": "z"}]):
        with pytest.raises(ValueError):
            stages.resolve(bad, "o", "i")


def test_streaming_is_incremental(spark, tmp_path):
    from tessitura.streaming.incremental import stream_folder

    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.range(3)
    df.write.parquet(source)
    for expected in (3, 8):
        stream_folder(spark, source, df.schema, lambda d: d.withColumn("x", F.col("id") + 1), sink, mark).awaitTermination()
        assert spark.read.parquet(sink).count() == expected
        spark.range(5).write.mode("append").parquet(source)


def test_numbered_is_gapless(spark):
    from tessitura.operators.numbering import numbered

    rows = numbered(spark.createDataFrame([(k * k,) for k in range(50)], "k long"), "k").orderBy("k").collect()
    assert [r.row for r in rows] == list(range(50))
    far = spark.range(4000).select(F.col("id").alias("k")).unionAll(spark.createDataFrame([(2**62,), (-(2**61),)], "k long")).repartition(7)
    out = numbered(far, "k")
    assert [r.row for r in out.orderBy("k").collect()] == list(range(4002))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 4002 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = [(g, a, b) for g in ("x", None, "y") for a in range(5) for b in range(4 if g else 3)]
    got = numbered(spark.createDataFrame(groups, "g string, a int, b int").repartition(5), "a", "b", by=["g"], name="n").collect()
    for g in ("x", None, "y"):
        own = sorted((r.a, r.b, r.n) for r in got if r.g == g)
        assert [n for _, _, n in own] == list(range(len(own))) and len(own) == (20 if g else 15)
    assert numbered(far.limit(0), "k").count() == 0


def test_line_numbers_restart_in_each_file(spark, tmp_path):
    for k, n in enumerate((2, 5, 3)):
        (tmp_path / f"f{k}.jsonl").write_text("".join(f'{{"prompt_input_ids": [{k}, {i}], "candidates": []}}\n' + "\n" * (i % 2) for i in range(n)))
    got = readers.read_candidates(spark, str(tmp_path)).collect()
    assert sorted((r.source_file[-8:], r.source_line, tuple(r.prompt_input_ids)) for r in got) == sorted((f"f{k}.jsonl", 1 + i + i // 2, (k, i)) for k, n in enumerate((2, 5, 3)) for i in range(n))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # many blocks of one file
    try:
        assert sorted((r.source_line, r.prompt_input_ids[1]) for r in readers.read_candidates(spark, str(tmp_path / "f1.jsonl")).collect()) == [(1 + i + i // 2, i) for i in range(5)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_baselines_of_long_runs(spark):
    from tessitura.operators import groups

    n = 100_000
    df = spark.range(n).select(F.lit("long").alias("run"), F.col("id").alias("s"), (F.col("id") * 7919 % 1000 / 10).alias("x")).repartition(6)
    df = df.unionAll(spark.createDataFrame([("one", 5, 3.0), ("two", 1, 1.0), ("two", 4, None), ("two", 2, 2.0), ("two", 9, 5.0)], "run string, s long, x double"))
    got = {(r.run, r.s): r.baseline for r in groups.moving_baseline(df, "s", "x", 0.9, run=["run"]).collect()}
    b = None
    for k in range(n):
        x = k * 7919 % 1000 / 10
        b = x if b is None else b
        assert abs(got["long", k] - b) < 1e-9
        b = 0.9 * b + 0.1 * x
    assert got["one", 5] == 3.0 and got["two", 1] == got["two", 2] == 1.0 and abs(got["two", 9] - 1.1) < 1e-12 and len(got) == n + 4
    assert groups.moving_baseline(df.limit(0), "s", "x").count() == 0



def _entry(tmp_path, left_out, code):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tessitura"), tmp_path / "tessitura", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_without_the_llm_folder(tmp_path):
    for k, left_out in enumerate((["llm"], ["llm", "corpus_pipeline.py"])):
        os.makedirs(tmp_path / str(k))
        done = _entry(tmp_path / str(k), left_out, "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q), q; assert e.oracle_sql()")
        assert done.returncode == 0, done.stderr


def test_entry_hides_no_broken_module(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.exists(os.path.join(root, "tessitura", "llm", "near.py")):
        pytest.skip("the folder is not there")
    done = _entry(tmp_path, ["near.py"], "import __spark_entry__ as e; e.queries()")
    assert done.returncode != 0 and "near" in done.stderr


def test_lines_are_numbered_through_parts(spark, tmp_path, monkeypatch):
    from tessitura import queries

    for file, parts in {"a": {"part-2": 30, "part-10": 40, "part-1": 5}, "b": {"part-1": 7, "part-2": 1}}.items():
        (tmp_path / "in" / f"file={file}").mkdir(parents=True)
        for name, n in parts.items():
            (tmp_path / "in" / f"file={file}" / name).write_text("".join(f"{file} {name} {i:04d}\n" for i in range(n)))
    want = {f"a {p} {i:04d}": k for k, (p, i) in enumerate([*(("part-1", i) for i in range(5)), *(("part-2", i) for i in range(30)), *(("part-10", i) for i in range(40))], 1)}
    want |= {f"b {p} {i:04d}": k for k, (p, i) in enumerate([*(("part-1", i) for i in range(7)), ("part-2", 0)], 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "in"), parts=True).collect()
        assert {r.value: r.source_line for r in got} == want and len(got) == len(want)
        assert {r.source_file.rsplit("/", 1)[-1] for r in got} == {"file=a", "file=b"}
        alone = readers.numbered_lines(spark, str(tmp_path / "in" / "file=a" / "part-10")).collect()
        assert sorted(r.source_line for r in alone) == list(range(1, 41)) and all(int(r.value[-4:]) + 1 == r.source_line for r in alone)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # no task has a whole file
    spark.createDataFrame([(i if i % 50 else None, f"text {i}") for i in range(1200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries.shared, "shared_folder", lambda *_: str(tmp_path / "out"))
    got = queries.QUERIES["src_6_line_numbers"](spark, str(tmp_path)).collect()
    ids = [[i for i in range(1200) if i % 50 and i % 3 == k] for k in range(3)]
    assert {r.doc_id: r.source_line for r in got if r.doc_id is not None} == {i: n for g in ids for n, i in enumerate(g, 1)}
    assert sorted(r.source_line for r in got if r.doc_id is None) == list(range(1, 25))
    assert len(list((tmp_path / "out" / "in").glob("file=*/part-*.json"))) > 4


def test_tokenizers_get_small_pieces(spark):
    """By bytes, not by rows alone; ids go back to Spark piece by piece."""

    class Lengths:
        def encode_batch(self, texts):
            return [[len(t), len(texts), sum(map(len, texts))] for t in texts]

    texts = [None, *("x" * 300_000 for _ in range(20)), "", "y" * 3_000_000, None, *("z" for _ in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r.i: r.ids for r in df.select("i", plugins.tokenize_with(Lengths)(F.col("t")).alias("ids")).collect()}
    assert len(got) == len(texts) and all((got[i] is None) == (t is None) for i, t in enumerate(texts))
    assert all(got[i][0] == len(t) for i, t in enumerate(texts) if t is not None)
    assert max(x[1] for x in got.values() if x) <= plugins.AT_ONCE
    assert max(x[2] for x in got.values() if x and x[1] > 1) <= plugins.BYTES_AT_ONCE
    assert df.where("i < 0").select(plugins.tokenize_with(Lengths)(F.col("t"))).collect() == []
