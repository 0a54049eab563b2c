"""Operators against plain loops and known signals."""

import collections
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave import plans
from tidewave.functions import bands as fb
from tidewave.operators import panes, patterns, peaks, reports, rollup, scan, spectral, stats, walk
from tidewave.operators.extrema import Extrema, Many
from tidewave.operators.quantiles import percentiles, percentiles_of_short
from tidewave.sources import media, series, tables
from tidewave.streaming import windowed_levels

SCHEMA = "track_id string, channel_index int, sample_idx long, value double"


def signal(spark, x, channel=0):
    return spark.createDataFrame([("t", channel, i, float(v)) for i, v in enumerate(x)], SCHEMA)


def test_sine_has_its_crest_factor(spark):
    t = np.arange(4000) / 1000
    w = panes.fixed_window(signal(spark, 0.5 * np.sin(2 * np.pi * 50 * t)), 1000, 500, 1000.0).collect()
    assert len(w) == 7 and all(r["is_valid_crest_factor"] for r in w)
    assert all(abs(r["crest_factor_db"] - 3.0103) < 1e-3 for r in w)
    assert w[0]["peak_level_dbfs"] == pytest.approx(20 * math.log10(0.5), abs=2e-5)


def test_silence_is_invalid_and_chunks_of_it_are_0_db(spark):
    s = signal(spark, np.zeros(100))
    assert not any(r["is_valid_crest_factor"] for r in panes.fixed_window(s, 20, 10).collect())
    assert {r["crest_factor_db"] for r in panes.fixed_chunk(s, 20).collect()} == {0.0}
    assert stats.whole_interval(s).first()["crest_factor"] is None


def test_sliding_maximum(spark):
    got = panes.sliding_max(signal(spark, [0, 0.5, 1, 0.2, 0.1, 0.8, 0.3, 0.6]), 2, 2).orderBy("window_idx").collect()
    assert [r["max_abs"] for r in got] == [0.5, 1, 0.8, 0.6]


@pytest.mark.parametrize("kind, rate", [("hold", 0.9), ("slow", 0.1), ("follow", 0.3)])
def test_block_scan_is_the_loop(spark, kind, rate):
    x = np.random.default_rng(2).standard_normal(500) * np.repeat([1, 0.01, 2, 0.1, 0], 100)
    e, want = 0.0, []
    for i, v in enumerate(x):
        if kind == "hold":
            e = max(abs(v), rate * e)
        elif kind == "slow":
            e = v * v if i == 0 else e + rate * (v * v - e)
        else:
            e = max(abs(v), (1 - rate) * e + rate * abs(v))
        want.append(math.sqrt(e) if kind == "slow" else e)
    got = series.to_rows(scan.envelope(series.to_blocks(signal(spark, x), 37), kind, rate)).orderBy("sample_idx").collect()
    assert np.allclose([r["value"] for r in got], want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("kind, rate", [("hold", 0.5), ("slow", 0.5), ("follow", 0.999)])
def test_fast_decays_and_runs_of_blocks(spark, monkeypatch, kind, rate):
    """Scales beyond the range of doubles, and blocks in several runs."""
    monkeypatch.setattr(scan, "RUN", 3)
    x = np.random.default_rng(5).standard_normal(9000) * np.repeat([1, 1e-6, 3], 3000)
    e, want = 0.0, []
    for i, v in enumerate(np.abs(x)):
        e = max(v, rate * e) if kind == "hold" else (v * v if i == 0 else e + rate * (v * v - e)) if kind == "slow" else max(v, (1 - rate) * e + rate * v)
        want.append(math.sqrt(e) if kind == "slow" else e)
    got = series.to_rows(scan.envelope(series.to_blocks(signal(spark, x), 1000), kind, rate)).orderBy("sample_idx").collect()
    assert np.allclose([r["value"] for r in got], want, rtol=1e-9, atol=1e-15)


def test_samples_are_numbered_across_slices(spark):
    rows = spark.range(5000).selectExpr("id % 3 as c", "timestamp_seconds(if(id % 50 = 0, null, (id * 7919) % 1000)) as ts", "id", "if(id = 77, double('nan'), id * 1.0) as v")
    one, many = (series.from_table(rows, F.lit("t"), F.col("c"), ["ts", "id"], F.col("v"), n) for n in (1 << 20, 97))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(one) == key(many) and len(key(many)) == 4999
    # no holes where values are missing: what follows keeps its place in blocks
    by = collections.defaultdict(list)
    for r in many.collect():
        by[r["channel_index"]].append(r["sample_idx"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("ts", ["timestamp_micros(if(id % 10 = 0, id * 1000000000, id))", "lpad(cast(if(id % 10 = 0, id * 1000000000, id) as string), 20, '0')"])
def test_crowded_moments_are_numbered_by_many_tasks(spark, ts):
    """Nine of ten rows lie within a hundredth of a second, the others over months; text keys are cut as well."""
    rows = spark.range(6000).selectExpr("0 as c", f"{ts} as ts", "id", "cast(id as double) as v")
    one, many = (series.from_table(rows, F.lit("t"), F.col("c"), ["ts", "id"], F.col("v"), n) for n in (1 << 20, 300))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    part = series._slices(rows.selectExpr("'t' as track_id", "c as channel_index", "ts", "id"), F.col("ts") if "lpad" in ts else F.unix_micros("ts").cast("double"), ["ts", "id"], 20)
    sizes = [r["count"] for r in rows.groupBy(part.alias("slice")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 900


def test_missing_values_leave_no_trace_in_envelopes(spark):
    x = np.random.default_rng(3).standard_normal(300)
    rows = [(i, float(v)) for i, v in enumerate(x)]
    holes = sorted(rows + [(i, v) for i in range(0, 300, 7) for v in (None, float("nan"))], key=lambda r: r[0])
    made = []
    for data in (rows, holes):
        df = spark.createDataFrame([(i, k, v) for k, (i, v) in enumerate(data)], "ts long, id long, v double")
        r = series.from_table(df, F.lit("t"), F.lit(0), ["ts", "id"], F.col("v"))
        made.append([row["value"] for row in series.to_rows(scan.envelope(series.to_blocks(r, 16), "slow", 0.1)).orderBy("sample_idx").collect()])
    assert len(made[0]) == 300 and made[0] == made[1]


def test_weights_are_power_complementary():
    f = np.linspace(0, 24000, 5000)
    assert np.allclose((fb.weights(f, fb.band_centres()) ** 2).sum(0), 1, atol=1e-12)
    with pytest.raises(ValueError):
        fb.weights(f, [2.0, 1.0])
    with pytest.raises(ValueError):
        fb.weights(f, [0.0, 1.0])


def test_bands_close_and_add_up_again(spark):
    x = np.random.default_rng(20260426).standard_normal(4096) * 0.25
    b = series.to_blocks(signal(spark, x), 1024)
    c = spectral.energy_closure(spectral.band_power(b, fb.band_centres(), 48000.0)).first()
    assert abs(c["closure_error_db"]) < 1e-9
    e = spectral.synthesis_error(b, fb.band_centres(), 48000.0).first()
    assert e["weighted_error_db"] < -250 < -60 < e["direct_error_db"]


def test_a_tone_is_in_its_band(spark):
    t = np.arange(8000) / 8000
    levels = spectral.band_levels(spectral.band_panes(series.to_blocks(signal(spark, 0.8 * np.sin(2 * np.pi * 62.5 * 2 * t)), 8000), (62.5, 125.0, 250.0), 8000.0, 1000))
    got = {r["band_hz"]: r["rms"] for r in levels.collect()}
    assert got[125.0] == pytest.approx(0.8 / math.sqrt(2), rel=1e-3)


def find_peaks(db, height, distance):
    runs, i = [], 0
    while i < len(db):
        j = i
        while j + 1 < len(db) and db[j + 1] == db[i]:
            j += 1
        if i > 0 and j < len(db) - 1 and db[i - 1] < db[i] > db[j + 1] and db[i] >= height:
            runs.append(((i + j) // 2, db[i]))
        i = j + 1
    kept = []
    for p in sorted(runs, key=lambda r: (-r[1], -r[0])):
        if all(abs(p[0] - k[0]) >= distance for k in kept):
            kept.append(p)
    return sorted(kept)


def test_peaks_against_a_plain_search(spark):
    db = np.round(np.random.default_rng(4).standard_normal(3000) * 3) - 2
    rows = spark.createDataFrame([("t", 0, i, float(v)) for i, v in enumerate(db)], "track_id string, channel_index int, sample_idx long, db double")
    got = sorted((r["peak_idx"], r["peak_db"]) for r in peaks.find_peaks(rows, 0.0, 7).collect())
    assert got == find_peaks(db.tolist(), 0.0, 7)


@pytest.mark.parametrize("block", [3, 7, 64])
def test_maxima_across_blocks(spark, block):
    db = np.round(np.random.default_rng(5).standard_normal(700)) - 2
    db[100:160] = 3.0  # a plateau over many blocks
    rows = spark.createDataFrame([("t", 0, i, float(v)) for i, v in enumerate(db)], "track_id string, channel_index int, sample_idx long, db double")
    got = sorted((r["peak_idx"], r["peak_db"]) for r in peaks.local_maxima(rows, height=-1.0, block=block).collect())
    assert got == find_peaks(db.tolist(), -1.0, 1)


def test_windows_of_other_lengths_are_compared_as_the_columns_say(spark):
    rng = np.random.default_rng(7)
    windows = [rng.standard_normal(int(n)).tolist() for n in rng.integers(3, 9, 14)] + [[1.0] * 5, [1.0] * 7, [2.0] * 4]
    found = {(i, j): r for i, j, _, r in patterns.alike(windows, 0.2).itertuples(index=False)}
    pairs = [(i, j, windows[i], windows[j]) for i in range(len(windows)) for j in range(i + 1, len(windows)) if len(windows[i]) != len(windows[j])]
    df = spark.createDataFrame(pairs, "i int, j int, a array<double>, b array<double>").select("i", "j", patterns.similarity(F.col("a"), F.col("b")).alias("r"))
    want = {(r["i"], r["j"]): r["r"] for r in df.collect() if r["r"] >= 0.2}
    got = {k: v for k, v in found.items() if len(windows[k[0]]) != len(windows[k[1]])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_worst_cases_keep_away_from_patterns(spark):
    db = [-30.0] * 200
    for i, v in ((20, -1.0), (60, -2.0), (62, -9.0), (120, -3.0), (170, -4.0)):
        db[i] = v
    rows = spark.createDataFrame([("t", 0, i, v) for i, v in enumerate(db)], "track_id string, channel_index int, sample_idx long, db double")
    found = peaks.find_peaks(rows, -20.0, 1)
    taken = found.where("peak_idx in (20, 60)")
    at = lambda top: sorted(r["peak_idx"] for r in peaks.worst_case(found, rows, 10.0, top, taken).collect())
    assert at(9) == [62, 120, 170] and at(1) == [62, 120, 170]  # three at least, of those that are no pattern's
    cut = {r["peak_idx"]: r for r in peaks.worst_case(found, rows, 10.0, 2, window=8).collect()}
    assert sorted(cut) == [20, 60, 120] and cut[60]["start_idx"] == 56 and cut[60]["window"] == db[56:64]
    bands = {k: reports.envelope_analysis(rows.withColumn("band_hz", F.lit(4.0)), 10.0, -20.0, 1, 6, (*peaks.KEYS, "band_hz"), least=2)[k] for k in ("peaks", "worst_cases", "sustained_summary")}
    assert bands["peaks"].count() == 5 and "band_hz" in bands["worst_cases"].columns and bands["sustained_summary"].first()["n_peaks"] == 3


def test_a_full_export(spark, tmp_path):
    w = panes.fixed_window(signal(spark, np.sin(np.arange(400))), 40, 20)
    frames = {"time_domain_summary": stats.time_domain_summary(w), "time_domain_analysis": w, "histogram_linear": spark.createDataFrame([("t", 0, [1.0, 2.0])], "track_id string, channel_index int, x array<double>")}
    assert tables.write_sections(frames, str(tmp_path)) == ["time_domain_summary", "time_domain_analysis", "histogram_linear"]
    assert spark.read.csv(f"{tmp_path}/time_domain_analysis", header=True).count() == w.count()
    assert spark.read.csv(f"{tmp_path}/histogram_linear", header=True, escape='"').first()["x"] == "[1.0,2.0]"
    with pytest.raises(ValueError):
        tables.write_sections({"other": w}, str(tmp_path))


def test_recovery_times_are_ordered(spark):
    db = [-60.0] * 100 + [-d * 0.5 for d in range(200)]
    rows = spark.createDataFrame([("t", 0, i, v) for i, v in enumerate(db)], "track_id string, channel_index int, sample_idx long, db double")
    p = peaks.find_peaks(rows, -3.0, 5)
    e = peaks.sustained_events(p, rows, 1000.0).first()
    assert (e["hold_ms"], e["t3_ms"], e["t6_ms"], e["t9_ms"], e["t12_ms"]) == (3.0, 6.0, 12.0, 18.0, 24.0)


def groups(pairs, lengths, least):
    """The grouping, said otherwise: repeated scans over all pairs."""
    alike = {(i, j): same for i, j, same in pairs}
    used, out = set(), []
    for length in dict.fromkeys(lengths[i] for i in range(len(lengths))):
        for i in [k for k in range(len(lengths)) if lengths[k] == length]:
            mates = [j for j in range(i + 1, len(lengths)) if alike.get((i, j)) is True and j not in used]
            if i not in used and mates:
                used |= set(mates)
                if len(mates) + 1 >= least:
                    out.append([i, *mates])
                    used.add(i)
    for i in range(len(lengths)):
        if i not in used:
            mates = [j for j in range(i + 1, len(lengths)) if alike.get((i, j)) is False and j not in used]
            used |= set(mates)
            if len(mates) + 1 >= least:
                out.append([i, *mates])
                used.add(i)
    return out


def test_pattern_groups():
    rng = np.random.default_rng(6)
    for _ in range(50):
        lengths = dict(enumerate(rng.integers(1, 4, 12).tolist()))
        pairs = [(i, j, lengths[i] == lengths[j]) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.3]
        assert patterns.greedy_groups(12, pairs, lengths, 2) == groups(pairs, lengths, 2)


def test_a_repeating_pulse_is_one_pattern(spark):
    db = [(-3.0 - abs(i % 50 - 20) if abs(i % 50 - 20) < 10 else -40.0) for i in range(1000)]
    rows = spark.createDataFrame([("t", 0, i, v) for i, v in enumerate(db)], "track_id string, channel_index int, sample_idx long, db double")
    m = patterns.repeating_patterns(peaks.windows_around(peaks.find_peaks(rows, -10.0, 20), rows, 30), 0.95, 3, 5)
    s = patterns.pattern_statistics(m, 100.0).collect()
    assert len(s) == 1 and s[0]["num_repetitions"] == 20 and s[0]["pattern_confidence"] == "high"
    assert s[0]["mean_interval_seconds"] == pytest.approx(0.5) and s[0]["beats_per_minute"] == pytest.approx(120)


def test_decay_fit_finds_the_curve(spark):
    rows = [("t", "g", float(80 * (math.exp(d / 10) - 1)), -float(d)) for d in (3, 6, 9, 12)]
    f = rollup.fit_decay(spark.createDataFrame(rows, "track_id string, channel_group string, time_ms double, level_db double")).first()
    assert f["tau_ms"] == pytest.approx(80, rel=0.01) and f["amplitude_db"] == pytest.approx(10, rel=0.01)


def wav(rate, x, bits):
    scale = 1 << (bits - 1)
    if bits == 24:
        body = b"".join(struct.pack("<i", int(v * (scale - 1)))[:3] for v in x.ravel())
    else:
        body = (x * (scale - 1)).astype(f"<i{bits // 8}").tobytes()
    n = x.shape[1]
    fmt = struct.pack("<HHIIHH", 1, n, rate, rate * n * bits // 8, n * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_files_become_blocks(spark, tmp_path, bits):
    x = np.random.default_rng(9).uniform(-1, 1, (1000, 2))
    (tmp_path / "a.wav").write_bytes(wav(8000, x, bits))
    files = media.discover(spark, str(tmp_path))
    assert "content" not in files.columns
    b = media.wav_blocks(files, 300, 300 if bits == 16 else 1 << 20).orderBy("channel_index", "block_idx").collect()
    assert len(b) == 8 and {r["sample_rate"] for r in b} == {8000}
    for c in (0, 1):
        got = np.concatenate([r["samples"] for r in b if r["channel_index"] == c])
        assert np.abs(got - x[:, c]).max() < 2.0 / (1 << (bits - 1)) + 1e-9


def test_result_tables(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([("t", 0, 1.0), ("t", 1, 2.0), ("u", 0, 3.0)], "track_id string, channel_index int, x double")
    tables.write_table(df, folder, "a")
    tables.write_table(df.where("track_id = 'u'").withColumn("x", F.lit(9.0)), folder, "a")
    got = {(r["track_id"], r["channel_index"]): r["x"] for r in tables.read_table(spark, folder, "a", df.schema).collect()}
    assert got == {("t", 0): 1.0, ("t", 1): 2.0, ("u", 0): 9.0}
    one = tables.read_table(spark, folder, "a", df.schema, "t", 1)
    assert one.count() == 1 and "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()
    assert tables.read_table(spark, folder, "none", df.schema).count() == 0
    assert tables.find_tables(spark, folder).first()["table"] == "a"
    tables.write_csv(df, f"{folder}/csv")
    assert spark.read.csv(f"{folder}/csv", header=True).count() == 3
    (tmp_path / "s.csv").write_text("[A]\nx,y\n1,2\n\n[B]\nx,y\n3,4\nragged\n5,6\n\n")
    assert [(r["x"], r["y"]) for r in tables.read_section(spark, f"{folder}/s.csv", "B", ["x", "y"]).orderBy("line").collect()] == [("3", "4"), ("5", "6")]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    e = spark.range(200).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), (F.sin("id") * 3).alias("value"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = windowed_levels(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "2 minutes").writeStream.format("memory").queryName("levels").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["window_start"], r["event_type"], r["n"], round(r["rms"], 9))
    assert sorted(map(key, spark.table("levels").collect())) == sorted(map(key, windowed_levels(e, "2 minutes").collect()))


@pytest.mark.parametrize("holes", [False, True])
def test_first_and_last_hits_are_those_of_a_search_in_full(holes):
    rng = np.random.default_rng(8)
    db = np.round(np.cumsum(rng.standard_normal(20_000)), 1)
    db[rng.integers(0, len(db), 50)] = np.nan
    idx = np.sort(rng.choice(60_000, len(db), replace=False)) if holes else np.arange(500, 500 + len(db))
    x = Extrema(idx, db)
    for _ in range(400):
        a, b = sorted(rng.integers(0, idx[-1] + 100, 2).tolist())
        level = float(rng.choice(db[np.isfinite(db)])) + rng.choice([-30, 0, 30])
        for test, hit in (("at most", db <= level), ("below", db < level), ("at least", db >= level)):
            found = idx[hit & (idx >= a) & (idx < b)]
            assert x.first(a, b, level, test) == (found[0] if len(found) else None)
            assert x.last(a, b, level, test) == (found[-1] if len(found) else None)


def test_the_work_for_a_peak_grows_with_the_logarithm_of_the_range():
    looked = []
    for n in (10_000, 100_000, 1_000_000):
        x = Extrema(np.arange(n), np.append(np.zeros(n - 1), -99.0))
        assert x.first(1, n, -50.0, "at most") == n - 1
        looked.append(x.looked)
    assert looked[-1] <= 8 * 64 and looked[-1] - looked[0] <= 4 * 64


def test_peaks_and_their_times_over_blocks(spark, monkeypatch):
    """Islands over several blocks, and searches that leave their block."""
    monkeypatch.setattr(peaks, "BLOCK", 50)
    rng = np.random.default_rng(12)
    db = np.round(np.cumsum(rng.standard_normal(1500)) % 40 - 40)
    rows = spark.createDataFrame([("t", c, i, float(v)) for c in range(3) for i, v in enumerate(db[: 500 * (c + 1)])], "track_id string, channel_index int, sample_idx long, db double")
    for distance in (3, 20, 200):
        got = collections.defaultdict(list)
        for r in peaks.find_peaks(rows, -30.0, distance, block=37).collect():
            got[r["channel_index"]].append((r["peak_idx"], r["peak_db"]))
        assert {c: sorted(v) for c, v in got.items()} == {c: find_peaks(db[: 500 * (c + 1)].tolist(), -30.0, distance) for c in range(3)}
    one = rows.where("channel_index = 2")
    for r in peaks.sustained_events(peaks.find_peaks(one, -30.0, 20), one, 10.0, -10.0, seconds=7.0).collect():
        i, v = r["peak_idx"], r["peak_db"]
        ahead = db[i : i + 70]
        first = lambda hit: int(np.argmax(hit)) if hit.any() else len(hit)
        assert (r["hold_ms"], r["t6_ms"]) == (first(ahead < v - 1) * 100.0, first(ahead <= v - 6) * 100.0)


def test_groups_that_batches_cut(spark):
    """A walk gives each group whole, whatever batches its rows come in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(500).selectExpr("id", "concat('k', cast(sqrt(id) as int)) as k", "cast(id % 3 as int) as c")
        got = walk.by_group(rows, ["k", "c"], ["id"], lambda key, r: {"n": [len(r["id"])], "first": [r["id"][0]], "up": [bool((np.diff(r["id"]) > 0).all())]}, "n long, first long, up boolean")
        want = rows.groupBy("k", "c").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.lit(True).alias("up"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("n", "tile"), [(4096, 300), (4095, 64), (3 * 997, 1 << 20), (1009, 200)])
def test_a_transform_over_many_tasks_is_that_of_one(spark, n, tile):
    """Squares, other products, and a prime number of samples; two series of different lengths at a time."""
    x = np.random.default_rng(n).standard_normal(n)
    rows = signal(spark, x).unionByName(signal(spark, x[: n // 3 * 2], 1))
    centres = (62.5, 125.0, 500.0, 2000.0)
    key = lambda df: {(r["channel_index"], r["band_hz"], r["sample_idx"]): r["value"] for r in df.collect()}
    one, many = key(spectral.full_band_rows(rows, centres, 8000.0)), key(spectral.full_band_rows(rows, centres, 8000.0, whole=100, tile=tile))
    assert one.keys() == many.keys() and len(one) == 5 * (n + n // 3 * 2)
    assert np.allclose([one[k] for k in one], [many[k] for k in one], atol=1e-10)


@pytest.mark.parametrize("window", [1, 6, 7, 40, 400])
def test_windows_over_blocks_are_those_over_series(spark, window):
    x = np.random.default_rng(window).standard_normal(333)
    rows = signal(spark, x).unionByName(signal(spark, x[:30], 1)).unionByName(signal(spark, x[:1], 2))
    for channel, own in ((0, x), (1, x[:30]), (2, x[:1])):
        ahead = (window - 1) // 2
        want = [math.sqrt(np.mean(own**2)) if len(own) <= window else math.sqrt((own[max(i + ahead + 1 - window, 0) : i + ahead + 1] ** 2).sum() / window) for i in range(len(own))]
        got = scan.moving_rms(rows.where(F.col("channel_index") == channel), window, block=16).orderBy("sample_idx").collect()
        assert np.allclose([r["envelope"] for r in got], want, atol=1e-12)
    jumps = {r["channel_index"]: (r["jumps"], r["largest"]) for r in panes.differences(rows, 1.0, block=16).collect()}
    d = np.abs(np.diff(x))
    assert jumps == {0: ((d > 1).sum(), d.max()), 1: ((d[:29] > 1).sum(), d[:29].max()), 2: (0, None)}
    held, e, want = scan.peak_hold(rows.where("channel_index = 0"), 0.1, block=16).orderBy("sample_idx").collect(), 0.0, []
    for v in np.abs(x):
        e = max(v, math.exp(-0.1) * e)
        want.append(e)
    assert np.allclose([r["envelope"] for r in held], want, rtol=1e-9)


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200])
def test_percentiles_by_selection_are_exact(spark, scale):
    rng = np.random.default_rng(6)
    groups = {"a": rng.standard_normal(4000), "b": np.round(rng.standard_normal(900) * 3), "c": np.full(50, -2.5), "d": np.array([7.0]), "e": 1e6 + rng.random(500), "f": -np.abs(rng.standard_normal(333))}
    rows = [(k, float(v) * scale) for k, x in groups.items() for v in x] + [("a", None), ("b", float("nan")), ("g", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r["k"]: (r["p"], r["q"]) for r in percentiles(df, ["k"], {"p": F.col("x"), "q": -F.col("x")}, shares).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert np.allclose(got[k][0], np.quantile(x * scale, shares), rtol=1e-12, atol=0)
        assert np.allclose(got[k][1], np.quantile(-x * scale, shares), rtol=1e-12, atol=0)


def test_a_store_shows_whole_versions_only(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder, schema = str(tmp_path / "store"), spark.createDataFrame([], "track_id string, channel_index int, value long").schema
    channels = lambda *c: spark.createDataFrame([("t", i) for i in c], "track_id string, channel_index int")
    rows = lambda v, *c: spark.createDataFrame([("t", i, v) for i in c], schema)
    read = lambda name, version=None: sorted((r["channel_index"], r["value"]) for r in tables.read_version(spark, folder, name, schema, version).collect())
    assert read("levels") == []
    assert tables.commit({"levels": rows(1, 0, 1, 2), "peaks": rows(1, 1)}, channels(0, 1, 2), folder) == 1
    assert tables.commit({"levels": rows(2, 1), "peaks": rows(2)}, channels(1), folder) == 2
    assert read("levels") == [(0, 1), (1, 2), (2, 1)] and read("peaks") == [] and read("peaks", 1) == [(1, 1)]
    (tmp_path / "store" / "data-of-a-dead-writer").mkdir()
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda v: tables.commit({"levels": rows(v, 3), "peaks": rows(v, 3)}, channels(3), folder), range(10, 14)))
    assert sorted(made) == [3, 4, 5, 6]
    last = 10 + made.index(6)
    assert read("levels")[-1] == (3, last) and read("peaks") == [(3, last)] and not list((tmp_path / "store").glob("draft-*"))


def test_cells_keep_the_sign_of_what_rounds_to_zero(spark):
    values = [-0.05, -0.04, -0.01, -0.06, 0.04, -0.0, 0.0, -1.25, None]
    got = [r["c"] for r in spark.createDataFrame([(v,) for v in values], "x double").select(reports.report_cell(F.col("x")).alias("c")).collect()]
    assert got == ["-0.0", "-0.0", "-0.0", "-0.1", "0.0", "0.0", "0.0", "-1.2", "N/A"]


def test_jumps_do_not_depend_on_the_mean(spark, tmp_path):
    """Half of the jumps are 50 but for the last digit of a double, which a mean taken off would decide."""
    v = np.random.default_rng(0).uniform(60, 300, 200)
    v = np.round(np.stack([v, v + 50], 1).ravel(), 2).tolist()
    rows = [(k, 1_700_000_000 + k, "view", x) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "event_id long, t long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = plans.queries()["w13_jumps"](spark, str(tmp_path)).collect()
    assert [r["jumps"] for r in got] == [int((np.abs(np.diff(v)) > 50.0).sum())]


def test_nearest_bands_read_their_metrics_once(spark):
    rows = [("t", c, hz, k) for c in (0, 1) for hz in (2.0, 2.1, 8.0, 16.0) for k in range(3) if (c, hz) != (1, 2.0)]
    held = spark.createDataFrame(rows, "track_id string, channel_index int, band_hz double, window_idx int")
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    got = rollup.nearest_bands(held.mapInPandas(count, held.schema), [2.05, 2.0, 2.0, 8.1, 500.0]).collect()
    assert seen.value == len(rows)
    want = {(0, 2.05, 2.0), (0, 2.0, 2.0), (0, 8.1, 8.0), (1, 2.05, 2.1), (1, 2.0, 2.1), (1, 8.1, 8.0)}
    assert {(r["channel_index"], r["wanted_hz"], r["band_hz"]) for r in got} == want and len(got) == 3 * len(want)


def test_bands_of_blocks_of_several_lengths(spark, monkeypatch):
    """Blocks of one length are transformed together, some at a time; each as by itself."""
    monkeypatch.setattr(spectral, "STRETCH", 200)
    rng, centres = np.random.default_rng(5), [1.0, 4.0, 16.0]
    held = {(c, a): rng.standard_normal(n) for c in range(5) for a, n in ((0, 16), (16, 16), (32, 11 + c % 2))}
    df = spark.createDataFrame([("t", c, a, x.tolist()) for (c, a), x in held.items()], "track_id string, channel_index int, start_sample long, samples array<double>")
    got = {(r["channel_index"], r["band_hz"], r["sample_idx"]): r["value"] for r in spectral.band_rows(df, centres, 64.0).collect()}
    want = {(c, hz, a + i): v for (c, a), x in held.items() for hz, row in zip((0.0, *centres), spectral.bank(x, centres, 64.0), strict=True) for i, v in enumerate(row)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    panes_ = {(r["channel_index"], r["band_hz"], r["pane"]): (r["n"], r["squares"]) for r in spectral.band_panes(df, centres, 64.0, 8).collect()}
    for (c, hz, p), (n, squares) in panes_.items():
        own = [v for (k, b, i), v in want.items() if (k, b, i // 8) == (c, hz, p)]
        assert n == len(own) and abs(squares - sum(v * v for v in own)) < 1e-9


def test_extreme_chunks_are_described_in_their_blocks(spark, monkeypatch):
    """Series of several blocks, with chunks cut by their ends, ties and a silent chunk: as from the bank's rows, but without them."""
    rng, centres = np.random.default_rng(8), [1.0, 4.0, 16.0]
    series_ = [rng.standard_normal(n) * np.repeat(rng.uniform(0.1, 2, n // 16 + 1), 16)[:n] for n in (64, 96, 75, 16)]
    series_.append(np.concatenate([series_[0][:32], np.zeros(16), series_[0][:32]]))
    rows = [("t", c, a, x[a : a + 32].tolist()) for c, x in enumerate(series_) for a in range(0, len(x), 32)]
    df = spark.createDataFrame(rows, "track_id string, channel_index int, start_sample long, samples array<double>")
    keys = ["track_id", "channel_index", "band_hz", "chunk_idx"]
    every = stats.band_statistics(spectral.band_rows(df, centres, 64.0).withColumn("chunk_idx", F.expr("sample_idx div 16")), keys)
    want = {tuple(r[k] for k in keys[1:]): r for r in every.collect()}
    monkeypatch.setattr(spectral, "band_rows", None)
    got = reports.extreme_band_statistics(df, centres, 64.0, 16).collect()
    assert len(got) == 2 * 4 * len(series_)
    columns = [c for c in want[0, 0.0, 0].asDict() if c not in keys]
    for r in got:
        other = want[r["channel_index"], r["band_hz"], r["chunk_idx"]]
        assert all(r[c] is None if other[c] is None else r[c] == pytest.approx(other[c], rel=1e-9, abs=1e-12) for c in columns)
        every = {k[2]: v["crest_factor_db"] and round(v["crest_factor_db"], 9) for k, v in want.items() if k[0] == r["channel_index"] and k[1] == 0}
        order = sorted(every, key=lambda k: (every[k] is not None, every[k] or 0, k) if r["chunk_type"] == "min_chunk" else (every[k] is None, -(every[k] or 0), k))
        assert r["chunk_idx"] == order[0]


def test_tasks_hold_few_results_at_a_time(spark, monkeypatch):
    """What a batch gives is handed on in parts, so a worker's memory doesn't grow with batches."""
    caught = []
    df = spark.createDataFrame([(0, 0.0)], "k long, x double")
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: caught.append(f) or self)
    frame = pd.DataFrame({"k": np.arange(5000) // 2, "x": np.arange(5000.0)})
    work = lambda _, held: {"y": held["x"]}
    walk.by_group(df, ["k"], ["x"], work, "y double")
    walk.by_row(df, ["k"], work, "y double")
    for made in (list(f(iter([frame[:3001], frame[3001:]]))) for f in caught):
        assert max(map(len, made)) <= walk.HELD_ROWS + 1
        out = pd.concat(made)
        assert out["k"].tolist() == frame["k"].tolist() and out["y"].tolist() == frame["x"].tolist()
    blocks = pd.DataFrame({"block_idx": np.arange(3000), "samples": [np.zeros(64)] * 3000})
    cut = list(scan.pieces(iter([blocks]), 7))
    assert max(len(p) * 64 * 7 for p in cut) <= scan.STRETCH and pd.concat(cut)["block_idx"].tolist() == list(range(3000))


def test_summaries_of_blocks_are_those_of_rows(spark, monkeypatch):
    """Series of one block and of several, silence, values out of range; rows are made for the several only."""
    rng, centres = np.random.default_rng(9), [1.0, 4.0, 16.0]
    series_ = [rng.uniform(-1.5, 1.5, 32), rng.standard_normal(80) * 0.01, np.zeros(32), np.linspace(-1, 1, 21)]
    rows = [("t", c, a, x[a : a + 32].tolist()) for c, x in enumerate(series_) for a in range(0, len(x), 32)]
    df = spark.createDataFrame(rows, "track_id string, channel_index int, start_sample long, samples array<double>")
    bank, by = spectral.band_rows(df, centres, 64.0), ["track_id", "channel_index", "band_hz"]
    want = {"bands": stats.band_statistics(bank, by), "linear": stats.linear_histogram(bank, bins=10, keys=by), "log": stats.log_histogram(bank, keys=by)}
    asked, rows_of = [], spectral.band_rows
    monkeypatch.setattr(spectral, "band_rows", lambda b, *a: asked.append(b) or rows_of(b, *a))
    got = reports.band_summaries(df, centres, 64.0, 10)
    assert {r["channel_index"] for b in asked for r in b.collect()} == {1}
    for name, other in want.items():
        at = by if name == "bands" else [*by, "bin"]
        assert sorted(got[name].columns) == sorted(other.columns)
        a, b = ({tuple(r[k] for k in at): r for r in d.collect()} for d in (got[name], other))
        assert a.keys() == b.keys()
        for k, r in a.items():
            for c in other.columns:
                assert r[c] == b[k][c] or r[c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("holes", [False, True])
def test_many_searches_at_once_are_those_one_by_one(holes):
    """Near and far hits, groups without samples, with holes and with samples that come twice."""
    rng = np.random.default_rng(21)
    sizes = [0, 1, 700, 64, 0, 40, 3000]
    held = [(np.sort(rng.choice(3 * n + 9, n, replace=k == 5)) if holes else 7 * k + np.arange(n), np.round(np.cumsum(rng.standard_normal(n)), 1)) for k, n in enumerate(sizes)]
    held[3][1][::9] = np.nan
    own = rng.integers(0, len(sizes), 900)
    start = rng.integers(-20, 3000, 900)
    end, level = start + rng.integers(0, 2500, 900), np.round(rng.standard_normal(900) * 20)
    x = Many(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), np.concatenate([[0], np.cumsum(sizes)]), own)
    one = [Extrema(*h) for h in held]
    a, b = x.between(start, end)
    assert [(p - q, r - q) for p, r, q in zip(a.tolist(), b.tolist(), x.low.tolist(), strict=True)] == [one[g].between(s, e) for g, s, e in zip(own.tolist(), start.tolist(), end.tolist(), strict=True)]
    for test in ("at most", "below", "at least"):
        for many, single in ((x.first, Extrema.first), (x.last, Extrema.last)):
            got = [i if there else None for i, there in zip(*(c.tolist() for c in many(start, end, level, test)), strict=True)]
            assert got == [single(one[g], s, e, v, test) for g, s, e, v in zip(own.tolist(), start.tolist(), end.tolist(), level.tolist(), strict=True)]


@pytest.mark.parametrize(("n", "distance"), [(0, 3), (1, 3), (400, 2), (400, 9), (4000, 500)])
def test_peaks_are_suppressed_as_one_by_one(n, distance):
    rng = np.random.default_rng(22)
    for db in (rng.integers(-9, 0, n).astype(float), np.arange(n, dtype=float), np.zeros(n)):
        idx, keep = np.cumsum(rng.integers(2, 6, n)), np.ones(n, bool)
        for i in np.lexsort((-idx, -db)):
            if keep[i]:
                keep[(np.abs(idx - idx[i]) < distance) & (np.arange(n) != i)] = False
        assert peaks.suppress(idx, db, distance).tolist() == keep.tolist()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_patterns_of_many_series_are_those_of_each(least):
    """Constant windows, windows of other lengths, series without windows, and more alike than there may be groups."""
    rng = np.random.default_rng(23)
    shapes = [np.sin(np.arange(n) / k) for n in (4, 7, 8) for k in (1, 2, 5)] + [np.full(4, 1.0), np.full(7, 1.0), np.full(1, 2.0)]
    series_ = [[shapes[k] * rng.uniform(0.5, 2) + rng.normal(0, 0.05, len(shapes[k])) * (k < 9) for k in rng.integers(0, len(shapes), n)] for n in (0, 1, 2, 5, 17, patterns.FEW, 3)]
    flat, cuts = [w for s in series_ for w in s], np.concatenate([[0], np.cumsum([len(s) for s in series_])])
    windows = np.empty(len(flat), object)
    windows[:] = flat
    i, j, same = patterns.pairs_of_many(windows, cuts, 0.8)
    want, members = set(), []
    for g, held in enumerate(series_):
        a, b, like, _ = patterns.alike_pairs(held, 0.8)
        edges = [(int(p), int(q), bool(s)) for p, q, s in zip(a, b, like, strict=True)]
        want |= {(cuts[g] + p, cuts[g] + q, s) for p, q, s in edges}
        found = patterns.greedy_groups(len(held), edges, dict(enumerate(map(len, held))), least)
        members += [(g, k, cuts[g] + n) for k, one in enumerate(sorted(found, key=len, reverse=True)[:3], 1) for n in one]
    assert set(zip(i.tolist(), j.tolist(), same.tolist(), strict=True)) == want and len(i) == len(want) > 20
    got = patterns.groups_of_many(np.array([len(w) for w in flat]), cuts, (i, j, same), least, 3)
    assert list(zip(*(c.tolist() for c in got), strict=True)) == members


def test_series_of_one_block_stay_where_they_are(spark):
    """Their peaks need no shuffle, and whatever is made of them is that of blocks which are not marked."""
    rng, centres = np.random.default_rng(24), [1.0, 4.0, 16.0]
    x = [rng.standard_normal(n) for n in (64, 64, 30, 150, 64)]
    held = [("t", c, k, 64 * k, v[64 * k : 64 * k + 64].tolist()) for c, v in enumerate(x) for k in range(-(-len(v) // 64))]
    df = spark.createDataFrame(held, "track_id string, channel_index int, block_idx long, start_sample long, samples array<double>")
    levels = scan.band_envelopes(df, centres, 64.0, digits=4)
    plain = {(r["channel_index"], r["band_hz"], r["start_sample"]): r for r in levels.collect()}
    assert {k[0] for k, r in plain.items() if r["whole"]} == {0, 1, 2, 4} and len(plain) == 4 * len(held)
    for (c, hz, a), r in plain.items():
        keep, e, want = math.exp(-1 / scan.release_samples(hz, 64.0)), 0.0, []
        for v in np.abs(np.concatenate([spectral.bank(x[c][k : k + 64], centres, 64.0)[[0.0, *centres].index(hz)] for k in range(0, len(x[c]), 64)])):
            e = max(v, e * keep + v * (1 - keep))
            want.append(20 * math.log10(max(e, 1e-10) + 1e-10))
        assert np.allclose(r["levels"], want[a : a + 64], atol=1e-4)
    marked, keys = spark.createDataFrame(plain.values(), levels.schema), (*peaks.KEYS, "band_hz")
    assert "Exchange" not in peaks._lone(marked.where("whole"), list(keys), -30.0, 3)._jdf.queryExecution().executedPlan().toString()
    said = [reports.envelope_analysis(m, 64.0, -30.0, 3, {0.0: 12, 1.0: 32, 4.0: 16, 16.0: 8}, keys, 0.8, 2, 4, 2, -18.0, 0.25) for m in (marked, marked.drop("whole"))]
    for name in ("peaks", "patterns", "worst_cases", "sustained", "sustained_summary"):
        a, b = (sorted(map(repr, found[name].collect())) for found in said)
        assert a == b and len(a) > 5


@pytest.mark.parametrize("short", [0, 400, 10_000])
def test_percentiles_of_short_groups_are_exact(spark, short):
    rng = np.random.default_rng(25)
    groups = {"a": rng.standard_normal(4000), "b": np.round(rng.standard_normal(900) * 3), "c": np.full(50, -2.5), "d": np.array([7.0]), "f": -np.abs(rng.standard_normal(333))}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("b", float("nan")), ("c", float("nan")), ("d", None), ("g", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    values = {"p": F.col("x"), "q": F.when(F.col("k") != "c", -F.col("x"))}
    got = {r["k"]: (r["p"], r["q"]) for r in percentiles_of_short(df, ["k"], values, shares, short).collect()}
    assert got.keys() == groups.keys() and got["c"][1] is None
    for k, x in groups.items():
        assert np.allclose(got[k][0], np.quantile(x, shares), rtol=1e-12, atol=0)
        assert k == "c" or np.allclose(got[k][1], np.quantile(-x, shares), rtol=1e-12, atol=0)


def test_a_histogram_adds_up_its_counts_once_a_series(spark):
    """The sum over all bins stands below the step that makes a row a bin."""
    df = spark.createDataFrame([(0, [1, 0, 3]), (0, [1, 1, 0]), (1, [0, 0, 0])], "k int, c array<long>")
    made = stats.histogram_of_counts(df, "c", 0.0, 3.0, 3, ["k"])
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [next(i for i, line in enumerate(plan) if what in line) for what in ("Generate", "aggregate(")]
    assert at[0] < at[1] and sum("aggregate(" in line for line in plan) == 1
    got = {(r["k"], r["bin"]): (r["bin_count"], r["bin_density"]) for r in made.collect()}
    assert got == {(0, 0): (2, 2 / 6), (0, 1): (1, 1 / 6), (0, 2): (3, 0.5), **{(1, b): (0, 0.0) for b in range(3)}}


def test_columns_of_arrays_are_handed_on_whole(spark):
    """Arrays of several lengths, empty and missing ones, NaN as null, and groups that batches and stretches cut."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(60).selectExpr("concat('k', id % 9) as k", "id", "transform(sequence(0, cast(id % 4 as int)), x -> cast(if(x = 2, double('NaN'), x) as double)) as x")

        def work(held, cuts):
            n = walk.lengths_of(held["x"])
            first, there = held["id"], held["id"] % 5 != 0
            return np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), {"id": first, "half": np.where(there, first / 2, np.nan), "x": walk.Lists(np.concatenate(list(held["x"][there])), np.where(there, n, 0), there)}

        got = walk.by_stretch(rows, ["k"], ["id"], work, "id int, half double, x array<double>", heavy="x").collect()
        assert sorted((r["k"], r["id"], r["half"], r["x"]) for r in got) == [(f"k{i % 9}", i, i / 2 if i % 5 else None, [None if v == 2 else float(v) for v in range(i % 4 + 1)] if i % 5 else None) for i in sorted(range(60), key=lambda i: (f"k{i % 9}", i))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(walk.stretches(np.array([walk.STRETCH + 1, 5, 5, walk.STRETCH]), np.array([0, 1, 2, 3, 4]))) == [(0, 1), (1, 3), (3, 4)]


def test_a_worst_case_without_half_of_its_window_has_none(spark):
    db = [-1.0 if i in (1, 30) else -40.0 for i in range(60)]
    levels = spark.createDataFrame([("t", 0, 0, db, True), ("t", 1, 0, db[:32], False), ("t", 1, 32, db[32:], False)], "track_id string, channel_index int, start_sample long, levels array<double>, whole boolean")
    found = peaks.find_peaks(levels, -20.0, 2)
    got = {(r["channel_index"], r["peak_idx"]): (r["start_idx"], r["window"]) for r in peaks.worst_case(found, levels, 1.0, window=40).collect()}
    assert got == {(c, i): w for c in (0, 1) for i, w in ((1, (0, db[:21])), (30, (10, db[10:50])))}
    wide = {(r["channel_index"], r["peak_idx"]): r["window"] for r in peaks.worst_case(found, levels, 1.0, window=70).collect()}
    assert wide[0, 1] == db[:36] and wide[1, 30] == db
    none = peaks.worst_case(found, levels, 1.0, window=122).collect()
    assert len(none) == 4 and all(r["window"] is None and r["start_idx"] is None and r["rank"] and r["decay_3db_ms"] == 1000.0 for r in none)
    assert peaks.windows_around(found, levels, 122).count() == 0


def test_a_section_that_fails_is_an_error(spark, tmp_path):
    good = spark.createDataFrame([("t", 0)], "track_id string, channel_index int")
    names = [n for n in tables.SECTIONS if n != "time_domain_summary"]
    assert tables.write_sections({n: good for n in reversed(names)}, f"{tmp_path}/a") == names
    assert all(spark.read.csv(f"{tmp_path}/a/{n}", header=True).count() == 1 for n in names)
    with pytest.raises(Exception, match="no such thing"):
        tables.write_sections({"track_metadata": good, "time_domain_summary": good.select(F.raise_error(F.lit("no such thing")).cast("string").alias("x"))}, f"{tmp_path}/b")


def test_stored_events_are_summed_up_as_others_are(spark, monkeypatch):
    """Series of no, few and many events; the many are selected from."""
    rng, names = np.random.default_rng(26), ("hold_ms", "t3_ms")
    monkeypatch.setattr(peaks, "percentiles_of_short", lambda *a: percentiles_of_short(*a, short=20))
    events = spark.createDataFrame([("t", c, float(rng.integers(0, 9)), None if k % 4 else float(rng.random())) for c, n in enumerate((0, 1, 7, 90)) for k in range(n)], "track_id string, channel_index int, hold_ms double, t3_ms double")
    series_ = spark.createDataFrame([("t", c) for c in range(4)], "track_id string, channel_index int")
    one, other = (sorted(peaks.sustained_summary(events, series_, names, stored=s).collect()) for s in (False, True))
    assert [r["n_peaks"] for r in other] == [0, 1, 7, 90]
    for a, b in zip(one, other, strict=True):
        assert all(b[c] == a[c] if isinstance(a[c], str) else b[c] == pytest.approx(a[c], rel=1e-12) for c in a.asDict())
