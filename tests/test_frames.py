"""Golden values of the rules, and geometry on synthetic frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panoquery.functions import scalar
from panoquery.operators import folds, geometry, kernels, knn, pairs, pixels, stats, windows
from panoquery.plans import mosaic
from panoquery.sources import images, sinks, tables


def one(df):
    return tuple(df.first())


def test_windows(spark):
    for n, want in ((10, [(0, 4), (4, 8), (8, 10)]), (9, [(0, 4), (4, 8)]), (1, []), (0, [])):
        df = windows.window_ranges(windows.windowed(windows.positions(spark.range(0, 3 * n, 3).toDF("k"), "k")))
        assert sorted((r.img_start, r.img_end) for r in df.collect()) == want


def test_slice(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    at = lambda a, b: sorted(r.pos for r in windows.sliced(df, a, b).collect())
    assert at(-4, None) == [6, 7, 8, 9] and at(2, -3) == [2, 3, 4, 5, 6] and at(-99, 2) == [0, 1] and at(None, None) == list(range(10))


def runs(spark, rows):
    return spark.createDataFrame(rows, "name string, secs double")


def test_intervals(spark):
    got = {r.name: r for r in stats.phase_stats(runs(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("c", None), ("c", 1.0)]), "name").collect()}
    assert (got["a"].mean, got["a"].std) == (2, 1) and got["a"].margin == pytest.approx(2.484338, abs=1e-6)
    assert (got["b"].mean, got["b"].std, got["b"].margin) == (2, 0, 0)
    assert got["c"].mean is None and got["c"].margin is None


@pytest.mark.parametrize("base, cand, want", [([10, 11, 12], [5, 5.5, 6], (2.0, 1.361203, 2.638797)), ([10, 11, 12], [5, 6], (2.0, -0.667568, 4.667568)), ([1, 2], [0, 0], (0, 0, 0))])
def test_speedup(spark, base, cand, want):
    s = stats.phase_stats(runs(spark, [("base", float(x)) for x in base] + [("cand", float(x)) for x in cand]).withColumn("k", F.lit(1)), "k", "name")
    assert one(stats.against_baseline(s, "base", "name", "k").select("speedup", "ci_lower", "ci_upper")) == pytest.approx(want, abs=1e-6)


def test_aggregate_speedup(spark):
    df = spark.createDataFrame([("a", 10.0, 5.0), ("a", 20.0, None), ("b", 1.0, None), ("c", 1.0, 0.0)], "k string, base double, cand double")
    assert {r.k: r.speedup for r in stats.aggregate_speedup(df, "k").collect()} == {"a": 2.0, "b": None, "c": None}


def test_t_critical(spark):
    df = spark.createDataFrame([(2,), (11,), (12,), (500,)], "n long").select(scalar.t_critical(F.col("n")))
    assert [r[0] for r in df.collect()] == [12.706, 2.228, 2.0, 2.0]


def test_pixels(spark):
    df = spark.createDataFrame([([10, 255, 7, 0, 0, 0, 5, 6, 7, 1, 0, 0], [13, 254, 0, 9, 9, 9, 0, 0, 0, 0, 0, 2])], "a array<int>, b array<int>")
    assert one(df.select(pixels.blended(F.col("a"), F.col("b"))))[0] == [11, 254, 3, 9, 9, 9, 5, 6, 7, 0, 0, 1]
    verdicts = [(0, None, "Bit-identical"), (1, 48.0, "Numerically equivalent"), (2, 45.0, "Visually identical"), (2, 40.0, "Different")]
    for m, p, want in verdicts:
        assert one(spark.range(1).select(scalar.pixel_verdict(F.lit(m), F.lit(p).cast("double"))))[0] == want
    for mse, want in ((1.0, 48.1308), (6.5, 40.0017), (6.6, 39.9354), (0.0, None)):
        assert one(spark.range(1).select(F.round(scalar.psnr(F.lit(mse)), 4)))[0] == want


def test_tiles_do_not_matter(spark):
    rng = np.random.default_rng(0)
    rows = [(k, *(rng.integers(0, 3, 10 * 2 * 3).tolist() for _ in "ab")) for k in range(3)]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    want = {r.k: r.p for r in df.select("k", pixels.blended(F.col("a"), F.col("b")).alias("p")).collect()}
    for workers in (1, 3, 4, 8, 10):
        assert {r.k: r.pixels for r in pixels.blended_tiles(df, ["k"], 10, workers).collect()} == want


def test_shape_mismatch(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 2, 3, 4, 5, 6])], "k int, a array<int>, b array<int>")
    r = pixels.compared(df, ["k"]).first()
    assert r.verdict == "Shape mismatch" and r.shape_match is False and r.mean_pixel_diff is None


def test_canvas(spark):
    df = spark.createDataFrame([(200, 100, 200, 100)], "w1 int, h1 int, w2 int, h2 int")
    h = lambda *x: [F.lit(float(v)) for v in x]
    r = geometry.canvas(df, h(1, 0, 50.4, 0, 1, -10.2, 0, 0, 1)).first()
    assert (r.x_min, r.x_max, r.y_min, r.y_max, r.fits) == (0, 250, -10, 100, True)
    assert geometry.canvas(df, h(10, 0, 0, 0, 10, 0, 0, 0, 1)).first().fits is False
    assert geometry.canvas(df, h(1, 0, 0, 0, 1, 0, 0, 0, 0)).first().fits is False
    big = spark.createDataFrame([(65536, 65536, 1, 1)], "w1 int, h1 int, w2 int, h2 int")
    assert geometry.canvas(big, h(1, 0, 0, 0, 1, 0, 0, 0, 1)).first().fits is True
    assert kernels.canvas((100, 200), (100, 200), np.array([[1, 0, 50.4], [0, 1, -10.2], [0, 0, 1]])) == (0, -10, 250, 100)
    assert kernels.canvas((100, 200), (100, 200), np.diag([10.0, 10.0, 1.0])) is None


@pytest.mark.parametrize("edges, want", [({(0, 1): 20, (0, 2): 3, (0, 3): 0, (1, 2): 30, (1, 3): 16, (2, 3): 15}, [1, 2, 0, 3]), ({(0, 1): 20, (2, 3): 25}, [2, 3, 0, 1]), ({}, [0, 1, 2, 3])])
def test_hub_order(spark, edges, want):
    frames = spark.range(4).select(F.lit(0).cast("long").alias("win_idx"), F.col("id").alias("local_idx"))
    rows = [(0, i, j, 99, edges.get((i, j), 0)) for i in range(4) for j in range(i + 1, 4)]
    p = pairs.gated(spark.createDataFrame(rows + rows[:1], "win_idx long, i long, j long, num_matches long, num_inliers long"))
    assert [r.local_idx for r in pairs.hub_order(frames, p).orderBy("ord").collect()] == want


@pytest.mark.parametrize("passing, want", [([], "EMPTY"), ([(1, 2)], "PARTIAL"), ([(0, 3)], "CONNECTED")])
def test_verdict(spark, passing, want):
    rows = [(0, i, j, 99, 15 if (i, j) in passing else 14) for i in range(4) for j in range(i + 1, 4)]
    p = pairs.gated(spark.createDataFrame(rows, "win_idx long, i long, j long, num_matches long, num_inliers long"))
    assert pairs.verdicts(p).first().verdict == want
    assert pairs.gated(spark.createDataFrame([(0, 0, 1, 3, 99)], "win_idx long, i long, j long, num_matches long, num_inliers long")).first().passes is False


def test_names(spark):
    assert one(spark.range(1).select(scalar.ordered_name(F.lit(7), F.lit("a/X.JPG")), scalar.ordered_name(F.lit(12345), F.lit("b.png")), scalar.core_count(F.lit("benchmark_8c_4s")))) == ("0007.jpg", "12345.png", 8)
    with pytest.raises(Exception, match="no core count"):
        spark.range(1).select(scalar.core_count(F.lit("results"))).collect()


def test_folds(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 100, 2, 3, 4])] + [(1, 0, 7)], "w long, o long, v long")
    near = lambda a, b: F.abs(a - b) < 50
    got = {r.w: (r.n_frames, r.n_merged, r.acc) for r in folds.linear_fold(df, "w", "o", "v", near, lambda a, b: a + b).collect()}
    assert got == {0: (5, 4, 10), 1: (1, 1, 7)}
    got = {r.w: (r.n_merged, r.acc) for r in folds.tree_fold(df, "w", "o", "v", near, lambda a, b: a + b, 5).collect()}
    assert got == {0: (4, 10), 1: (1, 7)}  # 100 is lost at the first level, 4 goes up alone


def test_knn(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(50, 5))
    y[7] = y[3]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, v array<double>")
    got = {(r.query_id, r["rank"]): r.train_id for r in knn.knn_join(q, t, 2, query_block=8, train_block=16).collect()}
    for i, v in enumerate(x):
        order = sorted(range(50), key=lambda j: (np.sqrt(((v - y[j]) ** 2).sum()), j))
        assert [got[i, 1], got[i, 2]] == order[:2]
    assert knn.knn_join(q, t.where("id < 0")).count() == 0


def test_geometry_is_recovered():
    rng = np.random.default_rng(3)
    whole = kernels.resized(rng.integers(1, 255, (50, 70, 3)).astype(np.uint8), 200, 280)
    a, b = whole[20:150, 10:160], whole[35:165, 61:211]
    fa, fb = kernels.features(a), kernels.features(b)
    m = kernels.matches(fa[1], fb[1])
    h, inliers = kernels.robust(fa[0][m[:, 0], :2].astype(float), fb[0][m[:, 1], :2].astype(float), 1)
    corners = np.array([[0, 0], [150, 0], [150, 130], [0, 130]], float)
    assert inliers >= 15 and np.abs(kernels.applied(h, corners) - (corners + [51, 15])).max() < 1
    flat = np.eye(3)
    flat[:2, 2] = 51, 15
    one_strip = kernels.warped(a, b, flat)
    assert one_strip.shape == (145, 201, 3) and np.array_equal(one_strip[:130, :51], a[:, :51])
    for strips in (2, 4, 7, 300):
        assert np.array_equal(kernels.warped(a, b, flat, strips), one_strip)
    assert np.array_equal(kernels.warped(a, a, np.eye(3)), a)
    assert len(kernels.features(np.zeros((40, 40, 3), np.uint8))[0]) == 0 and len(kernels.matches(fa[1][:1], fb[1])) == 0


def test_mosaics(spark):
    f = mosaic.extract(mosaic.synthetic(spark, windows=2)).cache()
    for out in (mosaic.linear(f), mosaic.tree(f)):
        assert sorted((r.win_idx, r.height, r.width, r.n_merged) for r in out.collect()) == [(0, 96, 272, 4), (1, 96, 272, 4)]
    five = mosaic.tree(mosaic.extract(mosaic.synthetic(spark, windows=1, size=5, step=30)), 5).first()
    assert (five.n_frames, five.n_merged) == (5, 5)
    swapped = f.where("win_idx = 0 or local_idx = 0").withColumn("local_idx", F.when(F.col("win_idx") == 1, -1).otherwise(F.col("local_idx"))).withColumn("pos", F.col("local_idx")).withColumn("win_idx", F.lit(0).cast("long"))
    first = mosaic.linear(swapped).first()  # a foreign first frame: all others are skipped, it stays
    assert (first.n_frames, first.n_merged, first.width) == (5, 1, 128) and "too few" in first.error
    scores = pairs.verdicts(mosaic.pair_scores(f))
    assert {r.verdict for r in scores.collect()} == {"CONNECTED"}
    f.unpersist()


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 255, (20, 30, 3)).astype(np.uint8) for _ in range(6)]
    for i, x in enumerate(frames):
        (tmp_path / f"f{i}.{'PNG' if i % 2 else 'png'}").write_bytes(sinks.png(x))
    (tmp_path / "f2.png").write_bytes(b"broken")
    (tmp_path / "notes.txt").write_text("x")
    got = sorted(images.load(spark, str(tmp_path), 0, None, 4, half=False).collect(), key=lambda r: r.pos)
    assert [(r.pos, r.win_idx, r.local_idx) for r in got] == [(0, 0, 0), (1, 0, 1), (3, 0, 3), (4, 1, 0), (5, 1, 1)]
    assert all(bytes(r.data) == frames[r.pos].tobytes() for r in got)
    half = images.load(spark, str(tmp_path), -1, None).first()
    assert (half.height, half.width) == (10, 15)
    x = frames[5].astype(float)
    mean = (x[0::2, 0::2] + x[1::2, 0::2] + x[0::2, 1::2] + x[1::2, 1::2]) / 4
    assert np.abs(np.frombuffer(half.data, np.uint8).reshape(10, 15, 3) - mean).max() <= 0.5
    out = tmp_path / "out"
    sinks.write_png(images.load(spark, str(tmp_path), 0, 2, half=False).withColumn("name", F.format_string("%04d.png", "pos")), str(out))
    assert (out / "0000.png").read_bytes() == sinks.png(frames[0]) and (out / "0001.png").exists()
    sinks.copy_ordered(spark.createDataFrame([(str(tmp_path / "f0.png"), "0003.png")], "src_path string, dest_name string"), str(tmp_path / "again"))
    assert (tmp_path / "again/0003.png").read_bytes() == sinks.png(frames[0])


def test_csv_tables(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 4, 0, 1, 0, 1, 9, 20, "True"), (0, 0, 4, 0, 2, 0, 2, 9, 3, "False")], "window_idx int, img_start int, img_end int, local_i int, local_j int, global_i int, global_j int, num_matches int, num_inliers int, passes_threshold string")
    for run in ("r1", "r2"):
        sinks.append_csv(rows, str(tmp_path / "pairs"), run)
    got = tables.pairs(spark, str(tmp_path / "pairs"), run_id=True).collect()
    assert sorted((r.i, r.j, r.passes) for r in got) == [(0, 1, True), (0, 2, False)]
    head = "window_idx,img_start,img_end,baseline,candidate,phase,baseline_mean_s,baseline_std_s,baseline_margin_s,candidate_mean_s,candidate_std_s,candidate_margin_s,speedup,ci_lower,ci_upper\n"
    (tmp_path / "benchmark_2c_4s.csv").write_text(head + "0,0,4,sequential,parallel,total,4,0,0,2,0,0,2,2,2\n0,0,4,sequential,parallel,extract,n/a,n/a,n/a,1,0,0,n/a,n/a,n/a\n")
    (tmp_path / "benchmark_8c_4s.csv").write_text(head + "0,0,4,sequential,parallel,total,4,0,0,1,0,0,4,4,4\n")
    got = tables.scaling(spark, str(tmp_path / "benchmark_*.csv"))
    assert sorted((r.cores, r.phase, r.baseline_mean_s) for r in got.collect() if r.phase == "total") == [(2, "total", 4.0), (8, "total", 4.0)]
    assert got.where("phase = 'extract'").first().baseline_mean_s is None
    assert math.isclose(one(stats.aggregate_speedup(got.select("cores", F.col("baseline_mean_s").alias("base"), F.col("candidate_mean_s").alias("cand")), "cores").where("cores = 8"))[1], 4.0)


def test_benchmark_driver(spark, tmp_path):
    """Windows x pipelines x runs: failures stay in their window, tables read back as they were written."""
    from panoquery.plans import benchmarks, mosaic, reports
    from panoquery.sources import sinks, tables

    def broken(nodes, win, clock):
        if win == 1:
            raise ValueError("no such window")
        return benchmarks.tree_run(nodes, win, clock)

    frames = mosaic.synthetic(spark, windows=2, size=3)
    lone = spark.createDataFrame([("x", 100, 50, 0, 1, 1, b"abc")], "origin string, pos long, win_idx long, local_idx long, height int, width int, data binary")
    pipelines = {k: benchmarks.PIPELINES[k] for k in ("sequential", "parallel")} | {"broken": broken}
    benchmarks.timed_runs(frames.unionByName(lone), pipelines, n_runs=2, warm_ups=1).write.parquet(f"{tmp_path}/runs")
    runs = spark.read.parquet(f"{tmp_path}/runs")
    got = {(r.win_idx, r.pipeline, r.run): r for r in runs.collect()}
    assert set(got) == {(w, p, k) for w in (0, 1) for p in pipelines for k in (0, 1)} - {(1, "broken", 0), (1, "broken", 1)} | {(1, "broken", -1)}
    assert "no such window" in got[1, "broken", -1].error and [r.failed for r in benchmarks.failures(runs).collect()] == [1]
    assert all(r.total >= r.extract + r.match + r.homo + r.warp + r.reext > 0 for k, r in got.items() if k[2] >= 0)
    sinks.append_csv(benchmarks.timing_rows(runs), f"{tmp_path}/timing")
    timing = tables.benchmark(spark, f"{tmp_path}/timing")
    rows = {(r.window_idx, r.candidate, r.phase): r for r in timing.collect()}
    assert set(rows) == {(w, c, p) for w, c in ((0, "parallel"), (0, "broken"), (1, "parallel")) for p in ("extract", "match", "homo", "warp", "reext", "total")}
    one = rows[0, "parallel", "total"]
    want = [np.mean([got[0, p, k].total for k in (0, 1)]) for p in ("sequential", "parallel")]
    assert one.baseline_mean_s == pytest.approx(want[0], abs=1e-6) and one.speedup == pytest.approx(want[0] / want[1], abs=1e-4) and (one.img_start, one.img_end) == (0, 3)
    found = benchmarks.differences(runs)
    sinks.append_csv(benchmarks.correctness_rows(found), f"{tmp_path}/correct")
    same = {(r.window_idx, r.candidate): r for r in tables.correctness(spark, f"{tmp_path}/correct").collect()}
    assert set(same) == {(0, "parallel"), (0, "broken"), (1, "parallel")} and (same[0, "parallel"].verdict, same[0, "parallel"].psnr_db) == ("Bit-identical", "inf")
    pivot = {r.strategy: r.total for r in reports.average_rows(timing).collect()}
    assert set(pivot) == set(pipelines) and [r.candidate for r in reports.names(timing, timing).collect()] == ["broken", "parallel"]
    totals = {r.pipeline: r for r in benchmarks.phase_totals(runs).collect()}
    t = totals["parallel"]
    assert t.stitch == pytest.approx(t.match + t.homo + t.warp + t.reext) and t.total == pytest.approx(sum(got[w, "parallel", k].total for w in (0, 1) for k in (0, 1)))


def test_not_measured(spark):
    from panoquery.plans import benchmarks

    rows = [(0, 0, 4, 4, 100.0, p, k, 1.0 + k, None if p == "a" else 2.0, 1.0, 1.0, 1.0, 6.0 + k, None, None, None, None) for p in ("sequential", "a") for k in (0, 1)]
    got = {r.phase: r for r in benchmarks.timing_rows(spark.createDataFrame(rows, benchmarks.RUNS)).collect()}
    assert (got["match"].baseline_mean_s, got["match"].candidate_mean_s, got["match"].speedup) == ("2.0", "n/a", "n/a") and got["total"].speedup == "1.0"
    shapes = spark.createDataFrame([(0, 0, 4, 4, 1.0, p, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None, 1, w, bytes(3 * w)) for p, w in (("sequential", 1), ("a", 2))], benchmarks.RUNS)
    row = benchmarks.correctness_rows(benchmarks.differences(shapes)).first()
    assert (row.shape_match, row.verdict, row.psnr_db, row.max_pixel_diff) == (False, "Shape mismatch", None, None)
    assert [r.pipeline for r in benchmarks.oversized(shapes.withColumn("mean_area", F.lit(0.15))).collect()] == ["a"]


def test_command_line(spark, tmp_path, capsys):
    """Files in, tables and files out: diagnosis, reordering, mosaics."""
    from panoquery.__main__ import main
    from panoquery.plans import mosaic
    from panoquery.sources import sinks, tables

    frames = mosaic.synthetic(spark, windows=1, size=4, height=192, width=256, step=96)
    sinks.write_png(frames.select(F.format_string("f%02d.png", "pos").alias("name"), "height", "width", "data"), f"{tmp_path}/in")
    main(["diagnose", f"{tmp_path}/in", "--out", f"{tmp_path}/out"], spark)
    assert "WINDOW 0 [images 0:4] (4 images)" in capsys.readouterr().out
    assert tables.summary(spark, f"{tmp_path}/out/window_diagnostics_summary").count() == 1 and tables.pairs(spark, f"{tmp_path}/out/window_diagnostics_pairs").count() == 6
    main(["reorder", f"{tmp_path}/in", "--pairs", f"{tmp_path}/out/window_diagnostics_pairs", "--out", f"{tmp_path}/ordered"], spark)
    assert sorted(p.name for p in (tmp_path / "ordered").iterdir()) == [f"{k:04d}.png" for k in range(4)]
    main(["stitch", f"{tmp_path}/in", "--out", f"{tmp_path}/made"], spark)
    assert [p.name for p in (tmp_path / "made").iterdir()] == ["window_0.png"]


def test_positions_of_far_keys(spark):
    """One key far from the others doesn't put the rest into one range; a null raises."""
    df = spark.createDataFrame([(k,) for k in [*range(0, 3000, 3), 10**15]], "id long")
    got = {r.id: r.pos for r in windows.positions(df, "id").collect()}
    assert got == {k: i for i, k in enumerate([*range(0, 3000, 3), 10**15])}
    sizes = [r["count"] for r in windows.Bucketizer(splits=[-math.inf, *sorted(set(df.approxQuantile("id", [k / 16 for k in range(1, 16)], 1 / 64))), math.inf], inputCol="id", outputCol="b").transform(df).groupBy("b").count().collect()]
    assert max(sizes) < 200
    with pytest.raises(Exception, match="(?i)null|NaN"):
        windows.positions(df.unionByName(spark.createDataFrame([(None,)], "id long")), "id").collect()


def test_last_run(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 4, 4, 6, 2, "PARTIAL")], tables.SUMMARY_CSV)
    for run in ("r10", "r9"):
        sinks.append_csv(rows.withColumn("passing_pairs", F.lit(len(run))), f"{tmp_path}/s", run)
    assert [r.passing_pairs for r in tables.read(spark, f"{tmp_path}/s", tables.SUMMARY_CSV, True).collect()] == [2]
    assert [r.run for r in tables.latest(spark.createDataFrame([(1, "r9"), (2, "r10")], "run int, run_id string")).collect()] == [2]
