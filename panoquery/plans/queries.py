"""Registered queries of the engine and their DuckDB twins.

There are no image files among the tables, so frames are stood in for by embeddings: a row is a frame, vec_id its place
in the sequence, its 64 components are values. The inliers of a pair are components that differ by less than TAU; matches
by less than twice that. As pixels the components are bytes: 8 x 8 gray, or the first 63 as 21 BGR pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panoquery.functions import scalar
from panoquery.operators import folds, geometry, knn, pairs, pixels, stats, windows
from panoquery.plans import benchmarks, mosaic, reports
from panoquery.streaming import ordered

TAU = 0.04
QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL twin."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return windows.windowed(windows.positions(rows, "vec_id"))


def close(a, b, tau):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y) < tau), lambda x: x)).cast("long")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs.window_pairs(frames(spark, sf), "v")
    return pairs.gated(p.select("win_idx", "i", "j", close(F.col("v_i"), F.col("v_j"), 2 * TAU).alias("num_matches"), close(F.col("v_i"), F.col("v_j"), TAU).alias("num_inliers")))


def pixel_frames(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return frames(spark, sf).select("vec_id", "win_idx", "local_idx", pixels.quantised(F.slice("v", 1, n)).alias("px"))


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Frame 2k beside frame 2k+1."""
    p = pixel_frames(spark, sf, 63)
    side = lambda s: p.where(F.col("local_idx") % 2 == s)
    a = side(0).select("win_idx", F.expr("local_idx div 2").alias("half"), "vec_id", F.col("px").alias("a"))
    return a.join(side(1).select("win_idx", F.expr("local_idx div 2").alias("half"), F.col("px").alias("b")), ["win_idx", "half"]).select("vec_id", "a", "b")


FRAMES = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings), f AS (SELECT *, pos // 4 AS win_idx, pos % 4 AS local_idx FROM e)"
NEAR = lambda tau: f"CAST(len(list_filter(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]) < {tau})) AS BIGINT)"
SCORED = f"{FRAMES}, p AS (SELECT a.win_idx, a.local_idx AS i, b.local_idx AS j, {NEAR(2 * TAU)} AS num_matches, {NEAR(TAU)} AS num_inliers FROM f a JOIN f b ON a.win_idx = b.win_idx AND a.local_idx < b.local_idx), g AS (SELECT *, num_matches >= 4 AND num_inliers >= 15 AS passes FROM p)"
VERDICTS = f"{SCORED}, w AS (SELECT win_idx, count(*) AS total_pairs, count(*) FILTER (WHERE passes) AS passing_pairs, CASE WHEN count(*) FILTER (WHERE passes) = 0 THEN 'EMPTY' WHEN bool_or(passes AND i = 0) THEN 'CONNECTED' ELSE 'PARTIAL' END AS verdict FROM g GROUP BY win_idx)"
BOTH = "both_ways AS (SELECT win_idx, i AS a, j AS b, num_inliers, passes FROM g UNION ALL SELECT win_idx, j, i, num_inliers, passes FROM g)"
HUB = f"""{SCORED}, {BOTH}, r AS (SELECT win_idx, a AS local_idx, count(*) FILTER (WHERE passes) AS degree, CAST(sum(num_inliers) AS BIGINT) AS inliers FROM both_ways GROUP BY 1, 2),
n AS (SELECT f.win_idx, f.local_idx, coalesce(degree, 0) AS degree, coalesce(inliers, 0) AS inliers FROM f LEFT JOIN r ON f.win_idx = r.win_idx AND f.local_idx = r.local_idx),
x AS (SELECT *, first_value(local_idx) OVER (PARTITION BY win_idx ORDER BY degree DESC, inliers DESC, local_idx) AS anchor FROM n),
o AS (SELECT x.*, row_number() OVER (PARTITION BY x.win_idx ORDER BY (x.local_idx = x.anchor) DESC, coalesce(t.num_inliers, 0) DESC, x.local_idx) - 1 AS ord FROM x LEFT JOIN both_ways t ON t.win_idx = x.win_idx AND t.a = x.local_idx AND t.b = x.anchor)"""
PX = lambda n: f"{FRAMES}, q AS (SELECT *, list_transform(v[1:{n}], lambda x: CAST(least(greatest(floor((x + 1) * 127.5), 0), 255) AS INTEGER)) AS px FROM f)"
SIDES = f"{PX(63)}, s AS (SELECT a.vec_id, a.px AS a, b.px AS b FROM q a JOIN q b ON a.win_idx = b.win_idx AND a.local_idx // 2 = b.local_idx // 2 AND a.local_idx % 2 = 0 AND b.local_idx % 2 = 1)"
SAMPLES = f"{SIDES}, u AS (SELECT vec_id, unnest(range(63)) AS k, unnest(a) AS x, unnest(b) AS y FROM s), m AS (SELECT vec_id, k // 3 AS p, max(x) AS mx, max(y) AS my FROM u GROUP BY 1, 2), bl AS (SELECT u.vec_id, k, CASE WHEN mx > 0 AND my > 0 THEN (x + y) // 2 WHEN mx > 0 THEN x WHEN my > 0 THEN y ELSE 0 END AS v FROM u JOIN m ON u.vec_id = m.vec_id AND u.k // 3 = m.p)"
T_SQL = lambda n: "coalesce(list_extract([" + ", ".join(map(str, scalar.T_CRITICAL)) + f"], CAST({n} - 1 AS INTEGER)), 2.0)"
STATS = f"r AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM events GROUP BY 1, 2)"
RATIO = f"b.mean / c.mean AS s, {T_SQL('least(b.n, c.n)')} * sqrt((b.std / b.mean) ** 2 / b.n + (c.std / c.mean) ** 2 / c.n) AS m"


@query("WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT pos // 4 AS win_idx, min(pos) AS img_start, max(pos) + 1 AS img_end, count(*) AS n_frames FROM p GROUP BY 1 HAVING count(*) >= 2")
def index_windows(spark, sf):
    return windows.window_ranges(windows.windowed(windows.positions(table(spark, sf, "documents").select("doc_id"), "doc_id")))


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT doc_id, pos FROM p WHERE pos >= (SELECT count(*) FROM p) - 4")
def tail_slice(spark, sf):
    return windows.sliced(windows.positions(table(spark, sf, "documents").select("doc_id"), "doc_id"), -4, None)


@query("SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix FROM pages WHERE lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.jpg', '.png', '.html')")
def suffix_scan(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", scalar.suffix(F.col("url")).alias("suffix"))
    return rows.where(F.col("suffix").isin(".jpg", ".png", ".html"))


@query(f"WITH {FRAMES} SELECT a.win_idx, a.local_idx AS i, b.local_idx AS j, a.vec_id AS vec_id_i, b.vec_id AS vec_id_j FROM f a JOIN f b ON a.win_idx = b.win_idx AND a.local_idx < b.local_idx")
def window_pairs(spark, sf):
    return pairs.window_pairs(frames(spark, sf).drop("v"), "vec_id")


@query(f"WITH {SCORED} SELECT win_idx, i, j, num_matches, num_inliers FROM p")
def pair_scores(spark, sf):
    return scored(spark, sf).drop("passes")


@query(f"WITH {SCORED} SELECT win_idx, i, j, num_inliers FROM g WHERE passes")
def pair_gate(spark, sf):
    return scored(spark, sf).where("passes").select("win_idx", "i", "j", "num_inliers")


@query(f"WITH {VERDICTS} SELECT * FROM w")
def window_verdict(spark, sf):
    return pairs.verdicts(scored(spark, sf))


RANGES = "rg AS (SELECT win_idx, min(pos) AS img_start, max(pos) + 1 AS img_end, count(*) AS n_frames FROM f GROUP BY win_idx HAVING count(*) >= 2)"


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_ranges(frames(spark, sf).select("win_idx", "pos"))


@query(
    f"WITH {SCORED}, {RANGES} SELECT CAST(win_idx AS INTEGER) AS window_idx, CAST(img_start AS INTEGER) AS img_start, CAST(img_end AS INTEGER) AS img_end, CAST(i AS INTEGER) AS local_i, CAST(j AS INTEGER) AS local_j, "
    "CAST(img_start + i AS INTEGER) AS global_i, CAST(img_start + j AS INTEGER) AS global_j, CAST(num_matches AS INTEGER) AS num_matches, CAST(num_inliers AS INTEGER) AS num_inliers, CASE WHEN passes THEN 'True' ELSE 'False' END AS passes_threshold FROM g JOIN rg USING (win_idx)"
)
def pair_table(spark, sf):
    return reports.pair_rows(scored(spark, sf), ranges(spark, sf))


@query(
    f"WITH {VERDICTS}, {RANGES} SELECT CAST(win_idx AS INTEGER) AS window_idx, CAST(img_start AS INTEGER) AS img_start, CAST(img_end AS INTEGER) AS img_end, CAST(n_frames AS INTEGER) AS num_images, "
    "CAST(total_pairs AS INTEGER) AS total_pairs, CAST(passing_pairs AS INTEGER) AS passing_pairs, verdict FROM w JOIN rg USING (win_idx)"
)
def summary_table(spark, sf):
    return reports.summary_rows(scored(spark, sf), ranges(spark, sf))


@query(f"WITH {VERDICTS} SELECT verdict, count(*) AS n_windows, string_agg(CAST(win_idx AS VARCHAR), ',' ORDER BY win_idx) AS windows FROM w GROUP BY verdict")
def verdict_rollup(spark, sf):
    return pairs.rollup(pairs.verdicts(scored(spark, sf)))


@query(f"WITH {SCORED}, {BOTH} SELECT win_idx, a AS i, " + ", ".join(f"CAST(coalesce(sum(num_inliers) FILTER (WHERE b = {k}), 0) AS BIGINT) AS c{k}" for k in range(4)) + " FROM both_ways GROUP BY 1, 2")
def inlier_matrix(spark, sf):
    return pairs.inlier_matrix(scored(spark, sf))


@query(f"WITH {HUB} SELECT win_idx, local_idx AS anchor, degree, inliers FROM o WHERE ord = 0")
def hub_anchor(spark, sf):
    return pairs.hub_order(frames(spark, sf), scored(spark, sf)).where("ord = 0").select("win_idx", "anchor", "degree", "inliers")


@query(f"WITH {HUB} SELECT win_idx * 4 + local_idx AS src_pos, win_idx * 4 + ord AS global_pos, printf('%04d.png', win_idx * 4 + ord) AS dest_name FROM o")
def reorder_manifest(spark, sf):
    rows = pairs.hub_order(frames(spark, sf), scored(spark, sf))
    at = F.col("win_idx") * 4 + F.col("ord")
    return rows.select((F.col("win_idx") * 4 + F.col("local_idx")).alias("src_pos"), at.alias("global_pos"), scalar.ordered_name(at, F.lit("X.PNG")).alias("dest_name"))


KNN = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT q.vec_id AS query_id, t.vec_id AS train_id, list_distance(q.v, t.v) AS d FROM e q, e t WHERE q.vec_id % 2 = 0 AND t.vec_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, train_id) AS rank FROM k)"


def two_nearest(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return knn.knn_join(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query(f"WITH {KNN} SELECT query_id, train_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 2")
def knn2(spark, sf):
    return two_nearest(spark, sf).select("query_id", "train_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {KNN}, b AS (SELECT query_id, max(train_id) FILTER (WHERE rank = 1) AS train_id, max(d) FILTER (WHERE rank = 1) AS d1, max(d) FILTER (WHERE rank = 2) AS d2 FROM r WHERE rank <= 2 GROUP BY 1) SELECT query_id, train_id, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM b WHERE d1 < 0.95 * d2")
def lowe_ratio(spark, sf):
    return knn.ratio_test(two_nearest(spark, sf), 0.95).select("query_id", "train_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT * FROM r WHERE rank <= 5")
def topk_features(spark, sf):
    best = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).where("rank <= 5")


def event_stats(spark, sf):
    return stats.phase_stats(table(spark, sf, "events"), "user_id", "event_type", value="value")


@query(f"WITH {STATS} SELECT user_id, event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN n > 1 THEN {T_SQL('n')} * std / sqrt(n) ELSE 0 END, 6) AS margin FROM r")
def phase_stats(spark, sf):
    return event_stats(spark, sf).select("user_id", "event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "margin")])


@query(f"WITH {STATS}, x AS (SELECT c.user_id, c.event_type, {RATIO} FROM r c JOIN r b ON b.user_id = c.user_id AND b.event_type = 'view' AND c.event_type <> 'view') SELECT user_id, event_type, round(s, 6) AS speedup, round(s * (1 - m), 6) AS ci_lower, round(s * (1 + m), 6) AS ci_upper FROM x")
def speedup_ci(spark, sf):
    out = stats.against_baseline(event_stats(spark, sf), "view", "event_type", "user_id")
    return out.select("user_id", "event_type", *[F.round(c, 6).alias(c) for c in ("speedup", "ci_lower", "ci_upper")])


MASKED = "CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN NULL ELSE value END"


@query(
    f"WITH r AS (SELECT user_id, event_type, CASE WHEN count(*) = count({MASKED}) THEN avg({MASKED}) END AS mean FROM events WHERE NOT (event_type = 'view' AND user_id % 5 = 0) GROUP BY 1, 2) "
    "SELECT c.user_id, c.event_type, round(b.mean, 6) AS base_mean, round(c.mean, 6) AS cand_mean, round(b.mean / c.mean, 6) AS speedup FROM r c LEFT JOIN r b ON b.user_id = c.user_id AND b.event_type = 'view' WHERE c.event_type <> 'view'"
)
def speedup_na(spark, sf):
    rows = table(spark, sf, "events").where("not (event_type = 'view' and user_id % 5 = 0)").withColumn("value", F.expr(MASKED))
    out = stats.against_baseline(stats.phase_stats(rows, "user_id", "event_type", value="value"), "view", "event_type", "user_id", how="left")
    return out.select("user_id", "event_type", *[F.round(c, 6).alias(c) for c in ("base_mean", "cand_mean", "speedup")])


@query("WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS b, CASE WHEN l_linenumber % 3 <> 0 THEN nullif(l_discount, 0) * l_quantity END AS c FROM lineitem) SELECT l_returnflag, l_linestatus, round(CASE WHEN sum(c) > 0 THEN sum(b) FILTER (WHERE b IS NOT NULL AND c IS NOT NULL) / sum(c) FILTER (WHERE b IS NOT NULL) END, 4) AS speedup FROM r GROUP BY 1, 2")
def aggregate_speedup(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("base"), F.expr("case when l_linenumber % 3 <> 0 then nullif(l_discount, 0) * l_quantity end").alias("cand"))
    return stats.aggregate_speedup(rows, "l_returnflag", "l_linestatus").withColumn("speedup", F.round("speedup", 4))


@query("SELECT o_custkey % 50 AS win_idx, o_orderpriority AS candidate, printf('%d-%d', (o_custkey % 50) * 4, (o_custkey % 50) * 4 + 4) AS label, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS speedup FROM orders GROUP BY 1, 2")
def window_speedup(spark, sf):
    g = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("win_idx"), F.col("o_orderpriority").alias("candidate")).agg(F.expr("cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(100 * count(*) as double)").alias("speedup"))
    return g.select("win_idx", "candidate", F.format_string("%d-%d", F.col("win_idx") * 4, F.col("win_idx") * 4 + 4).alias("label"), "speedup")


PHASE = "CASE event_id % 6 WHEN 0 THEN 'extract' WHEN 1 THEN 'match' WHEN 2 THEN 'homo' WHEN 3 THEN 'warp' WHEN 4 THEN 'reext' ELSE 'total' END"


@query(f"WITH r AS (SELECT event_type AS strategy, {PHASE} AS phase, value AS secs FROM events WHERE event_type <> 'view' UNION ALL SELECT 'baseline', {PHASE}, value FROM events WHERE event_type = 'view') SELECT strategy, " + ", ".join(f'round(avg(secs) FILTER (WHERE phase = \'{p}\'), 6) AS "{p}"' for p in stats.PHASES) + " FROM r GROUP BY strategy")
def strategy_phase_pivot(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.expr(PHASE).alias("phase"), F.col("value").alias("secs"))
    cand = rows.where("event_type <> 'view'").withColumnRenamed("event_type", "strategy")
    out = stats.strategy_pivot(cand, rows.where("event_type = 'view'").select(F.lit("baseline").alias("strategy"), "phase", "secs"))
    return out.select("strategy", *[F.round(p, 6).alias(p) for p in stats.PHASES])


@query("WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE regexp_extract(props, ': ([0-9]+)', 1) END AS raw FROM events) SELECT event_id, raw, TRY_CAST(raw AS DOUBLE) AS number FROM r")
def lenient_cast(spark, sf):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.regexp_extract("props", ": ([0-9]+)", 1))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).withColumn("number", F.expr("try_cast(raw as double)"))


@query("WITH r AS (SELECT page_id, printf('benchmark_%dc_4s.csv', 1 << (page_id % 5)) AS name, length(html) AS size FROM pages) SELECT CAST(regexp_extract(name, '(\\d+)c', 1) AS INTEGER) AS cores, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY 1")
def scaling_by_cores(spark, sf):
    rows = table(spark, sf, "pages").select(F.length("html").alias("size"), F.format_string("benchmark_%dc_4s.csv", F.expr("shiftleft(1, cast(page_id % 5 as int))")).alias("name"))
    return rows.groupBy(scalar.core_count(F.col("name")).alias("cores")).agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("size"))


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 'succeeded' ELSE 'missing' END AS state FROM customer")
def missing_candidates(spark, sf):
    customers, done = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(done, "c_custkey", "left_semi").withColumn("state", F.lit("succeeded")).unionByName(customers.join(done, "c_custkey", "left_anti").withColumn("state", F.lit("missing")))


@query("SELECT conv_id, max(turn) AS run, arg_max(text, turn) AS result FROM conversations GROUP BY conv_id")
def last_run(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("run"), F.max_by("text", "turn").alias("result"))


@query(f"WITH {PX(64)}, u AS (SELECT vec_id, unnest(range(64)) AS k, unnest(px) AS x FROM q) SELECT vec_id, (k // 8) // 2 AS y, (k % 8) // 2 AS x, CAST(floor(sum(x) / 4.0 + 0.5) AS INTEGER) AS v FROM u GROUP BY 1, 2, 3")
def downscale_half(spark, sf):
    made = pixel_frames(spark, sf, 64).select("vec_id", F.posexplode(pixels.halved(F.col("px"), 8, 8)).alias("k", "v"))
    return made.select("vec_id", F.expr("cast(k div 4 as bigint)").alias("y"), F.expr("cast(k % 4 as bigint)").alias("x"), "v")


@query(f"WITH {PX(63)} SELECT vec_id, unnest(range(21)) AS k, unnest(list_transform(range(21), lambda i: CAST((px[i * 3 + 1] * 1868 + px[i * 3 + 2] * 9617 + px[i * 3 + 3] * 4899 + 8192) // 16384 AS INTEGER))) AS v FROM q")
def gray(spark, sf):
    made = pixel_frames(spark, sf, 63).select("vec_id", F.posexplode(pixels.gray_plane(F.col("px"))).alias("k", "v"))
    return made.select("vec_id", F.col("k").cast("long").alias("k"), "v")


@query(f"WITH {SAMPLES} SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY k) AS pixels FROM bl GROUP BY 1")
def blend(spark, sf):
    return neighbours(spark, sf).select("vec_id", F.array_join(pixels.blended(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("pixels"))


@query(ORACLE["blend"])
def blend_tiled(spark, sf):
    made = pixels.blended_tiles(neighbours(spark, sf), ["vec_id"], rows=7, workers=4)
    return made.select("vec_id", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


@query(
    f"WITH {SIDES}, u AS (SELECT vec_id, unnest(range(63)) AS k, unnest(a) AS x, unnest(b) AS y FROM s), c AS (SELECT vec_id, true AS shape_match, max(abs(x - y)) AS max_pixel_diff, avg(abs(x - y)) AS mean, 100.0 * count(*) FILTER (WHERE x = y) / count(*) AS same, avg((x - y) * (x - y)) AS mse, "
    + ", ".join(f"max(abs(x - y)) FILTER (WHERE k % 3 = {k}) AS {c}_max_diff, avg(abs(x - y)) FILTER (WHERE k % 3 = {k}) AS {c}" for k, c in enumerate(("blue", "green", "red")))
    + " FROM u GROUP BY vec_id) SELECT vec_id, shape_match, max_pixel_diff, round(mean, 6) AS mean_pixel_diff, round(same, 6) AS identical_pixels_pct, round(CASE WHEN mse > 0 THEN 10 * log10(65025 / mse) END, 4) AS psnr_db, blue_max_diff, green_max_diff, red_max_diff, "
    "round(blue, 6) AS blue_mean_diff, round(green, 6) AS green_mean_diff, round(red, 6) AS red_mean_diff, CASE WHEN max_pixel_diff = 0 THEN 'Bit-identical' WHEN max_pixel_diff <= 1 THEN 'Numerically equivalent' WHEN 10 * log10(65025 / mse) > 40 THEN 'Visually identical' ELSE 'Different' END AS verdict FROM c"
)
def pixel_compare(spark, sf):
    out = pixels.compared(neighbours(spark, sf), ["vec_id"])
    means = ("mean_pixel_diff", "identical_pixels_pct", "blue_mean_diff", "green_mean_diff", "red_mean_diff")
    return out.select("vec_id", "shape_match", "max_pixel_diff", F.round("psnr_db", 4).alias("psnr_db"), "blue_max_diff", "green_max_diff", "red_max_diff", *[F.round(c, 6).alias(c) for c in means], "verdict")


H = ["1.0 + (p_partkey % 7) * 0.5", "(p_partkey % 3) * 0.25 - 0.25", "(p_partkey % 41) * 2.5 - 50.2", "(p_partkey % 5) * 0.125", "1.0 + (p_partkey % 4) * 0.75", "(p_partkey % 37) * 1.5 - 27.3", "0.0", "0.0", "1.0"]


@query(
    "WITH r AS (SELECT p_partkey, p_size * 8 AS w, p_size * 4 AS h, " + ", ".join(f"CAST({x} AS DOUBLE) AS h{i}" for i, x in enumerate(H)) + " FROM part), "
    "b AS (SELECT *, least(0, h2, h1 * h + h2, h0 * w + h1 * h + h2, h0 * w + h2) AS x0, greatest(w, h2, h1 * h + h2, h0 * w + h1 * h + h2, h0 * w + h2) AS x1, least(0, h5, h4 * h + h5, h3 * w + h4 * h + h5, h3 * w + h5) AS y0, greatest(h, h5, h4 * h + h5, h3 * w + h4 * h + h5, h3 * w + h5) AS y1 FROM r), "
    "c AS (SELECT p_partkey, w, h, CAST(trunc(x0 - 0.5) AS BIGINT) AS x_min, CAST(trunc(y0 - 0.5) AS BIGINT) AS y_min, CAST(trunc(x1 + 0.5) AS BIGINT) AS x_max, CAST(trunc(y1 + 0.5) AS BIGINT) AS y_max FROM b) "
    "SELECT p_partkey, x_min, y_min, x_max, y_max, x_max - x_min > 0 AND y_max - y_min > 0 AND (x_max - x_min) * (y_max - y_min) <= 4 * (CAST(w AS BIGINT) * h * 2) AS fits FROM c"
)
def canvas_guard(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 8).alias("w1"), (F.col("p_size") * 4).alias("h1"), *[F.expr(f"cast({x} as double)").alias(f"h_{i}") for i, x in enumerate(H)])
    rows = rows.withColumns({"w2": F.col("w1"), "h2": F.col("h1")})
    return geometry.canvas(rows, [F.col(f"h_{i}") for i in range(9)]).select("p_partkey", "x_min", "y_min", "x_max", "y_max", "fits")


@query("SELECT p_brand, avg(CAST(p_size AS DOUBLE) * p_size) AS mean_area, max(CAST(p_size AS BIGINT) * p_size * (p_partkey % 30)) AS largest, max(CAST(p_size AS BIGINT) * p_size * (p_partkey % 30)) > 10 * avg(CAST(p_size AS DOUBLE) * p_size) AS oversize FROM part GROUP BY 1")
def oversize_flag(spark, sf):
    area = F.col("p_size").cast("long") * F.col("p_size")
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.avg(area.cast("double")).alias("mean_area"), F.max(area * (F.col("p_partkey") % 30)).alias("largest"))
    return g.withColumn("oversize", F.col("largest") > 10 * F.col("mean_area"))


def gate(a, b):
    return close(a, b, TAU) >= pairs.LEAST_INLIERS


def average(a, b):
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


OK = "len(list_filter(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]) < 0.04)) >= 15"
AVG = "list_transform(list_zip(a.v, b.v), lambda z: (z[1] + z[2]) / 2)"
TREE = lambda src, dst, of: f"{dst} AS (SELECT a.win_idx, a.pos // 2 AS pos, CASE WHEN b.v IS NOT NULL AND {OK} THEN {AVG} ELSE a.v END AS v, CASE WHEN b.v IS NOT NULL AND {OK} THEN a.n + b.n ELSE a.n END AS n FROM {src} a LEFT JOIN {src} b ON a.win_idx = b.win_idx AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0)"


@query(
    f"WITH RECURSIVE {FRAMES}, w AS (SELECT win_idx, 0 AS k, v, 1 AS n FROM f WHERE local_idx = 0 UNION ALL SELECT a.win_idx, a.k + 1, CASE WHEN {OK} THEN {AVG} ELSE a.v END, CASE WHEN {OK} THEN a.n + 1 ELSE a.n END FROM w a JOIN f b ON a.win_idx = b.win_idx AND b.local_idx = a.k + 1), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY win_idx ORDER BY k DESC) AS r FROM w) SELECT win_idx, CAST(k + 1 AS BIGINT) AS n_frames, CAST(n AS BIGINT) AS n_merged, round(list_sum(v), 6) AS total FROM l WHERE r = 1"
)
def linear_fold(spark, sf):
    out = folds.linear_fold(frames(spark, sf), "win_idx", "local_idx", "v", gate, average)
    return out.select("win_idx", "n_frames", "n_merged", F.round(F.aggregate("acc", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {FRAMES}, l0 AS (SELECT win_idx, local_idx AS pos, v, 1 AS n FROM f), {TREE('l0', 'l1', 0)}, {TREE('l1', 'l2', 0)} SELECT win_idx, CAST(n AS BIGINT) AS n_merged, round(list_sum(v), 6) AS total FROM l2")
def tree_fold(spark, sf):
    out = folds.tree_fold(frames(spark, sf), "win_idx", "local_idx", "v", gate, average, 4)
    return out.select("win_idx", "n_merged", F.round(F.aggregate("acc", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def stream_ordered(spark, sf):
    schema = table(spark, sf, "events").select("event_id", "user_id", "value").schema
    return ordered.run(spark, sf, "events.parquet", schema).withColumnRenamed("key", "user_id")


@query(None)
def extract_stage(spark, sf):
    made = mosaic.extract(mosaic.synthetic(spark))
    return made.select("pos", F.size("keypoints").alias("n_keypoints"), (F.octet_length("descriptors") / 512).cast("int").alias("n_descriptors"))


@query(None)
def mosaic_windows(spark, sf):
    features = mosaic.extract(mosaic.synthetic(spark))
    out = [f(features).select(F.lit(name).alias("fold"), "win_idx", "height", "width", "n_frames", "n_merged") for name, f in (("linear", mosaic.linear), ("tree", mosaic.tree))]
    return out[0].unionByName(out[1])


@query(None)
def benchmark_verdicts(spark, sf):
    """Mosaics of every pipeline of the benchmark driver held against the baseline's, on synthetic frames."""
    runs = benchmarks.timed_runs(mosaic.synthetic(spark, windows=2, size=3), n_runs=1, warm_ups=0)
    return benchmarks.differences(runs).select("win_idx", "pipeline", "shape_match", "max_pixel_diff", "verdict")
