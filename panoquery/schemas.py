"""Row types of the engine: frames, keypoints, matches, and the CSV tables of diagnostics and benchmarks."""

# Phase names, and names and order of the CSV columns, as the files have them.
PHASES = ["extract", "match", "homo", "warp", "reext", "total"]
KEYPOINT = "struct<x float, y float, size float, angle float, response float, octave int, class_id int>"
FRAME = "origin string, pos long, win_idx long, local_idx long, height int, width int, data binary"
FEATURES = f"{FRAME}, keypoints array<{KEYPOINT}>, descriptors binary"
MOSAIC = "win_idx long, height int, width int, data binary, n_frames int, n_merged int, error string"
PAIRS_CSV = "window_idx int, img_start int, img_end int, local_i int, local_j int, global_i int, global_j int, num_matches int, num_inliers int, passes_threshold string"
SUMMARY_CSV = "window_idx int, img_start int, img_end int, num_images int, total_pairs int, passing_pairs int, verdict string"
BENCHMARK_CSV = (
    "window_idx int, img_start int, img_end int, baseline string, candidate string, phase string, " + ", ".join(f"{c} string" for c in ("baseline_mean_s", "baseline_std_s", "baseline_margin_s", "candidate_mean_s", "candidate_std_s", "candidate_margin_s", "speedup", "ci_lower", "ci_upper"))
)
CORRECTNESS_CSV = (
    "window_idx int, img_start int, img_end int, baseline string, candidate string, shape_match boolean, max_pixel_diff int, mean_pixel_diff double, identical_pixels_pct double, psnr_db string, "
    "blue_max_diff int, blue_mean_diff double, green_max_diff int, green_mean_diff double, red_max_diff int, red_mean_diff double, verdict string"
)
