"""Window mosaics: extract features once per frame, then fold each window, linearly or as a tree.

Linear: left to right; a frame that can't be merged is skipped and the accumulator stays. Tree: neighbours merge level by
level, all windows together; a failed merge keeps the left node. The two give different results on purpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panoquery.operators import kernels as K
from panoquery.operators.pairs import gated
from panoquery.schemas import FEATURES, MOSAIC

NODE = "win_idx long, pos long, height int, width int, data binary, keypoints binary, descriptors binary, n_frames int, n_merged int, error string"


def image(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)


def extract(frames: DataFrame) -> DataFrame:
    """Frames with keypoints and descriptors (packed float32); one frame at a time, so a batch's arrays stay bounded."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                kp, des = K.features(image(row))
                points = [{"x": float(x), "y": float(y), "size": 16.0, "angle": 0.0, "response": float(r), "octave": 0, "class_id": -1} for x, y, r in kp]
                yield pd.DataFrame([{**row._asdict(), "keypoints": points, "descriptors": des.tobytes()}])

    return frames.select("origin", "pos", "win_idx", "local_idx", "height", "width", "data").mapInPandas(rows, FEATURES)


def unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    kp = np.array([[p["x"], p["y"], p["response"]] for p in row.keypoints], np.float32).reshape(-1, 3)
    return kp, np.frombuffer(row.descriptors, np.float32).reshape(-1, 128)


def pair_scores(features: DataFrame) -> DataFrame:
    """(win_idx, i, j, num_matches, num_inliers, passes) for all pairs inside windows, by geometry."""

    def rows(batch: pd.DataFrame) -> pd.DataFrame:
        own = list(batch.sort_values("local_idx").itertuples(index=False))
        read = [unpacked(r) for r in own]
        out = []
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                m = K.matches(read[a][1], read[b][1])
                inliers = K.robust(read[a][0][m[:, 0], :2].astype(float), read[b][0][m[:, 1], :2].astype(float), K.seeded(own[a].win_idx, own[a].local_idx, own[b].local_idx))[1]
                out.append((own[a].win_idx, own[a].local_idx, own[b].local_idx, len(m), inliers))
        return pd.DataFrame(out, columns=["win_idx", "i", "j", "num_matches", "num_inliers"])

    found = features.select("win_idx", "local_idx", "keypoints", "descriptors").groupBy("win_idx").applyInPandas(rows, "win_idx long, i long, j long, num_matches long, num_inliers long")
    return gated(found)


def linear(features: DataFrame, strips: int = 1) -> DataFrame:
    """One mosaic per window of at least two frames."""

    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        own = list(batch.sort_values("pos").itertuples(index=False))
        if len(own) < 2:
            return pd.DataFrame(columns=["win_idx", "height", "width", "data", "n_frames", "n_merged", "error"])
        acc, acc_f, merged, errors = image(own[0]), unpacked(own[0]), 1, []
        for k, row in enumerate(own[1:], 1):
            out, why = K.merged(acc, acc_f, image(row), unpacked(row), K.seeded(row.win_idx, 0, k), strips)
            if out is None:
                errors.append(f"{row.pos}: {why}")
            else:
                acc, acc_f, merged = out, K.features(out), merged + 1
        return pd.DataFrame([{"win_idx": own[0].win_idx, "height": acc.shape[0], "width": acc.shape[1], "data": acc.tobytes(), "n_frames": len(own), "n_merged": merged, "error": "; ".join(errors) or None}])

    return features.groupBy("win_idx").applyInPandas(fold, MOSAIC)


def tree(features: DataFrame, size: int = 4) -> DataFrame:
    """One mosaic per window of at least two frames, in ceil(log2(size)) levels of pairwise merges."""

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                kp, des = unpacked(row)
                out.append((row.win_idx, row.local_idx, row.height, row.width, row.data, kp.tobytes(), des.tobytes(), 1, 1, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])

    def merge(depth: int):
        def pair(batch: pd.DataFrame) -> pd.DataFrame:
            own = list(batch.sort_values("pos").itertuples(index=False))
            a = own[0]._asdict() | {"pos": own[0].pos // 2}
            if len(own) > 1:
                b = own[1]
                read = [(np.frombuffer(r.keypoints, np.float32).reshape(-1, 3), np.frombuffer(r.descriptors, np.float32).reshape(-1, 128)) for r in own]
                out, why = K.merged(image(own[0]), read[0], image(b), read[1], K.seeded(b.win_idx, depth, b.pos))
                errors = [e for e in (a["error"], b.error, why and f"level {depth}, {b.pos}: {why}") if e]
                a |= {"n_frames": a["n_frames"] + b.n_frames, "error": "; ".join(errors) or None}
                if out is not None:
                    kp, des = K.features(out)
                    a |= {"height": out.shape[0], "width": out.shape[1], "data": out.tobytes(), "keypoints": kp.tobytes(), "descriptors": des.tobytes(), "n_merged": a["n_merged"] + b.n_merged}
            return pd.DataFrame([a])

        return pair

    level = features.mapInPandas(leaf, NODE)
    for depth in range(max(1, (size - 1).bit_length())):
        level = level.groupBy("win_idx", F.expr("pos div 2")).applyInPandas(merge(depth), NODE)
    return level.where("n_frames >= 2").select("win_idx", "height", "width", "data", "n_frames", "n_merged", "error")


def synthetic(spark, windows: int = 4, size: int = 4, height: int = 96, width: int = 128, step: int = 48, seed: int = 5) -> DataFrame:
    """Frames cut from one random texture per window, each ``step`` pixels right of the one before."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pos in batch.id:
                win, k = divmod(int(pos), size)
                rng = np.random.default_rng(seed + win)
                texture = rng.integers(1, 255, (height // 4 + 2, (width + step * size) // 4 + 2, 3)).astype(np.uint8)
                whole = K.resized(texture, texture.shape[0] * 4, texture.shape[1] * 4)
                frame = np.ascontiguousarray(whole[:height, k * step : k * step + width])
                yield pd.DataFrame([{"origin": f"synthetic/{pos:04d}.png", "pos": pos, "win_idx": win, "local_idx": k, "height": height, "width": width, "data": frame.tobytes()}])

    return spark.range(0, windows * size, 1, min(windows * size, 8)).mapInPandas(rows, "origin string, pos long, win_idx long, local_idx long, height int, width int, data binary")
