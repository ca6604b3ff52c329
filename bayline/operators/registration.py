"""Registration of pictures from matched points: consensus homographies, agreement and stability.

Matches enter as rows (pair, match_id, x, y, u, v): a point of the template and the point of the
picture that a descriptor match gave it. A pair of pictures has some hundreds of matches, so one
pair's are gathered; pairs are spread over the cluster. Every step is decided by hashes of ids, so
a run that is repeated gives the same answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Matches that a pair needs, inliers and share that make it a success, and what full confidence takes.
LEAST_MATCHES, LEAST_INLIERS, LEAST_SHARE, LEAST_CONFIDENCE, FULL = 8, 8, 0.2, 0.05, 80.0
#: Matches below which a frame's stability is 0, those of least distance that count, and its distance in pixels.
STABLE_MATCHES, STABLE_FIRST, STABLE_PIXELS = 12, 100, 3.0
QUADRUPLES = 256


def solve_homographies(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 maps, with 1 in the last place, that take source to target, by least squares; both are (n, points, 2)."""
    x, y = source[..., 0], source[..., 1]
    u, v = target[..., 0], target[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    first = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1)
    second = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)
    a, b = np.concatenate([first, second], 1), np.concatenate([u, v], 1)[..., None]
    normal, right = a.transpose(0, 2, 1) @ a, a.transpose(0, 2, 1) @ b
    fine = np.linalg.cond(normal) < 1e18
    normal[~fine] = np.eye(8)
    h = np.linalg.solve(normal, right)[..., 0]
    h[~fine] = np.nan
    return np.concatenate([h, np.ones((len(h), 1))], 1).reshape(-1, 3, 3)


def _scaled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their mean and scaled to a mean distance of one, and the map that does it."""
    centre = points.mean(0)
    scale = 1 / max(np.linalg.norm(points - centre, axis=1).mean(), 1e-9)
    return (points - centre) * scale, np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])


def _distances(maps: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How far each map takes each source point from its target."""
    moved = np.einsum("kij,nj->kni", maps, np.column_stack([source, np.ones(len(source))]))
    with np.errstate(all="ignore"):
        off = np.linalg.norm(moved[..., :2] / moved[..., 2:] - target, axis=-1)
    return np.where(np.isfinite(off), off, np.inf)


def consensus(source: np.ndarray, target: np.ndarray, pixels: float, seed: int) -> tuple[np.ndarray | None, np.ndarray]:
    """(map, inliers): the homography that most matches agree with within pixels, refitted to them.

    Quadruples are drawn by the seed; of maps with as many inliers the first wins.
    """
    n = len(source)
    none = np.zeros(n, bool)
    if n < 4:
        return None, none
    (s, from_s), (t, from_t) = _scaled(source), _scaled(target)
    rng = np.random.default_rng(seed)
    rows = np.argsort(rng.random((QUADRUPLES, n)), axis=1)[:, :4]
    back = np.linalg.inv(from_t)
    maps = back @ solve_homographies(s[rows], t[rows]) @ from_s
    near = _distances(maps, source, target) <= pixels
    best = near[near.sum(1).argmax()]
    if best.sum() < 4:
        return None, none
    for _ in range(3):
        found = (back @ solve_homographies(s[None, best], t[None, best]) @ from_s)[0]
        again = _distances(found[None], source, target)[0] <= pixels
        if again.sum() < best.sum() or (again == best).all():
            break
        best = again
    return found / found[2, 2], best


def register(matches: DataFrame, pair: str, pixels: float = 4.0) -> DataFrame:
    """(pair, matches, inliers, ratio, homography): one row for each pair with LEAST_MATCHES matches or more.

    homography has nine numbers, row by row, and is null where no map has four inliers. Matches with
    a null are left out.
    """

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("match_id")
        points = np.column_stack([group[c].to_numpy() for c in ("x", "y", "u", "v")])
        found, inliers = consensus(points[:, :2], points[:, 2:], pixels, int(group["seed"][0].as_py()) & 0x7FFFFFFF)
        n, k = len(points), int(inliers.sum())
        kept = n >= LEAST_MATCHES
        row = [[group[pair][0].as_py()], [n], [k], [k / n], [None if found is None else found.reshape(-1).tolist()]]
        kinds = (group.schema.field(pair).type, pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        return pa.table([pa.array(v[: int(kept)], t) for v, t in zip(row, kinds, strict=True)], names=[pair, "matches", "inliers", "ratio", "homography"])

    rows = matches.select(pair, F.col("match_id").cast("long"), *(F.col(c).cast("double") for c in ("x", "y", "u", "v"))).dropna().withColumn("seed", F.xxhash64(pair))
    tail = StructType.fromDDL("matches long, inliers long, ratio double, homography array<double>")
    return rows.groupBy(pair).applyInArrow(fit, StructType([StructField(pair, matches.schema[pair].dataType), *tail.fields]))


def mapped(h: Column, x: Column, y: Column) -> Column:
    """A point taken by a homography of nine numbers."""
    w = h[6] * x + h[7] * y + h[8]
    return F.struct(F.try_divide(h[0] * x + h[1] * y + h[2], w).alias("x"), F.try_divide(h[3] * x + h[4] * y + h[5], w).alias("y"))


def best_template(registered: DataFrame, picture: str, template: str, layout: str) -> DataFrame:
    """Each picture's best template with status and confidence.

    Templates compete by inliers times their share; the margin is over the best of another layout.
    A picture whose best has too few inliers, share or confidence has status unsupported_layout.
    """
    scored = registered.where(F.col("homography").isNotNull()).withColumn("score", F.col("inliers") * F.col("ratio"))
    entry = F.struct(F.col("score"), (-F.xxhash64(template)).alias("tie"), F.col(layout).alias("layout"), F.col(template).alias("template"), "inliers", "ratio", "homography")
    by_layout = scored.groupBy(picture, layout).agg(F.max(entry).alias("best"))
    ranked = by_layout.groupBy(picture).agg(F.max("best").alias("best"), F.max_by("best.score", F.struct("best.score", "best.tie"), ).alias("top"), F.sort_array(F.collect_list("best.score"), asc=False).alias("scores"))
    other = F.coalesce(F.try_element_at("scores", F.lit(2)), F.lit(0.0))
    margin = F.greatest(F.lit(0.0), 1 - other / F.greatest(F.col("best.score"), F.lit(1e-6)))
    confidence = F.least(F.lit(1.0), F.col("best.inliers") / FULL) * F.col("best.ratio") * (0.6 + 0.4 * margin)
    poor = (F.col("best.inliers") < LEAST_INLIERS) | (F.col("best.ratio") < LEAST_SHARE) | (F.col("confidence") < LEAST_CONFIDENCE)
    status = F.when(poor, "unsupported_layout").when(F.col("confidence") >= 0.55, "success").otherwise("success_with_warnings")
    out = ranked.withColumn("confidence", confidence).withColumn("status", status)
    return out.select(picture, "status", "confidence", F.col("best.layout").alias(layout), F.col("best.template").alias(template), F.col("best.inliers").alias("inliers"), F.col("best.ratio").alias("ratio"), F.col("best.homography").alias("homography"))


def stability(matches: DataFrame, frame: str) -> DataFrame:
    """(frame, stability): the share of a frame's best matches, by distance, that one homography explains; 0 with too few.

    matches have distance beside what register() takes.
    """
    row = F.struct("distance", "match_id", "x", "y", "u", "v")
    counted = matches.groupBy(frame).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(row)), 1, STABLE_FIRST).alias("first"))
    first = counted.where(F.col("n") >= STABLE_MATCHES).select(frame, F.inline("first"))
    found = register(first, frame, STABLE_PIXELS)
    share = F.when(F.col("homography").isNotNull(), F.col("ratio")).otherwise(0.0)
    return counted.select(frame).join(found.select(frame, share.alias("stability")), frame, "left").withColumn("stability", F.coalesce("stability", F.lit(0.0)))
