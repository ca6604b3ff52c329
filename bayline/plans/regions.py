"""Queries over inferred regions and shapes: parking areas, rectangles, peaks, layouts, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.functions import boxes, polygons, rasters
from bayline.operators import areas, fits, matching, running
from bayline.operators.spool import written
from bayline.plans.observations import OBS, observations
from bayline.plans.registry import Registry
from bayline.plans.scenes import _COMMON, _quads, _QUADS
from bayline.sources.tables import table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

CELL = 6.0


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of wide scenes: twenty orders make a frame, their items stand on a field of 600 by 300."""
    c = F.col
    x, y = (c("l_partkey") % 60 * 10).cast("double"), (c("l_suppkey") % 30 * 10).cast("double")
    box = boxes.box(x, y, x + 6 + c("l_quantity") % 5, y + 6 + c("l_linenumber") % 4)
    ident = (c("l_partkey") * 10000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("id")
    return table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 20).alias("frame"), ident, (c("l_linestatus") == "F").alias("is_slot"), box.alias("box"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _field(spark, sf_dir)
    return rows.where("is_slot").select("frame", F.col("id").alias("slot_id"), "box"), rows.where("not is_slot").select("frame", F.col("id").alias("vehicle_id"), "box")


_AREA = f"""
WITH RECURSIVE f AS (
  SELECT CAST(floor(l_orderkey / 20) AS BIGINT) AS frame, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS id, l_linestatus = 'F' AS is_slot, CAST(l_partkey % 60 * 10 AS DOUBLE) AS x1, CAST(l_suppkey % 30 * 10 AS DOUBLE) AS y1,
         l_partkey % 60 * 10 + 6 + l_quantity % 5 AS x2, CAST(l_suppkey % 30 * 10 + 6 + l_linenumber % 4 AS DOUBLE) AS y2 FROM lineitem),
g AS (SELECT *, CASE WHEN is_slot THEN y1 ELSE y2 - (y2 - y1) * 0.45 END AS top FROM f),
b AS (SELECT frame, id, is_slot, CAST(floor(x1 / {CELL}) AS INTEGER) AS x1, CAST(floor(top / {CELL}) AS INTEGER) AS y1, CAST(floor(x2 / {CELL}) AS INTEGER) AS x2, CAST(floor(y2 / {CELL}) AS INTEGER) AS y2 FROM g),
r AS (SELECT frame, greatest(1, round(quantile_cont(least(x2 - x1, y2 - y1), 0.5) * 6.0 / {CELL})) AS support, CAST(greatest(1, round(quantile_cont(least(x2 - x1, y2 - y1), 0.5) * 1.6 / {CELL})) AS INTEGER) AS r FROM f WHERE is_slot GROUP BY frame),
s AS (SELECT DISTINCT v.* FROM b v JOIN r USING (frame) JOIN b c ON c.frame = v.frame AND c.is_slot WHERE NOT v.is_slot
      AND greatest(c.x1 - v.x2, v.x1 - c.x2, 0) ** 2 + greatest(c.y1 - v.y2, v.y1 - c.y2, 0) ** 2 <= support ** 2),
cells AS (SELECT DISTINCT frame, x, unnest(range(y1, y2 + 1)) AS y FROM (SELECT frame, y1, y2, unnest(range(x1, x2 + 1)) AS x FROM (SELECT * FROM b WHERE is_slot UNION ALL SELECT * FROM s))),
disc AS (SELECT rr, dx, dy FROM range(1, 12) a(rr), range(-11, 12) u(dx), range(-11, 12) v(dy) WHERE dx * dx + dy * dy <= rr * rr),
n AS (SELECT rr, count(*) AS n FROM disc GROUP BY rr),
grown AS (SELECT DISTINCT frame, r, x + dx AS x, y + dy AS y FROM cells JOIN r USING (frame) JOIN disc ON rr = r),
closed AS (SELECT frame, x + dx AS x, y + dy AS y FROM grown JOIN disc ON rr = r JOIN n ON n.rr = r GROUP BY frame, r, x + dx, y + dy, n.n HAVING count(*) = n.n),
runs AS (SELECT frame, y, min(x) AS a, max(x) AS b, frame * 16777216 + (y + 2048) * 4096 + min(x) + 2048 AS node FROM (SELECT *, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS k FROM closed) GROUP BY frame, y, k),
edges AS (SELECT u.node AS a, v.node AS b FROM runs u JOIN runs v ON v.frame = u.frame AND v.y = u.y + 1 AND v.a <= u.b + 1 AND u.a <= v.b + 1),
sides AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT node, node AS other FROM runs UNION SELECT reach.node, sides.b FROM reach JOIN sides ON reach.other = sides.a),
label AS (SELECT node, min(other) AS region FROM reach GROUP BY node),
sized AS (SELECT frame, region, sum(b - a + 1) AS n, sum(sum(b - a + 1)) OVER (PARTITION BY frame) AS total FROM runs JOIN label USING (node) GROUP BY frame, region),
area AS (SELECT frame, y, unnest(range(a, b + 1)) AS x FROM runs JOIN label USING (node) JOIN sized USING (frame, region) WHERE n >= total * 0.05)
"""


@_R.add("parking_regions", _AREA + "SELECT frame, count(*) AS regions, CAST(sum(n) AS BIGINT) AS cells, CAST(max(n) AS BIGINT) AS largest FROM sized WHERE n >= total * 0.05 GROUP BY frame")
def parking_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of each frame's inferred parking area and their cells."""
    runs = areas.parking_runs(*_sides(spark, sf_dir), "frame", CELL)
    sizes = runs.groupBy("frame", "region").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"))
    return sizes.groupBy("frame").agg(F.count("*").alias("regions"), F.sum("n").alias("cells"), F.max("n").alias("largest"))


@_R.add(
    "inferred_placement",
    _AREA
    + f"""
, a AS (SELECT frame, id, x1, y1, x2, y2 FROM f WHERE is_slot), v AS (SELECT frame, id, x1, y2 - (y2 - y1) * 0.45 AS y1, x2, y2 FROM f WHERE NOT is_slot),
taken AS (SELECT DISTINCT b.frame, b.id FROM a JOIN v b ON a.frame = b.frame WHERE greatest({_COMMON} / ((a.x2 - a.x1) * (a.y2 - a.y1)), {_COMMON} / ((b.x2 - b.x1) * (b.y2 - b.y1))) >= 0.35),
p AS (SELECT v.frame, CASE WHEN t.id IS NOT NULL THEN 'in_mapped_space' WHEN v.frame NOT IN (SELECT frame FROM area) THEN 'area_unknown' WHEN area.x IS NOT NULL THEN 'in_parking_area' ELSE 'outside_parking_area' END AS placement
      FROM v LEFT JOIN taken t ON t.frame = v.frame AND t.id = v.id LEFT JOIN area ON area.frame = v.frame AND area.x = floor((v.x1 + v.x2) / 2 / {CELL}) AND area.y = floor((v.y2 - 0.5) / {CELL}))
SELECT frame, count(*) FILTER (placement = 'in_mapped_space') AS in_mapped_space, count(*) FILTER (placement = 'in_parking_area') AS in_parking_area, count(*) FILTER (placement = 'outside_parking_area') AS outside_parking_area,
       count(*) FILTER (placement = 'area_unknown') AS area_unknown, count(*) FILTER (placement <> 'outside_parking_area') AS facility_vehicles FROM p GROUP BY frame
""",
)
def inferred_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each frame's vehicles stand, by its inferred parking area."""
    slots, vehicles = _sides(spark, sf_dir)
    taken = matching.link_boxes(slots, vehicles, "frame").where("occupies")
    found = areas.placed(vehicles, taken, areas.parking_runs(slots, vehicles, "frame", CELL), "frame", CELL)
    names = ("in_mapped_space", "in_parking_area", "outside_parking_area", "area_unknown")
    return found.groupBy("frame").agg(*(F.count_if(F.col("placement") == n).alias(n) for n in names), F.count_if(F.col("placement") != "outside_parking_area").alias("facility_vehicles"))


@_R.add(
    "representation_ceiling",
    _QUADS
    + """
, c AS (SELECT p_partkey, w, h, [[x, y], [x + w, y + h], [x + w, y + h * 2], [x, y + h]] AS q FROM q),
e AS (SELECT p_partkey, w, h, q, unnest([[q[i % 4 + 1][1] - q[i][1], q[i % 4 + 1][2] - q[i][2]] FOR i IN range(1, 5)]) AS d FROM c),
s AS (SELECT p_partkey, w, h, (list_max([p[1] * d[1] + p[2] * d[2] FOR p IN q]) - list_min([p[1] * d[1] + p[2] * d[2] FOR p IN q]))
        * (list_max([p[2] * d[1] - p[1] * d[2] FOR p IN q]) - list_min([p[2] * d[1] - p[1] * d[2] FOR p IN q])) / (d[1] * d[1] + d[2] * d[2]) AS size FROM e WHERE d[1] <> 0 OR d[2] <> 0)
SELECT p_partkey, round(min(size), 6) AS rectangle, round(CASE WHEN min(size) > 1e-9 THEN any_value(w * h) / min(size) ELSE 0 END, 6) AS ceiling FROM s GROUP BY p_partkey
""",
)
def representation_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least rectangle about each quad, and the overlap that a detector of rectangles could reach at most."""
    rows = _quads(spark, sf_dir).withColumn("rectangle", polygons.area(polygons.least_rectangle(F.col("quad"))))
    share = F.when(F.col("rectangle") > 1e-9, polygons.area(F.col("quad")) / F.col("rectangle")).otherwise(0.0)
    return rows.select("p_partkey", F.round("rectangle", 6).alias("rectangle"), F.round(share, 6).alias("ceiling"))


PEAK = 0.5


@_R.add(
    "heatmap_peaks",
    f"""
WITH e AS (SELECT vec_id // 9 AS map, vec_id % 9 AS channel, embedding AS v FROM embeddings),
h AS (SELECT map, [1 / (1 + exp(-greatest(least(x::DOUBLE, 30), -30))) FOR x IN v] AS c FROM e WHERE channel = 0),
p AS (SELECT map, y, x, c[y * 8 + x + 1] AS confidence, list_max([c[(y + dy) * 8 + x + dx + 1] FOR dy IN range(-1, 2) FOR dx IN range(-1, 2) IF y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7]) AS top
      FROM h, range(8) a(y), range(8) b(x)),
k AS (SELECT * FROM p WHERE confidence >= {PEAK} AND confidence >= top - 1e-7),
o AS (SELECT map, list(v ORDER BY channel) AS o FROM e WHERE channel > 0 GROUP BY map HAVING count(*) = 8)
SELECT map, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(confidence, 6) AS confidence,
  [round(greatest(least((CASE WHEN i % 2 = 0 THEN x ELSE y END + 0.5) / 8 + tanh(o[i + 1][y * 8 + x + 1]::DOUBLE) * 0.15, 1), 0), 6) FOR i IN range(8)] AS corners FROM k JOIN o USING (map)
""".replace("list_max([c[(y + dy) * 8 + x + dx + 1] FOR dy IN range(-1, 2) FOR dx IN range(-1, 2) IF y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7])",
            "list_max([c[(y + d // 3 - 1) * 8 + x + d % 3] FOR d IN range(9) IF y + d // 3 - 1 BETWEEN 0 AND 7 AND x + d % 3 - 1 BETWEEN 0 AND 7])"),
)
def heatmap_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peaks of heat maps of 8 by 8 with the corners that their offsets give; nine embeddings are the channels of one map."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 9).alias("map"), (F.col("vec_id") % 9).alias("channel"), F.col("embedding").cast("array<double>").alias("v"))
    maps = rows.groupBy("map").agg(F.array_sort(F.collect_list(F.struct("channel", "v"))).alias("c"))  # nine vectors
    whole = maps.where(F.transform("c", lambda x: x.channel) == F.sequence(F.lit(0).cast(rows.schema["channel"].dataType), F.lit(8).cast(rows.schema["channel"].dataType)))
    found = whole.select("map", F.inline(rasters.peaks(F.transform("c", lambda x: x.v), 8, 8, PEAK)))
    return found.select("map", "y", "x", F.round("confidence", 6).alias("confidence"), F.transform("corners", lambda v: F.round(v, 6)).alias("corners"))


@_R.add(
    "scenario_audit",
    OBS
    + """
, s AS (SELECT camera AS dataset, slot AS scenario, count(*) AS readings, round(avg(CAST((p >= 0.5) = truth AS INTEGER)), 6) AS baseline, round(avg(CAST((p >= 0.35) = truth AS INTEGER)), 6) AS enhanced FROM obs GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY enhanced, dataset, scenario) AS place FROM s
""",
)
def scenario_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verdicts' accuracy on every scenario, the worst of the second first."""
    right = lambda at: F.round(F.avg(((F.col("p") >= at) == F.col("truth")).cast("int")), 6)
    scenarios = observations(spark, sf_dir).groupBy(F.col("camera").alias("dataset"), F.col("slot").alias("scenario")).agg(F.count("*").alias("readings"), right(0.5).alias("baseline"), right(0.35).alias("enhanced"))
    order = [F.col("enhanced"), F.col("dataset"), F.col("scenario")]
    ranged = running.in_ranges(scenarios.withColumn("one", F.lit(1).cast("long")), [], order)
    return running.running_sums(ranged, [], order, {"place": "one"}).drop("one", running.PART)


@_R.add(
    "expired_events",
    """
WITH d AS (SELECT event_type AS camera, ts, max(ts) OVER () - INTERVAL 7 DAY AS cut FROM events)
SELECT camera, count(*) FILTER (ts < cut) AS expired, count(*) FILTER (ts >= cut) AS kept, CAST(min(ts) FILTER (ts >= cut) AS VARCHAR) AS oldest FROM d GROUP BY camera
""",
)
def expired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events more than seven days older than the newest go; what stays, and how old it is."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("camera"), "ts")
    cut = rows.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("cut"))
    marked = rows.crossJoin(F.broadcast(cut))  # one row
    old = F.col("ts") < F.col("cut")
    return marked.groupBy("camera").agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("kept"), F.min(F.when(~old, F.col("ts"))).cast("string").alias("oldest"))


@_R.add(
    "layout_slots",
    """
WITH first AS (SELECT l_suppkey AS layout, min(l_orderkey) AS image FROM lineitem GROUP BY 1),
canon AS (SELECT layout, list(DISTINCT l_partkey ORDER BY l_partkey) AS slots FROM first JOIN lineitem ON l_suppkey = layout AND l_orderkey = image GROUP BY layout),
named AS (SELECT o_orderkey AS image, o_custkey % 97 AS layout FROM orders)
SELECT image, layout, CAST(i AS INTEGER) AS place, slots[i + 1] AS slot FROM (SELECT image, layout, slots, unnest(range(len(slots))) AS i FROM named JOIN canon USING (layout))
""",
)
def layout_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical slots, those of a layout's first image, for every image whose layout a classifier named."""
    manifest = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("layout"), F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("slot"))
    images = manifest.groupBy("layout", "image").agg(F.sort_array(F.collect_set("slot")).alias("slots"))
    canon = images.groupBy("layout").agg(F.min_by("slots", "image").alias("slots"))
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), (F.col("o_custkey") % 97).alias("layout"))
    return named.join(canon, "layout").select("image", "layout", F.posexplode("slots").alias("place", "slot"))


@_R.add("margin_learning_curve")
def margin_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of calibrated margins, fitted to growing nested samples of three folds of slots, on the fourth."""
    rows = written(observations(spark, sf_dir).select("slot", "p", "truth", (F.length("camera") % 3).alias("kind"), (F.col("slot") % 4).cast("int").alias("fold")))  # read in every pass
    train, held = rows.where("fold < 3"), rows.where("fold = 3")
    out = None
    for share in (0.25, 0.5, 1.0):
        margin, sigmoid = fits.calibrated_margin_fit(fits.nested_samples(train, "slot", [share]), ["p", "kind"], "truth", "fold", [0, 1, 2])
        scored = held.select(margin.margin().alias("margin"), "truth").select(sigmoid.margin().alias("z"), "truth")
        right = ((F.col("z") >= 0) == F.col("truth")).cast("int")
        part = scored.agg(F.lit(share).alias("share"), F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out
