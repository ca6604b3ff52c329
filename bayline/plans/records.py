"""Queries over stored records: catalogue slices and checks, jobs, uploads, splits, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.functions import hashing
from bayline.functions.verdicts import product_state
from bayline.operators import layouts, sampling, verification
from bayline.plans.catalogues import SEED, SRC, simhash_sql, sources, with_hash
from bayline.operators.spool import shared_path
from bayline.plans.registry import Registry
from bayline.sources import archives
from bayline.sources.tables import table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add("catalogue_slice", "SELECT doc_id AS id, lang, n_chars FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 100")
def catalogue_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred scenarios of one dataset in the catalogue's order."""
    docs = table(spark, sf_dir, "documents").where("source = 'src3'")
    return docs.orderBy("doc_id").limit(100).select(F.col("doc_id").alias("id"), "lang", "n_chars")


@_R.add("catalogue_lookup", "SELECT doc_id AS id, source, lang, n_chars FROM documents WHERE doc_id = 7")
def catalogue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario by its id; no row if there is none. The filter reaches the scan."""
    return table(spark, sf_dir, "documents").where("doc_id = 7").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")


@_R.add(
    "video_timeline",
    """
SELECT o_orderkey AS analysis, c_name AS video, n_name AS media, count(l_orderkey) AS events,
       string_agg(strftime(l_shipdate, '%Y-%m-%d') || ':' || l_linenumber || ':' || l_partkey, ',' ORDER BY l_shipdate, l_linenumber, l_partkey) AS timeline
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3
""",
)
def video_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finished analysis with its video, its medium and its events in order of time."""
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("analysis"), "o_custkey")
    videos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("video"), "c_nationkey")
    media = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("media"))
    event = F.struct("l_shipdate", "l_linenumber", "l_partkey")
    events = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("analysis")).agg(F.sort_array(F.collect_list(event)).alias("e"), F.count("*").alias("events"))
    text = F.transform("e", lambda x: F.concat_ws(":", F.date_format(x.l_shipdate, "yyyy-MM-dd"), x.l_linenumber, x.l_partkey))
    joined = runs.join(videos, "o_custkey").join(media, "c_nationkey").join(events, "analysis", "left")
    return joined.select("analysis", "video", "media", F.coalesce("events", F.lit(0).cast("long")).alias("events"), F.array_join(text, ",").alias("timeline"))


#: A catalogue needs these datasets, the last of which is not there, and so many scenarios of each.
REQUIRED, MINIMUM = ["src0", "src1", "src99"], 40


@_R.add(
    "catalogue_verification",
    f"""
WITH {simhash_sql("documents", "doc_id", "text")},
sc AS (SELECT doc_id AS id, source AS dataset, n_chars % 7 AS total, n_chars % 3 AS occupied, sha256(text) AS digest, hi, lo FROM documents LEFT JOIN sim ON sim.id = doc_id),
sl AS (SELECT l_orderkey AS id, count(*) AS slots, count(*) FILTER (WHERE l_returnflag = 'A') AS taken,
              count(*) FILTER (WHERE l_partkey % 50 / 100.0 + 0.1 + l_linenumber / 10.0 > 1) AS invalid FROM lineitem GROUP BY 1),
j AS (SELECT * FROM sc LEFT JOIN sl USING (id)),
f AS (SELECT digest, min(id) AS least FROM sc GROUP BY digest)
SELECT CAST(id AS VARCHAR) AS subject, 'no_slots' AS reason FROM j WHERE slots IS NULL
UNION ALL SELECT CAST(id AS VARCHAR), 'slot_total_mismatch' FROM j WHERE slots <> total
UNION ALL SELECT CAST(id AS VARCHAR), 'occupied_total_mismatch' FROM j WHERE taken <> occupied
UNION ALL SELECT CAST(id AS VARCHAR), 'missing_source_hash' FROM j WHERE digest IS NULL
UNION ALL SELECT CAST(id AS VARCHAR), 'missing_perceptual_hash' FROM j WHERE hi IS NULL
UNION ALL SELECT CAST(id AS VARCHAR), 'invalid_polygon' FROM j WHERE invalid > 0
UNION ALL SELECT CAST(id AS VARCHAR), 'exact_duplicate' FROM sc JOIN f USING (digest) WHERE id > least
UNION ALL SELECT CAST(a.id AS VARCHAR), 'near_duplicate' FROM sc a WHERE EXISTS (SELECT 1 FROM sc b WHERE b.id < a.id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 1)
UNION ALL SELECT d, 'missing_dataset' FROM (SELECT unnest({REQUIRED}) AS d) WHERE d NOT IN (SELECT dataset FROM sc)
UNION ALL SELECT dataset, 'below_minimum' FROM sc GROUP BY dataset HAVING count(*) < {MINIMUM}
""",
)
def catalogue_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of a catalogue of documents as scenarios and lineitems as their slots."""
    docs = with_hash(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text"), "text")
    c = F.col
    scenarios = docs.select(c("doc_id").alias("id"), c("source").alias("dataset"), (c("n_chars") % 7).alias("total"), (c("n_chars") % 3).alias("occupied"), "digest", "hash")
    x, w = c("l_partkey") % 50 / 100.0, 0.1 + c("l_linenumber") / 10.0
    corners = F.array(*(F.array(a, b) for a, b in ((x, F.lit(0.1)), (x + w, F.lit(0.1)), (x + w, F.lit(0.3)), (x, F.lit(0.3)))))
    slots = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), (c("l_returnflag") == "A").alias("occupied"), corners.alias("pairs"))
    return verification.verify_catalogue(scenarios, slots, REQUIRED, MINIMUM)


@_R.add("required_fields", "SELECT event_id AS id, json_extract(props, '$.k') IS NOT NULL AS complete, json_extract(props, '$.k') IS NOT NULL AND json_extract(props, '$.page') IS NOT NULL AS complete_page FROM events")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each manifest row has the fields that it must have."""
    has = lambda *keys: F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys("props"))) == 0
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), has("k").alias("complete"), has("k", "page").alias("complete_page"))


@_R.add(
    "holdout_gate",
    """
SELECT c_custkey AS lock, CASE WHEN c_acctbal < 0 THEN 'already_opened' WHEN sha256(c_name) <> sha256(replace(c_name, '7', '1')) THEN 'weights_changed' WHEN c_mktsegment = 'FURNITURE' THEN 'gate_not_passed' ELSE 'open' END AS verdict FROM customer
""",
)
def holdout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each lock lets the holdout be opened: once, with unchanged weights, after its gate was passed."""
    changed = F.sha2("c_name", 256) != F.sha2(F.regexp_replace("c_name", "7", "1"), 256)
    verdict = F.when(F.col("c_acctbal") < 0, "already_opened").when(changed, "weights_changed").when(F.col("c_mktsegment") == "FURNITURE", "gate_not_passed").otherwise("open")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lock"), verdict.alias("verdict"))


@_R.add(
    "official_partitions",
    SRC
    + """
, official AS (SELECT dataset, condition, any_value(CASE WHEN substr(sha256(dataset || condition), 1, 1) < '9' THEN 'train' WHEN substr(sha256(dataset || condition), 1, 1) < 'd' THEN 'holdout' END) AS split FROM src WHERE condition IS NOT NULL GROUP BY 1, 2)
SELECT id, split FROM src JOIN official USING (dataset, condition) WHERE split IS NOT NULL
""",
)
def official_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the official partition of their group; groups that no list names are dropped."""
    rows = sources(spark, sf_dir)
    digit = F.substring(F.sha2(F.concat("dataset", "condition"), 256), 1, 1)
    lists = rows.select("dataset", "condition").distinct().withColumn("split", F.when(digit < "9", "train").when(digit < "d", "holdout")).where("split is not null")
    return rows.join(lists, ["dataset", "condition"]).select("id", "split")


_SCORE = f"sha256('{SEED}|' || CAST(id AS VARCHAR))"


@_R.add(
    "template_rows",
    SRC
    + f"""
, o AS (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY dataset, condition ORDER BY {_SCORE}, id) AS own FROM src WHERE condition IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY own <> 1, CASE WHEN own = 1 THEN condition END, score, id) AS n FROM o)
SELECT id, dataset, condition FROM r WHERE n <= 6
""",
)
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rows of each layout: the least hash of each condition first, then the rest by hash."""
    rows = sources(spark, sf_dir).where("condition is not null")
    return sampling.condition_first(rows, "dataset", "condition", "id", SEED, 6).select("id", "dataset", "condition")


@_R.add(
    "validation_days",
    f"""
WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS day FROM orders), v AS (SELECT day FROM d ORDER BY sha256('{SEED}|CNR|' || day), day LIMIT 3)
SELECT o.day, CASE WHEN v.day IS NULL THEN 'train' ELSE 'validation' END AS split, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS day FROM orders) o LEFT JOIN v ON v.day = o.day GROUP BY 1, 2
""",
)
def validation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by day; the three days of least hash validate, the others train."""
    days = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("day")).agg(F.count("*").alias("n"))
    held = days.orderBy(hashing.score(F.concat(F.lit("CNR|"), "day"), SEED), "day").limit(3).select("day", F.lit("validation").alias("split"))
    return days.join(F.broadcast(held), "day", "left").select("day", F.coalesce("split", F.lit("train")).alias("split"), "n")  # three rows


@_R.add(
    "diverse_selection",
    SRC.replace("WITH src", "WITH RECURSIVE src")
    + """
, few AS (SELECT dataset, condition, size % 9 AS lot, id, row_number() OVER (PARTITION BY dataset, condition, size % 9 ORDER BY id) AS n FROM src WHERE condition IS NOT NULL),
walk AS (
  SELECT dataset, list({'c': condition, 'l': lot, 'k': id}) AS rest, list_filter(list({'c': condition, 'l': lot, 'k': id}), lambda x: FALSE) AS taken FROM few WHERE n <= 12 GROUP BY dataset
  UNION ALL
  SELECT dataset, list_filter(rest, lambda x: x.k <> pick.k), list_append(taken, pick) FROM (
    SELECT dataset, rest, taken, list_sort(list_transform(rest, lambda x: {
      'rule': CASE WHEN NOT list_contains([t.c FOR t IN taken], x.c) THEN 0 WHEN NOT list_contains([t.l FOR t IN taken], x.l) THEN 1 ELSE 2 END,
      'condition': CASE WHEN NOT list_contains([t.c FOR t IN taken], x.c) THEN x.c ELSE '' END,
      'first': CASE WHEN NOT list_contains([t.c FOR t IN taken], x.c) THEN CAST(list_contains([t.l FOR t IN taken], x.l) AS BIGINT)
                    WHEN NOT list_contains([t.l FOR t IN taken], x.l) THEN x.l ELSE len(list_filter(taken, lambda t: t.l = x.l)) END,
      'second': CASE WHEN list_contains([t.c FOR t IN taken], x.c) AND list_contains([t.l FOR t IN taken], x.l) THEN len(list_filter(taken, lambda t: t.c = x.c)) ELSE 0 END,
      'k': x.k, 'row': x}))[1].row AS pick FROM walk WHERE len(taken) < 12 AND len(rest) > 0))
SELECT dataset, t.c AS condition, t.l AS lot, t.k AS id, CAST(place AS INTEGER) AS place
FROM (SELECT dataset, unnest(taken) AS t, unnest(range(1, len(taken) + 1)) AS place FROM (SELECT dataset, arg_max(taken, len(taken)) AS taken FROM walk GROUP BY dataset))
""",
)
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve sources of each dataset that cover conditions, then sizes as lots, then balance both."""
    rows = sources(spark, sf_dir).where("condition is not null").withColumn("lot", F.col("size") % 9)
    return sampling.diverse(rows, "dataset", "condition", "lot", "id", 12)


@_R.add("upload_dedupe", SRC + "SELECT condition, digest, min(id) AS id, count(*) AS uploads FROM src WHERE digest NOT IN (SELECT digest FROM src WHERE \"partition\" = 'test') GROUP BY 1, 2")
def upload_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose content is not stored yet, one for each kind and content."""
    rows = sources(spark, sf_dir)
    stored = rows.where(F.col("partition") == "test").select("digest").distinct()
    return rows.join(stored, "digest", "left_anti").groupBy("condition", "digest").agg(F.min("id").alias("id"), F.count("*").alias("uploads"))


@_R.add(
    "manifest_images",
    "WITH m AS (SELECT replace(url, '/', '__') AS stem FROM pages), i AS (SELECT page_id, replace(url, '/', '__') AS stem FROM pages WHERE page_id % 3 <> 0) SELECT i.page_id, m.stem FROM m JOIN i USING (stem)",
)
def manifest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with the images whose stem follows from their id; the others are dropped."""
    pages = table(spark, sf_dir, "pages")
    stem = F.replace("url", F.lit("/"), F.lit("__")).alias("stem")
    return pages.select(stem).join(pages.where("page_id % 3 <> 0").select("page_id", stem), "stem").select("page_id", "stem")


@_R.add(
    "label_slots",
    "SELECT l_orderkey AS image, p_partkey AS label, unnest(range(p_size % 4)) AS slot FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'",
)
def label_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical slots of the layout that a classifier names for each image."""
    images = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("label"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), (F.col("p_size") % 4).alias("n")).where("n > 0")
    return images.join(known, "label").select("image", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("slot"))


@_R.add(
    "site_routing",
    "SELECT CASE WHEN s_suppkey % 9 + 1 <= 6 THEN 'train' WHEN s_suppkey % 9 + 1 <= 8 THEN 'validation' ELSE 'holdout' END AS split, count(*) AS cameras, count(*) FILTER (WHERE s_nationkey IN (1, 2, 3)) AS faithful FROM supplier GROUP BY 1",
)
def site_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras routed by their number, and those of sites whose geometry is exact."""
    number = F.col("s_suppkey") % 9 + 1
    split = F.when(number <= 6, "train").when(number <= 8, "validation").otherwise("holdout")
    return table(spark, sf_dir, "supplier").groupBy(split.alias("split")).agg(F.count("*").alias("cameras"), F.count_if(F.col("s_nationkey").isin(1, 2, 3)).alias("faithful"))


@_R.add(
    "partition_sets",
    SRC + """SELECT dataset, list_sort(list(DISTINCT "partition")) = ['test', 'train', 'validation'] AS complete, count(DISTINCT condition) = 4 AS all_conditions FROM src GROUP BY dataset""",
)
def partition_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each dataset has exactly the partitions, and as many conditions, as it should."""
    wanted = F.array(*map(F.lit, ("test", "train", "validation")))
    return sources(spark, sf_dir).groupBy("dataset").agg((F.sort_array(F.collect_set("partition")) == wanted).alias("complete"), (F.count_distinct("condition") == 4).alias("all_conditions"))


@_R.add(
    "merged_states",
    """
SELECT p_partkey AS slot, coalesce(nullif(p_type, 'ECONOMY'), p_brand) AS state, round(coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 50.0 END, 1.0), 6) AS confidence,
       round(coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 50.0 END, 0.0), 6) AS in_means FROM part
""",
)
def merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots with their states laid over them; a missing confidence is 1 in a scene and 0 in a mean."""
    state = F.coalesce(F.nullif(F.col("p_type"), F.lit("ECONOMY")), F.col("p_brand"))
    sure = F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0)
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("slot"), state.alias("state"), F.round(F.coalesce(sure, F.lit(1.0)), 6).alias("confidence"), F.round(F.coalesce(sure, F.lit(0.0)), 6).alias("in_means"))


_STATUS = {"1-URGENT": "running", "2-HIGH": "queued"}
_JOBS = "jobs AS (SELECT o_orderkey AS id, o_custkey AS media_asset_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'queued' ELSE 'done' END AS status FROM orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("media_asset_id"), product_state(F.col("o_orderpriority"), _STATUS, "done").alias("status"))


@_R.add("new_jobs", f"WITH {_JOBS} SELECT min(id) AS id, media_asset_id FROM jobs WHERE status = 'done' AND media_asset_id NOT IN (SELECT media_asset_id FROM jobs WHERE status IN ('queued', 'running')) GROUP BY 2")
def new_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for media without an active job, one for each medium."""
    jobs = _jobs(spark, sf_dir)
    return layouts.new_jobs(jobs.where("status = 'done'").select("id", "media_asset_id"), jobs)


@_R.add("recover_jobs", f"WITH {_JOBS} SELECT CASE WHEN status = 'done' THEN 'done' ELSE 'interrupted' END AS status, count(*) AS jobs FROM jobs GROUP BY 1")
def recover_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status after those that a restart cut off were marked."""
    return layouts.recover_jobs(_jobs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("jobs"))


@_R.add(
    "readiness",
    "WITH c AS (SELECT count(*) > 0 AS ready FROM documents UNION ALL SELECT count(*) > 1000000000 FROM events UNION ALL SELECT min(s_acctbal) > -1e9 FROM supplier) SELECT count(*) FILTER (WHERE ready) AS ready, count(*) AS checks, bool_and(ready) AS all_ready FROM c",
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the checks pass, and whether all do."""
    check = lambda name, table_name, ready: table(spark, sf_dir, table_name).agg(F.lit(name).alias("name"), ready.alias("ready"))
    n = F.count("*")
    return layouts.readiness(check("documents", "documents", n > 0), check("events", "events", n > 1_000_000_000), check("suppliers", "supplier", F.min("s_acctbal") > -1e9))


@_R.add(
    "external_confirmation",
    f"""
WITH {simhash_sql("documents", "doc_id", "text")},
d AS (SELECT doc_id AS id, sha256(text) AS digest, hi, lo, lang FROM documents LEFT JOIN sim ON sim.id = doc_id), k AS (SELECT * FROM d WHERE lang = 'en'), n AS (SELECT * FROM d WHERE lang <> 'en')
SELECT id FROM n a WHERE digest NOT IN (SELECT digest FROM k) AND NOT EXISTS (SELECT 1 FROM k b WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3)
""",
)
def external_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New texts that neither equal a known one nor come within 3 SimHash bits of one."""
    rows = with_hash(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text"), "text").select("id", "lang", "digest", "hash")
    return layouts.known_hash(rows.where("lang <> 'en'"), rows.where("lang = 'en'"), "digest", "hash").select("id")


@_R.add("spread_frames", "SELECT o_orderkey AS video, list_aggregate([CAST(floor((o_custkey + 10) * (i + 0.5) / 5) AS BIGINT) FOR i IN range(5)], 'string_agg', ',') AS positions FROM orders")
def spread_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where five calibration frames of each video lie: the midpoints of equal spans."""
    positions = sampling.spread_positions(F.col("o_custkey") + 10, 5)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), F.array_join(positions, ",").alias("positions"))


@_R.add("archive_scan", "SELECT 'pages/' || CAST(page_id % 10 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '.html' AS path, octet_length(encode(html)) AS size, sha256(html) AS digest FROM pages")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, packed into gzipped archives, as their streamed members; the predicate on the path reaches the reader."""
    pages = table(spark, sf_dir, "pages").select(F.concat_ws("/", F.lit("pages"), F.col("page_id") % 10, F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("name"), "html")
    path = shared_path(spark)
    archives.write_archives(pages, path, "name", "html").agg(F.sum("members")).collect()
    members = archives.archive_members(spark, path).where(F.col("path").startswith("pages/") & F.col("path").endswith(".html"))
    return members.select("path", "size", F.sha2("content", 256).alias("digest"))
