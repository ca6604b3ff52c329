"""Exact Jaccard self-join of documents on word shingles by a grouped prefix join.

A document's set holds the hashes of its n-word shingles. Documents with equal sets are one node.
Under one order of all shingles, two sets that are similar enough share a shingle among their
first few (the prefix). The order goes by rank, then by hash: common shingles have the doubling of
their count as rank, others rank 0, so the commonest come last. Ranks are joined to the shingles,
whatever their number; the order changes only the work, never the result. Most sets get their prefix
from those of their least hashes that are not common. Sets with too few of these are sent whole, and
their shingles are counted too. Then:

* nodes with identical prefix and size form a group;
* groups meet in the buckets of their prefix shingles. In a bucket of up to BUCKET groups, pairs
  of groups that pass the size filter are emitted, and those whose common prefix shingles are too
  few for the threshold go again. A larger bucket, the mark of near copies in great number,
  emits one edge for each group instead, to its least group;
* the connected groups are candidates for each other. They are expanded to their members, whose
  whole sets are compared: all against all inside a cluster of at most TILE members, tile against
  tile in larger ones, by one matrix product a time. Each comparison returns a spanning forest of
  the links it found, so no group emits all its pairs and no link between different sets is lost.

A null or empty text, or one without words, has the empty set and is linked with nothing. A text
with fewer than n words is one shingle. Rows that repeat an id belong to the components of all
their texts alike; a component is named by its least id, by null if it has none. Columns other
than the id and the text are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.llm import store
from bayline.llm.components import connected_components
from bayline.llm.hashing import mix, shingle_hashes, text_buffers, word_hashes
from bayline.llm.hot import join_one
from bayline.llm.store import discard

HOT = 32
#: Common shingles with more than this share of all counted entries, fewer than its inverse, are joined by broadcast.
SHARE = 1 / 256
#: Ranks are below it: counts have 64 bits.
RANKS = 64
BUCKET = 64
#: Members, and bytes of their sets, that a tile holds; a larger set is a tile of its own.
TILE, TILE_BYTES = 512, 8 << 20
#: The filter that keeps the sets of nodes without candidates from being sent: bits a node, and at most.
NODE_BITS, MOST_BITS = 16, 1 << 27
FILTER_SHIFTS = (0, 18, 36)
REMEMBERED = 500_000
_CELLS = 1 << 22
#: Bytes of sets that a task gathers before it hands them on.
_PIECE = 4 << 20
#: Bytes of texts or sets in a batch for Python, which makes several times as much of them.
BATCH = "4m"


class Similarity:
    """Jaccard similarity of at least numerator / denominator on n-word shingles."""

    def __init__(self, n: int, numerator: int, denominator: int) -> None:
        self.n, self.numerator, self.denominator = n, numerator, denominator

    def prefix(self, size: int) -> int:
        """How many first shingles of a set of this size must meet those of a similar one."""
        return size - -(-self.numerator * size // self.denominator) + 1

    def linked(self, common, a, b):
        """Whether sets of sizes a and b with so many common shingles are similar."""
        return self.denominator * common >= self.numerator * (a + b - common)


def materialise(df: DataFrame) -> DataFrame:
    """df written in the shared folder, with small batches on the way."""
    return store.materialise(df, batch=BATCH)


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_buffers(column):
        words, bounds = word_hashes(data, offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield shingle_hashes(words[a:b], n)


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of a set."""
    if not len(shingles):
        return 0
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return int(mix(np.array([mix(shingles + place).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class _Sent:
    """Remembers what a task has sent already, up to a bound."""

    def __init__(self) -> None:
        self.keys: set[int] = set()

    def first(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= REMEMBERED:
            self.keys.clear()
        self.keys.add(key)
        return True


def document_sets(docs: DataFrame, rule: Similarity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, size, low): each row's set; low, its least hashes, once for each node of a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            nodes, sizes, lows = [], [], []
            for s in _sets(batch.column(1), rule.n):
                node = set_key(s)
                nodes.append(node)
                sizes.append(len(s))
                low = 3 * rule.prefix(len(s)) // 2 + 8
                lows.append(s[:low].tobytes() if len(s) and sent.first(node) else None)
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lows, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "node", "size", "low"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(read, "doc_id long, node long, size int, low binary")


def _unpack(keys: list[str]):
    """Rows of a packed set, its key columns and, for keys with "place", the place of each shingle in the set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = part.column(0).to_pylist()
                sizes = np.array([len(p) // 8 for p in packed], np.int64)
                flat = np.frombuffer(b"".join(packed), np.int64)
                rows = np.repeat(np.arange(len(packed)), sizes)
                places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [pa.array(places) if k == "place" else part.column(1 + i).take(pa.array(rows)) for i, k in enumerate(keys)]
                yield pa.record_batch([pa.array(flat), *columns], ["shingle", *keys])

    return read


def common_shingles(nodes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(shingle, n, rank) of the shingles that stand among the least hashes of more than HOT nodes; written.

    With (node, shingles) of whole sets, shingles that are no node's least but stand in more than
    HOT of these sets are common as well. What was common without them stays so, and no shingle
    that a prefix of rank 0 may hold becomes so.
    """
    entries = nodes.select("low").mapInArrow(_unpack([]), "shingle long").withColumn("low", F.lit(1))
    if sets is not None:
        entries = entries.unionByName(sets.select("shingles").mapInArrow(_unpack([]), "shingle long").withColumn("low", F.lit(0)))
    counts = entries.groupBy("shingle").agg(F.sum("low").alias("low"), F.count("*").alias("n"))
    common = counts.where((F.col("low") > HOT) | ((F.col("low") == 0) & (F.col("n") > HOT)))
    return materialise(common.select("shingle", "n", (F.floor(F.log2("n")) + 1).cast("long").alias("rank")))


def _ranks(packed: DataFrame, common: DataFrame) -> DataFrame:
    """(node, late): for each common shingle of packed (node, shingles), its place * RANKS + its rank.

    The planner broadcasts the common shingles while they are few. Beyond that, those with a large
    share of all entries are met by broadcast still, so no task gets all sets of such a shingle.
    """
    entries = packed.select("shingles", "node").mapInArrow(_unpack(["node", "place"]), "shingle long, node long, place long")
    total = common.agg(F.sum("n")).first()[0] or 0
    heavy = [r.shingle for r in common.where(F.col("n") > F.greatest(F.lit(HOT), F.lit(SHARE * total))).select("shingle").collect()]
    is_heavy = F.col("shingle").isin(heavy)
    met = entries.where(~is_heavy).join(common.where(~is_heavy), "shingle")
    if heavy:
        met = met.unionByName(entries.where(is_heavy).join(F.broadcast(common.where(is_heavy)), "shingle"))
    return met.groupBy("node").agg(F.collect_list(F.col("place") * RANKS + F.col("rank")).alias("late"))


def _prefixes(ranked: DataFrame, rule: Similarity, whole: bool) -> DataFrame:
    """(node, size, prefix, grp) from (node, size, shingles, late).

    Unless sets are whole, a prefix is null that shingles of rank 0 do not fill.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, groups = [], []
            starts = batch.column(3).offsets.to_numpy()
            codes = batch.column(3).values.to_numpy()
            for i, (size, packed) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                s = np.frombuffer(packed, np.uint64)
                late = codes[starts[i] : starts[i + 1]]
                rank = np.zeros(len(s), np.int64)
                rank[late // RANKS] = late % RANKS
                need = rule.prefix(size)
                if not whole and len(s) - len(late) < need:
                    prefixes.append(None)
                    groups.append(None)
                    continue
                prefix = s[np.argsort(rank, kind="stable")][:need]
                prefixes.append(prefix.tobytes())
                groups.append(int(mix(np.array([set_key(prefix)], np.int64).view(np.uint64) + np.uint64(size)).view(np.int64)[0]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prefixes, pa.binary()), pa.array(groups, pa.int64())], ["node", "size", "prefix", "grp"])

    filled = ranked.select("node", "size", "shingles", F.coalesce("late", F.expr("cast(array() as array<bigint>)")).alias("late"))
    return filled.mapInArrow(read, "node long, size int, prefix binary, grp long")


def whole_sets(docs: DataFrame, rule: Similarity, keys: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(node, shingles): the sets of the n nodes in keys, by which few others may come along; written."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(keys, "node", n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        nodes, packed, size = [], [], 0

        def rows() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["node", "shingles"])
            nodes.clear()
            packed.clear()
            return out

        for batch in batches:
            for s in _sets(batch.column(0), rule.n):
                if len(s) and passes(shared.value, node := set_key(s)) and sent.first(node):
                    nodes.append(node)
                    packed.append(s.tobytes())
                    size += s.nbytes
                    if size > _PIECE:
                        yield rows()
                        size = 0
        yield rows()

    return materialise(docs.select(F.col(text).alias("text")).mapInArrow(read, "node long, shingles binary"))


def prefix_groups(docs: DataFrame, nodes: DataFrame, rule: Similarity, text: str = "text") -> DataFrame:
    """(node, size, prefix, grp): each node's prefix, packed, and the key of its group; written.

    nodes is (node, size, low), a row for each node.
    """
    common = common_shingles(nodes)
    least = nodes.withColumnRenamed("low", "shingles")
    found = materialise(_prefixes(least.join(_ranks(least, common), "node", "left"), rule, whole=False))
    discard(common)
    short = found.where("prefix is null").select("node", "size")
    n = short.count()
    if not n:
        return found
    sent = whole_sets(docs, rule, short, n, text)
    sets = materialise(sent.groupBy("node").agg(F.first("shingles").alias("shingles")).join(short, "node"))
    common = common_shingles(nodes, sets)
    rest = _prefixes(sets.join(_ranks(sets, common), "node", "left"), rule, whole=True)
    groups = materialise(found.where("prefix is not null").unionByName(rest))
    discard(common, found, sent, sets)
    return groups


def candidate_edges(groups: DataFrame, rule: Similarity) -> DataFrame:
    """(a, b): pairs of groups, or links to a large bucket's least group, that join candidates; written."""
    single = groups.groupBy("grp").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    entries = materialise(single.select("prefix", "grp", "size").mapInArrow(_unpack(["grp", "size"]), "shingle long, grp long, size int"))
    met = materialise(entries.groupBy("shingle").agg(F.count("*").alias("n"), F.min("grp").alias("least")).where("n > 1"))
    buckets = materialise(entries.join(met, "shingle"))
    small = buckets.where(F.col("n") <= BUCKET)
    left = small.select("shingle", F.col("grp").alias("a"), F.col("size").alias("size_a"))
    right = small.select("shingle", F.col("grp").alias("b"), F.col("size").alias("size_b"))
    sizes = [F.col("size_a").cast("long"), F.col("size_b").cast("long")]
    near = (F.least(*sizes) * rule.denominator) >= (F.greatest(*sizes) * rule.numerator)
    pairs = left.join(right, "shingle").where((F.col("a") < F.col("b")) & near).groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("common"))
    # what the prefixes share and all beyond the shorter reach must be enough; pairs that also meet
    # in large buckets are connected there
    beyond = F.greatest(*(F.ceil(s * rule.numerator / rule.denominator - 1e-9) - 1 for s in sizes))
    enough = (F.col("common") + beyond) * (rule.numerator + rule.denominator) >= (sizes[0] + sizes[1]) * rule.numerator
    large = buckets.where((F.col("n") > BUCKET) & (F.col("grp") != F.col("least"))).select(F.col("grp").alias("a"), F.col("least").alias("b"))
    edges = materialise(pairs.where(enough).select("a", "b").unionByName(large))
    discard(entries, met, buckets)
    return edges


def filter_bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a filter of so many that 64-bit keys set; the keys are hashes, so parts of them will do."""
    unsigned = keys.view(np.uint64)
    return [((unsigned >> np.uint64(i)) % np.uint64(bits)).astype(np.int64) for i in FILTER_SHIFTS]


def key_filter(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A Bloom filter over n 64-bit keys in a column, put together by Spark.

    It has NODE_BITS for each key, in powers of two, and MOST_BITS at most, of which the driver sees
    one row for 64. A filter that is too full lets more sets pass than need be; it holds none back.
    """
    bits = min(MOST_BITS, 1 << max(6, (NODE_BITS * n - 1).bit_length()))
    found = keys.select(F.explode(F.array(*(F.shiftrightunsigned(column, i).bitwiseAND(bits - 1) for i in FILTER_SHIFTS))).alias("bit"))
    words = found.select((F.col("bit") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
    found = words.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["at"].to_numpy()] = found["mask"].to_numpy()
    return out


def passes(words: np.ndarray, key: int) -> bool:
    """Whether the filter may hold a key."""
    return all((int(words[b[0] >> 6]) >> int(b[0] & 63)) & 1 for b in filter_bits(np.array([key], np.int64), len(words) * 64))


def _compare(sets: list[np.ndarray], rule: Similarity) -> np.ndarray:
    """For each set the first of those that links connect it with, among these sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    column = (np.cumsum(shared) - 1)[at]
    keep = shared[at]
    row, column = row[keep], column[keep]
    common = np.zeros((len(sets), len(sets)))
    width, total = max(1, _CELLS // len(sets)), int(shared.sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, total, width):
        i, j = np.searchsorted(column, [begin, begin + width])
        block = np.zeros((len(sets), min(width, total - begin)), np.float32)
        block[row[i:j], column[i:j] - begin] = 1
        common += block @ block.T
    links = rule.linked(common.astype(np.int64), sizes[:, None], sizes[None])
    label = np.arange(len(sets))
    while True:
        least = np.where(links, label[None], len(sets)).min(axis=1)
        least = np.minimum(label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def verified_edges(docs: DataFrame, members: DataFrame, rule: Similarity, text: str = "text") -> DataFrame:
    """(a, b): links between nodes that connect the same nodes as all links; members is (cluster, node, size).

    Clusters of one tile are gathered in jobs of about TILE_BYTES, larger ones compared tile by tile,
    so no group grows with the data.
    """
    spark = docs.sparkSession
    counts = materialise(members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(8 * F.col("size").cast("long")).alias("bytes")).where("n > 1"))
    n, total = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "bytes"))).first()
    members = materialise(members.join(counts, "cluster"))
    sent = whole_sets(docs, rule, members, n, text)
    sets = sent.groupBy("node").agg(F.first("shingles").alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    jobs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TILE_BYTES))
    placed = (
        members.withColumns({"tiles": tiles, "own": F.pmod(F.xxhash64("node"), tiles).cast("int")})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "node", "cluster",
            F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("cluster"), F.lit(jobs))).otherwise(F.col("cluster")).alias("job"),
            (F.col("tiles") > 1).alias("large"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        )
    )

    def compare(group: pa.Table) -> pa.Table:
        cluster = group["cluster"].to_numpy()
        order = np.argsort(cluster, kind="stable")
        nodes, packed = group["node"].to_numpy()[order], group["shingles"]
        cuts = np.flatnonzero(np.diff(cluster[order])) + 1
        a, b = [], []
        for part in np.split(np.arange(len(order)), cuts):
            if len(part) > 1:
                label = _compare([np.frombuffer(packed[int(order[k])].as_py(), np.uint64) for k in part], rule)
                moved = np.flatnonzero(label != np.arange(len(part)))
                a.append(nodes[part[moved]])
                b.append(nodes[part[label[moved]]])
        none = np.empty(0, np.int64)
        return pa.table([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    return placed.join(sets, "node").groupBy("job", "large", "i", "j").applyInArrow(compare, "a long, b long")


def similar_components(docs: DataFrame, rule: Similarity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs; key must be an integer column."""
    sets = materialise(document_sets(docs, rule, key, text))
    nodes = materialise(sets.where("low is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("low").alias("low")))
    placed = materialise(sets.select("doc_id", "node", "size"))
    discard(sets)
    groups = prefix_groups(docs, nodes, rule, text)
    discard(nodes)
    clusters = connected_components(candidate_edges(groups, rule))
    clusters = clusters.select(F.col("node").alias("grp"), "component")
    members = groups.select("grp", "node", "size").join(clusters, "grp", "left")
    members = members.select(F.coalesce("component", "grp").alias("cluster"), "node", "size")
    labels = connected_components(verified_edges(docs, members, rule, text))
    rows = materialise(placed.join(labels, "node", "left").select("doc_id", "size", F.coalesce("component", "node").alias("component")))
    discard(placed, groups)
    least = materialise(rows.where("size > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    linked = join_one(rows.where("size > 0"), least, "component").select("doc_id", "size", "component_id")
    alone = rows.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
