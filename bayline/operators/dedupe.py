"""Leakage checks, near-duplicate joins and quarantine across partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bayline.functions.hashing import bits64, hamming_hex64, masked_keys
from bayline.operators.spool import written


def leaking_keys(rows: DataFrame, key: str, partition: str) -> DataFrame:
    """Keys that stand in more than one partition, with those partitions."""
    seen = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(partition)).alias("partitions"))
    return seen.where(F.size("partitions") > 1)


def exposure_guard(rows: DataFrame, exposed: DataFrame, group: list[str], digest: str) -> DataFrame:
    """Rows whose digest is not exposed and whose group has no exposed row.

    A group counts as exposed if exposed names it or one of its own rows has an exposed digest.
    """
    digests = exposed.select(digest).where(F.col(digest).isNotNull()).distinct()
    hit = rows.join(digests, digest, "left_semi").select(*group)
    groups = exposed.select(*group).union(hit).distinct()
    return rows.join(digests, digest, "left_anti").join(groups, group, "left_anti")


#: Blocks that hashes are cut into, where not twice the bits: keys for one bit have 60 bits, so at most 16 hashes share one.
BLOCKS = {1: 16}


def near_hashes(hashes: DataFrame, hashed: str, most: int = 3) -> DataFrame:
    """(x, y, distance): pairs of distinct 64-bit hashes, x < y, that differ in at most most bits.

    Distinct hashes meet by every key that so many differing bits leave untouched, so none is missed.
    For one bit the pairs that meet are at most 120 times the hashes, whatever the texts. Else keys
    have about 32 bits, by which hashes that have nothing to do with each other rarely meet.
    """
    keyed = _keyed(hashes, hashed, most)
    x, y = (keyed.select("band", "value", F.col("h").alias(name), F.col("bits").alias(f"{name}_bits")) for name in ("x", "y"))
    near = x.join(y, ["band", "value"]).withColumn("distance", F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits"))))
    return near.where((F.col("distance") <= most) & (F.col("x") < F.col("y"))).select("x", "y", "distance").distinct()


def _keyed(hashes: DataFrame, hashed: str, most: int) -> DataFrame:
    """(h, bits, band, value) of the distinct well-formed hashes."""
    distinct = hashes.select(F.lower(hashed).alias("__lower"), F.col(hashed).alias("h")).where(F.col("__lower").rlike("^[0-9a-f]{16}$")).distinct()
    return distinct.select("h", bits64(F.col("__lower")).alias("bits")).select("h", "bits", F.inline(masked_keys(F.col("bits"), most, BLOCKS.get(most))))


def hashes_near(rows: DataFrame, known: DataFrame, hashed: str, most: int = 3) -> DataFrame:
    """The distinct hashes of rows that lie within most bits of one of known."""
    met = _keyed(rows, hashed, most).alias("a").join(_keyed(known, hashed, most).alias("b"), ["band", "value"])
    return met.where(F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= most).select(F.col("a.h").alias(hashed)).distinct()


def hamming_classes(rows: DataFrame, key: str, hashed: str, most: int = 3) -> DataFrame:
    """(a, b, distance): for each class of equal hashes its least key with each other member, and pairs of near classes by their least keys.

    Rows without a hash are in no class.
    """
    known = rows.where(F.col(hashed).isNotNull()).select(F.col(hashed).alias("h"), F.col(key).alias("b"))
    least = known.groupBy("h").agg(F.min("b").alias("a"))
    members = known.join(least, "h").where("a < b").select("a", "b", F.lit(0).alias("distance")).distinct()
    near = near_hashes(least, "h", most).join(least.select(F.col("h").alias("x"), F.col("a").alias("k")), "x").join(least.select(F.col("h").alias("y"), F.col("a").alias("l")), "y")
    return members.unionByName(near.select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"), "distance"))


#: Words that are summed together, and distinct words whose hashes a task keeps.
WORDS, KNOWN = 1 << 16, 1 << 18


class _WordHashes(dict):
    """The first 64 bits of words' MD5."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = int.from_bytes(md5(word, usedforsecurity=False).digest()[:8], "big")
        return found


def _simhashes(texts: Iterable[bytes | None], known: _WordHashes) -> list[str | None]:
    """The SimHash of each text in hex; null for one without a word."""
    sums: list[np.ndarray] = []
    counts, owners, waiting, held = [], [], [], 0

    def add() -> None:
        hashes, owner = np.concatenate(waiting), np.concatenate(owners)
        for lo in range(0, len(hashes), WORDS):
            of = owner[lo : lo + WORDS]
            bits = np.unpackbits(hashes[lo : lo + WORDS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            within = np.arange(len(of)) - np.repeat(begins, np.diff(begins, append=len(of)))
            runs = np.flatnonzero(within % 255 == 0)  # eight counters of a byte share a number
            parts = np.add.reduceat(bits.view(np.uint64), runs, axis=0).view(np.uint8)
            firsts = np.flatnonzero(np.diff(of[runs], prepend=-1))
            for text, part in zip(of[runs][firsts].tolist(), np.add.reduceat(parts, firsts, axis=0, dtype=np.int64), strict=True):
                sums[text] = part if sums[text] is None else sums[text] + part
        waiting.clear()
        owners.clear()

    for i, text in enumerate(texts):
        words = text.split() if text else []  # of bytes, at the blanks that \s names
        sums.append(None)
        counts.append(len(words))
        if words:
            waiting.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            owners.append(np.full(len(words), i))
            held += len(words)
        if held >= WORDS:
            add()
            held = 0
    if held:
        add()
    return [None if s is None else np.packbits(2 * s > n).tobytes().hex() for s, n in zip(sums, counts, strict=True)]


def with_simhash(rows: DataFrame, text: str) -> DataFrame:
    """rows without text but with digest, its SHA-256, and hash, the 64-bit SimHash over the words of the whole text.

    A bit is set where more than half of a text's words, repeated ones each time, have it set in
    their hashes, the first 64 bits of the words' MD5. Texts without a word have no hash. Rows are
    dealt over all tasks first, whatever files they come from; words never leave the task.
    """
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartition("__row")
    plain = dealt.select(*(c for c in rows.columns if c != text), F.sha2(text, 256).alias("digest"), F.lower(text).cast("binary").alias("hash"))
    fields = [f for f in plain.schema.fields if f.name != "hash"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            at = batch.schema.get_field_index("hash")
            found = pa.array(_simhashes((v.as_py() for v in batch.column(at)), known), pa.string())
            yield batch.set_column(at, "hash", found)

    return plain.mapInArrow(hashed, StructType([*fields, StructField("hash", StringType())]))


def simhash(rows: DataFrame, text: str) -> DataFrame:
    """(digest, hash) of each distinct text that has a word; see with_simhash()."""
    return with_simhash(rows.select(text), text).where("hash is not null").select("digest", "hash").distinct()


def first_partition_wins(rows: DataFrame, digest: str, partition: str, rank: Mapping[str, int]) -> DataFrame:
    """Rows of equal digest stay in their first partition by rank only; rows without a digest all stay.

    Partitions that rank lacks come last.
    """
    ranks = [F.lit(x) for pair in rank.items() for x in pair]
    order = F.coalesce(F.try_element_at(F.create_map(*ranks), F.col(partition)), F.lit(max(rank.values()) + 1))
    ranked = rows.where(F.col(digest).isNotNull()).withColumn("__rank", order)
    least = ranked.groupBy(digest).agg(F.min("__rank").alias("__rank"))
    return ranked.join(least, [digest, "__rank"]).select(rows.columns).unionByName(rows.where(F.col(digest).isNull()))


def quarantine(rows: DataFrame, key: str, digest: str, hashed: str, partition: str, order: tuple[str, ...] = ("holdout", "validation", "train"), most: int = 3) -> DataFrame:
    """rows with kept, conflict_partition and conflict_id: a row goes if a kept row of an earlier partition has its digest or a hash within most bits.

    The conflict is with the last kept row of the digest, else with the first kept row, by
    partition and key, of a near hash. Rows of one partition never conflict, so a pass for each
    partition decides as a walk over all rows in order of partition and key would. Distinct
    digests and hashes are compared, never pairs of rows; rows and near hashes are written first. Rows of partitions that order lacks are not kept.
    """
    rows = written(rows)  # read once for each step
    near = near_hashes(rows, hashed, most)
    own = rows.select(F.col(hashed).alias("x"), F.col(hashed).alias("y")).distinct().where(hamming_hex64(F.col("x"), F.col("y")) <= most)
    near = written(near.select("x", "y").union(near.select("y", "x")).union(own))
    named = lambda rank: F.struct(F.lit(rank).alias("rank"), F.col(key).alias("id"), F.lit(order[rank]).alias("partition"))
    nothing = F.lit(None).cast("string")
    other = rows.where(~F.coalesce(F.col(partition).isin(*order), F.lit(False)))
    out = other.select(*rows.columns, F.lit(False).alias("kept"), nothing.alias("conflict_partition"), F.lit(None).cast(rows.schema[key].dataType).alias("conflict_id"))
    taken = close = None  # the rows kept so far, by digest and by hash
    for rank, name in enumerate(order):
        part = rows.where(F.col(partition) == name)
        if taken is None:
            part = part.select(*rows.columns, F.lit(True).alias("kept"), nothing.alias("conflict_partition"), F.lit(None).cast(rows.schema[key].dataType).alias("conflict_id"))
        else:
            by_hash = near.join(close.withColumnRenamed(hashed, "y"), "y").groupBy(F.col("x").alias(hashed)).agg(F.min("__near").alias("__near"))
            marked = part.join(taken, digest, "left").join(by_hash, hashed, "left").withColumn("__conflict", F.coalesce("__same", "__near"))
            part = marked.select(*rows.columns, F.col("__conflict").isNull().alias("kept"), F.col("__conflict.partition").alias("conflict_partition"), F.col("__conflict.id").alias("conflict_id"))
        kept = part.where("kept")
        same = kept.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.max(named(rank)).alias("__same"))
        least = kept.where(F.col(hashed).isNotNull()).groupBy(hashed).agg(F.min(named(rank)).alias("__near"))
        taken = same if taken is None else taken.unionByName(same)
        close = least if close is None else close.unionByName(least)
        out = out.unionByName(part)
    return out


def first_source_wins(*sources: DataFrame, key: list[str]) -> DataFrame:
    """The union of relations; of rows with equal keys that of the first relation stays."""
    tagged = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    first = F.min_by(F.struct(*union.columns), "__source")
    return union.groupBy(*key).agg(first.alias("__row")).select("__row.*").drop("__source")
