"""Hash-decided order, buckets, keys and Hamming distances."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F


def score(key: Column, seed: str | int) -> Column:
    """The SHA-256 of seed|key in hex; its order is that of the 256-bit number."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def hex_mod(digits: Column, modulus: int) -> Column:
    """A hexadecimal number modulo a small one, folded eight digits at a time."""
    step = 16**8 % modulus
    parts = [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    return reduce(lambda a, p: (a * step + p) % modulus, parts, F.lit(0).cast("long"))


def score_mod(key: Column, seed: str | int, modulus: int) -> Column:
    """score() modulo a number."""
    return hex_mod(score(key, seed), modulus)


def content_key(content: Column, digits: int) -> Column:
    """The first hexadecimal digits of the SHA-256 of content."""
    return F.substring(F.sha2(content, 256), 1, digits)


def hamming_hex64(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; 64 where either is malformed or null."""
    half = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    bits = sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)), F.lit(0))
    fine = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(fine, bits).otherwise(F.lit(64)).cast("int")


def bits64(h: Column) -> Column:
    """A 16-digit hexadecimal hash as the long of the same bits."""
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def masked_keys(bits: Column, most: int, blocks: int | None = None) -> Column:
    """Keys of a 64-bit hash, given as a long, array of (band, value), of which hashes at most most bits apart share one.

    The 64 bits are cut into blocks and every choice of all but most of them, with zeros for the
    others, is a key: most differing bits touch at most as many blocks, so the rest is left
    untouched. Without a number there are 2 * most blocks, and keys of about 32 bits. With most = 0
    the hash itself is the one key.
    """
    blocks = blocks or 2 * most or 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << 64 - a) - (1 << 64 - b) for a, b in pairwise(edges)]  # counted from the left
    masks = [sum(kept) for kept in combinations(parts, blocks - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*(F.struct(F.lit(i).alias("band"), bits.bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(signed)))


def hash_keys(h: Column, most: int, blocks: int | None = None) -> Column:
    """masked_keys() of a hash in hex."""
    return masked_keys(bits64(h), most, blocks)


def partition_70_15_15(key: Column, seed: str | int) -> Column:
    """train, validation or test by hash in the shares 70, 15 and 15 per cent."""
    m = score_mod(key, seed, 100)
    return F.when(m < 70, "train").when(m < 85, "validation").otherwise("test")


def camera_split(dataset: Column, source_id: Column, partition: Column, seed: str | int, held_of_1000: int = 150) -> Column:
    """One of four splits that keep a camera's images apart from unseen cameras'.

    Validation and holdout sources are of unseen cameras. Every image of ACPDS is a camera of its
    own, so it trains; of other cameras' images a share by hash is held out.
    """
    return (
        F.when(partition == "validation", "val_unseen")
        .when(partition == "holdout", "test_unseen")
        .when(dataset == "ACPDS", "train")
        .when(score_mod(source_id, seed, 1000) < held_of_1000, "val_known")
        .otherwise("train")
    )
