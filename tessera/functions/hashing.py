"""FNV-1a hashes and a Bloom filter, in built-in functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of FNV-1a 64: offset basis 14695981039346656037 as two halves, prime 2^40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 3421674724, 2216829733, 435
MASK = 0xFFFFFFFF


def fnv1a_hex(data: Column) -> Column:
    """FNV-1a 64 of the bytes of a string column, as 16 hexadecimal digits."""
    return fnv1a_of_bytes(F.encode(data, "UTF-8"))


def fnv1a_of_bytes(data: Column) -> Column:
    """FNV-1a 64 of a binary column. Two 32-bit halves keep every product within a BIGINT."""
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1))), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    octets = F.when(F.octet_length(data) > 0, octets).otherwise(F.array().cast("array<bigint>"))

    def step(state, octet):
        x = state["lo"].bitwiseXOR(octet)
        product = x * PRIME_LOW
        high = state["hi"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), product.bitwiseAND(F.lit(MASK)).alias("lo"))

    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("hi"), F.lit(BASIS_LOW).cast("long").alias("lo"))
    done = F.aggregate(octets, start, step)
    return F.lower(F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0")))


def namespace_id(repository: Column, commit: Column) -> Column:
    return fnv1a_hex(F.concat(repository, F.lit("::"), commit))


def record_key(namespace: Column, kind: Column, name: Column) -> Column:
    """FNV-1a 64 of a namespace's identifier (16 hexadecimal digits, as 8 bytes, the high ones first), kind and name."""
    return fnv1a_of_bytes(F.concat(F.unhex(namespace), F.encode(F.concat(F.lit("::"), kind, F.lit("::"), name), "UTF-8")))


@dataclass(frozen=True)
class BloomSize:
    bits: int
    hashes: int


def bloom_size(items: int, rate: float) -> BloomSize:
    bits = max(64, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return BloomSize(bits, max(1, min(20, math.ceil(bits / max(1, items) * math.log(2)))))


def _positions(key: Column, size: BloomSize) -> Column:
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit("salt"))
    first, step = F.pmod(h1, F.lit(size.bits)), F.pmod(h2, F.lit(size.bits))
    return F.array(*[F.pmod(first + F.lit(i) * step, F.lit(size.bits)) for i in range(size.hashes)])


def bloom_build(keys: DataFrame, size: BloomSize, key: str = "key") -> DataFrame:
    """The filter as a table of (word, bits): 64 bits a row, built by partial sums."""
    at = keys.select(F.explode(_positions(F.col(key), size)).alias("at"))
    return at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def bloom_test(rows: DataFrame, bloom: DataFrame, size: BloomSize, key: str = "key") -> DataFrame:
    """Distinct keys with ``may_contain``. The filter stays a table: each position meets its word by a
    join, whatever the filter's size."""
    at = rows.select(key).distinct().select(key, F.explode(F.array_distinct(_positions(F.col(key), size))).alias("at"))
    at = at.select(key, F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    hit = at.join(bloom, "word", "left").withColumn("hit", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)))
    return hit.groupBy(key).agg(F.bool_and("hit").alias("may_contain"))
