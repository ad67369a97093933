"""URL filter: a blocked Bloom filter of listed canonical addresses in front of an exact hash join.

Everything is a Spark expression; there is no Python on the path of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter per listed entry, and entries of a block of 256 bits that follow from it.
BITS_PER_ENTRY = 16
BLOCK_BITS = 256
#: Bits set per entry, each from another byte of a second hash.
PROBES = 8


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """Four words of 64 bits with PROBES bits set, from a second hash of the key."""
    second = F.xxhash64(key, F.lit("second"))
    words = []
    for w in range(4):
        bits = [
            F.call_function(
                "shiftleft", F.lit(1).cast("long"),
                F.shiftrightunsigned(second, 6 * (w * PROBES // 4 + j)).bitwiseAND(63).cast("int"),
            )
            for j in range(PROBES // 4)
        ]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows (block, words) from one column ``key``; empty blocks have no row."""
    marked = keys.select(_place(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("m"))
    return marked.groupBy("block").agg(F.array(*[F.bit_or(F.col("m")[w]) for w in range(4)]).alias("words"))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with its host, path, the rule that decides and the verdict.

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and all subdomains if the address's path
    starts with the rule's path; the longest fitting rule wins.  Listed addresses are rules with their whole path, so a
    block list of millions of addresses works the same way.  Candidates of an address are its host suffixes with its path
    cut to the lengths that rules have; the filter drops those that are surely not listed, what passes is joined with the
    rules exactly.  Addresses without a rule get ``default``.

    Null or text without :// gives an empty host and path (no rule fits, unless one has an empty host).  Repeated and
    tied rows are kept as they are; of equal rules with different verdicts block wins; columns other than the key and the
    address are not read.  An empty table gives an empty result, no rules give the default everywhere.
    """
    listed = (
        rules.select(F.lower("host").alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.lower("verdict").alias("v"))
        .where(F.col("h").isNotNull())
        .select(F.concat("h", F.lit(" "), "p").alias("key"), F.concat("h", "p").alias("rule"), "v")
        .groupBy("key", "rule")
        .agg(F.max("v").alias("v"))
    )
    # one number and the distinct path lengths (at most the longest address) come to the driver
    facts = listed.agg(
        F.count("*").alias("n"), F.collect_set(F.length("key") - F.instr("key", " ")).alias("lengths")
    ).first()
    blocks = max(1, math.ceil(facts["n"] * BITS_PER_ENTRY / BLOCK_BITS))
    lengths = sorted(facts["lengths"])
    own = pages.select(F.col(key).alias("_id"), F.col(url).cast("string").alias("_url")).select(
        "_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    if not lengths:
        return own.select(
            F.col("_id").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1))
    )
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.concat(s, F.lit(" "), F.substring(F.col("path"), F.lit(1), n))))
    )
    known = bloom_blocks(listed.select("key"), blocks)
    # each different address probes its blocks; Spark sends the filter to all tasks while it is small, else both are shuffled
    probes = own.select("host", "path", F.explode(keys).alias("key")).distinct()
    probes = probes.select("*", _place(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("mask"))
    fits = [F.col("words")[w].bitwiseAND(F.col("mask")[w]) == F.col("mask")[w] for w in range(4)]
    hits = probes.join(known, "block").where(fits[0] & fits[1] & fits[2] & fits[3]).select("host", "path", "key")
    decided = (
        hits.join(listed.hint("shuffle_hash"), "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("v"), F.col("rule"))).alias("best"))
        .select("host", "path", "best.rule", F.col("best.v").alias("verdict"))
    )
    out = own.join(decided, ["host", "path"], "left")
    return out.select(F.col("_id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
