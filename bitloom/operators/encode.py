"""Encodings of the compressed form: fixed-width symbols, run lengths, canonical Huffman codes, delta dictionaries."""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig, OutOfRange
from ..layout import bits_needed
from ..plans.tables import running_sum, with_previous

MOST_RUN, MOST_LITERALS, MOST_CODE = 136, 135, 24

# Payload widths of the delta dictionary's tiers.
UNARY_TIERS = (9, 19, 28, 37, 45, 54, 63, 73, 82, 89, 97, 106, 115, 123, 131, 140, 147, 156, 163, 170, 175, 180, 185, 189, 193, 197, 202, 207, 210, 212)
FIXED_TIERS = (1, 3, 5, 6, 7, 9, 11, 12, 14, 15, 17, 19, 20, 22, 24, 26, 28, 29, 31, 33, 35, 37, 39, 41, 43, 45, 47, 49, 51, 54, 57, 60, 63, 65, 68, 71, 73, 76, 79, 82, 85, 88, 91, 94, 97, 100, 104, 107, 111, 115, 119, 123, 128, 133, 140, 145, 150, 156, 162, 170, 177, 187, 197)


def bit_length(x: Column) -> Column:
    """Bits of a non-negative long, 0 of 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def normal_size(n: int, deviation_bits: int, bases: int) -> int:
    """Bits of n rows of deviation and id."""
    return n * (deviation_bits + bits_needed(bases))


def runs(rows: DataFrame, symbol: list[str], key: str, block: Column) -> DataFrame:
    """(block, run, start, length, symbol...): maximal runs of equal symbols within blocks, by gaps and islands."""
    w = Window.partitionBy("block").orderBy(key)
    own = rows.select(key, *symbol, block.alias("block"))
    changed = F.lit(False)
    for s in symbol:
        changed = changed | ~F.col(s).eqNullSafe(F.lag(s).over(w))
    first = F.row_number().over(w) == 1
    marked = own.withColumn("run", F.sum(F.when(first | changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("block", "run").agg(F.min(key).alias("start"), F.count(F.lit(1)).cast("long").alias("length"), *[F.first(s).alias(s) for s in symbol])


def expanded(run_rows: DataFrame, symbol: list[str], key: str) -> DataFrame:
    """The rows of runs again, for keys that count up by one."""
    return run_rows.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias(key), *symbol)


def packets_of(symbols: np.ndarray) -> list[tuple[int, int]]:
    """(R, m) of a block: a run of R + 1 equal symbols if R > 0, then m literals that differ from their successors."""
    out, i, n = [], 0, len(symbols)
    while i < n:
        r = 1
        while i + r < n and r < MOST_RUN and symbols[i + r] == symbols[i]:
            r += 1
        repeat = 0
        if r >= 2:
            repeat, i = r - 1, i + r
        m = 0
        while i < n and m < MOST_LITERALS and (i + 1 >= n or symbols[i] != symbols[i + 1]):
            m, i = m + 1, i + 1
        out.append((repeat, m))
    return out


def packets(rows: DataFrame, symbol: list[str], key: str, block: Column) -> DataFrame:
    """(block, packet, repeat, literals) of every block; a block is a grid row or 1024 rows, so groups are small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        codes = pd.factorize(pd.MultiIndex.from_frame(pdf[symbol]))[0] if len(symbol) > 1 else pdf[symbol[0]].to_numpy()
        got = packets_of(codes)
        return pd.DataFrame({"block": pdf["block"].iloc[0], "packet": np.arange(len(got), dtype=np.int64), "repeat": [g[0] for g in got], "literals": [g[1] for g in got]})

    return rows.select(key, *symbol, block.cast("long").alias("block")).groupBy("block").applyInPandas(run, "block long, packet long, repeat long, literals long")


def rle_size(packet_rows: DataFrame, symbol_bits: int) -> DataFrame:
    """(blocks, packets, symbols, bits): 64 bits, two offsets of 32 per block, 4 or 8 control bits per number, and the symbols."""
    control = lambda c: F.when(F.col(c) <= 7, 4).otherwise(8)
    symbols = F.col("literals") + F.when(F.col("repeat") > 0, 1).otherwise(0)
    out = packet_rows.agg(F.countDistinct("block").cast("long").alias("blocks"), F.count(F.lit(1)).cast("long").alias("packets"), F.coalesce(F.sum(symbols), F.lit(0)).cast("long").alias("symbols"), F.coalesce(F.sum(control("repeat") + control("literals")), F.lit(0)).cast("long").alias("control"))
    return out.select("blocks", "packets", "symbols", (F.lit(64) + 64 * F.col("blocks") + F.col("control") + F.col("symbols") * symbol_bits).alias("bits"))


def huffman_lengths(frequencies: dict[int, int]) -> dict[int, int]:
    """Code lengths; of equal weights the node with the smaller smallest symbol, then the older one, is taken first."""
    if not frequencies:
        return {}
    if len(frequencies) == 1:
        return {next(iter(frequencies)): 1}
    heap = [(n, s, i) for i, (s, n) in enumerate(sorted(frequencies.items()))]
    members = [[s] for s, _ in sorted(frequencies.items())]
    length = dict.fromkeys(frequencies, 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, s, i), (m, t, j) = heapq.heappop(heap), heapq.heappop(heap)
        members.append(members[i] + members[j])
        for x in members[-1]:
            length[x] += 1
        heapq.heappush(heap, (n + m, min(s, t), len(members) - 1))
    if max(length.values()) > MOST_CODE:
        raise OutOfRange(f"a code of over {MOST_CODE} bits")
    return length


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (length, code), counting up by length and symbol."""
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s] = n, code
        code, last = code + 1, n
    return out


def huffman_codes(rows: DataFrame, value: str = "base_id") -> DataFrame:
    """(value, count, length, code). The dictionary, which is as small as the selection makes it, reaches the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(value).count().collect()}
    table = canonical(huffman_lengths(counts))
    return rows.sparkSession.createDataFrame([(s, counts[s], n, c) for s, (n, c) in sorted(table.items())], f"`{value}` long, count long, length int, code long")


def huffman_size(codes: DataFrame, blocks: int, deviation_bits: int) -> DataFrame:
    """(n, bases, code_bits, bits): 64 bits, an offset of 32 per block, the table, the deviations and the codes."""
    a = codes.agg(F.sum("count").cast("long").alias("n"), F.count(F.lit(1)).cast("long").alias("bases"), F.sum(F.col("count") * F.col("length")).cast("long").alias("code_bits"))
    ids = F.greatest(F.lit(1), bit_length(F.col("bases") - 1))
    return a.select("n", "bases", "code_bits", (F.lit(64 + 32 * blocks) + F.col("bases") * (ids + 5) + F.col("n") * deviation_bits + F.col("code_bits")).cast("long").alias("bits"))


def deltas(bases: DataFrame, key: str = "k0", group: str | None = None) -> DataFrame:
    """bases with ``delta`` = previous - this - 1 in descending key order (of a group's rows, or of all); null of the first.

    Keys are words of up to 62 bits; equal keys are an error. The global order is range-partitioned.
    """
    if group:
        own = bases.withColumn("_before", F.lag(key).over(Window.partitionBy(group).orderBy(F.col(key).desc())))
    else:
        own = with_previous(bases, [F.col(key).desc()], key, "_before")
    d = F.col("_before") - F.col(key) - 1
    return own.withColumn("delta", F.when(d < 0, F.raise_error(F.lit("equal keys in a delta dictionary")).cast("long")).otherwise(d)).drop("_before")


def tiered(delta_rows: DataFrame, unary: bool, overflow_bits: int) -> DataFrame:
    """(delta, bits, tier, size): the first tier that holds a delta's bits, with its prefix and payload."""
    tiers = UNARY_TIERS if unary else FIXED_TIERS
    n = bit_length(F.col("delta"))
    tier, payload = F.lit(len(tiers)), F.lit(overflow_bits)
    for i in range(len(tiers) - 1, -1, -1):
        tier, payload = F.when(n <= tiers[i], i).otherwise(tier), F.when(n <= tiers[i], tiers[i]).otherwise(payload)
    prefix = F.when(F.col("tier") < len(tiers), F.col("tier") + 1).otherwise(len(tiers)) if unary else F.lit(6)
    own = delta_rows.where("delta is not null").select("delta", n.alias("bits"), tier.cast("int").alias("tier"), payload.alias("payload"))
    return own.select("delta", "bits", "tier", (prefix + F.col("payload")).cast("long").alias("size"))


def undelta(rows: DataFrame, first: int, order: str = "rank") -> DataFrame:
    """Keys again: the first one minus the running sum of delta + 1."""
    summed = running_sum(rows, [F.col(order)], F.col("delta") + 1, "_s")
    return summed.withColumn("key", F.lit(first) - F.col("_s")).drop("_s")


def bit_length_histogram(delta_rows: DataFrame) -> DataFrame:
    """(bits, count, cumulative_pct, cumulative_bits_pct) of the bit lengths (1 at least) of deltas."""
    n = F.greatest(F.lit(1), bit_length(F.col("delta")))
    counts = delta_rows.where("delta is not null").groupBy(n.cast("int").alias("bits")).agg(F.count(F.lit(1)).cast("long").alias("count"))
    up, every = Window.orderBy("bits").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    weight = F.col("count") * F.col("bits")
    return counts.select("bits", "count", (100 * F.sum("count").over(up) / F.sum("count").over(every)).alias("cumulative_pct"), (100 * F.sum(weight).over(up) / F.sum(weight).over(every)).alias("cumulative_bits_pct"))


def best_tiers(histogram: dict[int, int], tiers: int, unary: bool, prefix_bits: int = 6, terminator: bool = True) -> tuple[list[int], int]:
    """The widths of ``tiers`` tiers that encode a histogram of bit lengths in the fewest bits, and these bits.

    Dynamic programming over the distinct lengths: the last i tiers cover the lengths up to one of them.
    """
    if tiers < 1 or not histogram:
        raise InvalidConfig("one tier and one length at least")
    lengths = sorted(histogram)
    total = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths])])
    tiers = min(tiers, len(lengths))
    best: dict[tuple[int, int], tuple[int, tuple]] = {(0, 0): (0, ())}
    for t in range(1, tiers + 1):
        prefix = (t - 1 + (1 if terminator else 0)) if unary else prefix_bits
        for e in range(t, len(lengths) + 1):
            options = [(best[t - 1, s][0] + int(total[e] - total[s]) * (prefix + lengths[e - 1]), best[t - 1, s][1] + (lengths[e - 1],)) for s in range(t - 1, e) if (t - 1, s) in best]
            best[t, e] = min(options)
    done = [best[t, len(lengths)] for t in range(1, tiers + 1) if (t, len(lengths)) in best]
    bits, widths = min(done, key=lambda x: (x[0], len(x[1])))
    return list(widths), bits


def knee(costs: list[int]) -> int:
    """The index of the curve that lies farthest below the line from its first to its last point."""
    n = len(costs)
    if n < 3 or costs[0] == costs[-1]:
        return 0
    return max(range(n), key=lambda i: (costs[0] + (costs[-1] - costs[0]) * i / (n - 1) - costs[i], -i))


def tier_of(bits: int, widths: list[int]) -> int:
    """The first width that holds so many bits, or the number of widths."""
    return bisect.bisect_left(widths, bits)
