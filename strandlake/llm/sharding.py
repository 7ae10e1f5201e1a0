"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks, the partitions they are read in.  Each block permutes its rows by random numbers and is written to the
shared folder, so block and place of a row are settled whichever task is run again.  How many rows each block sends to each
shard is drawn exactly: a multivariate hypergeometric draw row by row, whose column sums are the wanted shard sizes (at most
one apart).  Each block's permutation is cut at the drawn counts, the rows are exchanged, and each shard permutes what it
gets, in parts by a hash of block and place.  Neither step looks at a row's content, so no key, however frequent, is hot.
Only the blocks' counts, at most MAX_BLOCKS numbers, reach the driver, and what goes back is as large.

Defined cases: nulls are values like others; repeated rows are dealt one by one; an empty table gives an empty result; all
columns pass through, but columns of the input that are named shard or slot are replaced.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import lru_cache
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm._runtime import stored

MAX_BLOCKS, MAX_PARTS = 1 << 18, 1 << 15
#: Stored bytes of a task after the exchange, and parts for each.
TASK_BYTES, PARTS_PER_TASK = 24 << 20, 8
#: Rows from which numpy does not draw.
MANY = 1_000_000_000
#: Digits of the draws beyond that.
DIGITS = 60


@lru_cache(maxsize=1 << 16)
def _log_factorial(n: int) -> Decimal:
    """Within DIGITS digits, by Stirling's series for large numbers."""
    if n < 2_000:
        return Decimal(factorial(n)).ln()
    x = Decimal(n)
    series = [(1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400), (43867, 244188), (-174611, 125400)]
    tail = sum((Decimal(a) / b / x ** (2 * k + 1) for k, (a, b) in enumerate(series)), Decimal(0))
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899")
    return x * x.ln() - x + (2 * pi * x).ln() / 2 + tail


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows, taken without replacement, are good; any population size.

    Beyond numpy's range by inversion outwards from the mode, with numbers of DIGITS digits: what rounding can change has a
    probability below 10^-40.
    """
    if good + bad < MANY:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    with localcontext() as context:
        context.prec = DIGITS

        def choose(n: int, k: int) -> Decimal:
            return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

        p_left = p_right = (choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws)).exp()
        u = Decimal(int.from_bytes(rng.bytes(24), "big")) / (1 << 192) - p_left
        left = right = mode
        while u > 0 and (left > low or right < high):
            if right < high:
                p_right *= Decimal((good - right) * (draws - right)) / ((right + 1) * (bad - draws + right + 1))
                right += 1
                u -= p_right
                if u <= 0:
                    return right
            if left > low:
                p_left *= Decimal(left * (bad - draws + left)) / ((good - left + 1) * (draws - left + 1))
                left -= 1
                u -= p_left
                if u <= 0:
                    return left
    return mode


def _row(rng: np.random.Generator, n: int, left: list[int]) -> list[int]:
    """How many of n rows go to each shard that has `left` places."""
    row, rest = [], sum(left)
    for places in left:
        rest -= places
        row.append(hypergeometric(rng, places, rest, n) if n else 0)
        n -= row[-1]
    return row


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows to send from each block to each shard; rows sum to counts, columns to sizes at most one apart.

    Blocks are first drawn together, in groups below numpy's range, then each within its group's draw: the same law, with few
    draws of large numbers.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    groups: list[list[int]] = []
    size = MANY
    for i, n in enumerate(counts):
        if size + n >= MANY // 2:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += n
    out: list[list[int]] = []
    for group in groups:
        mine = _row(rng, sum(counts[i] for i in group), left)
        left = [a - b for a, b in zip(left, mine)]
        for i in group:
            out.append(_row(rng, counts[i], mine))
            mine = [a - b for a, b in zip(mine, out[-1])]
    return out


def shard_rows(rows: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (the place in the shard, gapless from 0)."""
    rows = rows.drop("shard", "slot")
    spark, columns = rows.sparkSession, rows.columns
    permuted = rows.coalesce(MAX_BLOCKS).withColumn("__sl_random", F.rand(seed)).sortWithinPartitions("__sl_random").drop("__sl_random")
    blocks = stored(permuted.withColumn("__sl_row", F.monotonically_increasing_id()), "shard-blocks")
    block, place = F.shiftright("__sl_row", 33), F.col("__sl_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["b"], r["n"], r["size"]) for r in blocks.select(block.alias("b"), "_metadata.file_size").groupBy("b").agg(F.count("*").alias("n"), F.max("file_size").alias("size")).collect())
    matrix = communication_matrix([n for _, n, _ in counts], shards, seed)
    cuts = spark.createDataFrame([(b, [int(x) for x in np.cumsum(row)]) for (b, _, _), row in zip(counts, matrix)], "__sl_block long, __sl_cuts array<long>")
    tasks = max(1, -(-sum(size for _, _, size in counts) // TASK_BYTES))
    parts = min(MAX_PARTS, max(1, -(-PARTS_PER_TASK * tasks // shards)))
    dealt = blocks.withColumn("__sl_block", block).join(F.broadcast(cuts), "__sl_block")
    dealt = dealt.withColumn("shard", F.size(F.filter("__sl_cuts", lambda c: c <= place)))
    dealt = dealt.withColumns({"__sl_order": F.xxhash64(F.lit(seed), "__sl_row"), "__sl_part": F.pmod(F.xxhash64(F.lit(seed + 1), "__sl_row"), F.lit(parts))}).drop("__sl_block", "__sl_cuts")
    # Where each part of a shard begins: by the row numbers alone, shards x parts numbers.
    sizes = dealt.groupBy("shard", "__sl_part").agg(F.count("*").alias("__sl_n"))
    before = Window.partitionBy("shard").orderBy("__sl_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__sl_part", F.coalesce(F.sum("__sl_n").over(before), F.lit(0)).alias("__sl_before"))
    again = Window.partitionBy("shard", "__sl_part").orderBy("__sl_order", "__sl_row")
    placed = dealt.repartition(int(tasks), "shard", "__sl_part").withColumn("__sl_rank", F.row_number().over(again) - 1).join(F.broadcast(offsets), ["shard", "__sl_part"])
    return placed.withColumn("slot", (F.col("__sl_before") + F.col("__sl_rank")).cast("long")).select(*columns, "shard", "slot")
