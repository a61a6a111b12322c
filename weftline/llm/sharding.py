"""Operator 6, sharding by a k-d tree. DataFrame operations only.

A node with k leaves is cut along its widest metadata dimension at the weighted quantile floor(k/2)/k, so that all
leaves get nearly the same bytes whatever their number. Dimensions are scaled to 0..1 over the whole table; the widest
is the one with the largest range inside the node. A cut is found by distributed histograms: one aggregation a level
counts bytes in ``BINS`` bins of every node, the bin that holds the quantile is cut into bins again, until the error
is below ``tolerance`` of a leaf. Ties in a dimension are spread by a hash of the text and then of the id, so copies of
a text stay side by side and a group that is larger than a leaf can still be cut.

Rows are whole, so cuts miss their goals by up to a row, and rows may be large beside a leaf. At the end leaves are evened
out: the rows of a leaf are hashed to bins, and the heaviest or the lightest leaf exchanges bins with another, each time
those that come nearest to the middle, until nothing helps or ``SLACK`` of a leaf is reached.

The driver sees nodes x bins sums at most. Slots are numbered by two levels: rows are numbered inside small buckets of
a shard, buckets are offset by running counts, so no task sorts a whole shard.

A level's rows are checkpointed, so no level is computed twice.

Defined results: a null text has size ``OVERHEAD`` and checksum 0; null metadata count as the empty string; rows with
equal ids get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpointed

OVERHEAD = 16
BINS = 512
BUCKET_ROWS = 250_000
EVEN_SUMS, EVEN_MOVES, PARTNERS, SLACK = 200_000, 2000, 40, 0.001


def _unit(column) -> F.Column:
    """A column's 64-bit hash as a number from 0 to 1."""
    return (F.shiftrightunsigned(F.xxhash64(column), 12)).cast("double") / F.lit(float(1 << 52))


def _inline(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table as SQL literals: no Python runs on the executors."""
    text = ", ".join("(" + ", ".join(f"CAST('{x!r}' AS DOUBLE)" if isinstance(x, float) else str(int(x)) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")


def _dimensions(docs: DataFrame) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_text"), F.coalesce("source", F.lit("")).alias("_source"), F.coalesce("lang", F.lit("")).alias("_lang"))
    # a tie is spread inside a millionth of the range, first by text, then by id
    spread = (_unit(F.col("_text")) + _unit(F.struct("doc_id", "_text")) / 1e6) / 1e6
    return rows.select("doc_id", "size", "text_crc32", F.array(F.log2("size") / 40.0 + spread, _unit(F.col("_source")) * 0.5 + spread, _unit(F.col("_lang")) * 0.25 + spread).alias("_at"))


def kd_shards(docs: DataFrame, target_bytes: int | None = None, n_shards: int | None = None, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32 and the shard of each row; give the bytes of a leaf or the number of leaves."""
    spark = docs.sparkSession
    rows = checkpointed(_dimensions(docs))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    leaves = n_shards or max(1, -(-total // target_bytes))
    nodes = {0: (leaves, 0)}  # node -> number of leaves, first leaf
    rows = rows.withColumn("_node", F.lit(0))
    slack = tolerance * total / leaves
    fresh = 1
    while any(k > 1 for k, _ in nodes.values()) and total:
        cut = {n: v for n, v in nodes.items() if v[0] > 1}
        open_rows = rows.where(F.col("_node").isin([int(n) for n in cut])) if len(cut) < 200 else rows
        ranges = open_rows.groupBy("_node").agg(F.sum("size"), *[f(F.col("_at")[d]) for d in range(3) for f in (F.min, F.max)]).collect()
        state, done = {}, {}
        for node, weight, *ends in ranges:
            if node in cut:
                dim = max(range(3), key=lambda d: ends[2 * d + 1] - ends[2 * d])
                state[node] = [dim, ends[2 * dim], ends[2 * dim + 1], 0.0, weight * (cut[node][0] // 2) / cut[node][0]]
        for node in cut.keys() - state.keys():
            done[node] = (0, 0.0)
        for _ in range(8):
            if not state:
                break
            plan = F.broadcast(_inline(spark, [(n, float(s[1]), float(s[2]), s[0]) for n, s in state.items()], ["_node", "_lo", "_hi", "_dim"]))
            value = F.element_at("_at", F.col("_dim") + 1)
            bin_ = F.least(F.lit(BINS - 1), F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)).cast("int")
            sums = rows.join(plan, "_node").where((value >= F.col("_lo")) & (value <= F.col("_hi"))).groupBy("_node", F.when(F.col("_hi") > F.col("_lo"), bin_).otherwise(0).alias("_bin")).agg(F.sum("size").alias("w"), F.min(value).alias("a"), F.max(value).alias("b")).collect()
            by: dict[int, list] = {}
            for node, b, w, lo, hi in sums:
                by.setdefault(node, []).append((b, w, lo, hi))
            for node, found in by.items():
                dim, _, _, before, goal = state[node]
                found.sort()
                for _, w, lo, hi in found:
                    if before + w >= goal - slack / 2:
                        break
                    before += w
                # cut after this bin, before it, or look inside it
                if abs(before + w - goal) <= slack or lo == hi:
                    done[node] = (dim, hi) if lo != hi or before + w - goal <= goal - before else (dim, lo - abs(lo) * 1e-15 - 1e-18)
                    del state[node]
                else:
                    state[node] = [dim, lo, hi, before, goal]
        done |= {n: (s[0], (s[1] + s[2]) / 2) for n, s in state.items()}
        table, after = [], {n: v for n, v in nodes.items() if n not in cut}
        for node, (dim, at) in done.items():
            k, first = cut[node]
            after |= {fresh: (k // 2, first), fresh + 1: (k - k // 2, first + k // 2)}
            table.append((node, dim, float(at), fresh, fresh + 1))
            fresh += 2
        nodes = after
        step = F.broadcast(_inline(spark, table, ["_node", "_dim", "_cut", "_low", "_high"]))
        rows = rows.join(step, "_node", "left").select("doc_id", "size", "text_crc32", "_at", F.when(F.col("_dim").isNull(), F.col("_node")).when(F.element_at("_at", F.col("_dim") + 1) <= F.col("_cut"), F.col("_low")).otherwise(F.col("_high")).alias("_node"))
        rows = checkpointed(rows)
    last = F.broadcast(_inline(spark, [(n, first) for n, (_, first) in nodes.items()], ["_node", "shard"]))
    return _evened(rows.join(last, "_node").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")), leaves)


def exchange(sums: list[tuple[int, int, int]], leaves: int, slack: float = SLACK, moves: int = EVEN_MOVES) -> list[tuple[int, int, int]]:
    """(shard, bin, new shard) for bins that go from heavy to light shards. ``sums`` has (shard, bin, weight)."""
    held: list[list[tuple[int, int, int]]] = [[(0, -1, -1)] for _ in range(leaves)]  # the first stands for no bin
    for shard, bin_, weight in sums:
        held[shard].append((weight, shard, bin_))
    for x in held:
        x.sort()
    total = [sum(w for w, *_ in x) for x in held]
    moved: dict[tuple[int, int], int] = {}
    least = slack * sum(total) / leaves

    def best(high: int, low: int) -> tuple[int, int] | None:
        """The bin of one and the bin of the other, or none, whose exchange comes nearest to the middle."""
        half = (total[high] - total[low]) / 2
        own, other = (np.array([w for w, *_ in held[k]], np.float64) for k in (high, low))
        at = np.searchsorted(other, own - half)
        pairs = [(abs(own - other[k] - half), k) for k in (np.maximum(at - 1, 0), np.minimum(at, len(other) - 1))]
        missed = np.minimum(pairs[0][0], pairs[1][0])
        i = int(np.argmin(missed))
        if 2 * half <= least or missed[i] > 0.9 * half:
            return None
        return i, int(pairs[0][1][i] if pairs[0][0][i] <= pairs[1][0][i] else pairs[1][1][i])

    for _ in range(moves):
        order = sorted(range(leaves), key=lambda k: (total[k], k))
        tried = [(order[-1], k) for k in order[:PARTNERS] if k != order[-1]] + [(k, order[0]) for k in order[::-1][:PARTNERS] if k != order[0]]
        found = next(((high, low, x) for high, low in tried if (x := best(high, low))), None)
        if found is None:
            break
        high, low, (i, j) = found
        for item, source, to in ((held[high][i], high, low), (held[low][j], low, high)):
            if item[1] >= 0:
                held[source].remove(item)
                insort(held[to], item)
                total[source] -= item[0]
                total[to] += item[0]
                moved[item[1:]] = to
    return [(shard, bin_, to) for (shard, bin_), to in sorted(moved.items()) if to != shard]


def _evened(rows: DataFrame, leaves: int) -> DataFrame:
    bins = max(16, EVEN_SUMS // leaves)
    binned = checkpointed(rows.withColumn("_bin", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(bins)).cast("int")))
    sums = [(r[0], r[1], r[2]) for r in binned.groupBy("shard", "_bin").agg(F.sum("size")).collect()]
    table = exchange(sums, leaves)
    if not table:
        return rows
    moves = F.broadcast(_inline(rows.sparkSession, table, ["shard", "_bin", "_to"]))
    return binned.join(moves, ["shard", "_bin"], "left").select("doc_id", "size", "text_crc32", F.coalesce("_to", "shard").cast("int").alias("shard"))


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """A gapless slot from 0 in each shard, by two levels."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS)) * 4
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("_in", inside).join(offsets, ["shard", "_bucket"]).withColumn("slot", (F.col("_before") + F.col("_in")).cast("long")).drop("_bucket", "_in", "_before")


def op6_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = checkpointed(kd_shards(docs, n_shards=40))
    return with_slots(rows, rows.count()).select("doc_id", "size", F.col("text_crc32").cast("long"), F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
