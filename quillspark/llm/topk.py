"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into ``m`` segments, about ``64 / log2(rows)``, so that a
probed value has about one code whatever the number of rows (3 at least: the
values of wider segments at large radii are too many). A code within
Hamming distance ``m * (r + 1) - 1`` of a query differs from it in at most ``r``
bits in some segment. Round ``r`` probes the values at exactly ``r`` bits from
the query's, in all segments, verifies full distances, and keeps the best; a query is
done once its kth verified distance is covered by the radius. The radius grows until
all queries are done, at the latest when a segment's whole width is searched, so
results are exact.

A query's first bound on its kth distance comes from a few codes that share a segment value with it, before any
round. Equal codes are one index entry with the ``k + 1`` smallest ids, found by a
ranked window that Spark limits before its shuffle, and equal query codes are searched once: a vector that
a third of the rows share costs one entry. Candidates farther than a
query's kth distance so far are dropped in the join itself; that cannot lose a
result.

Defined results: neighbours are ranked by distance, then id; a query is no
neighbour of itself, but rows with the same code are; with at most ``k`` other rows all are
returned; rows with a null id or code are left out; rows that repeat an id
and its code count once; columns besides the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm._spark import cut

BITS = 64


def sign_code(vector: str = "embedding") -> Column:
    """Bit ``i`` is set where component ``i`` (of at most 64) is above zero."""
    bits = F.transform(F.col(vector), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; widths differ by one at most."""
    out, at = [], 0
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        out.append((at, width))
        at += width
    return out


def _part(code: Column | str, shift: int, width: int) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, *, segments: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) for ``queries`` against ``index``, both of (id, code)."""
    w = W.partitionBy("code").orderBy("id")
    unique = index.where("id is not null and code is not null").select("id", "code").distinct()
    entries = cut(unique.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = cut(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct())
    n = entries.count()
    m = segments or max(3, min(16, round(BITS / max(1.0, math.log2(max(n, 2))))))
    if not 3 <= m <= BITS:
        raise ValueError("segments wider than 22 bits have too many values at large radii")
    parts = _segments(m)
    keyed = cut(entries.select("code", F.size("ids").alias("held"), F.posexplode(F.array(*(_part("code", s, b) for s, b in parts))).alias("seg", "value")))
    active = cut(_first_bounds(asked.select("q").distinct(), keyed, parts, k))
    spread = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = None  # (q, code, held, d) of the codes that hold a query's nearest k + 1 rows
    done = []
    radius = 0
    while True:
        # a query becomes very many probes: as many tasks as a shuffle has share them
        probes = active.repartition(spread, "q").mapInArrow(_prober(parts, radius), "q bigint, bound int, seg int, value bigint")
        d = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
        # a pair is met at its least radius, in the first segment of those; the rest would repeat it
        gaps = [F.bit_count(_part(F.col("q").bitwiseXOR(F.col("code")), s, b)).cast("int") for s, b in parts]
        first = F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))).cast("int") - 1
        met = (F.array_min(F.array(*gaps)) == radius) & (first == F.col("p.seg"))
        on = (F.col("p.seg") == F.col("i.seg")) & (F.col("p.value") == F.col("i.value")) & met & (d <= F.col("bound"))
        # merge: Spark takes probes for as small as the queries they are made of, and would broadcast them
        found = probes.alias("p").hint("merge").join(keyed.alias("i"), on).select("q", "code", "held", d.alias("d"))
        pool = cut(found if best is None else found.unionByName(best))
        # codes up to the one with which k + 1 rows are held, and all that tie with it: found from a query's rows at each
        # distance (BITS + 1 sums at most), so that a query with many candidates is not sorted in one task
        counts = pool.groupBy("q", "d").agg(F.sum("held").alias("rows"))
        ahead = F.sum("rows").over(W.partitionBy("q").orderBy("d").rowsBetween(W.unboundedPreceding, -1))
        reached = counts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < k + 1)
        state = cut(reached.groupBy("q").agg(F.sum("rows").alias("rows"), F.max("d").alias("far")))
        best = cut(pool.join(state.select("q", "far"), "q").where("d <= far").select("q", "code", "held", "d"))
        covered = m * (radius + 1) - 1
        bound = F.when(F.col("rows") >= k + 1, F.least("far", "bound"))
        state = active.join(state, "q", "left").select("q", F.coalesce(bound, F.col("bound")).alias("bound"))
        radius += 1
        if radius > max(b for _, b in parts):
            done.append(best)
            break
        settled = state.where(F.col("bound") <= covered)
        done.append(best.join(settled.select("q"), "q", "left_semi"))
        active = cut(state.where(F.col("bound") > covered))
        best = best.join(active.select("q"), "q", "left_semi")
        if active.isEmpty():
            break
    nearest = done[0]
    for more in done[1:]:
        nearest = nearest.unionByName(more)
    rows = nearest.join(entries, "code").select("q", "d", F.explode("ids").alias("neighbour_id"))
    rank = W.partitionBy("q").orderBy("d", "neighbour_id")
    lists = rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "d", "neighbour_id"))).alias("all"))
    others = asked.join(lists, "q").select("query_id", F.slice(F.filter("all", lambda x: x["neighbour_id"] != F.col("query_id")), 1, k).alias("all"))
    return others.select("query_id", F.posexplode("all").alias("pos", "e")).select("query_id", F.col("e.neighbour_id").alias("neighbour_id"), F.col("e.d").cast("long").alias("distance"), (F.col("pos") + 1).cast("long").alias("rank"))


def _first_bounds(asked: DataFrame, keyed: DataFrame, parts: list[tuple[int, int]], k: int) -> DataFrame:
    """(q, bound): a distance within which k + 1 rows are known to lie, from the ``k + 1`` smallest codes of each of a query's own segment values; else ``BITS``.

    A query in a cluster of near copies then meets only what is as near as those, not all of the cluster.
    """
    few = keyed.withColumn("r", F.row_number().over(W.partitionBy("seg", "value").orderBy("code"))).where(F.col("r") <= k + 1)
    own = asked.select("q", F.posexplode(F.array(*(_part("q", s, b) for s, b in parts))).alias("seg", "value"))
    near = own.join(few, ["seg", "value"]).select("q", "code", "held", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int").alias("d")).distinct()
    counts = near.groupBy("q", "d").agg(F.sum("held").alias("rows"))
    counts = counts.withColumn("rows", F.sum("rows").over(W.partitionBy("q").orderBy("d").rowsBetween(W.unboundedPreceding, 0)))
    bounds = counts.where(F.col("rows") >= k + 1).groupBy("q").agg(F.min("d").alias("bound"))
    return asked.join(bounds, "q", "left").select("q", F.coalesce("bound", F.lit(BITS)).alias("bound"))


def _prober(parts: list[tuple[int, int]], radius: int):
    """All values at ``radius`` bits from each query's value, in each segment that is wide enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(seg, shift, width, _masks(width, radius)) for seg, (shift, width) in enumerate(parts) if radius <= width]
        for batch in batches:
            q = batch.column("q").to_numpy(zero_copy_only=False).astype(np.int64)
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.int32)
            for seg, shift, width, mask in masks:
                step = max(1, 100_000 // len(mask))
                for at in range(0, len(q), step):
                    own = q[at : at + step]
                    value = ((own.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "q": pa.array(np.repeat(own, len(mask))), "bound": pa.array(np.repeat(bound[at : at + step], len(mask))),
                        "seg": pa.array(np.full(len(own) * len(mask), seg, dtype=np.int32)), "value": pa.array((value[:, None] ^ mask[None, :]).ravel()),
                    })

    return run
