"""Filling containers of fixed capacity with documents (problem 8): a grouping genetic algorithm on islands.

Documents are dealt to blocks of about BLOCK items by a hash of their id. On each block ISLANDS populations evolve apart:
a crossover injects whole well-filled containers of one parent into the other, drops the containers that now hold
duplicates and best-fits the displaced documents. After each epoch every island sends its elite to its neighbour on a
ring; after the last the best island of a block stands. Documents of poorly filled containers are then dealt anew and
packed in further rounds, each kept where it needs fewer containers, until a round gains next to nothing.

A document larger than the capacity is cut into full pieces, each a container of its own, and a remainder that is packed
like any other document; no other document is split. Size is n_tokens, or the UTF-8 bytes of the text plus one end token
where n_tokens is null or not positive; null text counts as empty. Repeated rows of one id are placed once, rows
without an id not at all.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.runtime import stage

BLOCK = 4096
ISLANDS = 3
EPOCHS = 3
POPULATION = 6
GENERATIONS = 60
#: Containers filled less than this are opened again for the next round.
POOR = 0.995
#: A class goes through another round if the last one saved a container, and at least this share of the opened ones.
LEAST_GAIN = 0.0002
_M = 1 << 20

Bins = list[list[int]]


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: Bins, fills: list[int] | None = None) -> Bins:
    """Put the items into the fullest container that takes them, opening new ones; bins is changed, and fills, the sum of each, if given."""
    fills = [sum(sizes[i] for i in b) for b in bins] if fills is None else fills
    keys = sorted((capacity - x) * _M + k for k, x in enumerate(fills))
    for i in order:
        size = sizes[i]
        at = bisect_left(keys, size * _M)
        if at < len(keys):
            key = keys.pop(at)
            k = key % _M
            bins[k].append(i)
            fills[k] += size
            insort(keys, key - size * _M, 0, at)
        else:
            insort(keys, (capacity - size) * _M + len(bins))
            bins.append([i])
            fills.append(size)
    return bins


class _Packing:
    """A solution: the container of each item and the fill of each container."""

    def __init__(self, of: np.ndarray, fills: np.ndarray):
        self.of, self.fills = of, fills
        #: fewer containers first, then the sum of squared fills, which rewards full containers beside empty ones
        self.fitness = (-len(fills), int((fills * fills).sum()))

    @classmethod
    def from_bins(cls, bins: Bins, sizes: np.ndarray) -> _Packing:
        of = np.empty(len(sizes), dtype=np.int64)
        of[np.fromiter(chain.from_iterable(bins), dtype=np.int64, count=len(sizes))] = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        return cls(of, np.bincount(of, weights=sizes, minlength=len(bins)).astype(np.int64))


def crossover(a: _Packing, b: _Packing, sizes: np.ndarray, capacity: int, rng: random.Random) -> _Packing:
    n = len(b.fills)
    full = np.argsort(-b.fills, kind="stable")[: max(1, n // 2)]
    injected = full[np.frombuffer(rng.randbytes(4 * len(full)), dtype=np.uint32) < 0.4 * 2**32]
    injected = injected if len(injected) else full[:1]
    place = np.full(n, -1)
    place[injected] = np.arange(len(injected))
    of = place[b.of]  # the containers of the child, -1 for items not placed yet
    open_ = of < 0
    hit = np.zeros(len(a.fills), dtype=bool)
    hit[a.of[~open_]] = True
    kept = np.flatnonzero(~hit)
    if len(kept) and rng.random() < 0.5:  # mutation: open one of the emptiest containers as well
        noise = np.frombuffer(rng.randbytes(4 * len(kept)), dtype=np.uint32) / 2**32
        kept = np.delete(kept, np.argmin(a.fills[kept] * (0.9 + 0.2 * noise)))
    place = np.full(len(a.fills), -1)
    place[kept] = np.arange(len(injected), len(injected) + len(kept))
    of[open_] = place[a.of[open_]]
    displaced = np.flatnonzero(of < 0)
    displaced = displaced[np.argsort(-sizes[displaced], kind="stable")]
    fills = np.concatenate((b.fills[injected], a.fills[kept]))
    least = int(sizes[displaced].min()) if len(displaced) else capacity + 1
    # only containers that take the least of them can change
    able = np.flatnonzero(capacity - fills >= least)
    keys = np.sort((capacity - fills[able]) * _M + able).tolist()
    count, fills = len(fills), fills.tolist()
    put = []
    for size in sizes[displaced].tolist():
        at = bisect_left(keys, size * _M)
        if at < len(keys):
            key = keys.pop(at)
            k = key % _M
            fills[k] += size
            key -= size * _M
            if key >= least * _M:
                insort(keys, key, 0, at)
        else:
            k = count
            count += 1
            fills.append(size)
            if capacity - size >= least:
                insort(keys, (capacity - size) * _M + k)
        put.append(k)
    of[displaced] = put
    return _Packing(of, np.array(fills, dtype=np.int64))


def improve(sizes: list[int], capacity: int, seeds: list[_Packing], rng: random.Random, population: int, generations: int) -> _Packing:
    """One island for one epoch; the best solution it has seen. Stops early at the lower bound."""
    each = np.array(sizes, dtype=np.int64)
    bound = -(-int(each.sum()) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    pool = list(seeds)
    while len(pool) < population:
        noisy = order if not pool else sorted(order, key=lambda i: -sizes[i] * (0.8 + 0.4 * rng.random()))
        pool.append(_Packing.from_bins(best_fit(noisy, sizes, capacity, []), each))
        if len(pool[-1].fills) <= bound:
            return pool[-1]
    scored = sorted(((s.fitness, k, s) for k, s in enumerate(pool)), key=lambda x: x[:2], reverse=True)
    for g in range(generations):
        if len(scored[0][2].fills) <= bound:
            break
        x, y = rng.sample(scored, 2)
        child = crossover(x[2], y[2], each, capacity, rng)
        scored.append((child.fitness, len(pool) + g, child))
        scored.sort(key=lambda x: x[:2], reverse=True)
        scored = scored[:population]
    return scored[0][2]


def evolve(sizes: list[int], capacity: int, seeds: list[Bins], rng: random.Random, population: int, generations: int) -> Bins:
    """improve() from and to lists of containers."""
    each = np.array(sizes, dtype=np.int64)
    best = improve(sizes, capacity, [_Packing.from_bins(s, each) for s in seeds], rng, population, generations)
    bins: Bins = [[] for _ in best.fills]
    for i, k in enumerate(best.of.tolist()):
        bins[k].append(i)
    return bins


def _epoch(epoch: int, population: int, generations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few blocks at a time: the arrays of a block become Python lists
        for batch in (b.slice(k, 2) for b in batches for k in range(0, b.num_rows, 2)):
            solutions, counts, squares = [], [], []
            for r in batch.to_pylist():
                rng = random.Random(f"{epoch}/{r['bin_class']}/{r['block']}/{r['island']}")
                each, seeds = np.array(r["sizes"], dtype=np.int64), []
                for given in (r["own"], r["migrant"]):
                    if given:
                        of = np.array(given, dtype=np.int64)
                        if not any(np.array_equal(of, s.of) for s in seeds):
                            seeds.append(_Packing(of, np.bincount(of, weights=each).astype(np.int64)))
                best = improve(r["sizes"], r["capacity"], seeds, rng, population, generations)
                solutions.append(best.of.astype(np.int32))
                counts.append(len(best.fills))
                squares.append(float(best.fitness[1]))
            keep = ["bin_class", "capacity", "block", "island", "ids", "sizes"]
            yield pa.record_batch(
                [batch.column(c) for c in keep] + [pa.array(solutions, pa.list_(pa.int32())), pa.array(counts, pa.int32()), pa.array(squares, pa.float64())],
                [*keep, "own", "n_bins", "squares"],
            )

    return run


_STATE = "bin_class string, capacity long, block long, island int, ids array<long>, sizes array<long>, own array<int>, n_bins int, squares double"


def pack_blocks(items: DataFrame, block: int, islands: int, epochs: int, population: int, generations: int, salt: int) -> DataFrame:
    """(bin_class, capacity, doc_id, size, bin): every item of at most the capacity in one container; bin is unique in its class."""
    n = items.groupBy("bin_class").agg(F.ceil(F.count("*") / F.lit(block)).alias("n_blocks"))
    dealt = items.join(F.broadcast(n), "bin_class").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(salt)), "n_blocks"))
    blocks = dealt.groupBy("bin_class", "capacity", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "size"))).alias("v"))
    none = F.lit(None).cast("array<int>")
    state = blocks.select(
        "bin_class", "capacity", "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("v.doc_id").alias("ids"), F.col("v.size").alias("sizes"),
    ).withColumns({"own": none, "migrant": none})
    state = state.repartition("bin_class", "block", "island")
    for epoch in range(epochs):
        state = stage(state.mapInArrow(_epoch(epoch, population, generations), _STATE))
        if epoch + 1 < epochs:
            elite = state.select("bin_class", "block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("own").alias("migrant"))
            state = state.drop("n_bins", "squares").join(elite, ["bin_class", "block", "island"])
    best = state.groupBy("bin_class", "capacity", "block").agg(
        F.max_by(F.struct("ids", "sizes", "own"), F.struct(-F.col("n_bins"), F.col("squares"), -F.col("island"))).alias("b")
    )
    each = best.select("bin_class", "capacity", "block", F.explode(F.arrays_zip("b.ids", "b.sizes", "b.own")).alias("x"))
    return each.select("bin_class", "capacity", F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("size"), F.concat_ws("-", F.lit(salt), "block", "x.own").alias("bin"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, n): the size in tokens of every document once."""
    own = F.when(F.col("n_tokens") > 0, F.col("n_tokens").cast("long"))
    size = F.coalesce(own, F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n").alias("n"))


def pack(
    docs: DataFrame, bins: DataFrame, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS,
    population: int = POPULATION, generations: int = GENERATIONS, poor: float = POOR,
) -> DataFrame:
    """(bin_class, container_id, doc_id, piece_no, tokens, capacity_tokens): the container of every document or piece.

    The classes in bins are independent: each holds all documents. Classes with null or non-positive capacity are left out.
    """
    classes = bins.select("bin_class", F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0 AND bin_class IS NOT NULL").distinct()
    # a parameter table of a few rows: it becomes a literal, every document is repeated once for each class
    each = [F.struct(F.lit(r[0]).alias("bin_class"), F.lit(r[1]).cast("long").alias("capacity")) for r in sorted(classes.collect())]
    each = F.array(*each) if each else F.lit(None).cast("array<struct<bin_class:string,capacity:bigint>>")
    cut = stage(sized(docs).select("doc_id", "n", F.explode(each).alias("c")).select("doc_id", "n", "c.*").withColumn("whole", F.floor((F.col("n") - 1) / F.col("capacity"))))
    full = cut.where("whole > 0").select("bin_class", "capacity", "doc_id", F.explode(F.expr("sequence(1, cast(whole as int))")).alias("piece_no"))
    full = full.select("bin_class", F.concat_ws("-", F.lit("d"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", F.col("capacity").alias("tokens"), "capacity")
    items = cut.select("bin_class", "capacity", "doc_id", (F.col("n") - F.col("whole") * F.col("capacity")).alias("size"))
    done, salt = [], 1
    current = stage(pack_blocks(items, block, islands, epochs, population, generations, salt))
    while True:
        fill = current.groupBy("bin_class", "bin").agg((F.sum("size") / F.first("capacity")).alias("fill"))
        marked = stage(current.join(fill, ["bin_class", "bin"]))
        opened = marked.where(F.col("fill") < poor).drop("fill")
        salt += 1
        again = stage(pack_blocks(opened.drop("bin"), block, islands, epochs, population, generations, salt))
        # one row per class
        counts = opened.groupBy("bin_class").agg(F.count_distinct("bin").alias("old")).join(again.groupBy("bin_class").agg(F.count_distinct("bin").alias("new")), "bin_class").collect()
        better = [r.bin_class for r in counts if r.new < r.old]
        more = [r.bin_class for r in counts if r.old - r.new >= max(1, LEAST_GAIN * r.old)]
        done += [marked.where(F.col("fill") >= poor).drop("fill"), opened.where(~F.col("bin_class").isin(better)), again.where(F.col("bin_class").isin(better) & ~F.col("bin_class").isin(more))]
        if not more:
            break
        current = again.where(F.col("bin_class").isin(more))
    packed = reduce(DataFrame.unionByName, done)
    whole = cut.select("bin_class", "doc_id", (F.col("whole") + 1).cast("int").alias("piece_no"))
    rest = packed.join(whole, ["bin_class", "doc_id"]).select("bin_class", F.col("bin").alias("container_id"), "doc_id", "piece_no", F.col("size").alias("tokens"), "capacity")
    return full.unionByName(rest).withColumnRenamed("capacity", "capacity_tokens")
