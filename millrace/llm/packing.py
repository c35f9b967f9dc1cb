"""Filling containers by a grouping genetic algorithm on islands (problem 8)."""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tokens import VOCABULARY, count_tokens
from millrace.session import cut

#: Items of a block, individuals of a deme, islands of a block, generations before and after migration, and epochs.
ISLAND, DEME, DEMES, GENERATIONS, EPOCHS = 1000, 12, 2, 24, 4
#: Islands that one task evolves at most, one after the other, where there are many.
TASK_ISLANDS = 64
#: Containers filled to at least this share settle at the end of an epoch.
SETTLED = 0.995

Packing = list[list[int]]  # containers, each a list of item numbers
Filled = tuple[Packing, list[int]]  # with the containers' fills


def best_fit(items: list[int], sizes: list[int], capacity: int, packing: Packing, fills: list[int]) -> None:
    """Put items, in the given order, where they leave the least room; open a container where they fit in none."""
    room = sorted((capacity - f, i) for i, f in enumerate(fills) if f < capacity)
    for x in items:
        k = bisect_left(room, (sizes[x], -1))
        if k < len(room):
            free, i = room.pop(k)
            packing[i].append(x)
        else:
            free, i = capacity, len(packing)
            packing.append([x])
            fills.append(0)
        fills[i] += sizes[x]
        if free > sizes[x]:
            insort(room, (free - sizes[x], i))


def fitness(fills: list[int], capacity: int) -> float:
    """Mean square of the containers' fill: few full ones are better than many even ones."""
    return sum((f / capacity) ** 2 for f in fills) / max(len(fills), 1)


def _fills(packing: Packing, sizes: list[int]) -> list[int]:
    return [sum(sizes[x] for x in c) for c in packing]


def _order(items: list[int], sizes: list[int], rng: random.Random) -> list[int]:
    """By falling size, or now and then nearly so, which tries other company."""
    noise = rng.choice((0.0, 0.0, 0.4, 1.0))
    return sorted(items, key=lambda x: (-sizes[x] * (1 - noise * rng.random()), x))


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """A child of ``a`` with whole well-filled containers of ``b``.

    Containers of ``a`` that share items with the injected ones are dissolved; their other items are put back, by size,
    best fit.
    """
    return _cross((a, _fills(a, sizes)), (b, _fills(b, sizes)), sizes, capacity, rng)[0]


def _cross(a: Filled, b: Filled, sizes: list[int], capacity: int, rng: random.Random) -> Filled:
    pb, fb = b
    order = sorted(range(len(pb)), key=lambda i: (-fb[i], rng.random()))
    take = order[: max(1, rng.randint(len(pb) // 8, max(len(pb) // 2, 1)))]
    child, fills = [list(pb[i]) for i in take], [fb[i] for i in take]
    inside = {x for c in child for x in c}
    loose: list[int] = []
    for c, f in zip(*a):
        if inside.isdisjoint(c):
            child.append(list(c))
            fills.append(f)
        else:
            loose += [x for x in c if x not in inside]
    best_fit(_order(loose, sizes, rng), sizes, capacity, child, fills)
    return child, fills


def mutate(packing: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Dissolve the emptiest containers and a few more; trade their items for smaller ones, then put the rest back.

    A trade puts a loose item into a container in place of a smaller one where the container then is fuller.
    """
    return _mutated((packing, _fills(packing, sizes)), sizes, capacity, rng)[0]


def _mutated(parent: Filled, sizes: list[int], capacity: int, rng: random.Random) -> Filled:
    packing, fills = parent
    order = sorted(range(len(packing)), key=lambda i: (fills[i], rng.random()))
    poor = sum(f < capacity * SETTLED for f in fills)
    gone = set(order[: max(2, poor // 4)]) | {rng.randrange(len(packing)) for _ in range(2)}
    loose = sorted((x for i in gone for x in packing[i]), key=lambda x: (-sizes[x], x))
    kept = [list(c) for i, c in enumerate(packing) if i not in gone]
    own = [fills[i] for i in range(len(packing)) if i not in gone]
    rest: list[int] = []
    tried = [i for i in range(len(kept)) if own[i] < capacity]
    rng.shuffle(tried)
    for x in loose:
        for i in tried[:24]:
            room = capacity - own[i]
            if not room:
                continue
            swap = max((y for y in kept[i] if sizes[y] < sizes[x] <= sizes[y] + room), key=lambda y: -sizes[y], default=None)
            if swap is not None:
                kept[i].remove(swap)
                kept[i].append(x)
                own[i] += sizes[x] - sizes[swap]
                rest.append(swap)
                break
        else:
            rest.append(x)
    best_fit(_order(rest, sizes, rng), sizes, capacity, kept, own)
    return kept, own


def evolve_deme(sizes: list[int], capacity: int, seed: int, elites: tuple[Packing, ...] = (), deme: int = DEME, generations: int = GENERATIONS) -> Packing:
    """Evolve one population over all ``sizes``, each at most ``capacity``; its best individual.

    The population is the ``elites`` that migrated here, best fit by falling size, and disturbed orders. A generation
    replaces the worst by children of the better ones. It ends early at the least possible number of containers.
    """
    if not sizes:
        return []
    rng = random.Random(seed)
    least = ceil(sum(sizes) / capacity)

    def start(noise: float) -> Filled:
        packing: Packing = []
        fills: list[int] = []
        best_fit(sorted(range(len(sizes)), key=lambda x: (-sizes[x] * (1 - noise * rng.random()), x)), sizes, capacity, packing, fills)
        return packing, fills

    def scored(p: Filled) -> tuple[tuple[int, float], Filled]:
        return (-len(p[0]), fitness(p[1], capacity)), p

    first = start(0.0)
    if len(first[0]) <= least or len(first[0]) == 1:
        return first[0]
    own = [scored(p) for p in [*((e, _fills(e, sizes)) for e in elites), first]]
    own += [scored(start(rng.choice((0.3, 1.0)))) for _ in range(deme - len(own))]
    own.sort(key=lambda s: s[0], reverse=True)
    for _ in range(generations):
        if -own[0][0][0] <= least:
            break
        a, b = rng.sample(range(max(2, len(own) - 2)), 2)
        children = [_cross(own[a][1], own[b][1], sizes, capacity, rng), _mutated(own[rng.randrange(min(3, len(own)))][1], sizes, capacity, rng)]
        own[-len(children) :] = [scored(c) for c in children]
        own.sort(key=lambda s: s[0], reverse=True)
    return own[0][1][0]


def evolve(sizes: list[int], capacity: int, seed: int, demes: int = DEMES) -> Packing:
    """What :func:`pack` does with one block of items: islands evolve apart, then one goes on from all their elites."""
    return evolve_deme(sizes, capacity, seed, tuple(evolve_deme(sizes, capacity, seed + 1 + i) for i in range(demes)) if sizes else ())


_ELITE = "kind string, capacity int, block bigint, island int, doc_id bigint, piece int, tokens int, place int"
_ITEM = "kind string, capacity int, epoch int, container string, doc_id bigint, piece int, tokens int, settled boolean"
_BY_ITEM = ["doc_id", "piece", "tokens"]


def _evolve_island(epoch: int):
    """One island: it evolves its block's items apart from the others and sends out its elite."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, block, island = key
        pdf = pdf.sort_values(_BY_ITEM, kind="stable").reset_index(drop=True)
        packing = evolve_deme(pdf["tokens"].tolist(), capacity := int(pdf["capacity"].iloc[0]), seed=hash((epoch, int(block), int(island), capacity)))
        return pdf.assign(place=_places(packing, len(pdf)))[["kind", "capacity", "block", "island", *_BY_ITEM, "place"]]

    return run


def _places(packing: Packing, n: int) -> list[int]:
    place = [0] * n
    for i, c in enumerate(packing):
        for x in c:
            place[x] = i
    return place


def _join_elites(epoch: int, last: bool):
    """Where the elites of a block's islands arrive: a population that starts from them evolves on; full containers settle."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, block = key
        elites: list[Packing] = []
        for _, own in pdf.groupby("island"):
            own = own.sort_values(_BY_ITEM, kind="stable").reset_index(drop=True)
            elites.append([list(x) for x in own.groupby("place").indices.values()])
        items, capacity = own, int(pdf["capacity"].iloc[0])
        sizes = items["tokens"].tolist()
        packing = evolve_deme(sizes, capacity, seed=hash((epoch, int(block), capacity)), elites=tuple(elites))
        place = _places(packing, len(sizes))
        full = [last or sum(sizes[x] for x in c) >= SETTLED * capacity for c in packing]
        return pd.DataFrame({"kind": kind, "capacity": capacity, "epoch": epoch, "container": [f"{kind}-{epoch}-{block}-{i}" for i in place], **{c: items[c] for c in _BY_ITEM}, "settled": [full[i] for i in place]})

    return run


def pack(sizes: DataFrame, capacities: DataFrame, island: int = ISLAND, epochs: int = EPOCHS) -> DataFrame:
    """Assign ``doc_id, tokens`` to containers of each ``kind, capacity``: ``kind, capacity, container, doc_id, piece, tokens``.

    An item larger than the container, and no other, is cut: pieces of the whole capacity fill containers alone, the
    remaining piece is packed with the others; ``piece`` counts from 0. In each epoch the items are dealt by a hash to
    blocks of about ``island`` items. DEMES islands, tasks of their own, evolve a block's packing apart; their elites
    migrate through a shuffle to one population, which evolves on from them (:func:`evolve_deme`). Containers filled to
    SETTLED settle, the items of the others are dealt anew, so they meet other partners; the last epoch settles all.
    Only ids and sizes move. A block has a fixed number of items, and the number of tasks follows that of islands, not
    of bytes, which say nothing about the work.

    Defined cases: items with a null id or size, or a size below 1, are skipped; a repeated id is as many items; kinds
    with a null or non-positive capacity are skipped; empty inputs give no rows; equal sizes are packed by id.
    """
    spark = sizes.sparkSession
    kinds = capacities.select(F.col("kind").cast("string").alias("kind"), F.col("capacity").cast("int").alias("capacity")).filter("kind IS NOT NULL AND capacity > 0").distinct().collect()  # container kinds: a handful
    items = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokens").cast("int").alias("tokens")).filter("doc_id IS NOT NULL AND tokens > 0")
    each = items.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.capacity).alias("capacity")) for r in kinds]))).select("_k.*", "doc_id", "tokens") if kinds else items.limit(0).withColumns({"kind": F.lit(""), "capacity": F.lit(0)})
    whole = F.expr("tokens div capacity").cast("int")
    cutting = each.filter("tokens >= capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1)))
    alone = cutting.select("kind", "capacity", F.lit(0).alias("epoch"), F.concat_ws("-", "kind", "doc_id", "piece").alias("container"), "doc_id", "piece", F.col("capacity").alias("tokens"), F.lit(True).alias("settled"))
    loose = each.filter("tokens % capacity > 0").select("kind", "capacity", "doc_id", F.when(F.col("tokens") >= F.col("capacity"), whole).otherwise(0).alias("piece"), F.expr("tokens % capacity").cast("int").alias("tokens"))
    done = [alone]
    for epoch in range(1, epochs + 1):
        counts = [r["count"] for r in loose.groupBy("kind").count().collect()]
        if not counts:
            break
        n = max(counts)
        last = epoch == epochs or n <= island
        blocks = max(1, ceil(n / island))
        tasks = _tasks(spark, blocks * len(counts) * DEMES)
        dealt = loose.withColumn("block", F.pmod(F.xxhash64(F.lit(epoch), "doc_id", "piece", "tokens"), F.lit(blocks))).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(DEMES - 1))))
        elites = dealt.repartition(tasks, "kind", "block", "island").groupBy("kind", "block", "island").applyInPandas(_evolve_island(epoch), _ELITE)
        met = elites.repartition(_tasks(spark, blocks * len(counts)), "kind", "block").groupBy("kind", "block").applyInPandas(_join_elites(epoch, last), _ITEM)
        packed = cut(met)
        done.append(packed.filter("settled"))
        if last:
            break
        loose = packed.filter("NOT settled").select("kind", "capacity", "doc_id", "piece", "tokens")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("kind", "capacity", "container", "doc_id", "piece", "tokens")


def _tasks(spark: SparkSession, islands: int) -> int:
    """A task for each island up to four for each core, more where a task would have over TASK_ISLANDS."""
    return max(1, min(islands, 4 * spark.sparkContext.defaultParallelism), islands // TASK_ISLANDS)


def token_sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens`` of each non-blank text, measured whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_tokens(b.column(1).to_pylist(), vocabulary), pa.int32())], names=["doc_id", "tokens"])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, tokens int").filter("tokens IS NOT NULL")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, the least possible number, tokens, and the share of room used."""
    by = packed.groupBy("kind", "capacity").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return by.select("kind", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).cast("bigint").alias("least"), "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"))
