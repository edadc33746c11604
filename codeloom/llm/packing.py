"""Problem 7: documents packed into as few containers of fixed capacity as possible.

A document larger than a container fills whole containers with its first tokens; only its rest competes for room. The
rests and all other documents are packed by a grouping genetic algorithm: a chromosome is a list of bins, crossover
injects well-filled bins of one parent into the other, bins that hold a document twice are dissolved, and what they
held first takes the place of smaller documents in the bins that it fills better (one or two against one or two), then
is put back by best fit, largest first.

Blocks of bounded size evolve apart, each on several islands with populations of their own; between epochs the best
chromosome of an island migrates to the next one, and the best island of a block gives its bins. Between rounds the bins
that are not full move with their documents to other blocks, where they are the first chromosome of the population.

Sizes are given; a size of null or 0 takes no room and joins the first bin of its block.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import cut

#: Documents of a block, rounds between which unfilled bins change their block, islands of a block, epochs of a round.
BLOCK, ROUNDS, ISLANDS, EPOCHS = 1_500, 2, 2, 2
#: Chromosomes of an island, its children in one epoch, those without a better one after which it ends, and free documents
#: whose pairs are looked at.
POPULATION, CHILDREN, PATIENCE, PAIRED = 6, 60, 20, 60


class Chromosome:
    """bins: the items of each bin, fills: their sizes."""

    __slots__ = ("bins", "fills", "fitness")

    def __init__(self, bins: list[list[int]], fills: list[int], capacity: int):
        self.bins, self.fills = bins, fills
        # fewer bins first, then bins as unequal as possible: full ones, and room in few
        self.fitness = (-len(bins), sum((f / capacity) ** 2 for f in fills))


def best_fit(bins: list[list[int]], fills: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put items, largest first, each into the bin that it leaves the least room in; open a bin where none has room."""
    free = sorted((capacity - f, i) for i, f in enumerate(fills) if f < capacity)
    for item in sorted(items, key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, i = free.pop(at)
        else:
            room, i = capacity, len(bins)
            bins.append([])
            fills.append(0)
        bins[i].append(item)
        fills[i] += size
        if room > size:
            insort(free, (room - size, i))


def refill(bins: list[list[int]], fills: list[int], items: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Free items put in place of smaller ones of a bin (one or two for one or two) where the bin is filled better; what is free then."""
    free = sorted(items, key=sizes.__getitem__)
    ordered: list[int] = [sizes[i] for i in free]
    sums: list[tuple[int, int, int]] = []
    full = 0
    for b, group in enumerate(bins):
        room = capacity - fills[b]
        while room > 0 and free:
            if 2 * len(sums) < full or not sums:
                some = free[:: max(1, len(free) // PAIRED)]
                sums = sorted((sizes[x] + sizes[y], x, y) for i, x in enumerate(some) for y in some[:i])
                full = len(sums)
            best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
            outs = [(sizes[x], (x,)) for x in group]
            outs += [(sizes[x] + sizes[y], (x, y)) for i, x in enumerate(group[:12]) for y in group[:i]]
            for size, out in [(0, ()), *outs]:
                at = bisect_right(ordered, size + room) - 1
                if at >= 0 and ordered[at] - size > best[0]:
                    best = (ordered[at] - size, out, (free[at],))
                at = bisect_right(sums, (size + room, 1 << 60, 0)) - 1
                if at >= 0 and sums[at][0] - size > best[0]:
                    best = (sums[at][0] - size, out, sums[at][1:])
                if best[0] == room:
                    break
            gain, out, into = best
            if not gain:
                break
            group[:] = [x for x in group if x not in out] + list(into)
            fills[b] += gain
            room -= gain
            free = sorted([x for x in free if x not in into] + list(out), key=sizes.__getitem__)
            ordered, sums = [sizes[i] for i in free], [p for p in sums if p[1] not in into and p[2] not in into]
    return free


def rebuilt(bins: list[list[int]], fills: list[int], displaced: list[int], sizes: list[int], capacity: int) -> Chromosome:
    left = refill(bins, fills, displaced, sizes, capacity)
    best_fit(bins, fills, left, sizes, capacity)
    return Chromosome(bins, fills, capacity)


def crossed(a: Chromosome, b: Chromosome, sizes: list[int], capacity: int, rng: random.Random) -> Chromosome:
    """Some well-filled bins of b injected into a."""
    order = sorted(range(len(b.bins)), key=b.fills.__getitem__, reverse=True)
    top = order[: max(1, len(order) // 2)]
    take = rng.sample(top, max(1, int(len(top) * rng.uniform(0.05, 0.4))))
    moved = {item for i in take for item in b.bins[i]}
    bins = [list(b.bins[i]) for i in take]
    fills = [b.fills[i] for i in take]
    displaced: list[int] = []
    for group, fill in zip(a.bins, a.fills):
        if moved.isdisjoint(group):
            bins.append(list(group))
            fills.append(fill)
        else:
            displaced += [item for item in group if item not in moved]
    return rebuilt(bins, fills, displaced, sizes, capacity)


def mutated(a: Chromosome, sizes: list[int], capacity: int, rng: random.Random) -> Chromosome:
    """The emptiest bins and some others dissolved and their items put back."""
    worst = sorted(range(len(a.bins)), key=a.fills.__getitem__)[: 1 + len(a.bins) // 50]
    gone = {*worst, *rng.sample(range(len(a.bins)), min(len(a.bins), 1 + len(a.bins) // 25))}
    displaced = [item for i in gone for item in a.bins[i]]
    bins = [list(g) for i, g in enumerate(a.bins) if i not in gone]
    fills = [f for i, f in enumerate(a.fills) if i not in gone]
    return rebuilt(bins, fills, displaced, sizes, capacity)


def seed(sizes: list[int], capacity: int) -> Chromosome:
    """Best fit, largest first."""
    bins: list[list[int]] = []
    fills: list[int] = []
    best_fit(bins, fills, list(range(len(sizes))), sizes, capacity)
    return Chromosome(bins, fills, capacity)


def evolved(sizes: list[int], capacity: int, given: list[list[list[int]]], number: int, children: int = CHILDREN) -> list[list[int]]:
    """Bins of the items 0..n-1 after one epoch on an island; `given` are chromosomes that came to it."""
    rng = random.Random(number)
    least = -(-sum(sizes) // capacity)
    first = [Chromosome([list(g) for g in c], [sum(sizes[i] for i in g) for g in c], capacity) for c in given]
    first.append(seed(sizes, capacity))
    population = list(first)
    best = max(population, key=lambda c: c.fitness)
    idle = 0
    for _ in range(POPULATION + children):
        if len(best.bins) <= least or idle > PATIENCE:
            break
        if len(population) < POPULATION:
            child = mutated(rng.choice(first), sizes, capacity, rng)
            population.append(child)
        else:
            population.sort(key=lambda c: c.fitness, reverse=True)
            a, b = rng.sample(population[: POPULATION // 2 + 1], 2)
            child = crossed(a, b, sizes, capacity, rng)
            if rng.random() < 0.5:
                child = mutated(child, sizes, capacity, rng)
            population[-1] = child
        idle = 0 if child.fitness > best.fitness else idle + 1
        best = max(best, child, key=lambda c: c.fitness)
    return best.bins


def chromosomes(pdf: pd.DataFrame) -> tuple[list[int], list[int], list[list[list[int]]]]:
    """Rows of one copy of each item, their sizes, and the chromosomes that the rows of an island tell of."""
    parts = [p for _, p in pdf.sort_values(["n", "k", "part"], kind="stable").groupby("origin", sort=True)]
    given = []
    for part in parts:
        if part["container"].notna().all():
            groups: dict[str, list[int]] = {}
            for i, c in enumerate(part["container"]):
                groups.setdefault(c, []).append(i)
            given.append(list(groups.values()))
    return list(parts[0].index), [int(n) for n in parts[0]["n"]], given


def epoch(number: int):
    """The work of one island in one epoch: its rows with their new bins, once for itself and once for the next island."""

    def island(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        cap, me = int(pdf["cap"][0]), int(pdf["island"][0])
        rows, sizes, given = chromosomes(pdf)
        if me and len(seed(sizes, cap).bins) <= -(-sum(sizes) // cap):
            return pdf[:0]  # nothing to gain, the first island has the bins
        bins = evolved(sizes, cap, given, number * 1_009 + int(pdf["block"][0]) * 31 + me)
        name = [""] * len(sizes)
        for b, group in enumerate(bins):
            for i in group:
                name[i] = f"{pdf['limit_name'][0]}:{number}:{pdf['block'][0]}:{me}:{b}"
        own = pdf.loc[rows].assign(container=name, origin=me)
        done = len(bins) <= -(-sum(sizes) // cap)
        return own if done else pd.concat([own, own.assign(island=(me + 1) % ISLANDS)])

    return island


def best_island(last: bool):
    """The rows of a block as its best island has them, and whether a bin is final."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["cap"].iloc[0])
        bins = pdf.groupby(["origin", "container"])["n"].sum()
        fitness = {o: (-len(f), float(((f / cap) ** 2).sum()), -o) for o, f in ((o, f.to_numpy()) for o, f in bins.groupby(level=0))}
        best = max(fitness, key=fitness.__getitem__)
        mine = pdf[pdf["origin"] == best]
        return mine.assign(done=last | (mine["container"].map(bins[best]) == cap))

    return choose


def measured(items: DataFrame, limits: DataFrame, key: str, size: str) -> tuple[DataFrame, DataFrame, int]:
    """Containers filled whole by one item, what is left to pack, and the number of blocks.

    Items without a key are left out, and so are limits without a positive capacity.
    """
    caps = limits.where("capacity_tokens > 0").select("limit_name", F.col("capacity_tokens").cast("bigint").alias("cap")).distinct()
    sized = cut(items.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")))
    # each item meets each limit, by the eighth of the limits that it is in
    under = (
        sized.withColumn("eighth", F.explode(F.sequence(F.lit(0), F.lit(7))))
        .join(caps.withColumn("eighth", F.pmod(F.xxhash64("limit_name"), F.lit(8)).cast("int")), "eighth")
        .drop("eighth")
    )
    full = (
        under.where("n > cap")
        .select("limit_name", "k", "cap", F.explode(F.sequence(F.lit(0), F.expr("CAST(n DIV cap AS INT) - 1"))).alias("part"))
        .select("limit_name", F.concat_ws(":", "limit_name", F.lit("whole"), "k", "part").alias("container"), "k", "part", (F.col("part") * F.col("cap")).alias("start"), F.col("cap").alias("n"))
    )
    rest = under.where("n <= cap OR n % cap > 0").select(
        "limit_name",
        "cap",
        "k",
        F.when(F.col("n") > F.col("cap"), F.expr("CAST(n DIV cap AS INT)")).otherwise(0).alias("part"),
        F.when(F.col("n") > F.col("cap"), F.expr("n - n % cap")).otherwise(F.lit(0).cast("bigint")).alias("start"),
        F.when(F.col("n") > F.col("cap"), F.expr("n % cap")).otherwise(F.col("n")).alias("n"),
        F.lit(None).cast("string").alias("container"),
    )
    return full, rest, max(1, -(-sized.count() // BLOCK))


def block_of(round_: int, blocks: int) -> Column:
    """An item finds its block by itself at first, later with the bin that it is in."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("container"), F.col("k").cast("string")), F.lit(round_)), F.lit(blocks)).cast("int")


def packed(items: DataFrame, limits: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(limit_name, container, key, part, start, tokens): every item under every limit.

    limits: limit_name, capacity_tokens. part counts the pieces of a document from 0, start is the first token of a piece.
    """
    full, rest, blocks = measured(items, limits, key, size)
    row = "limit_name string, cap bigint, k bigint, part int, start bigint, n bigint, container string, block int"
    done = [full]
    for round_ in range(ROUNDS):
        last = round_ == ROUNDS - 1
        found = rest.withColumn("block", block_of(round_, blocks)).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("origin", F.lit(-1))
        for e in range(EPOCHS):
            found = found.groupBy("limit_name", "block", "island").applyInPandas(epoch(round_ * EPOCHS + e), f"{row}, island int, origin int")
        best = found.where("island = origin").drop("island").groupBy("limit_name", "block").applyInPandas(best_island(last), f"{row}, origin int, done boolean")
        best = cut(best)
        done.append(best.where("done").select("limit_name", "container", "k", "part", "start", "n"))
        rest = best.where("NOT done").drop("done", "origin", "block")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.select("limit_name", "container", F.col("k").alias(key), "part", "start", F.col("n").alias(size))


def seeds(items: DataFrame, limits: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(limit_name, seed): containers that best fit, largest first, takes on the same blocks, for comparison."""
    full, rest, blocks = measured(items, limits, key, size)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = seed([int(n) for n in pdf["n"]], int(pdf["cap"].iloc[0])).bins
        return pd.DataFrame({"limit_name": [pdf["limit_name"].iloc[0]], "bins": [len(bins)]})

    packed_ = rest.withColumn("block", block_of(0, blocks)).select("limit_name", "cap", "n", "block").groupBy("limit_name", "block").applyInPandas(count, "limit_name string, bins bigint")
    return packed_.unionByName(full.groupBy("limit_name").agg(F.count(F.lit(1)).alias("bins"))).groupBy("limit_name").agg(F.sum("bins").alias("seed"))


def fill(placed: DataFrame, limits: DataFrame, first: DataFrame) -> DataFrame:
    """Per limit: containers used, those of the seed, the least number that the tokens need, and the share of room used."""
    bins = placed.groupBy("limit_name", "container").agg(F.sum("tokens").alias("n"))
    return (
        bins.groupBy("limit_name")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"))
        .join(limits.select("limit_name", "capacity_tokens").distinct(), "limit_name")
        .join(first, "limit_name")
        .select(
            "limit_name",
            "containers",
            "seed",
            F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"),
            (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"),
        )
    )
