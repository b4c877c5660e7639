"""Energy propagation over typed edges."""

from __future__ import annotations

import atexit
import glob
import heapq
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.config import ATTENUATION, BLOCKER, BROADCAST_EDGES, KERNEL_EDGES, MAX_STEPS
from tidegraph.operators.bestfirst import Rows, Search, chosen, rounded
from tidegraph.operators.edges import in_mask
from tidegraph.plans.lineage import cut, cut_by, shared_path, shuffles_removed
from tidegraph.plans.skew import SALTS, heavy_keys

#: Hops after which lineage is cut.
CUT_EVERY = 4
#: From so many hops on, laying the edges out by source once costs less than shuffling them with every hop.
BY_SOURCE_FROM = 4
#: Nodes of a frontier that may be broadcast.
BROADCAST_NODES = 1_000_000
#: Tasks of searches for each core.
TASKS_A_CORE = 3


def check(max_steps: int, threshold: float, top_k: int | None, rigor: float = 1.0) -> None:
    if not 0 <= max_steps <= MAX_STEPS:
        raise ValueError(f"max_steps must be 0..{MAX_STEPS}")
    if not threshold >= 0:
        raise ValueError("the threshold must not be negative")
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive")
    if not rigor > 0:
        raise ValueError("the rigor must be positive")


def prepared(edges: DataFrame, mask: Iterable[int] | None = None) -> DataFrame:
    """The edges (src, dst, edge_type, weight) of the mask, computed once and kept."""
    usable = edges.select("src", "dst", "edge_type", "weight")
    return cut(usable if mask is None else usable.filter(in_mask(F.col("edge_type"), mask)))


@dataclass(frozen=True)
class BySource:
    """Edges kept partitioned by source and salt, so that each hop shuffles its frontier alone. Edges of heavy sources, of
    which there are never many, have a salt by their target; a frontier row of such a source goes to each of its parts."""

    edges: DataFrame
    heavy: DataFrame

    @staticmethod
    def of(edges: DataFrame, mask: Iterable[int] | None = None) -> BySource:
        usable = prepared(edges, mask)
        heavy = cut(heavy_keys(usable, ["src"]).withColumn("heavy", F.lit(True)))
        salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        marked = usable.join(F.broadcast(heavy), "src", "left").select("src", salt.alias("salt"), "dst", "edge_type", "weight")
        return BySource(cut_by(marked, "src", "salt"), heavy)

    def join(self, front: DataFrame) -> DataFrame:
        """Rows of ``front`` (with src) along their edges."""
        parts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        wide = front.join(F.broadcast(self.heavy), "src", "left").withColumn("salt", F.explode(parts)).drop("heavy")
        return wide.join(self.edges, ["src", "salt"]).drop("salt")


def laid_out(edges: DataFrame, max_steps: int, mask: Iterable[int] | None = None) -> DataFrame | BySource:
    """The edges as so many hops read them best: as they are, kept, or kept by source."""
    if max_steps < 2:
        return edges if mask is None else edges.filter(in_mask(F.col("edge_type"), mask))
    return BySource.of(edges, mask) if max_steps >= BY_SOURCE_FROM else prepared(edges, mask)


def hop_levels(edges: DataFrame | BySource, seeds: DataFrame, max_steps: int, threshold: float, mask: Iterable[int] | None, combine: str = "max", groups: list[str] | None = None) -> DataFrame:
    """(groups, node_id, energy, hop, predecessor, edge_type) of every hop's frontier: each node once a hop.

    Per hop, energies go along the edges, those under the threshold are dropped, and a node keeps the greatest
    (``combine`` max, with the smallest source and edge type of equals as its predecessor) or the sum. The frontier of a
    hop is what arrived in it, even if less than before. Frontiers are aggregated on the map side before the next join;
    small ones are broadcast by the optimizer. Hot sources are split, by ``BySource`` or else by adaptive execution. A mask
    holds for plain edges; those by source have had theirs.
    """
    by = groups or []
    if isinstance(edges, BySource):
        along = edges.join
    else:
        usable = edges.select("src", "dst", "edge_type", "weight")
        if mask is not None:
            usable = usable.filter(in_mask(F.col("edge_type"), mask))
        along = lambda front: front.join(usable, "src")
    front = seeds.select(*by, F.col("node_id").cast("long").alias("node_id")).distinct()
    front = front.select(*by, "node_id", F.lit(1.0).alias("energy"), F.lit(0).alias("hop"), F.lit(-1).cast("long").alias("predecessor"), F.lit(0).alias("edge_type"))
    levels = [front]
    for hop in range(1, max_steps + 1):
        out = (F.col("energy") * F.col("weight")).alias("out")
        step = along(front.select(*by, F.col("node_id").alias("src"), "energy")).select(*by, "src", "dst", "edge_type", out)
        step = step.filter(F.col("out") >= threshold)
        best = F.min(F.struct((-F.col("out")).alias("down"), F.col("src"), F.col("edge_type")))
        energy = F.sum("out") if combine == "sum" else -F.col("b.down")
        agg = step.groupBy(*by, F.col("dst").alias("node_id")).agg(best.alias("b"), *([energy.alias("total")] if combine == "sum" else []))
        front = agg.select(*by, "node_id", (F.col("total") if combine == "sum" else energy).alias("energy"), F.lit(hop).alias("hop"), F.col("b.src").alias("predecessor"), F.col("b.edge_type").alias("edge_type"))
        if hop % CUT_EVERY == 0:
            front = cut(front)
        levels.append(front)
    return reduce(DataFrame.union, levels)


def hop_wave(edges: DataFrame, seeds: DataFrame, max_steps: int, threshold: float, top_k: int | None, mask: Iterable[int] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Best energy per node over all hops: node_id, energy, hop, predecessor, edge_type, rank, ordered by energy, node.

    Ties keep the earliest hop, then the smallest predecessor and edge type. Seeds have energy 1, predecessor -1 and edge
    type 0. ``seeds`` has node_id; with ``groups`` the waves are independent per group (and top_k holds for each).
    """
    check(max_steps, threshold, top_k)
    by = groups or []
    levels = hop_levels(laid_out(edges, max_steps, mask), seeds, max_steps, threshold, mask, groups=by)
    best = F.min(F.struct((-F.col("energy")).alias("down"), "hop", "predecessor", "edge_type"))
    rows = levels.groupBy(*by, "node_id").agg(best.alias("b"))
    rows = rows.select(*by, "node_id", (-F.col("b.down")).alias("energy"), "b.hop", "b.predecessor", "b.edge_type").filter(F.col("energy") >= threshold)
    return ranked(rows, [F.col("energy").desc(), F.col("node_id")], top_k, by)


def ranked(rows: DataFrame, order: list[Column], top_k: int | None, groups: list[str] | None = None) -> DataFrame:
    """Rows with ``rank`` 1.. in a total order, cut to top_k. Without groups and with top_k, partitions keep their own top_k
    before one task ranks them; without top_k, ranks come from a range sort with partition offsets, not from one task."""
    from pyspark.sql import Window

    if groups:
        out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long"))
        return out.filter(F.col("rank") <= top_k) if top_k else out
    if top_k:
        return rows.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    part = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return part.join(F.broadcast(sizes), "__part").withColumn("rank", (F.col("__before") + within).cast("long")).drop("__part", "__n", "__before")


def saturating_recall(edges: DataFrame, seeds: DataFrame, threshold: int, top_k: int, max_steps: int = 8, cap: int = 65_535) -> DataFrame:
    """Fixed-point wave: a node fires once, at ``threshold`` or more; what its edges (src, dst, edge_type, attenuation
    0..255) carry adds up at a node per step, up to ``cap``. (node_id, energy, rank) of the fired nodes by energy.

    A node that got more than ever before is in the next frontier; one that has fired doesn't fire again. Edge type 255
    carries nothing. Only the frontier, the best energies and the fired nodes are kept between steps.
    """
    if not 0 <= threshold <= cap:
        raise ValueError(f"the threshold must be 0..{cap}")
    check(min(max_steps, MAX_STEPS), 0, top_k)
    usable = edges.filter("edge_type <> 255").select("src", "dst", "attenuation")
    front = cut(seeds.select("node_id").distinct().withColumn("energy", F.lit(cap).cast("long")))
    best, fired = front, front.filter("false")
    for _ in range(max_steps):
        firing = front.filter(F.col("energy") >= threshold).join(fired.select("node_id"), "node_id", "left_anti")
        firing = cut(firing)
        if firing.isEmpty():
            break
        fired = fired.union(firing)
        carried = F.shiftright(F.col("energy") * F.col("attenuation"), 8)
        got = firing.withColumnRenamed("node_id", "src").join(usable, "src").select(F.col("dst").alias("node_id"), carried.alias("c")).filter(F.col("c") >= threshold)
        got = got.groupBy("node_id").agg(F.least(F.sum("c"), F.lit(cap)).alias("energy"))
        had = best.select("node_id", F.col("energy").alias("had"))
        front = cut(got.join(had, "node_id", "left").filter(F.col("energy") > F.coalesce("had", F.lit(0))).select("node_id", "energy"))
        best = cut(best.union(front).groupBy("node_id").agg(F.max("energy").alias("energy")))
    return ranked(fired, [F.col("energy").desc(), F.col("node_id")], top_k)


def sum_wave(edges: DataFrame, seeds: DataFrame, max_steps: int, threshold: float, top_k: int) -> DataFrame:
    """Wave in which energies that arrive at a node in one hop add up; a node keeps its best hop. Edges carry ``weight``.
    Sums are rounded to 12 places, since their order isn't fixed."""
    check(max_steps, threshold, top_k)
    levels = hop_levels(laid_out(edges, max_steps), seeds, max_steps, threshold, None, "sum")
    rows = levels.groupBy("node_id").agg(F.round(F.max("energy"), 12).alias("energy"))
    return ranked(rows, [F.col("energy").desc(), F.col("node_id")], top_k)


def attenuated(edges: DataFrame, profile: str = "default", rigor: float = 1.0) -> DataFrame:
    """Edges whose weight is attenuation * weight * rigor, by a literal table of ten entries; blocking edges and pairs go."""
    from tidegraph.operators.edges import without_blocked

    table = F.create_map(*[F.lit(x) for i, a in enumerate(ATTENUATION[profile]) for x in (i + 1, a)])
    factor = F.coalesce(table[F.col("edge_type")], F.lit(0.0))
    return without_blocked(edges).withColumn("weight", factor * F.col("weight") * F.lit(rigor))


def _kernel(adjacency: dict, seed: int, steps: int, threshold: float, mask: frozenset, att: dict, rigor: float, top_k: int | None) -> tuple[list[tuple], dict]:
    """Best-first search from one seed. ``adjacency`` lists (edge_type, dst, weight) in stored order."""
    best, path_of = {seed: 1.0}, {seed: ()}
    heap: list[tuple] = [(-1.0, seed, 0, ())]
    n = dict.fromkeys(("expanded", "masked", "thresholded", "blocked"), 0)
    while heap:
        down, node, depth, path = heapq.heappop(heap)
        if 1e-15 - down < best[node] or depth >= steps:
            continue
        n["expanded"] += 1
        out = adjacency.get(node, ())
        closed = {d for t, d, _ in out if t == BLOCKER}
        for t, dst, w in out:
            if t == BLOCKER:
                n["blocked"] += 1
            elif t not in mask:
                n["masked"] += 1
            elif dst in closed:
                n["blocked"] += 1
            else:
                energy = -down * att.get(t, 0.0) * w * rigor
                if energy < threshold:
                    n["thresholded"] += 1
                elif energy > best.get(dst, -1.0) + 1e-15:
                    best[dst], path_of[dst] = energy, (*path, t)
                    heapq.heappush(heap, (-energy, dst, depth + 1, path_of[dst]))
    rows = sorted(((-round(e, 12), len(path_of[v]), v, path_of[v]) for v, e in best.items() if e >= threshold), key=lambda r: r[:3])
    n["before_top_k"] = len(rows)
    rows = rows[:top_k]
    return [(v, -e, list(p), k) for e, k, v, p in rows], n | {"after_top_k": len(rows)}


def reachable(edges: DataFrame, seeds: DataFrame, max_steps: int, mask: Iterable[int], threshold: float, profile: str, rigor: float, idle: bool = False, most: int | None = None) -> DataFrame | None:
    """Edges (src, dst, edge_type, weight) of the nodes from which a wave can go on: kept edges of a frontier that could
    still carry the threshold. Blocking edges come along. With ``idle``, edges of all nodes that a wave expands.

    Each hop reads the edges once, for the nodes that are new in it alone; nothing but what is found is shuffled. More than
    ``most`` edges are counted and not kept: None.
    """
    table = F.create_map(*[F.lit(x) for i, a in enumerate(ATTENUATION[profile]) for x in (i + 1, a)])
    carry = F.coalesce(table[F.col("edge_type")], F.lit(0.0)) * F.col("weight") * F.lit(rigor)
    open_ = in_mask(F.col("edge_type"), mask) & (F.col("edge_type") != BLOCKER)
    least = threshold * (1 - 1e-9)
    share = float("inf") if idle else edges.filter(open_).agg(F.max(carry)).first()[0] or 0.0
    front = seeds.select("node_id", F.lit(1.0).alias("energy"))
    seen, near, n = seeds.select("node_id").filter("false"), edges.filter("false"), 0
    for hop in range(max_steps):
        active = front if idle else front.filter(F.col("energy") * F.lit(share) >= least)
        fresh = cut(active.select("node_id").join(seen, "node_id", "left_anti"))
        few = fresh.count()
        if few:
            src = fresh.select(F.col("node_id").alias("src"))
            new = edges.join(F.broadcast(src) if few <= BROADCAST_NODES else src, "src", "left_semi").select(*edges.columns)
            if most is not None:
                n += new.count()
                if n > most:
                    return None
            near = near.union(cut(new))
            seen = seen.union(fresh)
        if hop + 1 < max_steps:
            step = active.withColumnRenamed("node_id", "src").join(near.filter(open_), "src").select(F.col("dst").alias("node_id"), (F.col("energy") * carry).alias("energy"))
            front = cut(step.filter(F.col("energy") >= least).groupBy("node_id").agg(F.max("energy").alias("energy")))
            if front.isEmpty():
                break
    return near


def best_first(
    edges: DataFrame, seeds: DataFrame, max_steps: int, threshold: float, top_k: int | None, mask: Iterable[int], rigor: float = 1.0,
    profile: str = "default", kernel_edges: int = BROADCAST_EDGES, stats: bool = False, order: tuple[str, ...] = ("energy", "length", "node"),
    among: DataFrame | tuple[int, int] | None = None, always: DataFrame | None = None,
) -> DataFrame:
    """Best-first wave from each distinct seed (node_id): seed, node_id, energy, best_path, best_path_len.

    Label-setting in the order of energy, node, steps and path: a node's stronger but deeper path may keep its weaker but
    shallower one from going on, so at a binding step limit this isn't the hop wave. Edges to a target that a blocking
    edge of the same source closes are passed over. Energies are rounded to 12 places; rows are cut to ``top_k`` per seed
    by energy, path length and node, or by another ``order`` of these. Where ``among`` is given (node_id, or a first node and
    one past the last), only its nodes come out, and those of ``always`` (node_id) besides the ``top_k``. With ``stats`` a row per seed of counters comes out
    instead.

    Search is sequential per seed, so seeds are spread over tasks. If the edges of the mask are counted to be no more than
    ``kernel_edges``, each task holds them all in compressed rows; else they are written as such rows into the shared
    folder, and tasks map them. Where that folder can't be mapped, or an edge keeps an energy whole, the edges that any seed
    can reach are held if they are so few; else each seed's own go to its search.
    """
    kept = prepared(edges, None if stats else frozenset(mask) | {BLOCKER})
    return _searched(kept, seeds, max_steps, threshold, top_k, mask, rigor, profile, kernel_edges, "stats" if stats else "rows", order, among, always)


def reached(edges: DataFrame, seeds: DataFrame, max_steps: int, threshold: float, mask: Iterable[int], rigor: float = 1.0, profile: str = "default", kernel_edges: int = BROADCAST_EDGES) -> DataFrame:
    """The nodes that best-first waves from all seeds reach: node_id, energy (the greatest), n_seeds. Tasks add their own
    seeds up, so that a node leaves each of them once."""
    kept = prepared(edges, frozenset(mask) | {BLOCKER})
    parts = _searched(kept, seeds, max_steps, threshold, None, mask, rigor, profile, kernel_edges, "nodes")
    return parts.groupBy("node_id").agg(F.max("energy").alias("energy"), F.sum("n_seeds").alias("n_seeds"))


def _searched(
    edges: DataFrame, seeds: DataFrame, max_steps: int, threshold: float, top_k: int | None, mask: Iterable[int], rigor: float, profile: str,
    kernel_edges: int, what: str, order: tuple[str, ...] = ("energy", "length", "node"), among: DataFrame | tuple[int, int] | None = None, always: DataFrame | None = None,
    others: bool = False,
) -> DataFrame:
    """Searches over kept edges; ``what`` comes out: rows, stats, or nodes (of each task: node_id, energy, n_seeds). With
    ``others``, the seed isn't among its rows."""
    check(max_steps, threshold, top_k, rigor)
    mask_set, att = frozenset(mask), {i + 1: a for i, a in enumerate(ATTENUATION[profile])}
    seeds = cut(seeds.select(F.col("node_id").cast("long").alias("node_id")).distinct())
    sc, stats = seeds.sparkSession.sparkContext, what == "stats"
    names = ["expanded", "masked", "thresholded", "blocked", "before_top_k", "after_top_k"]
    kinds = {"rows": "seed long, node_id long, energy double, best_path array<int>, best_path_len int", "stats": "seed long, " + ", ".join(f"{x} long" for x in names), "nodes": "node_id long, energy double, n_seeds long"}
    some = lambda df: df if df is None or isinstance(df, tuple) else np.unique(df.select(F.col("node_id").cast("long")).dropna().toArrow()["node_id"].to_numpy())
    limits = sc.broadcast((some(among), some(always)))
    most = top_k and top_k + others if what == "rows" and order[0] == "energy" and among is None and always is None else None

    def of_seed(seed: int, node: np.ndarray, energy: np.ndarray, length: np.ndarray, n: dict, paths: Callable) -> pa.RecordBatch:
        """What a wave of a seed gives; ``paths`` gives the ends and types of the paths of some of its places."""
        fit = np.flatnonzero((energy >= threshold) & (node != seed) if others else energy >= threshold)
        if stats:
            n = n | {"before_top_k": len(fit), "after_top_k": min(len(fit), top_k or len(fit))}
            return pa.record_batch([pa.array([x], pa.int64()) for x in (seed, *(n[x] for x in names))], ["seed", *names])
        at = fit[chosen(node[fit], energy[fit], length[fit], top_k, order, *limits.value)]
        ends, types = paths(at)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(types, pa.int32()))
        return pa.record_batch([pa.array(np.full(len(at), seed), pa.int64()), pa.array(node[at], pa.int64()), pa.array(energy[at]), lists, pa.array(length[at], pa.int32())], ["seed", "node_id", "energy", "best_path", "best_path_len"])

    def by_kernel(adjacency: dict, seed: int) -> pa.RecordBatch:
        got, n = _kernel(adjacency, seed, max_steps, threshold, mask_set, att, rigor, None)
        ways = [p for _, _, p, _ in got]

        def paths(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = [ways[i] for i in at]
            return np.cumsum([len(p) for p in own], dtype=np.int64), np.array([t for p in own for t in p], np.int32)

        return of_seed(seed, np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64), np.array([r[3] for r in got], np.int32), n, paths)

    def adjacency_of(src: np.ndarray, kind: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> dict:
        out: dict = {}
        by = np.lexsort((weight, dst, kind, src))
        for s, t, d, w in zip(*[c[by].tolist() for c in (src, kind, dst, weight)], strict=True):
            out.setdefault(s, []).append((t, d, w))
        return out

    def summed(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(rows).group_by("node_id").aggregate([("energy", "max"), ("seed", "count")]).rename_columns(["node_id", "energy", "n_seeds"])
        yield from got.to_batches()

    near, folder, carry = edges, None, 0.0
    if near.count() > kernel_edges:
        carry = greatest_share(edges, mask_set, profile, rigor)
        folder = written(edges, mask_set, stats) if carry < 1 - 1e-6 and threshold >= 1e-9 else None
        if folder is None:
            near = reachable(edges, seeds, max_steps, mask_set, threshold, profile, rigor, stats, kernel_edges)
    if near is not None or folder:
        if folder:
            quick, held = True, None
        else:
            raw = columns(near)
            rows = Rows.of(*raw, mask_set, stats)
            quick = rows.greatest(att, rigor) < 1 - 1e-6 and threshold >= 1e-9
            held = sc.broadcast(rows if quick else raw)
            del raw, rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = sorted(x for b in batches for x in b.column("node_id").to_pylist() if x is not None)
            if not mine:
                return
            if not quick:
                src, dst, kind, weight = held.value
                adjacency = adjacency_of(src, kind, dst, weight)
                each = (by_kernel(adjacency, s) for s in mine)
                yield from summed(each) if what == "nodes" else each
                return
            graph = Rows.mapped(folder, carry, stats) if folder else held.value
            search = Search(graph, max_steps, threshold, att, rigor)
            greatest, hits = np.full(len(graph.nodes), -1.0), np.zeros(len(graph.nodes), np.int64)
            for seed in mine:
                at, n = search.run(seed, most)
                if not len(at):
                    alone = of_seed(seed, np.array([seed]), np.ones(1), np.zeros(1, np.int32), n, lambda at: (np.zeros(len(at), np.int64), np.empty(0, np.int32)))
                    yield from summed([alone]) if what == "nodes" else [alone]
                elif what == "nodes":
                    energy = rounded(search.best[at])
                    at, energy = at[energy >= threshold], energy[energy >= threshold]
                    hits[at] += 1
                    greatest[at] = np.maximum(greatest[at], energy)
                else:
                    yield of_seed(seed, graph.nodes[at], rounded(search.best[at]), search.depth[at].astype(np.int32), n, lambda x, at=at: search.paths(at[x]))
            at = np.flatnonzero(hits)
            if len(at):
                yield pa.record_batch([pa.array(graph.nodes[at], pa.int64()), pa.array(greatest[at]), pa.array(hits[at])], ["node_id", "energy", "n_seeds"])

        return seeds.repartition(TASKS_A_CORE * sc.defaultParallelism, "node_id").mapInArrow(run, kinds[what])
    near = reachable(edges, seeds, max_steps, mask_set, threshold, profile, rigor, stats)
    levels = hop_levels(attenuated(near, profile, rigor), seeds.withColumn("seed", F.col("node_id")), max(max_steps - 1, 0), threshold * (1 - 1e-9), mask_set, groups=["seed"])
    own = levels.select("seed", F.col("node_id").alias("src")).distinct().join(near, "src", "left").select("seed", "src", "dst", F.col("edge_type").cast("int").alias("edge_type"), "weight")

    def one(t: pa.Table) -> pa.Table:
        e = t.filter(pc.is_valid(t["dst"]))
        return pa.Table.from_batches([by_kernel(adjacency_of(*[e[c].to_numpy() for c in ("src", "edge_type", "dst", "weight")]), t["seed"][0].as_py())])

    found = own.groupBy("seed").applyInArrow(one, kinds["stats" if stats else "rows"])
    return found.groupBy("node_id").agg(F.max("energy").alias("energy"), F.count(F.lit(1)).alias("n_seeds")) if what == "nodes" else found


def greatest_share(edges: DataFrame, mask: Iterable[int], profile: str, rigor: float) -> float:
    """No edge of the mask carries more than this share of an energy."""
    table = F.create_map(*[F.lit(x) for i, a in enumerate(ATTENUATION[profile]) for x in (i + 1, a)])
    most = edges.filter(in_mask(F.col("edge_type"), mask)).agg(F.max(F.coalesce(table[F.col("edge_type")], F.lit(0.0)) * F.col("weight"))).first()[0]
    return max(most or 0.0, 0.0) * rigor * (1 + 1e-12)


def written(edges: DataFrame, mask: frozenset, counted: bool = False) -> str | None:
    """The compressed rows of kept edges as files in a folder that all executors share, see ``Rows.mapped``; None where
    there is no such folder.

    Open edges are sorted by ranges, of which each task writes its own; the driver holds the ids of nodes and their
    counts, and puts the files together. They stay until the driver ends.
    """
    shared = shared_path(edges.sparkSession)
    if shared is None:
        return None
    folder = f"{shared}/rows-{uuid.uuid4().hex}"
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with shuffles_removed(edges.sparkSession):
        ids = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    nodes = np.sort(ids.toArrow()["node_id"].to_numpy())
    nodes.tofile(f"{folder}/nodes")
    shut, inside = F.col("edge_type") == BLOCKER, in_mask(F.col("edge_type"), mask) & (F.col("edge_type") != BLOCKER)
    closing = cut(edges.filter(shut).select("src", "dst").distinct())
    order = ["src", "edge_type", "dst", "weight"]
    rows = edges.filter(inside).join(F.broadcast(closing) if closing.count() <= BROADCAST_NODES else closing, ["src", "dst"], "left_anti")
    rows = rows.select("src", F.col("edge_type").cast("byte").alias("edge_type"), "dst", "weight").repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.memmap(f"{folder}/nodes", np.int64, "r")
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        files = {c: open(f"{folder}/{own}.{c}", "wb") for c in ("dst", "kind", "weight")}  # noqa: SIM115
        for b in batches:
            src, kind, dst, weight = (b.column(c).to_numpy() for c in order)
            np.searchsorted(places, dst).astype(np.int32).tofile(files["dst"])
            kind.tofile(files["kind"])
            weight.tofile(files["weight"])
            node, n = np.unique(np.searchsorted(places, src), return_counts=True)
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array(n, pa.int64())], ["place", "n"])
        for c, f in files.items():
            f.close()
            os.replace(f.name, f"{folder}/{c}.{part:06d}")

    count = lambda at, n: np.bincount(at, n, len(nodes)).astype(np.int64)
    with shuffles_removed(edges.sparkSession):
        parts = rows.mapInArrow(write, "place long, n long")
    got = parts.toArrow()
    opened = count(got["place"].to_numpy(), got["n"].to_numpy())
    np.append(0, np.cumsum(opened)).tofile(f"{folder}/first")
    for c in ("dst", "kind", "weight"):
        with open(f"{folder}/{c}", "wb") as whole:
            for name in sorted(glob.glob(f"{folder}/{c}.*")):
                with open(name, "rb") as f:
                    shutil.copyfileobj(f, whole, 1 << 20)
                os.remove(name)
    if counted:
        n = lambda c: F.count(F.when(c, 1))
        got = edges.groupBy("src").agg(n(~inside & ~shut).alias("masked"), (n(shut) + n(inside)).alias("others")).toArrow()
        at = np.searchsorted(nodes, got["src"].to_numpy())
        count(at, got["masked"].to_numpy()).tofile(f"{folder}/masked")
        (count(at, got["others"].to_numpy()) - opened).tofile(f"{folder}/blocked")
    return folder


def columns(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """src, dst, edge_type and weight of edges that were counted to be few."""
    got = edges.select("src", "dst", F.col("edge_type").cast("byte"), "weight").toArrow()
    return tuple(got[c].to_numpy() for c in ("src", "dst", "edge_type", "weight"))


def merged_wave(edges: DataFrame, seeds: DataFrame, max_steps: int, threshold: float, top_k: int, mask: Iterable[int], rigor: float = 1.0, profile: str = "default") -> DataFrame:
    """``merged_best`` of the best-first waves of all seeds. Each wave gives its first ``top_k`` rows: a node behind them in
    all waves has as many others before it in the merged order."""
    return merged_best(best_first(edges, seeds, max_steps, threshold, top_k, mask, rigor, profile), top_k)


class HeldGraph:
    """A graph whose edges every worker holds in compressed rows, for very many waves at once.

    The edges are counted first and must not exceed ``most``; ``held_waves`` gives larger graphs to ``hop_wave``, which holds nothing.
    """

    def __init__(self, edges: DataFrame, mask: Iterable[int] | None = None, most: int = KERNEL_EDGES):
        kept = prepared(edges, mask)
        n = kept.count()
        if n > most:
            raise ValueError(f"{n} edges are too many to hold in each worker")
        pdf = kept.toPandas().sort_values(["src", "edge_type", "dst", "weight"])
        src = pdf["src"].to_numpy(np.int64)
        nodes, first = np.unique(src, return_index=True)
        self._held = edges.sparkSession.sparkContext.broadcast((nodes, np.append(first, len(src)), pdf["dst"].to_numpy(np.int64), pdf["edge_type"].to_numpy(np.int32), pdf["weight"].to_numpy(np.float64)))

    def hop_waves(self, seeds: DataFrame, max_steps: int, threshold: float, top_k: int) -> DataFrame:
        """The hop wave of every distinct seed (node_id) on its own: seed, node_id, energy, hop, predecessor, edge_type, rank.
        The same rows as ``hop_wave`` with the seed as its group."""
        check(max_steps, threshold, top_k)
        held = self._held

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _waves(held.value, pdf["node_id"].to_numpy(np.int64), max_steps, threshold, top_k)

        schema = "seed long, node_id long, energy double, hop int, predecessor long, edge_type int, rank long"
        return seeds.select(F.col("node_id").cast("long").alias("node_id")).dropna().distinct().mapInPandas(run, schema)


def held_waves(edges: DataFrame, seeds: DataFrame, max_steps: int, threshold: float, top_k: int, mask: Iterable[int] | None = None, most: int = KERNEL_EDGES) -> DataFrame:
    """The hop wave of every distinct seed on its own, over a held graph up to ``most`` edges and by ``hop_wave`` beyond."""
    mask = None if mask is None else tuple(mask)
    if prepared(edges, mask).count() <= most:
        return HeldGraph(edges, mask, most).hop_waves(seeds, max_steps, threshold, top_k)
    own = seeds.select(F.col("node_id").cast("long").alias("node_id")).dropna().distinct()
    return hop_wave(edges, own.withColumn("seed", F.col("node_id")), max_steps, threshold, top_k, mask, ["seed"])


def _waves(graph: tuple, seeds: np.ndarray, max_steps: int, threshold: float, top_k: int) -> pd.DataFrame:
    """Hop waves of many seeds, hop by hop over all of them: numpy sorts take the place of maps."""
    nodes, first, dst, kind, weight = graph
    n = len(seeds)
    who, node, energy = np.arange(n), seeds, np.ones(n)
    every = [(who, node, energy, np.zeros(n, np.int32), np.full(n, -1), np.zeros(n, np.int32))]
    for hop in range(1, max_steps + 1):
        at = np.searchsorted(nodes, node)
        at[at == len(nodes)] = 0
        known = nodes[at] == node if len(nodes) else np.zeros(len(node), bool)
        who, node, energy, at = who[known], node[known], energy[known], at[known]
        count = first[at + 1] - first[at]
        edge = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at], count)
        out = np.repeat(energy, count) * weight[edge]
        ok = out >= threshold
        edge, out, who, prior = edge[ok], out[ok], np.repeat(who, count)[ok], np.repeat(node, count)[ok]
        order = np.lexsort((kind[edge], prior, -out, dst[edge], who))
        edge, out, who, prior = edge[order], out[order], who[order], prior[order]
        best = np.ones(len(who), bool)
        best[1:] = (who[1:] != who[:-1]) | (dst[edge[1:]] != dst[edge[:-1]])
        who, node, energy = who[best], dst[edge[best]], out[best]
        every.append((who, node, energy, np.full(len(who), hop, np.int32), prior[best], kind[edge[best]]))
        if not len(who):
            break
    who, node, energy, hop, prior, kinds = (np.concatenate(c) for c in zip(*every, strict=True))
    order = np.lexsort((kinds, prior, hop, -energy, node, who))
    who, node, energy, hop, prior, kinds = (c[order] for c in (who, node, energy, hop, prior, kinds))
    best = np.ones(len(who), bool)
    best[1:] = (who[1:] != who[:-1]) | (node[1:] != node[:-1])
    best &= energy >= threshold
    who, node, energy, hop, prior, kinds = (c[best] for c in (who, node, energy, hop, prior, kinds))
    order = np.lexsort((node, -energy, who))
    who, node, energy, hop, prior, kinds = (c[order] for c in (who, node, energy, hop, prior, kinds))
    rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
    keep = rank <= top_k
    return pd.DataFrame({"seed": seeds[who[keep]], "node_id": node[keep], "energy": energy[keep], "hop": hop[keep], "predecessor": prior[keep], "edge_type": kinds[keep], "rank": rank[keep]})


def merged_best(rows: DataFrame, top_k: int | None) -> DataFrame:
    """Waves of several seeds as one: each node once, with its greatest energy, then the shortest path, then the first seed."""
    best = F.min(F.struct((-F.col("energy")).alias("down"), "best_path_len", "seed", "best_path"))
    out = rows.groupBy("node_id").agg(best.alias("b")).select("node_id", (-F.col("b.down")).alias("energy"), "b.best_path_len", "b.seed", "b.best_path")
    return ranked(out, [F.col("energy").desc(), F.col("best_path_len"), F.col("node_id")], top_k)


def wave_scope(edges: DataFrame, records: DataFrame, anchors: DataFrame, max_steps: int, threshold: float, limit: int, mask: Iterable[int], rigor: float = 1.0, profile: str = "default") -> DataFrame:
    """Evidence for each record that a wave from an anchor node reaches: anchor, record_id, node_id, energy, best_path, the
    distinct types of its edges from the anchor (direct_out) and to the anchor (direct_in). The anchor itself is left out;
    ``limit`` records per anchor."""
    edges, anchors, mask = prepared(edges), cut(anchors.select("node_id")), frozenset(mask)
    usable = edges.filter(in_mask(F.col("edge_type"), mask | {BLOCKER}))
    rows = _searched(usable, anchors, max_steps, threshold, limit, mask, rigor, profile, BROADCAST_EDGES, "rows", others=True)
    n = anchors.distinct().count()
    records = records.select("record_id", "node_id")

    ends_of = (("src", "dst", "direct_out"), ("dst", "src", "direct_in"))

    def direct(seed: str, node: str, name: str, near: DataFrame) -> DataFrame:
        """The types of edges between an anchor and a node, as ``name``, of what is in ``near``."""
        own = edges.select(F.col(seed).alias("seed"), F.col(node).alias("node_id"), F.col("edge_type").alias(name))
        return own.join(near, near.columns, "left_semi")

    if n * limit <= BROADCAST_NODES:
        # Few rows are broadcast, so that no other edge is shuffled.
        rows = cut(rows)
        few = F.broadcast(rows.select("seed", "node_id"))
        for e in ends_of:
            rows = rows.join(direct(*e, few).groupBy("seed", "node_id").agg(F.array_sort(F.collect_set(e[2])).alias(e[2])), ["seed", "node_id"], "left")
    else:
        # Rows are shuffled once, and meet the edges of anchors in both directions at once.
        near = anchors.select(F.col("node_id").alias("seed")).distinct()
        out, into = (direct(*e, F.broadcast(near) if n <= BROADCAST_NODES else near) for e in ends_of)
        types = out.unionByName(into, allowMissingColumns=True).groupBy("seed", "node_id").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("direct_out", "direct_in")])
        rows = rows.join(types, ["seed", "node_id"], "left")
        if records.count() <= BROADCAST_NODES:
            records = F.broadcast(records)
    rows = rows.join(records, "node_id")
    none = F.array().cast("array<int>")
    return rows.select(F.col("seed").alias("anchor"), "record_id", "node_id", "energy", "best_path", F.coalesce("direct_out", none).alias("direct_out"), F.coalesce("direct_in", none).alias("direct_in"))
