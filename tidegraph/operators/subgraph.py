"""Floating subgraphs: bounded parts of a graph as verified streams of text."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.config import ATTENUATION, BLOCKER, HELD_EDGES
from tidegraph.operators.bestfirst import APART, HUB, Rows, rounded
from tidegraph.operators.edges import induced
from tidegraph.operators.wave import BROADCAST_NODES, TASKS_A_CORE, attenuated, check, columns, hop_levels, prepared, reachable, reached
from tidegraph.plans.lineage import cut

MAGIC, VERSION = "TIDEGRAPH-SUBGRAPH", 1
#: Edges after which a task hands over the roots it has looked them up for.
BATCH_EDGES = 100_000


def _firsts(rows: Rows, at: int, threshold: float, att: np.ndarray, top_k: int) -> tuple[np.ndarray, ...]:
    """Attenuation, target, type and weight of a node's edges; of a hub's, without those behind ``top_k`` other targets, whatever energy
    the node has."""
    part = slice(rows.first[at], rows.first[at + 1])
    dst, kind, weight = rows.dst[part], rows.kind[part], rows.weight[part]
    share, some = att[kind] * weight, 4 * top_k
    while HUB < len(share) and some < len(share):
        least = np.partition(share, len(share) - some)[len(share) - some]
        if len(np.unique(dst[share >= least])) >= top_k:
            keep = np.flatnonzero(share >= least - APART / threshold)
            return att[kind[keep]], dst[keep], kind[keep], weight[keep]
        some *= 4
    return att[kind], dst, kind, weight


def _offers(rows: Rows, node: int, energy: float, threshold: float, att: np.ndarray, top_k: int, hubs: dict) -> Iterator[tuple]:
    """(energy, node, edge_type) that a node's edges offer, the best of them: where ``top_k`` targets come before an offer,
    as many nodes are selected before it, so it never is. Offers are rounded to 12 places. ``hubs`` keeps what is found of
    hubs."""
    at = int(np.searchsorted(rows.nodes, node))
    if at == len(rows.nodes) or rows.nodes[at] != node:
        return
    got = hubs.get(at)
    if got is None:
        got = _firsts(rows, at, threshold, att, top_k)
        if rows.first[at + 1] - rows.first[at] > HUB:
            hubs[at] = got
    share, dst, kind, weight = got
    offer = energy * share * weight
    ok = np.flatnonzero(offer >= threshold - APART)
    if not len(ok):
        return
    offer, dst, kind = rounded(offer[ok]), dst[ok], kind[ok]
    ok = offer >= threshold
    offer, dst, kind = offer[ok], dst[ok], kind[ok]
    most, all_ = 4 * top_k, len(offer)
    while most < all_:  # the first offers; more if too few targets are among them
        some = np.flatnonzero(offer >= np.partition(offer, all_ - most)[all_ - most])
        if len(np.unique(dst[some])) >= top_k:
            offer, dst, kind = offer[some], dst[some], kind[some]
            break
        most *= 4
    order = np.lexsort((kind, dst, -offer))
    offer, dst, kind = offer[order], dst[order], kind[order]
    _, first = np.unique(dst, return_index=True)
    first = np.sort(first)[:top_k]
    yield from zip(offer[first].tolist(), rows.nodes[dst[first]].tolist(), kind[first].tolist(), strict=True)


def _grow(rows: Rows, root: int, steps: int, threshold: float, att: np.ndarray, rigor: float, top_k: int, all_offers: bool = False, hubs: dict | None = None) -> list[tuple]:
    """Nodes in the order of selection; edges stay unblocked by blocking edges, which are only passed over. A node's further
    offers to one target are weaker and come later, so they count only where energies may grow (``all_offers``)."""
    heap = [(-round(rigor, 12), root, 0, ())]
    best: dict[int, tuple] = {}
    hubs = {} if hubs is None else hubs
    while heap and len(best) < top_k:
        down, node, depth, path = heapq.heappop(heap)
        energy = round(-down, 12)
        if energy < threshold or (node in best and best[node][0] >= energy):
            continue
        best[node] = (energy, depth, path)
        if depth >= steps:
            continue
        for nxt, dst, t in _every(rows, node, energy, threshold, att) if all_offers else _offers(rows, node, energy, threshold, att, top_k, hubs):
            heapq.heappush(heap, (-nxt, dst, depth + 1, (*path, t)))
    return [(v, e, d, list(p)) for v, (e, d, p) in sorted(best.items())]


def _every(rows: Rows, node: int, energy: float, threshold: float, att: np.ndarray) -> Iterator[tuple]:
    at = int(np.searchsorted(rows.nodes, node))
    if at < len(rows.nodes) and rows.nodes[at] == node:
        for i in range(int(rows.first[at]), int(rows.first[at + 1])):
            nxt = round(energy * float(att[rows.kind[i]]) * float(rows.weight[i]), 12)
            if nxt >= threshold:
                yield nxt, int(rows.nodes[rows.dst[i]]), int(rows.kind[i])


def grow(edges: DataFrame, roots: DataFrame, steps: int, threshold: float, top_k: int, mask: Iterable[int], rigor: float = 1.0, profile: str = "floating", kernel_edges: int = HELD_EDGES) -> DataFrame:
    """(root, node_id, energy, depth, path) of up to ``top_k`` nodes around each root, best energy first. Rigor scales the
    root's energy once. If the edges of the mask, else those that any root can reach, are counted to be no more than
    ``kernel_edges``, each task holds them in compressed rows; else each root's own reachable edges go to its search."""
    check(steps, threshold, top_k, rigor)
    inside, factors = frozenset(mask) - {BLOCKER}, {i + 1: a for i, a in enumerate(ATTENUATION[profile])}
    att = np.array([factors.get(t, 0.0) for t in range(128)])
    roots = cut(roots.select(F.col("node_id").cast("long").alias("node_id")).distinct())
    sc, names = roots.sparkSession.sparkContext, ["root", "node_id", "energy", "depth", "path"]
    schema = "root long, node_id long, energy double, depth long, path array<int>"
    # Steps round to 12 places, up as well as down.
    least = max(threshold - 1e-11, 0.0) / max(rigor, 1.0)
    near = prepared(edges, inside)
    if near.count() > kernel_edges:
        near = reachable(near, roots, steps, inside, least, profile, 1.0)

    def around(rows: Rows, some: Iterable[int]) -> pd.DataFrame:
        grows, hubs = not rows.greatest(factors, 1.0) < 1 - 1e-6 or threshold < 1e-9, {}
        return pd.DataFrame([(r, *x) for r in some for x in _grow(rows, r, steps, threshold, att, rigor, top_k, grows, hubs)], columns=names)

    if near.count() <= kernel_edges:
        held = sc.broadcast(Rows.of(*columns(near), inside))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield around(held.value, pdf["node_id"].dropna().astype("int64").tolist())

        return roots.repartition(TASKS_A_CORE * sc.defaultParallelism, "node_id").mapInPandas(run, schema)
    levels = hop_levels(attenuated(near, profile), roots.withColumn("root", F.col("node_id")), max(steps - 1, 0), least * (1 - 1e-9), inside, groups=["root"])
    own = levels.select("root", F.col("node_id").alias("src")).distinct().join(near, "src", "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf.dropna(subset=["dst"])
        return around(Rows.of(*[e[c].to_numpy(t) for c, t in (("src", "int64"), ("dst", "int64"), ("edge_type", "int64"), ("weight", "float64"))], inside), [int(pdf["root"].iloc[0])])

    return own.groupBy("root").applyInPandas(one, schema)


def export(nodes: DataFrame, edges: DataFrame, held_edges: int = HELD_EDGES) -> DataFrame:
    """(root, stream): one text per root with its nodes and the edges between them, in canonical order, with the SHA-256 of
    its content. The number of nodes per root is bounded by ``grow``'s top_k, that of edges by what lies between them.

    Edges counted to be no more than ``held_edges`` are held by each task, which looks up those between a root's nodes; else they are
    joined with the pairs of these."""
    usable = edges.filter(F.col("edge_type") != BLOCKER).select("src", "dst", F.col("edge_type").cast("int").alias("edge_type"), "weight")
    n = usable.agg(F.count(F.lit(1)), F.count(F.when(F.col("weight").isNull(), 1))).first()
    order = F.array_sort(F.collect_list(F.struct("node_id", "energy", "depth", "path"))).alias("nodes")
    if n[0] <= held_edges and not n[1]:
        body = _with_inner(nodes.groupBy("root").agg(order), usable.filter("src IS NOT NULL AND dst IS NOT NULL"))
    else:
        nodes = cut(nodes)
        pairs = nodes.select("root", F.col("node_id").alias("src")).join(nodes.select("root", F.col("node_id").alias("dst")), "root")
        # Pairs of a root's nodes are few; edges of a hub, which is in many roots, would be many before they meet their target.
        inner = induced(usable, nodes).distinct().join(pairs, ["src", "dst"])
        links = inner.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("src", "edge_type", "dst", "weight"))).alias("edges"))
        body = nodes.groupBy("root").agg(order).join(links, "root", "left")
    none = F.array().cast("array<struct<src:bigint,edge_type:int,dst:bigint,weight:double>>")
    body = body.select("root", F.to_json(F.struct("root", "nodes", F.coalesce("edges", none).alias("edges"))).alias("content"))
    return body.select("root", F.to_json(F.struct(F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), F.sha2("content", 256).alias("content_sha256"), "content")).alias("stream"))


def _with_inner(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots and their ``nodes`` with the distinct ``edges`` between these in their order, by tasks that hold all edges by
    their ends."""
    got = edges.select("src", "dst", F.col("edge_type").cast("byte"), F.col("weight").cast("double")).distinct().toArrow()
    src, dst, kind, weight = (got[c].to_numpy() for c in ("src", "dst", "edge_type", "weight"))
    del got
    ends, by = np.union1d(src, dst), np.lexsort((weight, dst, kind, src))
    src, dst, kind, weight = np.searchsorted(ends, src[by]), np.searchsorted(ends, dst[by]), kind[by], weight[by]
    key = src * len(ends) + dst
    rank = np.argsort(key, kind="stable")
    held = points.sparkSession.sparkContext.broadcast((ends, key[rank], rank.astype(np.int32), src.astype(np.int32), dst.astype(np.int32), kind, weight))
    link = [pa.field("src", pa.int64()), pa.field("edge_type", pa.int32()), pa.field("dst", pa.int64()), pa.field("weight", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, keys, rank, src, dst, kind, weight = held.value
        known, have = np.append(ends, 0), np.append(keys, -1)

        def between(mine: np.ndarray) -> np.ndarray:
            """The edges between some nodes, in the order of source, type, target and weight."""
            place = np.searchsorted(ends, mine)
            place = place[(place < len(ends)) & (known[place] == mine)]
            pair = (place[:, None] * len(ends) + place).ravel()
            start = np.searchsorted(keys, pair)
            hit = np.flatnonzero(have[start] == pair)
            start, count = start[hit], np.searchsorted(keys, pair[hit], "right") - start[hit]
            return np.sort(rank[np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)])

        def handed(b: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
            edge, ends_at = np.concatenate(found), np.append(0, np.cumsum([len(x) for x in found]))
            links = pa.StructArray.from_arrays([pa.array(ends[src[edge]]), pa.array(kind[edge].astype(np.int32)), pa.array(ends[dst[edge]]), pa.array(weight[edge])], fields=link)
            return pa.record_batch([b.column("root"), b.column("nodes"), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), links)], ["root", "nodes", "edges"])

        for b in batches:
            every, at = b.column("nodes").flatten().field("node_id").to_numpy(), np.append(0, np.cumsum(b.column("nodes").value_lengths().to_numpy()))
            begin, n, found = 0, 0, []
            for i in range(len(b)):
                found.append(between(np.unique(every[at[i] : at[i + 1]])))
                n += len(found[-1])
                if n >= BATCH_EDGES or i + 1 == len(b):
                    yield handed(b.slice(begin, i + 1 - begin), found)
                    begin, n, found = i + 1, 0, []

    schema = f"root {points.schema['root'].dataType.simpleString()}, nodes {points.schema['nodes'].dataType.simpleString()}, edges array<struct<src:bigint,edge_type:int,dst:bigint,weight:double>>"
    return points.mapInArrow(run, schema)


CONTENT = (
    "root bigint, nodes array<struct<node_id: bigint, energy: double, depth: bigint, path: array<int>>>, "
    "edges array<struct<src: bigint, edge_type: int, dst: bigint, weight: double>>"
)


def decode(streams: DataFrame) -> DataFrame:
    """Streams with ``problem`` (null if there is none: MAGIC, VERSION, HASH or CANONICAL) and the parsed ``content``.
    A stream must be exactly what ``export`` writes of its content."""
    outer = F.from_json("stream", "magic string, version int, content_sha256 string, content string")
    rows = streams.withColumn("__o", outer).withColumn("content", F.from_json(F.col("__o.content"), CONTENT))
    again = F.to_json(F.struct(F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), F.sha2(F.col("__o.content"), 256).alias("content_sha256"), F.col("__o.content").alias("content")))
    problem = (
        F.when(~F.col("__o.magic").eqNullSafe(F.lit(MAGIC)), "MAGIC").when(~F.col("__o.version").eqNullSafe(F.lit(VERSION)), "VERSION")
        .when(~F.col("__o.content_sha256").eqNullSafe(F.sha2(F.col("__o.content"), 256)), "HASH")
        .when((F.to_json("content") != F.col("__o.content")) | (again != F.col("stream")), "CANONICAL")
    )
    return rows.withColumn("problem", problem).drop("__o")


def patch(edges: DataFrame, imported: DataFrame, streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after importing good streams, and the hashes imported by now. A stream whose hash was imported is skipped, so
    importing again changes nothing; repeated edges count once."""
    good = decode(streams).filter("problem IS NULL").withColumn("stream_hash", F.sha2("stream", 256))
    new = good.join(imported.select("stream_hash"), "stream_hash", "left_anti")
    more = new.select(F.explode("content.edges").alias("e")).select("e.src", "e.dst", "e.edge_type", "e.weight")
    return edges.select("src", "dst", "edge_type", "weight").union(more).distinct(), imported.select("stream_hash").union(new.select("stream_hash")).distinct()


def of_waves(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waves of several seeds as a subgraph: nodes (node_id, energy, n_seeds: how many seeds reach it) and induced edges."""
    nodes = rows.groupBy("node_id").agg(F.max("energy").alias("energy"), F.count_distinct("seed").alias("n_seeds"))
    return nodes, induced(edges, nodes)


def around(edges: DataFrame, seeds: DataFrame, max_steps: int, threshold: float, mask: Iterable[int]) -> tuple[DataFrame, DataFrame]:
    """``of_waves`` of the best-first waves from all seeds, whose nodes are added up where they are found. Nodes counted to
    be few are broadcast, so that no edge is shuffled."""
    nodes = cut(reached(edges, seeds, max_steps, threshold, mask))
    ends = nodes.select("node_id")
    return nodes, induced(edges, F.broadcast(ends) if nodes.count() <= BROADCAST_NODES else ends)
