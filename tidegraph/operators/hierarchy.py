"""Paths, depths, roots and descendants in parent-child data of unknown depth, with cycles found.

Leaves are peeled from the bottom up, round by round, and chains of nodes with one child and one parent are contracted on
the way, so that the number of rounds grows with the logarithm of the depth. What can't be peeled holds the cycles. In
the reverse order of the peeling, every node takes its roots, depths and paths from the parents it had when it was
peeled, which were peeled later. Each round peels a share of what is left, so all later rounds together are no larger
than a few times the round that reads them. Every round is a job over all executors, at every size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut


def clean_id(column: str):
    """Ids compare in lower case without outer white space; blank ids are null."""
    c = F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))
    return F.when(c != "", c)


def clean_links(events: DataFrame, node: str, parents: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, is_root) and links (node, parent) between existing nodes, each once, from rows with a list of parents.

    A node's parents are the union over its rows. Null and blank ids are dropped. A root names no parent that exists.
    """
    rows = events.select(clean_id(node).alias("node"), F.col(parents).alias("parents")).filter("node IS NOT NULL")
    named = rows.select("node", F.explode("parents").alias("parent")).select("node", clean_id("parent").alias("parent"))
    nodes = rows.select("node").distinct()
    links = named.filter("parent IS NOT NULL").distinct().join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent")
    links = cut(links)
    has = links.select("node").distinct().withColumn("is_root", F.lit(False))
    nodes = cut(nodes.join(has, "node", "left").select("node", F.coalesce("is_root", F.lit(True)).alias("is_root")))
    return nodes, links


@dataclass
class Peeled:
    """``rounds``: of each round, from the first on, the links by which its nodes hang on nodes peeled later: (node,
    parent, w, inner). ``cycles``: (node, root_id), those on a cycle. ``links``: the links between nodes off cycles."""

    nodes: DataFrame
    links: DataFrame
    cycles: DataFrame
    rounds: list[DataFrame]


def _components(links: DataFrame) -> DataFrame:
    """(node, root_id) of the nodes on cycles by colouring, for a rest too large for one task.

    Each node takes the smallest id that reaches it; within a colour, the nodes that reach its namesake are its cycle.
    Those are taken out and the rest is coloured again, until no link is left.
    """
    found: list[DataFrame] = []
    loops = links.filter("node = parent").select("node", F.col("node").alias("root_id"))
    rest = cut(links.filter("node <> parent"))
    while True:
        # Only nodes with a child and a parent can be on a cycle.
        while True:
            inner = rest.join(rest.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
            inner = cut(inner.join(inner.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("node", "parent"))
            before, after = rest.count(), inner.count()
            rest = inner
            if before == after:
                break
        if not after:
            break
        colour = cut(rest.select("node").union(rest.select("parent")).distinct().withColumn("colour", F.col("node")))
        while True:
            sent = rest.join(colour, "node").groupBy(F.col("parent").alias("node")).agg(F.min("colour").alias("sent"))
            new = cut(colour.join(sent, "node", "left").select("node", F.least("colour", "sent").alias("colour"), (F.col("sent") < F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if new.filter("moved").isEmpty():
                break
        inside = rest.join(colour, "node").join(colour.select(F.col("node").alias("parent"), F.col("colour").alias("pc")), "parent").filter("colour = pc")
        inside = cut(inside.select("node", "parent", "colour"))
        mine = cut(colour.filter("node = colour"))
        front = mine
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("parent"), "colour"), ["parent", "colour"]).select("node", "colour").distinct()
            front = cut(back.join(mine, ["node", "colour"], "left_anti"))
            mine = cut(mine.union(front))
        sizes = mine.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        # A colour whose namesake is on no cycle only loses its namesake.
        found.append(cut(mine.join(sizes, "colour", "left_semi").select("node", F.col("colour").alias("root_id"))))
        gone = mine.select("node")
        rest = cut(rest.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "parent"))
    out = loops
    for f in found:
        out = out.union(f)
    return cut(out.groupBy("node").agg(F.min("root_id").alias("root_id")))


LEAF, CHAIN, REST = 0, 1, 2


def _round(rest: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """One round over links (node, parent, w, inner, turn), where ``w`` links and the nodes ``inner`` of chains lie in
    between. ``turn`` is the number of the round, as a column, so that all rounds have the same plan and compiled code.

    Rows by ``kind``: LEAF, the links of nodes without a child, which are peeled. CHAIN, the link of a node with one
    child and one parent that is peeled too, as its hash is smaller than that of both neighbours (so these aren't); its
    child, be it a leaf or not, is linked to its parent instead. So what is peeled hangs on nodes of later rounds alone.
    REST, the links that are left, the lightest of parallel ones. Also returns the number of rows of each kind.
    """
    order = lambda c: F.xxhash64(F.col(c), F.col("turn"))
    kids = rest.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
    ups = rest.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("parent", "w", "inner")).alias("up"), F.min("turn").alias("turn"))
    both = ups.join(kids, "node", "left")
    leaves = both.filter("n IS NULL").select("node", F.lit(True).alias("leaf"))
    links = rest.join(leaves, "node", "left")
    chains = both.filter("n = 1 AND m = 1 AND child <> node").select("node", "child", "up", "turn")
    chosen = chains.filter((order("node") < order("child")) & (order("node") < order("up.parent")))
    edit = F.array(
        F.struct("node", F.col("up.parent").alias("parent"), F.lit(None).cast("struct<parent:string,w:bigint,inner:array<string>>").alias("to"), F.col("child")),
        F.struct(F.col("child").alias("node"), F.col("node").alias("parent"), F.col("up").alias("to"), F.lit(None).cast("string").alias("child")),
    )
    edits = chosen.select(F.explode(edit).alias("e")).select("e.*", F.lit(True).alias("edited"))
    links = links.join(edits, ["node", "parent"], "left")
    drops = F.col("edited") & F.col("to").isNull()
    kind = F.when(F.col("leaf"), F.lit(LEAF)).when(drops, F.lit(CHAIN)).otherwise(F.lit(REST))
    moved = F.col("to").isNotNull()
    inner = F.concat("to.inner", F.array("parent"), "inner")
    links = links.select(
        kind.alias("kind"), "node", F.when(moved, F.col("to.parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(moved, F.col("w") + F.col("to.w")).otherwise(F.col("w")).alias("w"), F.when(moved, inner).otherwise(F.col("inner")).alias("inner"), "child", "turn",
    )
    best = links.groupBy("kind", "node", "parent").agg(F.min(F.struct("w", "inner")).alias("b"), F.min("child").alias("child"), F.min("turn").alias("turn"))
    out = best.select("kind", "node", "parent", "b.w", "b.inner", "child", (F.col("turn") + 1).alias("turn"))
    seen = Observation()
    out = cut(out.observe(seen, *[F.count(F.when(F.col("kind") == k, 1)).alias(str(k)) for k in (LEAF, CHAIN, REST)]))
    return out, {int(k): n for k, n in seen.get.items()}


def peel(nodes: DataFrame, links: DataFrame, with_path: bool = False) -> Peeled:
    """Peels leaves and contracts chains, round by round, and finds the nodes on cycles in what is left.

    Links to itself put a node on a cycle. ``links`` must be distinct pairs of existing nodes. ``inner`` is kept only
    ``with_path``. A round in which nothing is peeled (but chains are left) is one whose hashes chose none of them.
    """
    spark = nodes.sparkSession
    no_inner = F.array().cast("array<string>") if with_path else F.lit(None).cast("array<string>")
    rest = links.select("node", "parent", F.lit(1).cast("long").alias("w"), no_inner.alias("inner"), F.lit(0).alias("turn"))
    rounds: list[DataFrame] = []
    chains: list[DataFrame] = []
    cycles = spark.createDataFrame([], "node string, root_id string")
    n_links, found_cycles = links.count(), False
    while n_links:
        done, counts = _round(rest)
        rest, n_links = done.filter(F.col("kind") == REST).select("node", "parent", "w", "inner", "turn"), counts[REST]
        if counts[LEAF] or counts[CHAIN]:
            rounds.append(done.filter(F.col("kind") != REST).select("node", "parent", "w", "inner"))
            if counts[CHAIN]:
                chains.append(done.filter(F.col("kind") == CHAIN).select("node", "parent", "child"))
        elif not _has_chains(rest):
            if found_cycles:
                raise AssertionError("links are left that no peeling removes")
            cycles, found_cycles = _unfold_cycles(_components(rest.select("node", "parent")), chains), True
            gone = cycles.select("node")
            rest = cut(rest.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "parent", "w", "inner", "turn"))
            n_links = rest.count()
    off = links
    if found_cycles:
        cycles = _name_cycles(cycles)
        gone = cycles.select("node")
        off = cut(links.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "parent"))
    return Peeled(nodes, off, cycles, rounds)


def _has_chains(rest: DataFrame) -> bool:
    kids = rest.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
    ups = rest.groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    return not ups.join(kids, "node").filter("n = 1 AND m = 1 AND child <> node").isEmpty()


def _unfold_cycles(cycles: DataFrame, chains: list[DataFrame]) -> DataFrame:
    """Adds the contracted nodes of cycles. ``cycles`` are nodes that were never contracted; a contracted one lies on a
    cycle if both the first such node above it and the first below it do. Pointers to these double their reach in each
    pass, over the nodes contracted later."""
    if not chains:
        return cycles
    every = chains[0]
    for x in chains[1:]:
        every = every.union(x)
    every = cut(every.select("node", F.col("parent").alias("up"), F.col("child").alias("down"), F.lit(True).alias("moved")))
    while True:
        up = every.select(F.col("node").alias("up"), F.col("up").alias("up_2"))
        down = every.select(F.col("node").alias("down"), F.col("down").alias("down_2"))
        next_ = every.join(up, "up", "left").join(down, "down", "left")
        moved = F.col("up_2").isNotNull() | F.col("down_2").isNotNull()
        next_ = next_.select("node", F.coalesce("up_2", "up").alias("up"), F.coalesce("down_2", "down").alias("down"), moved.alias("moved"))
        # Values out of an aggregation carry no constraints, which else multiply in the planner from pass to pass.
        next_ = next_.groupBy("node").agg(F.min("up").alias("up"), F.min("down").alias("down"), F.max("moved").alias("moved"))
        seen = Observation()
        every = cut(next_.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("n")))
        if not seen.get["n"]:
            break
    above = cycles.select(F.col("node").alias("up"), "root_id")
    below = cycles.select(F.col("node").alias("down"), "root_id")
    return cycles.union(cut(every.join(above, "up").join(below, ["down", "root_id"], "left_semi").select("node", "root_id")))


def _name_cycles(cycles: DataFrame) -> DataFrame:
    names = cycles.groupBy("root_id").agg(F.min("node").alias("name"))
    return cut(cycles.join(names, "root_id").select("node", F.col("name").alias("root_id")))


def assign(peeled: Peeled, with_path: bool = False) -> DataFrame:
    """(node, root_id, depth[, path]) for each node off cycles and each root it can be traced to off cycles.

    ``depth`` is the smallest number of links; of several shortest paths, ``path`` (from the root to the node) is the
    smallest in the order of its ids. Rounds are done from the last to the first.
    """
    extra = [F.array("node").alias("path")] * with_path
    done = [peeled.nodes.filter("is_root").select("node", F.col("node").alias("root_id"), F.lit(0).cast("long").alias("depth"), *extra)]
    order = F.struct("depth", *["path"] * with_path)
    for links in reversed(peeled.rounds):
        have = done[0]
        for x in done[1:]:
            have = have.union(x)
        mine = links.select(F.col("node").alias("child"), F.col("parent").alias("node"), "w", "inner")
        path = [F.concat("path", "inner", F.array("child")).alias("path")] * with_path
        step = have.join(mine, "node").select("child", "root_id", (F.col("depth") + F.col("w")).alias("depth"), *path)
        step = step.groupBy("child", "root_id").agg(F.min(order).alias("b"))
        done.append(cut(step.select(F.col("child").alias("node"), "root_id", "b.depth", *["b.path"] * with_path)))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def descendants(links: DataFrame) -> DataFrame:
    """(node, descendant, distance): each node with all its descendants, as rows, so no list outgrows a task.

    ``links`` (node, parent) must hold no cycle. Children send their lists to their ancestors: in the k-th round every
    node takes, from its descendants at a distance of 2^k exactly, what they have up to that distance. So lists double
    their reach, a row is sent once for each shortest path's middle, and the rounds are the logarithm of the height.
    """
    have = cut(links.select(F.col("parent").alias("node"), F.col("node").alias("descendant"), F.lit(1).cast("long").alias("distance")))
    reach, parts = 1, [have]
    while True:
        middle = have.filter(F.col("distance") == reach).select("node", F.col("descendant").alias("via"))
        lists = parts[0]
        for x in parts[1:]:
            lists = lists.union(x)
        sent = middle.join(lists.withColumnRenamed("node", "via"), "via").select("node", "descendant", (F.col("distance") + reach).alias("distance"))
        new = sent.groupBy("node", "descendant").agg(F.min("distance").alias("distance")).join(lists, ["node", "descendant"], "left_anti")
        have = cut(new)
        if have.isEmpty():
            return lists
        parts.append(have)
        reach *= 2


def hierarchy(events: DataFrame, node: str, parents: str, with_path: bool = False) -> DataFrame:
    """(provenance_id, root_id, depth[, path]) over all nodes; a node on a cycle gives one row with depth -1, as root_id
    the smallest id on its cycles and a null path. Empty tables give no rows; see ``clean_links`` for nulls and repeats.
    """
    nodes, links = clean_links(events, node, parents)
    peeled = peel(nodes, links, with_path)
    rows = assign(peeled, with_path)
    rings = peeled.cycles.select("node", "root_id", F.lit(-1).cast("long").alias("depth"), *[F.lit(None).cast("array<string>").alias("path")] * with_path)
    return rows.union(rings).withColumnRenamed("node", "provenance_id")


def latest_object(events: DataFrame) -> DataFrame:
    """(node, object_id): of each event, the object_id of its row with the highest sequence_no (null object_ids give way)."""
    key = F.when(F.col("object_id").isNotNull(), F.struct("sequence_no", "object_id"))
    return events.select(clean_id("provenance_id").alias("node"), "sequence_no", "object_id").filter("node IS NOT NULL").groupBy("node").agg(F.max(key).getField("object_id").alias("object_id"))
