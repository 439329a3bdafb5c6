"""Graph operators on edge tables. Loops end on a convergence test and raise when ``max_rounds`` is exceeded."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is the smallest node reachable.

    Alternates large-star and small-star rounds: each is one min-aggregation and one join on the node, so a hub with a
    large share of the edges is pre-aggregated in the first and split by adaptive skew handling in the second. ``settle``
    writes the edges of a round where all executors can read them.
    """
    u, v = F.col("u"), F.col("v")
    e = settle(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(u > v).distinct())
    before = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return e.select(u.alias("node"), v.alias("component")).union(e.select(v.alias("node"), v.alias("component")).distinct())
        before = now
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        e = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"connected_components did not converge in {max_rounds} rounds")


def closure(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst", seeds: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """(src, dst, depth) of every reachable pair, depth the fewest edges; from the seeds (column ``src``) only, if given.

    Each round extends the newest pairs by one edge and drops what is known: work is per new pair, not per path.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    front = settle((e.join(seeds.select("src").distinct(), "src", "left_semi") if seeds is not None else e).withColumn("depth", F.lit(1)))
    known = front
    for depth in range(2, max_rounds + 2):
        step = front.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        front = settle(step.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return known
        known = known.union(front)
    raise RuntimeError(f"closure did not end in {max_rounds} rounds")


def layers(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, layer): 0 for nodes that depend on nothing, else one more than the deepest dependency; null on or behind a cycle.

    Kahn's peeling, one round per layer: the nodes all of whose dependencies (src depends on dst) have a layer.
    """
    e = settle(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    left = e
    done = settle(nodes.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(0)))
    new = done
    for k in range(1, max_rounds + 1):
        left = settle(left.join(new.select(F.col("node").alias("dst")), "dst", "left_anti"))
        waiting = left.select(F.col("src").alias("node")).distinct()
        new = settle(nodes.join(waiting, "node", "left_anti").join(done.select("node"), "node", "left_anti").withColumn("layer", F.lit(k)))
        if new.isEmpty():
            return nodes.join(done, "node", "left")
        done = settle(done.union(new))
    raise RuntimeError(f"layers did not end in {max_rounds} rounds")


def longest_path(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, depth): edges on the longest way down from a node of a graph without cycles."""
    return layers(edges, settle, src, dst, max_rounds).withColumnRenamed("layer", "depth")


def circuits(near: dict, start) -> Iterator[list]:
    """Johnson's search: every elementary cycle through ``start`` of a graph whose nodes all lie on a way back to it.

    A node whose search found no cycle stays blocked until one of the nodes behind it is on a cycle again, so between two
    cycles no edge is tried more than twice.
    """
    blocked, waiting, path, open_, found = {start}, defaultdict(set), [start], [iter(near[start])], [False]
    while open_:
        step = next(open_[-1], None)
        if step == start and step is not None:
            yield [*path, start]
            found[-1] = True
        elif step is not None:
            if step not in blocked:
                blocked.add(step)
                path.append(step), open_.append(iter(near[step])), found.append(False)
        else:
            node, led = path.pop(), found.pop()
            open_.pop()
            if led:
                free = [node]
                while free:
                    n = free.pop()
                    if n in blocked:
                        blocked.discard(n)
                        free += waiting.pop(n, ())
                if found:
                    found[-1] = True
            else:
                for n in near[node]:
                    waiting[n].add(node)


def _from_smallest(edges: list[tuple], starts: list) -> Iterator[list]:
    """The cycles of a component whose smallest node is one of the starts."""
    out, into = defaultdict(list), defaultdict(list)
    for a, b in edges:
        out[a].append(b), into[b].append(a)

    def reached(start, near: dict) -> set:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()]:
                if n > start and n not in seen:
                    seen.add(n), todo.append(n)
        return seen

    for start in starts:
        both = reached(start, out) & reached(start, into)
        if len(both) > 1:
            yield from circuits({n: sorted(m for m in out[n] if m in both) for n in both}, start)


def cycles(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst", max_edges: int = 100_000, starts: int = 64) -> DataFrame:
    """(path, length): every elementary cycle, of any length, once, from its smallest node; path repeats it at the end.

    A cycle lies inside a component. Each component's edges go to tasks that search from up to ``starts`` of its nodes
    each, inside the strong component that the node has among larger ones; cycles are streamed out as they are found.
    Components of more than ``max_edges`` edges are split into their strong ones first. A strong component of more is an
    error (its edges are held by one task, and its cycles may be more than can be listed).
    """
    e = settle(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    apart = e.where("src <> dst")

    def inside(some: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
        of = lambda c, name: label.select(F.col("node").alias(c), F.col("component").alias(name))
        own = settle(some.join(of("src", "component"), "src").join(of("dst", "_to"), "dst").where("component = _to").select("component", "src", "dst"))
        return own, settle(own.groupBy("component").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("nodes")))

    inner, size = inside(apart, connected_components(apart, settle).distinct())
    too_large = F.col("edges") > max_edges
    if not size.where(too_large).isEmpty():  # only where the weak components do not fit are the strong ones looked for here
        wide = inner.join(size.where(too_large).select("component"), "component", "left_semi").select("src", "dst")
        few, few_size = inside(wide, strong_components(wide, settle))
        inner = inner.join(size.where(too_large).select("component"), "component", "left_anti").union(few)
        size = size.where(~too_large).union(few_size)
        large = size.where(too_large).first()
        if large:
            raise ValueError(f"the component of {large['component']} has {large['edges']} edges, more than {max_edges}")
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("nodes") / starts).cast("int") - 1))
    dealt = inner.join(size.select("component", F.ceil(F.col("nodes") / starts).cast("int").alias("parts"), parts.alias("part")), "component")
    kind = e.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = None

        def rows() -> Iterator[tuple]:
            nonlocal node
            for b in batches:
                node = b.schema.field("src").type
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for (_, part, parts), group in groupby(rows(), key=lambda r: r[:3]):
            own = [(a, b) for *_, a, b in group]
            found = _from_smallest(own, sorted({a for a, _ in own})[part::parts])
            while paths := list(islice(found, 4096)):
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.list_(node)), "length": pa.array([len(p) - 1 for p in paths], pa.int32())})

    ordered = dealt.repartition("component", "part").sortWithinPartitions("component", "part").select("component", "part", "parts", "src", "dst")
    loops = e.where("src = dst").select(F.array("src", "dst").alias("path"), F.lit(1).alias("length"))
    return loops.union(ordered.mapInArrow(run, f"path array<{kind}>, length int"))


def change_impact(edges: DataFrame, changed: DataFrame, settle: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, direct, indirect) dependents of each changed node (column ``src``): src depends on dst."""
    back = closure(edges.select(F.col(dst).alias("src"), F.col(src).alias("dst")), settle, seeds=changed)
    n = back.groupBy("src").agg(F.sum((F.col("depth") == 1).cast("long")).alias("direct"), F.sum((F.col("depth") > 1).cast("long")).alias("indirect"))
    return changed.select("src").distinct().join(n, "src", "left").fillna(0).withColumnRenamed("src", "node")


def strong_components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) of the nodes on a cycle; component is the smallest node of the strongly connected component.

    Nodes without an edge in or out are taken off until none is left; the smallest node that reaches each node is its
    label, and what leads back to a label's own node inside the label is a component. Then the same for the rest.
    """
    e = settle(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    found = settle(e.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")))
    e = e.where("src <> dst")
    for _ in range(max_rounds):
        n = None
        while True:
            e = settle(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            now = e.count()
            if now == n:
                break
            n = now
        if not n:
            # a node with a loop of its own may be in a larger component as well
            return found.groupBy("node").agg(F.min("component").alias("component"))
        label = settle(e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
        while True:
            near = e.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
            new = settle(label.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label")))
            moved = not new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
            label = new
            if not moved:
                break
        inner = settle(e.join(label.withColumnRenamed("node", "src"), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").where("label = to").select("src", "dst", "label"))
        part = settle(label.where("node = label"))
        front = part
        while not front.isEmpty():
            back = inner.join(front.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
            front = settle(back.join(part.select("node"), "node", "left_anti"))
            part = settle(part.union(front))
        several = part.groupBy("label").count().where("count > 1").select("label")
        found = settle(found.union(part.join(several, "label", "left_semi").select("node", F.col("label").alias("component"))))
        gone = part.select("node")
        e = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    raise RuntimeError(f"strong_components did not end in {max_rounds} rounds")
