"""Connected components by contraction with random priorities.

Each task first folds blocks of its edges into stars around the smallest node, without a
shuffle. Once the edges left fit one block, a single task's stars are the components. Until then, in each round every
node hooks to its neighbour (or itself) of the lowest priority and edges are rewritten to those parents and folded
again. Priorities are ids, which end stars at once, and hashes in turn, so chains of rising ids shrink by a constant
factor too. No node's edges are gathered in one place: minima are partial sums, and look-ups are joins whose hot
keys AQE splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import Scratch

MAX_ROUNDS = 60
#: Edges that a task folds at a time.
BLOCK_EDGES = 1 << 18


def stars(edges: Iterable[tuple], roots: bool = False) -> list[tuple]:
    """The same components as stars: (smallest node, node) for each other node of an edge, and for itself where it is
    a loop's only node or `roots` are wanted."""
    above: dict = {}
    alone = set()

    def top(x):
        while (p := above.get(x, x)) != x:
            above[x] = x = above.get(p, p)
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
        else:
            alone.add(a)
    out = [(top(x), x) for x in list(above)]
    below = {r for r, _ in out}
    return out + [(x, x) for x in (alone | below if roots else alone - below) if x not in above]


def _fold(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    def folded(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        pairs = stars((e for batch in block for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), roots)
        schema = block[0].schema
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], schema.field(k).type) for k in (0, 1)], schema=schema)

    block, held = [], 0
    for batch in batches:
        block.append(batch)
        held += batch.num_rows
        if held >= BLOCK_EDGES and not roots:
            yield folded(block)
            block, held = [], 0
    if block:
        yield folded(block)


def fold(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of each task as stars, block by block; nodes that have loops only keep one."""
    return edges.mapInArrow(_fold, edges.schema)


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node. Loops and repeated edges do no harm; null ends are dropped."""
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    left = scratch.save(fold(edges))
    one_block = lambda df: scratch.save(df.coalesce(1).mapInArrow(partial(_fold, roots=True), df.schema))
    if left.count() <= BLOCK_EDGES:
        return one_block(left).select(F.col("b").alias("node"), F.col("a").alias("component"))
    hooks = scratch.save(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    left = left.where("a <> b")
    for k in range(MAX_ROUNDS):
        n = left.count()
        if n <= BLOCK_EDGES:
            if n:
                last = scratch.large(one_block(left).select(F.col("b").alias("node_"), F.col("a").alias("parent")))
                hooks = hooks.join(last, hooks["root"] == last["node_"], "left").select("node", F.coalesce("parent", "root").alias("root"))
            break
        rank = lambda c: F.struct((F.xxhash64(F.lit(k), c) if k % 2 else F.lit(0)).alias("h"), c.alias("id"))
        both = left.select("a", "b").union(left.select("b", "a"))
        parents = scratch.save(both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("node_"), F.least("m", rank(F.col("a")))["id"].alias("parent")))
        near = scratch.large(parents)
        ends = left.join(near, left["a"] == near["node_"]).select(F.col("parent").alias("pa"), "b")
        ends = ends.join(near, ends["b"] == near["node_"]).select("pa", F.col("parent").alias("pb")).where("pa <> pb")
        # Written and read again, so that a task folds many small parts together.
        rewritten = scratch.save(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        left = scratch.save(fold(rewritten))
        moved = hooks.join(near, hooks["root"] == near["node_"], "left").select("node", F.coalesce("parent", "root").alias("root"))
        old, hooks = hooks, scratch.save(moved)
        scratch.drop(rewritten, parents, old)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    label = hooks.groupBy("root").agg(F.min("node").alias("component"))
    return scratch.save(hooks.join(label, "root").select("node", "component"))
