"""Pointer jumping over parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.plans.scratch import Scratch
from logmill.plans.skew import join_one

MAX_ROUNDS = 64


def jump(links: DataFrame, scratch: Scratch, paths: bool = False) -> DataFrame:
    """Root and depth of every node, and its path if ``paths``, by doubling the jump in each round.

    ``links``: (node, parent), one row a node; parent is null at a root and otherwise a node of ``links``.
    Returns (node, root, depth[, path]); path is the array of nodes from the root to the node. A node in a cycle or
    below one has root and path null and depth -1.

    A round joins each open node with the state of the node it points to, so a pointer that spans d links
    spans 2d afterwards. Round k closes exactly the nodes of depth 2^(k-1) to 2^k - 1. A node at a greater
    depth has ancestors at all lesser ones, so a round that closes none proves that the open rest is cyclic:
    log2(deepest) + 2 rounds in all, whatever the cycles. The open nodes are counted while a round is written.
    """
    with_path = [F.array("node").alias("path")] if paths else []
    start = links.select("node", F.col("parent").alias("ptr"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), *with_path)
    is_open = F.col("ptr").isNotNull()
    state, left = scratch.write_counting(start, "jump-0", is_open)
    done, todo = state.filter(~is_open), state.filter(is_open)
    for k in range(1, MAX_ROUNDS):
        if not left:
            break
        other = done.unionByName(todo).select(F.col("node").alias("ptr"), F.col("ptr").alias("o_ptr"), F.col("root").alias("o_root"), F.col("depth").alias("o_depth"), *([F.col("path").alias("o_path")] if paths else []))
        stepped = join_one(todo.drop("root"), other, ["ptr"], rows=left).select(
            "node",
            F.col("o_ptr").alias("ptr"),
            F.col("o_root").alias("root"),
            (F.col("depth") + F.col("o_depth")).alias("depth"),
            *([F.concat("o_path", "path").alias("path")] if paths else []),
        )
        state, now = scratch.write_counting(stepped, f"jump-{k}", is_open)
        done, todo = done.unionByName(state.filter(~is_open)), state.filter(is_open)
        if now == left:
            break
        left = now
    none = F.lit(None)
    lost = todo.select("node", none.cast(todo.schema["root"].dataType).alias("root"), F.lit(-1).cast("long").alias("depth"), *([none.cast(todo.schema["path"].dataType).alias("path")] if paths else []))
    return done.drop("ptr").unionByName(lost)
