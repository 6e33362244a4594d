"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestmill.functions.scale import materialize

# Links that are gathered before they are replaced by stars; stars beyond half of it are handed on.
MOST_LINKS = 1 << 18


def star_links(a: np.ndarray, b: np.ndarray, hash_a: np.ndarray, hash_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The links of stars that connect what ``a`` and ``b`` connect, with their hashes: each node with that of the smallest hash."""
    nodes, first, place = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    hashes = np.concatenate([hash_a, hash_b])[first]
    order = np.lexsort((nodes, hashes))
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    one, other = rank[place[: len(a)]], rank[place[len(a) :]]
    root = np.arange(len(nodes))
    while len(one):
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]
        one, other = root[one], root[other]
        apart = one != other
        one, other = one[apart], other[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    centre, leaf = order[root[moved]], order[moved]
    return nodes[centre], nodes[leaf], hashes[centre], hashes[leaf]


def stars(links: DataFrame) -> DataFrame:
    """``a, b``: links that connect the same, fewer than each partition has nodes of (whole numbers) ``a`` and ``b``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            return star_links(*(np.concatenate(parts) for parts in zip(*held, strict=True)))

        def rows(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in found[:2]], ["a", "b"])

        for batch in batches:
            held.append(tuple(column.to_numpy(zero_copy_only=False) for column in batch.columns))
            if sum(len(part[0]) for part in held) >= MOST_LINKS:
                held = [merged()]
                if len(held[0][0]) >= MOST_LINKS // 2:
                    yield rows(held.pop())
        if held:
            yield rows(merged())

    ends = [F.col(end).cast("long") for end in ("a", "b")]
    hashed = links.select(*(end.alias(name) for end, name in zip(ends, "ab", strict=True)), *(F.xxhash64(end).alias(f"hash_{name}") for end, name in zip(ends, "ab", strict=True)))
    return hashed.filter("a <> b").mapInArrow(run, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (whole numbers ``a`` and ``b``): equal roots for connected nodes.

    Each partition first replaces its links by stars. Then in each round every node points to the neighbour with the
    smallest hash, or to itself, and links are redrawn between those. Hashes put the nodes in random order, so each
    round removes a constant share of them whatever the shape. Neighbour minima are combined before the shuffle and
    every join reads checkpointed tables, whose hot keys adaptive execution may split; nothing is gathered by node.
    """
    current = materialize(stars(links).distinct())
    pointers = None
    while not current.isEmpty():
        both = current.union(current.select("b", "a"))
        smallest = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("node")))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("node"))
        steps = both.groupBy("a").agg(smallest.alias("m")).select(F.col("a").alias("node"), F.least(own, F.col("m"))["node"].alias("root"))
        steps = materialize(steps)
        if pointers is None:
            pointers = steps
        else:
            later = steps.select(F.col("node").alias("root"), F.col("root").alias("next"))
            pointers = materialize(pointers.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        of_a, of_b = (steps.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")) for end in ("a", "b"))
        redrawn = current.join(of_a, "a").join(of_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        current = materialize(stars(redrawn).distinct())
    return pointers if pointers is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).filter("false")
