"""Exact n-gram Jaccard self join by T-occurrence search, and the classes it links.

Two sets with a Jaccard similarity of at least ``t`` share a token among the first ``n - ceil(t * n) + 1`` tokens
of each, whatever order all tokens are put in. The join uses this twice before any two texts meet:

1. Sets that are equal are one class, found by a hash of the set; only one document of a class goes on.
2. Half of the hash space is counted: tokens there are met by one document only, or by more. A document with
   enough tokens of its own can have no partner and is done. That is nearly every document of a corpus.
3. The others are counted wholly, and each keeps its rarest tokens. Documents that share one of those are
   candidates, and connected candidates form clusters, which are the units of the search.
4. Within a cluster the T-occurrence search runs over inverted lists as DivideSkip has it: short lists are merged
   by a heap, long lists are probed by binary search, and documents that reach the needed overlap are linked.
   Pairs already known to be connected are not searched again.
5. A cluster beyond one cell is searched cell by cell, each with common representatives. Links need only connect, so
   what then lies in the cluster's largest component is settled among itself; the others meet the cells whose sizes
   they can reach.

Links are closed to components by contraction. Token lists travel as packed arrays with one entry per token
and block of documents, so a passage that a third of all documents share costs one entry per block. Tokens are 64-bit
hashes of shingles, and sets are compared by those.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill.functions.scale import materialize, shared_folder
from digestmill.llm.components import connected
from digestmill.llm.rows import by_ids, numbered_rows, release, released, slim, without_rows
from digestmill.llm.shingles import packed, packed_rising, shingle_set, signature, unpacked, unpacked_rising

PERCENT = 80
# Tokens of one block of documents: what a task gathers before it hands a block on.
BLOCK_TOKENS = 250_000
# Tokens of a bucket of the hash space, which is what one call of a counting task holds.
BUCKET_TOKENS = 1_000_000
# Documents are told apart by their low bits inside a range of ids when counts go back.
RANGE_BITS = 12
# Tokens and documents of one cell of a cluster, the unit of a search task, and representatives of a larger cluster.
CELL_TOKENS, CELL_DOCUMENTS, REPRESENTATIVES = 1_000_000, 500, 16
# DivideSkip's weight of a binary probe against a heap step.
PROBE_WEIGHT = 0.0085
# Members of the largest component that a document is compared with before it is searched.
CENTRES = 8
# Fingerprints in the first count: the upper 48 bits of a hash, of which the lower half of the values counts.
_FINGERPRINT_SHIFT = np.uint64(16)
_REGION = 1 << 47


def needed(size: Column, percent: int) -> Column:
    """Tokens a document must compare: those that any partner has to share one of."""
    return size - F.ceil(size * percent / 100) + 1


def bucket_count(frame: DataFrame, tokens: Column) -> int:
    """Buckets for all tokens of a frame: as many as keep each bounded, and one per shuffle partition at least."""
    total = frame.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("n")).first()["n"]
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BUCKET_TOKENS))


def shingle_summaries(texts: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, sig_a, sig_b, prints`` of every row of a slim frame, in the one pass over all texts.

    ``prints`` holds the fingerprints of the counted half of the hash space, packed.
    """
    names = ["doc_id", "n_shingles", "sig_a", "sig_b", "prints"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sizes, marks, prints = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text)
                sizes.append(len(tokens))
                marks.append(signature(tokens))
                values = tokens[: np.searchsorted(tokens, np.uint64(_REGION << int(_FINGERPRINT_SHIFT)))] >> _FINGERPRINT_SHIFT
                prints.append(packed_rising(np.unique(values)))
            columns = [sizes, [mark[0] for mark in marks], [mark[1] for mark in marks]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(column, pa.int64()) for column in columns), pa.array(prints, pa.binary())], names)

    return texts.mapInArrow(run, "doc_id long, n_shingles long, sig_a long, sig_b long, prints binary")


def own_tokens(prints: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, n_own``: tokens of the counted half of the hash space that no other document has, from ``doc_id, prints``.

    Equal sets count as different documents here: their tokens are nobody's own.
    """
    blocks = prints.mapInArrow(_fingerprint_blocks(buckets), "bucket int, prints binary, owners binary, base long")
    found = blocks.groupBy("bucket").applyInArrow(_single_owners, "id_range long, lows binary")
    return found.groupBy("id_range").applyInArrow(_owner_counts, "doc_id long, n_own long")


def _fingerprint_blocks(buckets: int):
    def block(prints: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        base = min(ids)
        owners = np.repeat(np.array(ids, np.int64) - base + 1, [len(part) for part in prints]).astype(np.uint64)
        values = np.concatenate(prints)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        several = np.diff(np.r_[first, len(values)]) > 1
        values, owners = values[first], np.where(several, np.uint64(0), owners[first])  # owner 0: met more than once
        where = (values.astype(np.float64) * (buckets / _REGION)).astype(np.int64).clip(0, buckets - 1)
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        ends = np.r_[cuts[1:], len(values)]
        spans = list(zip(cuts.tolist(), ends.tolist(), strict=True))
        columns = [
            pa.array(where[cuts], pa.int32()),
            pa.array([packed_rising(values[start:end]) for start, end in spans], pa.binary()),
            pa.array([packed(owners[start:end]) for start, end in spans], pa.binary()),
            pa.array([base] * len(spans), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "prints", "owners", "base"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: list[np.ndarray] = []
        ids: list[int] = []
        held = 0
        for batch in released(batches):
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = unpacked_rising(data.as_py())
                if doc_id is None or not len(values):
                    continue
                prints.append(values)
                ids.append(doc_id)
                held += len(values)
                if held >= BLOCK_TOKENS:
                    yield block(prints, ids)
                    prints, ids, held = [], [], 0
        if held:
            yield block(prints, ids)

    return run


def _single_owners(group: pa.Table) -> pa.Table:
    """Owners of the fingerprints that one block has once and no other block has, by range of ids."""
    release()
    values, owners = [], []
    for prints, holders, base in zip(*(group.column(name).to_pylist() for name in ("prints", "owners", "base")), strict=True):
        values.append(unpacked_rising(prints))
        holders = unpacked(holders).astype(np.int64)
        owners.append(np.where(holders > 0, holders - 1 + base, np.int64(np.iinfo(np.int64).min)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    other = np.r_[True, value[1:] != value[:-1]] & np.r_[value[1:] != value[:-1], True]
    owner = np.sort(owner[other & (owner != np.iinfo(np.int64).min)])
    ranges = owner >> RANGE_BITS
    cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(owner) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(owner)]
    lows = [packed((owner[start:end] & ((1 << RANGE_BITS) - 1)).astype(np.uint64)) for start, end in zip(cuts.tolist(), ends.tolist(), strict=False)]
    return pa.table({"id_range": pa.array(ranges[cuts], pa.int64()), "lows": pa.array(lows, pa.binary())})


def _owner_counts(group: pa.Table) -> pa.Table:
    id_range = group.column("id_range")[0].as_py()
    counts = np.zeros(1 << RANGE_BITS, np.int64)
    for lows in group.column("lows").to_pylist():
        counts += np.bincount(unpacked(lows).astype(np.int64), minlength=1 << RANGE_BITS)
    present = np.flatnonzero(counts)
    return pa.table({"doc_id": pa.array(present + (id_range << RANGE_BITS), pa.int64()), "n_own": pa.array(counts[present], pa.int64())})


def token_blocks(texts: DataFrame) -> DataFrame:
    """``block, doc_id, tokens``: the sets of a slim frame, dealt into numbered blocks of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block, held = (context.partitionId() if context else 0) << 32, 0
        for batch in released(batches):
            numbers, sets = [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text)
                if held >= BLOCK_TOKENS:
                    block, held = block + 1, 0
                held += len(tokens)
                numbers.append(block)
                sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column(0), pa.array(sets, pa.binary())], ["block", "doc_id", "tokens"])

    return texts.mapInArrow(run, "block long, doc_id long, tokens binary")


def rare_tokens(sets: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``token, doc_id``: of each set's rarest tokens, as many as a partner must share one of, those met elsewhere."""

    def listed(group: pa.Table) -> pa.Table:
        release()
        block = group.column("block")[0].as_py()
        tokens = np.concatenate([np.frombuffer(data, np.uint64) for data in group.column("tokens").to_pylist()])
        values, counts = np.unique(tokens, return_counts=True)
        where = (values >> np.uint64(11)).astype(np.float64) * (buckets / (1 << 53))
        where = where.astype(np.int64).clip(0, buckets - 1)
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(values) else np.empty(0, np.int64)
        spans = list(zip(cuts.tolist(), np.r_[cuts[1:], len(values)].tolist(), strict=False))
        return pa.table({
            "bucket": pa.array(where[cuts], pa.int32()),
            "block": pa.array([block] * len(spans), pa.int64()),
            "values": pa.array([packed_rising(values[start:end]) for start, end in spans], pa.binary()),
            "counts": pa.array([packed(counts[start:end]) for start, end in spans], pa.binary()),
        })

    def summed(group: pa.Table) -> pa.Table:
        values = [unpacked_rising(data) for data in group.column("values").to_pylist()]
        counts = [unpacked(data) for data in group.column("counts").to_pylist()]
        _, place = np.unique(np.concatenate(values), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts).astype(np.float64))[place].astype(np.uint64)
        parts = np.split(totals, np.cumsum([len(part) for part in values])[:-1])
        return pa.table({
            "bucket": group.column("bucket"), "block": group.column("block"), "values": group.column("values"),
            "counts": pa.array([packed(part) for part in parts], pa.binary()),
        })

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        rows = sorted(zip(*(right.column(name).to_pylist() for name in ("bucket", "values", "counts")), strict=True))
        values = np.concatenate([unpacked_rising(data) for _, data, _ in rows]) if rows else np.empty(0, np.uint64)
        counts = np.concatenate([unpacked(data) for _, _, data in rows]) if rows else np.empty(0, np.uint64)
        picked, owners = [], []
        for doc_id, data in zip(left.column("doc_id").to_pylist(), left.column("tokens").to_pylist(), strict=True):
            tokens = np.frombuffer(data, np.uint64)
            met = counts[np.searchsorted(values, tokens)]
            first = np.lexsort((tokens, met))[: len(tokens) - -(-len(tokens) * percent // 100) + 1]
            shared = tokens[first[met[first] > 1]]
            picked.append(shared)
            owners.append(np.full(len(shared), doc_id, np.int64))
        token = np.concatenate(picked) if picked else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        return pa.table({"token": pa.array(token.view(np.int64), pa.int64()), "doc_id": pa.array(owner, pa.int64())})

    by_bucket = sets.groupBy("block").applyInArrow(listed, "bucket int, block long, values binary, counts binary")
    totals = by_bucket.groupBy("bucket").applyInArrow(summed, "bucket int, block long, values binary, counts binary")
    return sets.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(chosen, "token long, doc_id long")


def overlap(one: np.ndarray, other: np.ndarray) -> int:
    """Common tokens of two sorted sets."""
    if len(one) > len(other):
        one, other = other, one
    place = np.searchsorted(other, one)
    place[place == len(other)] = 0
    return int((other[place] == one).sum()) if len(other) else 0


class TOccurrence:
    """Documents of one cell, their inverted lists, and the components found so far."""

    def __init__(self, sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, asks: np.ndarray | None = None):
        """``sets`` by rising size; equal entries of ``label`` are joined already; pairs of two that do not ask are left out."""
        self.percent = percent
        self.sets = sets
        self.sizes = np.array([len(tokens) for tokens in self.sets], np.int64)
        self.label = np.arange(len(sets)) if label is None else label.copy()
        self.given = self.label.copy()
        self.asks = np.ones(len(sets), bool) if asks is None else asks
        tokens = np.concatenate(self.sets)
        owners = np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owners = owners[order]  # rising within each token's list
        _, lengths = np.unique(tokens[order], return_counts=True)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        lists = np.empty(len(tokens), np.int64)
        lists[order] = np.repeat(np.arange(len(lengths)), lengths)
        self.lists_of = np.split(lists, np.cumsum(self.sizes)[:-1])

    def least_overlap(self, one: int, other: int) -> int:
        """The common tokens two sizes need: 100 * common >= percent * (one + other - common)."""
        return -(-self.percent * (one + other) // (100 + self.percent))

    def join(self, one: int, other: int) -> None:
        a, b = sorted((int(self.label[one]), int(self.label[other])))
        if a != b:
            self.label[self.label == b] = a

    def run(self) -> list[tuple[int, int]]:
        """Stars of what was joined: the root of each component with each of the given ones in it, as places in the order of sizes."""
        centres: list[int] = []
        for query in range(1, len(self.sets)):
            size = int(self.sizes[query])
            lowest = int(np.searchsorted(self.sizes, -(-self.percent * size // 100)))
            if centres and lowest <= centres[-1] and self.asks[query]:
                self.try_centres(query, lowest, centres)
            open_ = self.label[:query] != self.label[query]
            open_[:lowest] = False
            if not self.asks[query]:
                open_ &= self.asks[:query]
            if open_.any():
                before = self.label[query]
                self.search(query, open_)
                if self.label[query] != before or not centres:
                    centres = [*centres, query][-CENTRES:]
        moved = np.flatnonzero((self.given == np.arange(len(self.sets))) & (self.label != self.given))
        return list(zip(self.label[moved].tolist(), moved.tolist(), strict=True))

    def try_centres(self, query: int, lowest: int, centres: list[int]) -> None:
        for centre in reversed(centres):
            if centre >= lowest and self.label[centre] != self.label[query]:
                if overlap(self.sets[query], self.sets[centre]) >= self.least_overlap(int(self.sizes[query]), int(self.sizes[centre])):
                    self.join(query, centre)
                    return

    def search(self, query: int, open_: np.ndarray) -> None:
        """Link a document with all open ones that share enough tokens with it."""
        size = int(self.sizes[query])
        lists = self.lists_of[query]
        lengths = self.ends[lists] - self.starts[lists]
        order = np.argsort(-lengths, kind="stable")
        least = -(-self.percent * size // 100)  # the needed overlap with the smallest possible partner
        n_long = min(int(least / (PROBE_WEIGHT * log2(max(2, int(lengths.max()))) + 1)), least - 1)
        long_lists, short_lists = lists[order[:n_long]].tolist(), lists[order[n_long:]]
        merged = []
        for at in short_lists[self.ends[short_lists] - self.starts[short_lists] > 1].tolist():
            holders = self.owners[self.starts[at] : self.ends[at]]
            holders = holders[holders < query]
            holders = holders[open_[holders]]
            if len(holders):
                merged.append(holders.tolist())
        for other, hits in groupby(heapq.merge(*merged)):
            common = sum(1 for _ in hits)
            wanted = self.least_overlap(size, int(self.sizes[other]))
            if common + n_long < wanted or self.label[other] == self.label[query]:
                continue
            if self.probed(other, common, wanted, long_lists) >= wanted:
                self.join(query, other)

    def probed(self, other: int, common: int, wanted: int, long_lists: list[int]) -> int:
        """Common tokens after binary probes of the long lists, given up once the rest cannot suffice."""
        left = len(long_lists)
        for at in long_lists:
            if common + left < wanted:
                break
            left -= 1
            end = int(self.ends[at])
            place = bisect_left(self.owners, other, int(self.starts[at]), end)
            common += place < end and int(self.owners[place]) == other
        return common


def search_cells(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that join components, within each unit of ``unit, part, cluster, doc_id, label, asks, tokens``."""

    def searched(group: pa.Table) -> pa.Table:
        release()
        names = ("cluster", "doc_id", "label", "asks")
        by_id: dict[tuple[int, int], tuple[int, bool, int]] = {}
        for at, (cluster, doc_id, label, asks) in enumerate(zip(*(group.column(name).to_pylist() for name in names), strict=True)):
            by_id[cluster, doc_id] = (label, asks or by_id.get((cluster, doc_id), (0, False, 0))[1], at)
        tokens = group.column("tokens")
        sizes = np.array(pa.compute.binary_length(tokens))
        rows = sorted((cluster, int(sizes[at]), doc_id, label, asks, at) for (cluster, doc_id), (label, asks, at) in by_id.items())
        linked: list[tuple[int, int]] = []
        for _, own in groupby(rows, key=lambda row: row[0]):
            own = list(own)
            if len(own) > 1:
                sets = [np.frombuffer(tokens[row[5]].as_py(), np.uint64) for row in own]
                # Labels as the first place that has them.
                label = np.unique(np.array([row[3] for row in own]), return_index=True, return_inverse=True)
                search = TOccurrence(sets, percent, label[1][label[2]], np.array([row[4] for row in own]))
                linked += [(own[a][2], own[b][2]) for a, b in search.run()]
        return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})

    return members.groupBy("unit", "part").applyInArrow(searched, "a long, b long")


def cluster_links(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect what is connected within the clusters (``doc_id, cluster``) of ``sets``.

    Cells are cut along the sizes of the sets, on slim rows. The first search is within cells, the second between what
    it left outside the largest component of a cluster and the cells whose sizes it can reach.
    """
    slim_rows = sets.select("doc_id", (F.length("tokens") / 8).cast("long").alias("n"))
    # A size and a fraction by a hash: sizes can be cut anywhere, also where many are equal.
    at_size = (F.col("n") + F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)).alias("at")
    sized = materialize(clusters.join(slim_rows, "doc_id").select("doc_id", "cluster", "n", at_size))
    needed = F.greatest(F.ceil(F.sum("n") / CELL_TOKENS), F.ceil(F.count("*") / CELL_DOCUMENTS)).cast("int")
    edges = F.percentile_approx("at", [step / 64 for step in range(1, 64)], F.lit(1000)).alias("edges")
    cells = sized.groupBy("cluster").agg(needed.alias("n_cells"), F.sum("n").alias("total"))
    facts = cells.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.max("n_cells").alias("most")).first()
    batches = 1 + 2 * facts["total"] // CELL_TOKENS
    if (facts["most"] or 1) <= 1:
        one = sized.select(F.pmod(F.xxhash64("cluster"), F.lit(batches)).alias("unit"), F.lit(-1).alias("part"), "cluster", "doc_id", F.col("doc_id").alias("label"), F.lit(True).alias("asks"))
        return materialize(search_cells(one.join(sets.select("doc_id", "tokens"), "doc_id"), percent))
    is_large = F.col("n_cells") > 1
    # Cells of like sizes: one or several of 64 bands, or parts of a band by a hash.
    cut = cells.filter(is_large).join(sized.groupBy("cluster").agg(edges), "cluster", "left").select("cluster", "n_cells", "edges")
    placed = sized.join(cut, "cluster", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(1)))
    band = F.size(F.filter("edges", lambda edge: edge < F.col("at")))
    spread = F.ceil(F.col("n_cells") / 64).cast("int")
    merged = F.floor(band / F.greatest(F.lit(1), F.floor(64 / F.col("n_cells")))).cast("int")
    cell = F.when(is_large, merged * spread + F.pmod(F.xxhash64("doc_id"), spread)).otherwise(-1).cast("int")
    placed = materialize(placed.withColumn("part", cell).drop("edges", "at"))
    unit = F.when(is_large, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(batches)))
    one = placed.select(unit.alias("unit"), "part", "cluster", "doc_id")
    large = placed.filter(is_large)
    bounds = materialize(large.groupBy("cluster", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("tokens"), F.count("*").alias("documents")))
    shown = F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id")).alias("r")
    shown = large.groupBy("cluster", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(REPRESENTATIVES)).alias("slot")).agg(shown)
    everywhere = shown.join(bounds.select("cluster", "part"), "cluster").select(F.col("cluster").alias("unit"), "part", "cluster", F.col("r.doc_id").alias("doc_id"))
    first = one.unionByName(everywhere).select("*", F.col("doc_id").alias("label"), F.lit(True).alias("asks"))
    links = materialize(search_cells(first.join(sets.select("doc_id", "tokens"), "doc_id"), percent))
    roots = connected(links).select(F.col("node").alias("doc_id"), F.col("root").alias("label"))
    labelled = materialize(large.join(roots, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    main = labelled.groupBy("cluster", "label").agg(F.count("*").alias("size")).groupBy("cluster").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    outside = labelled.join(main, "cluster").filter("label <> main").select("cluster", "doc_id", "label", "n")
    blocks = outside.groupBy("cluster").agg(needed.alias("n_blocks"))
    asking = outside.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("n_blocks")).cast("int"))
    reach = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)
    asked = asking.join(bounds, "cluster").filter(reach).select("cluster", "block", "part", "doc_id", "label", F.lit(True).alias("asks"))
    tiles = asked.select("cluster", "block", "part").distinct()
    others = labelled.select("cluster", "part", "doc_id", "label", F.lit(False).alias("asks")).join(tiles, ["cluster", "part"]).select(*asked.columns)
    second = asked.unionByName(others).withColumn("unit", F.xxhash64("cluster", "block")).drop("block")
    return links.unionByName(materialize(search_cells(second.join(sets.select("doc_id", "tokens"), "doc_id"), percent)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the smallest id reachable by links, itself included.

    Two documents link when the Jaccard similarity of their five-word shingle sets is at least ``percent`` / 100.
    Ids must be integers; rows with one id are one document. A text without words has no shingles and links
    with nothing; a null text is one. A null id links with nothing and gets the smallest id of the rows with its
    very set, if there is one. An empty table gives no row; other columns are left out.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids must be integers")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ngram-join-{uuid.uuid4().hex}"
    texts = slim(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    shingle_summaries(texts).write.parquet(f"{folder}/summaries")
    written = spark.read.parquet(f"{folder}/summaries")
    summaries = written.drop("prints")
    mark = ["sig_a", "sig_b", "n_shingles"]
    classes = summaries.filter("n_shingles > 0").groupBy(*mark).agg(F.min("doc_id").alias("rep"))
    own = own_tokens(written.select("doc_id", "prints"), bucket_count(written, F.col("n_shingles") / 2))
    open_classes = classes.filter("rep IS NOT NULL").join(own.withColumnRenamed("doc_id", "rep"), "rep", "left")
    suspects = materialize(open_classes.filter(F.coalesce("n_own", F.lit(0)) < needed(F.col("n_shingles"), percent)).select(F.col("rep").alias("doc_id")).distinct())
    token_blocks(by_ids(texts, suspects)).write.parquet(f"{folder}/sets")
    sets = spark.read.parquet(f"{folder}/sets")
    buckets = bucket_count(sets, F.length("tokens") / 8)
    rare = materialize(rare_tokens(sets, buckets, percent))
    first = rare.groupBy("token").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    stars = rare.join(first, "token").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    clusters = connected(stars).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
    roots = connected(cluster_links(sets, clusters, percent))
    smallest = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = materialize(roots.join(smallest, "root").select(F.col("node").alias("rep"), "component_id"))
    known = classes.join(named, "rep", "left").select(*mark, F.coalesce("component_id", "rep").alias("component_id"))
    # Classes of one document need no name; the others may be hot, and both sides of this join can be split.
    found = summaries.join(known, mark, "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of linked texts, with all its columns: that with the smallest id.

    Rows are judged each by their own text, also where they repeat an id or have none; a null id loses against any
    other, and of equal ids the first row stays. Texts without words stay.
    """
    keyed = numbered_rows(docs, "_row")
    found = near_duplicates(keyed, percent, "_row", text_col).filter("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(keyed[id_col].isNull().alias("none"), keyed[id_col].alias("id"), F.col("_row").alias("row"))
    ranked = found.join(keyed.select("_row", order.alias("order")), "_row")
    groups = ranked.groupBy("component_id").agg(F.min("order").alias("first"), F.count("*").alias("n")).filter("n > 1")
    dropped = ranked.join(groups, "component_id").filter("order.row <> first.row").select("_row")
    return without_rows(keyed, dropped, "_row").drop("_row")
