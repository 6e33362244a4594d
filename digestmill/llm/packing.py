"""Packing token sequences into near-equal windows by Karmarkar-Karp multiway differencing.

Documents of a partition are taken in groups of bounded size. Whole windows are cut off each document;
what remains is dealt over ``k`` windows: every remainder starts as a partition of its own, and the two
partitions with the widest spread are merged again and again, the fullest windows of one with the
emptiest of the other. ``k`` starts at the least that could hold the group and rises by one whenever the
result exceeds the capacity. Because documents may be cut freely, a few long remainders of each group are
cut into small grains first; grains let the differencing even out what whole remainders cannot.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from digestmill.llm.pretokens import Cache, library, needs_library, piece_encoder, special_strings, units
from digestmill.llm.rows import released, slim

CAPACITY = 2048
END_OF_DOCUMENT = 1
# A group is packed when its remainders fill so many windows: the state of a task stays a few megabytes.
GROUP_WINDOWS = 64
GRAIN = 64
GRAINS_PER_WINDOW = 2
# Sequence ids carry the task's partition above these bits.
SEQUENCE_BITS = 33

# Entries of a worker's cache of encoded words: about 30 MB. A worker outlives its stage, and more entries are no faster.
CACHE_ENTRIES = 200_000

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Item = tuple[int, int, int]  # document, first token, tokens


def differencing(weights: list[int], ways: int) -> tuple[int, list[list[int]]]:
    """Largest load and the items of each way, after merging partial partitions with opposing imbalances."""
    joined: list[tuple[int, int]] = []  # a way with two parts is a node of a tree whose leaves are items
    heap = []
    for item, weight in enumerate(weights):
        loads, nodes = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        loads[0], nodes[0] = weight, item
        heap.append((-weight, item, loads, nodes))
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, loads, nodes = heapq.heappop(heap)
        _, _, other_loads, other_nodes = heapq.heappop(heap)
        other_nodes = other_nodes[::-1]
        loads = loads + other_loads[::-1]
        both = (nodes >= 0) & (other_nodes >= 0)
        merged = np.where(nodes >= 0, nodes, other_nodes)
        if both.any():
            first = len(weights) + len(joined)
            joined.extend(zip(nodes[both].tolist(), other_nodes[both].tolist(), strict=True))
            merged[both] = np.arange(first, len(weights) + len(joined))
        order = np.argsort(-loads, kind="stable")
        loads, merged = loads[order], merged[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), turn, loads, merged))
        turn += 1
    _, _, loads, nodes = heap[0]
    ways_of = []
    for node in nodes.tolist():
        items, waiting = [], [node] if node >= 0 else []
        while waiting:
            node = waiting.pop()
            if node < len(weights):
                items.append(node)
            else:
                waiting.extend(joined[node - len(weights)])
        ways_of.append(sorted(items))
    return int(loads[0]), ways_of


def in_grains(items: list[Item], grain: int, wanted: int) -> list[Item]:
    """The same tokens with the longest items cut until about ``wanted`` grains are there."""
    longest = sorted(range(len(items)), key=lambda place: (-items[place][2], place))
    cut: set[int] = set()
    for place in longest:
        if wanted <= 0 or items[place][2] <= grain:
            break
        cut.add(place)
        wanted -= items[place][2] // grain
    out: list[Item] = []
    for place, (document, start, length) in enumerate(items):
        if place in cut:
            out += [(document, at, min(grain, start + length - at)) for at in range(start, start + length, grain)]
        else:
            out.append((document, start, length))
    return out


def pack_items(items: list[Item], capacity: int) -> list[list[Item]]:
    """Windows of at most ``capacity`` tokens that hold all items, each shorter than ``capacity``."""
    if not items:
        return []
    ways = -(-sum(length for _, _, length in items) // capacity)
    grains = in_grains(items, min(GRAIN, capacity), GRAINS_PER_WINDOW * ways) if ways > 1 else items
    while True:
        fullest, packed = differencing([length for _, _, length in grains], ways)
        if fullest <= capacity:
            break
        ways += 1
    return [joined_up([grains[place] for place in window]) for window in packed if window]


def joined_up(window: list[Item]) -> list[Item]:
    """Neighbouring grains of one document that met in one window are one piece again."""
    out: list[Item] = []
    for document, start, length in sorted(window):
        if out and out[-1][0] == document and out[-1][1] + out[-1][2] == start:
            out[-1] = (document, out[-1][1], out[-1][2] + length)
        else:
            out.append((document, start, length))
    return out


class Packer:
    """Documents in, rows of pieces out, group by group."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity = capacity
        self.sequence = first_sequence
        self.tokens: list[np.ndarray] = []
        self.ids: list = []
        self.items: list[Item] = []
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, tokens: np.ndarray) -> None:
        document, size = len(self.ids), len(tokens)
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        whole = size - size % self.capacity
        for start in range(0, whole, self.capacity):
            self.window([(document, start, self.capacity)])
        if whole < size:
            self.items.append((document, whole, size - whole))
            self.waiting += size - whole
        if self.waiting >= GROUP_WINDOWS * self.capacity or len(self.ids) >= GROUP_WINDOWS * 64:
            self.flush()

    def window(self, pieces: list[Item]) -> None:
        offset = 0
        for document, start, length in pieces:
            tokens = self.tokens[document]
            code = zlib.crc32(tokens[start : start + length].tobytes())
            self.rows.append((self.ids[document], start, length, code, len(tokens), self.sequence, offset))
            offset += length
        self.sequence += 1

    def flush(self) -> None:
        for pieces in pack_items(self.items, self.capacity):
            self.window(pieces)
        self.tokens, self.ids, self.items, self.waiting = [], [], [], 0

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


@lru_cache(maxsize=2)
def text_encoder(path: str, end: int):
    """A function from a text to its ids and the end mark, as little-endian unsigned 32-bit numbers.

    Its cache lives as long as the worker process.
    """
    specials, encode = special_strings(path), piece_encoder(path)
    known = Cache(lambda unit: np.array(encode(unit), "<u4").tobytes(), CACHE_ENTRIES)
    last = np.array([end], "<u4").tobytes()

    def tokens(text: str) -> np.ndarray:
        if needs_library(text, specials):
            return np.array([*library(path).encode(text, add_special_tokens=False).ids, end], "<u4")
        return np.frombuffer(b"".join([*map(known.__getitem__, units(text)), last]), "<u4")

    return tokens


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END_OF_DOCUMENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece.

    A document is its ids by the ``.json`` vocabulary, without added special tokens, then ``end``. Each of its
    tokens lies in exactly one piece; the pieces of a sequence follow each other from offset 0 and hold at most
    ``capacity`` tokens. Packing happens where the rows are, without a shuffle; sequence ids are unique over
    all partitions and the same whenever a task is run again on the same rows.

    A null or empty text is the end mark alone; a null id stays null; repeated rows are packed each; an empty
    table gives no piece; other columns are left out. A document of any length is cut over windows.
    """
    if capacity < 2:
        raise ValueError("capacity must be at least 2")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    frame = slim(docs, id_col, text_col)
    id_type = dict(frame.dtypes)["doc_id"]
    names = [part.split()[0] for part in PIECES.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = text_encoder(path, end)
        context = TaskContext.get()
        packer = Packer(capacity, (context.partitionId() if context else 0) << SEQUENCE_BITS)
        kind = None
        for batch in released(batches):
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, tokens_of(text))
            if packer.rows:
                yield piece_batch(packer.taken(), kind, names)
        packer.flush()
        if packer.rows:
            yield piece_batch(packer.taken(), kind, names)

    return frame.mapInArrow(run, f"doc_id {id_type}, {PIECES}")


def piece_batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    ids, *columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(column, pa.int64()) for column in columns)], ["doc_id", *names])
