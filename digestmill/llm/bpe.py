"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue keeps one bucket of list positions per merge rank and a two-level bitmap over the ranks. The
lowest waiting rank is found by two find-first-set steps, whatever the number of waiting pairs; entries whose pair has changed since they were queued are skipped when they come up. A
pre-token of any length takes time in proportion to its bytes, with a small factor for equal ranks.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestmill.llm.pretokens import CACHE_ENTRIES, Cache, split, units
from digestmill.llm.rows import per_document, slim

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
# Integers have any length here, so 256 ranks to a word keep the bitmap two levels deep.
WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1


class RankQueue:
    """Positions by merge rank, lowest rank first, then leftmost.

    ``low`` has a bit per rank, ``top`` a bit per word of ``low``. A bucket is a heap of positions; pairs of
    one rank may be queued out of order.
    """

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((n_ranks >> WORD_BITS) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> WORD_BITS
        if not self.low[word]:
            self.top |= 1 << word
        self.low[word] |= 1 << (rank & WORD_MASK)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; only while ``top`` is not 0."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        rank = (word << WORD_BITS) + first.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[word] = bits ^ first
        if bits == first:
            self.top ^= 1 << word
        return rank, bucket[0]


class Codec:
    """Ids of pre-tokens by a table of merge ranks, and bytes of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.queue = RankQueue(max(self.bytes_of) + 1)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: merges in rank order, the leftmost first among equal ranks."""
        rank_of, queue, size = self.ranks.get, self.queue, len(piece)
        whole = rank_of(piece)
        if whole is not None:
            return (whole,)
        push, pop = queue.push, queue.pop
        # A linked list of parts by their start: after[i] is the end of the part at i (0 once merged away),
        # before[i] the start of the part on its left. waiting[i] is the rank of the pair that starts at i.
        after, before = [*range(1, size + 1)], [*range(-1, size)]
        waiting = [rank_of(piece[at : at + 2]) for at in range(size - 1)]
        waiting.append(None)
        for at, rank in enumerate(waiting):
            if rank is not None:
                push(rank, at)
        while queue.top:
            rank, at = pop()
            if waiting[at] != rank:
                continue  # the pair has changed since it was queued
            gone = after[at]
            end = after[at] = after[gone]
            after[gone], waiting[gone], before[end] = 0, None, at
            rank = waiting[at] = rank_of(piece[at : after[end]]) if end < size else None
            if rank is not None:
                push(rank, at)
            left = before[at]
            if left >= 0:
                rank = waiting[left] = rank_of(piece[left:end])
                if rank is not None:
                    push(rank, left)
        ids, at = [], 0
        while at < size:
            ids.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return tuple(ids)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def encoder(path: str, entries: int = CACHE_ENTRIES):
    """A function from a text to its ids; its caches of pre-tokens live as long as the worker process."""
    coder = codec(path)
    pieces = Cache(lambda piece: coder.encode_piece(piece.encode()), entries)
    known = Cache(lambda unit: tuple(chain.from_iterable(map(pieces.__getitem__, split(unit)))), entries)
    return lambda text: list(chain.from_iterable(map(known.__getitem__, units(text))))


def bpe_encode(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text, by the ranks in a ``.tiktoken`` file.

    A null or empty text has no ids; a null id stays null; repeated rows give repeated results; an empty
    table gives none; other columns are left out.
    """
    path = ranks or public_tokenizers.path(DEFAULT_RANKS)

    def worker():
        encode = encoder(path)
        return lambda text: (encode(text),)

    return per_document(slim(docs, id_col, text_col), "ids array<long>", worker).withColumn("ids", F.col("ids").cast("array<int>"))


def bpe_decode(coded: DataFrame, ranks: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, data binary`` of id arrays; a null array decodes to no bytes. An unknown id is an error."""
    path = ranks or public_tokenizers.path(DEFAULT_RANKS)

    def worker():
        coder = codec(path)
        return lambda ids: (coder.decode(ids or ()),)

    return per_document(coded.select(coded[id_col].alias("doc_id"), coded[ids_col].alias("ids")), "data binary", worker)


def bpe_digests(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass over the texts.

    The ids never leave the task, so a long text costs no wide row. Cases as in ``bpe_encode``; no ids have
    the digest of the empty string.
    """
    path = ranks or public_tokenizers.path(DEFAULT_RANKS)

    def worker():
        encode, coder = encoder(path), codec(path)
        names = {index: str(index) for index in coder.bytes_of}

        def digest(text: str) -> tuple[int, str, str]:
            ids = encode(text)
            listed = " ".join(map(names.__getitem__, ids))
            return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

        return digest

    return per_document(slim(docs, id_col, text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string", worker)
