"""Byte-level BPE with a rank queue on a hierarchical bitmap, for pre-tokens of any length.

A pre-token is a doubly linked list of parts. For every merge rank that some neighbouring pair has there is a bucket of
the positions where it was seen, and a bit in a two-level bitmap: a summary word with a bit per leaf, leaves of 256
ranks. The next rank is found by find-first-set in the summary, then in its leaf. Within a bucket positions leave in
order, the leftmost first. A position is stale when its pair has changed since; stale entries are skipped, never
searched for. So n parts take n log n steps at most.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 256
#: Pre-tokens whose ids a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 600_000, 64


class Ranks:
    """The ranks of a .tiktoken file: base64 token and rank on each line."""

    def __init__(self, lines: list[bytes]):
        self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.token = {rank: token for token, rank in self.rank.items()}

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls(f.readlines())

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if piece in self.rank:
            return [self.rank[piece]]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merges neighbours, the lowest rank first and of one rank the leftmost, until no pair has a rank."""
        rank, n = self.rank, len(piece)
        part: list = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int] = [-1] * n  # the rank of the pair that starts here, -1 without
        buckets: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}
        summary = 0

        def put(i: int) -> None:
            nonlocal summary
            j = after[i]
            r = rank.get(part[i] + part[j], -1) if j < n else -1
            pair[i] = r
            if r >= 0:
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    leaf = r // LEAF
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << r % LEAF
                    summary |= 1 << leaf

        for i in range(n):
            put(i)
        while summary:
            leaf = (summary & -summary).bit_length() - 1
            bits = leaves[leaf]
            r = leaf * LEAF + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                if bits := bits & bits - 1:
                    leaves[leaf] = bits
                else:
                    del leaves[leaf]
                    summary &= summary - 1
            if part[i] is None or pair[i] != r:
                continue  # stale
            j = after[i]
            part[i] += part[j]
            part[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [rank[p] for p in part if p is not None]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Pieces(dict):
    """The ids of pre-tokens as little-endian 32-bit bytes, remembered while they are short and few."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = self.ranks.encode_piece(piece.encode("utf-8"))
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= LONGEST and len(self) < REMEMBERED:
            self[piece] = out
        return out


@lru_cache(maxsize=1)
def _pieces_of(path: str) -> _Pieces:
    """A worker's encoder, with what it remembers from all its tasks."""
    return _Pieces(Ranks.read(path))


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns doc_id, n_tokens and the digests of ids and decoded bytes.

    Every match of the pattern is encoded separately; there are no special tokens. Null counts as empty; an empty text
    has no id. The rank file is read where the work is done, by a path that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        pieces, find = _pieces_of(ranks_path), regex.compile(pattern).findall
        token = pieces.ranks.token.__getitem__
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                raw = b"".join(map(pieces.__getitem__, find(text or "")))
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(token, np.frombuffer(raw, "<u4").tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        pieces, find = _pieces_of(ranks_path), regex.compile(pattern).findall
        for batch in batches:
            ids = [np.frombuffer(b"".join(map(pieces.__getitem__, find(t or ""))), "<i4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the bytes of (doc_id, ids); null ids count as none. An id that isn't in the file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.read(ranks_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ranks.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
