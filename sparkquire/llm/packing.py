"""Packing of tokenised documents into sequences by large-item matching and best fit.

The plan needs only how many pieces have each length, at most ``capacity``
numbers whatever the corpus; each piece then finds its place from its rank
among the pieces of its length: its number among those of its task, which is
counted where the piece is made, after those of the tasks before.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

CAPACITY = 2048
_made: dict = {}


class Tokens:
    """Token ids of texts, as the library ``tokenizers`` gives them for a byte-level BPE file.

    With ``ranks``, the same vocabulary as merge ranks and its word pattern, texts go
    through tiktoken, which gives the same ids several times faster; texts that
    hold a special token's string always go through ``tokenizers`` itself.
    Holds file contents, so that executors need no files.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        self.special = [t["content"] for t in json.loads(self.json).get("added_tokens", [])]
        self.ranks, self.pattern = None, pattern
        if ranks:
            with open(ranks, "rb") as f:
                self.ranks = f.read()
        self.key = zlib.crc32(self.json.encode()), ranks

    def _tools(self):
        if self.key not in _made:
            from tokenizers import Tokenizer

            fast = None
            if self.ranks:
                import tiktoken

                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
                fast = tiktoken.Encoding(f"quire-{self.key[0]}", pat_str=self.pattern, mergeable_ranks=merges, special_tokens={})
            _made[self.key] = Tokenizer.from_str(self.json), fast
        return _made[self.key]

    def ids(self, text: str) -> np.ndarray:
        full, fast = self._tools()
        if fast is None or any(s in text for s in self.special):
            return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def public_tokens(name: str = "byte_bpe_50k") -> Tokens:
    """The public tokenizer of that name, found by the installed package ``public_tokenizers``."""
    import public_tokenizers

    return Tokens(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)


def plan(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(slots, number of bins) for ``counts[n]`` items of each length n.

    A slot (length, first rank, first bin, items a bin, offset) places the items of
    a length from that rank on. Items over a third of the capacity go first, at
    most two a bin, the longest with the longest that fits beside it; shorter
    ones, from long to short, fill the tightest gaps that take them.
    """
    cap = len(counts) - 1
    left, rank = counts.astype(np.int64).copy(), np.zeros(cap + 1, np.int64)
    slots, gaps, bins = [], [[] for _ in range(cap + 1)], 0

    def put(length, bin0, each, offset, n):
        slots.append((length, rank[length], bin0, each, offset))
        rank[length] += n
        left[length] -= n

    third = cap // 3
    for a in range(cap, third, -1):
        b = min(a, cap - a)
        while left[a]:
            while b > third and (not left[b] or b == a and left[b] < 2):
                b -= 1
            if b <= third:
                n = int(left[a])
                put(a, bins, 1, 0, n)
                gaps[cap - a].append((bins, n))
            else:
                n = int(left[a]) // 2 if a == b else int(min(left[a], left[b]))
                put(a, bins, 1, 0, n)
                put(b, bins, 1, a, n)
                gaps[cap - a - b].append((bins, n))
            bins += n
    for a in range(third, 0, -1):
        gap = a
        while left[a]:
            while gap < cap and not gaps[gap]:
                gap += 1
            if gap == cap:
                bin0, n = bins, int(-(-left[a] // (cap // a)))
                bins += n
            else:
                bin0, n = gaps[gap].pop()
            each = gap // a
            full = min(n, int(left[a]) // each)
            rest = int(left[a]) - full * each if full < n else 0
            if full:
                put(a, bin0, each, cap - gap, full * each)
                gaps[gap - each * a].append((bin0, full))
            if rest:
                put(a, bin0 + full, each, cap - gap, rest)
                gaps[gap - rest * a].append((bin0 + full, 1))
                full += 1
            if full < n and gap < cap:
                gaps[gap].append((bin0 + full, n - full))
    return np.array(sorted(slots), np.int64).reshape(-1, 5), bins


def _pieces(tokens: Tokens, capacity: int, keep_ids: bool):
    def run(batches):
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for at, text in enumerate(batch.column("text")):
                ids = np.append(tokens.ids(text.as_py() or ""), np.uint32(0)).astype("<u4")
                n = -(-len(ids) // capacity)
                start = 0
                for piece in range(n):
                    end = len(ids) - capacity * (n - piece - 1)
                    part = ids[start:end]
                    for to, x in zip(rows, (at, piece, start, end - start, zlib.crc32(part.tobytes()), seen[end - start], part if keep_ids else None)):
                        to.append(x)
                    seen[end - start] += 1
                    start = end
            out = [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:6]), pa.array(np.full(len(rows[0]), task))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "within", "task"]
            if keep_ids:
                out, names = [*out, pa.array([r.astype(np.int32) for r in rows[6]], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _places(slots: np.ndarray):
    keys = (slots[:, 0] << 44) + slots[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            _, first, bin0, each, offset = slots[at].T
            into = rank - first
            rest = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(bin0 + into // each), pa.array(offset + into % each * length)], [*rest, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokens: Tokens | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every row of ``docs``.

    A document is its text's token ids (null text: empty) and then id 0. One of more than
    ``capacity`` ids is cut into pieces of ``capacity``, of which the first may be shorter. Rows
    that repeat a doc_id, null ones too, are documents of their own, whichever of equal pieces comes first. Texts of any length are
    taken whole. An empty table gives an empty result. Other columns are not read.
    """
    tokens = tokens or public_tokens()
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" if keep_ids else ""
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = checkpointed(docs.select("doc_id", "text").mapInArrow(_pieces(tokens, capacity, keep_ids), f"{schema}, within long, task long{more}"))
    sizes = checkpointed(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length] = row.n
    slots, _ = plan(counts)
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    ranked = pieces.join(before.drop("n"), ["length", "task"]).withColumn("rank", F.col("within") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return ranked.select(*names, "rank").mapInArrow(_places(slots), f"{schema}{more}, sequence_id long, offset long")
