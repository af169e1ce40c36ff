"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matches."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free
from .textops import U, chunks, gram_hashes, hasher, spans

TILE, COVERAGE = 3, 0.8
BLOCK_BYTES = 8 << 20
#: Shared seeds looked at together.
HITS = 1 << 20

PAIRS = "item_id {item}, coverage double, n_tiles int, n_matched int, tiles array<struct<doc_word:int,item_word:int,words:int>>"


def tilings(doc: np.ndarray, item: np.ndarray, tile: int = TILE) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, words) of the tiles: the longest unmarked common run is marked first, until none of ``tile`` words is left.

    Runs are found by Karp-Rabin hashes of ``tile`` words and grown along
    diagonals. Equal lengths: the run that begins first in the document, then in the item.
    """
    tile = min(tile, len(item))
    if not tile or len(doc) < tile:
        return []
    a, b = gram_hashes(doc, tile), gram_hashes(item, tile)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    hits = np.flatnonzero(high > low)
    if not len(hits):
        return []
    times = (high - low)[hits]
    at = np.repeat(hits, times)
    to = order[np.repeat(low[hits], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
    line = at - to
    by = np.lexsort((at, line))
    at, to, line = at[by], to[by], line[by]
    new = np.ones(len(at), bool)
    new[1:] = (line[1:] != line[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at))) + tile - 1
    heap = [(-int(n), int(p), int(q)) for n, p, q in zip(size, at[begin], to[begin])]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        used = in_doc[p : p + n] | in_item[q : q + n]
        if not used.any():
            in_doc[p : p + n] = in_item[q : q + n] = True
            out.append((p, q, n))
            continue
        free = np.flatnonzero(np.diff(np.concatenate(([True], used, [True])).astype(np.int8)))
        for s, e in zip(free[::2], free[1::2]):
            if e - s >= tile:
                heapq.heappush(heap, (-int(e - s), p + int(s), q + int(s)))
    return out


class Index:
    """The items of one block: their words, and sorted hashes of their seeds with the items that hold them."""

    def __init__(self, ids: list, texts: list[str]):
        column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        self.ids, self.words = [], []
        for at, _, data, offs in chunks(column, lower=True):
            starts, ends, first = spans(data, offs)
            h = hasher(data)(starts, ends)
            for k in range(len(offs) - 1):
                if first[k + 1] > first[k]:
                    self.ids.append(ids[at + k])
                    self.words.append(h[first[k] : first[k + 1]])
        self.seeds = {}
        for size in sorted({min(TILE, len(w)) for w in self.words}):
            own = [(gram_hashes(w, size), k) for k, w in enumerate(self.words) if min(TILE, len(w)) == size]
            keys, items, places = np.concatenate([g for g, _ in own]), np.concatenate([np.full(len(g), k) for g, k in own]), np.concatenate([np.arange(len(g)) for g, _ in own])
            order = np.argsort(keys, kind="stable")
            self.seeds[size] = keys[order], items[order], places[order]
        self.lengths = np.array([len(w) for w in self.words], np.int64)

    def candidates(self, words: np.ndarray, first: np.ndarray, coverage: float):
        """(document, item) of the pairs whose shared seeds cover enough of the item: tiles lie within them, so no other pair can reach ``coverage``."""
        for size, (keys, items, places) in self.seeds.items():
            grams = gram_hashes(words, size)
            low = np.searchsorted(keys, grams)
            at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == grams)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[doc + 1]
            doc, low = np.divmod(np.unique(doc[inside] * len(keys) + low[at[inside]]), len(keys))
            times = np.searchsorted(keys, keys[low], "right") - low
            ends = np.cumsum(times)
            a = 0
            while a < len(doc):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - times[a] + HITS, "right")))
                b = int(np.searchsorted(doc, doc[b - 1], "right"))
                n = times[a:b]
                d, entry = np.repeat(doc[a:b], n), np.repeat(low[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k, q = items[entry], places[entry]
                by = np.lexsort((q, k, d))
                d, k, q = d[by], k[by], q[by]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
                covered = np.full(len(d), size)
                covered[1:] = np.where(new[1:], size, np.minimum(size, q[1:] - q[:-1]))
                begin = np.flatnonzero(new)
                keep = begin[np.add.reduceat(covered, begin) / self.lengths[k[begin]] >= coverage]
                yield from zip(d[keep].tolist(), k[keep].tolist())
                a = b

    def matches(self, words: np.ndarray, first: np.ndarray, coverage: float):
        """(document, item, tiles, covered share) of the pairs that reach ``coverage``."""
        for d, k in sorted(self.candidates(words, first, coverage)):
            own, item = words[first[d] : first[d + 1]], self.words[k]
            tiles = tilings(own, item)
            share = sum(n for _, _, n in tiles) / len(item)
            if share >= coverage:
                yield d, k, tiles, share


def _pairs(index: Index, coverage: float, flag: str | None = None):
    def run(batches):
        for batch in batches:
            rows, best = [], {}
            for a, _, data, offs in chunks(batch, lower=True):
                starts, ends, first = spans(data, offs)
                for d, k, tiles, share in index.matches(hasher(data)(starts, ends), first, coverage):
                    key = a + d, index.ids[k]
                    if key not in best or best[key][0] < share:
                        best[key] = share, tiles
            if flag:
                bad = np.zeros(batch.num_rows, bool)
                bad[[r for r, _ in best]] = True
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bad)], [*batch.schema.names, flag])
                continue
            at = [r for r, _ in best]
            rows = [sorted(t) for _, t in best.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([i for _, i in best], index.kind), pa.array([s for s, _ in best.values()], pa.float64()),
                    pa.array([len(t) for t in rows], pa.int32()), pa.array([sum(n for _, _, n in t) for t in rows], pa.int32()),
                    pa.array([[{"doc_word": p, "item_word": q, "words": n} for p, q, n in t] for t in rows], pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))),
                ],
                ["doc_id", "item_id", "coverage", "n_tiles", "n_matched", "tiles"],
            )

    return run


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Indexes of the items, each over about ``block_bytes`` of text: how many blocks there are follows from the table's size."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[items.schema["item_id"].dataType.simpleString()]
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        index = Index([r.item_id for r in rows], [r.text for r in rows])
        index.kind = kind
        yield n, index


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, n_matched, tiles: every document that holds at least ``coverage`` of an item's words in tiles.

    Words are runs of letters, digits, ``_`` and non-ASCII characters, lower-cased.
    Tiles take three words or more (of an item of fewer words: all of them). A document and an item become a
    candidate when the runs of three words that they share cover enough of the item. The
    tiles may stand anywhere and in any order, so reordered passages count. The
    items are matched in blocks of bounded size, each sent to all tasks; documents
    are never shuffled. Null and empty texts match nothing; items with a null
    id are left out; repeated items count once, repeated documents once for each row. Of an item_id's several texts the
    best covered one is reported, of equally covered ones the first by its block and text. Texts of any length are taken whole.
    An empty table on either side gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + PAIRS.format(item=benchmark.schema["item_id"].dataType.simpleString())
    out = None
    for n, index in _blocks(benchmark, block_bytes):
        part = docs.select("doc_id", "text").mapInArrow(_pairs(index, coverage), schema)
        part = checkpointed(part) if n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item by the rule of `contaminated_pairs`, all columns kept."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    flag = free(docs, "contaminated")
    for n, index in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(_pairs(index, coverage, flag), f"{fields}, {flag} boolean").where(~F.col(flag)).drop(flag)
        docs = checkpointed(docs) if n > 1 else docs
    return docs
