"""Exact removal of byte strings that a document with a smaller id holds, by a logarithmic family of suffix arrays.

Every 50-byte window belongs to the least 16-byte string in it (by a hash, the
leftmost of ties), so equal windows always meet in that string's shard. A
shard adds its windows in document order: each new batch gets a suffix array,
is merge-scanned against the existing levels, and equal-sized levels merge,
so that n windows need about log n levels and each window moves log n times.
Runs of windows that a batch of texts repeats whole are found before that, in
a sparse suffix array of the batch, of the suffixes where a run starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import _groups
from .common import checkpointed, free
from .textops import BASE, CHUNK, U, chunks, mix

LENGTH, ANCHOR = 50, 16
MOST = 2 * LENGTH - ANCHOR
#: A row's bytes, and its size in the last of them.
WIDE = MOST // 8 * 8 + 8
SIDE = (LENGTH - ANCHOR) // 2
BATCH_BYTES, SHARD_BYTES, LEVEL, PACK = 8 << 20, 6 << 20, 1 << 16, 5
SLICE = 1 << 20
#: Rows looked at together.
STEP = 1 << 16
#: How many shards a batch addresses; where there are more, a second exchange divides them.
FAN = 4096
#: One document in SAMPLE is looked at for anchors that would fill a shard alone, of which there are HOT at most, 8 bytes each.
SAMPLE, HOT = 256, 1 << 20
_HALF = U((1 << 38) - 1) << U(26)
_ROW = np.random.default_rng(50).integers(1 << 63, size=WIDE // 8, dtype=U) | U(1)


def windows(data: np.ndarray, offs: np.ndarray):
    """(start, count, anchor, anchor's hash) of the runs of windows that share one least string; no window crosses a document."""
    n = len(data)
    if n < LENGTH:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U)]
    h, step, base = data.astype(U) + U(1), 1, BASE
    while step < ANCHOR:
        h = h[:-step] * U(base) + h[step:]
        step, base = 2 * step, base * base % (1 << 64)
    h = mix(h * U(BASE))
    least = (h & _HALF) | np.arange(len(h), dtype=U)
    span, have = LENGTH - ANCHOR + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - span + have], least[span - have :]) if span > have else least
    at = (least & U((1 << 26) - 1)).astype(np.int64)
    good = np.ones(len(at), bool)
    for e in offs[1:-1]:
        good[max(0, e - LENGTH + 1) : e] = False
    new = good.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~good[:-1]
    last = good.copy()
    last[:-1] &= new[1:] | ~good[1:]
    start = np.flatnonzero(new)
    return start, np.flatnonzero(last) - start + 1, at[start], h[at[start]]


def _rows_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each segment's bytes in a row of WIDE, zeros behind."""
    padded = np.concatenate([data, np.zeros(WIDE, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[start]
    rows[np.arange(WIDE) >= size[:, None]] = 0
    return rows


def _same(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse suffix array of segments, their byte order, and where in it a different one begins. Meanwhile the last byte of a row, else zero, is its size, so that only equal segments are equal."""
    rows[:, -1] = size
    text = rows.view(f"S{WIDE}").ravel()
    order = np.argsort(text, kind="stable")
    new = np.ones(len(order), bool)
    for k in range(1, len(order), STEP):
        part = text[order[k - 1 : k + STEP]]
        new[k : k + STEP] = part[1:] != part[:-1]
    rows[:, -1] = 0
    return order, new


def _later(doc: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which segments equal one of a document with a smaller id."""
    begin = np.flatnonzero(new)
    low = np.minimum.reduceat(doc[order], begin) if len(begin) else doc[:0]
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > low[np.cumsum(new) - 1]
    return out


def _joined(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(doc, mark, bytes of int64 pairs) for each document: its intervals, those that touch made one."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    if not len(doc):
        return
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    group = np.cumsum(first) - 1
    shift = group * (1 << 40)
    reach = np.maximum.accumulate(end + shift)
    new = first.copy()
    new[1:] |= start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    pairs = np.stack([start[at], reach[np.append(at[1:], len(doc)) - 1] - shift[at]], 1)
    cuts = np.searchsorted(at, np.flatnonzero(first))
    for a, b, k in zip(cuts, np.append(cuts[1:], len(at)), np.flatnonzero(first)):
        yield int(doc[k]), int(mark[k]), pairs[a:b].tobytes()


OUT = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("load", pa.binary())])


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(OUT)], schema=OUT)


def _sums(rows: np.ndarray) -> np.ndarray:
    """A hash of each row's bytes."""
    return mix((rows.view(U) * _ROW[: rows.shape[1] // 8]).sum(1))


def _part_sums(rows: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes of each row from ``begin``."""
    out, part = np.empty(len(rows), U), np.zeros((min(STEP, len(rows)), -(-n // 8) * 8), np.uint8)
    for k in range(0, len(rows), STEP):
        some = rows[k : k + STEP]
        part[: len(some), :n] = np.take_along_axis(some, begin[k : k + STEP, None] + np.arange(n), 1)
        out[k : k + STEP] = _sums(part[: len(some)])
    return out


def _key(rows: np.ndarray, off: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What equal windows share: a hash of the segment's anchor, or of all of a ``whole`` segment, which is one window."""
    key = _part_sums(rows, off, ANCHOR)
    if whole.any():
        key[whole] = _sums(rows[whole])
    return key


def _loads(shard: np.ndarray, shards: int, doc, mark, pos, size, off, whole, rows):
    """(shard, packed segments) for each of the shards that has some; rows of shard ``shards`` are left out."""
    keep = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[keep], np.arange(shards + 1))
    pack = zstandard.ZstdCompressor(level=PACK)
    for s in np.flatnonzero(np.diff(cuts)):
        at = keep[cuts[s] : cuts[s + 1]]
        body = rows[at][np.arange(WIDE) < size[at][:, None]]
        parts = [np.array([len(at)]), doc[at], mark[at], pos[at], size[at].astype(np.uint8), (off[at] + 128 * whole[at]).astype(np.uint8), body]
        yield int(s), pack.compress(b"".join(p.tobytes() for p in parts))


def _joint(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The columns of all lists, which are emptied on the way."""
    return [np.concatenate([x.pop(0) for x in held]) for _ in held[0][:]]


def _split(doc, mark, pos, size, off, anchor, rows, hot):
    """The segments, those with a hot anchor as single windows, and which these are."""
    whole = np.isin(anchor, hot)
    if not whole.any():
        return doc, mark, pos, size, off, whole, rows
    n = np.where(whole, size - LENGTH + 1, 1)
    seg = np.repeat(np.arange(len(n)), n)
    into = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    size = np.where(whole, LENGTH, size)[seg]
    padded = np.pad(rows, ((0, 0), (0, WIDE)))
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, WIDE, 1)[seg, into])
    rows[np.arange(WIDE) >= size[:, None]] = 0
    return doc[seg], mark[seg], pos[seg] + into, size, off[seg] - into, whole[seg], rows


def _segments(shards: int, hot: np.ndarray):
    """For each shard a packed load of segments (doc_id null), and intervals already settled in this batch, which only pass through a shard."""

    def settle(held):
        doc, mark, pos, size, off, whole, rows = _split(*_joint(held), hot)
        later = _later(doc, *_same(rows, size))
        out = [(r[0] % shards, *r) for r in _joined(doc[later], mark[later], pos[later], pos[later] + size[later])]
        shard = np.where(later, shards, (_key(rows, off, whole) % U(shards)).astype(np.int64))
        return out + [(s, None, None, load) for s, load in _loads(shard, shards, doc, mark, pos, size, off, whole, rows)]

    def run(batches):
        held, total = [], 0
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            for a, b, data, offs in chunks(batch):
                for lo in range(0, max(1, len(data)), SLICE) if b == a + 1 else (0,):
                    part = data[lo : lo + SLICE + LENGTH - 1] if b == a + 1 else data
                    start, count, anchor, h = windows(part, np.array([0, len(part)]) if b == a + 1 else offs)
                    row = np.searchsorted(offs, start + lo, "right") - 1
                    size = count + LENGTH - 1
                    held.append([ids[a + row], marks[a + row], start + lo - offs[row], size, anchor - start, h, _rows_of(part, start, size)])
                    total += len(part)
                    if total >= BATCH_BYTES:
                        yield _out(settle(held))
                        held, total = [], 0
        if held:
            yield _out(settle(held))

    return run


def _divide(fine: int):
    """Loads of each shard, many at a time, as loads of its ``fine`` parts; rows come in the order of shards."""

    def run(batches):
        for group in _groups(batches, "shard"):
            shard, loads = group.column("shard")[0].as_py(), group.filter(group.column("doc_id").is_null()).column("load").to_pylist()
            yield from group.filter(group.column("doc_id").is_valid()).to_batches()
            held, total = [], 0
            for k, load in enumerate(loads):
                held.append(list(_unpack(load)))
                total += held[-1][-1].size
                if total >= 4 * BATCH_BYTES or k + 1 == len(loads):
                    doc, mark, pos, size, off, whole, rows = _joint(held)
                    part = (mix(_key(rows, off, whole) ^ U(BASE)) % U(fine)).astype(np.int64)
                    yield _out([(shard * fine + s, None, None, x) for s, x in _loads(part, fine, doc, mark, pos, size, off, whole, rows)])
                    held, total = [], 0

    return run


def _anchors(batches):
    """Each anchor of this batch's distinct segments and how many hold it."""
    for batch in batches:
        for _, _, data, offs in chunks(batch):
            start, count, _, h = windows(data, offs)
            if len(start):
                order, new = _same(_rows_of(data, start, count + LENGTH - 1), count + LENGTH - 1)
                anchor, n = np.unique(h[order[new]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], ["anchor", "n"])


class Level:
    """A suffix array: the text of some segments, the starts of their distinct windows in byte order, and the least document of each."""

    def __init__(self, text: np.ndarray, array: np.ndarray, doc: np.ndarray):
        self.text, self.array, self.doc = text, array, doc

    def keys(self, some=slice(None)) -> np.ndarray:
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[self.array[some]])
        return rows.view(f"S{LENGTH}").ravel()

    @staticmethod
    def of(text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
        """The level of a batch in document order, its windows' order, each one's place in the level, and which windows an earlier document of the batch holds."""
        keys = Level(text, at, doc).keys()
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        return Level(text, at[first], doc[first]), order, place, doc > doc[first][place]

    @staticmethod
    def _merge(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of two sorted arrays one after the other, and which in it equal the one before. The stable sort is a timsort, which finds the two runs and merges them."""
        both = np.concatenate([mine, theirs])
        order = np.argsort(both, kind="stable")
        both = both[order]
        return order, np.append(np.zeros(min(1, len(both)), bool), both[1:] == both[:-1])

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """The least document of each of the sorted, distinct ``keys`` here, by one merge; the largest integer where there is none."""
        order, again = self._merge(self.keys(), keys)
        out = np.full(len(keys), np.iinfo(np.int64).max)
        at = np.flatnonzero(again)
        out[order[at] - len(self.array)] = self.doc[order[at - 1]]
        return out

    def merged(self, new: Level) -> Level:
        """Both in one array, by one merge; of equal windows the one of this, the older level stays."""
        both = Level(np.concatenate([self.text, new.text]), np.concatenate([self.array, new.array + len(self.text)]), np.concatenate([self.doc, new.doc]))
        order, again = self._merge(self.keys(), new.keys())
        return Level(both.text, both.array[order[~again]], both.doc[order[~again]])


class Family:
    """Levels of geometrically growing sizes. Batches come in ascending document order."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Adds a batch's windows; says which of them a document with a smaller id holds."""
        level, _, place, held = Level.of(text, at, doc)
        keys = level.keys()
        before = np.full(len(keys), np.iinfo(np.int64).max)
        for old in self.levels:
            before = np.minimum(before, old.scan(keys))
        held |= doc > before[place]
        while self.levels and len(self.levels[-1].array) <= 2 * len(level.array):
            level = self.levels.pop().merged(level)
        self.levels.append(level)
        return held


def _unpack(load: bytes):
    raw = zstandard.ZstdDecompressor().decompress(load)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc, mark, pos = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * k) for k in range(3))
    size, off = (np.frombuffer(raw, np.uint8, n, 8 + 24 * n + n * k).astype(np.int64) for k in range(2))
    rows = np.zeros((n, WIDE), np.uint8)
    rows[np.arange(WIDE) < size[:, None]] = np.frombuffer(raw, np.uint8, offset=8 + 26 * n)
    return doc, mark, pos, size, off & 127, off > 127, rows


def _several(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows are of a group that has two documents or more."""
    order = np.argsort(group, kind="stable")
    g, d = group[order], doc[order]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    many = np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)
    out = np.zeros(len(group), bool)
    out[order] = many[np.cumsum(np.append(True, g[1:] != g[:-1])) - 1]
    return out


def _meeting(rows: np.ndarray, size: np.ndarray, off: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Segments that may share a window with another document: a shared window reaches SIDE bytes beyond the anchor on one side at least, so that side and the anchor are shared too."""
    out = np.zeros(len(doc), bool)
    for begin, have in ((off, size - off >= ANCHOR + SIDE), (off - SIDE, off >= SIDE)):
        k = np.flatnonzero(have)
        if len(k):
            out[k] |= _several(_part_sums(rows[k], begin[k], ANCHOR + SIDE), doc[k])
    return out


def _shard(table: pa.Table) -> pa.Table:
    """The intervals that one shard finds: equal segments at once, the rest window by window in suffix arrays."""
    settled = table.filter(table.column("doc_id").is_valid())
    loads = table.filter(table.column("doc_id").is_null()).column("load").to_pylist()
    if not loads:
        return settled
    doc, mark, pos, size, off, whole, rows = _joint([list(_unpack(x)) for x in loads])
    use = np.flatnonzero(_several(_key(rows, off, whole), doc))
    use = use[_meeting(rows[use], size[use], off[use], doc[use])] if len(use) else use
    found = []
    if len(use):
        doc, mark, pos, size, off, rows = (x[use] for x in (doc, mark, pos, size, off, rows))
        later = _later(doc, *_same(rows, size))
        found.append((doc[later], mark[later], pos[later], pos[later] + size[later]))
        left = np.flatnonzero(~later)
        if len(left):
            left = left[_meeting(rows[left], size[left], off[left], doc[left])]
        left = left[np.lexsort((pos[left], doc[left]))]
        family, count = Family(), size[left] - LENGTH + 1
        cuts = np.searchsorted(np.cumsum(count), np.arange(LEVEL, int(count.sum()) + LEVEL, LEVEL), "left") + 1
        a = 0
        for b in np.unique(np.minimum(cuts, len(left))):
            part, n = left[a:b], count[a:b]
            if len(part):
                text = rows[part][np.arange(WIDE) < size[part][:, None]]
                seg = np.repeat(np.arange(len(part)), n)
                into = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
                held = family.add(text, (np.cumsum(size[part]) - size[part])[seg] + into, doc[part][seg])
                seg, into = part[seg[held]], into[held]
                found.append((doc[seg], mark[seg], pos[seg] + into, pos[seg] + into + LENGTH))
            a = b
    rows_out = [(-1, *r) for r in _joined(*(np.concatenate(x) for x in zip(*found)))] if found else []
    return pa.concat_tables([settled, pa.Table.from_batches([_out(rows_out)])])


def _hot(keyed: DataFrame, shard_bytes: int, sample: int) -> np.ndarray:
    """Anchors that more segments hold than a shard should have, by the documents that a hash picks. Only where segments go depends on them, no result."""
    some = keyed.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(sample)) == 0).mapInArrow(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    least = max(2, 2 * shard_bytes // (LENGTH - ANCHOR + 1) // sample)
    return np.sort(np.array([r.anchor for r in some.where(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(HOT).collect()], np.int64).view(U))


def _spans(docs: DataFrame, shard_bytes: int, fan: int, sample: int) -> DataFrame:
    """id, mark (a hash of the text), spans, of each text that loses bytes; in the shared folder.

    Work is dealt in shards of about ``shard_bytes`` of text, one partition each, however large the table; a batch of texts
    writes loads for ``fan`` of them at most, which a second exchange divides where there are more.
    """
    schema = "shard long, doc_id long, mark long, load binary"
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(64, -(-total // shard_bytes))
    coarse = min(shards, fan)
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    found = keyed.mapInArrow(_segments(coarse, _hot(keyed, shard_bytes, sample)), schema)
    if shards > coarse:
        fine = -(-shards // coarse)
        shards = coarse * fine
        found = found.repartition(shards, "shard", F.spark_partition_id() % fine).sortWithinPartitions("shard").mapInArrow(_divide(fine), schema)
    found = found.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard, schema)
    return checkpointed(found.groupBy(F.col("doc_id").alias("id"), "mark").agg(F.collect_list("load").alias("spans")))


def with_spans(docs: DataFrame, name: str, shard_bytes: int = SHARD_BYTES, fan: int = FAN, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a column ``name``: loads of the byte intervals to remove, null where there are none."""
    doc, mark = free(docs, "doc"), free(docs, "mark")
    spans = _spans(docs, shard_bytes, fan, sample).select(F.col("id").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(name))
    return docs.join(spans, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(mark)), "left").drop(doc, mark)


def _cut(text: bytes, loads: list[bytes] | None) -> tuple[bytes, int, int]:
    """(bytes left, how many go, in how many runs)."""
    if not loads:
        return text, 0, 0
    pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in loads])
    turn = np.zeros(len(text) + 1, np.int32)
    np.add.at(turn, pairs[:, 0], 1)
    np.add.at(turn, pairs[:, 1], -1)
    gone = np.cumsum(turn[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _digest(batches):
    for batch in batches:
        texts = (t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary()))
        rows = [(len(t), *_cut(t, s.as_py())) for t, s in zip(texts, batch.column("spans"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 2, 3)), pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _trim(name: str):
    def run(batches):
        for batch in batches:
            texts = [None if not t.is_valid else _cut(t.as_py(), s.as_py())[0].decode("utf-8", "ignore") for t, s in zip(batch.column("text").cast(pa.large_binary()), batch.column(name))]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([name])

    return run


def removed_spans(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``.

    A byte goes when a 50-byte string that covers it also starts in a document
    with a smaller doc_id, judged on the whole input texts as UTF-8; matches
    never cross documents. Null texts count as empty. Rows that repeat a doc_id
    are one document, so none of them is the smaller; rows with a null doc_id neither lose
    bytes nor make others lose any. Texts of any length are taken whole, in slices that overlap. An empty table gives an empty result.
    Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs.select("doc_id", "text"), "spans", **how).mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """All rows and columns of ``docs``, texts without the bytes that `removed_spans` counts; a character cut in two goes whole."""
    name = free(docs, "spans")
    return with_spans(docs, name, **how).mapInArrow(_trim(name), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
