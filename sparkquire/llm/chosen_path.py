"""Jaccard similarity join of word 5-gram sets by chosen paths.

A run is a random tree over the documents: each node splits its documents by
one sampled shared token (the least under a random order of all tokens), small
nodes are brute-forced, large ones split again, and runs repeat until every
document's chance of a missed link is under the target. Equal sets collapse to one
class with one representative text first, so copies are never expanded into pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget, free, stored
from .components import components
from .textops import U, chunks, hasher, mix, shingles, spans, unique_in

SHINGLE, SIMILARITY = 5, 0.8
RUNS, LIMIT, MISS = 6, 200, 1e-3
#: A leaf of more than BLOCK limits is compared in pairs of blocks of so many.
BLOCK = 2


def tree(n: int, similarity: float, miss: float) -> tuple[int, int]:
    """(depth, rounds): how often a node splits at most, one time more for every tenfold of documents beyond ten million, and after
    how many rounds of RUNS trees of that depth a pair at ``similarity`` is missed with a chance under ``miss``."""
    depth = max(4, round(math.log10(max(n, 1))) - 3)
    runs = math.ceil(math.log(miss) / math.log1p(-(similarity**depth))) if similarity < 1 else 1
    return depth, -(-runs // RUNS)


def _sets(batch: pa.RecordBatch | pa.Table, shingle: int):
    """(first row, end row, distinct shingles, each row's begin) over runs of rows."""
    for a, b, data, offs in chunks(batch, lower=True):
        starts, ends, first = spans(data, offs)
        yield a, b, *unique_in(*shingles(hasher(data)(starts, ends), first, shingle))


def _orders(shingle: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(9176 + shingle)
    return random.integers(1 << 63, size=n, dtype=U) | U(1), random.integers(1 << 63, size=n, dtype=U)


def _signatures(shingle: int, orders: int):
    """doc_id, the text's mark, set key, set size, and the least token under each of the orders, 32 bits of it; no row for a text without words."""
    by, plus = _orders(shingle, orders)

    def run(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for a, b, values, begin in _sets(batch, shingle):
                sizes, full = np.diff(begin), np.flatnonzero(np.diff(begin))
                at = begin[full]
                sums = [np.add.reduceat(v, at) if len(at) else np.zeros(0, U) for v in (values, mix(values ^ U(0x5851F42D4C957F2D)))]
                least = np.empty((len(full), len(by)), np.uint32)
                for k in range(len(by)):
                    if len(at):
                        least[:, k] = np.minimum.reduceat((values * by[k] + plus[k]) >> U(32), at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, b - a).take(pa.array(full)) for c in (ids, marks)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                        pa.array(sizes[full].astype(np.int32)), pa.array([r.tobytes() for r in least], pa.binary()),
                    ],
                    ["doc_id", "mark", "k1", "k2", "n", "least"],
                )

    return run


def _paths(number: int, depth: int):
    """One row for each run of this round: the path's hash at each depth."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.frombuffer(b"".join(batch.column("least").to_pylist()), np.uint32).reshape(batch.num_rows, -1, RUNS, depth)[:, number].astype(U)
            path = np.empty((len(got), RUNS, depth), U)
            h = np.broadcast_to(mix(np.arange(1, RUNS + 1, dtype=U) + U(number * RUNS)), got.shape[:2])
            for d in range(depth):
                h = mix(h * U(3) + got[:, :, d] + U(1))
                path[:, :, d] = h
            flat = path.reshape(-1, depth).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.repeat(np.arange(len(got)), RUNS))), *(pa.array(np.ascontiguousarray(flat[:, d])) for d in range(depth))], ["node", *(f"p{d}" for d in range(depth))])

    return run


def _leaves(reps: DataFrame, number: int, limit: int, depth: int) -> DataFrame:
    """node, leaf, depth, size: where each representative ends up in each run of this round; leaves of one are there too."""
    schema = "node long, " + ", ".join(f"p{d} long" for d in range(depth))
    rows, out, before = reps.select("node", "least").mapInArrow(_paths(number, depth), schema), None, None
    for d in range(depth):
        rows, path = stored(rows)
        if before:
            forget(reps.sparkSession, before)
        sized = rows.join(rows.groupBy(f"p{d}").agg(F.count("*").alias("size")), f"p{d}")
        stop = F.lit(True) if d == depth - 1 else F.col("size") <= limit
        ended = checkpointed(sized.where(stop).select("node", F.col(f"p{d}").alias("leaf"), F.lit(d + 1).alias("depth"), "size"))
        out = ended if out is None else out.unionByName(ended)
        rows, before = sized.where(~stop).drop("size", f"p{d}"), path
        if d == depth - 1 or not rows.take(1):
            break
    forget(reps.sparkSession, before)
    return out


def _groups(batches, key: str):
    """Runs of rows with one key, from rows that arrive in its order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def shared_counts(values: np.ndarray, begin: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many values each two of the sets share: products of 0/1 columns, ``width`` distinct values at a time."""
    m = len(begin) - 1
    row = np.repeat(np.arange(m), np.diff(begin))
    order = np.argsort(values, kind="stable")
    v, row = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(v))) > 1
    column = (np.cumsum(many) - 1)[np.cumsum(new) - 1]
    use = many[np.cumsum(new) - 1]
    row, column = row[use], column[use]
    total = np.zeros((m, m), np.float32)
    for at in range(0, int(many.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        total += x @ x.T
    return total


def _least_root(m: int, pairs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The smallest key each row reaches over ``pairs``."""
    root = keys.copy()
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        was = root.copy()
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        if (root == was).all():
            break
    return root


def _verify(shingle: int, similarity: float):
    """Exact links within each cell: links per node, weighted by copies, and the smallest node of its group there.

    A pair that several leaves hold is counted in the smallest leaf that both are in.
    """

    def run(batches):
        for cell in _groups(batches, "cell"):
            got = [(values, begin) for _, _, values, begin in _sets(cell, shingle)]
            values = np.concatenate([v for v, _ in got])
            begin = np.append(0, np.cumsum(np.concatenate([np.diff(b) for _, b in got])))
            key = np.add.reduceat(np.append(values, U(0)), np.minimum(begin[:-1], len(values))) if len(begin) > 1 else np.zeros(0, U)
            right = (key.view(np.int64) == cell.column("k1").to_numpy()) & (np.diff(begin) == cell.column("n").to_numpy())
            node, part, copies = (cell.column(c).to_numpy() for c in ("node", "part", "copies"))
            shared, size = shared_counts(values, begin), np.diff(begin)
            a, b = np.nonzero(np.triu(shared > 0, 1))
            s = shared[a, b]
            ok = (s >= similarity * (size[a] + size[b] - s) - 1e-6) & right[a] & right[b] & (node[a] != node[b])
            other = cell.column("other").to_numpy()
            ok &= (part[a] != part[b]) | (part[a] == other[a])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            leaf = cell.column("leaf")[0].as_py()
            lists = cell.column("leaves").to_pylist()
            most = max(map(len, lists))
            mine = np.array([x + [leaf] * (most - len(x)) for x in lists])
            before = np.zeros(len(a), bool)
            for k in range(most):
                u = mine[a, k]
                before |= (u < leaf) & (mine[b] == u[:, None]).any(1)
            a, b = a[~before], b[~before]
            links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            root = _least_root(len(node), np.stack([a, b], 1), node)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at].astype(np.int64)), pa.array(root[at])], ["node", "links", "root"])

    return run


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def grouped(docs: DataFrame, shingle: int, similarity: float, limit: int, miss: float) -> DataFrame:
    """doc_id, mark (a hash of the text), class_id, n_links, group, group_id of each row with a doc_id and words; group tells groups apart whose least doc_id is the same."""
    ids = _marked(docs).where("doc_id is not null")
    depth, rounds = tree(docs.count(), similarity, miss)
    signed = checkpointed(ids.mapInArrow(_signatures(shingle, rounds * RUNS * depth), "doc_id long, mark long, k1 long, k2 long, n int, least binary"))
    classes = signed.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.count("*").alias("copies"), F.first("least").alias("least"))
    reps = checkpointed(classes.select("k1", "k2", "n", "rep.doc_id", "rep.mark", "copies", "least", F.monotonically_increasing_id().alias("node")))

    leaves, todo = None, reps
    for number in range(rounds):
        part = _leaves(todo, number, limit, depth)
        leaves = part if leaves is None else leaves.unionByName(part)
        if number + 1 < rounds:
            # A rare token ends a path early and meets nobody, so each run of a node counts as one of its deepest.
            chance = leaves.groupBy("node").agg((F.count("*") * F.log1p(-F.pow(F.lit(similarity), F.max("depth")))).alias("chance"))
            todo = checkpointed(reps.join(chance.where(F.col("chance") > math.log(miss)), "node", "left_semi"))
            if not todo.take(1):
                break

    shared = leaves.where("size > 1")
    marks = shared.groupBy("leaf").agg(F.max("size").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    unlike = marks.groupBy("size", "s", "x").agg(F.min("leaf").alias("leaf")).select("leaf", F.col("size").alias("members"))
    cells = checkpointed(shared.join(unlike, "leaf").select("node", "leaf", "members").distinct())
    of = cells.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    parts = F.ceil(F.col("members") / (BLOCK * limit)).cast("int")
    keyed = (
        cells.join(of, "node").join(reps.select("node", "k1", "n", "copies", "doc_id", "mark"), "node")
        .withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("cell", F.xxhash64("leaf", F.least("part", "other"), F.greatest("part", "other"))).drop("parts", "members")
    )
    texts = keyed.join(ids.dropDuplicates(["doc_id", "mark"]), ["doc_id", "mark"])
    found = checkpointed(
        texts.repartition("cell").sortWithinPartitions("cell", "node").select("cell", "leaf", "node", "part", "other", "k1", "n", "copies", "leaves", "text")
        .mapInArrow(_verify(shingle, similarity), "node long, links long, root long")
    )
    own = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "group")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = reps.drop("least", "mark").join(linked, "node", "left").join(own, "node", "left").withColumn("group", F.coalesce("group", "node"))
    per = checkpointed(per.select("k1", "k2", "n", "copies", F.col("doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "group"))
    least = per.groupBy("group").agg(F.min("class_id").alias("group_id"))
    per = checkpointed(per.join(least, "group"))
    return signed.drop("least").join(per, ["k1", "k2", "n"]).select("doc_id", "mark", "class_id", "n_links", "group", "group_id")


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, limit: int = LIMIT, miss: float = MISS) -> DataFrame:
    """doc_id, class_id, n_links, group_id, kept: one row for each row of ``docs``.

    Sets are the distinct runs of ``shingle`` words (lower-cased runs of letters,
    digits, ``_`` and non-ASCII characters); a text of fewer words has one
    shingle of them all. Two documents link when their sets' Jaccard similarity,
    always computed exactly, is at least ``similarity``; a pair at that value is missed with
    a chance under ``miss``, at any similarity. class_id: smallest doc_id with the same set; n_links:
    other rows linked, equal sets included; group_id: smallest doc_id reachable by
    links; kept: doc_id = group_id. Null, empty and wordless texts and null
    doc_ids link with nothing. Rows that repeat a doc_id, with the same text or another, count as rows of their own. doc_id is an integer.
    Texts of any length are taken whole; an empty table gives an empty result; other columns are not read.
    """
    done = grouped(docs, shingle, similarity, limit, miss).select("doc_id", "class_id", "n_links", "group_id")
    ids = _marked(docs)
    alone = ids.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("group_id"))
    wordless = ids.where("doc_id is not null").mapInArrow(_wordless, "doc_id long").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"))
    return done.unionByName(alone).unionByName(wordless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(False)))


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, limit: int = LIMIT, miss: float = MISS) -> DataFrame:
    """The rows of ``docs``, all columns kept, without near copies: of each group of `jaccard_groups` the row with the smallest doc_id.

    Of rows with that doc_id the one with the least hash of its text stays, of those with equal texts the one with the least hash of all its
    columns: the choice follows from the rows alone. Rows without a doc_id or without words are in no group and stay.
    """
    found = checkpointed(grouped(docs, shingle, similarity, limit, miss).select("doc_id", "mark", "group"))
    sizes = found.groupBy("group", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = sizes.groupBy("group").agg(F.min(F.struct("doc_id", "mark", "n")).alias("k")).select("k.*")
    doc, mark, n = (free(docs, c) for c in ("doc", "mark", "n"))
    named = lambda t: t.select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), *([F.col("n").alias(n)] if "n" in t.columns else []))
    of = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(mark))
    gone = sizes.select("doc_id", "mark").join(first, ["doc_id", "mark"], "left_anti")
    left = docs.join(named(gone), of, "left_anti").join(named(first), of, "left")
    one = left.where(F.col(n) > 1).groupBy(doc, mark).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return left.where(F.coalesce(n, F.lit(1)) == 1).select(*docs.columns).unionByName(one)


def _wordless(batches):
    for batch in batches:
        for a, b, data, offs in chunks(batch):
            _, _, first = spans(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(np.flatnonzero(np.diff(first) == 0)))], ["doc_id"])
