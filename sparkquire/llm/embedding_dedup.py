"""Near-duplicate vectors by random-hyperplane sign hashes in several tables, exact cosines, and connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import _groups, _least_root
from .common import checkpointed
from .components import components

COSINE, MISS, BLOCK = 0.9, 1e-4, 512
#: Further signs of each vector, by which a bucket's vectors are compared before the vectors themselves are sent.
SKETCH = 128


def table_count(bits: int, cosine: float, miss: float) -> int:
    """How many tables of ``bits`` signs miss a pair at ``cosine`` with a chance under ``miss``."""
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-meet))


def sketch_bound(cosine: float, miss: float) -> int:
    """The most signs of a sketch that two vectors at ``cosine`` differ in, but for a chance under ``miss``."""
    p = math.acos(cosine) / math.pi
    above, most = 1.0, -1
    while above >= miss and most < SKETCH:
        most += 1
        above -= math.comb(SKETCH, most) * p**most * (1 - p) ** (SKETCH - most)
    return most


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _signed(bits: int, tables: int):
    """Each class's bucket in every table, and its sketch."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("embedding")
            dims = vectors.value_lengths().to_numpy()
            out, sketch = np.empty((len(vectors), tables), np.int64), np.empty((len(vectors), SKETCH // 8), np.uint8)
            for d in np.unique(dims):
                if d not in planes:
                    planes[d] = np.random.default_rng(d).normal(size=(d, bits * tables + SKETCH))
                at = np.flatnonzero(dims == d)
                up = _unit(_matrix(vectors.take(pa.array(at)))) @ planes[d] >= 0
                out[at] = (up[:, SKETCH:].reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))) + (int(d) << 32)
                sketch[at] = np.packbits(up[:, :SKETCH], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "copies", "embedding")), flat, pa.array([r.tobytes() for r in sketch], pa.binary())], ["node", "copies", "embedding", "buckets", "sketch"])

    return run


def _near(most: int):
    """Of each cell the vectors whose sketch differs in ``most`` signs or fewer from another's there."""

    def run(batches):
        for cell in _groups(batches, "cell"):
            if cell.num_rows < 2:
                continue
            cell = cell.combine_chunks()
            node, part, other = (cell.column(c).to_numpy() for c in ("node", "part", "other"))
            signs = np.unpackbits(np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1), axis=1).astype(np.float32) * 2 - 1
            close = (signs @ signs.T >= SKETCH - 2 * most) & ((part[:, None] != part) | (part == other)[:, None]) & (node[:, None] != node)
            at = pa.array(np.flatnonzero(close.any(1)))
            if len(at):
                yield from cell.select(["cell", "tab", "node", "part", "other"]).take(at).to_batches()

    return run


def _verify(cosine: float):
    """Exact links in each cell of one table's bucket, counted in the first table where two vectors meet."""

    def run(batches):
        for cell in _groups(batches, "cell"):
            if cell.num_rows < 2:
                continue
            cell = cell.combine_chunks()
            node, copies, part, other, table = (cell.column(c).to_numpy() for c in ("node", "copies", "part", "other", "tab"))
            unit = _unit(_matrix(cell.column("embedding")))
            a, b = np.nonzero(np.triu(unit @ unit.T >= cosine - 1e-12, 1))
            ok = ((part[a] != part[b]) | (part[a] == other[a])) & (node[a] != node[b])
            a, b = a[ok], b[ok]
            exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            a, b = a[exact], b[exact]
            if not len(a):
                continue
            buckets = _matrix(cell.column("buckets"))[:, : int(table[0])]
            new = ~(buckets[a] == buckets[b]).any(1)
            a, b = a[new], b[new]
            links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            root = _least_root(len(node), np.stack([a, b], 1), node)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at].astype(np.int64)), pa.array(root[at])], ["node", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vec_id of ``vectors`` (vec_id integer, embedding array).

    Two vectors of the same length link when their cosine in double precision is at
    least ``cosine``. A pair at that cosine is missed with a chance under ``miss``,
    nearer ones with less; no pair below it links. Equal vectors are one class,
    so copies are never paired; a bucket of more than ``block`` classes
    is compared in pairs of blocks. Null or zero vectors and those with null or non-finite
    components link with nothing. Of rows that repeat a vec_id the greatest
    vector by array order counts; a null vec_id gives one row, with a null component, not kept.
    Signs take about log2 of the number of classes in bits, less six, so that a bucket holds some
    sixty vectors at any size. Buckets exchange ids and sketches of 128 further signs; only vectors
    whose sketch is near another's in a bucket are sent there for the exact cosine. Equal cosines, repeated rows and an empty
    table need no further rule; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = checkpointed(rows.withColumn("usable", usable))
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))
    good = rows.where("usable").select("vec_id", plain.alias("embedding"))
    classes = checkpointed(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    n = classes.count()
    bits = max(4, round(math.log2(max(n, 2))) - 6)
    tables = table_count(bits, cosine, 0.9 * miss)

    signed = checkpointed(classes.select("node", "copies", "embedding").mapInArrow(_signed(bits, tables), "node long, copies long, embedding array<double>, buckets array<long>, sketch binary"))
    met = signed.select("node", "sketch", F.posexplode("buckets").alias("tab", "bucket")).withColumn("bucket", F.xxhash64("tab", "bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    own = met.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("size") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    split = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("cell", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
    cells = split.select("cell", "tab", "node", "part", "other", "sketch").repartition("cell").sortWithinPartitions("cell", "node")
    near = checkpointed(cells.mapInArrow(_near(sketch_bound(cosine, 0.1 * miss)), "cell long, tab int, node long, part int, other int"))
    sent = near.join(signed.drop("sketch"), "node").repartition("cell").sortWithinPartitions("cell", "node").select("cell", "tab", "node", "part", "other", "copies", "embedding", "buckets")
    found = checkpointed(sent.mapInArrow(_verify(cosine), "node long, links long, root long"))

    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = classes.join(linked, "node", "left").join(groups, "node", "left").select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    done = good.join(per, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
