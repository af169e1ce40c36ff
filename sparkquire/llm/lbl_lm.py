"""Corpus language model: a log-bilinear network trained by noise-contrastive estimation, and a smoothed unigram base.

Words are counted over the whole corpus: each batch of texts sends one row for
each of its distinct words, and the word's count comes back to the batch. The
network predicts symbols: the commonest words, the end of a text,
and for all other words a class by spelling, within which a word's share is
its smoothed count. Two words of context score a symbol by two bilinear forms,
so the normaliser of every context is one matrix product. Blocks of documents,
dealt by a hash, train copies of the network, which are averaged after each of
a few rounds: the result depends on the rows, not on how they are partitioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import _groups
from .common import checkpointed, fold, forget, stored
from .textops import BASE, NOT_SPACE, U, chunks, hasher, mix, spans

WORDS, SPELLINGS, WIDTH, NOISE = 1024, 128, 24, 128
END, START = WORDS + SPELLINGS, WORDS + SPELLINGS + 1
SYMBOLS = END + 1
#: Text of a batch, of a partition of words and of a training block; all their numbers grow with the table.
BATCH_BYTES, SHARD_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20, 8 << 20
ROUNDS, BLOCK = 2, 2048
#: Tokens looked at together.
RUN = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?|")] = True


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(load: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(load, np.int64, 1)[0])
    sizes = np.frombuffer(load, np.int64, n, 8)
    raw = zstandard.ZstdDecompressor().decompress(load[8 + 8 * n :])
    at = np.concatenate(([0], np.cumsum(sizes)))
    return [np.frombuffer(raw, k, (b - a) // np.dtype(k).itemsize, a) for k, a, b in zip(kinds, at[:-1], at[1:])]


def words_of(data: np.ndarray, offs: np.ndarray):
    """(hash, spelling class, each document's first word) of the words: bytes other than white space, A-Z lower-cased."""
    data = _LOWER[data]
    starts, ends, first = spans(data, offs, NOT_SPACE)
    marked = _MARKS[data[ends - 1]] & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
    last = ends - 1 - marked
    before = np.where(last > starts, data[np.maximum(last - 1, 0)], 0) if len(ends) else last
    spelling = mix((data[last].astype(U) << U(9)) + (before.astype(U) << U(1)) + marked.astype(U) + U(7)) % U(SPELLINGS) if len(ends) else np.zeros(0, U)
    return hasher(data)(starts, ends), spelling.astype(np.uint8), first


COUNTED = pa.schema([("batch", pa.int64()), ("place", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("load", pa.binary())])


def _count(batches):
    """A row for each distinct word of a batch of texts, with its place among them and its training count; and (place -1) the batch's documents as such places."""

    def settle(held, ids, out_of, marks):
        words, spelling = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        sizes = np.concatenate([np.diff(h[2]) for h in held]).astype(np.int32)
        out_of = np.concatenate(out_of)
        keys, at, number = np.unique(words, return_index=True, return_inverse=True)
        counts = np.bincount(number, np.repeat(~out_of, sizes), len(keys)).astype(np.int64)
        load = _pack(number.astype(np.int32), sizes, np.concatenate(ids), out_of, np.concatenate(marks), spelling[at])
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((batch_id, -1, None, None, None, load), COUNTED)], schema=COUNTED)
        for k in range(0, len(keys), 1 << 16):
            part = slice(k, k + (1 << 16))
            n = len(keys[part])
            arrays = [pa.array(np.full(n, batch_id)), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array(keys[part].view(np.int64)), pa.array(counts[part]), pa.array(spelling[at][part].astype(np.int32)), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=COUNTED)

    batch_id = TaskContext.get().partitionId() << 32
    held, ids, out_of, marks, total = [], [], [], [], 0
    for batch in batches:
        own, out, mark = batch.column("row_id").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("mark").to_numpy()
        for a, b, data, offs in chunks(batch):
            held.append(words_of(data, offs))
            ids.append(own[a:b])
            out_of.append(out[a:b])
            marks.append(mark[a:b])
            total += len(data)
            if total >= BATCH_BYTES:
                yield from settle(held, ids, out_of, marks)
                held, ids, out_of, marks, total = [], [], [], [], 0
                batch_id += 1
    if held:
        yield from settle(held, ids, out_of, marks)


ANSWERS = "batch long, place int, total long, pick long, key long, kind int"


def _total(batches):
    """Each row's word's count over the corpus, and its number if it may be one of the commonest WORDS; and (batch null) those words, and sums by spelling, whose place is -1 and whose key is how many words there are."""
    table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], COUNTED.remove(5))])
    if not table.num_rows:
        return
    column = lambda c: table.column(c).to_numpy()
    keys, at, number = np.unique(column("key"), return_index=True, return_inverse=True)
    total, kind = np.bincount(number, column("n"), len(keys)).astype(np.int64), column("kind")[at]
    top = np.lexsort((keys, -total))[:WORDS]
    top = top[total[top] > 1]
    pick = np.full(len(keys), -1)
    pick[top] = np.arange(len(top)) + TaskContext.get().partitionId() * WORDS
    names = ["batch", "place", "total", "pick", "key", "kind"]
    answer = pa.table({"batch": table.column("batch"), "place": table.column("place"), "total": pa.array(total[number]), "pick": pa.array(pick[number]), "key": pa.nulls(len(number), pa.int64()), "kind": pa.nulls(len(number), pa.int32())})
    yield from answer.to_batches(1 << 16)
    tokens, words = np.bincount(kind, total, SPELLINGS).astype(np.int64), np.bincount(kind, total > 0, SPELLINGS).astype(np.int64)
    for place, sums, picks, others, kinds in ((-1, tokens, np.full(SPELLINGS, -1), words, np.arange(SPELLINGS)), (0, total[top], pick[top], keys[top], kind[top])):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(sums), pa.int64()), pa.array(np.full(len(sums), place, np.int32)), pa.array(sums), pa.array(picks), pa.array(others), pa.array(kinds.astype(np.int32))], names)


RESOLVED = "row_id long, held_out boolean, mark long, n_words long, symbols binary, known long, log_all double, log_rare double"


def _resolve(vocabulary: np.ndarray):
    """Each document of a batch as symbols, with its sums of log10(count + 1) over all words and over those that only a class stands for."""

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.equal(table.column("place"), -1)).column("load")[0].as_py()
        number, sizes, ids, out_of, marks, kind = _unpack(own, np.int32, np.int32, np.int64, bool, np.int64, np.uint8)
        words = table.filter(pa.compute.greater_equal(table.column("place"), 0))
        place = words.column("place").to_numpy()
        count, pick = np.zeros(len(kind), np.int64), np.full(len(kind), -1)
        count[place], pick[place] = words.column("total").to_numpy(), words.column("pick").to_numpy()
        symbol = WORDS + kind.astype(np.int64)
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary[:, 0], pick), len(vocabulary) - 1)
            hit = vocabulary[at, 0] == pick
            symbol[hit] = vocabulary[at[hit], 1]
        logs, doc = np.log10(count + 1.0), np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(doc, x[number], len(sizes)) if len(doc) else np.zeros(len(sizes))
        ends = np.concatenate(([0], np.cumsum(sizes.astype(np.int64) * 2)))
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(symbol.astype(np.int16)[number].tobytes())])
        columns = [ids, out_of, marks, sizes.astype(np.int64), flat.cast(pa.binary()), add(count > 0).astype(np.int64), add(logs), add(np.where(symbol >= WORDS, logs, 0.0))]
        return pa.table({f.split()[0]: x if isinstance(x, pa.Array) else pa.array(x) for f, x in zip(RESOLVED.split(", "), columns)})

    return run


def sequences(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, symbol, the one before, the one before that) over all tokens, ends included."""
    n = sizes.astype(np.int64) + 1
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n)
    w = np.full(ends[-1] if len(n) else 0, END, np.int64)
    inside = np.ones(len(w), bool)
    inside[ends - 1] = False
    w[inside] = symbols
    into = np.arange(len(w)) - (ends - n)[doc]
    one, two = np.full(len(w), START), np.full(len(w), START)
    one[into > 0] = w[np.flatnonzero(into > 0) - 1]
    two[into > 1] = w[np.flatnonzero(into > 1) - 2]
    return doc, w, one, two


def token_runs(batch: pa.RecordBatch | pa.Table):
    """`sequences` over the rows' symbols, whatever their length, some RUN tokens at a time."""
    loads = batch.column("symbols").to_pylist()
    symbols, cuts = np.frombuffer(b"".join(loads), np.int16), np.concatenate(([0], np.cumsum([len(x) // 2 for x in loads]))).astype(np.int64)
    a = 0
    while a < len(loads):
        if cuts[a + 1] - cuts[a] > RUN:
            for low in range(cuts[a], cuts[a + 1], RUN):
                high, back = min(low + RUN, cuts[a + 1]), max(cuts[a], low - 2)
                keep = slice(low - back, None if high == cuts[a + 1] else -1)
                doc, w, one, two = sequences(symbols[back:high], np.array([high - back]))
                yield a + doc[keep], w[keep], one[keep], two[keep]
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + RUN, "right")) - 1)
        doc, w, one, two = sequences(symbols[cuts[a] : cuts[b]], np.diff(cuts[a : b + 1]))
        yield a + doc, w, one, two
        a = b


#: The logistic function at steps of 1/256 from -30 to 30.
LOGISTIC = (1 / (1 + np.exp(-np.arange(-30 * 256, 30 * 256 + 1) / 256))).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function within 0.2 % of its value, by a table; overwrites ``x``."""
    np.clip(x, -30, 30, out=x)
    x += 30
    x *= 256
    x += 0.5
    return LOGISTIC[x.astype(np.int16)]


class LogBilinear:
    """score(w | u, v) = q_w . (a_u + b_v) + c_w; context rows hold the position's matrix already multiplied in."""

    def __init__(self, unigram: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, 0.1, s).astype(np.float32) for s in ((SYMBOLS + 1, WIDTH), (SYMBOLS + 1, WIDTH), (SYMBOLS, WIDTH))]
        self.p.append(np.log(unigram).astype(np.float32)[:, None])
        self.noise = unigram

    def learn(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, rate: float, seed: int = 1) -> None:
        """One pass of noise-contrastive estimation in blocks, AdaGrad steps; each block's tokens share NOISE noise symbols."""
        r = np.random.default_rng(seed)
        order, cdf = r.permutation(len(w)), np.cumsum(self.noise)
        log_noise = (np.log(self.noise) + np.log(NOISE)).astype(np.float32)
        a, b, q, c = self.p
        order_of: dict[int, np.ndarray] = {}
        if not hasattr(self, "seen"):
            self.seen = [np.full(x.shape, 1e-2, np.float32) for x in self.p]
        for at in range(0, len(w), BLOCK):
            k = order[at : at + BLOCK]
            u, v, y = one[k], two[k], w[k]
            z = np.minimum(np.searchsorted(cdf, r.random(NOISE) * cdf[-1]), SYMBOLS - 1)
            h = a[u] + b[v]
            gp = sigmoid((h * q[y]).sum(1) + c[y, 0] - log_noise[y]) - 1
            gn = h @ q[z].T
            gn += c[z, 0] - log_noise[z]
            gn = sigmoid(gn)
            gh = gp[:, None] * q[y] + gn @ q[z]
            for which, idx, g in ((0, u, gh), (1, v, gh), (2, np.append(y, z), np.concatenate([gp[:, None] * h, gn.T @ h])), (3, np.append(y, z), np.append(gp, gn.sum(0))[:, None])):
                by = order_of[which] = order_of[2] if which == 3 else np.argsort(idx.astype(np.uint16), kind="stable")
                rows = idx[by]
                first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                rows, g = rows[first], np.add.reduceat(g[by], first) / np.sqrt(np.float32(len(k)))
                self.seen[which][rows] += g * g
                self.p[which][rows] -= rate * g / np.sqrt(self.seen[which][rows])

    def tables(self):
        """(log score by first context, by second, log normaliser): normalised log-probabilities are sums of their entries."""
        a, b, q, c = (x.astype(np.float64) for x in self.p)
        first, second = a @ q.T + c.T, b @ q.T
        high1, high2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
        z = np.log(np.exp(first - high1) @ np.exp(second - high2).T) + high1 + high2.T
        return first.astype(np.float32), second.astype(np.float32), z.astype(np.float32)


#: Averages are sums of whole numbers, so their order does not matter.
UNIT = float(1 << 32)


def _trainer(model: LogBilinear, rate: float):
    """For each block the model that its documents make of the shared one, a row for each parameter row, and its training tokens."""

    def run(batches):
        import copy

        for block in _groups(batches, "block"):
            own, n, held = copy.deepcopy(model), 0, []
            for k, (_, *tokens) in enumerate(token_runs(block)):
                held.append(tokens)
                n += len(tokens[0])
            for k in range(0, len(held), 4):
                own.learn(*(np.concatenate(x) for x in zip(*held[k : k + 4])), rate, k + 1)
            flat = np.rint(np.concatenate([np.pad(x, ((0, 0), (0, WIDTH - x.shape[1]))) for x in own.p]).astype(np.float64) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.full(len(flat), n)), *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(WIDTH))], ["k", "n", *(f"x{k}" for k in range(WIDTH))])

    return run


def trained(model: LogBilinear, blocks: DataFrame, rounds: int, rate: float) -> LogBilinear:
    """``model`` after ``rounds`` rounds: every block trains it alone, then their parameters are averaged by tokens; each round halves the rate."""
    names = [f"x{k}" for k in range(WIDTH)]
    for number in range(rounds):
        own = blocks.mapInArrow(_trainer(model, rate / 2**number), "k int, n long, " + ", ".join(f"{x} long" for x in names))
        whole = own.groupBy("k").agg(F.sum("n").alias("n"), *(F.sum(F.col(x).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).alias(x) for x in names))
        mixed = whole.select("k", *((F.col(x) / F.col("n") / UNIT).cast("double").alias(x) for x in names)).toPandas().sort_values("k")
        flat, begin = mixed[names].to_numpy(), 0
        for k, x in enumerate(model.p if len(mixed) else ()):
            model.p[k] = flat[begin : begin + len(x), : x.shape[1]].astype(np.float32)
            begin += len(x)
    return model


def _scorer(tables, shares: np.ndarray, n: int, v: int, end_count: int):
    first, second, z = tables
    flat = np.log10(np.e)

    def run(batches):
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for doc, w, one, two in token_runs(batch):
                total += np.bincount(doc, (first[one, w].astype(np.float64) + second[two, w] - z[one, two]) * flat + shares[w], batch.num_rows)
            tokens = batch.column("n_words").to_numpy() + 1
            base = batch.column("log_all").to_numpy() + np.log10(end_count + 1) - tokens * np.log10(n + v + 1)
            known = batch.column("known").to_numpy() + (end_count > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("held_out"), pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), n)), pa.array(base), pa.array(total + batch.column("log_rare").to_numpy())],
                ["row_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def lm_scores(docs: DataFrame, folds: int = 7, out: int = 2, rate: float = 0.2, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Tokens: runs of bytes other than white space, A-Z lower-cased, then one end.
    All documents but those with crc32(doc_id) mod ``folds`` = ``out`` are counted and
    trained on, in blocks of about ``block_bytes`` of text that a hash of doc_id and text deals out, all of them in each of ``rounds`` rounds.
    score is the log10 of a normalised probability: a word outside the
    vocabulary has its class's, times (c + 1) / (class tokens + class words + 1).
    Words are told apart by 64-bit hashes. Null texts count as empty; a text without words is its end.
    Repeated rows count as rows and are scored one by one; those that repeat a doc_id and its text train once. A null doc_id counts as empty text in the fold. doc_id is an integer.
    Texts of any length are taken whole. Of equally frequent words the one with the smaller hash enters the vocabulary first.
    An empty table gives an empty result; other columns are not read.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = lambda size: max(16, -(-total // size))
    lowest = -(1 << 63)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("row_id"), (fold(F.col("doc_id"), folds) == out).alias("held_out"), text.alias("text"), F.xxhash64(text).alias("mark"))
    counted, counted_path = stored(rows.mapInArrow(_count, "batch long, place int, key long, n long, kind int, load binary"))
    answers, answers_path = stored(counted.where("place >= 0").drop("load").repartition(lots(SHARD_BYTES), "key").mapInArrow(_total, ANSWERS))
    sums = answers.where("batch is null")
    by_class = sums.where("place < 0").groupBy("kind").agg(F.sum("total").alias("tokens"), F.sum("key").alias("words")).toPandas()
    top = sums.where("place = 0").orderBy(F.desc("total"), "key").limit(WORDS).toPandas()
    ends = rows.where(~F.col("held_out")).count()
    n, v = int(by_class.tokens.sum()) + ends, int(by_class.words.sum()) + (ends > 0)

    tokens, words = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    tokens[by_class.kind.to_numpy(int)], words[by_class.kind.to_numpy(int)] = by_class.tokens, by_class.words
    tokens -= np.bincount(top.kind.to_numpy(int), top.total.to_numpy(float), SPELLINGS) if len(top) else 0
    words -= np.bincount(top.kind.to_numpy(int), minlength=SPELLINGS) if len(top) else 0
    vocabulary = np.stack([top["pick"].to_numpy(np.int64), np.arange(len(top))], 1)
    vocabulary = vocabulary[np.argsort(vocabulary[:, 0])]
    unigram = np.full(SYMBOLS, 0.5)
    unigram[: len(top)] += top.total.to_numpy(float)
    unigram[WORDS:END] += tokens
    unigram[END] += ends
    shares = np.zeros(SYMBOLS)
    shares[WORDS:END] = -np.log10(tokens + words + 1)

    none = lambda kind: F.lit(None).cast(kind)
    own = counted.where("place < 0").select("batch", "place", none("long").alias("total"), none("long").alias("pick"), "load")
    parts = own.unionByName(answers.where("batch is not null").select("batch", "place", "total", "pick", none("binary").alias("load")))
    resolved, _ = stored(parts.repartition(lots(BATCH_BYTES), "batch").groupBy("batch").applyInArrow(_resolve(vocabulary), RESOLVED))
    forget(docs.sparkSession, counted_path)
    forget(docs.sparkSession, answers_path)
    blocks = max(1, -(-total // block_bytes))
    dealt = resolved.where(~F.col("held_out")).select("row_id", "mark", "symbols").dropDuplicates(["row_id", "mark"]).withColumn("block", F.pmod(F.xxhash64("row_id", "mark"), F.lit(blocks)))
    dealt = checkpointed(dealt.repartition(blocks, "block").sortWithinPartitions("block", F.xxhash64("mark", "row_id"), "mark", "row_id"))
    model = trained(LogBilinear(unigram / unigram.sum()), dealt, rounds, rate)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out_schema = "row_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = resolved.mapInArrow(_scorer(model.tables(), shares, n, v, ends), out_schema)
    return scored.select(F.when(F.col("row_id") != lowest, F.col("row_id")).cast(kind).alias("doc_id"), *scored.columns[1:])
