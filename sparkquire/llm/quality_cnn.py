"""Quality scores by a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, checkpointed, fold, labelled_docs
from .textops import chunks

SAMPLE = 6000
#: Bytes of labelled text that the driver trains on, at most.
SAMPLE_BYTES = 64 << 20
PIECE, HOP = 256, 192
WIDTH, STRIDE, FILTERS, HIDDEN = 8, 2, 24, 16
PAD = 256


def places(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, begin in it) of overlapping pieces of PIECE bytes every HOP bytes that cover each document to its end."""
    n = np.maximum(1, -(-(np.diff(offs) - (PIECE - HOP)) // HOP))
    doc = np.repeat(np.arange(len(n)), n)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * HOP


def pieces(data: np.ndarray, offs: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The bytes of some of these pieces, padded with PAD."""
    at, size = offs[:-1][doc] + begin, np.diff(offs)[doc] - begin
    low, high = (int(at.min()), int(at.max()) + PIECE) if len(at) else (0, 0)
    part = data[low:high].astype(np.uint16)
    padded = np.concatenate([part, np.full(high - low - len(part), PAD, np.uint16)])
    out = np.lib.stride_tricks.sliding_window_view(padded, PIECE)[at - low] if len(at) else np.zeros((0, PIECE), np.uint16)
    out[np.arange(PIECE) >= size[:, None]] = PAD
    return out


class Net:
    """Filters over one-hot bytes, ReLU and the maximum over each piece; mean, maximum and minimum over the pieces; one hidden layer."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "taps": r.normal(0, 0.35, (WIDTH, PAD + 1, FILTERS)).astype(f), "bias": np.zeros(FILTERS, f),
            "w1": r.normal(0, 0.2, (3 * FILTERS, HIDDEN)).astype(f), "b1": np.zeros(HIDDEN, f), "w2": r.normal(0, 0.3, HIDDEN).astype(f), "b2": np.zeros(1, f),
        }
        self.p["taps"][:, PAD] = 0
        self._pairs = None

    def highest(self, x: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each piece, and where it is."""
        steps = (PIECE - WIDTH) // STRIDE + 1
        best = np.empty((len(x), FILTERS), np.float32)
        where = np.empty((len(x), FILTERS), np.int32)
        for a in range(0, len(x), 64):
            y = x[a : a + 64].astype(np.int32)
            if pairs:
                code = y[:, :-1:2] * (PAD + 1) + y[:, 1::2]
                total = self._pairs[0][code[:, :steps]]
                for k in range(1, WIDTH // 2):
                    total += self._pairs[k][code[:, k : k + steps]]
                best[a : a + 64] = total.max(1)
                continue
            total = self.p["taps"][0][y[:, : 2 * steps : 2]]
            for k in range(1, WIDTH):
                total += self.p["taps"][k][y[:, k : k + 2 * steps : 2]]
            at = total.argmax(1)
            where[a : a + 64] = at
            best[a : a + 64] = np.take_along_axis(total, at[:, None], 1)[:, 0]
        return best, where

    def top(self, h: np.ndarray, begin: np.ndarray):
        n = np.diff(np.append(begin, len(h)))[:, None]
        v = np.concatenate([np.add.reduceat(h, begin) / n, np.maximum.reduceat(h, begin), np.minimum.reduceat(h, begin)], 1)
        t = np.tanh(v @ self.p["w1"] + self.p["b1"])
        return v, t, 1 / (1 + np.exp(-np.clip(t @ self.p["w2"] + self.p["b2"], -30, 30)))

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self._pairs is None:
            t = self.p["taps"]
            self._pairs = [(t[k][:, None] + t[k + 1][None]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]
        doc, begin = places(offs)
        h = np.empty((len(doc), FILTERS), np.float32)
        for a in range(0, len(doc), 4096):
            part = slice(a, a + 4096)
            h[part] = np.maximum(self.highest(pieces(data, offs, doc[part], begin[part]), True)[0] + self.p["bias"], 0)
        return self.top(h, np.searchsorted(doc, np.arange(len(offs) - 1)))[2]

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        raw, where = self.highest(x, False)
        h = np.maximum(raw + self.p["bias"], 0)
        v, t, p = self.top(h, begin)
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"w2": t.T @ d, "b2": d.sum(keepdims=True)}
        dt = d[:, None] * self.p["w2"] * (1 - t * t)
        g |= {"w1": v.T @ dt, "b1": dt.sum(0)}
        dv = dt @ self.p["w1"].T
        n = np.diff(np.append(begin, len(h)))
        of = np.repeat(np.arange(len(n)), n)
        mean, high, low = (dv[:, k * FILTERS : (k + 1) * FILTERS] for k in range(3))
        dh = (mean / n[:, None])[of]
        for part, side in ((high, 1), (low, 2)):
            hit = (h == v[of, side * FILTERS : (side + 1) * FILTERS]).astype(np.float32)
            dh += hit * (part / np.add.reduceat(hit, begin))[of]
        dh *= h > 0
        g["bias"] = dh.sum(0)
        g["taps"] = np.empty_like(self.p["taps"])
        row, filters = np.arange(len(x))[:, None], np.arange(FILTERS)
        for k in range(WIDTH):
            at = x[row, where * STRIDE + k].astype(np.int64) * FILTERS + filters
            g["taps"][k] = np.bincount(at.ravel(), dh.ravel(), (PAD + 1) * FILTERS).reshape(-1, FILTERS)
        g["taps"][:, PAD] = 0
        return g


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 5, batch: int = 48, rate: float = 0.004, seed: int = 3) -> Net:
    """Adam on the cross-entropy, both classes weighing the same in the sampling of batches at first, whole texts throughout."""
    net, random, step = Net(), np.random.default_rng(seed), 0
    m, s = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    steps = max(epochs, -(-240 // max(1, -(-len(texts) // batch)))) * -(-len(texts) // batch)
    order: list[int] = []
    while step < steps:
        if len(order) < batch:
            order += random.permutation(len(texts)).tolist()
        at, order = order[:batch], order[batch:]
        data = np.frombuffer(b"".join(texts[k] for k in at), np.uint8)
        offs = np.append(0, np.cumsum([len(texts[k]) for k in at]))
        doc, begin = places(offs)
        x = pieces(data, offs, doc, begin)
        g = net.gradients(x, np.searchsorted(doc, np.arange(len(at))), labels[at].astype(np.float32))
        step += 1
        now = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for k in net.p:
            m[k] += 0.1 * (g[k] - m[k])
            s[k] += 0.01 * (g[k] * g[k] - s[k])
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = SAMPLE, size: int = SAMPLE_BYTES) -> Net | None:
    """The network, trained on the driver on at most ``rows`` labelled whole texts outside the held-out fold, of at most ``size`` bytes in all; None without labels.

    Texts are taken whole, by a hash of doc_id, those left out that would exceed ``size``.
    """
    pairs = bounded_labels(labels, column, rows)
    texts = checkpointed(labelled_docs(docs, pairs)) if pairs else None
    sizes, total, picked = ({r.doc_id: r.n for r in texts.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()} if pairs else {}), 0, []
    for doc, _ in pairs:
        if doc in sizes and total + sizes[doc] <= size:
            total += sizes[doc]
            picked.append((doc,))
    keys = docs.sparkSession.createDataFrame(picked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}") if picked else None
    got = sorted((r.doc_id, r.label > 0, r.text.encode()) for r in texts.join(F.broadcast(keys), "doc_id", "left_semi").toLocalIterator()) if picked else []
    return train([t for _, _, t in got], np.array([y for _, y, _ in got])) if got else None


def _scorer(net: Net | None):
    def run(batches):
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            for a, b, data, offs in chunks(batch) if net else ():
                out[a:b] = net.scores(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, from all bytes of its text.

    Null texts count as empty and empty texts are scored as one piece of padding.
    Without labels every score is 0.5. Repeated rows are scored one by one, texts of any length whole; a null doc_id counts as empty text in the fold. An empty
    table gives an empty result; other columns are not read. The sample's bounds, ``rows`` and SAMPLE_BYTES, keep training on the driver small.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_scorer(fit(docs, labels, rows=rows)), f"doc_id {kind}, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
