"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM, decoded by Viterbi."""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_labels import TEMPLATES, labelled_pages

#: Fixed values of the HTML standard: elements without content, whose content is text, that break lines, and that close an open paragraph or their like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object canvas video audio".split())
#: Of these, what browsers take as text up to the page's end when it is not closed; the others are then elements like any.
TO_END = frozenset("script style textarea title iframe".split())
BLOCK = frozenset(
    "html head body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend label button blockquote pre figure figcaption address hr br details summary dialog menu hgroup center".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
ENDS_P = BLOCK - {"br", "label", "button"}
STOP = frozenset("ul ol dl table tbody thead tfoot article section div aside nav header footer main form".split())

#: A quote opens a value only after ``=``; one that no fitting quote closes is a character like any, so that a stray quote spoils no more than its tag.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"<]*\"|=\s*'[^'<]*'|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I | re.S)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
BITS = 14
_codes: dict[str, int] = {}


def _code(name: str) -> int:
    got = _codes.get(name)
    if got is None:
        if len(_codes) > 200_000:
            _codes.clear()
        h = 2166136261
        for c in name.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        got = _codes[name] = (h ^ h >> 15) % (1 << BITS)
    return got


def blocks(page: str) -> list[tuple[str, tuple, int, int]]:
    """(text, ancestors as (tag, class and id words), characters in links, tags inside) of each leaf block, in page order.

    Text of one block is cut where a block element begins or ends; character references
    are decoded and white space is one space. Scripts, styles, other raw elements, comments and
    hidden elements give no blocks; a raw element outside TO_END that is never closed is like any other. Open elements may stay unclosed.
    """
    out, stack, parts = [], [], []
    links = inside = hidden = 0
    a = 0
    unclosed = set()

    def flush():
        nonlocal parts, links, inside
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, tuple(x[:2] for x in stack), links, inside))
            parts = []
        links = inside = 0

    def leave(k: int):
        nonlocal hidden
        while len(stack) > k:
            hidden -= stack.pop()[2]

    while True:
        m = _TAG.search(page, a)
        text = page[a : m.start()] if m else page[a:]
        if text and not hidden:
            parts.append(text)
            if any(x[0] == "a" for x in stack):
                links += len(text)
        if not m:
            break
        a = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "p" or name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in BLOCK or not any(x[0] in BLOCK for x in stack[k + 1 :]):
                        leave(k)
                    break
                if stack[k][0] in STOP and name not in STOP:
                    break
            continue
        if name in RAW and m[3].rstrip().endswith("/"):
            continue
        if name in RAW and name not in unclosed:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, a)
            if end or name in TO_END:
                a = end.end() if end else len(page)
                continue
            unclosed.add(name)
        if name in BLOCK:
            flush()
            if name in ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        leave(k)
                        break
                    if stack[k][0] in STOP:
                        break
            if name in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[name]:
                        leave(k)
                        break
                    if stack[k][0] in STOP and not (name in ("td", "th") and stack[k][0] == "tr"):
                        break
        else:
            inside += 1
        if name in VOID:
            continue
        attributes = m[3]
        words = ()
        if attributes and not attributes.isspace():
            words = tuple(w.lower() for x in _NAMES.finditer(attributes) for w in _PART.findall(x[2] or x[3] or x[4] or ""))
        concealed = bool(attributes and _HIDDEN.search(attributes))
        hidden += concealed
        stack.append((name, words, concealed))
    flush()
    return out


def _share(text: str, links: int) -> int:
    share = links / max(len(text), links, 1)
    return 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3


def features(page: list[tuple[str, tuple, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(block, feature) pairs: ancestor tags and their class words, the innermost ones by depth, and binned shape of the text and of the blocks beside it."""
    row, column = [], []
    memo: dict[tuple, list[int]] = {}
    central = lambda over: any(t in ("article", "main") for t, _ in over)
    marked = any(central(over) for _, over, _, _ in page)
    for k, (text, over, links, inside) in enumerate(page):
        codes = memo.get(over)
        if codes is None:
            names = {f"t:{t}" for t, _ in over if t not in ("html", "body", "b", "i", "em", "strong", "span", "u", "font")}
            names |= {f"c:{w}" for _, ws in over for w in ws}
            shut = [t for t, _ in over if t in BLOCK]
            names.add("a:in" if central(over) else "a:out" if marked else "a:none")
            names |= {f"1:{shut[-1]}" if shut else "1:", f"2:{'/'.join(shut[-2:])}"}
            codes = memo[over] = [_code(n) for n in names]
        n = len(text)
        beside = [page[j] if 0 <= j < len(page) else None for j in (k - 1, k + 1)]
        shape = [
            f"n:{min(n.bit_length(), 9)}", f"l:{_share(text, links)}", f"w:{min(text.count(' ') // 4, 6)}",
            "e:1" if text[-1] in ".!?…。:;\"”»" else "e:0", f"m:{min(inside, 3)}", "d:1" if any(c.isdigit() for c in text[:40]) else "d:0",
            "©" if "©" in text[:12] or "\N{MIDDLE DOT}" in text[:40] else "_", "first" if k == 0 else "last" if k == len(page) - 1 else "mid",
            *(f"{side}:{_share(b[0], b[2])}{min(len(b[0]).bit_length(), 9) // 2}" if b else f"{side}:" for side, b in zip("pq", beside)),
        ]
        codes = [*codes, *map(_code, shape), 1 << BITS]
        row += [k] * len(codes)
        column += codes
    return np.array(row, np.int64), np.array(column, np.int64)


class CRF:
    """Two labels (0 other, 1 main text): a weight for each label and feature, and for each label after a label."""

    def __init__(self, w: np.ndarray | None = None, t: np.ndarray | None = None):
        self.w = np.zeros((2, (1 << BITS) + 1)) if w is None else w
        self.t = np.zeros((3, 2)) if t is None else t

    def unary(self, row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(row, self.w[y][column], n) for y in (0, 1)], 1)

    def decode(self, row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        """The likeliest labels, by Viterbi."""
        u = self.unary(row, column, n).tolist()
        (t00, t01), (t10, t11), (s0, s1) = self.t.tolist()
        a, b = s0 + u[0][0], s1 + u[0][1]
        back = []
        for x, y in u[1:]:
            p, q = a + t00 >= b + t10, a + t01 >= b + t11
            back.append((not p, not q))
            a, b = (a + t00 if p else b + t10) + x, (a + t01 if q else b + t11) + y
        label = int(b > a)
        out = [label]
        for p, q in reversed(back):
            label = int(q if label else p)
            out.append(label)
        return np.array(out[::-1], bool)

    def gradient(self, row: np.ndarray, column: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected: (blocks x labels, transitions), by forward and backward sums."""
        n = len(y)
        u, t = self.unary(row, column, n), self.t[:2]
        add = np.logaddexp
        f, b = np.empty((n, 2)), np.zeros((n, 2))
        f[0] = self.t[2] + u[0]
        for k in range(1, n):
            f[k] = u[k] + add(f[k - 1, 0] + t[0], f[k - 1, 1] + t[1])
        for k in range(n - 2, -1, -1):
            b[k] = add(t[:, 0] + u[k + 1, 0] + b[k + 1, 0], t[:, 1] + u[k + 1, 1] + b[k + 1, 1])
        z = add(f[-1, 0], f[-1, 1])
        d = -np.exp(f + b - z)
        e = np.zeros((3, 2))
        e[2] = d[0]
        if n > 1:
            e[:2] = -np.exp(f[:-1, :, None] + t + (u[1:] + b[1:])[:, None, :] - z).sum(0)
            np.add.at(e, (y[:-1], y[1:]), 1)
        e[2, y[0]] += 1
        d[np.arange(n), y] += 1
        return d, e


def train(pages: list[tuple[list, list[int]]], epochs: int = 5, rate: float = 0.2, l2: float = 1e-4, seed: int = 1) -> CRF:
    """Conditional maximum likelihood, AdaGrad over pages."""
    model, random = CRF(), np.random.default_rng(seed)
    gw, gt = np.full(model.w.shape, 1e-2), np.full(model.t.shape, 1e-2)
    data = [(*features(x), np.array(y)) for x, y in pages if x]
    for _ in range(epochs):
        for k in random.permutation(len(data)):
            row, column, y = data[k]
            d, e = model.gradient(row, column, y)
            used, at = np.unique(column, return_inverse=True)
            for label in (0, 1):
                g = np.bincount(at, d[row, label], len(used)) - l2 * model.w[label, used]
                gw[label, used] += g * g
                model.w[label, used] += rate * g / np.sqrt(gw[label, used])
            gt += e * e
            model.t += rate * e / np.sqrt(gt)
    return model


@functools.lru_cache
def fitted(pages: int = 1200, templates: tuple[str, ...] = TEMPLATES) -> CRF:
    """The field trained on ``pages`` labelled pages of `html_labels`, the documented bound of the training set."""
    return train([_label(*p) for p in labelled_pages(pages, templates=templates)])


def accuracy(model: CRF, pages: int, templates: tuple[str, ...], seed: int = 77) -> float:
    """The share of blocks of fresh pages by these templates that the field labels right."""
    right = total = 0
    for page, main in labelled_pages(pages, seed, templates):
        found, labels = _label(page, main)
        right += int((model.decode(*features(found), len(found)) == np.array(labels, bool)).sum())
        total += len(found)
    return right / total


def _label(page: str, main: set[str]) -> tuple[list, list[int]]:
    found = blocks(page)
    return found, [int(text in main) for text, *_ in found]


def main_text(page: str | None, model: CRF) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = model.decode(*features(found), len(found))
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def _extract(model: CRF):
    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame, model: CRF | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``, from the whole html.

    The blocks labelled main text, joined by line feeds; a null or empty page or one without
    main text gives an empty text. Repeated rows are extracted one by one, null ids and urls are passed on, pages of any length are taken whole, other
    columns are not read; an empty table gives an empty result. Without ``model`` the field of `fitted` is trained first, on the driver.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(_extract(model or fitted()), f"page_id {kinds['page_id']}, url string, text string, n_chars long")
