"""Main text of web pages: a bidirectional LSTM labels every text block of a page.

A page becomes its sequence of leaf blocks. Each block is seen as hashed features of
its tag path (tags, classes and ids) and of its words, with a few numbers, and the
LSTM reads the whole sequence in both directions before each block is classified. It
is trained on the driver, in numpy, from a bounded sample of pages: their own blocks,
labelled where the markup says what a block is, and the same texts set into other
page layouts.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .wordhash import SPACE, words

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?/][^>]*>|<[a-z!/?][^>]*\Z", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = {"br", "img", "meta", "link", "input", "hr", "wbr", "source", "area", "base", "col", "embed", "track"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Tags that end an open paragraph or item when they begin.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

BUCKETS = 4096
WIDTH = 24
NUMBERS = 6
HIDDEN = 16


@dataclass
class Block:
    text: str
    path: list[str]
    linked: int = 0


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: text between block-level tags, references decoded, white space single."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, [f for tag, names in stack if tag not in _INLINE for f in (tag, *names)], min(linked, len(text))))
        parts.clear()
        linked = 0

    def pop(at: int) -> None:
        nonlocal links
        for tag, _ in stack[at:]:
            links -= tag == "a"
        del stack[at:]

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif m[2]:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag or stack[i][0] not in _INLINE), -1)
                if i >= 0 and stack[i][0] == tag:
                    pop(i)
            elif tag not in _VOID:
                stack.append((tag, []))
                links += tag == "a"
            continue
        flush()
        if m[2]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i >= 0:
                pop(i)
        elif tag not in _VOID and not m[4].endswith("/"):
            ends = _ENDS.get(tag, {"p"})
            i = len(stack) - 1
            while i >= 0 and (stack[i][0] in _INLINE or stack[i][0] in ends):
                i -= 1
            if any(t not in _INLINE for t, _ in stack[i + 1 :]):
                pop(i + 1)
            stack.append((tag, [x for n in _NAMED.finditer(m[4]) for x in re.findall(r"[a-z]+", (n[1] or n[2] or n[3] or "").lower())] if m[4] else []))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


#: What markup calls its parts; fixed by custom on the web.
MAIN_NAMES = {"article", "main", "content", "post", "entry", "story", "body"}
OTHER_NAMES = {
    "head", "nav", "header", "footer", "aside", "form", "menu", "navbar", "breadcrumb", "breadcrumbs", "sidebar", "widget", "ad", "ads", "advert", "advertisement",
    "banner", "sponsor", "sponsored", "promo", "promotion", "notice", "cookie", "consent", "alert", "popup", "modal", "subscribe", "newsletter", "signup", "login",
    "search", "comment", "comments", "reply", "respond", "disqus", "share", "social", "related", "recommended", "pagination", "pager", "copyright", "legal", "dialog", "button",
}


def weak_label(b: Block) -> int | None:
    """1 for an article's block, 0 for another; None where the path doesn't tell."""
    names = b.path[2:] if b.path[:2] == ["html", "body"] else b.path[1:] if b.path[:1] in (["html"], ["body"]) else b.path
    if any(x in OTHER_NAMES for x in names):
        return 0
    return 1 if any(x in MAIN_NAMES for x in names) else None


_LAYOUTS_MAIN = (["article"], ["main"], ["div", "content"], ["main", "article"], ["div", "post"], ["section", "entry"], ["div", "main"], ["div", "article", "body"], ["div", "story"], ["div", "page", "main", "article"])
_LAYOUTS_OTHER = (
    ["nav", "ul", "li"], ["header"], ["header", "nav", "ul", "li"], ["div", "menu", "ul", "li"], ["ul", "nav", "li"], ["div", "ad"], ["div", "advert"], ["aside"], ["aside", "sidebar", "div"], ["div", "sidebar", "ul", "li"],
    ["div", "banner"], ["div", "cookie", "notice"], ["div", "notice"], ["form"], ["form", "div"], ["div", "newsletter", "form"], ["section", "comments", "div", "comment", "p"], ["div", "comments", "p"], ["ol", "comment", "list", "li", "p"],
    ["footer"], ["footer", "p"], ["div", "footer"], ["div", "related", "ul", "li"], ["div", "share"], ["div", "breadcrumb"], ["div", "promo"],
)


def training_pages(pages: list[list[Block]], seed: int = 3) -> list[tuple[list[Block], np.ndarray]]:
    """Pages with a label of each block (-1: unknown): as they are, and in other layouts with blocks of other kinds around and inside."""
    r = np.random.default_rng(seed)
    out = []
    texts_in, texts_out = [], [b for p in pages for b in p if weak_label(b) == 0]
    for p in pages:
        labels = [weak_label(b) for b in p]
        out.append((p, np.array([-1 if y is None else y for y in labels])))
        texts_in.append([b for b, y in zip(p, labels, strict=True) if y == 1])
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    for main in texts_in:
        if not main or not texts_out:
            continue
        where = pick(_LAYOUTS_MAIN)
        page: list[tuple[Block, int]] = [(Block(main[0].text[:60], ["html", "head", "title"]), 0)]

        def others(n: int, inside: list[str]) -> None:
            for _ in range(n):
                kind = pick(_LAYOUTS_OTHER)
                whole = "comment" in " ".join(kind) or kind[-1] in ("aside", "notice", "promo")
                for _ in range(int(r.integers(1, 5))):
                    t = pick(pick(texts_in) or main).text if whole else pick(texts_out).text  # noqa: B023
                    page.append((Block(t, ["html", "body", *inside, *kind], len(t) if kind[-1] == "li" else 0), 0))  # noqa: B023

        wrap = ["div"] * int(r.integers(0, 3))
        others(int(r.integers(1, 4)), wrap)
        for b in main:
            leaf = b.path[-1] if b.path and b.path[-1] not in MAIN_NAMES else pick(["p", "div", "p"])
            page.append((Block(b.text, ["html", "body", *wrap, *where, *(["div"] * int(r.random() < 0.2)), leaf]), 1))
            if r.random() < 0.08:
                others(1, [*wrap, *where])
        others(int(r.integers(1, 4)), wrap)
        out.append(([b for b, _ in page], np.array([y for _, y in page])))
    return out


def _hashed(names: list[str]) -> list[int]:
    """Buckets of a path: each name, and each name with the one before it."""
    return [zlib.crc32(x.encode()) % BUCKETS for x in (*names, *(f"{a}>{b}" for a, b in zip(names, names[1:], strict=False)))]


@dataclass
class Batch:
    """Blocks of several pages: feature buckets (flat, with their block), numbers, and place in (time, page)."""

    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    numbers: np.ndarray
    page: np.ndarray
    time: np.ndarray
    n_pages: int = 0
    length: int = field(default=0)


_known_paths: dict[tuple[str, ...], list[int]] = {}


def featurise(pages: list[list[Block]]) -> Batch:
    flat = [b for p in pages for b in p]
    path: list[int] = []
    path_n = []
    for b in flat:
        key = tuple(b.path)
        got = _known_paths.get(key)
        if got is None:
            if len(_known_paths) > 50_000:
                _known_paths.clear()
            got = _known_paths[key] = _hashed(b.path)
        path += got
        path_n.append(len(got))
    raw = [b.text.encode() for b in flat]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    w = words(np.frombuffer(b"".join(raw), np.uint8), offsets, SPACE)
    n_words, n_chars = np.diff(w.first), np.array([len(b.text) for b in flat], float)
    linked = np.array([b.linked for b in flat], float)
    sizes = [len(p) for p in pages]
    time = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64)
    of = np.repeat(np.array(sizes, float), sizes) if sizes else np.zeros(0)
    ends = np.array([b.text[-1:] in ".!?" for b in flat], float)
    numbers = np.stack([np.log1p(n_words) / 5, np.log1p(n_chars) / 7, linked / np.maximum(n_chars, 1), ends, time / np.maximum(of, 1), np.minimum(time, 10) / 10], 1) if flat else np.zeros((0, NUMBERS))
    return Batch(np.array(path, np.int64), np.repeat(np.arange(len(flat)), path_n).astype(np.int64), (w.hash % np.uint64(BUCKETS)).astype(np.int64), w.doc, numbers, np.repeat(np.arange(len(pages)), sizes).astype(np.int64), time.astype(np.int64), len(pages), max(sizes, default=0))


def _mean(table: np.ndarray, bucket: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean table row of each block's buckets, and one over their number."""
    count = np.bincount(of, minlength=n)
    share = 1 / np.maximum(count, 1)
    total = np.zeros((n, table.shape[1]), table.dtype)
    full = np.flatnonzero(count)
    if len(full):
        first = np.concatenate([[0], np.cumsum(count)])[:-1][full]
        total[full] = np.add.reduceat(table[bucket], first, axis=0)
    return total * share[:, None].astype(table.dtype), share


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, on: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, page, HIDDEN) over x (time, page, features + 1); off steps carry the state on."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out = np.zeros((t, n, HIDDEN), x.dtype)
    for k in range(t):
        z = np.concatenate([x[k], h], 1)
        g = z @ w
        i, f, o, u = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        c2 = f * c + i * u
        tc = np.tanh(c2)
        h2 = o * tc
        m = on[k][:, None]
        if keep is not None:
            keep.append((z, i, f, o, u, c, tc, m))
        c, h = np.where(m, c2, c), np.where(m, h2, h)
        out[k] = h
    return out


def _lstm_back(dout: np.ndarray, w: np.ndarray, keep: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of w."""
    t, n, _ = dout.shape
    dx, dw = np.zeros((t, n, width)), np.zeros_like(w)
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for k in range(t - 1, -1, -1):
        z, i, f, o, u, c, tc, m = keep[k]
        dh = dh + dout[k]
        a, d = np.where(m, dh, 0), np.where(m, dc, 0)
        d = d + a * o * (1 - tc**2)
        dg = np.concatenate([d * u * i * (1 - i), d * c * f * (1 - f), a * tc * o * (1 - o), d * i * (1 - u**2)], 1)
        dz = dg @ w.T
        dw += z.T @ dg
        dx[k] = dz[:, :width]
        dh, dc = np.where(m, dz[:, width:], dh), np.where(m, d * f, dc)
    return dx, dw


def new_model(seed: int = 9) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    width = 2 * WIDTH + NUMBERS + 1
    lstm = lambda: r.normal(0, 0.15, (width + HIDDEN, 4 * HIDDEN))
    return {"path": r.normal(0, 0.3, (BUCKETS, WIDTH)), "word": r.normal(0, 0.1, (BUCKETS, WIDTH)), "fwd": lstm(), "back": lstm(), "out": r.normal(0, 0.3, (2 * HIDDEN + 1, 1))}


def _forward(model: dict[str, np.ndarray], b: Batch, path_on: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
    """Log-odds of each block."""
    n, kind = len(b.page), model["out"].dtype
    p, p_share = _mean(model["path"], b.path, b.path_of, n)
    if path_on is not None:
        p = p * path_on[:, None]
    q, q_share = _mean(model["word"], b.word, b.word_of, n)
    x = np.zeros((b.length, b.n_pages, 2 * WIDTH + NUMBERS + 1), kind)
    x[b.time, b.page] = np.concatenate([p, q, b.numbers.astype(kind), np.ones((n, 1), kind)], 1)
    on = np.zeros((b.length, b.n_pages), bool)
    on[b.time, b.page] = True
    kf, kb = ([], []) if keep is not None else (None, None)
    hf = _lstm(x, on, model["fwd"], kf)
    hb = _lstm(x[::-1], on[::-1], model["back"], kb)[::-1]
    h = np.concatenate([hf[b.time, b.page], hb[b.time, b.page], np.ones((n, 1), kind)], 1)
    if keep is not None:
        keep |= {"kf": kf, "kb": kb, "h": h, "p_share": p_share, "q_share": q_share, "shape": x.shape}
    return (h @ model["out"])[:, 0]


def train(pages: list[tuple[list[Block], np.ndarray]], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 4) -> dict[str, np.ndarray]:
    """Adam on the log loss of known blocks; the path of one block in ten is hidden, so that words and neighbours count too."""
    model = new_model()
    r = np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in model.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(pages))
        for at in range(0, len(order), batch):
            chosen = [pages[i] for i in order[at : at + batch]]
            b = featurise([p for p, _ in chosen])
            y = np.concatenate([y for _, y in chosen])
            if not len(y):
                continue
            path_on = (r.random(len(y)) >= 0.1).astype(float)
            keep: dict = {}
            score = _forward(model, b, path_on, keep)
            d = np.where(y >= 0, _sigmoid(score) - y, 0.0)[:, None] / max(1, (y >= 0).sum())
            grad = {"out": keep["h"].T @ d}
            dh = d @ model["out"].T
            t, n, width = keep["shape"]
            df, db = np.zeros((t, n, HIDDEN)), np.zeros((t, n, HIDDEN))
            df[b.time, b.page], db[b.time, b.page] = dh[:, :HIDDEN], dh[:, HIDDEN : 2 * HIDDEN]
            dxf, grad["fwd"] = _lstm_back(df, model["fwd"], keep["kf"], width)
            dxb, grad["back"] = _lstm_back(db[::-1], model["back"], keep["kb"], width)
            dx = (dxf + dxb[::-1])[b.time, b.page]
            for name, part, bucket, of, share in (("path", dx[:, :WIDTH] * path_on[:, None], b.path, b.path_of, keep["p_share"]), ("word", dx[:, WIDTH : 2 * WIDTH], b.word, b.word_of, keep["q_share"])):
                grad[name] = np.zeros_like(model[name])
                np.add.at(grad[name], bucket, (part * share[:, None])[of])
            step += 1
            for k, g in grad.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                model[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in model.items()}


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = 300, sample_chars: int = 8_000_000) -> DataFrame:
    """One row for each row of `pages`: page_id, url, text, n_chars.

    `text` joins the blocks that the network takes for the article's, in page order, by
    an empty line; n_chars counts its code points. Every block of every page is
    classified, and nothing is cut. The network is trained on at most `sample_pages`
    pages, picked by a hash of their ids, of `sample_chars` characters together (a page
    that goes beyond is left out); long ones are learnt in runs of 512 blocks.
    Null, empty and text-free pages give an empty text; repeated rows give the same text
    each; other columns are ignored. If no page of the sample tells its parts by markup,
    all of a page's visible text is kept.
    """
    spark = pages.sparkSession
    ship(spark)
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # The sample's hashes first, then only its pages: else every task would send its own best ones to the driver.
    hashed = df.where("html IS NOT NULL").select("html", F.xxhash64("page_id", "html", F.lit(5)).alias("h"))
    picked, left = [], sample_chars
    for r in hashed.select("h", F.length("html").alias("n")).dropDuplicates(["h"]).orderBy("h").limit(sample_pages).collect():
        if r["n"] <= left:
            picked.append(r["h"])
            left -= r["n"]
    rows = sorted(hashed.where(F.col("h").isin(picked)).dropDuplicates(["h"]).collect(), key=lambda r: r["h"]) if picked else []
    whole = [(p, y) for p, y in training_pages([blocks(r["html"]) for r in rows]) if (y == 0).any() and (y == 1).any()]
    made = [(p[i : i + 512], y[i : i + 512]) for p, y in whole for i in range(0, len(p), 512)]
    model = spark.sparkContext.broadcast(train(made) if made else None)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [blocks(x.as_py()) for x in part.column("html")]
                # Pages of like length together, so that little is padded.
                order = sorted(range(len(found)), key=lambda i: len(found[i]))
                texts = [""] * len(found)
                for k in range(0, len(order), 32):
                    own = order[k : k + 32]
                    b = featurise([found[i] for i in own])
                    on = iter((_forward(model.value, b) >= 0).tolist() if model.value is not None and len(b.page) else [True] * len(b.page))
                    for i in own:
                        texts[i] = "\n\n".join(x.text for x in found[i] if next(on))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(label, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
