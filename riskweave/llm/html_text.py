"""Main-text extraction with a recurrent block labeller.

A page becomes its sequence of text blocks; a bidirectional LSTM reads their
tag paths and hashed words, and so labels each block with the whole page in
view.  The net is trained here, on a bounded sample of pages whose blocks get
weak labels from plainly named elements; pieces of other pages are put in as
menus, notices, comments and the like so that it also learns those.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the labeller is trained on, at most.
TRAIN_PAGES = 240
PATH_BUCKETS, WORD_BUCKETS = 192, 64
FEATURES = PATH_BUCKETS + WORD_BUCKETS + 5
HIDDEN = 16
#: Blocks labelled at once.
CHUNK_BLOCKS = 20_000

# What HTML says about elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
SILENT = frozenset("script style noscript template svg iframe object title textarea select".split())
#: Of the silent elements, those whose content is no markup: without an end tag it goes to the end of the page.
RAW = frozenset("script style iframe title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"},
} | {t: {"p"} for t in "p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav footer header form main blockquote pre hr figure fieldset".split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: An unquoted value takes the slash that ends it.
_VALUE_SLASH = re.compile(r"=\s*[^\s\"'>]+/\Z")
_WHITE = re.compile(r"\s+")
_PART = re.compile(r"[^a-zA-Z0-9]+")

# Words in tag names, classes and ids that tell what a block is, for weak labels.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget related notice cookie consent gdpr "
    "popup modal ad ads advert adverts advertisement sponsor sponsored promo form login signup subscribe newsletter search comment comments reply "
    "replies respond disqus share social pagination pager copyright toolbar alert skip".split()
)
MAIN_WORDS = frozenset("article main content post entry story body".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int = 0


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and markup are none.

    Tolerant of unclosed and stray tags: an end tag closes the nearest open
    element of its name and all within, or nothing.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = 0
    page = page or ""

    def flush() -> None:
        nonlocal links
        text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, tuple(p for _, p in stack), links))
        parts.clear()
        links = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                parts.append(token)
                if any(t == "a" for t, _ in stack):
                    links += len(token)
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag == "svg" and m[3].endswith("/") and not _VALUE_SLASH.search(m[3]):
            continue
        if tag in SILENT:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close or tag in RAW:
                at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "br":
                flush()
            continue
        ended = CLOSES.get(tag, ())
        while stack and (stack[-1][0] in ended or (ended and stack[-1][0] in INLINE)):
            stack.pop()
        names = " ".join(a or b or c for _, a, b, c in _NAMED.findall(m[3])) if m[3] else ""
        if not m[3].endswith("/"):
            stack.append((tag, f"{tag} {names}".strip()))
    flush()
    return out


def _hash(word: str, buckets: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % buckets


def path_words(path: tuple[str, ...]) -> set[str]:
    return {w for step in path for w in _PART.split(step.lower()) if w}


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row per block: its tag path, its hashed words, and its size, link share and place."""
    x = np.zeros((len(blocks), FEATURES), dtype=np.float32)
    seen: dict[tuple, list[int]] = {}
    for i, b in enumerate(blocks):
        if b.path not in seen:
            seen[b.path] = [_hash(w, PATH_BUCKETS) for w in path_words(b.path)] + [
                _hash("last:" + (b.path[-1].split(" ")[0] if b.path else ""), PATH_BUCKETS)
            ]
        x[i, seen[b.path]] = 1.0
        words = b.text.lower().split()
        counts = np.bincount([_hash(w, WORD_BUCKETS) for w in words], minlength=WORD_BUCKETS)
        x[i, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = counts / len(words)
        x[i, -5:] = (
            np.log1p(len(words)) / 5, min(1.0, b.link_chars / len(b.text)), i / len(blocks), 1 - i / len(blocks),
            b.text[-1] in ".!?",
        )
    return x


def weak_labels(blocks: list[Block]) -> np.ndarray:
    """1 for main text, 0 for the rest, after the names of the elements around a block, innermost first."""
    anchored = any(s.split(" ")[0] in ("article", "main") for b in blocks for s in b.path)
    out = np.zeros(len(blocks), dtype=np.int64)
    for i, b in enumerate(blocks):
        label = 0 if anchored else int(len(b.text) > 80)
        for step in reversed(b.path):
            words = {w for w in _PART.split(step.lower()) if w}
            if words & ASIDE_WORDS:
                label = 0
                break
            if words & MAIN_WORDS and "body" not in step.split(" ")[0]:
                label = 1
                break
        out[i] = label
    return out


def restyled(blocks: list[Block], rng: np.random.Generator) -> list[Block]:
    """The same page as another site would mark it up: other names around and inside the main text."""
    around = (
        ("article",), ("main",), ("main", "article"), ("div content",), ("div main-content", "div post"), ("section entry",),
        ("div article body",), ("main", "div"), ("article", "div", "section"),
    )
    inside = ("p", "p", "p", "p", "li", "blockquote", "td", "h2", "h3", "pre", "div", "dd", "figcaption")
    frame = around[rng.integers(len(around))] if rng.random() < 0.7 else ("article",)
    vary = rng.random() * 0.6
    out = []
    for b in blocks:
        path = list(b.path)
        if "article" in path:
            i = path.index("article")
            path[i : i + 1] = frame
            if path[-1] == "p" and rng.random() < vary:
                kind = inside[rng.integers(len(inside))]
                path[-1:] = {"li": ["ul", "li"], "td": ["table", "tr", "td"], "dd": ["dl", "dd"], "blockquote": ["blockquote", "p"]}.get(kind, [kind])
        out.append(Block(b.text, tuple(path), b.link_chars))
    return out


def with_strange_parts(blocks: list[Block], other: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page with some parts of another one put in as what is not main text, and its labels."""
    mixed, marks = restyled(blocks, rng), list(weak_labels(blocks))
    kinds = (
        ("aside sidebar", "div"), ("div sidebar", "p"), ("section comments", "div comment"), ("div comments", "p"), ("form", "label"),
        ("div cookie notice", "p"), ("header", "h1"), ("header", "p"), ("div menu", "li"), ("div ads", "p"), ("form newsletter", "p"),
        ("div related", "li"), ("ul comment-list", "li comment"), ("aside", "p"), ("aside", ""), ("div banner", ""), ("div share", "a"),
        ("div ad", ""), ("div footer", ""), ("section comments", "h2"), ("div notice", ""),
    )
    for _ in range(rng.integers(1, 6)):
        outer, inner = kinds[rng.integers(len(kinds))]
        main = [i for i in range(1, len(mixed)) if marks[i] and marks[i - 1]]
        if main and rng.random() < 0.5:
            at = int(rng.choice(main))
            around = mixed[at].path[:3]
        else:
            at, around = (0 if rng.random() < 0.4 else len(mixed)), ("html", "body")
        size = int(rng.integers(1, 4))
        start = int(rng.integers(max(1, len(other) - size)))
        put = [Block(b.text, (*around, outer, *([inner] if inner else []))) for b in other[start : start + size]]
        mixed[at:at] = put
        marks[at:at] = [0] * len(put)
    return mixed, np.array(marks, dtype=np.int64)


class BlockLabeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in ("f", "b"):
            self.w[f"x{d}"] = rng.normal(0, 0.15, (FEATURES, 4 * HIDDEN))
            self.w[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{d}"] = np.zeros(4 * HIDDEN)
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.w["o"] = rng.normal(0, 0.3, (2 * HIDDEN, 1))
        self.w["p"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN))
        out = np.zeros((n, steps, HIDDEN))
        into = (x.reshape(n * steps, -1) @ self.w[f"x{d}"]).reshape(n, steps, -1) + self.w[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = into[:, t] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = [self._run(x, mask, d, keep.setdefault(d, []) if keep is not None else None) for d in "fb"]
        joined = np.concatenate(both, axis=2)
        if keep is not None:
            keep["joined"] = joined
        return 1 / (1 + np.exp(-(joined @ self.w["o"] + self.w["p"])[..., 0]))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the blocks."""
        keep: dict = {}
        p = self.scores(x, mask, keep)
        dz = ((p - y) * mask / mask.sum())[..., None]
        g = {"o": np.einsum("nth,ntk->hk", keep["joined"], dz), "p": dz.sum(axis=(0, 1))}
        d_joined = dz @ self.w["o"].T
        for k, d in enumerate("fb"):
            d_out = d_joined[..., k * HIDDEN : (k + 1) * HIDDEN]
            dh = dc = np.zeros((x.shape[0], HIDDEN))
            d_gate = np.zeros((*x.shape[:2], 4 * HIDDEN))
            gh = np.zeros_like(self.w[f"h{d}"])
            for t, h, c, i, f, o, u, tc, m in reversed(keep[d]):
                dh = dh + d_out[:, t]
                inner = dh * m
                d_cell = dc * m + inner * o * (1 - tc * tc)
                a = np.concatenate(
                    [d_cell * u * i * (1 - i), d_cell * c * f * (1 - f), inner * tc * o * (1 - o), d_cell * i * (1 - u * u)], axis=1
                )
                d_gate[:, t] = a
                gh += h.T @ a
                dh = dh * (1 - m) + a @ self.w[f"h{d}"].T
                dc = dc * (1 - m) + d_cell * f
            flat = d_gate.reshape(-1, 4 * HIDDEN)
            g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = x.reshape(-1, FEATURES).T @ flat, gh, flat.sum(axis=0)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 300, batch: int = 24, rate: float = 0.02) -> None:
        """Adam on batches of whole pages."""
        rng = np.random.default_rng(3)
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            part = [pages[i] for i in rng.integers(len(pages), size=batch)]
            x, mask = _padded([p for p, _ in part])
            y = np.zeros(mask.shape)
            for i, (_, labels) in enumerate(part):
                y[i, : labels.size] = labels
            for k, g in self.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= CHUNK_BLOCKS:
                hi += 1
            x, mask = _padded([pages[i] for i in order[lo:hi]])
            for i, s in zip(order[lo:hi], self.scores(x, mask)):
                out[i] = s[: len(pages[i])] >= 0.5
            lo = hi
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(pages), max(map(len, pages)), FEATURES), dtype=np.float32)
    mask = np.zeros(x.shape[:2], dtype=np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
    return x, mask


def train_labeller(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> BlockLabeller:
    """Fit on ``train_pages`` pages of least hash, at most: a bounded sample, chosen the same way at any size."""
    known = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(F.lit(3), html_col).alias("order"), F.col(html_col).cast("string").alias("html"))
    span = 1 << 30
    # half as many again by hash, so that few more than the sample leave the tasks
    share = min(1.0, 1.5 * train_pages / max(1, known.count()))
    sample = known.where(F.pmod("order", F.lit(span)) < F.lit(int(share * span) + 1)).orderBy(F.pmod("order", F.lit(span)), "html").limit(train_pages).collect()
    parsed = [b for r in sample if (b := blocks_of(r["html"]))]
    rng = np.random.default_rng(1)
    seen = []
    for i, blocks in enumerate(parsed):
        seen.append((block_features(blocks), weak_labels(blocks)))
        for _ in range(3):
            mixed, labels = with_strange_parts(blocks, parsed[int(rng.integers(len(parsed)))], rng)
            seen.append((block_features(mixed), labels))
    labeller = BlockLabeller()
    if seen:
        labeller.fit(seen)
    return labeller


def extract_main_text(
    pages: DataFrame, labeller: BlockLabeller, html_col: str = "html", name: str = "text", batch_chars: int = 8_000_000
) -> DataFrame:
    """``pages`` with the main text: its blocks, each on one line, in page order.

    Null html counts as empty and a page without main text gives an empty text.
    A column named like the new one is replaced; all others stay.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller)  # a few hundred KB whatever the input
    carried = [c for c in pages.columns if c != name]
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")
    given = pages.select(row, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts: list[str] = []
            waiting: list[list[Block]] = []
            chars = 0

            def label() -> None:
                for blocks, main in zip(waiting, net.label([block_features(b) for b in waiting])):
                    texts.append("\n".join(b.text for b, keep in zip(blocks, main) if keep))
                waiting.clear()

            for value in batch.column(1):
                page = value.as_py()
                waiting.append(blocks_of(page))
                chars += len(page)
                if chars >= batch_chars:
                    label()
                    chars = 0
            label()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    schema = f"row {given.schema['row'].dataType.simpleString()}, text string"
    return given.mapInArrow(extract, schema).select(
        *[F.col("row").getField(c).alias(c) for c in carried], F.col("text").alias(name)
    )
