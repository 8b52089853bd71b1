"""Main text of web pages by a recurrent block labeller.

A page is cut to its leaf blocks: runs of text between block-level tags, in page
order. A block is described by its tag path (tags, classes, ids and roles of its
ancestors, hashed), its words (hashed) and a few measures such as the share of text
in links. A bidirectional LSTM, in numpy, reads the whole page's sequence, so every
block is labelled with the document's context, and the blocks labelled as article
are the page's text.

It is trained here, on a sample of at most SAMPLE_PAGES pages of at most SAMPLED_BYTES bytes, whole. Their blocks' labels
come from elements that say what they hold (article and main, and inside them no
nav, aside, form, footer, comments). As pages of one site look alike, each sampled
page is also seen in other dress: its blocks are dealt into the containers that
other sites use for the article (WRAPPERS) and for everything else (FURNITURE).
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.llm.common import few_rows

SAMPLE_PAGES = 200
DRESSES = 2
EPOCHS = 10
BATCH = 16
HIDDEN = 24
PATH, WORDS, MEASURES = 64, 32, 10
WIDTH = PATH + WORDS + MEASURES
SAMPLED_BYTES = 1 << 18  # longer pages are not drawn for training

#: Elements whose text is no text of the page.
SILENT = frozenset("script style noscript template head title svg iframe object canvas".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open one of the same kind.
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
#: Block-level tags that end an open paragraph.
ENDS_P = BLOCKS - {"button", "label", "option", "html", "body", "td", "th", "tr"}

#: Names by which a container's content is known for sure.
_ARTICLE = frozenset({"article", "main"})
_OTHER = frozenset({"nav", "aside", "footer", "form", "menu", "button", "dialog", ".comment", ".comments", ".sidebar", ".ad", ".ads", ".advert", ".cookie", ".related", ".share", ".newsletter"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|\d+")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "title", "svg", "iframe", "object", "canvas", "textarea")}
_SPACE = re.compile(r"\s+")


class Path:
    """The block-level tags above a block, with their names, as a node of a tree: what is needed of the
    whole path is carried down, so a block costs the same at any depth."""

    __slots__ = ("below", "size", "article", "other", "leaf", "sums", "vector")

    def __init__(self, parent: Path | None = None, names: tuple[str, ...] = ()):
        self.below: dict[tuple[str, ...], Path] = {}
        self.size = len(names) + (parent.size if parent else 0)
        self.article = not _ARTICLE.isdisjoint(names) or bool(parent and parent.article)
        self.other = not _OTHER.isdisjoint(names) or bool(parent and parent.other)
        self.leaf = next((n for n in reversed(names) if n[0] != "."), parent.leaf if parent else "")
        self.sums = parent.sums.copy() if parent else np.zeros(PATH, np.float32)
        for name in names:
            place, sign = _slot(name, PATH)
            self.sums[place] += sign
        self.vector = self.sums / (max(1.0, float(np.linalg.norm(self.sums))) / 2)


class Paths:
    """Paths met before, up to a bound."""

    LIMIT = 50_000

    def __init__(self):
        self.root, self.held = Path(), 0

    def under(self, parent: Path, names: tuple[str, ...]) -> Path:
        found = parent.below.get(names)
        if found is None:
            found = Path(parent, names)
            self.held += 1
            if self.held <= self.LIMIT:
                parent.below[names] = found
        return found

    def of(self, *names: str) -> Path:
        at = self.root
        for name in names:
            at = self.under(at, (name,))
        return at

    def rest(self) -> None:
        """Forget them if there are too many; to be called between pages."""
        if self.held > self.LIMIT:
            self.root, self.held = Path(), 0


@dataclass
class Block:
    text: str
    path: Path
    linked: int  # characters inside links
    leaf: str


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for m in _NAMES.finditer(attributes):
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        out += [f".{part}" for part in _NAME.findall(value)]
    return tuple(out)


def parse(page: str | None, paths: Paths | None = None) -> list[Block]:
    """The leaf blocks of a page with their text, whole, and decoded. Unclosed and
    stray tags do no harm; a null page has no block. Each tag is looked at once."""
    page, paths = page or "", paths or Paths()
    blocks: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: dict[str, int] = {}  # how many of each tag are on the stack
    pieces: list[str] = []
    linked = at = 0
    seen: dict[tuple[str, str], tuple[str, ...]] = {}

    def close():
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                path = stack[-1][1] if stack else paths.root
                blocks.append(Block(text, path, min(linked, len(text)), path.leaf))
            pieces.clear()
            linked = 0

    def pop(to: int):
        for t, _ in stack[to:]:
            opened[t] -= 1
        del stack[to:]

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            pieces.append(page[at:end])
            if opened.get("a"):
                linked += end - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            close()
        elif tag == "br":
            pieces.append(" ")
        if m[1]:
            if opened.get(tag):
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in EMPTY:
            continue
        if tag in _CLOSE and tag != "textarea":
            if m[0].endswith("/>") and tag in ("svg", "object", "canvas"):
                continue
            stop = _CLOSE[tag].search(page, at)
            at = stop.end() if stop else size
            continue
        if tag in SILENT:  # the head; what it holds is silent by itself
            continue
        ends = ENDS_ITSELF.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
            if stack[k][0] in ends:
                pop(k)
                break
            if stack[k][0] in BLOCKS:
                break
        path = stack[-1][1] if stack else paths.root
        if tag in BLOCKS:
            key = (tag, m[3])
            if key not in seen:
                seen[key] = _names(tag, m[3])
            path = paths.under(path, seen[key])
        stack.append((tag, path))
        opened[tag] = opened.get(tag, 0) + 1
    close()
    return blocks


def _slot(text: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h & 0x10000 else -1.0


class Features:
    """Vectors of blocks; hashed words are remembered, up to a bound."""

    LIMIT = 200_000

    def __init__(self):
        self.slots: dict[str, tuple[int, float]] = {}

    def words(self, text: str) -> np.ndarray:
        v = np.zeros(WORDS, np.float32)
        for w in text.lower().split():
            slot = self.slots.get(w)
            if slot is None:
                slot = _slot(w, WORDS)
                if len(self.slots) > self.LIMIT:
                    self.slots.clear()
                self.slots[w] = slot
            v[slot[0]] += slot[1]
        return v / max(1.0, float(np.linalg.norm(v)))

    def __call__(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), WIDTH), np.float32)
        for i, b in enumerate(blocks):
            n = len(b.text)
            out[i, :PATH] = b.path.vector
            out[i, PATH : PATH + WORDS] = self.words(b.text)
            ends = b.text[-1] in ".!?…"
            out[i, PATH + WORDS :] = (np.log1p(n) / 5, np.log1p(b.text.count(" ")) / 4, b.linked / n, float(ends), b.text.count(".") / n * 20, float(b.leaf[:1] == "h" and b.leaf[1:].isdigit()), float(b.leaf == "p"), float(b.leaf == "li"), i / len(blocks), b.path.size / 10)
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, mask, w, u, b, keep=False):
    """Hidden states of a batch (time, batch, width); a masked step changes nothing."""
    steps, batch, _ = x.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    c = np.zeros((batch, HIDDEN), np.float32)
    given = x @ w + b
    out, memory = np.zeros((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = given[t] + h @ u
        g = np.tanh(z[:, :HIDDEN])
        i, f, o = np.split(_sigmoid(z[:, HIDDEN:]), 3, axis=1)
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            memory.append((h, c, g, i, f, o, tc, m))
        c = np.where(m, c_new, c)
        h = np.where(m, o * tc, h)
        out[t] = h
    return out, memory


def _lstm_back(x, d_out, memory, w, u):
    d_w, d_u, d_b = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32)
    d_h = np.zeros_like(d_out[0])
    d_c = np.zeros_like(d_h)
    for t in range(len(memory) - 1, -1, -1):
        h, c, g, i, f, o, tc, m = memory[t]
        d_h = d_h + d_out[t]
        inner = d_h * m
        d_cell = d_c * m + inner * o * (1 - tc * tc)
        d_z = np.concatenate([d_cell * i * (1 - g * g), d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), inner * tc * o * (1 - o)], axis=1)
        d_w += x[t].T @ d_z
        d_u += h.T @ d_z
        d_b += d_z.sum(axis=0)
        d_c = np.where(m, d_cell * f, d_c)
        d_h = np.where(m, d_z @ u.T, d_h)
    return d_w, d_u, d_b


def _padded(pages: list[np.ndarray]):
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
    return x, mask


def _reversed(a, mask):
    """Each sequence of the batch backwards, its padding still behind it."""
    n = mask.sum(axis=0)
    t = np.arange(len(mask))[:, None]
    return np.take_along_axis(a, np.where(t < n, n - 1 - t, t).reshape(len(mask), -1, *[1] * (a.ndim - 2)), axis=0)


@dataclass
class Labeller:
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w[f"{side}w"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN)).astype(np.float32)
            w[f"{side}u"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"{side}b"] = np.zeros(4 * HIDDEN, np.float32)
            w[f"{side}b"][2 * HIDDEN : 3 * HIDDEN] = 1
        w["o"] = rng.normal(0, 0.2, (2 * HIDDEN + WIDTH,)).astype(np.float32)
        w["c"] = np.zeros(1, np.float32)
        return cls(w)

    def forward(self, x, mask, keep=False):
        w = self.weights
        ahead, m1 = _lstm(x, mask, w["fw"], w["fu"], w["fb"], keep)
        turned = _reversed(x, mask)
        back, m2 = _lstm(turned, mask, w["bw"], w["bu"], w["bb"], keep)
        top = np.concatenate([ahead, _reversed(back, mask), x], axis=2)
        return _sigmoid(top @ w["o"] + w["c"][0]), top, m1, m2, turned

    def gradients(self, x, mask, y):
        w = self.weights
        p, top, m1, m2, turned = self.forward(x, mask, True)
        d = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        d_top = d[:, :, None] * w["o"]
        g = {"o": np.tensordot(d, top, ((0, 1), (0, 1))), "c": np.array([d.sum()], np.float32)}
        g["fw"], g["fu"], g["fb"] = _lstm_back(x, d_top[:, :, :HIDDEN], m1, w["fw"], w["fu"])
        g["bw"], g["bu"], g["bb"] = _lstm_back(turned, _reversed(d_top[:, :, HIDDEN : 2 * HIDDEN], mask), m2, w["bw"], w["bu"])
        return g

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 4) -> None:
        """Adam over batches of pages."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                x, mask = _padded([pages[i] for i in pick])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(pick):
                    y[: len(labels[i]), j] = labels[i]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def predict(self, pages: list[np.ndarray], cells: int = 4096) -> list[np.ndarray]:
        """Each block's share of being article; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = max(1, min(256, cells // len(pages[order[at]])))
            pick = order[at : at + n]
            while len(pick) > 1 and len(pages[pick[-1]]) * len(pick) > 2 * cells:
                pick = pick[: len(pick) // 2]
            p = self.forward(*_padded([pages[i] for i in pick]))[0]
            for j, i in enumerate(pick):
                out[i] = p[: len(pages[i]), j]
            at += len(pick)
        return out


#: Containers of the article on other sites.
WRAPPERS = (
    ("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", ".content"), ("div", ".post"), ("div", ".post", ".body"), ("div", ".entry", ".content"), ("section", ".article", ".body"),
    ("div", ".story"), ("div", ".text"), ("div", ".article"), ("section", ".post"), ("div", ".page", "div", ".content"), ("table", "tbody", "tr", "td"), ("div",), ("section",), ("div", "div"), ("div", ".container", "div", ".row", "div", ".col", ".8"),
)
#: Containers of everything else, with where they stand (before, amid, after the article) and what they hold.
FURNITURE = (
    (("nav", "ul", "li"), "ba", "menu"), (("div", ".menu", "ul", "li"), "ba", "menu"), (("header",), "b", "short"), (("header", "div", ".logo"), "b", "short"), (("div", ".header"), "b", "short"), (("header", "nav", "ul", "li"), "b", "menu"), (("div", ".breadcrumb"), "b", "menu"), (("div", ".breadcrumbs", "ol", "li"), "b", "menu"), (("div", ".navbar"), "b", "menu"), (("div", ".topbar"), "b", "short"),
    (("aside",), "ba", "prose"), (("aside", "p"), "ba", "prose"), (("div", ".sidebar"), "ba", "prose"), (("div", ".sidebar", "ul", "li"), "ba", "menu"), (("div", ".widget"), "a", "prose"), (("div", ".related"), "a", "menu"), (("section", ".related", "ul", "li"), "a", "menu"), (("div", ".recommended", "h3"), "a", "short"),
    (("div", ".ad"), "bma", "prose"), (("div", ".ads"), "bma", "prose"), (("div", ".advert"), "bma", "prose"), (("div", ".advertisement"), "bma", "prose"), (("div", ".banner"), "bm", "prose"), (("div", ".promo"), "ma", "prose"), (("div", ".sponsored"), "ma", "prose"),
    (("div", ".cookie", ".notice"), "ba", "prose"), (("div", ".cookie", ".banner", "p"), "ba", "prose"), (("div", ".notice"), "ba", "prose"), (("div", ".alert"), "b", "prose"), (("div", ".consent"), "ba", "prose"), (("div", ".modal"), "a", "prose"), (("div", ".popup"), "a", "prose"), (("dialog",), "ba", "prose"),
    (("form",), "ma", "short"), (("form", "label"), "ma", "short"), (("form", "button"), "ma", "short"), (("form", ".search", "button"), "b", "short"), (("div", ".newsletter"), "ma", "prose"), (("div", ".subscribe", "p"), "ma", "prose"), (("div", ".login"), "b", "short"), (("form", "select", "option"), "ba", "short"),
    (("div", ".share"), "ma", "menu"), (("div", ".social", "ul", "li"), "ma", "menu"), (("div", ".tags"), "a", "menu"), (("div", ".author", ".bio"), "a", "prose"),
    (("section", ".comments", "div", ".comment", "p"), "a", "prose"), (("div", ".comments", "p"), "a", "prose"), (("div", ".comments", "ul", "li"), "a", "prose"), (("ol", ".comment", ".list", "li", "p"), "a", "prose"), (("div", ".comments", "article", ".comment", "p"), "a", "prose"), (("section", ".comments", "h2"), "a", "short"), (("div", ".discussion", "p"), "a", "prose"), (("div", ".replies", "div", ".reply", "p"), "a", "prose"),
    (("footer",), "a", "prose"), (("footer", "p"), "a", "prose"), (("div", ".footer"), "a", "short"), (("footer", "ul", "li"), "a", "menu"), (("div", ".copyright"), "a", "short"),
)


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks in an article or main element; None if the page has neither."""
    if not any(b.path.article for b in blocks):
        return None
    return np.array([float(b.path.article and not b.path.other) for b in blocks], np.float32)


def dressed(blocks: list[Block], labels: np.ndarray, rng: np.random.Generator, spare: list[str], paths: Paths) -> tuple[list[Block], np.ndarray]:
    """The page's article in another container, with other furniture around it."""
    body = ("html", "body") + (("div", ".wrapper"),)[0] * int(rng.integers(2))
    wrapper = body + WRAPPERS[int(rng.integers(len(WRAPPERS)))]
    article = []
    for b, y in zip(blocks, labels):
        if y:
            leaf = b.leaf if b.leaf in ("h1", "h2", "h3", "li", "p", "blockquote", "td") else "p"
            path = wrapper + (("ul",) if leaf == "li" else ()) + ((leaf,) if leaf != "p" or rng.random() < 0.9 else ("div",))
            article.append((Block(b.text, paths.of(*path), int(b.linked), path[-1]), 1.0))
    if article and rng.random() < 0.3:  # a list or a link inside the article
        k = int(rng.integers(len(article)))
        words = spare[int(rng.integers(len(spare)))].split()[:12]
        article.insert(k + 1, (Block(" ".join(words) or "a", paths.of(*wrapper, "ul", "li"), 0, "li"), 1.0))
    places: dict[str, list[tuple[Block, float]]] = {"b": [], "m": [], "a": []}
    for n in rng.permutation(len(FURNITURE))[: int(rng.integers(4, 14))]:
        path, where, kind = FURNITURE[n]
        where = where[int(rng.integers(len(where)))]
        inside = where == "m" or rng.random() < 0.25
        for _ in range(int(rng.integers(1, 7)) if kind == "menu" or "omment" in str(path) else 1 + int(rng.integers(2))):
            words = spare[int(rng.integers(len(spare)))].split()
            n_words = {"menu": int(rng.integers(1, 4)), "short": int(rng.integers(1, 8)), "prose": int(rng.integers(4, 60))}[kind]
            text = " ".join(words[:n_words]) or "a"
            full = paths.of(*(wrapper if inside else body), *path)
            places[where].append((Block(text, full, len(text) if kind == "menu" and rng.random() < 0.8 else 0, next((t for t in reversed(path) if t[0] != "."), "div")), 0.0))
    middle = list(article)
    for x in places["m"]:
        middle.insert(int(rng.integers(len(middle) + 1)), x)
    whole = places["b"] + middle + places["a"]
    return [b for b, _ in whole], np.array([y for _, y in whole], np.float32)


def train(pages: list[str], seed: int = 6) -> Labeller:
    """A labeller from the pages' own structure; without a usable page, an untrained one
    is of no use, so the rule of ``weak_labels`` on FURNITURE alone is learned."""
    rng, paths = np.random.default_rng(seed), Paths()
    known = []
    for page in pages:
        blocks = parse(page, paths)
        labels = weak_labels(blocks)
        if labels is not None and 0 < labels.sum():
            known.append((blocks, labels))
    if not known:
        text = "the words of a page are what its reader came for, and they go on for some lines."
        known = [([Block(text, paths.of("html", "body", "article", "p"), 0, "p")] * 6, np.ones(6, np.float32))]
    spare = [b.text for blocks, _ in known for b in blocks if len(b.text) > 20] or ["some words to be read"]
    features = Features()
    xs, ys = [], []
    for blocks, labels in known:
        xs.append(features(blocks))
        ys.append(labels)
        for _ in range(DRESSES):
            b, y = dressed(blocks, labels, rng, spare, paths)
            if b:
                xs.append(features(b))
                ys.append(y)
    model = Labeller.new()
    model.train(xs, ys)
    return model


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Labeller:
    """Train on the sampled pages with the smallest hashes of their ids, ``sample`` at most."""
    rows = few_rows(pages.select("page_id", "html").where(F.octet_length("html") <= SAMPLED_BYTES), "page_id", sample, 3).collect()
    return train([r.html for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id, r.html))])


def _extract(shared):
    def run(batches):
        model: Labeller = shared.value
        features, paths = Features(), Paths()
        for b in batches:
            ids, pages = b.column("page_id"), b.column("html")
            urls = b.column("url")
            for at in range(0, b.num_rows, 256):
                paths.rest()
                parsed = [parse(p, paths) for p in pages[at : at + 256].to_pylist()]
                share = model.predict([features(x) for x in parsed])
                text = ["\n\n".join(x.text for x, s in zip(blocks, p) if s >= 0.5) for blocks, p in zip(parsed, share)]
                yield pa.RecordBatch.from_arrays([ids[at : at + 256], urls[at : at + 256], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the blocks labelled as article, each
    trimmed and with single spaces, joined by an empty line; n_chars counts code points.
    Null and empty pages, and pages without such a block, give an empty text; a share of
    exactly one half counts as article, and an empty table gives an empty one. Repeated
    rows come back repeated; other columns are not read."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
