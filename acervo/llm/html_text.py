"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks of text.  Each block becomes a vector of its hashed tag
path, its hashed words and a few proportions; a bidirectional LSTM in numpy reads
the whole page's sequence, so every block is judged by what stands before and after it.

The labeller is trained where it is used: on at most `max_pages` pages (the bound
of the sample, chosen by a hash of the page) whose own structure tells blocks
apart (article or main against nav, footer, asides and the like).  Containers are
renamed at random while training, so no single tag name decides.

Defined results: null or empty html has no text; without a page to learn from, the
structural hints decide; repeated rows give repeated results; an empty table gives an
empty result; other columns pass through, and a text column whose name is taken ends in
an underscore.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import free, small_batches

#: A quote opens a value behind an equals sign alone, anywhere else (or without its fellow) it is a character like others.
ATTRIBUTES = r"""(?:[^>=]++|=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+')?+)*+"""
#: Comments, elements without text, declarations, tags; what the page's end cuts off is consumed whole, so nothing is read twice.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|title|svg)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({ATTRIBUTES})(?:>|(\Z))", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>]+)""", re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same kind.
SELF_CLOSING = {"p": "p", "li": "li", "tr": "tr", "td": "td", "th": "td", "dt": "dt", "dd": "dd", "option": "option"}
#: Structural hints used as training labels.
BOILERPLATE = frozenset("nav header footer aside form button menu ad ads advert advertisement banner cookie cookies notice sidebar comment comments related share social promo sponsor sponsored subscribe newsletter breadcrumb breadcrumbs popup modal login search".split())
CONTENT = frozenset("article main content post entry story body-text".split())
PATH_SLOTS, WORD_SLOTS, HIDDEN = 64, 32, 16
MAX_PAGES = 300
#: Blocks, with the padding, that are labelled together; a longer page is labelled alone.
CELLS = 40_000


class Path:
    """The tags around a block and their class, id and role names, from the root; it shares what its parent has."""

    __slots__ = ("above", "names", "size", "slots", "boilerplate", "content")

    def __init__(self, above: Path | None = None, names: tuple[str, ...] = ()):
        self.above, self.names = above, names
        self.size = len(names) + (above.size if above else 0)
        self.slots = above.slots.copy() if above else np.zeros(PATH_SLOTS, np.float32)
        for name in names:
            self.slots[crc32(name.encode()) % PATH_SLOTS] += 1
        self.boilerplate = bool(above and above.boilerplate) or not BOILERPLATE.isdisjoint(names)
        self.content = bool(above and above.content) or not CONTENT.isdisjoint(names)

    def __iter__(self) -> Iterator[str]:
        levels, at = [], self
        while at:
            levels.append(at.names)
            at = at.above
        return (name for names in reversed(levels) for name in names)


#: Elements beyond which a start tag closes nothing.
BARRIERS = ("div", "ul", "ol", "table", "article", "section")


def blocks(page: str | None) -> list[tuple[Path, str, int]]:
    """(path, text, link characters) of every leaf block, in page order."""
    page = page or ""
    stack: list[tuple[str, Path]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where a tag is open
    root, out, piece, linked, at = Path(), [], [], 0, 0

    def add(raw: str):
        nonlocal linked
        if raw:
            piece.append(raw)
            if places["a"]:
                linked += len(raw.strip())

    def flush():
        nonlocal piece, linked
        text = " ".join(html.unescape("".join(piece)).split()) if piece else ""
        if text:
            out.append((stack[-1][1] if stack else root, text, linked))
        piece, linked = [], 0

    def close(tag: str, beyond: int = -1):
        if places[tag] and (i := places[tag][-1]) > beyond:
            for t, _ in stack[i:]:
                places[t].pop()
            del stack[i:]

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[5] is not None:  # no tag after all
            add(m[0])
        if m[3] is None or m[5] is not None:
            continue
        tag = m[3].lower()
        if tag not in INLINE:
            flush()
        if m[2]:
            close(tag)
        elif tag not in VOID:
            if tag in SELF_CLOSING:
                close(SELF_CLOSING[tag], max((places[t][-1] for t in BARRIERS if places[t]), default=-1))
            names = (tag, *[n.lower() for x in NAMES.findall(m[4] or "") for n in re.split(r"[\s_-]+", x) if n])
            places[tag].append(len(stack))
            stack.append((tag, Path(stack[-1][1] if stack else root, names)))
    add(page[at:])
    flush()
    return out


def hint(path: Path) -> int | None:
    """1 for content, 0 for boilerplate, None where the structure does not tell."""
    return 0 if path.boilerplate else 1 if path.content else None


def vectors(page: list[tuple[Path, str, int]]) -> np.ndarray:
    x = np.zeros((len(page), PATH_SLOTS + WORD_SLOTS + 6), np.float32)
    for row, (path, text, linked) in zip(x, page):
        row[:PATH_SLOTS] = path.slots
        w = text.lower().encode().split()
        row[PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = np.bincount(np.fromiter(map(crc32, w), np.int64, len(w)) % WORD_SLOTS, minlength=WORD_SLOTS) / np.sqrt(len(w) * 4)
        n = len(text)
        row[-6:] = (np.log1p(n) / 5, min(1.0, linked / n), np.log1p(len(w)) / 4, sum(text.count(c) for c in ".,;") * 8 / n, text.endswith((".", "!", "?")), path.size / 8)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Bidirectional LSTM over blocks, then a logistic unit on both states."""

    def __init__(self, inputs: int = PATH_SLOTS + WORD_SLOTS + 6, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": draw(inputs, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1  # remember at first
        self.p |= {"out": draw(2 * hidden, 1), "bias": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x [steps, pages, inputs] in reading direction; padded steps leave the state as it is."""
        n, k = self.hidden, self.p[f"h{d}"]
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, memory = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            a = z[t] + h @ k
            gates = _sigmoid(a)
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 3 * n :]
            g = np.tanh(a[:, 2 * n : 3 * n])
            m = mask[t][:, None]
            new = f * c + i * g
            s = np.tanh(new)
            if keep:
                memory.append((h, c, i, f, g, o, s))
            c, h = np.where(m, new, c), np.where(m, o * s, h)
            out[t] = h
        return out, memory

    def _back(self, x, mask, d, memory, grad, into):
        n, k = self.hidden, self.p[f"h{d}"]
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        dz = np.zeros((*x.shape[:2], 4 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, g, o, s = memory[t]
            m = mask[t][:, None]
            dh = dh + grad[t]
            dn = np.where(m, dc + dh * o * (1 - s * s), 0)
            z = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), dn * i * (1 - g * g), np.where(m, dh * s, 0) * o * (1 - o)], axis=1)
            dz[t] = z
            into[f"h{d}"] += h.T @ z
            dc = np.where(m, dn * f, dc)
            dh = np.where(m, z @ k.T, dh)
        flat = dz.reshape(-1, 4 * n)
        into[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        into[f"c{d}"] += flat.sum(0)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of content for each block; x [steps, pages, inputs], mask marks the real blocks."""
        f, _ = self._run(x, mask, "f", False)
        b, _ = self._run(x[::-1], mask[::-1], "b", False)
        return _sigmoid(np.concatenate([f, b[::-1]], axis=2) @ self.p["out"] + self.p["bias"])[..., 0]

    def train(self, pages: list[list], epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 5):
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = [pages[j] for j in order[at : at + batch]]
                x, mask = padded([vectors(renamed(p, rng)) for p in some])
                y, w = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
                for j, p in enumerate(some):
                    for t, (path, _, _) in enumerate(p):
                        if (label := hint(path)) is not None:
                            y[t, j], w[t, j] = label, 1
                f, mf = self._run(x, mask, "f", True)
                b, mb = self._run(x[::-1], mask[::-1], "b", True)
                both = np.concatenate([f, b[::-1]], axis=2)
                dz = ((_sigmoid((both @ self.p["out"] + self.p["bias"])[..., 0]) - y) * w / max(1, w.sum()))[..., None]
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                g["out"] = both.reshape(-1, both.shape[2]).T @ dz.reshape(-1, 1)
                g["bias"] = dz.sum((0, 1))
                d = dz @ self.p["out"].T
                self._back(x, mask, "f", mf, d[..., : self.hidden], g)
                self._back(x[::-1], mask[::-1], "b", mb, d[::-1, :, self.hidden :], g)
                step += 1
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def renamed(page: list, rng) -> list:
    """The page with its containers under other names of the same kind, or under plain ones."""
    swap: dict[str, str] = {}
    choice = {0: sorted(BOILERPLATE), 1: sorted(CONTENT)}
    for path, _, _ in page:
        for name in path:
            if name not in swap and (name in BOILERPLATE or name in CONTENT):
                r = rng.random()
                same = choice[int(name in CONTENT)]
                swap[name] = name if r < 0.5 else same[rng.integers(len(same))] if r < 0.8 else "div"
    return [(Path(None, tuple(swap.get(n, n) for n in path)), text, linked) for path, text, linked in page]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


def train(pages: DataFrame, *, html_col="html", max_pages: int = MAX_PAGES) -> Labeller | None:
    """A labeller fitted on at most max_pages pages; None if none of them shows both kinds of blocks."""
    own = pages.select(F.col(html_col).cast("string").alias("h")).filter("length(h) > 0").withColumn("k", F.xxhash64("h"))
    # the sample's keys first: a task then sends keys, and only the chosen pages travel whole
    keys = [r.k for r in own.select("k").distinct().orderBy("k").limit(max_pages).collect()]
    rows = own.filter(F.col("k") <= keys[-1]).dropDuplicates(["k"]).collect() if keys else []
    known = [b for b in (blocks(r.h) for r in rows) if {0, 1} <= {hint(path) for path, _, _ in b}]
    return Labeller().train(known) if known else None


def batches_of(sizes: list[int], cells: int = CELLS) -> Iterator[list[int]]:
    """Indexes of the sizes over 0, smallest first, in batches that padding to the largest keeps within `cells`."""
    own: list[int] = []
    for i in sorted((i for i, n in enumerate(sizes) if n), key=lambda i: sizes[i]):
        if own and (len(own) + 1) * sizes[i] > cells:
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def texts(model: Labeller | None, pages: list[str | None]) -> list[str]:
    """Main text of each page."""
    cut = [blocks(p) for p in pages]
    out = [""] * len(pages)
    for some in batches_of([len(c) for c in cut]):
        if model is None:
            for i in some:
                out[i] = " ".join(t for path, t, _ in cut[i] if hint(path) != 0)
            continue
        x, mask = padded([vectors(cut[i]) for i in some])
        good = model.scores(x, mask) >= 0.5
        for j, i in enumerate(some):
            out[i] = " ".join(t for (_, t, _), g in zip(cut[i], good[:, j]) if g)
    return out


def extract(pages: DataFrame, model: Labeller | None, *, html_col="html", out_col="text") -> DataFrame:
    """pages with the main text of each whole page in out_col."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series(texts(model, [h if isinstance(h, str) else None for h in htmls]), dtype=object)

    return pages.withColumn(free(pages, out_col)[0], run(F.col(html_col).cast("string")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
