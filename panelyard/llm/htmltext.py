"""Main text of web pages: a recurrent labeller over the page's blocks.

A page is cut into leaf blocks at block-level tags. Each block is described by its
tag path with class and id words (hashed vectors, summed), its words (hashed vectors,
averaged) and a few counts. A bidirectional LSTM written in numpy reads the blocks in
page order and labels every one main text or not, with the whole page as context.

The labeller is trained on a bounded sample of the pages themselves. A page's own
structure gives the labels where it is telling (blocks in an article or main element
that no side element holds). Most training pages are composed anew from the sample's
blocks, with and without such elements, among menus, notices, adverts, forms,
sidebars and comments, under many names, so that the labels rest on context.

Whole paths, whole blocks and whole pages count; a page of more than ``CHUNK`` blocks
is described piece by piece, from either end. A line break (br) is white space inside
its block.

Defined results: null and empty html, and pages without main blocks, give an empty
text. Rows are read on their own, repeated and null ids included. Tags may be left
open, mixed in case or cut off. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import portions

PATH, WORDS, COUNTS = 48, 24, 8
HIDDEN = 20
#: The most pages that training reads, and the pages it composes from them.
SAMPLE, COMPOSED = 300, 700
#: Training reads pages of at most so many characters, and of a page so many blocks.
LONGEST, TRAINED = 100_000, 80
#: Blocks that the labeller holds at once.
CHUNK = 8192

# HTML element names.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea head title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|$)", re.S)
_RAW = {name: re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I) for name in ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title")}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
#: Optional end tags: a new element of the key closes an open one of the values.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Step:
    """An open element that blocks lie in: its tag and names, the element around it, and its depth. Blocks share steps, however deep they lie."""

    __slots__ = ("name", "up", "depth", "total", "_main", "_side")

    def __init__(self, name: str, up: Step | None):
        self.name, self.up, self.depth, self.total = name, up, 1 + (up.depth if up else 0), None
        self._main = self._side = None

    def part(self) -> tuple[bool, bool]:
        """Whether it lies in an article or main element, and in one whose names stand for the side; worked out once for each step."""
        line, step = [], self
        while step is not None and step._main is None:
            line.append(step)
            step = step.up
        main, side = (step._main, step._side) if step is not None else (False, False)
        for s in reversed(line):
            s._main = main = main or bool(_MAIN.match(s.name))
            s._side = side = side or bool(_SIDE.search(s.name))
        return main, side


def path_of(names: tuple[str, ...]) -> Step | None:
    step = None
    for n in names:
        step = Step(n, step)
    return step


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Step | None, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks in page order: path of elements (tag and names), text, characters inside links."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, Step | None]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links, depth_a, silent, at = 0, 0, 0, 0

    def close() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(stack[-1][1] if stack else None, text, min(links, len(text))))
            parts.clear()
        links = 0

    def leave(k: int) -> None:
        nonlocal silent
        for name, _ in stack[k:]:
            opened[name] -= 1
            silent -= name in SILENT
        del stack[k:]

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not silent:
            piece = page[at:end]
            parts.append(piece)
            if depth_a:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                close()
            if name == "a":
                depth_a = max(0, depth_a - 1)
            if opened[name]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in _RAW:
            end_tag = _RAW[name].search(page, at)
            at = end_tag.end() if end_tag else n
            if name in BLOCK:
                close()
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            close()
            for open_ in CLOSES.get(name, ()):
                for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                    if stack[k][0] == open_:
                        leave(k)
                        break
                    if stack[k][0] in ("ul", "ol", "table", "dl", "article", "section", "div"):
                        break
            if name in ("body", "article", "main", "nav", "header", "footer", "aside") and stack and stack[-1][0] == "head":
                leave(len(stack) - 1)
        if name == "a":
            depth_a += 1
        if name not in VOID and not m[3].rstrip().endswith("/") and (name in BLOCK or name in SILENT):
            around = stack[-1][1] if stack else None
            named = " ".join(x for g in _NAMED.findall(m[3]) for x in g if x)
            stack.append((name, Step(f"{name} {named}".strip().lower(), around) if name in BLOCK else around))
            opened[name] += 1
            silent += name in SILENT
    close()
    return out


class _Vectors(dict):
    """word -> fixed vector drawn from its hash; forgets everything when large."""

    def __init__(self, size: int, salt: int):
        super().__init__()
        self.size, self.salt = size, salt

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) > 100_000:
            self.clear()
        bits = np.frombuffer(b"".join(xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"), seed=self.salt + k) for k in range(-(-self.size // 128))), np.uint8)
        self[word] = v = np.unpackbits(bits)[: self.size].astype(np.float32) * 2 - 1
        return v


#: Words hashed at a time.
HASHED = 1 << 16
_SEEDS = [9 + k for k in range(-(-WORDS // 128))]


def word_sums(lines: list[list[str]]) -> np.ndarray:
    """The sum of the fixed vectors of each line's words: a word's bits come from its hash, a set one counts 1 and another -1."""
    out = np.zeros((len(lines), WORDS), np.float32)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    words = [w.encode("utf-8", "surrogatepass") for x in lines for w in x]
    for a in range(0, len(words), HASHED):
        part, own = words[a : a + HASHED], owner[a : a + HASHED]
        digests = [np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, seed=k) for w in part]), np.uint8).reshape(len(part), 16) for k in _SEEDS]
        bits = np.unpackbits(np.concatenate(digests, axis=1), axis=1)[:, :WORDS]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        count = np.diff(np.append(first, len(own)))
        out[own[first]] += 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) - count[:, None]
    return out


class Describer:
    def __init__(self) -> None:
        self.paths, self.names = _Vectors(PATH, 1), {}

    def name(self, name: str) -> np.ndarray:
        found = self.names.get(name)
        if found is None:
            if len(self.names) > 50_000:
                self.names.clear()
            self.names[name] = found = np.add.reduce([self.paths[w] for w in re.split(r"[\s_\-]+", name)])
        return found

    def total(self, step: Step | None) -> np.ndarray:
        """The sum over a whole path; steps keep theirs, so each is added once."""
        line = []
        while step is not None and step.total is None:
            line.append(step)
            step = step.up
        sum_ = step.total if step is not None else np.zeros(PATH, np.float32)
        for s in reversed(line):
            s.total = sum_ = sum_ + self.name(s.name)
        return sum_

    def path(self, step: Step | None) -> np.ndarray:
        """The two innermost elements in full, those around them at six tenths, or as six of them if they are more."""
        if step is None:
            return np.zeros(PATH, np.float32)
        outer = step.up.up if step.up else None
        around = self.total(outer)
        return (self.total(step) - around + 0.6 * around * min(1.0, 6 / outer.depth if outer else 1.0)) / 2

    def __call__(self, page: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
        """One row for each block from ``start`` to ``stop``."""
        own = page[start:stop]
        out = np.zeros((len(own), PATH + WORDS + COUNTS), np.float32)
        lines = [b.text.lower().split() for b in own]
        out[:, PATH : PATH + WORDS] = word_sums(lines) / np.array([max(len(x), 1) ** 0.5 for x in lines], np.float32)[:, None] / np.float32(3)
        for k, (b, found) in enumerate(zip(own, lines, strict=True)):
            n = len(b.text)
            out[k, :PATH] = self.path(b.path)
            marks = sum(b.text.count(c) for c in ".!?") / len(found) if found else 0
            depth = min(b.path.depth if b.path else 0, 16)
            out[k, PATH + WORDS :] = (np.log1p(n) / 4, b.linked / n, np.log1p(len(found)) / 3, marks, sum(map(str.isupper, b.text)) / n, (start + k) / len(page), depth / 8, 1.0)
        return out


class Labeller:
    """Two LSTMs, one from either end, and a logistic layer over both."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = PATH + WORDS + COUNTS
        self.p = {}
        for way in "fb":
            self.p["x" + way] = r.normal(0, d**-0.5, (d, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + way] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p["c" + way] = bias
        self.p["o"] = r.normal(0, 0.1, (2 * HIDDEN + d,)).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])

    def _run(self, way: str, x: np.ndarray, on: np.ndarray, keep: bool, before: tuple | None = None):
        """(states, what the gradient needs, last state) from x: (pages, blocks, inputs); on: which blocks a page has; before: the state to start from."""
        b, t, _ = x.shape
        pre = x @ self.p["x" + way] + self.p["c" + way]
        h, c = before or (np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32))
        out, memory = np.zeros((b, t, HIDDEN), np.float32), []
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            i, f, o, g = self._gates(pre[:, k] + h @ self.p["h" + way])
            live = on[:, k, None]
            fresh = f * c + i * g
            if keep:
                memory.append((k, i, f, o, g, c, fresh, h))
            c = np.where(live, fresh, c)
            h = np.where(live, o * np.tanh(fresh), h)
            out[:, k] = h
        return out, memory, (h, c)

    def of_long_page(self, page: list[Block], describe: Describer, chunk: int = CHUNK) -> np.ndarray:
        """The margins of one page, ``chunk`` blocks at a time, forwards and then backwards."""
        out = np.full(len(page), self.p["ob"][0], np.float64)
        parts = [(a, min(a + chunk, len(page))) for a in range(0, len(page), chunk)]
        for n, way in enumerate("fb"):
            state = None
            for a, b in parts if way == "f" else parts[::-1]:
                x = describe(page, a, b)
                states, _, state = self._run(way, x[None], np.ones((1, b - a), bool), False, state)
                out[a:b] += states[0] @ self.p["o"][n * HIDDEN : (n + 1) * HIDDEN] + (x @ self.p["o"][2 * HIDDEN :] if way == "f" else 0)
        return out

    def margins(self, x: np.ndarray, on: np.ndarray) -> np.ndarray:
        both = [self._run(way, x, on, False)[0] for way in "fb"]
        return np.concatenate([*both, x], axis=2) @ self.p["o"] + self.p["ob"]

    def gradient(self, x: np.ndarray, on: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {way: self._run(way, x, on, True) for way in "fb"}
        top = np.concatenate([runs["f"][0], runs["b"][0], x], axis=2)
        z = top @ self.p["o"] + self.p["ob"]
        d = np.where(on, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0) / on.sum()
        g = {"o": np.einsum("bt,btk->k", d, top), "ob": np.array([d.sum()])}
        for n, way in enumerate("fb"):
            out_d = d[:, :, None] * self.p["o"][n * HIDDEN : (n + 1) * HIDDEN]
            gx, gh, gc = np.zeros_like(self.p["x" + way]), np.zeros_like(self.p["h" + way]), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for k, i, f, o, cand, before, fresh, h in reversed(runs[way][1]):
                live = on[:, k, None]
                dh = dh + out_d[:, k]
                tc = np.tanh(fresh)
                do, dfresh = dh * tc, dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dfresh * cand * i * (1 - i), dfresh * before * f * (1 - f), do * o * (1 - o), dfresh * i * (1 - cand * cand)], axis=1) * live
                gx += x[:, k].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dh = np.where(live, dz @ self.p["h" + way].T, dh)
                dc = np.where(live, dfresh * f, dc)
            g["x" + way], g["h" + way], g["c" + way] = gx, gh, gc
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 25, rate: float = 0.01) -> None:
        r = np.random.default_rng(5)
        m = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        v = {k: np.zeros_like(x, np.float64) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = sorted(r.permutation(len(pages)), key=lambda k: len(pages[k][1]) // 8)
            groups = [order[k : k + batch] for k in range(0, len(order), batch)]
            for k in r.permutation(len(groups)):
                x, on, y = padded([pages[i] for i in groups[k]])
                step += 1
                for name, grad in self.gradient(x, on, y).items():
                    grad = np.clip(grad, -0.5, 0.5)
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.999 * v[name] + 0.001 * grad * grad
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(y) for _, y in pages)
    x, on, out = np.zeros((len(pages), t, PATH + WORDS + COUNTS), np.float32), np.zeros((len(pages), t), bool), np.zeros((len(pages), t))
    for k, (a, y) in enumerate(pages):
        x[k, : len(y)], on[k, : len(y)], out[k, : len(y)] = a, True, y
    return x, on, out


_MAIN = re.compile(r"(article|main)\b")
_SIDE = re.compile(r"^(nav|footer|header|aside|form|menu|button|select|dialog)\b|\b(ads?|advert\w*|promo\w*|sponsor\w*|comments?|replies|cookie\w*|consent|notice|banner|newsletter|subscribe|share|social|related|sidebar|breadcrumbs?|widget|popup|modal)\b")


def own_labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks of an article or main element outside side elements; None if the page has no such element."""
    parts = [b.path.part() if b.path else (False, False) for b in page]
    if not any(main for main, _ in parts):
        return None
    return np.array([float(main and not side) for main, side in parts])


# Names that pages give to their parts, for composed pages.
_MAIN_NAMES = "content post-content entry-content article-body story-body main-content post article text body-text entry page-content".split()
_SIDE_NAMES = {
    "menu": "nav menu navigation navbar topnav site-nav breadcrumb".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot".split(),
    "notice": "cookie-notice cookie-banner notice consent alert gdpr banner".split(),
    "sidebar": "sidebar side related widget aside recommended most-read".split(),
    "comments": "comments comment comment-list discussion responses replies".split(),
    "form": "newsletter subscribe signup search login contact-form".split(),
    "header": "header site-header masthead top branding".split(),
    "footer": "footer site-footer bottom copyright legal".split(),
}


def compose(r: random.Random, main: list[str], side: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page made of main and side texts under names drawn at random, with labels."""
    frame = [("html",), ("html", "body"), ("html", "body", "div wrapper"), ("html", "body", "div page", "div container")][r.randrange(4)]
    frame = ("html", "body", *frame[2:])
    blocks_: list[Block] = []
    labels: list[float] = []

    def put(path: tuple[str, ...], text: str, linked: bool, y: float) -> None:
        if text:
            blocks_.append(Block(path_of((*frame, *path)), text, len(text) if linked else 0))
            labels.append(y)

    def some(texts: list[str], words: int) -> str:
        found = r.choice(texts).split()
        at = r.randrange(max(1, len(found) - words))
        return " ".join(found[at : at + r.randint(1, words)])

    def part(kind: str) -> None:
        tag = {"menu": "nav", "sidebar": "aside", "header": "header", "footer": "footer", "comments": "section", "form": "form"}.get(kind, "div")
        name = r.choice(_SIDE_NAMES[kind])
        use = tag if r.random() < 0.5 else "div"
        own = f"{use} {name}" if use == "div" or r.random() < 0.5 else use
        if kind in ("menu", "sidebar", "header"):
            for _ in range(r.randint(1, 8)):
                put((own, "ul", "li") if r.random() < 0.7 else (own,), some(side, 5), r.random() < 0.85, 0.0)
        elif kind == "comments":
            for _ in range(r.randint(1, 6)):
                inner = (own, f"div {r.choice(['comment', 'comment-body', 'reply'])}")
                put((*inner, "p"), some(main, 40), False, 0.0)
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                put((own, r.choice(["p", "button", "label", "div"])), some(side, 8), False, 0.0)
        else:
            for _ in range(r.randint(1, 3)):
                put((own, "p") if r.random() < 0.5 else (own,), some(side, 25), r.random() < 0.2, 0.0)

    for kind in r.sample(["menu", "header", "notice", "ad"], r.randint(1, 4)):
        part(kind)
    tag = r.choice(["article", "main", "article", "div", "div", "section"])
    own = f"{tag} {r.choice(_MAIN_NAMES)}" if tag in ("div", "section") or r.random() < 0.4 else tag
    inner = (own,) if r.random() < 0.6 else (own, f"div {r.choice(_MAIN_NAMES)}")
    if r.random() < 0.8:
        put((*inner, r.choice(["h1", "h2"])), some(main, 10), False, 1.0)
    for k, text in enumerate(main):
        leaf = r.choices(["p", "p p", "li", "blockquote", "h2", "", "pre", "td"], [12, 1, 1, 1, 1, 2, 0.5, 0.5])[0]
        put((*inner, *leaf.split()), text, False, 1.0)
        if r.random() < 0.08 and k + 1 < len(main):
            frame, kept = (*frame, *inner), frame
            part(r.choice(["ad", "sidebar", "form", "notice"]))
            frame = kept
    for kind in r.sample(["comments", "sidebar", "ad", "form", "footer", "footer"], r.randint(1, 5)):
        part(kind)
    return blocks_, np.array(labels)


def learn(pages: list[list[Block]], composed: int = COMPOSED) -> Labeller:
    """Train on pages with telling structure and on pages composed of their blocks."""
    r = random.Random(23)
    describe, model = Describer(), Labeller()
    examples, main, side = [], [], []
    for page in pages:
        y = own_labels(page)
        if y is not None and 0 < y.sum() < len(y):
            examples.append((describe(page[:TRAINED]), y[:TRAINED]))
            main.append([b.text for b, v in zip(page, y, strict=True) if v])
            side += [b.text for b, v in zip(page, y, strict=True) if not v]
    if not main:
        main = [["This text stands for the body of a page.", "A second paragraph follows it, longer than the first one."]]
    side = side or ["Home", "About us", "Contact", "All rights reserved"]
    for _ in range(composed):
        own = r.choice(main)
        at = r.randrange(len(own))
        page, y = compose(r, own[at : at + r.randint(1, 14)], side)
        if len(y):
            examples.append((describe(page[:TRAINED]), y[:TRAINED]))
    model.train(examples)
    return model


def extract(pages: list[list[Block]], model: Labeller, describe: Describer) -> list[str]:
    """The main blocks of each page; pages of like length go through the labeller together, at most ``CHUNK`` blocks, the filling up to the longest page included."""
    out = [""] * len(pages)
    chosen = lambda k, z: "\n".join(b.text for b, m in zip(pages[k], z, strict=False) if m > 0)
    group: list[int] = []
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    for at, k in enumerate(order):
        if len(pages[k]) > CHUNK:
            out[k] = chosen(k, model.of_long_page(pages[k], describe))
            continue
        group.append(k)
        if at + 1 == len(order) or len(group) == 64 or (len(group) + 1) * len(pages[order[at + 1]]) > CHUNK:
            x, on, _ = padded([(describe(pages[j]), np.zeros(len(pages[j]))) for j in group])
            for j, z in zip(group, model.margins(x, on), strict=True):
                out[j] = chosen(j, z)
            group = []
    return out


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, describe = shared.value, Describer()
        for batch in batches:
            found = batch.column(2).to_pylist()
            texts: list[str] = []
            for part in portions(found):
                texts += extract([blocks(h) for h in found[part]], model, describe)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Learns from at most ``sample`` pages of at most ``LONGEST`` characters."""
    short = pages.select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h"), F.xxhash64(id_col).alias("i")).where(F.length("html") <= LONGEST)
    model = learn([blocks(h) for h in short.orderBy("i", "h").select("html").limit(sample).toArrow().column(0).to_pylist()])
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(model)), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
