"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf blocks in order: texts between block tags, with the path of open tags and the words of their
class, id and role. A bidirectional LSTM reads, for each block, a hashed vector of the path, a hashed vector of the words
and a few figures, so that every block is judged in the context of the whole page. Blocks judged main text are joined.

Training needs no labels by hand: at most ``TRAIN_PAGES`` pages, those of least hash, are labelled by the element that
holds a block (article or not), and their texts are also laid out anew, with menus, notices, adverts, forms, sidebars
and comments under the names in use for them, before, inside and after articles under theirs.

Null and empty pages have the empty text. Unclosed and unknown tags, comments and references are read as browsers do;
a tag cut off by the end of the page is dropped. Texts are read whole.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_chunks

TRAIN_PAGES, LAYOUTS, STEPS, BATCH, RATE = 400, 3, 400, 24, 0.01
PATH, WORDS, FIGURES, HIDDEN = 128, 64, 8, 20

# HTML's elements.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style textarea title xmp iframe noframes noembed".split())
NEVER = RAW | frozenset("head noscript template svg math select option button object canvas audio video map".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body div section article main aside nav header footer form td th blockquote".split())
# Names in use for parts of pages.
BOILERPLATE = ("nav", "menu", "navbar", "header", "masthead", "topbar", "footer", "copyright", "legal", "aside", "sidebar", "rail", "widget", "ad", "ads", "advert", "advertisement", "adsbox",
               "banner", "promo", "sponsored", "sponsor", "cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "form",
               "search", "login", "comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "share", "social", "follow", "related", "recommended", "trending", "popular",
               "breadcrumb", "breadcrumbs", "pagination", "pager", "tags", "toolbar", "skip", "dialog", "contentinfo", "navigation", "complementary")
MAIN = ("article", "main", "content", "post", "entry", "story", "body", "text", "page", "articlebody", "maincontent", "blog", "prose", "document")
ELEMENTS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "dialog": "dialog", "sidebar": "aside"}

ASIDE = frozenset("." + n for n in BOILERPLATE) | frozenset(ELEMENTS.values())

_BUCKETS: dict[tuple[str, int], int] = {}


def _bucket(token: str, n: int) -> int:
    got = _BUCKETS.get((token, n))
    if got is None:
        if len(_BUCKETS) > 200_000:
            _BUCKETS.clear()
        got = _BUCKETS[(token, n)] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % n
    return got


def _names(attributes: str) -> list[str]:
    out = []
    for v in ATTRIBUTE.findall(attributes):
        v = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", v.strip("\"'"))
        out += [x for x in re.split(r"[^a-z0-9]+", v.lower()) if x and not x.isdigit()]
    return out


class Path:
    """Open tags of a place in a page, each element a step from the one around it, so that deep pages stay linear.

    ``sums`` counts the hashed tokens of the whole path; ``last`` are its last six tokens, innermost first.
    """

    __slots__ = ("sums", "last", "main", "aside")

    def __init__(self, above: Path | None = None, tokens: tuple[str, ...] = ()):
        self.sums = above.sums.copy() if above else np.zeros(PATH, np.float32)
        for t in tokens:
            self.sums[_bucket(t, PATH)] += 1.0
        self.last = (*reversed(tokens), *(above.last if above else ()))[:6]
        self.main = bool(above and above.main) or any(t in ("article", "main") for t in tokens)
        self.aside = bool(above and above.aside) or any(t in ASIDE for t in tokens)


@dataclass
class Block:
    path: Path
    text: str
    linked: int


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page with their open tags; text under elements that never show text is left out."""
    page = page or ""
    stack: list[tuple[str, Path]] = []
    top = Path()
    out: list[Block] = []
    parts: list[str] = []
    linked, hidden, anchors = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1][1] if stack else top, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text = references.unescape(raw)
            parts.append(text)
            if anchors:
                linked += len(text)

    def pop(to: int) -> None:
        nonlocal hidden, anchors
        for name, _ in stack[to:]:
            hidden -= name in NEVER
            anchors -= name == "a"
            held[name] -= 1
        del stack[to:]

    held: Counter[str] = Counter()  # open elements by name
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1) if held[name] else -1
            if open_at >= 0:
                if any(s[0] not in INLINE for s in stack[open_at:]):
                    flush()
                pop(open_at)
            continue
        if name == "br" or name not in INLINE:
            if name == "br":
                parts.append(" ")
            else:
                flush()
                shut = CLOSES.get(name, ())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] in shut:
                        pop(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
        if name in VOID or m[3].rstrip().endswith("/") and name in ("path", "circle", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((name, Path(stack[-1][1] if stack else top, (name, *("." + x for x in _names(m[3]))))))
        hidden += name in NEVER
        anchors += name == "a"
        held[name] += 1
    flush()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """Path, words and figures of each block."""
    x = np.zeros((len(page), PATH + WORDS + FIGURES), np.float32)
    for i, b in enumerate(page):
        x[i, :PATH] = 0.6 * b.path.sums
        for token in b.path.last:
            x[i, _bucket(token, PATH)] += 0.4
        words = b.text.lower().split()
        for w in words:
            x[i, PATH + _bucket(w, WORDS)] += 1.0
        x[i, PATH:PATH + WORDS] /= np.linalg.norm(x[i, PATH:PATH + WORDS])
        size = len(b.text)
        x[i, PATH + WORDS:] = (np.log1p(size) / 6, b.linked / size, b.text[-1] in ".!?…", len(words) < 5, i / len(page), "©" in b.text, min(len(page), 50) / 50, b.text.count(",") / len(words))
    return np.minimum(x, 3.0)


@dataclass
class Labeller:
    """Weights of one bidirectional layer and of the output."""

    w: dict[str, np.ndarray]

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = False):
        t, b, _ = x.shape
        wx = x @ self.w["x" + side] + self.w["b" + side]
        h, c, hs, trace = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32), np.zeros((t, b, HIDDEN), np.float32), []
        for k in (range(t) if side == "f" else range(t - 1, -1, -1)):
            z = wx[k] + h @ self.w["h" + side]
            i, f, o = (1 / (1 + np.exp(-z[:, j * HIDDEN:(j + 1) * HIDDEN])) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = mask[k][:, None]
            c1 = on * (f * c + i * g) + (1 - on) * c
            tc = np.tanh(c1)
            h1 = on * (o * tc) + (1 - on) * h
            if keep:
                trace.append((k, h, c, i, f, o, g, tc, on))
            h, c = h1, c1
            hs[k] = h
        return hs, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-odds of main text; x is (blocks, pages, features), mask (blocks, pages)."""
        both = np.concatenate([self._run(x, mask, s)[0] for s in "fb"], 2)
        return (both @ self.w["y"] + self.w["c"])[..., 0]

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        hf, tf = self._run(x, mask, "f", True)
        hb, tb = self._run(x, mask, "b", True)
        both = np.concatenate([hf, hb], 2)
        p = 1 / (1 + np.exp(-(both @ self.w["y"] + self.w["c"])[..., 0]))
        d = ((p - y) * mask / mask.sum())[..., None]
        grads = {"y": np.einsum("tbh,tbo->ho", both, d), "c": d.sum((0, 1))}
        up = d @ self.w["y"].T
        for side, trace, part in (("f", tf, up[..., :HIDDEN]), ("b", tb, up[..., HIDDEN:])):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh, nh, nc = np.zeros_like(self.w["h" + side]), 0.0, 0.0
            for k, h, c, i, f, o, g, tc, on in reversed(trace):
                dh = part[k] + nh
                dc = nc + on * dh * o * (1 - tc * tc)
                dz[k] = on * np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                gh += h.T @ dz[k]
                nh = dz[k] @ self.w["h" + side].T + (1 - on) * dh
                nc = on * dc * f + (1 - on) * nc
            grads |= {"x" + side: np.tensordot(x, dz, ((0, 1), (0, 1))), "h" + side: gh, "b" + side: dz.sum((0, 1))}
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((t, len(pages), PATH + WORDS + FIGURES), np.float32), np.zeros((t, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[:len(p), i], mask[:len(p), i] = p, 1
    return x, mask


def like_length(order: list[int], sizes: list[int], most: int = 64, cells: int = 20_000) -> Iterator[list[int]]:
    """Runs of ``order`` (by size) of at most ``most`` pages and, padded to the longest, ``cells`` blocks; a longer page is alone."""
    group: list[int] = []
    for i in order:
        if group and (len(group) == most or (len(group) + 1) * sizes[i] > cells):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def fit(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 5) -> Labeller:
    rng = np.random.default_rng(seed)
    size = PATH + WORDS + FIGURES
    w = {"y": rng.normal(0, 0.1, (2 * HIDDEN, 1)), "c": np.zeros(1)}
    for s in "fb":
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN:2 * HIDDEN] = 1
        w |= {"x" + s: rng.normal(0, 0.1, (size, 4 * HIDDEN)), "h" + s: rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)), "b" + s: bias}
    model = Labeller({k: v.astype(np.float32) for k, v in w.items()})
    pages = [p for p in pages if len(p[1])]
    m, v = {k: np.zeros_like(a) for k, a in model.w.items()}, {k: np.zeros_like(a) for k, a in model.w.items()}
    pages.sort(key=lambda p: len(p[1]))
    for step in range(1, STEPS + 1 if pages else 1):
        # Whole pages of like length, so that a long one does not pad all others: neighbours by length, less of them the longer they are.
        at = int(rng.integers(0, len(pages)))
        near = np.clip(at + rng.integers(-4 * BATCH, 4 * BATCH + 1, BATCH), 0, len(pages) - 1)
        some = [pages[i] for i in near[:max(1, min(BATCH, 20_000 // len(pages[at][1])))]]
        x, mask = padded([p[0] for p in some])
        y = np.zeros_like(mask)
        for i, p in enumerate(some):
            y[:len(p[1]), i] = p[1]
        # Some names are hidden at random, so that no single one decides.
        x[..., :PATH] *= rng.random((x.shape[1], PATH)) > 0.05
        x[..., PATH:PATH + WORDS] *= (rng.random((*x.shape[:2], 1)) > 0.3) * rng.uniform(0, 1.5, (*x.shape[:2], 1))
        for k, g in model.step(x, mask, y).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.w[k] -= (RATE * (1 - step / (STEPS + 1)) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def taught(page: list[Block]) -> np.ndarray | None:
    """1 for blocks in an article or main element and in no part named as boilerplate; None for pages without either."""
    if not any(b.path.main for b in page):
        return None
    return np.array([float(b.path.main and not b.path.aside) for b in page], np.float32)


def laid_out(texts: list[str], others: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page of a random layout: paragraphs of ``texts`` as the article, ``others`` and some of ``texts`` around it."""
    rows: list[Block] = []
    y: list[int] = []
    outer = [(), (".page",), ("div",), ("div", ".wrapper"), ("div", ".container"), ("div", ".site"), ("table", "tr", "td")][rng.integers(7)]
    pick = lambda pool: pool[rng.integers(len(pool))]

    def part(base: tuple) -> None:
        name = pick(BOILERPLATE)
        box = (ELEMENTS[name],) if name in ELEMENTS and rng.random() < 0.6 else (pick(("div", "div", "section", "ul", "p", "aside")), "." + name)
        if rng.random() < 0.3:
            box += ("." + pick(("box", "wrap", "list", "inner", "block", "top", "left", "right", "area")),)
        leaf = pick(((), ("p",), ("ul", "li"), ("ul", "li", "a"), ("div",), ("h2",), ("label",), ("span",)))
        for _ in range(rng.integers(1, 6)):
            text = pick(texts) if rng.random() < 0.5 else pick(others)
            rows.append(Block(Path(tokens=("html", "body", *base, *box, *leaf)), text, len(text) if "a" in leaf else 0))
            y.append(0)

    def article() -> None:
        kind = rng.random()
        name = pick(MAIN)
        box = ("article",) if kind < 0.35 else ("main",) if kind < 0.45 else () if kind < 0.55 else (pick(("div", "section", "main", "article")), "." + name)
        if rng.random() < 0.3:
            box += ("div", "." + pick(MAIN))
        if rng.random() < 0.8:
            rows.append(Block(Path(tokens=("html", "body", *outer, *box, pick(("h1", "h1", "h2")))), " ".join(pick(texts).split()[:12]), 0))
            y.append(1)
        for _ in range(rng.integers(1, 12)):
            text = pick(texts)
            leaf = ("p",) if rng.random() < 0.75 else pick((("ul", "li"), ("blockquote",), ("h2",), ("h3",), ("pre",), ("div",), ("p", "b"), ("table", "tr", "td"), ("ol", "li"), ("figure", "figcaption"), ()))
            if leaf in (("h2",), ("h3",), ("ul", "li")) or rng.random() < 0.15:
                text = " ".join(text.split()[:rng.integers(1, 8)])
            rows.append(Block(Path(tokens=("html", "body", *outer, *box, *leaf)), text, 0))
            y.append(1)
            if rng.random() < 0.08:
                part((*outer, *box))

    for _ in range(rng.integers(0, 4)):
        part(outer if rng.random() < 0.5 else ())
    article()
    for _ in range(rng.integers(0, 5)):
        part(outer if rng.random() < 0.5 else ())
    return rows, np.array(y, np.float32)


def train(pages: DataFrame, seed: int = 3) -> Labeller:
    some = pages.select(F.col("html").cast("string").alias("html")).where("length(html) > 0").orderBy(F.xxhash64("html"), "html").limit(TRAIN_PAGES).collect()
    rng = np.random.default_rng(seed)
    rows, texts, others = [], [], []
    for r in some:
        page = blocks(r["html"])
        y = taught(page)
        if y is not None:
            rows.append((vectors(page), y))
            texts += [b.text for b, k in zip(page, y, strict=True) if k]
            others += [b.text for b, k in zip(page, y, strict=True) if not k]
    if texts and others:
        for _ in range(LAYOUTS * len(some)):
            page, y = laid_out(texts, others, rng)
            rows.append((vectors(page), y))
    return fit(rows)


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept for every row of ``pages(page_id, url, html)``; other columns are ignored.

    A null, empty or tag-only page gives the empty text; repeated pages and pages under null or equal ids give a row each,
    and equal pages equal texts. Deeply nested and very long pages are read whole.
    """
    model = model or train(pages)
    held = pages.sparkSession.sparkContext.broadcast(model.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        for batch in batches:
            for begin, end, htmls in in_chunks(batch, "html"):
                cut = [blocks(h) for h in htmls]
                x = [vectors(b) for b in cut]
                text, kept = [""] * len(cut), [0] * len(cut)
                order = sorted((i for i in range(len(cut)) if cut[i]), key=lambda i: len(cut[i]))
                for group in like_length(order, [len(b) for b in cut]):
                    scores = labeller.scores(*padded([x[i] for i in group]))
                    for j, i in enumerate(group):
                        main = [b.text for b, s in zip(cut[i], scores[:, j], strict=False) if s > 0]
                        text[i], kept[i] = " ".join(main), len(main)
                rows = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
                                                  pa.array([len(b) for b in cut], pa.int64()), pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_kept long")
