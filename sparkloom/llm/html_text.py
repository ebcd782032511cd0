"""Main text of web pages by a recurrent block labeller.

A tolerant scanner turns a page into its leaf blocks: runs of text between block-level tags, each with its tag path. A
bidirectional LSTM in numpy reads the blocks of the whole document in page order, each as hashed vectors of its tag path and its words
and a few numbers, and labels every block as main text or not. It is trained here, on generated pages of many layouts
whose labels are known; no page of the input is needed for that.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.words import chunks

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 64, 24, 6, 16
TRAIN_PAGES, EPOCHS, BATCH = 900, 12, 30
SEED = 7

# Elements of HTML by how text flows through them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and elements whose content is markup that isn't shown as text.
RAW = frozenset("script style iframe textarea title".split())
MUTED = frozenset("template svg select option canvas audio video".split())
#: Inside these of an svg element HTML may go on; elsewhere an HTML tag ends the svg element.
FOREIGN = frozenset("foreignobject desc".split())
HTML = frozenset("article aside blockquote body br center dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr img li main nav ol p pre section table ul".split())

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PIECE = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Path:
    """An open element that isn't inline, linked to the one around it; blocks share these. ``total``: the summed vectors of it and all around it."""

    __slots__ = ("parent", "entry", "total")

    def __init__(self, parent: Path | None, entry: str):
        self.parent, self.entry, self.total = parent, entry, None


class Block:
    """A run of text in an element (a Path, its entries from the outermost on, or none), and how many of its characters are in links."""

    __slots__ = ("element", "text", "linked")

    def __init__(self, path: Path | tuple[str, ...] | None, text: str, linked: int):
        self.text, self.linked = text, linked
        self.element = reduce(Path, path, None) if isinstance(path, tuple) else path

    @property
    def path(self) -> tuple[str, ...]:
        out, node = [], self.element
        while node is not None:
            out.append(node.entry)
            node = node.parent
        return tuple(reversed(out))


class _Open:
    """The open elements, and where in the stack those of each tag, of inline, muted and foreign tags are, so that no step looks through the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Path | None]] = []  # tag, innermost path
        self.places: dict[str, list[int]] = {}
        self.whole: list[int] = []  # not inline
        self.special: list[int] = []  # muted or foreign
        self.muted = 0

    def push(self, tag: str, entry: str) -> None:
        at, around = len(self.stack), self.path()
        self.stack.append((tag, around if tag in INLINE else Path(around, entry)))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.whole.append(at)
        if tag in MUTED or tag in FOREIGN:
            self.special.append(at)
            self.muted += tag in MUTED

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.places[tag].pop()
        if tag not in INLINE:
            self.whole.pop()
        if tag in MUTED or tag in FOREIGN:
            self.special.pop()
            self.muted -= tag in MUTED
        return tag

    def pop_to(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def path(self) -> Path | None:
        return self.stack[-1][1] if self.stack else None

    def top(self) -> str | None:
        return self.stack[-1][0] if self.stack else None

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def has_inline(self, tag: str) -> bool:
        """Whether an inline element is open inside the innermost block."""
        return self.has(tag) and self.places[tag][-1] > (self.whole[-1] if self.whole else -1)

    def inside(self) -> str | None:
        return self.stack[self.special[-1]][0] if self.special else None


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. Unclosed and stray tags are closed as browsers do, roughly; scripts, styles, forms' values, drawings, media and the title give none.

    What isn't shown ends at its close tag or its parent's, or at once if it's closed by itself or never. Time and memory
    grow with the page's length, however deep elements are nested.
    """
    out: list[Block] = []
    open_ = _Open()
    text: list[str] = []
    at, linked = 0, 0
    seen: dict[str, tuple[int, int]] = {}

    def found(pattern: str) -> tuple[int, int]:
        """Where the next match starts and ends, the page's length if there's none."""
        if seen.get(pattern, (-1, -1))[0] < at:
            m = re.compile(pattern, re.IGNORECASE).search(page, at)
            seen[pattern] = m.span() if m else (len(page), len(page))
        return seen[pattern]

    def ahead(start: str) -> int:
        """Where the next tag that begins so is."""
        return found(rf"<{re.escape(start)}(?=[\s/>])")[0]

    def flush() -> None:
        nonlocal linked
        body = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if body:
            out.append(Block(open_.path(), body, min(linked, len(body))))
        text.clear()
        linked = 0

    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not open_.muted:
            text.append(piece)
            if open_.has("a"):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if name not in INLINE:
                flush()
            if open_.has_inline(name) if name in INLINE else open_.has(name):
                open_.pop_to(name)
            continue
        if name in RAW:
            flush()
            if rest.endswith("/") and ahead(name) <= ahead("/" + name):  # closed by itself, if no close tag of its own follows
                continue
            start, end = found(rf"</{re.escape(name)}\s*>")
            at = end if start < len(page) or name in ("script", "style") else at
            continue
        inside = open_.inside()
        if inside == "svg" and name in HTML or inside == "option" and name not in INLINE and not open_.has("select"):
            open_.pop_to(inside)
            inside = None
        if name in MUTED:
            flush()
            if inside == name == "option":
                open_.pop_to(name)
            # option ends by itself, svg and template may hold their like, another one is unclosed if its like opens first
            end = ahead("/" + name)
            if rest.endswith("/") or name != "option" and (end == len(page) or name not in ("svg", "template") and ahead(name) < end):
                continue
        elif name not in INLINE and not open_.muted:
            flush()
            while open_.stack and (open_.top() in INLINE or open_.top() == "p" or open_.top() == name == "li"):
                open_.pop()
        if name not in VOID and not rest.endswith("/"):
            entry = name
            for named in _NAMED.findall(rest):
                entry += "".join("." + x.lower() for x in _PIECE.findall("".join(named)))
            open_.push(name, entry)
    flush()
    return out


@lru_cache(maxsize=100_000)
def _hashed(key: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(key.encode("utf-8", "surrogatepass"))
    return h % dim, 1.0 if h >> 31 else -1.0


@lru_cache(maxsize=2_000)
def _entry_vector(entry: str, innermost: bool) -> np.ndarray:
    v = np.zeros(PATH_DIM)
    for k, part in enumerate(entry.split(".")):
        at, sign = _hashed(f"0:{part}" if innermost else f"c:{part}" if k else f"t:{part}", PATH_DIM)
        v[at] += sign
    return v


def _path_vector(path: Path | None) -> np.ndarray:
    """All entries of a path, summed, and the innermost one once more by itself. Sums are whole numbers, kept with the elements."""
    if path is None:
        return np.zeros(PATH_DIM)
    chain, node = [], path
    while node is not None and node.total is None:
        chain.append(node)
        node = node.parent
    total = node.total if node is not None else np.zeros(PATH_DIM, np.float32)
    for node in reversed(chain):
        total = node.total = (total + _entry_vector(node.entry, False)).astype(np.float32)
    return total + _entry_vector(path.entry, True)


def vectors(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), PATH_DIM + WORD_DIM + NUMBERS))
    for k, b in enumerate(found):
        out[k, :PATH_DIM] = _path_vector(b.element)
        words = b.text.lower().split()
        for w in words:
            at, sign = _hashed(w.strip(".,;:!?"), WORD_DIM)
            out[k, PATH_DIM + at] += sign / (len(words) + 3)
        n = len(b.text)
        out[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(n) / 6, b.linked / n, min(1.0, sum(map(b.text.count, ".,;")) / max(1, n / 40)) / 2, k / len(found), (k + 1) / len(found), "©" in b.text
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """Two LSTMs over padded batches, one in each direction, and a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + NUMBERS
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN))
            self.p["h" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["o"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN)
        self.p["b"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c, out, tape = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, steps, HIDDEN)), []
        xs = x @ self.p["x" + d] + self.p["c" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = xs[:, t] + h @ self.p["h" + d]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c1 = (f * c + i * g) * m  # padding, at the end, leaves the state at zero in either direction
            s = np.tanh(c1)
            if keep:
                tape.append((t, i, f, o, g, c, h, s, m))
            c, h = c1, o * s * m
            out[:, t] = h
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["b"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        err = (_sigmoid(both @ self.p["o"] + self.p["b"]) - y) * mask / mask.sum()
        grad = {"o": np.einsum("nt,nth->h", err, both), "b": np.array([err.sum()])}
        for k, d in enumerate("fb"):
            up = err[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh, dc, gh = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN)), np.zeros_like(self.p["h" + d])
            for t, i, f, o, g, c0, h0, s, m in reversed(runs[d][1]):
                total = (up[:, t] + dh) * m
                dc = (dc + total * o * (1 - s * s)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), total * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                gh += h0.T @ dz
                dh, dc = dz @ self.p["h" + d].T, dc * f
            grad |= {"x" + d: np.einsum("ntk,ntz->kz", x, dz_all, optimize=True), "h" + d: gh, "c" + d: dz_all.sum((0, 1))}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over shuffled batches; pages: vectors and labels of the blocks of each."""
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                part = [pages[k] for k in order[at : at + BATCH]]
                x, mask = padded([v for v, _ in part])
                y = np.zeros(mask.shape)
                for k, (_, labels) in enumerate(part):
                    y[k, : len(labels)] = labels
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = 0.02 * (1 - epoch / epochs)
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask = np.zeros((len(xs), steps, xs[0].shape[1])), np.zeros((len(xs), steps))
    for k, v in enumerate(xs):
        x[k, : len(v)], mask[k, : len(v)] = v, 1
    return x, mask


def generated(rng: np.random.Generator) -> str:
    """A page of a random layout; blocks of main text begin with the mark U+0001."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    chance = lambda p: rng.random() < p

    def sentence(a: int = 3, b: int = 16) -> str:
        text = words(a, b).capitalize() + pick(".", ".", "!", "?", ",", "")
        return text if chance(0.8) else re.sub(" ", pick(" | ", "!! ", "%%% ", "&amp;&amp; ", " "), text)

    def prose(main: bool) -> str:
        return "\x01" * main + (words(1, 5) if chance(0.2) else " ".join(sentence() for _ in range(rng.integers(1, 6))))

    def links(n: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>" if chance(0.8) else re.sub("</?li>", " ", items)

    def boiler(kind: str) -> str:
        tag, cls = {
            "nav": pick(("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "navbar navigation"), ("nav", "breadcrumb")),
            "header": pick(("header", ""), ("div", "header"), ("header", "site-header masthead"), ("div", "banner")),
            "footer": pick(("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright")),
            "aside": pick(("aside", ""), ("div", "sidebar"), ("aside", "widget related"), ("div", "side-column")),
            "ad": pick(("div", "ad"), ("div", "ads advert"), ("div", "advertisement"), ("aside", "sponsored promo"), ("section", "ad-banner")),
            "notice": pick(("div", "cookie-notice"), ("div", "notice"), ("div", "consent gdpr"), ("div", "alert popup"), ("section", "newsletter subscribe")),
            "form": pick(("form", ""), ("form", "search"), ("div", "login form"), ("form", "contact")),
            "comments": pick(("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "comment reply"), ("section", "responses discussion")),
            "share": pick(("div", "share social"), ("div", "tags"), ("div", "related posts"), ("div", "author-bio")),
        }[kind]
        if kind == "nav":
            inner = links(rng.integers(2, 9))
        elif kind == "form":
            inner = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button><p>{sentence()}</p>'
        elif kind == "footer":
            inner = pick("&copy; ", "") + f"{word()}.{word()} &middot; {prose(False)}" + (links(3) if chance(0.3) else "")
        elif kind == "comments":
            item = pick("li", "div", "p", "article")
            inner = "".join(f'<{item} class="comment"><b>{word()}</b> {prose(False)}</{item}>' for _ in range(rng.integers(1, 5)))
        elif kind == "aside":
            inner = f"<h3>{words(1, 4)}</h3>" + pick(links(4), f"<p>{prose(False)}</p>")
        else:
            inner = pick("{}", "<p>{}</p>", "<span>{}</span>", "<p>{}</p><a href='#'>x</a>").format(prose(False))
        mark = f' {pick("class", "class", "id")}="{cls}"' if cls else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def main() -> str:
        out = [f"<h1>\x01{sentence()}</h1>"] if chance(0.9) else []
        for _ in range(rng.integers(10, 40) if chance(0.1) else rng.integers(1, 9)):
            kind = rng.random()
            if kind < 0.6:
                out.append(pick("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}<br>\x01second line here</p>", "<div>{}</div>").format(prose(True)))
            elif kind < 0.7:
                out.append(f"<h2>\x01{sentence(2, 6)}</h2>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>{prose(True)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{prose(True)}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>\x01{words(1, 4)}</td><td>\x01{word()}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            else:
                out.append(boiler(pick("ad", "share", "notice")))
        tag, cls = pick(("article", ""), ("article", ""), ("article", "post entry"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry post-content"), ("section", "story main"))
        body = f"<{tag}" + (f' class="{cls}"' if cls else "") + f">{''.join(out)}</{tag}>"
        if chance(0.3) and tag != "main":
            body = f"<main>{body}</main>" if chance(0.5) else f'<div id="main"><div class="wrapper">{body}</div></div>'
        return body

    before = [boiler(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if chance(0.7 if k == "nav" else 0.35)]
    after = [boiler(k) for k in ("share", "aside", "ad", "form", "notice", "nav") if chance(0.25)]
    comments = [boiler("comments")] if chance(0.35) else []
    tail = [boiler("footer")] if chance(0.85) else []
    rng.shuffle(before)
    rng.shuffle(after)
    shell = pick("{}", "{}", '<div class="page">{}</div>', '<div id="wrapper"><div class="container">{}</div></div>')
    return "<html><head><title>t</title></head><body>" + shell.format("".join([*before, main(), *comments, *after, *tail])) + "</body></html>"


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Labeller:
    """The labeller trained on generated pages; the same for every call."""
    rng, data = np.random.default_rng(seed), []
    for _ in range(pages):
        found = blocks(generated(rng))
        labels = np.array(["\x01" in b.text for b in found], float)
        for b in found:
            b.text = b.text.replace("\x01", "")
        data.append((vectors(found), labels))
    model = Labeller(seed)
    model.fit(data, seed=seed)
    return model


def texts(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page: the blocks labelled so, joined by one space."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        part = order[at : at + 64]
        while len(part) > 1 and len(found[part[-1]]) * len(part) > 8192:
            part = part[: len(part) // 2]
        x, mask = padded([vectors(found[k]) for k in part])
        p = model.probabilities(x, mask)
        for row, k in zip(p, part, strict=True):
            out[k] = " ".join(b.text for b, score in zip(found[k], row, strict=False) if score >= 0.5)
        at += len(part)
    return out


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text (main text, empty if none) and n_chars (its code points).

    Null and empty pages give an empty text; a page without tags is one block. Character references are decoded and
    white space inside a block becomes one space. Ids and urls may be null or repeat; other columns aren't read.
    """
    model = trained()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            out = texts(model, [h or "" for h in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
