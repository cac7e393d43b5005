"""Operator 12: the main text of web pages, by a recurrent labeller of their blocks.

A page is cut into leaf blocks in page order: runs of text between the borders of block
elements. A block is a vector: hashed names, classes, ids and roles of the elements
around it (its tag path), hashed words of its whole text, and some figures (length,
links, punctuation, place). A bidirectional LSTM in numpy reads a page's whole sequence
of blocks and says of each whether it belongs to the main text, so a block is judged in
the light of all others. Blocks of the main text are joined by line ends.

Nobody labelled the pages, so the labeller learns from landmarks: a bounded sample of
SAMPLE unlike pages of at most SAMPLE_CHARS characters, in which elements like article,
nav or footer tell the parts apart. They are read twice as they are, and MIXED times with other
parts put before, into and after the article. Their paragraphs are also laid out anew, in
SAMPLE x VARIANTS other page designs (menus, banners, notices, side columns, forms,
adverts, comments, with and without telling names), for which the labels are known.
The sample depends on the pages' contents alone, and training has a fixed seed.

Blocks: <br> and inline elements don't end a block; <br> is white space. Text in
script, style, title, noscript, template, iframe, object, svg, canvas, select, button and
textarea is no text of the page. References are decoded, white space of any kind
becomes one space. An unfinished tag at the end runs to the end; end tags that are
missing are supplied. Paths count at most DEPTH levels.

Cases: null or empty html, or html without text, gives an empty text and n_chars 0. A
page of any length is one sequence; its time and memory are in proportion. Repeated
rows give repeated results. An empty table gives an empty result. Extra columns are kept,
those named as a result, in any case, are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col, map_texts, table

SAMPLE = 300
SAMPLE_CHARS = 100_000
VARIANTS = 5
#: Times that a sampled page with landmarks is read again with parts of other kinds put into it.
MIXED = 4
EPOCHS = 8
BATCH = 24
RATE = 0.004
#: Sizes of the vectors' parts and of the two hidden states.
PATH, INNER, WORDS, FIGURES = 192, 96, 48, 12
HIDDEN = 32
DEPTH = 64
#: Blocks of a padded batch at scoring; a longer page is a batch of its own.
BATCH_BLOCKS = 16_384

FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMES = re.compile(r"""(?i)\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
DROPPED = frozenset("noscript template object svg canvas select button audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose start ends an open element of the named kinds, up to the border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in RAW}


class Parser:
    """Cuts pages into blocks. ``paths`` names the elements around a block; it is kept between pages."""

    MOST_PATHS = 20_000

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.paths: list[tuple[int, tuple[str, ...], int]] = [(-1, (), 0)]
        self._child: dict = {}

    def _step(self, parent: int, name: str, rest: str) -> int:
        key = parent, name, rest if name != "a" else ""
        found = self._child.get(key)
        if found is None:
            depth = self.paths[parent][2] + 1
            if depth > DEPTH:
                return parent
            tokens = [name]
            if rest and name != "a":
                for value in _NAMES.findall(rest):
                    tokens += ["." + w for w in _PART.findall(_CAMEL.sub(" ", value).lower())]
            found = self._child[key] = len(self.paths)
            self.paths.append((parent, tuple(dict.fromkeys(tokens)), depth))
        return found

    def tokens(self, path: int) -> list[tuple[str, ...]]:
        """The elements' tokens from the outermost to the innermost."""
        out = []
        while path > 0:
            path, tokens, _ = self.paths[path]
            out.append(tokens)
        return out[::-1]

    def __call__(self, page: str) -> list[tuple[int, str, int]]:
        """Blocks (path, text, characters of it in links)."""
        if len(self.paths) > self.MOST_PATHS:
            self._forget()
        blocks: list[tuple[int, str, int]] = []
        stack: list[str] = []
        paths = [0]
        opened: dict[str, int] = defaultdict(int)
        held: list[str] = []
        where, linked, dropped = -1, 0, 0
        pos, size = 0, len(page)

        def flush() -> None:
            nonlocal where, linked
            text = " ".join("".join(held).split())
            if text:
                blocks.append((where, text, min(linked, len(text))))
            held.clear()
            where, linked = -1, 0

        def pop(k: int) -> None:
            nonlocal dropped
            if any(name in BLOCK for name in stack[k:]):
                flush()
            for name in stack[k:]:
                opened[name] -= 1
                dropped -= name in DROPPED
            del stack[k:], paths[k + 1 :]

        while pos < size:
            lt = page.find("<", pos)
            end = size if lt < 0 else lt
            if end > pos and not dropped:
                text = page[pos:end]
                text = entities.unescape(text) if "&" in text else text
                if where < 0 and not text.isspace():
                    where = paths[-1]
                if opened["a"]:
                    linked += len(text)
                held.append(text)
            if lt < 0:
                break
            m = _TAG.match(page, lt)
            if not m:
                mark = page[lt + 1 : lt + 2]
                if page.startswith("<!--", lt):
                    gt = page.find("-->", lt + 4)
                    pos = size if gt < 0 else gt + 3
                elif mark in ("!", "?") or mark == "/" or mark.isalpha():
                    gt = page.find(">", lt)
                    pos = size if gt < 0 else gt + 1
                else:  # a less-than sign
                    if not dropped:
                        where = paths[-1] if where < 0 else where
                        held.append("<")
                    pos = lt + 1
                continue
            pos = m.end()
            name = m[2].lower()
            if m[1]:
                if opened[name] > 0:
                    k = len(stack) - 1
                    while stack[k] != name:
                        k -= 1
                    pop(k)
                continue
            if name in RAW:
                closing = _RAW_END[name].search(page, pos)
                pos = closing.start() if closing else size
                if closing:
                    gt = page.find(">", pos)
                    pos = size if gt < 0 else gt + 1
                continue
            if name == "br":
                held.append(" ")
                continue
            if name in BLOCK:
                flush()
                if opened["p"] > 0:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k] == "p":
                            pop(k)
                            break
                        if stack[k] in BLOCK:
                            break
                if name in CLOSES and any(opened[x] > 0 for x in CLOSES[name][0]):
                    kinds, border = CLOSES[name]
                    for k in range(len(stack) - 1, max(len(stack) - 1 - DEPTH, -1), -1):
                        if stack[k] in kinds:
                            pop(k)
                            break
                        if stack[k] in border:
                            break
            if name in VOID or m[3].endswith("/") and name not in BLOCK:
                continue
            stack.append(name)
            paths.append(self._step(paths[-1], name, m[3].strip()))
            opened[name] += 1
            dropped += name in DROPPED
        flush()
        return blocks


class Featurizer:
    """Vectors of a page's blocks."""

    SIZE = PATH + INNER + WORDS + FIGURES
    MOST = 200_000

    def __init__(self, parser: Parser):
        self.parser = parser
        self.words: dict[str, int] = {}
        self.known: dict[int, np.ndarray] = {}
        self.of: list | None = None

    def path(self, path: int) -> np.ndarray:
        if self.of is not self.parser.paths:
            self.known, self.of = {}, self.parser.paths
        found = self.known.get(path)
        if found is None:
            found = self.known[path] = np.zeros(PATH + INNER, np.float32)
            elements = self.parser.tokens(path)
            for tokens in elements:
                for t in tokens:
                    found[zlib.crc32(t.encode()) % PATH] += 1
            np.tanh(found, out=found)
            for tokens in elements[-3:]:
                for t in tokens:
                    found[PATH + zlib.crc32(("in" + t).encode()) % INNER] = 1
        return found

    def word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.MOST:
                self.words.clear()
            found = self.words[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return found

    def __call__(self, blocks: list[tuple[int, str, int]]) -> np.ndarray:
        out = np.zeros((len(blocks), self.SIZE), np.float32)
        for k, (path, text, linked) in enumerate(blocks):
            words = text.lower().split()
            n = len(text)
            out[k, : PATH + INNER] = self.path(path)
            counts = np.bincount([self.word(w) for w in words], minlength=WORDS)
            out[k, PATH + INNER : PATH + INNER + WORDS] = counts / np.sqrt(counts @ counts)  # of length 1, however often words are repeated
            stops = text.count(".") + text.count("!") + text.count("?")
            out[k, -FIGURES:] = (np.log1p(n) / 4, np.log1p(len(words)) / 4, linked / n, min(stops / len(words), 1), min(text.count(",") / len(words), 1), text[-1] in ".!?:”\"", "©" in text, text[0].isupper(), min(text.count("|") + text.count("»"), 3) / 3, k / len(blocks), np.log1p(len(blocks)) / 4, 1)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """A bidirectional LSTM with one output a block; weights are float32 arrays by name."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 1):
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = {"out": rng.normal(0, 0.1, (2 * HIDDEN + 1,)).astype(np.float32)}
            for d in "fb":
                weights["x" + d] = rng.normal(0, Featurizer.SIZE**-0.5, (Featurizer.SIZE, 4 * HIDDEN)).astype(np.float32)
                weights["h" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.w = weights

    @staticmethod
    def _orders(lengths: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(steps)[None, :]
        back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
        return back, at < lengths[:, None]

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of (pages, steps, size); with ``keep`` also what training needs."""
        pages, steps, _ = x.shape
        z = (x.reshape(pages * steps, -1) @ self.w["x" + d]).reshape(pages, steps, -1)
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.empty((pages, steps, HIDDEN), np.float32), []
        for t in range(steps):
            a = z[:, t] + h @ self.w["h" + d]
            gates, g = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, last = c, h
            c = f * before + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[:, t] = h
            if keep:
                kept.append((i, f, o, g, before, squashed, last))
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, upper: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of one direction's weights."""
        pages, steps, size = x.shape
        dz = np.empty((pages, steps, 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((pages, HIDDEN), np.float32)
        grad = np.zeros_like(self.w["h" + d])
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, squashed, last = kept[t]
            dh = dh + upper[:, t]
            dc = dc + dh * o * (1 - squashed * squashed)
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad += last.T @ dz[:, t]
            dh, dc = dz[:, t] @ self.w["h" + d].T, dc * f
        return {"h" + d: grad, "x" + d: x.reshape(-1, size).T @ dz.reshape(-1, 4 * HIDDEN)}

    def scores(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        back, mask = self._orders(lengths, x.shape[1])
        rows = np.arange(len(x))[:, None]
        forward, kept = self._run(x, "f", keep)
        turned = x[rows, back]
        backward, other = self._run(turned, "b", keep)
        both = np.concatenate([forward, backward[rows, back]], axis=2)
        p = _sigmoid(both @ self.w["out"][:-1] + self.w["out"][-1])
        return (p, mask, back, rows, turned, both, kept, other) if keep else p

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, mask, back, rows, turned, both, kept, other = self.scores(x, lengths, True)
        n = mask.sum()
        loss = -np.log(np.clip(np.where(y > 0.5, p, 1 - p), 1e-7, 1))[mask].sum() / n
        dy = np.where(mask, p - y, 0).astype(np.float32) / n
        out = np.append((both * dy[..., None]).sum((0, 1)), dy.sum())
        upper = dy[..., None] * self.w["out"][:-1]
        grads = {"out": out.astype(np.float32)} | self._back(x, "f", kept, upper[..., :HIDDEN])
        return float(loss), grads | self._back(turned, "b", other, upper[..., HIDDEN:][rows, back])


def _padded(items: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in items])
    out = np.zeros((len(items), lengths.max(), Featurizer.SIZE), np.float32)
    for k, x in enumerate(items):
        out[k, : len(x)] = x
    return out, lengths


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights learned from (vectors, labels) of pages, by Adam."""
    model, rng = Labeller(seed=seed), random.Random(seed)
    mean, square = {k: np.zeros_like(v) for k, v in model.w.items()}, {k: np.zeros_like(v) for k, v in model.w.items()}
    step, total = 0, epochs * -(-len(pages) // BATCH)
    for _ in range(epochs):
        # Pages of like length share a batch.
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]) + rng.random() * 8)
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rng.shuffle(batches)
        for batch in batches:
            x, lengths = _padded([pages[k][0] for k in batch])
            y = np.zeros(x.shape[:2], np.float32)
            for row, k in enumerate(batch):
                y[row, : lengths[row]] = pages[k][1]
            _, grads = model.gradients(x, lengths, y)
            step += 1
            rate = RATE * (1 - step / (total + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            norm = max(1.0, float(sum((g * g).sum() for g in grads.values())) ** 0.5)
            for k, g in grads.items():
                g = g / norm
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                model.w[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return model.w


#: Names of elements, classes and ids by which a sampled page tells its own parts apart.
APART = frozenset("nav footer aside form .ad .ads .advert .advertisement .banner .sponsored .promo .cookie .cookies .consent .notice .sidebar .menu .nav .navigation .navbar .breadcrumb .breadcrumbs .footer .comment .comments .reply .share .social .related .newsletter .subscribe .popup .modal .widget .search .complementary .contentinfo .alert .dialog".split())
MAIN = frozenset("article main .main .article .articlebody .post .entry .story".split())


def landmarks(elements: list[list[tuple[str, ...]]]) -> list[int] | None:
    """1 for blocks within a main element and no part apart, else 0; None if a page has no main element."""
    flat = [[set(tokens) for tokens in path] for path in elements]
    if not any(tokens & MAIN for path in flat for tokens in path):
        return None
    out = []
    for path in flat:
        inner = [bool(t & MAIN) for t in path]
        first = inner.index(True) if True in inner else -1
        header = any("header" in t for t in path[: max(first, 0)])
        out.append(int(first >= 0 and not header and not any(t & APART for t in path)))
    return out


_STOCK = {
    "notice": ["We use cookies to give you the best experience. By going on you accept our policy.", "This site uses cookies.", "Please accept our terms to continue reading.", "Accept all", "Your browser is out of date, please update it.", "Diese Seite verwendet Cookies.", "Ce site utilise des cookies.", "Este sitio usa cookies."],
    "form": ["Sign up for our newsletter", "Enter your email address", "Search", "Log in", "User name", "Password", "Leave a reply", "Your name", "Message", "Subscribe now", "I agree to the terms"],
    "footer": ["© 2024 {w} Inc. All rights reserved.", "Copyright {w}", "Privacy policy", "Terms of use", "Contact us", "Powered by {w}", "Imprint", "© www.{w}.example.com · {s}"],
    "share": ["Share", "Tweet", "Like", "Email this", "Print", "Follow us", "Share this article"],
    "comments": ["Comments", "{w} says:", "3 comments", "Reply", "Report", "Posted by {w} on 3 May", "Leave a comment", "I agree with {w}.", "Great post, thanks!", "{s}"],
    "side": ["Related posts", "Popular", "Recent articles", "Archives", "Categories", "About the author", "Tags", "Most read"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "{s}", "{s}", "{s}"],
    "letter": ["Subscribe to our newsletter", "Sign up: {s}", "Never miss a story. {s}", "{s}"],
    "top": ["{w}", "{s}", "{s}", "Welcome to {w}"],
    "menu": ["Home", "News", "About", "Contact", "Blog", "Products", "{w}", "{w}", "{w}"],
}
_WRAP = {
    "notice": ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div role="alert"', 'div class="alert"', 'div class="consent popup"', "div", "p", 'section class="gdpr"', "dialog"],
    "form": ["form", 'form class="search"', 'form id="login"', 'div class="newsletter"', 'form action="/s"', "fieldset"],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div id="colophon"', 'footer class="site-footer"', "div", "center", "address"],
    "share": ['div class="share"', 'ul class="social"', 'div class="share-buttons"', 'div class="toolbar"'],
    "comments": ['section id="comments"', 'div class="comments"', 'div id="disqus_thread"', 'ol class="commentlist"', 'div class="comment-list"', 'section class="responses"'],
    "side": ["aside", 'div class="sidebar"', 'div id="secondary"', 'div class="widget"', 'aside class="related"', 'div id="right-column"', 'div class="related-posts"', "td"],
    "ad": ['div class="ad"', 'div class="advert"', 'div id="banner"', 'ins class="adsbygoogle"', 'div class="sponsored"', 'aside class="promo"', 'div class="ad-slot"', 'div class="advertisement"'],
    "menu": ["nav", 'div class="menu"', 'ul id="nav"', 'div id="navigation"', 'nav class="main-nav"', 'div class="breadcrumb"', 'div class="navbar"', "ul", "div"],
    "letter": ['section class="newsletter"', 'div class="subscribe"', 'div class="signup-box"', 'aside class="newsletter"'],
    "top": ["header", "header", 'div class="header"', 'div id="masthead"', 'div id="header"', 'header class="site-header"', "div"],
    "main": ["article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'section class="story"', 'article class="post"', "div", "section", 'div class="article-body"', "td", 'div id="main"'],
}
#: Kinds of parts that stand within articles, too.
ASIDES = ("ad", "ad", "notice", "side", "side", "form", "comments", "letter", "share", "top", "menu", "footer")
_SEAMS = re.compile(r"</(?:p|h[1-6]|div|article|main|nav|ul)>|<(?:p|article|main|footer)[\s>]")
_MAIN_MARK, _APART_MARK = "\ue000", "\ue001"


class Designs:
    """Lays sampled paragraphs out in made page designs; a mark before each text tells its label."""

    def __init__(self, paragraphs: list[str], seed: int = 7):
        self.rng = random.Random(seed)
        self.paragraphs = paragraphs or ["A short text."]

    def _filled(self, kind: str) -> str:
        word = self.rng.choice(self.rng.choice(self.paragraphs).split()[:20] or ["x"])
        said = " ".join(self.rng.choice(self.paragraphs).split()[: self.rng.randint(3, 40)])
        return self.rng.choice(_STOCK[kind]).replace("{w}", word.strip(".,")).replace("{s}", said)

    def _in(self, wrap: str, inner: str) -> str:
        name = wrap.split()[0]
        if name == "td":
            return f"<table><tr><td>{inner}</td></tr></table>"
        return f"<{wrap}>{inner}</{name}>"

    def _apart(self, text: str) -> str:
        return _APART_MARK + entities.escape(text.replace(_MAIN_MARK, " "), quote=False)

    def prose(self) -> str:
        """A stretch of a sampled paragraph, up to the whole of it."""
        words = self.rng.choice(self.paragraphs).split()
        return " ".join(words[: max(3, int(len(words) * self.rng.random() ** 0.5))])

    def part(self, kind: str) -> str:
        """A part that isn't main text."""
        r = self.rng
        if kind not in ("menu", "share") and r.random() < 0.4:  # prose like the article's: only its place tells
            item = r.choice(["<p>{}</p>", "<p>{}</p>", "{}", "<div>{}</div>", "<li>{}</li>", "<h3>{}</h3>", '<div class="comment">{}</div>' if kind == "comments" else "<span>{}</span>"])
            return self._in(r.choice(_WRAP[kind]), "".join(item.format(self._apart(self.prose())) for _ in range(r.randint(1, 3))))
        some = [self._filled(kind) for _ in range(r.randint(1, 2 if kind in ("notice", "ad", "footer") else 7))]
        if kind == "menu":
            links = [f'<a href="/{k}">{self._apart(t)}</a>' for k, t in enumerate(some + [self._filled(kind) for _ in range(3)])]
            inner = r.choice(["<ul><li>" + "</li><li>".join(links) + "</li></ul>", " | ".join(links), "<p>" + "</p><p>".join(links) + "</p>"])
        elif kind == "form":
            inner = "".join(r.choice(["<label>{}</label><input name=q>", "<p>{}</p><input type=submit>", "<div><label>{}</label><textarea>x</textarea></div>", "<h3>{}</h3>"]).format(self._apart(t)) for t in some) + "<button>Go</button>"
        elif kind == "comments":
            long = [" ".join(r.choice(self.paragraphs).split()[: r.randint(4, 60)]) for _ in range(r.randint(1, 5))]
            item = r.choice(["<li>{}</li>", '<div class="comment">{}</div>', "<p>{}</p>", '<article class="comment"><p>{}</p></article>', '<div class="comment-body"><p>{}</p></div>'])
            said = some + long if r.random() < 0.5 else [*long, *some[:1]]
            head = f"<h3>{self._apart('Comments')}</h3>" if r.random() < 0.5 else ""
            inner = head + "".join(item.format(self._apart(t)) for t in said)
        elif kind == "side":
            item = r.choice(['<li><a href="/x">{}</a></li>', "<p>{}</p>", "<h3>{}</h3>", "<li>{}</li>", "<div>{}</div>"])
            some += [" ".join(r.choice(self.paragraphs).split()[: r.randint(2, 25)]) for _ in range(r.randint(0, 5))]
            inner = "".join(item.format(self._apart(t)) for t in some)
        else:
            inner = "".join(r.choice(["<p>{}</p>", "{}", "<div>{}</div>", '<a href="/y">{}</a><br>']).format(self._apart(t)) for t in some)
        return self._in(r.choice(_WRAP[kind]), inner)

    def mixed(self, page: str) -> str:
        """A page with parts put in at ends and beginnings of its blocks."""
        r = self.rng
        places = [m.start() + (len(m[0]) if m[0].startswith("</") else 0) for m in _SEAMS.finditer(page)]
        for at in sorted(r.sample(places, min(len(places), r.randint(1, 4))), reverse=True):
            page = page[:at] + self.part(r.choice(ASIDES)) + page[at:]
        return page

    def page(self, title: str, paragraphs: list[str]) -> str:
        r = self.rng
        shown = lambda t: _MAIN_MARK + entities.escape(t, quote=False)
        item = r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>"])
        body = []
        for t in paragraphs:
            shape = r.random()
            if shape < 0.06:
                body.append("<ul>" + "".join(f"<li>{shown(x)}</li>" for x in t.split(". ")[:8] if x.strip()) + "</ul>")
            elif shape < 0.1:
                body.append(f"<h2>{shown(' '.join(t.split()[:6]))}</h2>")
            elif shape < 0.14:
                body.append(f"<blockquote>{shown(t)}</blockquote>")
            elif shape < 0.17:
                body.append("<table>" + "".join(f"<tr><td>{shown(x)}</td></tr>" for x in t.split(", ")[:4] if x.strip()) + "</table>")
            elif shape < 0.2:
                body.append(f'<p>{shown(t)} <a href="/z">more</a></p>')
            else:
                body.append(item.format(shown(t)))
            if r.random() < 0.08:
                body.append(self.part(r.choice(ASIDES)))
        head = r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", '<header class="entry-header"><h1>{}</h1></header>', ""]).format(shown(title))
        if r.random() < 0.25:
            body.append(self.part(r.choice(["share", "form", "comments", "letter", "side"])))
        main = self._in(r.choice(_WRAP["main"]), head + "".join(body))
        if r.random() < 0.25:  # a page without a box around its article
            main = head + "".join(body)
        before = [self._in(r.choice(_WRAP["top"]), f"<p>{self._apart(self._filled('menu'))}</p>" + (self.part("menu") if r.random() < 0.5 else ""))] if r.random() < 0.6 else []
        before += [self.part(k) for k in ("menu", "notice", "ad", "form", "side", "letter") if r.random() < (0.6 if k == "menu" else 0.3)]
        after = [self.part(k) for k in ("share", "side", "comments", "form", "ad", "footer", "notice", "letter", "top") if r.random() < {"footer": 0.7, "comments": 0.6}.get(k, 0.35)]
        r.shuffle(before)
        whole = "".join(before) + main + "".join(after)
        whole = r.choice(["{}", "{}", '<div id="page">{}</div>', '<div class="container">{}</div>', '<div class="wrapper"><div>{}</div></div>', '<form id="aspnetForm">{}</form>' if r.random() < 0.3 else "{}"]).replace("{}", whole)
        return f"<html><head><title>{entities.escape(title)}</title></head><body>{whole}" + r.choice(["</body></html>", ""])


def _mixed(parser: Parser, page: str) -> tuple[list[tuple[int, str, int]], list[int]]:
    """The blocks of a page with landmarks and marked parts, and their labels."""
    blocks = parser(page)
    labels = landmarks([parser.tokens(path) for path, _, _ in blocks]) or [0] * len(blocks)
    plain = [(path, text.replace(_APART_MARK, "").strip(), linked) for path, text, linked in blocks]
    kept = [(b, y if _APART_MARK not in text else 0) for b, (_, text, _), y in zip(plain, blocks, labels, strict=True) if b[1]]
    return [(path, text, min(linked, len(text))) for (path, text, linked), _ in kept], [y for _, y in kept]


def _marked(parser: Parser, page: str) -> tuple[list[tuple[int, str, int]], list[int]]:
    """The blocks of a made page, without marks, and their labels."""
    blocks, labels = [], []
    for path, text, linked in parser(page):
        plain = text.replace(_MAIN_MARK, "").replace(_APART_MARK, "").strip()
        if plain:
            blocks.append((path, plain, min(linked, len(plain))))
            labels.append(int(_MAIN_MARK in text))
    return blocks, labels


def sample(pages: DataFrame, html_col: str = "html") -> list[str]:
    """SAMPLE unlike pages of at most SAMPLE_CHARS characters, by a hash of their contents."""
    read = pages.select(col(html_col).cast("string").alias("html")).filter(F.length("html").between(1, SAMPLE_CHARS))
    read = read.withColumn("key", F.xxhash64("html", F.lit("sample")))
    chosen = read.select("key").distinct().orderBy("key").limit(SAMPLE)
    found = read.join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("html").alias("html"))
    return [r["html"] for r in sorted(found.collect(), key=lambda r: r["key"])]


def train(pages: DataFrame, html_col: str = "html") -> dict[str, np.ndarray]:
    """The labeller's weights, learned from ``sample(pages)``."""
    parser = Parser()
    featurize = Featurizer(parser)
    parts, told, stories, seen = [], [], [], []
    for page in sample(pages, html_col):
        blocks = parser(page)
        labels = landmarks([parser.tokens(path) for path, _, _ in blocks])
        if labels is None:
            parts += [text for _, text, _ in blocks if len(text) > 80]
            continue
        told.append((featurize(blocks), np.array(labels, np.float32)))
        seen.append(page)
        inside = [text for (_, text, _), y in zip(blocks, labels, strict=True) if y]
        parts += [text for (_, text, _), y in zip(blocks, labels, strict=True) if not y or len(text) > 80]
        if inside:
            stories.append(inside)
    designs = Designs([t for t in parts if t.strip()])
    stories = stories or [[t] for t in designs.paragraphs]
    made = []
    for k in range(SAMPLE * VARIANTS):
        story = stories[k % len(stories)]
        start = designs.rng.randrange(len(story))
        text = story[start : start + designs.rng.randint(1, 24)]
        blocks, labels = _marked(parser, designs.page(" ".join(text[0].split()[:10]), text))
        if blocks:
            made.append((featurize(blocks), np.array(labels, np.float32)))
    for page in seen * MIXED:
        blocks, labels = _mixed(parser, designs.mixed(page))
        if blocks:
            made.append((featurize(blocks), np.array(labels, np.float32)))
    return fit([x for x in told if len(x[1])] * 2 + made)


def _extractor(weights: dict[str, np.ndarray]) -> Callable[[list[str | None]], tuple[list[str], list[int]]]:
    parser = Parser()
    featurize, model = Featurizer(parser), Labeller(weights)

    def work(pages: list[str | None]) -> tuple[list[str], list[int]]:
        texts = [""] * len(pages)
        held: list[tuple[int, list[str], np.ndarray]] = []

        def label() -> None:
            held.sort(key=lambda x: len(x[1]))
            i = 0
            while i < len(held):
                j = i + 1
                while j < len(held) and (j + 1 - i) * len(held[j][1]) <= BATCH_BLOCKS and len(held[j][1]) <= 2 * len(held[i][1]):
                    j += 1
                x, lengths = _padded([v for _, _, v in held[i:j]])
                for (k, found, _), p, n in zip(held[i:j], model.scores(x, lengths), lengths, strict=True):
                    texts[k] = "\n".join([t for t, s in zip(found, p[:n].tolist(), strict=True) if s >= 0.5])
                i = j
            held.clear()

        size = 0
        for k, page in enumerate(pages):
            blocks = parser(page) if page else []
            if not blocks:
                continue
            held.append((k, [t for _, t, _ in blocks], featurize(blocks)))
            size += len(blocks)
            if size > BATCH_BLOCKS:
                label()
                size = 0
        label()
        return texts, [len(t) for t in texts]

    return work


def extract(pages: DataFrame, weights: dict[str, np.ndarray], html_col: str = "html", keep: Sequence[str] | None = None) -> DataFrame:
    """``pages`` with the main text of each page and its number of code points."""
    return map_texts(pages, html_col, FIELDS, lambda: _extractor(weights), keep=keep)


def op12_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages), keep=["page_id", "url"])


QUERIES = {"op12_page_blocks": op12_page_blocks}
ORACLES: dict[str, str] = {}
