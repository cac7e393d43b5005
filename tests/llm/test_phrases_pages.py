"""Operators 11 to 13 against brute force, and the page labeller on pages with known texts."""

import html
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import collocations, divergence, page_blocks


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(rows, least, top, max_n=5):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        mine = f.setdefault(lang, Counter())
        for words in words_of(text):
            n[lang] += len(words)
            mine.update(tuple(words[i : i + k]) for k in range(1, max_n + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p for q, b in good.items() for i in range(len(q)) for j in range(i + 1, len(q) + 1) if (p := q[i:j]) != q and good.get(p) == b}
        scored = []
        for p, a in good.items():
            if p not in gone:
                s, k = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    common = ["the", "of", "New", "york", "ÉTÉ", "a", "in", "big", "apple", "日本"]
    rows = []
    for k in range(120):
        words = [rng.choice(common) if rng.random() < 0.8 else f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!?"]) for w in words) + " New York Times Square Garden"
        rows.append((text, rng.choice(["en", "en", "fr", None, ""])))
    rows += [rows[0]] * 30 + [(None, "en"), ("", "xx"), (" .,; ", "en"), ("x" * 70_000 + " y", "en"), (" ".join(["again"] * 5000), "en")]
    return rows


@pytest.mark.parametrize("least,top", [(10, 2000), (30, 7), (300, 50)])
def test_collocations(spark, texts, least, top):
    docs = spark.createDataFrame([(*r, 1, "x") for r in texts], "text string, lang string, n long, phrase string").repartition(5)
    got = collocations.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(texts, least, top)


def test_cells_that_all_pass_lose_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_CELLS", 8)
    monkeypatch.setattr(collocations, "MOST_CELLS", 8)
    monkeypatch.setattr(collocations, "SLICE", 500)
    monkeypatch.setattr(collocations, "FAN", 2)
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(5)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=12).collect()) == brute_phrases(texts, 12, 2000)


def test_scores_are_exact(spark):
    rng = random.Random(1)
    rows = [(10**12 + rng.randint(0, 10**9), 10**16 + rng.randint(0, 10**9), 10**13 + rng.randint(0, 10**9), 10**14 + rng.randint(0, 10**9)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", collocations.score("a", "n", "l", "r").alias("s"))
    assert all(x["s"] == 1000 * x["a"] * x["n"] // (x["l"] * x["r"]) for x in df.collect())


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def brute_audit(rows, least, top):
    groups, docs, counts = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.setdefault(lang, set()).add(source)
        docs.setdefault(lang, Counter()).update(set(terms))
        counts.setdefault((lang, source), Counter()).update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        def p(c):
            n = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + (10**9 * Fraction(c[t] + 5, n)).__floor__() for t in kept}
        q = p(whole)
        of = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(pairs, 1)]
            best = sorted((q[t] - of[s][t], t.encode()) for t in kept if counts[lang, s][t] and of[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(9)
    rows = []
    for k in range(400):
        words = [f"{rng.choice('abcdé')}{rng.choice('xyz日')}{rng.choice('AeO')}" if rng.random() < 0.9 else f"rare{''.join(rng.choice('abcdefg') for _ in range(6))}" for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice([" ", "-", "9"]).join(words), rng.choice(["en", "de", None]), f"s{rng.randint(0, 11)}"))
    return [*rows, *[rows[0]] * 5, (None, "fr", "lonely"), ("", "fr", None), ("unique", "it", "x"), (None, None, None)]


@pytest.mark.parametrize("sources,terms,held", [(64, 1024, 300_000), (3, 7, 50)])
def test_audit(spark, sourced, sources, terms, held, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS", terms)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in sourced], "text string, lang string, source string, n long, term string, tile long").repartition(4)
    got = divergence.audit(docs, least_docs=10, top=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(sourced, 10, 6)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_parts_per_billion_are_exact():
    rng = random.Random(4)
    for scale in (10, 10**6, 10**12, 10**15, 10**17):
        n = [rng.randint(0, scale) for _ in range(6)]
        got = divergence.parts_per_billion(np.array([n]), np.array([sum(n)]), 6)[0]
        assert got.tolist() == [1 + 10**9 * (c + 5) // (sum(n) + 30) for c in n]


# Pages ---------------------------------------------------------------------------------------------

PARSED = [
    ("", []),
    ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<b>b</b> c<p>d<br>e</p>f", ["ab c", "d e", "f"]),
    ("<div>one\n two &nbsp; three<!-- x <p>no</p> --></div><script>var a='</p><p>x';</script>tail", ["one two three", "tail"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
    ("<title>no</title><p title='a>b' class=x>yes</p><button>no</button><select><option>no</select>end", ["yes", "end"]),
    ("a < b and <3 <p>c</p", ["a < b and <3", "c"]),
    ("<p>one <a href='x'>two</a></div></p></b>three<a", ["one two", "three"]),
    ("&lt;p&gt;kept&lt;/p&gt; &#233;&eacute;", ["<p>kept</p> éé"]),
    ("<style>p{}</style><noscript>no<p>no</noscript><P CLASS=Y>Yes</P><SCRIPT>1</SCRIPT>", ["Yes"]),
    ("x<script>never closed <p>no</p>", ["x"]),
]


@pytest.mark.parametrize("page,want", PARSED)
def test_blocks(page, want):
    assert [text for _, text, _ in page_blocks.Parser()(page)] == want


def test_parser_is_linear():
    parser = page_blocks.Parser()
    for hard in ("<div>" * 60_000 + "x" + "</div>" * 60_000, "<a <a " * 60_000, "<b>" * 40_000 + "<p>x" * 40_000, "<a href=\"x" * 60_000, "</b>" * 100_000, "<" * 200_000):
        parser(hard)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 5, page_blocks.Featurizer.SIZE)).astype(np.float32)
    lengths, y = np.array([5, 2, 4]), rng.integers(0, 2, (3, 5)).astype(np.float32)
    model = page_blocks.Labeller(seed=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, grads = model.gradients(x.astype(np.float64), lengths, y)
    for name, w in model.w.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            old, losses = w[at], []
            for d in (1e-4, -1e-4):
                w[at] = old + d
                losses.append(model.gradients(x.astype(np.float64), lengths, y)[0])
            w[at] = old
            assert abs((losses[0] - losses[1]) / 2e-4 - grads[name][at]) < 1e-4


def made_pages(n=160, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "sul", "ék"]) for _ in range(rng.randint(1, 4)))
    line = lambda k: (" ".join(word() for _ in range(k)) + ".").capitalize()
    rows = []
    for k in range(n):
        body = [line(rng.randint(3, 40)) for _ in range(rng.randint(1, 9))] + ["Fish &amp; chips"]
        page = f"<html><head><title>{body[0]}</title><script>x('</p>')</script></head><body><nav><ul>" + "".join(f"<li><a href=/{i}>{word()}</a></li>" for i in range(6)) + f'</ul></nav><div class="ad">{line(9)}</div><article><h1>{body[0]}</h1>' + "".join(f"<p>{t}</p>" for t in body) + f"</article><footer>&copy; {word()}.example</footer></body></html>"
        rows.append((k, f"http://x/{k}", page, "\n".join(html.unescape(t) for t in [body[0], *body])))
    return rows


PARTS = {
    "notice": '<div class="notice">{}</div>', "cookies": '<div class="cookie-banner"><p>{}</p><button>OK</button></div>', "aside": "<aside><h3>Related</h3><p>{}</p></aside>", "sidebar": '<div class="sidebar"><p>{}</p></div>', "form": "<form><label>Search</label><input name=q><p>{}</p></form>",
    "newsletter": '<section class="newsletter"><p>{}</p></section>', "ad": '<div class="ad">{}</div>', "comments": '<section class="comments"><h2>Comments</h2><div class="comment"><p>{}</p></div></section>', "menu": '<ul class="menu"><li><a href="/a">{}</a></li></ul>',
}


def checked_parts(rows, weights):
    """Parts of other kinds before, in and after the article change no text, but for a few pages."""
    extract, wrong, seen = page_blocks._extractor(weights), 0, 0
    for k, (name, part) in enumerate(PARTS.items()):
        pages, want = [], []
        for i, (_, _, page, text) in enumerate(rows[:60]):
            put = part.format(rows[(i + k + 1) % len(rows)][3].split("\n")[1])
            at = (page.index("<article>"), page.index("</h1>") + 5, page.index("</article>"), page.index("</article>") + 10)[(i + k) % 4]
            pages.append(page[:at] + put + page[at:])
            want.append(text)
        bad = sum(a != b for a, b in zip(extract(pages)[0], want, strict=True))
        assert bad <= 12, (name, bad)
        wrong, seen = wrong + bad, seen + len(pages)
    assert wrong <= 0.05 * seen


def test_main_text(spark, monkeypatch):
    rows = made_pages()
    hard = [(1000, None, None, ""), (1001, "u", "", ""), (1002, "u", "<nav><a href=x>y</a></nav>", None), (1003, "u", "<div>" * 500 + "x" * 300_000, None)]
    pages = spark.createDataFrame([(a, b, c, 1, "t") for a, b, c, _ in rows + hard], "page_id long, url string, html string, N_chars long, where string").repartition(3)
    weights = page_blocks.train(pages)
    checked_parts(rows, weights)
    got = {r["page_id"]: r for r in page_blocks.extract(pages, weights).collect()}
    assert len(got) == len(rows) + len(hard)
    assert all(got[k]["text"] == want and got[k]["n_chars"] == len(want) for k, _, _, want in rows)
    assert got[1000]["text"] == got[1001]["text"] == "" and got[1000]["n_chars"] == 0
    assert page_blocks.extract(pages.limit(0), weights, keep=["page_id"]).count() == 0
    monkeypatch.setattr(page_blocks, "SAMPLE", 30)
    monkeypatch.setattr(page_blocks, "VARIANTS", 1)
    monkeypatch.setattr(page_blocks, "MIXED", 1)
    one, two = page_blocks.train(pages), page_blocks.train(pages.repartition(2))
    assert all((one[k] == two[k]).all() for k in one)
    page_blocks.train(pages.limit(0))
    # A design that no sampled page has: comments, a notice, a side column and a form, without an article element.
    story = rows[0][3].split("\n")
    other = '<body><div class="cookie-notice">We use cookies.</div><div id="header"><a href=/>Home</a></div><div class="content"><h1>{}</h1>{}</div><div class="sidebar"><h3>Popular</h3><p>{}</p></div><form><label>Your name</label></form><section id="comments"><p>{}</p><p>Great post, thanks!</p></section><div class="footer">© 2024</div>'
    page = other.format(story[0], "".join(f"<p>{html.escape(t)}</p>" for t in story[1:]), rows[1][3].split("\n")[0], rows[2][3].split("\n")[1])
    one = page_blocks.extract(spark.createDataFrame([(page,)], "html string"), weights).first()
    assert one["text"] == "\n".join(story)
