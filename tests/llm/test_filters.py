import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritally.llm import common, decontaminate, html_extract, language_id, quality_crf, toxicity

from .data import SCHEMA, empty, odd, rows, sentence

LABELS = "doc_id long, quality int, toxic int"


# ---------------------------------------------------------------- shared


def test_samples_are_bounded_and_the_same_every_time(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in common.bounded_sample(df.repartition(n), "k", 300).collect()) for n in (1, 7))
    assert a == b and len(a) == 300
    assert common.bounded_sample(df, "k", 9000).count() == 5000


def test_remainders_are_those_of_crc32(spark):
    got = [r[0] for r in spark.range(50).select(common.is_remainder("id", 4, 2), "id").orderBy("id").collect()]
    assert got == [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(50)]


# ---------------------------------------------------------------- toxicity


def brute_segments(scores):
    """All maximal segments by the definition: best segment, then left and right of it, again and again."""
    found = []

    def go(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and j - i > best[2] - best[1])):
                    best = (total, i, j)
        if best:
            found.append((best[1], best[2] + 1, best[0]))
            go(a, best[1])
            go(best[2] + 1, b)

    go(0, len(scores))
    return sorted(found)


def test_linear_scan_finds_all_maximal_segments():
    rng = random.Random(1)
    for _ in range(60):
        n, drift = rng.randrange(1, 40), rng.choice([0.3, 0.7, 1.1])
        gains = {k: rng.random() * 3 for k in range(n) if rng.random() < 0.4}
        got = toxicity.maximal_segments(sorted(gains), [gains[k] for k in sorted(gains)], drift)
        want = brute_segments([gains.get(k, -drift) for k in range(n)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [c for *_, c in got] == pytest.approx([c for *_, c in want])


def toxic_corpus(n=400):
    rng = random.Random(2)
    texts, toxic = [], []
    for k in range(n):
        words = sentence(rng, rng.randrange(20, 200)).split()
        bad = k % 5 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vile", "scumbag", "filthy"]) for _ in range(3)]
        texts.append(" ".join(words))
        toxic.append(int(bad if rng.random() > 0.03 else not bad))
    return texts, toxic


def test_toxicity_learns_and_finds_the_passage(spark):
    texts, toxic = toxic_corpus()
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], LABELS)
    out = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in out)
    assert right >= 390
    for r in out:
        if r.doc_id % 5 == 0 and r.predicted:
            tokens = toxicity.TOKEN.findall(texts[r.doc_id].lower())
            assert any({"vile", "scumbag", "filthy"} & set(tokens[p.start : p.end]) for p in r.passages)
    assert all(0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality_crf, "quality")])
def test_scorers_of_odd_tables(spark, module, column):
    texts, toxic = toxic_corpus(120)
    labels = spark.createDataFrame([(k, 1 - t, t) for k, t in enumerate(toxic)], LABELS)
    model = module.fit(spark.createDataFrame(rows(texts), SCHEMA), labels)
    df = odd(spark)
    out = module.score_documents(df, model).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
    assert sorted(map(str, (r.text for r in out))) == sorted(map(str, (r.text for r in df.collect())))
    assert module.score_documents(empty(spark), model).count() == 0
    blank = module.fit(empty(spark), spark.createDataFrame([], LABELS))
    assert len({r.score for r in module.score_documents(df, blank).collect()}) == 1


# ---------------------------------------------------------------- quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    count = np.array([3, 0, 1, 4, 2])
    emission, moves = rng.normal(size=count.sum()), rng.normal(size=(2, 2))
    got, expected, norm = quality_crf.forward_backward(emission, moves, count)
    want, total, pairs, at = [], 0.0, np.zeros((2, 2)), 0
    for n in count:
        e = emission[at : at + n]
        at += n
        if not n:
            continue
        weights, ones, moved = [], [], []
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            m = np.zeros((2, 2))
            for i, j in zip(y, y[1:], strict=False):
                m[i, j] += 1
            weights.append(np.exp(e @ y + (m * moves).sum()))
            ones.append(y)
            moved.append(m)
        z = sum(weights)
        want += list(np.array(weights) @ np.array(ones) / z)
        pairs += sum(w * m for w, m in zip(weights, moved, strict=True)) / z
        total += np.log(z)
    assert np.allclose(got, want) and np.allclose(expected, pairs) and norm == pytest.approx(total)


def test_line_features_are_those_of_the_lines():
    texts = ["Ab cd.\n\nx | y !\nAb cd.", "", "q1 q1 q1 q1 q1", " \n "]
    lines = quality_crf.line_features(pa.array(texts, pa.large_string()))
    assert lines.count.tolist() == [3, 0, 1, 0] and lines.size.tolist() == [2, 4, 2, 5]
    get = dict(zip(quality_crf.NAMES, lines.own.T, strict=True))
    assert get["copy"].tolist() == [0, 0, 1, 0] and get["pipes"].tolist() == [0, 0.25, 0, 0] and get["stop"].tolist() == [1, 0, 1, 0] and get["again"].tolist() == [0, 0, 0, 0.4]
    x = quality_crf.with_neighbours(lines)
    n = len(quality_crf.NAMES)
    assert np.array_equal(x[1, n : 2 * n], lines.own[0]) and np.array_equal(x[1, 2 * n :], lines.own[2]) and not x[3, n:].any()


def test_quality_learns_from_lines(spark):
    rng = random.Random(4)
    texts, good = [], []
    for k in range(300):
        bad = k % 4 == 0
        body = [sentence(rng, 12).capitalize() + "." if not bad or rng.random() < 0.2 else " | ".join(sentence(rng, 8).split()) + " ###" for _ in range(rng.randrange(3, 9))]
        texts.append("\n".join(body))
        good.append(int(not bad))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    model = quality_crf.fit(docs, spark.createDataFrame([(k, y, 0) for k, y in enumerate(good)], LABELS))
    out = quality_crf.score_documents(docs, model).collect()
    assert sum(r.predicted == good[r.doc_id] for r in out) >= 290
    assert all(len(r.line_good) == texts[r.doc_id].count("\n") + 1 for r in out)


# ---------------------------------------------------------------- languages


def test_languages(spark):
    rng = random.Random(5)
    stems = {"en": ["the", "thing", "ation"], "fr": ["été", "eaux", "le"], "de": ["ung", "über", "sch"]}
    data = []
    for k in range(360):
        lang = sorted(stems)[k % 3]
        data.append((k, " ".join(rng.choice(stems[lang]) + rng.choice("abcdef") for _ in range(rng.randrange(15, 150))), lang, "s", 1, 0.5, "b", 1, "k", 2, 3))
    docs = spark.createDataFrame(data, SCHEMA)
    model = language_id.fit(docs)
    out = language_id.identify(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2) >= 80
    strange = {r.doc_id: r for r in language_id.identify(odd(spark), model).collect() if r.doc_id is not None}
    assert strange[0].lang_pred == strange[1].lang_pred == strange[9].lang_pred == "und" and strange[8].lang_pred != "und" and strange[6].lang_pred != "und"
    assert language_id.identify(odd(spark), model).count() == odd(spark).count() and language_id.identify(empty(spark), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train([], [])).collect()} == {"und"}


def test_windows_and_tables_give_what_the_network_says():
    rng = np.random.default_rng(6)
    texts = ["", "a", "é" * 200, sentence(random.Random(1), 400)]
    data, offsets = common.raw(pa.array(texts, pa.large_string()))
    x, text, size = language_id.windows(data, offsets)
    for k, t in enumerate(texts):
        raw = t.encode()
        mine = x[text == k]
        assert len(mine) == -(-len(raw) // language_id.WINDOW) and mine.tobytes()[: len(raw)] == raw and size[text == k].sum() == len(raw)
    model = language_id.train([sentence(random.Random(k), 60, "xy"[k % 2]) for k in range(30)], ["xy"[k % 2] for k in range(30)], epochs=1)
    some = rng.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    e = model.embed[some]
    pooled = []
    for k, w in zip(language_id.WIDTHS, model.filters, strict=True):
        n = language_id.WINDOW - k + 1
        pooled.append(sum(e[:, j : j + n] @ w[j] for j in range(k)).max(1))
    h = np.maximum(np.hstack(pooled) + model.bias, 0) @ model.out + model.out_bias
    want = h - np.log(np.exp(h).sum(1, keepdims=True))
    assert np.allclose(model.log_probabilities(some, model.tables()), want, atol=1e-3)


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a> Slogan of the site</header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this site better for everyone who visits.</div><aside><p>Some words in a sidebar that are not the article at all.</p></aside>
<article><h1>The&nbsp;title</h1><p>First <b>para</b>graph with a <a href=x>link</a> &amp; more.<br>Next<p>Short.<div class="ad">Buy this now</div><form><label>Mail</label></form><ul><li>one point</li></ul></article>
<section class="comments"><p>I think that this article is very long and deserves an answer.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "The title\nFirst paragraph with a link & more. Next\nShort.\none point"


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<article><p>cut &am", "cut &am"), ("<article><p>a b<scr", "a b"), ("<article>x<script>never closed </p>", "x"), ("<main>" + "<div>" * 3000 + "deep words", "deep words"), ("<nav>only", "")])
def test_broken_pages(page, want):
    assert html_extract.main_text(page) == want


def test_pages_without_containers_go_by_words_and_links():
    long = "word " * 40
    page = f"<table><tr><td><a href=1>a b</a></td></tr><tr><td>{long}</td></tr><tr><td>{long}</td></tr><tr><td><a href=2>c d</a> | <a href=3>e</a></td></tr></table>"
    assert html_extract.main_text(page) == "\n".join([long.strip()] * 2)


LONG = " ".join(f"word{k}" for k in range(60))
WRAPPED = [
    '<div class="layout with-sidebar"><article>@</article></div>', '<div class="no-header"><main>@</main></div>', '<div id="search-results-page"><div class="article">@</div></div>',
    '<article class="post comments-open">@</article>', '<div class="post-related-content">@</div>', '<div class="social-science">@</div>', '<form id="aspnetForm"><main>@</main></form>',
    '<div class="page-header"><article>@</article></div>', '<div class="siteHeader"><main id="mainContent">@</main></div>', '<div>@</div>', "@", '<form action="/x"><div>@</div><div>@</div></form>',
]
AWAY = [
    '<div class="sidebar">@</div>', '<div class="sidebar-left widget">@</div>', '<div id="site-footer">@</div>', '<ol class="comment-list"><li><article class="comment">@</article></ol>', '<div class="ad-300x250">@</div>',
    '<div class="related-posts"><article>@</article></div>', '<section id="comments"><article>@</article></section>', '<div class="cookie-policy-banner"><p>short</div>', '<div role="navigation">@</div>', '<div class="adSlot">@</div>', '<p hidden>@', '<aside>@</aside>',
]


@pytest.mark.parametrize("page", WRAPPED)
def test_text_in_wrappers_stays(page):
    """Alone, and between menus of links."""
    menu = "<ul><li><a href=1>One</a><li><a href=2>Two more</a><li><a href=3>Three</a></ul>"
    for before, after in (("", ""), (menu, menu)):
        got = html_extract.main_text(f"<html><body class='single no-js'>{before}{page.replace('@', f'<p>{LONG}</p><p>{LONG}</p>')}{after}</body></html>")
        assert got == "\n".join([LONG] * 2 * page.count("@"))


@pytest.mark.parametrize("page", AWAY)
def test_text_in_what_is_no_content_goes(page):
    got = html_extract.main_text(f"<html><body><article><p>{LONG}</p></article>{page.replace('@', f'<p>{LONG} end</p>')}</body></html>")
    assert got == LONG


def test_the_tree_asks_for_link_density_on_both_sides():
    def features(tree):
        return {tree[0]} | features(tree[2]) | features(tree[3]) if isinstance(tree, tuple) else set()

    assert {0, 1, 3, 5, 6} <= features(html_extract.TREE)
    wrong = [r for r in html_extract.LABELLED if (html_extract.decide(html_extract.TREE, r[:-1]) >= 0.5) != r[-1]]
    assert len(wrong) <= 0.05 * len(html_extract.LABELLED)


class Splitter(HTMLParser):
    """The text of every block and its share of words in links, by an HTML parser of another kind; for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.links, self.depth, self.silent = [], "", "", 0, 0

    def close_block(self):
        if self.text.split():
            self.found.append((" ".join(self.text.split()), len(self.links.split()) / len(self.text.split())))
        self.text = self.links = ""

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "select")
        self.depth += tag == "a"
        if tag in html_extract.BREAKS:
            self.close_block()
        elif tag in ("br", "img"):
            self.text += " "

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "select")
        self.depth -= tag == "a"
        if tag in html_extract.BREAKS:
            self.close_block()

    def handle_data(self, data):
        if not self.silent:
            self.text += data
            self.links += data + " " if self.depth else ""


def test_blocks_equal_those_of_a_plain_parser():
    rng = random.Random(12)

    def inside(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(9)
            if kind < 3 or not depth:
                out.append(rng.choice([" ", "", "\n"]) + " ".join(rng.choice(["word", "a&amp;b", "x &lt; y", "caf&eacute;", "&#8212;", "é"]) for _ in range(rng.randrange(1, 6))))
            elif kind == 3:
                out.append(rng.choice(["<br>", "<img alt='a > b'>", "<!-- <p>no</p> -->", "<script>if (a < b) '<p>'</script>", "<style>p > a {}</style>"]))
            elif kind == 4:
                out.append(f"<a href='x'> {' '.join('link' for _ in range(rng.randrange(1, 4)))} </a>")
            else:
                tag = rng.choice(["p", "div", "b", "span", "ul", "td", "h2", "blockquote"]) if kind < 8 else "i"
                out.append(f"<{tag} data-x='1'>{inside(depth - 1)}</{tag}>")
        return "".join(out)

    for _ in range(300):
        page = f"<html><body>{inside(4)}</body></html>"
        plain = Splitter()
        plain.feed(page)
        plain.close()
        plain.close_block()
        got = html_extract.blocks(page)
        assert [(b[0], b[1]) for b in got] == [(t, len(t.split())) for t, _ in plain.found]
        assert all(abs(b[2] - d) < 1e-9 for b, (_, d) in zip(got, plain.found, strict=True))


def test_extract_of_a_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = html_extract.extract(df).collect()
    assert [r.n_chars for r in out] == [len(r.text) for r in out] and sorted(len(r.text) > 0 for r in out) == [False, True, True]
    assert html_extract.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- leaks


def edited(rng, words, k):
    words = words[:]
    for _ in range(k):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"n{rng.randrange(999)}"] if rng.random() < 0.6 else []
    return words


def brute_edits(item, run):
    """Least edit distance of the item to a part of the run, cell by cell."""
    row = [0] * (len(run) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(run, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    items = [sentence(rng, n) for n in (3, 8, 14, 30, 45, 45)]
    texts = []
    for k in range(120):
        words = sentence(rng, rng.randrange(0, 60)).split()
        if k % 2:
            item = items[k % 6].split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, item, rng.randrange(0, 1 + len(item) // 4))
        texts.append(" ".join(words).upper() if k % 7 == 0 else ", ".join(words))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, "x y z w v"), (9, None), (8, "")], "item_id long, text string")
    got = {(r.doc_id, x.item_id): x.distance for r in decontaminate.with_leaks(docs, bench).collect() for x in r.leaks}
    want = {}
    tokens = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            e = brute_edits(tokens(item), tokens(text))
            if e <= decontaminate.edits(len(tokens(item))):
                want[d, i] = e
    assert len(want) > 20 and got.keys() <= want.keys() and len(got) >= 0.99 * len(want)
    assert all(got[k] == want[k] for k in got)


def at_the_limit(rng, n, kind):
    """An item of n words and a copy with as many edits as it may have."""
    item, k = sentence(rng, n).split(), decontaminate.edits(n)
    run = item[:]
    if kind == "deleted":
        run = [item[i] for i in sorted(rng.sample(range(n), n - k))]
    for place in rng.sample(range(n), k) if kind == "replaced" else []:
        run[place] = sentence(rng, 1, "z")
    for _ in range(k if kind == "inserted" else 0):
        run.insert(rng.randrange(1, len(run)), sentence(rng, 1, "z"))
    return item, run


def recall(n, kind, count, seeds):
    """Of leaks at the limit among other words; without the seeds every window of the text is walked."""
    rng, hits = random.Random(n), 0
    for _ in range(count):
        item, run = at_the_limit(rng, n, kind)
        words = decontaminate.split(pa.array([" ".join([sentence(rng, rng.randrange(30)), *run, sentence(rng, rng.randrange(30))])]))
        found = decontaminate.Items([7], [" ".join(item)])
        hits += 7 in found.leaks(words).get(0, {}) if seeds else found.near(0, words.hash)
    return hits / count


@pytest.mark.parametrize("n", [5, 12, 40, 59, 80, 150])
@pytest.mark.parametrize("kind", ["deleted", "inserted", "replaced"])
def test_recall_at_the_limit(n, kind):
    assert recall(n, kind, 100, True) >= 0.99
    assert recall(n, kind, 40, False) >= 0.97


def test_other_texts_share_no_sample_without_a_word_of_the_item():
    rng = random.Random(10)
    for n in (5, 40, 150):
        items = decontaminate.Items([0], [sentence(rng, n)])
        assert not items.near(0, decontaminate.split(pa.array([sentence(rng, 300, "q")])).hash)


def test_leaks_across_punctuation_and_scripts():
    item = "Élan Vital ПРИВЕТ мир ΑΒΓ straße naïve co\u0301te 漢字 42"
    text = "x “élan”—vital; привет\u2026мир «αβγ» straße\u00a0naïve: co\u0301te、漢字。42! y"
    found = decontaminate.Items([1], [item]).leaks(decontaminate.split(pa.array([text])))
    assert found == {0: {1: (0, 1, 11)}}


def test_leaks_by_blocks_and_of_odd_tables(spark, monkeypatch):
    rng = random.Random(8)
    items = [sentence(rng, 12) for _ in range(9)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(rows([items[k % 9] + " " + sentence(rng, 20) for k in range(18)]), SCHEMA)
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    assert all([x.item_id for x in r.leaks] == [r.doc_id % 9] for r in decontaminate.with_leaks(docs, bench).collect())
    assert decontaminate.with_leaks(odd(spark), bench).filter(F.size("leaks") > 0).count() == 0
    assert decontaminate.with_leaks(empty(spark), bench).count() == 0 and decontaminate.with_leaks(docs, bench.limit(0)).filter(F.size("leaks") > 0).count() == 0
