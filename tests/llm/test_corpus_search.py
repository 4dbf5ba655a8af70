"""Importance resampling, page text and ranked search against brute force, and their odd inputs."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from html import unescape
from zlib import crc32

import numpy as np
import pytest

from recallweave.llm import htmltext, maxtree, resample
from recallweave.llm.htmltext import Page
from recallweave.llm.terms import KEPT, coded_counts, windows

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"Word{i % 977} und das É-Tier" for i in range(30_000))


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def odd_documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", *[f"'extra' AS {c}" for c in "id row own body chunk bucket n term tf item item_id rank score place path paths host".split()])


ODD = [(1, "Aa bb aa cc"), (1, "Aa bb aa cc"), (2, None), (3, ""), (None, "bb É 文字 dd"), (4, LONG), (5, LONG + " tail"), (6, "!? --"), (7, "bb"), (8, "aa aa aa bb"), (9, "a\x00b\x7fc"), (None, None)]


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_resample_equals_brute_force(spark, rows, n):
    targets = ["aa bb", None, "dd 文字 und das", ""]
    got = resample.resample(odd_documents(spark, rows), spark.createDataFrame([(t,) for t in targets], "text string"), n=n, buckets=50, percent=40, least_words=1, long=700).collect()

    def features(text):
        w = terms(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return crc32(f.encode()) % 50

    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([r[1] for r in rows], targets))
    S, T = sum(s.values()) + 50, sum(t.values()) + 50
    gain = [math.floor(1000 * math.log(((t[b] + 1) * S) / ((s[b] + 1) * T))) for b in range(50)]
    want = []
    for key, text in rows:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        want.append((key, len(terms(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    eligible = sorted((-w[4], -1 if w[0] is None else w[0]) for w in want if w[1] >= 1)
    drawn = sorted((r["rank"], -r.score, -1 if r.id is None else r.id) for r in got if r["rank"])
    assert drawn == [(i + 1, *e) for i, e in enumerate(eligible[: len(eligible) * 40 // 100])]


def test_chunks_own_each_start_once():
    text = LONG.encode().translate(KEPT)
    for n, size in ((1, 50), (3, 64), (5, 1), (3, 10**9)):
        found = [f for own, body in resample.chunks(text, n, size) for f in resample.features(body.split(), own, n)]
        assert Counter(found) == Counter(resample.features(text.split(), len(text.split()), n))
    assert list(resample.chunks(b"", 2)) == [] and b"".join(text[a:b] for a, b in windows(text, 7)) == text


def test_long_texts_are_counted_in_windows():
    import pyarrow as pa

    texts = ["one two two", None, "x " * 900_000 + "y", ""]
    n, row, code, count = coded_counts(pa.array(texts), lambda words: np.array([{b"x": 0, b"y": 1, b"two": 2}.get(w, -1) for w in words], np.int64), 3)
    assert n.tolist() == [3, 0, 900_001, 0]
    assert list(zip(row.tolist(), code.tolist(), count.tolist(), strict=True)) == [(0, 2, 2), (2, 0, 900_000), (2, 1, 1)]


def by_hand(rows, items, k=10, b=90):
    docs = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in rows) if w]
    n, total = len(docs), sum(d[2] for d in docs)
    asked, df = {}, Counter(t for d in docs for t in d[1])
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, words in asked.items():
        scores = []
        for d, tf, length in docs:
            m = 100 - b + b * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in words if tf[w])
            if s > 0:
                scores.append((-s, -(2**63) if d is None else d))
        out += [(i, r + 1, None if d == -(2**63) else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_search_equals_brute_force(spark, rows):
    items = [(1, "aa und"), (1, "TAIL bb"), (2, None), (3, "no such words"), (None, "文字 aa"), (4, ""), (5, "bb bb")]
    got = maxtree.search(odd_documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), k=3).collect()
    assert sorted(str(tuple(r)) for r in got) == by_hand(rows, items, 3)


def test_search_of_many_documents_in_blocks_with_floors(spark, monkeypatch):
    """Several blocks of items, a sample for floors, several shards and many ties."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    rows = [(i % 2500, " ".join(rng.choices(words, k=rng.choice((1, 3, 3, 40))))) for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(40)]
    monkeypatch.setattr(maxtree, "TERMS", 60)
    monkeypatch.setattr(maxtree, "SAMPLE", 200)
    got = maxtree.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == by_hand(rows, items)


def test_max_tree_opens_few_leaves_and_all_ties():
    rng = np.random.default_rng(3)
    n, per, width = 4096, 12, 500
    term = np.sort((rng.pareto(0.7, (n, per)) * 5).astype(np.int64) % width, axis=1)
    share = rng.integers(1, 50, n * per)
    keep = np.append(True, term.ravel()[1:] != term.ravel()[:-1]) | (np.arange(n * per) % per == 0)
    lengths = keep.reshape(n, per).sum(axis=1)
    shard = maxtree.Shard(rng.permutation(n), lengths, term.ravel()[keep], share[keep])
    opened = 0
    for _ in range(30):
        terms = np.unique(rng.integers(20, width, 5))
        weight = rng.integers(1, 9, len(terms))
        by_term = np.zeros(width, np.int64)
        by_term[terms] = weight
        scores = np.bincount(np.repeat(np.arange(n), lengths), by_term[shard.term] * shard.share, minlength=n).astype(np.int64)
        want = sorted((-s, d) for s, d in zip(scores.tolist(), shard.ids.tolist(), strict=True) if s > 0)[:10]
        best = []
        opened += shard.search(terms, weight, by_term, best, 10, 0)
        assert sorted((-s, -d) for s, d in best) == want
        again = []
        shard.search(terms, weight, by_term, again, 10, -want[-1][0])
        assert sorted(again) == sorted(best)
    assert opened < 30 * n / maxtree.LEAF / 4


def test_text_of_the_given_pages(spark):
    """An article element stands in every one: its blocks, by patterns of their own."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in htmltext.main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?[bi]>", "", inner))).split())
        assert r.text == want and r.n_chars == len(want)


SHELL = "<html><head><title>t</title></head><body><div class='top'>{top}</div><div class='c{n}'>{body}</div><div class='low'>{low}</div></body></html>"


def test_hosts_decide_where_a_page_does_not(spark):
    """The article of the last page is shorter than what stands below it; the host's other pages tell which is which."""
    text = "<p>A sentence of some length, as articles have them, stands here.</p>"
    pages = [(i, "http://a.example/x", SHELL.format(n=i, top="<a href=x>Home</a>", body=text * 4, low=f"<p>Seen {i} times.</p>")) for i in range(9)]
    odd = SHELL.format(n=9, top="", body="<p>Short news.</p>", low=text * 3)
    pages += [(9, "http://u@A.example:80/y", odd), (10, None, odd), (11, "http://b.example/", None), (12, "no url", ""), (9, "http://a.example", odd)]
    got = htmltext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    plain = re.sub("<[^>]*>", "", text)
    assert sorted((r.page_id, r.text) for r in got) == [(i, " ".join([plain] * 4)) for i in range(9)] + [(9, "Short news."), (9, "Short news."), (10, " ".join([plain] * 3)), (11, ""), (12, "")]
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ("<nav>Menu</nav><article><h1>T</h1><p>Hello <b>wor</b>ld &amp; you<br>there<p>next&nbsp; one &#65;&eacute;</article><footer>f</footer>", "T Hello world & you there next one Aé"),
        ("<main><header>By me</header><p>One</p><aside>side</aside><div class='ad-box'>buy</div><div id=cookieNotice>we use</div><form><input>send</form><p>Two</p></main>", "One Two"),
        ("<article><p>Text</p></article><section id='comments'><article><p>Reader says a lot, and more, and more than the text.</p></article></section>", "Text"),
        ("<div class='wrap has-sidebar'><article><p>Kept</p></article></div>", "Kept"),
        ("<header><article><p>Kept in a header</p></article>x</header>", "Kept in a header"),
        ("<article><script>var t='</p>';</script><style>p{}</style><p>x<!-- no --> y</p><p hidden>h</p><p style='display: none'>n</p></article>", "x y"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a b c d e"),
        ("<article><p title='a>b'>q</p><p data=\"<p>\">r", "q r"),
        ("<article>kept <!-- open <p>lost", "kept"),
        ("<article>a < b &amp c &am", "a < b & c &am"),
        ("plain words only", "plain words only"),
        ("<nav><p>nothing else</p></nav>", ""),
        ("", ""),
    ],
)
def test_pages_by_hand(html, want):
    assert Page(html).text([]) == want


def test_any_cut_and_any_depth_end():
    html = "<div><nav class='m'><ul><li><a href='x'>y</a></ul></nav><article id=\"k\"><!-- c --><p>text &amp; more</p><script>s</script></article></div>"
    for i in range(len(html) + 1):
        Page(html[:i]).text(["html>div>article"])
    assert Page("<div>" * 50_000 + "<b>" * 50_000 + "deep" + "</p>" * 50_000).text([]) == "deep"
    assert Page("<i class='a1'><b class='b2'>" * 50_000 + "deep").text([]) == "deep"
