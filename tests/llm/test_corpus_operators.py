"""Each corpus operator against a brute-force version or an exact round trip, on small tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallweave.llm import annforest, chat, chunkdedup, fingerprint, langid, mixing, neardup, packing, quality, queries, rollups, textkit
from recallweave.llm.common import maybe_in, settle
from recallweave.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def block(*texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_words_and_shingles():
    texts = ["A b c  d\n", "", "x", "x y", "x y z", " \t", "é é é é"]
    values, at = textkit.shingle_hashes(*block(*texts), 3)
    sets = [set(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    wanted = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in map(word_list, texts)]
    assert [len(s) for s in sets] == [len(w) for w in wanted]


def test_language_held_out(spark, docs):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def all_ngrams(text):
    """A run of anything but letters is one space, none at the start; n-grams of all orders, but no lone space."""
    norm = ""
    for c in text:
        if c.isalpha():
            norm += c.lower() if len(c.lower()) == 1 else c
        elif norm and norm[-1] != " ":
            norm += " "
    return [(n, norm[i : i + n]) for n in langid.ORDERS for i in range(len(norm) - n + 1) if n > 1 or norm[i] != " "]


def test_language_filters_against_sets(docs):
    """Counts from masks, less false positives, against exact sets of n-grams; a language has fewer rows than the sample's bound."""
    rows = [(r.text, r.lang) for r in docs.collect() if r.text and r.lang]
    model = langid.fit(docs)
    counts = {k: collections.Counter() for k in model.languages}
    for t, k in rows:
        counts[k].update(all_ngrams(t))
    total = collections.Counter()
    for k, found in counts.items():
        for (n, _), c in found.items():
            total[k, n] += c
    rate = {k: {g: c / total[k, g[0]] for g, c in found.items() if c >= 2e-5 * total[k, g[0]]} for k, found in counts.items()}
    top = collections.defaultdict(float)
    for found in rate.values():
        for g, r in found.items():
            top[g] = max(top[g], r)
    member = {k: {g for g, r in found.items() if r >= 0.4 * top[g]} for k, found in rate.items()}
    reach = [sum(counts[k][g] for g in member[k]) / sum(counts[k].values()) for k in model.languages]
    assert model.reach == pytest.approx(reach, rel=1e-9)
    texts = ["the end", " 12 Zürich, ab", "", "a", "?!", "x", *[t for t, _ in rows[:150]]]
    shares, sizes = model.score(*block(*texts))
    for t, share, size in zip(texts, shares, sizes):
        grams = all_ngrams(t)
        assert size == len(grams)
        for k, name in enumerate(model.languages):
            exact, fp = sum(g in member[name] for g in grams), model.false_positive[k]
            corrected = share[k] * model.reach[k] * max(size, 1)
            assert corrected * (1 - fp) + fp * size >= exact - 1e-6  # a filter forgets nothing
            assert abs(corrected - exact) <= 0.02 * size + 3
    assert all(model.score(*block(t))[0] == pytest.approx(share[None]) for t, share in zip(texts[:20], shares))  # whatever stands beside a text


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(700, 16)), np.repeat(rng.normal(size=(1, 16)), 300, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in annforest.nearest(df, F.col("id") % 100 == 0, sample=500, leaf=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y, hit = x.astype(float), 0
    assert set(got) == set(range(0, 1000, 100))
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(y)), d)) if j != q][:10]
        hit += len(set(order) & {v for v, _ in found})
        assert len(found) == 10 and all(d[v] == pytest.approx(s, abs=1e-12) for v, s in found)
        if q >= 700:
            assert [v for v, _ in found] == order  # copies: ties to the smaller id
    assert hit / 100 >= 0.9


@pytest.mark.parametrize("per_source", [1, 2])
def test_best_fit_is_tightest(per_source):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 60, 300).tolist()
    sources, clusters = rng.integers(0, 6, 300).tolist(), rng.integers(0, 80, 300).tolist()
    bins = packing.best_fit(sizes, sources, clusters, 100, per_source)
    left, held = {}, collections.defaultdict(list)
    for k in sorted(range(300), key=lambda k: -sizes[k]):  # brute force: look at every bin
        able = [b for b in left if left[b] >= sizes[k] and all(clusters[j] != clusters[k] for j in held[b]) and sum(sources[j] == sources[k] for j in held[b]) < per_source]
        want = min(able, key=lambda b: (left[b], b)) if able else len(left)
        assert bins[k] == want
        left[want] = left.get(want, 100) - sizes[k]
        held[want].append(k)


def test_pack_keeps_everything(spark, docs):
    df = docs.unionByName(docs.where("doc_id < 5"))
    rows = packing.pack(df, capacity=128, shard=64).collect()
    tokens = collections.Counter()
    for r in rows:
        tokens[r.doc_id] += r.tokens
    wanted = collections.Counter()
    for r in df.collect():
        wanted[r.doc_id] += len(word_list(r.text))
    assert tokens == wanted
    fill = collections.Counter()
    for r in rows:
        fill[r.shard, r.bin] += r.tokens
    assert max(fill.values()) <= 128


def test_poisson(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit("xxxx").alias("text"))
    rows = mixing.replicate(df, {"a": 3, "b": 1}).groupBy("source").agg(F.count("*").alias("n")).collect()
    n = {r.source: r.n for r in rows}
    assert n["a"] == pytest.approx(15_000, rel=0.03) and n["b"] == pytest.approx(5_000, rel=0.05)
    table = spark.range(1).select(mixing.poisson_table(F.lit(2.5)).alias("c")).first().c
    assert table[0] == pytest.approx(np.exp(-2.5)) and table[-1] == pytest.approx(1)
    big = mixing.replicate(df.where("doc_id < 400"), {"a": 1000, "b": 0}).count()  # rate 4
    assert big == pytest.approx(400, rel=0.15)
    same = lambda d: sorted((r.doc_id, r.copy) for r in mixing.replicate(d, {"a": 3, "b": 1}).select("doc_id", "copy").collect())
    assert same(df) == same(df.repartition(7))


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in fingerprint.edit_probe(docs).collect()}
    texts = dict(sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True))
    ids = list(texts)
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        t, u = texts[a], texts[b]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[a]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == fingerprint.encode(fingerprint.fingerprints([t.encode()])[0])
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited for r in got.values()]) > 0.35 and np.mean([r.near_next for r in got.values()]) < 0.1


def test_phrases_do_not_depend_on_offset():
    rng = np.random.default_rng(5)
    shared = "".join(map(chr, rng.integers(97, 123, 4000)))
    names = [set(fingerprint.phrase_names(*block(x + shared + y))[0].tolist()) for x, y in (("", ""), ("abc" * 7 + "q", "zz"), ("é", "tail"))]
    assert all(len(names[0] & n) / len(names[0] | n) > 0.8 for n in names[1:])
    assert fingerprint.fingerprints([b"", b"a", b"aaaa"])[0].size == 0


def plain_phrases(text, min_span=fingerprint.MIN_SPAN):
    """(name, span) of the kept phrases of all levels, symbol by symbol."""
    full = (1 << 64) - 1
    mixed = lambda x: int(textkit.mix(np.array([x & full], np.uint64))[0])
    seed, place = [int(x) for x in fingerprint._SEED], [int(x) for x in fingerprint._PLACE]
    lowest = lambda x: (x & -x).bit_length() - 1
    symbols, kept, level = [(mixed(ord(c) + seed[2]), 1) for c in text], set(), 0
    while symbols:
        level += 1
        if len(symbols) == 1:
            return kept | set(symbols)
        runs = [(s, len(x := [w for _, w in run]), sum(x)) for s, run in itertools.groupby(symbols, lambda x: x[0])]
        symbols = [(mixed(s + n * seed[0] + level), w) for s, n, w in runs]
        label = [s for s, _ in symbols]
        for toss in range(4):
            beside = [label[0] ^ (full if toss == 0 else 1), *label[:-1]]
            at = [lowest(a ^ b) for a, b in zip(label, beside)]
            label = [2 * i + (a >> i & 1) for a, i in zip(label, at)]
        after = [*label[1:], -1]
        starts = [i for i in range(len(label)) if i == 0 or (label[i] > label[i - 1] and label[i] >= after[i])]
        phrases = [symbols[a:b] for a, b in zip(starts, [*starts[1:], len(symbols)])]
        symbols = [(mixed(mixed_sum(p, place) + len(p) * seed[1]), sum(w for _, w in p)) for p in phrases]
        kept |= {x for x in symbols if x[1] >= min_span}
    return kept


def mixed_sum(phrase, place):
    return sum(s * place[j % len(place)] for j, (s, _) in enumerate(phrase))


def test_parse_against_a_loop():
    rng = np.random.default_rng(8)
    drawn = ["".join(rng.choice(list(letters), n)) for letters, n in (("ab", 300), ("abc ", 900), ("the of\né文", 1500), ("abcdefghijklmnopqrstuvwxyz ", 2000))]
    texts = ["", "a", "aaaa", "ab" * 60, "é𝔘文" * 9 + "zz", *drawn, drawn[0] + drawn[2], "a" * 500 + drawn[1]]
    name, span, doc = fingerprint.phrase_names(*block(*texts))
    for d, t in enumerate(texts):
        assert set(zip(name[doc == d].tolist(), span[doc == d].tolist())) == plain_phrases(t)


def test_rollup(spark, tmp_path):
    r = rollups.TokenRollup(spark, str(tmp_path))
    row = lambda *x: spark.createDataFrame([x], "source string, lang string, tokenizer string, sign int, tokens long, chars long")
    assert r.commit("b/1%", row("s", "en", "t", 1, 10, 50)) and not r.commit("b/1%", row("s", "en", "t", 1, 99, 99))
    r.commit("2", row("s", None, "t", 1, 5, 5).unionByName(row("s", "en", "t", -1, 10, 50)).unionByName(row("s", "en", "t", 1, 7, 50)))
    want = {("s", None, "t", 1, 5, 5), ("s", "en", "t", 1, 7, 50)}
    assert set(map(tuple, r.totals().collect())) == want
    r.compact()
    assert set(map(tuple, r.totals().collect())) == want and not r.commit("2", row("s", "en", "t", 1, 1, 1))
    r.commit("3", row("s", None, "t", -1, 5, 5))
    assert set(map(tuple, r.totals().collect())) == {("s", "en", "t", 1, 7, 50)} and r.batches() == ["2", "3", "b/1%"]


def test_commit_during_compaction(spark, tmp_path, monkeypatch):
    r = rollups.TokenRollup(spark, str(tmp_path))
    row = lambda n: spark.createDataFrame([("s", "en", "t", 1, n, n)], "source string, lang string, tokenizer string, sign int, tokens long, chars long")
    r.commit("1", row(10))
    place, late = r._place, []

    def slow(aside, folder, name):  # the other writer comes after the list was made, before the snapshot is in place
        if folder == "bases" and not late:
            late.append(r.commit("2", row(10)))
        return place(aside, folder, name)

    monkeypatch.setattr(r, "_place", slow)
    assert r.compact() and late == [True]
    assert [x.tokens for x in r.totals().collect()] == [20] and r.batches() == ["1", "2"]
    names, listed = r._names, []

    def between(folder):  # and once more, between the list of snapshots and that of batches
        if folder == "batches" and not listed:
            listed.append(rollups.TokenRollup(spark, str(tmp_path)).commit("3", row(10)))
        return names(folder)

    monkeypatch.setattr(r, "_names", between)
    assert r.compact() and listed == [True]
    assert [x.tokens for x in r.totals().collect()] == [30] and not r.commit("2", row(1)) and not r.commit("3", row(1))


def brute_components(texts, k, percent):
    sets = {i: ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())) for i, w in ((i, word_list(t)) for i, t in texts)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed, n, length=120, edits=6):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(0, edits)):
            w[at] = f"x{rng.integers(0, 9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size", [2048, 12])
def test_near_duplicates(spark, docs, size):
    """A region far larger than its block must lose no link."""
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(family(1, 90) + family(2, 40, 60, 9))] + [(2000, ""), (2001, None), (2002, "a b"), (2003, "A  b")]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words_in_shingle=3, percent=85, block=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_filter_of_keys(spark, n):
    keys = settle(spark.range(n).select((F.col("id") * 7).alias("k")), "keys")
    rows = spark.range(30000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("text"))
    wanted = {7 * i for i in range(1, n)}
    found = [r.k for r in maybe_in(rows, "k", keys).select("k").collect()]
    assert wanted <= set(found) and None not in found and len(found) - len(wanted) < 300
    few = {r.k for r in maybe_in(rows, "k", keys, most_bits=2048).select("k").collect()}
    assert wanted <= few


def test_rows_that_share_an_id(spark):
    """All sets of an id are compared, and are one node."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("a", 200), ("b", 400), ("c", 90)))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, c), (5, c + " c"), (6, a + " " + b), (7, c), (7, c), (None, a), *[(8, f"{c} {c[:i]}") for i in range(3)]]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 4), (7, 4), (8, 4), (8, 4), (8, 4)]
    assert len(got) == len(rows) and all(r.component_id is None and r.kept for r in got if r.doc_id is None)


@pytest.mark.parametrize("size", [2048, 16])
def test_boilerplate_brings_nobody_together(spark, size):
    """Texts of one long boilerplate and bodies of their own share prefixes in every order; only like bodies are linked."""
    rng = np.random.default_rng(11)
    body = lambda k: " ".join(f"v{k}x{i}" for i in range(40))
    plate = " ".join(f"p{i}" for i in rng.integers(0, 900, 110))
    texts = [(i, f"{plate} {body(i % 70 if i < 100 else i)}" + (" end" if i >= 70 else "")) for i in range(160)]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words_in_shingle=3, percent=85, block=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 85)


def test_prefixes_come_longest_first():
    """Every pair comes once, at the length of its common prefix."""
    rng = np.random.default_rng(12)
    sketch = rng.integers(0, 3, (40, neardup.TREES * neardup.DEPTH)).astype(np.uint8)
    table = pa.table({"tree": pa.array([2] * 40, pa.int32()), "id": list(range(40)), "n": [5] * 40, "label": list(range(40)), "sketch": [s.tobytes() for s in sketch], "keys": [[]] * 40})
    own = sketch[:, 2 * neardup.DEPTH : 3 * neardup.DEPTH]
    common = lambda i, j: next((k for k in range(neardup.DEPTH) if own[i, k] != own[j, k]), neardup.DEPTH)
    found = [(i, j) for i, others in neardup._Block(table, 85).candidates() for j in others]
    lengths = [common(i, j) for i, j in found]
    assert len({frozenset(p) for p in found}) == len(found) == 780 and lengths == sorted(lengths, reverse=True)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(root))


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", None), (1, 2, "assistant", "a <\\| b <|im_start|>user\nx"), (1, 3, "user", "<|"), (1, 4, "assistant", "d"), (2, 0, "user", "only"), (3, None, "as%<\n", "𝔘"), (None, 0, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.prefix_target(df)
    parsed = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert [(t.role, t.text) for t in parsed[1].turns] == [(r[2], r[3] or "") for r in rows[:5]] and parsed[1].losses == [rows[2][3], "d"]
    assert [(t.role, t.text) for t in parsed[3].turns] == [("as%<\n", "𝔘")] and parsed[2].losses == [] and [(t.role, t.text) for t in parsed[None].turns] == [("", "n")]
    for e in examples.collect():
        span = e.formatted[e.loss_start : e.loss_start + e.loss_chars]
        assert e.formatted.endswith(span + chat.END) or not e.loss_chars
    assert examples.where("conv_id = 1").count() == 2


def brute_passages(rows, least):
    """Chunks by a plain rolling loop; the stretches of them that stand earlier too, merged."""
    cut_docs = []
    for i, t in sorted(rows):
        raw = t.encode()
        hashes = []
        for upto in range(1, len(raw) + 1):
            h = 0
            for b in raw[max(0, upto - chunkdedup._ROLL) : upto]:
                h = ((h << 1) + int(chunkdedup._GEAR[b])) & 0xFFFFFFFF
            hashes.append(h)
        at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        before = [hashes[s - 1] if s >= chunkdedup._ROLL else 0xFFFFFFFF for s in at]
        starts = {0}
        for k, s in enumerate(at):
            if s >= chunkdedup._ROLL and before[k] == min(before[max(0, k - chunkdedup.REACH) : k + chunkdedup.REACH + 1]):
                starts.add(s)
        starts = sorted(starts)
        starts = [s for s in starts if s < len(raw)]
        cut_docs.append((i, [(s, raw[s:e]) for s, e in zip(starts, [*starts[1:], len(raw)])]))
    seen, out = set(), []
    for i, cut in cut_docs:
        for k, (s, _) in enumerate(cut):
            stretch = b""
            for _, c in cut[k:]:
                stretch += c
                if len(word_list(stretch.decode())) >= least:
                    break
            else:
                continue
            if stretch in seen:
                if out and out[-1][0] == i and out[-1][2] >= s:
                    out[-1][2] = s + len(stretch)
                else:
                    out.append([i, s, s + len(stretch)])
            seen.add(stretch)
    return sorted((i, s, e - s) for i, s, e in out)


def test_chunk_dedup_against_a_loop(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))
    passage, other = word(70), word(60)
    rows = [(1, word(80) + " " + passage + " " + word(50)), (2, word(33) + " " + passage + " " + word(9)), (3, word(120)), (4, passage + " x " + other), (5, other + " " + word(30) + " " + other), (6, ""), (8, "again " * 90), (9, word(5) + " again" * 80)]
    df = spark.createDataFrame([*rows, (7, None)], "doc_id long, text string")
    got = sorted((r.id, r.start, r.chars) for r in chunkdedup.repeated_passages(df).collect())
    want = [w for w in brute_passages(rows, chunkdedup.MIN_WORDS)]
    assert got == want and {g[0] for g in got} == {2, 4, 5, 8, 9}
    kept = {r.doc_id: r.text for r in chunkdedup.remove_repeated(df).collect()}
    assert kept[1] == rows[0][1] and kept[3] == rows[2][1] and kept[7] is None and kept[6] == ""
    assert len(kept[2]) < 400 and passage[150:300] not in kept[2]


def test_passages_by_length(spark):
    """Recall of passages of random words that stand in two documents, by length; no other word is marked but by chance at an end."""
    rng = np.random.default_rng(12)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(3000)]
    share = 1 / np.arange(1, 3001)
    word = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    lengths, rows = (15, 25, 28, 30, 40, 60), []
    for n in lengths:
        for _ in range(100):
            passage = word(n)
            rows += [(2 * len(rows), f"{word(40)} {passage} {word(37)}", n), (2 * len(rows) + 1, f"{word(33)} {passage} {word(45)}", n)]
    rows = [(i, t, n) for i, (_, t, n) in enumerate(rows)]
    found = {r.id: r.words for r in chunkdedup.repeated_passages(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert all(i % 2 for i in found)  # the first of the two stays whole
    recall = {n: sum(i in found for i, _, m in rows[1::2] if m == n) / 100 for n in lengths}
    assert recall[15] == 0 and recall[25] >= 0.6 and recall[28] >= 0.9 and min(recall[n] for n in (30, 40, 60)) >= 0.98, recall
    marked = {n: sum(found.get(i, 0) for i, _, m in rows[1::2] if m == n) / (100 * n) for n in lengths}
    assert marked[30] > 0.8 and marked[60] > 0.9 and all(found[i] <= n + 2 for i, _, n in rows if i in found), marked


def test_passages_of_shared_and_missing_ids(spark):
    """Different texts under one id, or under none, are documents of their own; no other text is cut."""
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))
    p, q, r = word(70), word(70), word(70)
    clean = [word(90) for _ in range(700)]
    texts = [(None, word(30) + " " + p), (None, word(31) + " " + p), (7, word(32) + " " + q), (7, word(33) + " " + q), (7, word(33) + " " + q), (1, word(9) + " " + r), (None, r + " " + word(8))]
    df = spark.createDataFrame([*texts, *[(None, t) for t in clean], *[(7, t) for t in clean[:50]]], "doc_id long, text string")
    kept = [(x.doc_id, x.text) for x in chunkdedup.remove_repeated(df).collect()]
    held = lambda passage: sum(passage in t for _, t in kept)
    assert len(kept) == 757 and held(p) == 1 and held(r) == 1 and held(q) in (1, 2)  # q's texts 4 and 5 are one document
    assert sum(passage[120:300] in t for _, t in kept for passage in (p, q, r)) == held(p) + held(q) + held(r)
    assert (1, texts[5][1]) in kept and {(7, t) for t in clean[:50]} | {(None, t) for t in clean[50:]} <= set(kept)
    assert not any(t == c and i is None for c in clean[:50] for i, t in kept)  # the id comes first


def plain_kind(c):
    if chr(c).isascii() and chr(c).isalnum():
        return 0 if chr(c).isupper() else 1 if chr(c).islower() else 2
    for kind, chars in ((3, b" \t\r\x0b\x0c"), (4, b"\n"), (5, b".,;:'\"-()"), (6, b"!?"), (7, b"|/\\_=<>[]{}")):
        if c in chars:
            return kind
    return 8 if 0x21 <= c < 0x7F or c < 9 else 9


def plain_statistics(text):
    raw = text.encode()
    low = raw.lower()  # of ASCII
    share = lambda a, b: a / max(b, 1)
    kinds = collections.Counter(map(plain_kind, raw))
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    n, size = len(spans), [b - a for a, b in spans]
    mean = share(sum(size), n)
    words = collections.Counter(low[a:b] for a, b in spans)
    sets = [[plain_kind(c) for c in raw[a:b]] for a, b in spans]
    letters = [sum(k in (0, 1, 9) for k in s) for s in sets]
    pairs = {low[a : spans[i + 1][1]] for i, (a, _) in enumerate(spans[:-1])}
    lines = [x for x in low.split(b"\n") if x]
    return [
        np.log1p(len(raw)), np.log1p(n), *[share(kinds[k], len(raw)) for k in range(10)], mean, np.sqrt(max(share(sum(x * x for x in size), n) - mean**2, 0)), len(words) / np.sqrt(max(n, 1)), share(len(words), n),
        share(max(words.values(), default=0), n), share(sum(m > 0 and s.count(0) == m and len(s) > 1 for s, m in zip(sets, letters)), n), share(sum(any(k in (6, 7, 8) for k in s) for s in sets), n), share(letters.count(0), n),
        share(len(pairs), n - 1) if n > 1 else 0, np.log1p(len(lines)), share(len(set(lines)), len(lines)), np.log1p(share(len(raw), len(lines))),
    ]


def test_statistics_against_a_loop(docs):
    texts = ["", " ", "a", "A B", "NASA nasa Nasa!", "x\n\nx\ny", "\n", "12 | <b> é文\x01\x7f\t.", "a b a b a b", *[r.text or "" for r in docs.limit(150).collect()], ""]
    assert quality.block_statistics(*block(*texts)) == pytest.approx(np.array([plain_statistics(t) for t in texts]), abs=1e-9)


def test_isotonic():
    x, y = np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.0])
    _, v = quality.isotonic(x, y)
    assert v.tolist() == pytest.approx([0, 0.5, 2 / 3]) and quality.isotonic(np.zeros(3), np.array([1.0, 0, 0]))[1].tolist() == pytest.approx([1 / 3])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_normal_equations_by_fold(spark, docs):
    """The partition-summed fit equals ridge regression on all rows at once."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    measured = settle(docs.select("doc_id", quality.statistics(F.col("text")).alias("stats")), "stats")
    model = quality.fit(measured, labels, features=32)
    p = measured.join(labels, "doc_id").toPandas()
    z, y = model.features(np.array(p.stats.tolist())), p.quality.to_numpy(float)
    w = np.linalg.solve(z.T @ z + 1e-3 * len(y) / 32 * np.diag([1e-6] + [1.0] * 32), z.T @ y)
    assert model.weights == pytest.approx(w, rel=1e-5, abs=1e-6)
