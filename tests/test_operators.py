import numpy as np
import pytest
from pyspark.sql import functions as F

from recallweave.functions import labels, text, vectors
from recallweave.operators import chunking, graph, learning, lifecycle, records, search
from recallweave.sources import connectors, files
from recallweave.sources.store import TableStore


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_vector_kernels(spark):
    a, b = F.array(*map(F.lit, [1.0, 0.0, 0.0])), F.array(*map(F.lit, [0.0, 1.0, 0.0]))
    row = spark.range(1).select(vectors.cosine(a, a), vectors.cosine(a, b), vectors.cosine(a, F.array(F.lit(1.0))), vectors.normalize(F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert row[0] == 1 and row[1] == 0 and row[2] == 0 and row[3] == pytest.approx([0.6, 0.8])


def test_hash_embedding(spark):
    df = spark.createDataFrame([("cat",), ("cat",), ("automobile racing championship",), ("",), (None,)], "t string")
    e = [r[0] for r in df.select(vectors.hash_embedding(F.col("t"), 384)).collect()]
    assert len(e[0]) == 384 and np.dot(e[0], e[1]) == pytest.approx(1) and np.dot(e[0], e[2]) < 0.95 and not any(e[3]) and e[4] is None


def loop_chunks(words, size, overlap):
    """Windows as a loop makes them: stop when what is left is no more than half the overlap."""
    if len(words) <= size:
        return [words] if words else []
    step, out, at = max(size - overlap, 1), [], 0
    while at < len(words):
        out.append(words[at : at + size])
        at += step
        if at + overlap // 2 >= len(words):
            break
    return out


@pytest.mark.parametrize("n", [0, 1, 29, 30, 31, 49, 50, 55, 56, 100, 333])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = spark.createDataFrame([(1, " \n".join(words))], "id int, t string")
    rows = [r.chunk.split(" ") for r in chunking.chunk(got, "t", 30, 10).orderBy("chunk_index").collect()]
    assert rows == loop_chunks(words, 30, 10)


def test_paragraphs(spark):
    t = "one two\n\nthree four\n\nfive six"
    assert one(spark, chunking.paragraphs(F.col("t"), 100), t=t) == [t]
    assert len(one(spark, chunking.paragraphs(F.col("t"), 3), t=t)) == 3


def test_text_functions(spark):
    assert one(spark, text.clean_text(F.col("t")), t="  hello  \n\n\n  world  \n  ") == "hello\nworld"
    assert one(spark, text.strip_markup(F.col("t")), t="<p>Hello <b>world</b></p><script>x</script>") == "Hello world"
    assert one(spark, text.strip_markup_compat(F.col("t")), t="a<script>x</script>b") == "a"
    assert one(spark, text.rfc822_text(F.col("t")), t="From: a\nX: y\nSubject: s\n\nline\n\nlast") == "From: a\nSubject: s\nline\nlast"
    assert one(spark, text.emlx_text(F.col("t")), t="99\nFrom: a\n\nhi\n<?xml ?>") == "From: a\nhi"
    assert one(spark, text.sender_name(F.col("t")), t='"Ann Lee" <a@b>') == "Ann Lee"
    assert one(spark, text.project_from_title(F.col("t")), t="main.py - tool — proj1 [x]") == "proj1"
    assert one(spark, text.path_in_title(F.col("t")), t="vim /etc/hosts now") == "/etc/hosts"
    assert one(spark, text.metadata_value(F.col("t"), "kTitle"), t='kOther = "a"\nkTitle   = "b c"') == "b c"
    assert one(spark, text.frontmatter_tags(F.col("t")), t="---\ntags:\n- a\n---\nbody") == []
    assert one(spark, text.transcript_line(F.col("t")), t='{"message":{"role":"user","content":[{"text":"hi"},{"text":""}]}}') == "User: hi\n\n"
    assert one(spark, text.transcript_line(F.col("t")), t='{"role":"assistant","content":"yo"}') == "Assistant: yo\n\n"
    assert one(spark, text.transcript_line(F.col("t")), t="not json") is None


def test_admission_and_types(spark):
    cases = {"/a/b.rs": True, "/a/b.exe": False, "/a/.b.rs": False, "/a/node_modules/b.rs": False, "/u/Library/Caches/b.md": False, "/u/Library/Mobile Documents/Caches/b.md": True}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", labels.should_index(F.col("p"), F.lit(10)).alias("ok"), labels.should_index(F.col("p"), F.lit(1 << 21)).alias("big"))
    assert {r.p: r.ok for r in df.collect()} == cases and not any(r.big for r in df.collect())
    assert one(spark, labels.memory_type(F.col("t")), t="HowTo") == "Procedural"
    assert one(spark, labels.exact_memory_type(F.col("t")), t="goal") == "Semantic"


def test_recall_and_lifecycle(spark):
    m = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0], "Semantic", 0.8, 0.0, 0, 1), ("b", [0.0, 1.0, 0.0, 0.0], "Goal", 0.1, 0.95, 1, 2)], "id string, vector array<double>, memory_type string, importance double, decay double, access_count long, timestamp long")
    q = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],)], "q array<double>")
    hits = search.recall(m, q, 5).collect()
    assert [h.id for h in hits] == ["a"] and hits[0].similarity > 0.99
    assert [r.id for r in lifecycle.consolidate(m).collect()] == ["a"]
    assert {r.id: r.decay for r in lifecycle.apply_access(m, spark.createDataFrame([("b",), ("b",)], "id string")).collect()} == {"a": 0.0, "b": 0.0}
    assert lifecycle.evict(m, 10).count() == 2 and lifecycle.evict(m, 1).count() == 1


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], "src string, dst string, similarity double")
    hop = lambda n: {r.id for r in graph.k_hop(e, spark.createDataFrame([("a",)], "id string"), n).collect()}
    assert hop(0) == set() and hop(1) == {"b"} and hop(2) == {"b", "c"}
    h = spark.createDataFrame([("x", "y", 0.9), ("x", "z", 0.8), ("y", "x", 0.9)], "src string, dst string, similarity double")
    assert [r.members for r in graph.hyperedges(h).collect()] == [["x", "y", "z"]]


def test_index_recall_and_tombstones(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    index = search.InvertedFileIndex(df, 8, folder=str(tmp_path))
    probed = index.search(x[0].tolist(), 10, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in probed and search.InvertedFileIndex(df, 8).search(x[0].tolist(), 10, 5).collect() == index.search(x[0].tolist(), 10, 5).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found, wanted = 0, 0
    for i in range(5):
        best = {f"v{j}" for j in np.argsort(-(unit @ unit[i]))[:10]}
        got = [r.id for r in index.search(x[i].tolist(), 10, 5).collect()]
        assert got[0] == f"v{i}"
        found, wanted = found + len(best & set(got)), wanted + 10
    assert found / wanted >= 0.8
    assert index.delete(spark.createDataFrame([("v0",)], "id string")).search(x[0].tolist(), 3, 8).where("id = 'v0'").count() == 0


def test_pairs_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    df = spark.createDataFrame([(f"v{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    key = lambda d: sorted((r.src, r.dst, round(r.similarity, 9)) for r in d.collect())
    assert key(search.pairs_above(df, 3, 0.2, block=7)) == key(search.pairs_above(df, 3, 0.2))


def test_compression_tiers(spark):
    m = spark.createDataFrame([(90,), (50,), (5,)], "access_count long")
    tiers = m.select(F.when(F.col("access_count") / 100 > 0.8, "hot").when(F.col("access_count") / 100 > 0.4, "warm").otherwise("cold").alias("t")).groupBy("t").count()
    assert {r["t"]: r["count"] for r in tiers.collect()} == {"hot": 1, "warm": 1, "cold": 1}
    assert lifecycle.compression(m).first().savings_percent > 0


def test_store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path))
    s.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    s.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    s.delete("t", spark.createDataFrame([(1,)], "id int"))
    state = lambda: sorted(map(tuple, s.read("t", ["id"]).collect()))
    assert state() == [(2, "c"), (3, "d")]
    s.compact("t", ["id"])
    assert state() == [(2, "c"), (3, "d")]
    s.replace_where("t", ["id"], "v", spark.createDataFrame([(9, "d")], "id int, v string"))
    assert state() == [(2, "c"), (9, "d")]


def test_files(spark, tmp_path):
    for name, body in {"a.md": "# hi \n\n there", "b.html": "<p>x > y</p>", "node_modules/c.md": "no", "d.exe": "no", "m.eml": "From: a\n\nbody"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.parsed(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.md": "# hi\nthere", "b.html": "x  y", "m.eml": "From: a\nbody", "bad.txt": None}


def test_registry(spark):
    r = connectors.default_registry()
    assert len(r.select()) == 14 and [c.name for c in r.select(["vault", "chat"], {"chat": False})] == ["vault"]
    notes = spark.createDataFrame([("n1", "---\ntags: [a]\n---\nsome note of enough length", 1), ("n2", "x", 2)], "path string, text string, timestamp long")
    empty = spark.createDataFrame([], "id string")
    new, stats = r.run({"vault": (notes,)}, empty, ["vault"])
    assert new.count() == 1 and stats.first().created == 1
    again, stats = r.run({"vault": (notes,)}, new.select("id"), ["vault"])
    assert again.count() == 0 and stats.first().skipped == 1


def test_records(spark):
    raw = spark.createDataFrame([("1␞s␞f␞d␞INBOX␞acc␞b␟bad␞x␟",)], "t string")
    assert [r.subject for r in records.mail_records(raw, "t").collect()] == ["s"]
    note = spark.createDataFrame([("<<<NOTE_START>>>\nID: 7\nTITLE: T\nFOLDER: F\nBODY: b1\nb2\n<<<NOTE_END>>>",)], "t string")
    assert tuple(records.notes(note, "t").first()) == ("7", "T", "F", "b1\nb2")
    sample = learning.weighted_sample(spark.range(100).withColumn("w", F.lit(1.0)), 10, "w", "id")
    assert sample.distinct().count() == 10
