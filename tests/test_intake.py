"""Texts to tables in one call, contexts put together, sources found in listings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallweave.functions import vectors
from recallweave.operators import assist, intake, workflows
from recallweave.operators.counters import Counters
from recallweave.sources import discovery
from recallweave.sources.store import TableStore

TEXT = "id string, content string, summary string, memory_type string, importance double, timestamp long"


def embed(c):
    return vectors.hash_embedding(c, 32)


def texts(spark, *rows):
    return spark.createDataFrame([(i, c, s, "semantic", 0.5, n) for n, (i, c, s) in enumerate(rows)], TEXT)


ROWS = [
    ("a", "the river runs to the sea in the north", None), ("b", "the river runs to the sea in the south", None), ("c", "a summary stands for this long text", "the river runs to the sea in the north"),
    ("a", "a second text that has the first one's name", None), (None, "a text without a name of its own", None), (None, "a text without a name of its own", None), ("d", "  short ", None), ("e", None, None), (None, None, None), ("f", "", ""),
]


def state(store):
    return {t: sorted(map(str, store.read(t, k).select(*c).collect())) for t, k, c in (("memories", ["id"], ["id", "content"]), ("nodes", ["id"], ["id"]), ("edges", ["src", "dst"], ["src", "dst"]), ("hyperedges", ["src"], ["src", "members"]))}


def test_texts_become_memories_once(spark, tmp_path):
    store, counts = TableStore(spark, str(tmp_path / "s")), Counters(spark)
    told = intake.remember_texts(store, texts(spark, *ROWS), counts, embed, above=0.7)
    assert told == {"created": 4, "skipped": 3}  # rows without id and content are none
    kept = {r.id: r for r in store.read("memories", ["id"]).collect()}
    assert kept["a"].content == ROWS[0][1] and kept["c"].content == ROWS[2][1] and len(kept) == 4
    assert np.allclose(kept["a"].vector, kept["c"].vector)  # the summary's vector, the whole content
    assert {(r.src, r.dst) for r in store.read("edges", ["src", "dst"]).collect()} == {(x, y) for x in "abc" for y in "abc" if x != y}
    before = state(store)
    assert intake.remember_texts(store, texts(spark, *ROWS), counts, embed, above=0.7) == {"created": 0, "skipped": 7}
    assert state(store) == before
    assert intake.remember_texts(store, texts(spark, *ROWS).limit(0), counts, embed) == {"created": 0, "skipped": 0}
    assert state(store) == before


@pytest.mark.parametrize("stopped", ["arrivals", "edges", "hyperedges", "nodes"])
def test_a_call_that_stopped_is_made_good(spark, tmp_path, stopped):
    whole = TableStore(spark, str(tmp_path / "w"))
    intake.remember_texts(whole, texts(spark, *ROWS), Counters(spark), embed, above=0.7)
    store = TableStore(spark, str(tmp_path / "s"))
    upsert = store.upsert

    def fail(table, rows):
        version = upsert(table, rows)
        if table == stopped:
            raise OSError("lost")
        return version

    store.upsert = fail
    with pytest.raises(OSError):
        intake.remember_texts(store, texts(spark, *ROWS), Counters(spark), embed, above=0.7)
    store.upsert = upsert
    assert intake.remember_texts(store, texts(spark, *ROWS), Counters(spark), embed, above=0.7) == {"created": 4, "skipped": 3}
    assert state(store) == state(whole)


def test_edges_by_the_callers_index(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))

    def near(own, both):
        return own.select(F.col("id").alias("src")).crossJoin(both.where("id = 'b'").select(F.col("id").alias("dst"))).where("src <> dst").withColumn("similarity", F.lit(0.9))

    intake.remember_texts(store, texts(spark, *ROWS[:3]), Counters(spark), embed, near=near)
    assert {(r.src, r.dst) for r in store.read("edges", ["src", "dst"]).collect()} == {("a", "b"), ("c", "b")}


PARTS = "source string, rank int, head string, similarity double, content string"


def test_context_has_its_parts_in_order(spark):
    parts = spark.createDataFrame([("file", 1, "n (p)", 0.9, "body"), ("email", 2, "Subject: b", 0.1, ""), ("email", 1, "Subject: a", 0.2, "mail"), ("system", 1, "[pdf] x: y", 0.0, None), ("other", 1, "no", 0.0, "no")], PARTS)
    got = intake.assembled(parts).first().context
    mail, system, file = (intake.SECTIONS[s] for s in ("email", "system", "file"))
    assert got == mail[0] + "1. Subject: a\n   Content: mail\n\n2. Subject: b\n\n" + mail[1] + system[0] + "1. [pdf] x: y\n" + system[1] + file[0] + "1. n (p)\nbody\n\n" + file[1]


def test_thinking_without_parts_or_memories(spark):
    hits = spark.createDataFrame([("m", 0.5, "known")], "id string, similarity double, content string")
    none = spark.createDataFrame([], PARTS)
    said = intake.think(hits, none).first()
    assert (said.context, said.confidence, said.memories) == ("", 0.5, 1) and said.response.endswith("known")
    assert intake.think(hits.limit(0), none).first().memories == 0
    assert "body" in intake.think(hits, spark.createDataFrame([("file", 1, "n", 0.9, "body")], PARTS)).first().response


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_vaults_are_found_in_the_usual_order(spark):
    at = lambda *p, o=None: [r.root for r in discovery.find_vault(listing(spark, *p), "/h", o).collect()]
    assert at("/h/vaults/z/.obsidian/a", "/h/vaults/k/.obsidian/a", "/h/vaults/k/.obsidian/b") == ["/h/vaults/k"]
    assert at("/h/vaults/k/.obsidian/a", "/h/Obsidian/.obsidian/a") == ["/h/Obsidian"]
    assert at("/h/vaults/k/.obsidian/a", "/x/.obsidian/a", o="/x/") == ["/x"]
    assert at("/h/vaults/k/.obsidian/a", o="/x") == ["/h/vaults/k"]
    assert at("/h/vaults/k/deep/.obsidian/a", "/h/vaultsk/.obsidian/a", "/h/vaults/.obsidian", None) == []


def test_notes_of_a_vault(spark):
    deep = "/h/Obsidian/" + "d/" * 9 + "n.md"
    paths = ["/h/Obsidian/a.md", "/h/Obsidian/b/c.md", deep, deep.replace("n.md", "e/n.md"), "/h/Obsidian/.x/c.md", "/h/Obsidian/templates/t.md", "/h/Obsidian/b/node_modules/t.md", "/h/Obsidian2/c.md", "/h/Obsidian/c.txt", None]
    rows = discovery.vault_notes(listing(spark, *paths), listing(spark, "/h/Obsidian").select(F.col("path").alias("root")))
    assert {r.relative for r in rows.collect()} == {"a.md", "b/c.md", "d/" * 9 + "n.md"}
    notes = spark.createDataFrame([("a.md", "---\ntags: [x, y]\n---\n" + "a long enough body", 1), ("b.md", " ".join(f"w{i}" for i in range(900)), 2), ("c.md", "short", 3), ("d.md", None, 4), ("e/e.md", "a body without any tags", None)], "relative string, text string, timestamp long")
    made = sorted((r.timestamp or 0, r.summary, len(r.content.split())) for r in discovery.vault_texts(notes).collect())
    assert made[0] == (0, "e: a body without any tags", 5) and made[1][0] == 2 and made[-1][:1] == (2,)
    assert [(m[1], m[2]) for m in made if m[0] == 2][:2] == [("b (part 2)", 400), ("b (part 3)", 200)] and made[-1][2] == 400


def test_profiles_and_folders(spark):
    base = f"/h/{discovery.APPLICATION_SUPPORT}/Google/Chrome"
    rows = discovery.browser_profiles(listing(spark, f"{base}/Default/History", f"{base}/Profile 2/History", f"{base}/Profile 2/History", f"{base}/Guest/History", f"{base}/Default/x/History", base, None), "/h")
    assert sorted((r.browser, r.profile) for r in rows.collect()) == [("Chrome", "Default"), ("Chrome", "Profile 2")]
    named = spark.createDataFrame([("~/a/",), ("/h/a",), ("~",), ("/",), ("",), (None,), ("~b",)], "folder string")
    assert sorted(r.folder for r in discovery.watched(named, listing(spark, "/h/a/x", "/h/c/y.md", None), "/h").collect()) == ["/", "/h", "/h/a", "/h/c", "~b"]


def test_topics_are_files_in_order(spark, tmp_path):
    rows = [("a", f"m{n:03d}", f"text {n}\nsecond line", 1000 - n) for n in range(60)] + [("b c/d", "x", "one", 1), (None, "y", "two", 2), ("1", "z", "", None), ("a", "gone", None, 5)]
    memories = spark.createDataFrame(rows, "t string, id string, content string, timestamp long")
    workflows.write_topics(memories, "t", str(tmp_path / "t"), 7)
    files = sorted((tmp_path / "t" / "topic=a").glob("part-*"))
    assert len(files) >= 9 and all(f.read_text().count("### ") <= 7 for f in files)
    want = assist.topic_text(memories.where("content is not null and t = 'a'"), "t").first().body
    assert "".join(f.read_text() for f in files).rstrip("\n") == want.rstrip("\n")
    got = sorted((r.topic or "", r.id, r.content) for r in workflows.read_topics(spark, str(tmp_path / "t")).collect())
    assert got == sorted((t or "", i, c) for t, i, c, _ in rows if c is not None)


def test_clipboard_is_remembered_once(spark, tmp_path):
    store, counts = TableStore(spark, str(tmp_path / "s")), Counters(spark)
    copied = spark.createDataFrame([("old", 1), ("x", 2), ("y" * 150, 2), ("", 3), (None, 4)], "content string, timestamp long")
    first, again = (workflows.remember_clipboard(store, copied, counts, embed).first() for _ in range(2))
    assert first == again and first.preview == "y" * 100 and store.read("memories", ["id"]).count() == 1
    kept = store.read("memories", ["id"]).first()
    assert (kept.memory_type, kept.importance, kept.content) == ("Working", 0.6, "y" * 150)
    assert not workflows.remember_clipboard(store, copied.where("content = ''"), counts, embed).first().success
