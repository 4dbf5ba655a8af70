"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing extra columns."""

import base64
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recallweave.llm import annforest, chat, chunkdedup, fingerprint, langid, mixing, neardup, packing, quality, queries, rollups

EXTRA = "id t k b n rep place size first copy copies bin cluster tokens component kept block label tag digest score base deep sketch".split()
LONG = " ".join(f"word{i % 977} and the ounce of it" for i in range(40_000))
ROWS = [
    (1, "The ounce of the and that is it", "en", "s"), (1, "The ounce of the and that is it", "en", "s"), (1, "another text under the same id", "en", "s"), (2, None, "en", None), (3, "", None, "s"),
    (None, "no id here but a text of words", "de", "s"), (4, "12345 !!", "fr", "r"), (5, LONG, "en", "s"), (6, LONG + " more", None, None), (7, "\n \t", "es", "r"), (8, "Ünïcode 𝔘𝔫𝔦 文字", None, "s"), (None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("extra") for c in EXTRA})


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_operators(spark, rows, tmp_path):
    df = table(spark, rows)
    n = len(rows)
    model = langid.fit(df)
    found = df.select("text", langid.predict(model, F.col("text")).alias("p")).collect()
    assert len(found) == n and all(r.p.lang == "und" and r.p.score == 0 for r in found if not any(c.isalpha() for c in r.text or ""))
    assert packing.pack(df, capacity=1000).where("piece = 0").count() == n
    mixed = mixing.replicate(df, {"s": 1.0})  # rate 11.6 or so for source s, 0 for others; its own columns stay
    assert mixed.columns == [*df.columns, "copy_", "copies_"] and {r.source for r in mixed.collect()} <= {"s"}
    drawn = mixed.groupBy("doc_id", "text", "copies_").agg(F.count("*").alias("n"), F.max("copy_").alias("last")).collect()
    assert all(r.n % r.copies_ == 0 and r["last"] == r.copies_ for r in drawn)
    assert {r["copy"] for r in mixed.collect()} <= {"extra"} and bool(drawn) == bool(rows)
    prints = fingerprint.edit_probe(df).collect()
    assert len(prints) == n
    near = neardup.near_duplicates(df).collect()
    assert len(near) == n and all(r.component_id is None and r.kept for r in near if r.doc_id is None)
    cut = chunkdedup.remove_repeated(df)
    assert cut.columns == df.columns and cut.count() == n
    stats = df.select("doc_id", quality.statistics(F.col("text")).alias("stats"))
    scorer = quality.fit(stats, spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1), (7, 0), (8, 1)], "doc_id long, quality int"))
    assert all(0 <= r.s <= 1 for r in stats.select(quality.score(scorer, F.col("stats")).alias("s")).collect())
    totals = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.chars) for r in rollups.corpus_history(df, str(tmp_path / "r"), lambda d, name, rows=None: d).totals().collect()}
    want = {(None, "en", "words-1"): (1, 0, 0), ("s", "en", "words-1"): (4, 22 + len(LONG.split()), 92 + len(LONG)), ("r", "fr", "words-1"): (1, 1, 8)}
    assert all(totals[k] == v for k, v in want.items()) if rows else not totals


def test_copies_of_one_row_draw_apart(spark):
    """Rows that share a key or have none, and equal rows, draw for themselves, whatever the partitioning."""
    rows = [(None, "same text", "s")] * 3000 + [(5, "same text", "s")] * 3000 + [(6, f"text {i}", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.replicate(docs, {"s": 1.0})
    by = {r.doc_id: r for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copies").alias("kinds")).collect()}
    assert set(by) == {None, 5, 6} and all(abs(r.n - 3000) < 250 and r.kinds >= 4 for r in by.values())
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.replicate(docs.repartition(9), {"s": 1.0}).collect()))


def test_no_labels(spark):
    stats = table(spark, ROWS).select("doc_id", quality.statistics(F.col("text")).alias("stats"))
    none = quality.fit(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.s for r in stats.select(quality.score(none, F.col("stats")).alias("s")).collect()} == {0.5}


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_pipeline_stages(spark, rows, tmp_path):
    df = table(spark, rows)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        df = spark.read.parquet(str(tmp_path / str(i)))
    assert rows or not df.count()


def test_one_of_each_group(spark):
    out = neardup.one_of_each(table(spark, ROWS)).collect()
    ids = [r.doc_id for r in out]
    assert ids.count(1) == 1 and ids.count(None) == 2 and not (5 in ids and 6 in ids) and {2, 3, 4, 7, 8} <= set(ids)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert langid.in_a_language(docs).count() == docs.count()


def test_noise_and_unlearned_languages_go(spark):
    rng = random.Random(1)
    words = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(100))
    noise = [words("abcdefghijklmnopqrstuvwxyz"), words("bcdfghjklmnpqrstvwxz"), base64.b64encode(rng.randbytes(450)).decode(), rng.randbytes(300).hex()]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    italian = "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    bad = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([*noise, polish, italian, finnish])], docs.schema)
    kept = langid.in_a_language(docs.unionByName(bad))
    assert kept.where("doc_id < 0").count() == 0 and kept.count() == docs.count()


def test_no_language_keeps_texts_with_letters(spark):
    texts = ["The ounce of the and", "文字", "𝔘", "12345 !!", "", None, " \n"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for df in (docs, docs.unionByName(spark.createDataFrame([(8, None, "en"), (9, "12", "en")], docs.schema))):
        kept = langid.in_a_language(df)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2}


def test_bins_hold_no_near_copies(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (2, text + " more"), (None, "some " + text), (None, "some " + text), (3, ""), (4, ""), (5, "other words"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_best_fit(spark, str(tmp_path)).collect()
    assert len(got) == 8 and len({(r.shard, r.bin) for r in got if r.tokens > 100}) == 4 and len({(r.shard, r.bin) for r in got if not r.tokens}) == 3


def test_rows_without_an_id_share_no_cluster_with_a_number(spark):
    """A null text hashes to the hash's seed, 42, and other texts to numbers that could be ids; neither makes a row a copy of that document."""
    text = " ".join(f"w{i}" for i in range(60))
    (hashed,) = spark.sql("select xxhash64('another text of five words or more')").first()
    rows = [(42, text), (None, None), (7, text + " more"), (None, text + " less"), (None, "another text of five words or more"), (hashed, "nothing like it but as long as that"), ((1 << 63) - 1, "x"), (-(1 << 63) + 9, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {(r.id, r.n): r.cluster for r in packing.pieces(docs, near=True).selectExpr("id", "tokens n", "cluster").collect()}
    assert len(got) == 8 and got[42, 60] == got[7, 61] == got[None, 61]
    assert len({got[None, 0], got[None, 7], got[hashed, 8], got[42, 60]}) == 4


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (0, [3.0, 4.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0])]], ids=["empty", "one", "few"])
def test_nearest(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("extra") for c in EXTRA})
    got = annforest.nearest(df, F.col("id") % 100 == 0).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(got)] == ([(0, 100, 0.0), (100, 0, 0.0)] if len(rows) == 5 else [])


@pytest.mark.parametrize("rows", [[], [(1, 0, "assistant", LONG), (1, 0, "assistant", LONG), (1, 0, None, "")]], ids=["empty", "ties"])
def test_chat(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("extra") for c in EXTRA})
    got = chat.digests(chat.read_back(chat.prefix_target(df))).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == ([(3, 2 * len(LONG))] if rows else [])
