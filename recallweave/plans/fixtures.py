"""Entities derived from the driver's tables by integer arithmetic, so SQL elsewhere can derive the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import chunking, search, wordindex
from .stored import stored

T0 = 1704067200000
AS_OF = T0 + 30 * 86_400_000
EXTENSIONS = ("md", "pdf", "rs", "py", "csv", "log")
SENDERS = ("noreply@shop.example", "updates@site.example", "info@club.example", '"Ann Lee" <ann@home.example>', "bob@work.example", "Carla <carla@work.example>", "dan@home.example")
MAILBOXES = ("INBOX", "Junk", "Work", "Papierkorb", "INBOX", "Family")

#: What the content searches look for: a phrase, a part of a word, words of which the first is cut, and what is nowhere.
NEEDLES = ("the and", "ingth", "ou the", "no such words")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("mem-"), v).alias("id"), v, F.col("embedding").cast("array<double>").alias("vector"), _pick(labels.MEMORY_TYPES, v % 8).alias("memory_type"),
        ((v * 37 % 100) / 100).alias("importance"), ((v * 53 % 120) / 100).alias("decay"), (v * 7 % 23).alias("access_count"), (F.lit(T0) + v * 60000).alias("timestamp"),
    )


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ext = _pick(EXTENSIONS, d % 6)
    name = F.concat(F.lit("doc_"), d, F.lit("."), ext)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/data/"), "source", F.lit("/"), name).alias("path"), name.alias("name"), ext.alias("ext"), (F.lit(T0 // 1000) + d * 3600).alias("modified"),
        d, "source", "text", F.octet_length("text").cast("bigint").alias("size"),
    )


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table, written once."""
    return stored(spark, sf_dir, "chunks", ["documents"], lambda: _cut_chunks(spark, sf_dir))


def _cut_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_index(spark, sf_dir)
    rows = chunking.chunk(files.select("path", "doc_id", F.concat(F.lit("["), "path", F.lit("]\n"), "text").alias("body")), "body", 512, 128)
    return rows.select(F.col("path").alias("file_path"), "doc_id", "chunk_index", F.col("chunk").alias("content"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding that belongs to each chunk: file_path, doc_id, chunk_index, vector, without texts. Written once."""

    def make() -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        n = e.agg(F.count("*").alias("n"))
        keyed = file_chunks(spark, sf_dir).select("file_path", "doc_id", "chunk_index").crossJoin(F.broadcast(n)).withColumn("vec_id", (F.col("doc_id") * 31 + F.col("chunk_index")) % F.col("n"))
        return keyed.join(e.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), "vec_id").drop("n", "vec_id")

    return stored(spark, sf_dir, "chunk-vectors", ["documents", "embeddings"], make)


def edges(spark: SparkSession, sf_dir: str, above: float = 0.3) -> DataFrame:
    """The graph's similarity edges: each memory's five most similar others above 0.2, written once; `above` filters them."""
    made = stored(spark, sf_dir, "edges", ["embeddings"], lambda: search.pairs_above(memories(spark, sf_dir), 5, 0.2))
    return made.where(F.col("similarity") > above)


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").cast("array<double>").alias("q")).limit(1)


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    subject = F.concat(F.array_join(F.slice(text.words(F.col("text")), 1, 6), " "), F.when(d % 5 == 0, " weekly digest").otherwise(""))
    return table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(
        d.alias("message_id"), _pick(SENDERS, d % 7).alias("sender"), subject.alias("subject"), F.concat("text", F.when(d % 4 == 0, " unsubscribe").otherwise("")).alias("body"),
        _pick(MAILBOXES, d % 6).alias("mailbox"), (F.lit(T0 // 1000) + d * 60).alias("indexed_at"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_type").alias("app_name"),
        F.concat(F.lit("file"), k, F.lit(".py — proj"), F.col("user_id") % 10).alias("window_title"), "user_id", "value", "ts",
    ).withColumn("project", text.project_from_title(F.col("window_title")))


def url_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    n = pages.agg(F.count("*").alias("n"))
    counts = events.crossJoin(F.broadcast(n)).groupBy((F.col("event_id") % F.col("n")).alias("page_id")).agg(F.count("*").alias("visit_count"), F.max("ts").alias("last"))
    seconds = F.unix_seconds(F.col("last").cast("timestamp"))
    return pages.join(counts, "page_id").select("page_id", "url", "visit_count", ((seconds + 11644473600) * 1000000).alias("last_visit_time"))


def _indexed(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, keys: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    make = lambda: wordindex.by_slot(wordindex.postings(rows, keys, fields))
    index = stored(spark, sf_dir, f"{name}-words", ["documents"], make, ["slot"])
    return index, stored(spark, sf_dir, f"{name}-dictionary", ["documents"], lambda: wordindex.dictionary(index))


def chunk_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The chunks' inverted index and its dictionary, written once."""
    return _indexed(spark, sf_dir, "chunks", file_chunks(spark, sf_dir), ["file_path", "doc_id", "chunk_index"], ["content"])


def mail_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The mails' inverted index over sender, subject and body, and its dictionary, written once."""
    return _indexed(spark, sf_dir, "mails", emails(spark, sf_dir), ["message_id"], ["sender", "subject", "body"])
