"""Further registered queries, each with the DuckDB SQL that it equals."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text, vectors
from ..operators import assist, browse, counters, graph, intake, learning, learnloop, lifecycle, records, search, wordindex, workflows
from ..sources import connectors, discovery, readers, store
from ..streaming.bursts import BurstStream
from . import fixtures as fx
from . import oracles as sql
from .queries import _fused, _hits, _items, _stream, _stream_dir, r6
from .stored import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _store(spark: SparkSession) -> store.TableStore:
    return store.TableStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


# Remembering and answering


def _memories(spark, sf) -> DataFrame:
    v = F.col("vec_id")
    return fx.memories(spark, sf).withColumns({"content": F.concat(F.lit("what is known of "), "id"), "source": F.when(v % 3 == 0, "file").otherwise("memory")})


def _new(spark, sf) -> DataFrame:
    v = F.col("vec_id")
    rows = _memories(spark, sf).where("vec_id % 20 = 7")
    return rows.select(
        F.when(v % 100 == 7, F.col("id")).otherwise(F.concat(F.lit("new-"), v)).alias("id"), F.when(v % 100 == 27, " short ").otherwise(F.concat(F.lit("a new memory, number "), v)).alias("content"),
        F.when(v % 100 == 47, F.slice("vector", 1, 8)).otherwise(F.transform("vector", lambda x: x * 2)).alias("vector"), F.lit("HowTo").alias("memory_type"), F.lit(0.7).alias("importance"), "timestamp",
    )


NEW = sql.MEM + """,
fresh AS (SELECT 'new-' || vec_id AS id, vec_id, vector, 0.0 AS decay, 'a new memory, number ' || vec_id AS content FROM memories WHERE vec_id % 20 = 7 AND vec_id % 100 NOT IN (7, 27, 47)),
known AS (SELECT id, vector, decay FROM memories UNION ALL SELECT id, vector, decay FROM fresh),
near AS (SELECT f.id AS src, k.id AS dst, list_cosine_similarity(f.vector, k.vector) * greatest(1 - k.decay, 0.5) AS similarity FROM fresh f JOIN known k ON f.id <> k.id
  WHERE list_cosine_similarity(f.vector, k.vector) * greatest(1 - k.decay, 0.5) > 0.15 QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY similarity DESC, dst) <= 4)"""


def _remembered(spark, sf) -> assist.Remembered:
    return assist.remember(_memories(spark, sf), _new(spark, sf), above=0.15, dim=64, least_bytes=20)


@query(f"WITH {NEW} SELECT id, memory_type, round(importance, 6) AS importance, round(decay, 6) AS decay, CAST(access_count AS BIGINT) AS access_count, 1.0::DOUBLE AS size FROM memories WHERE false"
       f" UNION ALL SELECT id, 'Procedural', 0.7, 0.0, 0, 1.0 FROM fresh")
def remember_memories(spark, sf):
    made = _remembered(spark, sf).memories.where(F.startswith("id", F.lit("new-")))
    return made.select("id", "memory_type", r6("importance"), r6("decay"), "access_count", r6(F.sqrt(vectors.dot(F.col("vector"), F.col("vector"))), "size"))


@query(f"WITH {NEW} SELECT id, ['Memory', 'Procedural'] AS labels FROM fresh")
def remember_nodes(spark, sf):
    return _remembered(spark, sf).nodes


@query(f"WITH {NEW} SELECT src, dst, round(similarity, 6) AS similarity, 'similar_to' AS kind, 0.6::DOUBLE AS confidence FROM near")
def remember_edges(spark, sf):
    return _remembered(spark, sf).edges.select("src", "dst", r6("similarity"), "kind", "confidence")


@query(f"WITH {NEW} SELECT src, [src] || list(dst ORDER BY similarity DESC, dst) AS members, 0.6::DOUBLE AS confidence FROM near GROUP BY src HAVING count(*) >= 2")
def remember_hyperedges(spark, sf):
    return _remembered(spark, sf).hyperedges


SECOND = "second AS (SELECT id, list_dot_product(vector, q) * greatest(1 - decay, 0.5) AS similarity FROM memories, q WHERE list_dot_product(vector, q) * greatest(1 - decay, 0.5) >= 0.05 AND memory_type = 'Episodic' ORDER BY similarity DESC, id LIMIT 3)"


@query(sql._with(sql.MEM, sql.Q, sql._recalled(k=5), SECOND) + "SELECT id, round(similarity, 6) AS similarity FROM hits UNION ALL SELECT id, round(similarity, 6) FROM second WHERE id NOT IN (SELECT id FROM hits)")
def secondary_recall(spark, sf):
    m, q = fx.memories(spark, sf), fx.query_vector(spark, sf)
    both = assist.merged(search.recall(m, q, 5).select("id", "similarity"), search.recall(m, q, 3, types=["Episodic"], metric="dot"))
    return both.select("id", r6("similarity"))


@query(sql._with(sql.MEM, sql.Q, sql.CHUNK_VECTORS, sql.FILE_HITS, sql.MERGED, sql._recalled(k=5),
    "best AS (SELECT count(*) AS n, max(similarity) AS top, arg_max('what is known of ' || id, similarity) AS content FROM hits)", "extra AS (SELECT content AS context FROM merged ORDER BY rank LIMIT 1)")
    + "SELECT 'context' AS kind, md5('" + assist.FOUND.replace("'", "''").replace("\n", "' || chr(10) || '") + "' || substr(context, 1, 2000)) AS response, round(top, 6) AS confidence, n AS memories FROM best, extra"
    + " UNION ALL SELECT 'memories', md5('Based on ' || n || ' relevant memories: ' || content), round(top, 6), n FROM best UNION ALL SELECT 'nothing', md5('" + assist.NOTHING + "'), 0.1, 0")
def think_answer(spark, sf):
    """What is answered with further context, with memories alone, and with neither."""
    hits = search.recall(_memories(spark, sf), fx.query_vector(spark, sf), 5)
    files = search.merge_by_file(search.with_content(_hits(spark, sf), fx.file_chunks(spark, sf))).orderBy("rank").limit(1)
    extra, none = files.select(F.col("content").alias("context")), spark.range(1).select(F.lit("").alias("context"))
    one = lambda kind, answered: answered.select(F.lit(kind).alias("kind"), F.md5("response").alias("response"), r6("confidence"), "memories")
    return one("context", assist.answer(hits, extra)).unionByName(one("memories", assist.answer(hits, none))).unionByName(one("nothing", assist.answer(hits.where(F.lit(False)), none)))


@query(sql._with(sql.MEM, sql.Q, "s AS (SELECT *, list_cosine_similarity(vector, q) AS s FROM memories, q WHERE vec_id % 3 = 0)", "a AS (SELECT * FROM s ORDER BY s DESC, id LIMIT 40)")
    + "SELECT id, memory_type, round(s * greatest(1 - decay, 0.5), 6) AS similarity FROM a WHERE memory_type IN ('Semantic', 'Goal') ORDER BY s * greatest(1 - decay, 0.5) DESC, id LIMIT 10")
def recall_filtered(spark, sf):
    return assist.recall_filtered(_memories(spark, sf), fx.query_vector(spark, sf), 10, "file", ["semantic", "goal"]).select("id", "memory_type", r6("similarity"))


@query(sql._with(sql.CHUNK_VECTORS, sql.Q, "n AS (SELECT path, chunk_index, list_cosine_similarity(vector, q) AS s FROM cv, q ORDER BY s DESC, path, chunk_index LIMIT 60)")
    + f"SELECT path, chunk_index, round(CASE WHEN ext IN {sql._in(labels.BOOSTED)} THEN s * 1.15 WHEN ext IN {sql._in(labels.LOWERED)} THEN s * 0.95 ELSE s END, 6) AS similarity FROM n JOIN files USING (path) WHERE s >= 0.2"
    + f" ORDER BY CASE WHEN ext IN {sql._in(labels.BOOSTED)} THEN s * 1.15 WHEN ext IN {sql._in(labels.LOWERED)} THEN s * 0.95 ELSE s END DESC, path, chunk_index LIMIT 20")
def file_search_indexed(spark, sf):
    return search.search_index(fx.chunk_vectors(spark, sf), fx.file_index(spark, sf), fx.query_vector(spark, sf), 20, 0.2).select("path", "chunk_index", r6("similarity"))


def _mail_chunks(spark, sf):
    return fx.chunk_vectors(spark, sf).where("doc_id % 3 = 0").withColumn("file_path", F.concat(F.lit("mail://"), F.col("doc_id").cast("string")))


@query(sql._with(sql.CHUNK_VECTORS, sql.Q, sql.MAIL, "n AS (SELECT 'mail://' || doc_id AS file_path, chunk_index, list_cosine_similarity(vector, q) AS s FROM cv, q WHERE doc_id % 3 = 0 ORDER BY s DESC, file_path, chunk_index LIMIT 45)")
    + f"SELECT message_id, chunk_index, {sql.SENDER} AS sender, message_id % 2 AS attachments, {sql._preview('subject')} AS preview, round(s, 6) AS similarity FROM n JOIN mail ON file_path = 'mail://' || message_id WHERE s >= 0.15 ORDER BY s DESC, message_id, chunk_index LIMIT 15")
def mail_search_indexed(spark, sf):
    m = fx.emails(spark, sf).withColumn("attachments", F.col("message_id") % 2)
    files = m.select(F.concat(F.lit("mail://"), F.col("message_id").cast("string")).alias("path"))
    hits = assist.search_mail(_mail_chunks(spark, sf), files, m, fx.query_vector(spark, sf), 15)
    return hits.select("message_id", "chunk_index", text.sender_name(F.col("sender")).alias("sender"), "attachments", text.preview(F.col("subject")).alias("preview"), r6("similarity"))


@query(sql._with(sql.MEM, sql.Q, sql._recalled(), "given AS (SELECT id, similarity FROM hits UNION ALL SELECT 'gone-1', 0.9)") + "SELECT g.id, m.memory_type, round(g.similarity, 6) AS similarity FROM given g JOIN memories m USING (id)")
def hits_with_memories(spark, sf):
    """Hits of a vector store with their memories; those whose memory is gone are dropped."""
    m = fx.memories(spark, sf)
    hits = search.recall(m, fx.query_vector(spark, sf), 10).select("id", "similarity").unionByName(spark.range(1).select(F.lit("gone-1").alias("id"), F.lit(0.9).alias("similarity")))
    return m.select("id", "memory_type").join(F.broadcast(hits), "id").select("id", "memory_type", r6("similarity"))  # eleven hits


@query(sql._with(sql.MEM, sql.Q, sql._recalled(k=5)) + "SELECT 'today' || chr(10) || string_agg('- [' || memory_type || '] what is known of ' || id, chr(10) ORDER BY similarity DESC, id) AS digest FROM hits")
def workflow_digest(spark, sf):
    return assist.digest(search.recall(_memories(spark, sf), fx.query_vector(spark, sf), 5), "today")


def _taught(spark, sf) -> tuple[store.TableStore, list[dict[str, int]]]:
    """Documents as texts to remember: those of even number first, then all of them."""
    d = fx.table(spark, sf, "documents")
    texts = d.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.col("text").alias("content"), F.lit("episodic").alias("memory_type"), F.lit(0.5).alias("importance"), F.col("doc_id").alias("timestamp"))
    tables, counts = _store(spark), counters.Counters(spark)
    call = lambda rows: intake.remember_texts(tables, rows, counts, lambda c: vectors.hash_embedding(c, 64), above=0.8)
    return tables, [call(texts.where("timestamp % 2 = 0")), call(texts)]


TAUGHT = [
    sql._hashed("e", "documents", "doc_id", "text", 64),
    f"t AS (SELECT doc_id, 'doc-' || doc_id AS id, text, v, doc_id % 2 = 0 AS early FROM documents JOIN e USING (doc_id) WHERE strlen(regexp_replace(text, '^{sql.WS}+|{sql.WS}+$', '', 'g')) >= 20)",
    "near AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS similarity FROM t a JOIN t b ON a.id <> b.id AND (b.early OR NOT a.early) WHERE list_dot_product(a.v, b.v) > 0.8)",
    "best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(similarity, 9) DESC, dst) <= 4)",
]


@query(sql._with(*TAUGHT) + "SELECT src, dst, round(similarity, 6) AS similarity FROM best")
def remember_text_edges(spark, sf):
    """Edges of texts that were remembered in two calls: the second's see all memories, the first's only one another."""
    return _taught(spark, sf)[0].read("edges", ["src", "dst"]).select("src", "dst", r6("similarity"))


@query(sql._with(*TAUGHT, "h AS (SELECT src FROM best GROUP BY 1 HAVING count(*) >= 2)")
    + """SELECT 1 AS call, (SELECT count_if(early) FROM t) AS created, (SELECT count_if(doc_id % 2 = 0) FROM documents) - (SELECT count_if(early) FROM t) AS skipped, x.* FROM x
UNION ALL SELECT 2, (SELECT count_if(NOT early) FROM t), (SELECT count(*) FROM documents) - (SELECT count_if(NOT early) FROM t), x.* FROM x""".replace("FROM x", "FROM (SELECT (SELECT count(*) FROM t) AS memories, (SELECT count(*) FROM t) AS nodes, (SELECT count(*) FROM h) AS hyperedges) x"))  # fmt: skip
def remember_text_counts(spark, sf):
    """What both calls counted while they wrote, and what the store holds afterwards."""
    tables, told = _taught(spark, sf)
    rows = spark.createDataFrame([(n + 1, t["created"], t["skipped"]) for n, t in enumerate(told)], "call int, created bigint, skipped bigint")
    for name, key in {"memories": "id", "nodes": "id", "hyperedges": "src"}.items():
        rows = rows.crossJoin(F.broadcast(tables.read(name, [key]).agg(F.count("*").alias(name))))  # one row
    return rows


@query(sql._with(*sql.FUSED, sql.MEM, sql.MAIL, sql._recalled(k=5).replace("hits AS", "recalled AS"),
    f"c AS (SELECT source, id, similarity, CAST(split_part(id, '/', 1) AS BIGINT) AS doc_id, {sql._cut('content', 'chars')} AS content FROM b JOIN hits USING (source, id, content))",
    """l AS (SELECT c.source, c.content, row_number() OVER (PARTITION BY c.source ORDER BY similarity DESC, c.doc_id, CAST(split_part(id, '/', 2) AS BIGINT)) AS r, CASE c.source
  WHEN 'email' THEN 'Subject: ' || subject || chr(10) || '   From: ' || sender || ' | Date: ' || indexed_at || ' | Mailbox: ' || mailbox WHEN 'file' THEN name || ' (' || path || ')' ELSE '[' || ext || '] ' || name || ': ' || path END AS head
  FROM c JOIN files f ON f.doc_id = c.doc_id LEFT JOIN mail ON message_id = c.doc_id)""",
    """s AS (SELECT source, string_agg(r || '. ' || head || chr(10) || CASE WHEN source = 'file' THEN content || chr(10) || chr(10) ELSE CASE WHEN content <> '' THEN '   Content: ' || content || chr(10) ELSE '' END || CASE source WHEN 'email' THEN chr(10) ELSE '' END END, '' ORDER BY r) AS body FROM l GROUP BY source)""",
    "x AS (SELECT string_agg(CASE source " + " ".join(f"WHEN '{k}' THEN chr(10) || '{a.strip()}' || chr(10) || body || '{z.strip()}' || chr(10) || chr(10)" for k, (a, z) in intake.SECTIONS.items())
    + " END, '' ORDER BY CASE source " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(intake.SECTIONS)) + " END) AS context FROM s)")
    + "SELECT md5('" + assist.FOUND.replace("'", "''").replace("\n", "' || chr(10) || '") + "' || substr(context, 1, 2000)) AS response, round((SELECT max(similarity) FROM recalled), 6) AS confidence, (SELECT count(*) FROM recalled) AS memories, md5(context) AS context FROM x")
def think_with_context(spark, sf):
    """A question's answer from memories and from mail, system and file results, each cut to its share of the context."""
    files = fx.file_index(spark, sf).select("doc_id", "name", "path", "ext")
    mail = fx.emails(spark, sf).select(F.col("message_id").alias("doc_id"), "subject", "sender", "indexed_at", "mailbox")
    few = _fused(spark, sf).select("source", "doc_id", "chunk_index", "similarity", "content")  # at most 23 rows
    parts = mail.join(files.join(F.broadcast(few), "doc_id"), "doc_id", "right")
    shown = F.concat(F.lit("Subject: "), "subject", F.lit("\n   From: "), "sender", F.lit(" | Date: "), F.col("indexed_at").cast("string"), F.lit(" | Mailbox: "), "mailbox")
    head = F.when(F.col("source") == "email", shown).when(F.col("source") == "file", F.concat("name", F.lit(" ("), "path", F.lit(")"))).otherwise(F.concat(F.lit("["), "ext", F.lit("] "), "name", F.lit(": "), "path"))
    parts = parts.select("source", F.struct(-F.col("similarity"), "doc_id", "chunk_index").alias("rank"), head.alias("head"), "similarity", "content")
    out = intake.think(search.recall(_memories(spark, sf), fx.query_vector(spark, sf), 5), parts)
    return out.select(F.md5("response").alias("response"), r6("confidence"), "memories", F.md5("context").alias("context"))


# Files, folders and stores


@query(sql._with(sql.FILES, "r AS (SELECT string_split(path, '/') AS p, modified FROM files)")
    + """SELECT p[3] AS name, '/data/' || p[3] AS path, count(DISTINCT p[4]) AS items, count(DISTINCT CASE WHEN len(p) > 4 THEN p[4] END) AS subfolders, max(modified) AS modified, p[3] IN ('src1', 'src10') AS indexed
FROM r GROUP BY p[3]""")  # fmt: skip
def folder_entries(spark, sf):
    return assist.folder_entries(fx.file_index(spark, sf), "/data", ["/data/src1/inner", "/data/src10"])


@query("""SELECT * FROM (VALUES ('Home', '/home/a', true), ('Documents', '/home/a/Documents', true), ('Desktop', '/home/a/Desktop', false), ('Downloads', '/home/a/Downloads', true),
  ('iCloud Drive', '/home/a/Library/Mobile Documents/com~apple~CloudDocs', false), ('Projects', '/home/a/Projects', false), ('Developer', '/home/a/Developer', false)) AS t(label, path, there)""")
def common_folders(spark, sf):
    place = F.concat(F.lit("/home/a/"), F.when(F.col("doc_id") % 2 == 0, "Documents/").otherwise("Downloads/"), "name")
    return assist.common_folders(fx.file_index(spark, sf).select(place.alias("path")), "/home/a")


@query("SELECT '/home/a/Documents/p' || user_id % 50 AS folder FROM events UNION SELECT '/data/' || source FROM documents UNION SELECT '/data/src' || user_id % 7 FROM events")
def watched_folders(spark, sf):
    """Folders that users named in different ways and folders of indexed files, each once."""
    e = F.col("user_id").cast("bigint")
    named = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("~/Documents/p"), (e % 50).cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("/home/a/Documents/p"), (e % 50).cast("string")))
    again = F.concat(F.lit("/data/src"), (e % 7).cast("string"), F.lit("//"))
    configured = fx.table(spark, sf, "events").select(F.explode(F.array(named, again)).alias("folder"))
    return discovery.watched(configured, fx.file_index(spark, sf), "/home/a/")


@query(sql._with(sql.MEM) + "SELECT vec_id, timestamp AS modified FROM memories ORDER BY md5('3|' || vec_id), vec_id LIMIT 50")
def vector_sample(spark, sf):
    return search.sample(fx.memories(spark, sf), 50, "vec_id").select("vec_id", F.col("timestamp").alias("modified"))


@query(sql._with(sql.MEM, sql.Q, sql.CHUNK_VECTORS,
    "n AS (SELECT 'file::' || path || '::' || chunk_index AS id, list_cosine_similarity(vector, q) AS s, path, chunk_index FROM cv, q UNION ALL SELECT 'memory::' || id, list_cosine_similarity(vector, q), NULL, NULL FROM memories, q)",
    "b AS (SELECT * FROM n ORDER BY s DESC, id LIMIT 600)", f"w AS (SELECT path, chunk_index, CASE WHEN ext IN {sql._in(labels.BOOSTED)} THEN s * 1.15 WHEN ext IN {sql._in(labels.LOWERED)} THEN s * 0.95 ELSE s END AS s FROM b JOIN files USING (path) WHERE s >= 0.2)")
    + "SELECT path, chunk_index, round(s, 6) AS similarity FROM w ORDER BY w.s DESC, path, chunk_index LIMIT 20")
def file_search_unlabelled(spark, sf):
    """A search for files in a store of files and memories that doesn't know which vector is of a file: by their ids, among ten times as many."""
    chunks = fx.chunk_vectors(spark, sf).select(F.concat(F.lit("file::"), "file_path", F.lit("::"), F.col("chunk_index").cast("string")).alias("id"), "vector")
    both = chunks.unionByName(fx.memories(spark, sf).select(F.concat(F.lit("memory::"), "id").alias("id"), "vector")).withColumn("source", F.lit(None).cast("string"))
    return search.search_store(both, fx.file_index(spark, sf), fx.query_vector(spark, sf), 20, 0.2).select("path", "chunk_index", r6("similarity"))


@query("SELECT count(*) AS vectors, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes, true AS ok FROM embeddings")
def store_status(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.agg(F.count("*").alias("vectors"), F.sum(F.size("embedding") * 4).cast("bigint").alias("bytes"), F.lit(True).alias("ok"))


@query(sql._with(sql.CHUNKS) + "SELECT count(*) AS chunks FROM chunks JOIN files USING (path) WHERE ext = 'md'")
def chunk_count_by_ext(spark, sf):
    files = fx.file_index(spark, sf).where("ext = 'md'").select(F.col("path").alias("file_path"))
    return fx.file_chunks(spark, sf).select("file_path").join(files, "file_path").agg(F.count("*").alias("chunks"))


@query(sql._with(sql.CHUNKS) + "SELECT path, chunk_index, md5(content) AS content FROM chunks WHERE doc_id = 7 ORDER BY chunk_index LIMIT 5")
def chunks_of_file(spark, sf):
    """A point lookup: the first chunks of one path."""
    path = fx.file_index(spark, sf).where("doc_id = 7").select("path")
    rows = fx.file_chunks(spark, sf).join(F.broadcast(path), F.col("file_path") == F.col("path"))  # one path
    return rows.orderBy("chunk_index").limit(5).select("path", "chunk_index", F.md5("content").alias("content"))


@query(sql._with(sql.MEM) + "SELECT id, memory_type, timestamp FROM memories WHERE id = 'mem-42'")
def memory_by_id(spark, sf):
    return fx.memories(spark, sf).where("id = 'mem-42'").select("id", "memory_type", "timestamp")


def _blobs(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    v = F.col("vec_id")
    return e.select("vec_id", F.when(v % 2 == 0, vectors.packed(F.col("embedding"))).alias("blob"), F.when(v % 10 == 1, "no list").when(v % 2 == 1, F.to_json(F.col("embedding").cast("array<double>"))).alias("listed"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS vector FROM embeddings WHERE vec_id % 10 <> 1")
def memory_scan(spark, sf):
    """Stored vectors, bytes or a JSON list; rows with neither are dropped."""
    return vectors.decoded_rows(_blobs(spark, sf), "blob", "listed").select("vec_id", vectors.rounded(F.col("vector")).alias("vector"))


@query(sql._with(sql.MEM) + "SELECT id, memory_type, round(CASE WHEN vec_id % 4 = 0 THEN importance ELSE importance END, 6) AS importance FROM memories WHERE vec_id % 3 = 0 OR vec_id % 4 = 0")
def insert_or_ignore(spark, sf):
    """Appends of rows some of whose keys are there already."""
    m, s = fx.memories(spark, sf).select("id", "vec_id", "memory_type", "importance"), _store(spark)
    s.insert_new("activity", ["id"], m.where("vec_id % 3 = 0"))
    s.insert_new("activity", ["id"], m.where("vec_id % 4 = 0").withColumn("importance", F.when(F.col("vec_id") % 3 == 0, -1.0).otherwise(F.col("importance"))))
    return s.read("activity", ["id"]).select("id", "memory_type", r6("importance"))


@query("SELECT 'k' || event_id % 7 AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1")
def key_values(spark, sf):
    """A key-value table: each put replaces the one before."""
    e, s = fx.table(spark, sf, "events"), _store(spark)
    key = F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("key")
    s.upsert("config", e.groupBy(key).agg(F.min("event_id").cast("string").alias("value")))
    s.upsert("config", e.groupBy(key).agg(F.max("event_id").cast("string").alias("value")))
    return s.read("config", ["key"])


@query("SELECT 'v' || vec_id % 100 AS key, list_transform(arg_max(embedding, vec_id), lambda x: round(CAST(x AS DOUBLE), 6)) AS vector FROM embeddings GROUP BY 1")
def key_blobs(spark, sf):
    """Vectors as bytes by key; each put replaces the one before."""
    e, s = fx.table(spark, sf, "embeddings"), _store(spark)
    key = F.concat(F.lit("v"), (F.col("vec_id") % 100).cast("string"))
    rows = e.select(key.alias("key"), "vec_id", vectors.packed(F.col("embedding")).alias("blob"))
    for best in (F.min_by, F.max_by):
        s.upsert("blobs", rows.groupBy("key").agg(best("blob", "vec_id").alias("blob")))
    return s.read("blobs", ["key"]).select("key", vectors.rounded(vectors.unpacked(F.col("blob")).cast("array<double>")).alias("vector"))


@query("SELECT user_id % 20 AS state, event_id % 4 AS action, round(avg(value) + 1, 6) AS value FROM events GROUP BY 1, 2")
def q_table(spark, sf):
    e, s = fx.table(spark, sf, "events"), _store(spark)
    q = e.groupBy((F.col("user_id") % 20).alias("state"), (F.col("event_id") % 4).alias("action")).agg(F.avg("value").alias("value"))
    s.upsert("q", q)
    s.upsert("q", q.withColumn("value", F.col("value") + 1))
    s.compact("q", ["state", "action"])
    return s.read("q", ["state", "action"]).select("state", "action", r6("value"))


@query(sql._with(sql.MEM) + "SELECT id FROM memories WHERE vec_id % 3 <> 0")
def delete_by_source(spark, sf):
    s = _store(spark)
    s.upsert("vectors", _memories(spark, sf).select("id", "source"))
    s.delete_where("vectors", ["id"], F.col("source") == "file")
    return s.read("vectors", ["id"]).select("id")


@query(sql._with(sql.MAIL) + "SELECT 'mail://' || message_id AS path, CAST(k AS INT) AS chunk_index FROM mail, range(CASE WHEN message_id % 2 = 0 THEN 1 ELSE 3 END) AS t(k)")
def mail_reindexed(spark, sf):
    """Mail under mail:// keys; indexing half of it again replaces all chunks of these messages."""
    m, s = fx.emails(spark, sf).select("message_id"), _store(spark)
    rows = lambda df, n: df.select(F.concat(F.lit("mail://"), F.col("message_id").cast("string")).alias("path"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk_index"))
    s.replace_where("chunks", ["path", "chunk_index"], "path", rows(m, 3))
    s.replace_where("chunks", ["path", "chunk_index"], "path", rows(m.where("message_id % 2 = 0"), 1))
    return s.read("chunks", ["path", "chunk_index"]).select("path", "chunk_index")


@query(sql._with(sql.MEM, sql.Q, sql._recalled(k=5)) + "SELECT CAST(n AS INT) AS n, list(id ORDER BY similarity DESC, id) AS result_ids, first(id ORDER BY similarity DESC, id) AS selected_id FROM hits, range(3, 0, -1) AS t(n) GROUP BY n")
def recent_queries(spark, sf):
    """Queries appended to a log; the newest of it."""
    from .queries import query_log

    s, one = _store(spark), query_log(spark, sf)
    for n in range(4):
        s.upsert("log", one.withColumn("n", F.lit(n)))
    return s.read("log", ["n"]).orderBy(F.desc("n")).limit(3)


def _old_stores(spark, sf):
    m = fx.memories(spark, sf)
    v = F.col("vec_id")
    vector = F.when(v % 9 == 0, F.slice("vector", 1, 8)).otherwise(F.col("vector"))
    files = m.where("vec_id % 2 = 0").select(F.concat(F.when(v % 4 == 0, "mail://").otherwise("file::"), v.cast("string")).alias("id"), vector.alias("vector"))
    return {"files": files, "memories": m.where("vec_id % 2 = 1").select("id", vector.alias("vector"))}


@query("""SELECT CASE WHEN vec_id % 2 = 0 THEN 'files' ELSE 'memories' END AS store, CASE WHEN vec_id % 4 = 0 THEN 'email' WHEN vec_id % 2 = 0 THEN 'file' ELSE 'memory' END AS source,
  count(*) FILTER (vec_id % 9 <> 0) AS migrated, count(*) FILTER (vec_id % 9 = 0) AS skipped, vec_id % 4 = 2 OR vec_id % 2 = 1 AS verified FROM embeddings GROUP BY ALL""")
def migration_of_stores(spark, sf):
    old = _old_stores(spark, sf)
    done = old["files"].unionByName(old["memories"]).where((F.size("vector") == 64) & ~F.col("id").isin("mail://4", "mail://8")).select("id")
    return assist.migration(old, done, 64)


@query(sql._with(sql.FILES) + "SELECT source AS topic, CAST(count(*) AS BIGINT) AS n, md5('# ' || source || chr(10) || chr(10) || string_agg('### ' || name || chr(10) || md5(text) || chr(10), chr(10) ORDER BY modified, name)) AS body FROM files GROUP BY 1")
def topic_export(spark, sf):
    """Knowledge as one markdown file for each topic, and how many memories are read back from it."""
    rows = fx.file_index(spark, sf).select("source", F.col("name").alias("id"), F.md5("text").alias("content"), F.col("modified").alias("timestamp"))
    files = assist.topic_text(rows, "source")
    read = assist.topic_entries(files).join(rows.select(F.col("source").alias("topic"), "id", "content"), ["topic", "id", "content"]).groupBy("topic").agg(F.count("*").alias("n"))
    return files.join(read, "topic").select("topic", "n", F.md5("body").alias("body"))


@query(sql._with(sql.FILES) + "SELECT source AS topic, name AS id, md5(rtrim(text, chr(10))) AS content FROM files")
def topic_files(spark, sf):
    """Knowledge as folders of markdown files by topic, which many tasks write, and the memories read back from them."""
    folder = _new_folder(spark, "topics")
    rows = fx.file_index(spark, sf).select("source", F.col("name").alias("id"), F.col("text").alias("content"), F.col("modified").alias("timestamp"))
    workflows.write_topics(rows, "source", folder, 100)
    return workflows.read_topics(spark, folder).select("topic", "id", F.md5("content").alias("content"))


# Mail, chats and browsers


#: A phrase of whole words, parts of words, what only another field holds, and what is nowhere.
ASKED = (("weekly digest", "subject"), ("unsub", "body"), ("example", "all"), ("the and", "all"), ("carla", "subject"), ("no such words", "all"))


def _asked(n: int, needle: str, field: str) -> str:
    of = {f: f"array_to_string({sql._words(f'lower(coalesce({f}, chr(32)))')}, ' ')" for f in ("sender", "subject", "body") if field in (f, "all")}
    whole, part = (" OR ".join(f"contains({a} || {c} || {a}, '{b}{needle}{b}')" for c in of.values()) for a, b in (("' '", " "), ("''", "")))
    return f"w{n} AS (SELECT message_id FROM mail WHERE {whole}), a{n} AS (SELECT '{needle}' AS needle, '{field}' AS field, message_id, (SELECT count(*) FROM w{n}) > 0 AS whole FROM mail WHERE CASE WHEN (SELECT count(*) FROM w{n}) > 0 THEN message_id IN (FROM w{n}) ELSE {part} END ORDER BY message_id LIMIT 25)"


@query(sql._with(sql.MAIL, *[_asked(n, *a) for n, a in enumerate(ASKED)]) + " UNION ALL ".join(f"FROM a{n}" for n in range(len(ASKED))))
def mail_first_found(spark, sf):
    """Mails by field, as whole words or, where no mail holds these, as parts of words."""
    index, known = fx.mail_words(spark, sf)
    found = [wordindex.first_found(index, known, needle, "message_id", field).select(F.lit(needle).alias("needle"), F.lit(field).alias("field"), "message_id", "whole") for needle, field in ASKED]
    return functools.reduce(DataFrame.unionByName, found)


@query(sql._with(sql.MAIL) + "SELECT message_id FROM mail WHERE message_id % 4 IN (0, 1)")
def account_mail(spark, sf):
    m = F.col("message_id")
    rows = fx.emails(spark, sf).withColumns({"account": F.when(m % 4 == 0, "Hotmail").otherwise("other"), "addresses": F.when(m % 4 == 1, F.array(F.lit("Ann@Home.Example"))).otherwise(F.array(F.lit("x@y.example")))})
    return assist.of_accounts(rows, ["hotmail", "ann@home.example"]).select("message_id")


def _messages(spark, sf):
    e = fx.table(spark, sf, "events")
    chat = F.col("user_id") % 50
    return e.select(chat.alias("chat"), F.concat(F.lit("chat "), chat.cast("string")).alias("name"), F.when(F.col("event_id") % 2 == 0, "You").otherwise("Ann").alias("sender"), F.concat(F.lit("message about the "), "event_type", F.lit(" "), (F.col("event_id") % 5).cast("string")).alias("text"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"))


@query("""WITH m AS (SELECT user_id % 50 AS chat, CASE WHEN event_id % 2 = 0 THEN 'You' ELSE 'Ann' END AS sender, 'message about the ' || event_type || ' ' || event_id % 5 AS text, ts, event_id AS n FROM events),
s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY chat) <= 100 THEN 'all' ELSE strftime(ts, '%Y-%m') END AS period FROM m WHERE length(text) > 20),
t AS (SELECT chat, period, substr(text, 1, 80) AS snippet, max((strlen(text), -n)) AS best FROM s GROUP BY chat, period, substr(text, 1, 80)),
k AS (SELECT chat, period, string_agg(snippet, '; ' ORDER BY best DESC) AS topics FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY chat, period ORDER BY best DESC) <= 8) GROUP BY 1, 2),
b AS (SELECT chat, period, count(*) AS messages, strftime(min(ts), '%b %Y') AS a, strftime(max(ts), '%b %Y') AS z, string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || sender || ': ' || text, chr(10) ORDER BY ts, n) AS lines FROM s GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN a = z THEN a ELSE a || ' – ' || z END AS label FROM b)
SELECT chat, period, label, 'WhatsApp conversation with chat ' || chat || ' (' || label || ', ' || messages || ' messages). Topics: ' || topics AS summary, md5('WhatsApp conversation with chat ' || chat || ' — ' || label || chr(10) || chr(10) || lines) AS content, messages FROM l JOIN k USING (chat, period)""")
def chat_texts(spark, sf):
    return assist.chat_texts(_messages(spark, sf)).withColumn("content", F.md5("content")).drop("last")


@query("""WITH s AS (SELECT user_id % 50 AS chat, CASE WHEN event_id % 2 = 0 THEN 'You' ELSE 'Ann' END AS sender, 'message about the ' || event_type || ' ' || event_id % 5 AS text, ts, event_id AS n FROM events),
p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY chat) <= 100 THEN 'all' ELSE strftime(ts, '%Y-%m') END AS period FROM s WHERE length(text) > 20 AND chat % 4 <> 3),
b AS (SELECT chat, strftime(min(ts), '%b %Y') AS a, strftime(max(ts), '%b %Y') AS z, max(ts) AS last, string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || sender || ': ' || text, chr(10) ORDER BY ts, n) AS lines FROM p GROUP BY chat, period)
SELECT md5('WhatsApp conversation with chat ' || chat || ' — ' || CASE WHEN a = z THEN a ELSE a || ' – ' || z END || chr(10) || chr(10) || lines) AS content, 'Episodic' AS memory_type, 0.4::DOUBLE AS importance, epoch_us(last) // 1000 AS timestamp FROM b""")
def connector_chat(spark, sf):
    """Messages of the chats that have a session, by the registry's connector."""
    m = _messages(spark, sf)
    return _short(connectors.default_registry().connectors["chat"].load(m.drop("name"), m.where("chat % 4 <> 3").select("chat", "name").distinct()))


@query("SELECT string_agg(p, ', ' ORDER BY p) AS details FROM (SELECT browser || ' (' || count(*) || CASE WHEN count(*) = 1 THEN ' profile)' ELSE ' profiles)' END AS p FROM (SELECT DISTINCT event_type AS browser, user_id % 3 AS profile FROM events) GROUP BY browser)")
def browser_profiles(spark, sf):
    profiles = fx.table(spark, sf, "events").select(F.col("event_type").alias("browser"), (F.col("user_id") % 3).alias("profile")).distinct()
    return assist.profile_summary(profiles)


@query(f"""WITH p AS (SELECT user_id % 7 AS b, CASE user_id % 4 WHEN 0 THEN 'Default' WHEN 3 THEN 'Guest Profile' ELSE 'Profile ' || user_id % 4 END AS profile, event_id % 2 = 0 AS history FROM events)
SELECT DISTINCT {sql._list(discovery.BROWSERS)}[b + 1] AS browser, profile, '/home/a/{discovery.APPLICATION_SUPPORT}/' || {sql._list(discovery.BROWSERS.values())}[b + 1] || '/' || profile || '/History' AS path FROM p WHERE history AND profile <> 'Guest Profile'""")
def browser_profiles_found(spark, sf):
    """Profiles with a history, found in a listing of files."""
    u = F.col("user_id")
    folder = F.get(F.array(*[F.lit(f) for f in discovery.BROWSERS.values()]), (u % 7).cast("int"))
    profile = F.when(u % 4 == 0, "Default").when(u % 4 == 3, "Guest Profile").otherwise(F.concat(F.lit("Profile "), (u % 4).cast("string")))
    path = F.concat_ws("/", F.lit(f"/home/a/{discovery.APPLICATION_SUPPORT}"), folder, profile, F.when(F.col("event_id") % 2 == 0, "History").otherwise("Cookies"))
    return discovery.browser_profiles(fx.table(spark, sf, "events").select(path.alias("path")), "/home/a")


@query(sql._with(f"t AS (SELECT doc_id, 'n' || doc_id AS name, text, len({sql._words('text')}) AS n FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND strlen(regexp_replace(text, '^{sql.WS}+|{sql.WS}+$', '', 'g')) >= 20)",
    sql._chunked("c", "(SELECT * FROM t WHERE n > 500)", "doc_id, name, text", "text", 400, 50))
    + "SELECT doc_id AS timestamp, md5(text) AS content, md5(name || ' [a, b]: ' || substr(text, 1, 200)) AS summary FROM t WHERE n <= 500 UNION ALL"
    + " SELECT doc_id, md5(content), md5(name || CASE WHEN chunk_index = 0 THEN ' [a, b]: ' || substr(text, 1, 200) ELSE ' (part ' || chunk_index + 1 || ')' END) FROM c WHERE chunk_index < 5")
def vault_found(spark, sf):
    """A vault found in a listing, and its notes as texts to remember; templates, hidden folders and another vault, which comes later, give none."""
    d = F.col("doc_id")
    place = F.when(d % 4 == 0, "k2").otherwise("k1")
    inside = F.when(d % 7 == 0, "templates").when(d % 11 == 0, ".trash").otherwise(F.col("source"))
    note = fx.table(spark, sf, "documents").select(F.concat_ws("/", F.lit("/home/a/vaults"), place, inside, F.concat(F.lit("n"), d.cast("string"), F.lit(".md"))).alias("path"), F.concat(F.lit("---\ntags: [a, b]\n---\n"), "text").alias("text"), d.alias("timestamp"))
    p = F.col("page_id")
    mark = F.concat(F.when(p % 3 == 0, "/home/a/elsewhere").when(p % 3 == 1, "/home/a/vaults/k2").otherwise("/home/a/vaults/k1"), F.lit("/.obsidian/c"), p.cast("string"))
    listing = note.unionByName(fx.table(spark, sf, "pages").select(mark.alias("path"), F.lit(None).cast("string").alias("text"), p.alias("timestamp")))
    found = discovery.vault_texts(discovery.vault_notes(listing, discovery.find_vault(listing, "/home/a")))
    return found.select("timestamp", F.md5("content").alias("content"), F.md5("summary").alias("summary"))


def _short(df: DataFrame) -> DataFrame:
    """A connector's items without the hash in their ids."""
    return df.select(F.md5("content").alias("content"), "memory_type", r6("importance"), "timestamp")


SQL_ITEM = "md5({c}) AS content, '{k}' AS memory_type, round({i}, 6) AS importance, CAST({t} AS BIGINT) AS timestamp"
VISITS = "least(0.8, 0.3 + ln(v) * 0.05)"


def _pages(spark, sf):
    h = fx.url_history(spark, sf)
    return h.select((F.col("page_id") % 3).alias("profile"), "url", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), "visit_count", "last_visit_time", "page_id")


@query(sql._with(sql.HIST, "r AS (SELECT *, 'page ' || page_id AS title FROM hist QUALIFY row_number() OVER (PARTITION BY page_id % 3 ORDER BY visit_count DESC, url) <= 40)")
    + "SELECT md5(title || chr(10) || url) AS content, 'Semantic' AS memory_type, CAST(last_visit_time // 1000 - 11644473600000 AS BIGINT) AS timestamp FROM r")
def connector_history(spark, sf):
    return _short(connectors.browser_history(_pages(spark, sf), most=40)).drop("importance")


@query(sql._with(sql.HIST, "r AS (SELECT *, 'page ' || page_id AS title FROM hist QUALIFY row_number() OVER (PARTITION BY page_id % 3 ORDER BY visit_count * 100 DESC, url) <= 30)")
    + "SELECT md5(title || chr(10) || url) AS content, 'Semantic' AS memory_type, CAST(page_id AS BIGINT) AS timestamp FROM r")
def connector_frecency(spark, sf):
    rows = _pages(spark, sf).withColumns({"frecency": F.col("visit_count") * 100, "timestamp": F.col("page_id")})
    return _short(connectors.frecency_history(rows, most=30)).drop("importance")


@query("""WITH v AS (SELECT p.url, event_id, 'title ' || event_id AS title FROM pages p JOIN events e ON e.event_id % (SELECT count(*) FROM pages) = p.page_id),
r AS (SELECT url, count(*) AS n, arg_max(title, event_id) AS title, max(event_id) AS last FROM v GROUP BY url ORDER BY n DESC, url LIMIT 100)
SELECT md5(title || chr(10) || url) AS content, 'Semantic' AS memory_type, CAST((last + 978307200) * 1000 AS BIGINT) AS timestamp FROM r""")
def connector_visits(spark, sf):
    pages, n = fx.table(spark, sf, "pages"), fx.table(spark, sf, "pages").agg(F.count("*").alias("n"))
    visits = fx.table(spark, sf, "events").crossJoin(F.broadcast(n)).select((F.col("event_id") % F.col("n")).alias("item"), F.concat(F.lit("title "), F.col("event_id").cast("string")).alias("title"), F.col("event_id").alias("seconds"))
    return _short(connectors.visited_items(pages.select(F.col("page_id").alias("item"), "url"), visits, most=100)).drop("importance")


@query(sql._with(sql._chunked("c", "(SELECT doc_id, text FROM documents WHERE strlen(text) >= 50)", "doc_id", "text", 512, 128)) + "SELECT " + SQL_ITEM.format(c="content", k="Goal", i="0.7", t="doc_id") + " FROM c")
def connector_plans(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.concat(F.lit("/plans/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", F.col("doc_id").alias("timestamp"))
    return _short(connectors.markdown_files(d, "plans", "Goal", 0.7, 50))


@query(sql._with(sql._chunked("c", "documents", "doc_id", "text", 512, 128)) + "SELECT " + SQL_ITEM.format(c="content", k="Semantic", i="0.6", t="doc_id") + " FROM c")
def connector_memory_notes(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.concat(F.lit("/notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", F.col("doc_id").alias("timestamp"))
    return _short(connectors.markdown_files(d, "memory", "Semantic", 0.6))


def _new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, source, length(text) AS chars, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def walked_files(spark, sf):
    """Documents written as lines of files below a folder and read by a walk, which enters neither hidden folders nor those of packages, where some lie."""
    folder = _new_folder(spark, "walk")
    d = fx.table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "source", "text")).alias("value"), "doc_id", (F.col("doc_id") % 7 == 0).alias("package"), (F.col("doc_id") % 11 == 0).alias("hidden"))
    for name, rows in {"a/node_modules/b": "package", "a/.b": "hidden and not package", "a/b": "not hidden and not package and doc_id % 2 = 0", "c": "not hidden and not package and doc_id % 2 <> 0"}.items():
        d.where(rows).select("value").write.text(f"{folder}/{name}")
    readers.register(spark)
    found = spark.read.format("folder_walk").load(folder).where(F.endswith("path", F.lit(".txt")) & F.col("valid"))
    one = found.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    x = F.from_json("line", "doc_id bigint, source string, text string")
    return one.select(x.alias("x")).select("x.doc_id", "x.source", F.length("x.text").alias("chars"), F.md5("x.text").alias("digest"))


def _mailbox(spark, sf) -> str:
    """Mail as a fetch gives it: fields and records between their separators, in files."""
    folder = _new_folder(spark, "mailbox")
    m = fx.emails(spark, sf).withColumn("account", F.lit("account"))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("message_id", "subject", "sender", "indexed_at", "mailbox", "account", "body")]
    m = m.select(F.concat_ws("␞", *fields).alias("value"))
    m.write.option("lineSep", "␟").text(folder)
    readers.register(spark)
    return folder


def _fetched(raw: DataFrame) -> DataFrame:
    recent = records.recent_mail(records.mail_records(raw.where("valid"), "record"), fx.T0 // 1000 + 30 * 86400 + 3600)
    return recent.select(F.col("message_id").cast("bigint").alias("message_id"), "mailbox", "date", F.md5("subject").alias("subject"), F.md5("body").alias("body"))


SQL_FETCHED = sql._with(sql.MAIL) + f"""SELECT message_id, mailbox, indexed_at AS date, md5(coalesce(regexp_replace(subject, '^{sql.WS}+|{sql.WS}+$', '', 'g'), '')) AS subject,
md5(substr(coalesce(regexp_replace(body, '^{sql.WS}+|{sql.WS}+$', '', 'g'), ''), 1, 2000)) AS body FROM mail
WHERE indexed_at BETWEEN {fx.T0 // 1000 + 3600} AND {fx.T0 // 1000 + 30 * 86400 + 3600} AND lower(mailbox) NOT IN {sql._in([m.lower() for m in labels.SKIPPED_MAILBOXES])}"""


@query(SQL_FETCHED)
def mailbox_fetch(spark, sf):
    """Mail of the last 30 days from files of records, which many tasks read by ranges of bytes."""
    return _fetched(spark.read.format("separated_records").option("separator", "␟").option("split_bytes", 1 << 20).load(_mailbox(spark, sf)))


@query(SQL_FETCHED)
def mailbox_stream(spark, sf):
    """The same as a stream, whose offsets are the bytes read of each file."""
    rows = spark.readStream.format("separated_records").option("separator", "␟").option("split_bytes", 1 << 20).load(_mailbox(spark, sf))
    out = _new_folder(spark, "mailbox-out")
    stream = _fetched(rows).writeStream.format("parquet").option("checkpointLocation", _new_folder(spark, "mailbox-offsets")).trigger(once=True).start(out)
    stream.awaitTermination()
    return spark.read.parquet(out)


@query(sql._with("d AS (SELECT text AS content FROM documents WHERE length(text) > 20 ORDER BY content LIMIT 1000)") + "SELECT " + SQL_ITEM.format(c="content", k="Procedural", i="0.5", t="0") + " FROM d")
def connector_notebook(spark, sf):
    """The first table of the catalog that is there and has a text column, by the registry's connector; its thousand first texts."""
    fx.table(spark, sf, "documents").createOrReplaceTempView("notebook_blocks")
    fx.table(spark, sf, "documents").select("doc_id").createOrReplaceTempView("notebook_keys")
    return _short(connectors.discovered_rows(spark, ["no_such_table", "notebook_keys", "notebook_blocks"]))


@query(sql._with(sql._chunked("n", "documents", "doc_id", "text", 512, 128), sql._chunked("p", "(SELECT doc_id, text FROM documents WHERE strlen(text) >= 50)", "doc_id", "text", 512, 128),
    "i AS (SELECT 'agent_memory' AS connector, doc_id, content FROM n UNION ALL SELECT 'plans', doc_id, content FROM p)", "k AS (SELECT * FROM i WHERE strlen(content) >= 20)")
    + "SELECT 1 AS import, connector, count_if(doc_id % 3 <> 0) AS created, 0 AS skipped FROM k GROUP BY connector UNION ALL SELECT 2, connector, count_if(doc_id % 3 = 0), count_if(doc_id % 3 <> 0) FROM k GROUP BY connector")
def import_counts(spark, sf):
    """Two imports through the registry, of which the second brings the first's files again: what the writing jobs count."""
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", F.col("doc_id").alias("timestamp"))
    registry, tables, counts = connectors.default_registry(), _store(spark), counters.Counters(spark)
    load = lambda rows: registry.load_into(tables, "items", {"agent_memory": (rows,), "plans": (rows,), "vault": (rows,)}, counts, config={"vault": False})
    first, second = load(d.where("doc_id % 3 <> 0")), load(d)
    return first.select(F.lit(1).alias("import"), "*").unionByName(second.select(F.lit(2).alias("import"), "*"))


@query(sql._with(sql.MEM, "q AS (SELECT vec_id AS n, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 5)")
    + "SELECT 'search ' || n AS name, count(*) AS scanned, count_if(list_cosine_similarity(vector, q) >= 0.1) AS above, least(10, count_if(list_cosine_similarity(vector, q) >= 0.1)) AS hits, true AS timed FROM memories, q GROUP BY n")
def search_counts(spark, sf):
    """Five searches that tell while they run how many memories they read and how many are near enough; their times are kept with the counts."""
    counts = counters.Counters(spark)
    hits = []
    for n in range(5):
        rows = search.scored(fx.memories(spark, sf), fx.query_vector(spark, sf, n))
        near = F.col("similarity") >= 0.1
        best = lambda seen: seen.where(F.col("similarity") >= 0.1).orderBy(F.desc("similarity"), "id").limit(10).select("id").collect()
        found, _ = counts.run(f"search {n}", rows, {"scanned": F.count("*"), "above": F.count_if(near)}, best)
        hits.append((f"search {n}", len(found)))
    told = counts.table().select("name", F.col("counts")["scanned"].alias("scanned"), F.col("counts")["above"].alias("above"), (F.col("micros") > 0).alias("timed"))
    return told.join(spark.createDataFrame(hits, "name string, hits bigint"), "name")


@query(sql._with("t AS (SELECT doc_id, text, len(" + sql._words("text") + ") AS n FROM documents WHERE text <> '')", sql._chunked("c", "(SELECT doc_id, text FROM t WHERE n > 500)", "doc_id", "text", 400, 50))
    + "SELECT " + SQL_ITEM.format(c="content", k="Semantic", i="0.6", t="doc_id") + " FROM c WHERE chunk_index < 5 UNION ALL SELECT " + SQL_ITEM.format(c="text", k="Semantic", i="0.6", t="doc_id") + " FROM t WHERE n <= 500")
def connector_vault(spark, sf):
    note = F.concat(F.lit("---\ntags: [a]\n---\n"), "text")
    d = fx.table(spark, sf, "documents").select(F.concat(F.lit("/v/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), note.alias("text"), F.col("doc_id").alias("timestamp"))
    return _short(connectors.vault(d))


@query("SELECT " + SQL_ITEM.format(c="'title ' || doc_id || chr(10) || md5(text)", k="Semantic", i="0.6", t="0") + " FROM documents")
def connector_notes(spark, sf):
    d = F.col("doc_id").cast("string")
    note = F.concat(F.lit("<<<NOTE_START>>>\nID: n"), d, F.lit("\nTITLE: title "), d, F.lit("\nFOLDER: f\nBODY: "), F.md5("text"), F.lit("\n<<<NOTE_END>>>\n"))
    return _short(connectors.marked_notes(fx.table(spark, sf, "documents").select(note.alias("text"))))


@query("""WITH l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' END || text || chr(10) || chr(10) AS t FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''),
w AS (SELECT conv_id, string_agg(t, '' ORDER BY turn) AS body FROM l GROUP BY 1)"""
    + ",\n" + sql._chunked("c", "(SELECT * FROM w WHERE strlen(body) >= 50)", "conv_id", "body", 400, 50) + " SELECT " + SQL_ITEM.format(c="content", k="Episodic", i="0.5", t="conv_id") + " FROM c WHERE chunk_index < 15")
def connector_sessions(spark, sf):
    t = fx.table(spark, sf, "conversations")
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    lines = t.select(F.concat(F.lit("/s/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("n"), line.alias("line"), F.col("conv_id").alias("timestamp"))
    return _short(connectors.agent_conversations(lines, "desktop_sessions", 15, 0.5))


# Activity, learning and upkeep


def _paths(spark, sf):
    return fx.activity(spark, sf).withColumn("path", F.when(F.col("id") % 3 == 0, F.concat(F.lit("/w/"), F.col("id").cast("string"))))


@query(sql._with(sql.ACT, "l AS (SELECT * FROM act ORDER BY timestamp DESC, id DESC LIMIT 1)", "p AS (SELECT timestamp, id FROM act WHERE id % 3 = 0 ORDER BY timestamp DESC, id DESC LIMIT 10)")
    + f"SELECT app_name, window_title, project, greatest({fx.AS_OF} - timestamp, 0) // 1000 AS idle_seconds, (SELECT list('/w/' || id ORDER BY timestamp DESC, id DESC) FROM p) AS recent FROM l")
def activity_now(spark, sf):
    return assist.activity_now(_paths(spark, sf), fx.AS_OF)


@query(sql._with(sql.MEM) + "SELECT count(*) AS n, round(avg(importance), 6) AS avg_importance, round(avg(decay), 6) AS avg_decay, CAST(sum(access_count) AS BIGINT) AS accesses, CAST(sum(vec_id % 4) // 2 AS BIGINT) AS connections FROM memories")
def memory_stats_connected(spark, sf):
    m = fx.memories(spark, sf).withColumn("connections", F.array_repeat(F.lit("x"), (F.col("vec_id") % 4).cast("int")))
    return assist.stats_connected(m).select("n", r6("avg_importance"), r6("avg_decay"), "accesses", "connections")


def _texted(spark, sf):
    """Memories with a document's text as content and their vector packed; every tenth has no vector."""
    m = fx.memories(spark, sf).join(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content")), "vec_id")
    packed = vectors.packed(F.col("vector").cast("array<float>"))
    return m.withColumn("blob", F.when(F.col("vec_id") % 10 == 1, vectors.packed(F.slice("vector", 1, 0).cast("array<float>"))).otherwise(packed)).drop("vector")


TEXTED = "texted AS (SELECT m.*, d.text AS content FROM memories m JOIN documents d ON d.doc_id = m.vec_id)"


@query(sql._with(sql.MEM, TEXTED, "b AS (SELECT * FROM texted WHERE vec_id % 3 <> 0 ORDER BY timestamp, id LIMIT 40)")
    + "SELECT id, CASE WHEN memory_type = 'Episodic' THEN 'Episodic' ELSE 'Semantic' END AS kind, len(vector) AS dim, md5(substr(content, 1, 2000)) AS content FROM b WHERE vec_id % 10 <> 1")
def bridge_import(spark, sf):
    """A batch of 40 oldest memories without a reference; some have no vector."""
    m = _texted(spark, sf)
    out = assist.bridge_import(m, m.where("vec_id % 3 = 0").select("id"), 40)
    return out.select("id", "kind", F.size("vector").cast("bigint").alias("dim"), F.md5("content").alias("content"))


def _runs(n: int, limit: int) -> str:
    ctes = [sql.MEM, TEXTED, "r0 AS (SELECT id FROM texted WHERE false)"]
    for k in range(1, n + 1):
        ctes += [f"b{k} AS MATERIALIZED (SELECT id, vec_id % 10 <> 1 AS ok FROM texted WHERE id NOT IN (SELECT id FROM r{k - 1}) ORDER BY timestamp, id LIMIT {limit})",
                 f"r{k} AS MATERIALIZED (SELECT id FROM r{k - 1} UNION ALL SELECT id FROM b{k} WHERE ok)"]
    rows = " UNION ALL ".join(f"SELECT {k} AS run, count_if(ok) AS imported, count_if(NOT ok) AS skipped FROM b{k}" for k in range(1, n + 1))
    return sql._with(*ctes) + f"SELECT r.*, total, processed, total - processed AS remaining FROM ({rows}) r, (SELECT (SELECT count(*) FROM texted) AS total, (SELECT count(*) FROM r{n}) AS processed)"


@query(_runs(3, 50))
def bridge_runs(spark, sf):
    """Three batches that leave their references, what each counted while it wrote, and the bridge's state afterwards."""
    tables, counts, m = _store(spark), counters.Counters(spark), _texted(spark, sf)
    told = [assist.bridge_run(tables, m, counts, fx.AS_OF + k, 50) for k in range(3)]
    rows = spark.createDataFrame([(k + 1, t["imported"], t["skipped"]) for k, t in enumerate(told)], "run int, imported bigint, skipped bigint")
    return rows.crossJoin(F.broadcast(assist.bridge_status(m, tables.read("refs", ["id"]))))  # one row


@query("""WITH r AS (SELECT event_id AS id, (event_id % 21 - 10) / 5 AS reward FROM events)
SELECT id, CASE WHEN reward > 0 THEN 'Evaluation' ELSE 'Reflection' END AS kind, printf('Trajectory recorded: reward=%.2f, quality=%.2f', reward, least(greatest((reward + 1) / 2, 0), 1)) AS content, round(least(abs(reward), 1), 6) AS confidence FROM r ORDER BY id DESC LIMIT 10""")
def recent_thoughts(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") % 21 - 10) / 5).alias("reward"), F.col("event_id").alias("timestamp"))
    return records.last_n(assist.thoughts(e), [F.desc("timestamp")], 10).select("id", "kind", "content", r6("confidence"))


@query(sql._with(sql.MEM, sql.Q) + "SELECT CAST(floor(importance * 100) % 100 AS BIGINT) AS action FROM memories, q ORDER BY list_cosine_similarity(vector, q) DESC, id LIMIT 1")
def pattern_action(spark, sf):
    return assist.pattern_action(fx.memories(spark, sf).select("id", "vector", F.col("importance").alias("quality")), fx.query_vector(spark, sf))


@query("""WITH e AS (SELECT event_id AS i, event_id % 17 / 17 AS reward FROM events), l AS (SELECT * FROM e ORDER BY i DESC LIMIT 100),
t AS (SELECT avg(reward) AS a, coalesce(regr_slope(reward, i), 0) AS s FROM l)
SELECT (SELECT count(*) FROM e) AS experiences, (SELECT greatest(count(*) - 31, 0) FROM e) AS updates, (SELECT count(DISTINCT (user_id % 20, event_id % 4)) FROM events) AS q_size, round(a, 6) AS avg_reward, round(s, 6) AS trend, CAST(CASE WHEN s < -0.05 THEN 0.11 WHEN s > 0.05 THEN 0.095 ELSE 0.1 END AS DOUBLE) AS exploration FROM t""")
def learner_stats(spark, sf):
    e = fx.table(spark, sf, "events")
    q = e.select((F.col("user_id") % 20).alias("state"), (F.col("event_id") % 4).alias("action")).distinct()
    out = assist.learner_stats(e.select(F.col("event_id").alias("i"), (F.col("event_id") % 17 / 17).alias("reward")), q)
    return out.withColumns({"avg_reward": r6("avg_reward"), "trend": r6("trend")})


@query("""SELECT 'q' AS part, user_id % 20 AS state, event_id % 4 AS action, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 2, 3
UNION ALL SELECT 'experience', user_id % 20, event_id % 4, round(sum(event_id % 5 / 4), 6), count(*) FROM events GROUP BY 2, 3 UNION ALL SELECT 'rate', NULL, NULL, 1.0, 1""")
def learner_moved(spark, sf):
    """A learner written as lines by two exports, of which the second repeats the first, and read elsewhere; its rate of 1.5 is held to 1."""
    e = fx.table(spark, sf, "events")
    state, action = (F.col("user_id") % 20).cast("bigint").alias("state"), (F.col("event_id") % 4).cast("bigint").alias("action")
    q = e.groupBy(state, action).agg(F.avg("value").alias("value"), F.count("*").alias("visits"))
    seen = e.select(F.col("event_id").cast("bigint").alias("i"), state, action, (F.col("event_id") % 5 / 4).alias("reward"), state.alias("next_state"), F.lit(False).alias("done"))
    folder = _new_folder(spark, "learner")
    for _ in range(2):
        learnloop.exported(q, seen, 1.5).write.mode("append").text(folder)
    q, seen, rate = learnloop.imported(spark.read.text(folder))
    out = q.select(F.lit("q").alias("part"), "state", "action", r6("value"), F.col("visits").alias("n"))
    out = out.unionByName(seen.groupBy("state", "action").agg(r6(F.sum("reward"), "value"), F.count("*").alias("n")).withColumn("part", F.lit("experience")))
    none = F.lit(None).cast("bigint")
    return out.unionByName(rate.select(F.lit("rate").alias("part"), none.alias("state"), none.alias("action"), F.col("exploration").alias("value"), F.lit(1).cast("bigint").alias("n")))


@query("""WITH b AS (SELECT source, substr(text, 1, 40) AS content, least(doc_id / 500, 1) AS confidence, doc_id AS timestamp FROM documents),
o AS (SELECT * FROM b WHERE timestamp % 2 = 0), n AS (SELECT * FROM b),
f AS (SELECT content, source, min((timestamp, confidence)) AS r FROM o GROUP BY ALL), g AS (SELECT content, source, min((timestamp, confidence)) AS r FROM n GROUP BY ALL)
SELECT md5(content) AS content, source, round(r[2], 6) AS confidence, CAST(r[1] AS BIGINT) AS timestamp FROM f UNION ALL SELECT md5(content), source, round(r[2], 6), CAST(r[1] AS BIGINT) FROM g WHERE (content, source) NOT IN (SELECT (content, source) FROM f)""")
def beliefs_added(spark, sf):
    """Beliefs in two lots, of which the second brings the first's again; those stay as they were."""
    d = fx.table(spark, sf, "documents").select(F.substring("text", 1, 40).alias("content"), (F.col("doc_id") / 500).alias("confidence"), "source", F.col("doc_id").alias("timestamp"))
    none = spark.createDataFrame([], "id string, content string, confidence double, source string, timestamp bigint")
    out = lifecycle.added_beliefs(lifecycle.added_beliefs(none, d.where("timestamp % 2 = 0")), d)
    return out.select(F.md5("content").alias("content"), "source", r6("confidence"), "timestamp")


def _introspected(spark, sf) -> tuple[DataFrame, DataFrame]:
    m, e = fx.memories(spark, sf), fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") % 21 - 10) / 5).alias("reward"), F.col("event_id").alias("timestamp"), "value")
    goals, thoughts = m.select("id", lifecycle.goal_status(F.col("decay")).alias("status")), assist.thoughts(e)
    phases = e.select(F.col("value").alias("phase"))
    return browse.introspection(m, thoughts, goals, e, m.where("importance >= 0.3"), learning.order_parameter(phases), 1000), thoughts


@query(sql._with(sql.MEM) + """SELECT count(*) AS memories, (SELECT count(*) FROM events) AS thoughts, (SELECT least(count(*), 1000) FROM events) AS experiences, count_if(vec_id * 53 % 120 < 100) AS active_goals,
  round((SELECT sqrt(pow(avg(cos(value)), 2) + pow(avg(sin(value)), 2)) FROM events), 6) AS avg_reward,
  CASE WHEN count_if(importance >= 0.3) > 10 AND (SELECT sqrt(pow(avg(cos(value)), 2) + pow(avg(sin(value)), 2)) FROM events) > 0.5 THEN 'improving' WHEN (SELECT count(*) FROM events) > 1000 THEN 'declining' ELSE 'stable' END AS trend FROM memories""")
def introspection(spark, sf):
    """The state of all parts in one row; goals are as far as their memory has decayed."""
    out = _introspected(spark, sf)[0]
    return out.withColumn("avg_reward", r6("avg_reward"))


@query("""WITH r AS (SELECT event_id AS id, (event_id % 21 - 10) / 5 AS reward FROM events),
l AS (SELECT string_agg('  - [' || CASE WHEN reward > 0 THEN 'Evaluation' ELSE 'Reflection' END || '] ' || printf('Trajectory recorded: reward=%.2f, quality=%.2f', reward, least(greatest((reward + 1) / 2, 0), 1)), chr(10) ORDER BY id DESC) AS lines FROM (SELECT * FROM r ORDER BY id DESC LIMIT 5)),
s AS (SELECT (SELECT count(*) FROM embeddings) AS m, count(*) AS n, least(count(*), 1000) AS x, sqrt(pow(avg(cos(value)), 2) + pow(avg(sin(value)), 2)) AS sync FROM events)
SELECT printf('Brain Status: healthy' || chr(10) || 'Memories: %d, Thoughts: %d, Experiences: %d' || chr(10) || 'Learning Trend: %s' || chr(10) || 'Recent Thoughts:' || chr(10) || '%s', m, n, x,
  CASE WHEN (SELECT count_if(vec_id * 37 % 100 >= 30) FROM embeddings) > 10 AND sync > 0.5 THEN 'improving' WHEN n > 1000 THEN 'declining' ELSE 'stable' END, lines) AS message FROM s, l""")
def state_summary(spark, sf):
    """The state and the newest thoughts as one text."""
    return workflows.state_text(*_introspected(spark, sf))


@query("SELECT true AS success, event_type || ' copied as number ' || event_id AS preview, 'Working' AS memory_type, 0.6::DOUBLE AS importance, epoch_us(ts) // 1000 AS timestamp FROM events ORDER BY ts DESC, preview DESC LIMIT 1")
def clipboard_remembered(spark, sf):
    """The text that was copied last as a memory, asked for twice."""
    e, tables, counts = fx.table(spark, sf, "events"), _store(spark), counters.Counters(spark)
    copied = e.select(F.concat("event_type", F.lit(" copied as number "), F.col("event_id").cast("string")).alias("content"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    for _ in range(2):
        out = workflows.remember_clipboard(tables, copied, counts)
    return out.join(tables.read("memories", ["id"]), "id").select("success", "preview", "memory_type", r6("importance"), "timestamp")


@query("""WITH e AS (SELECT event_id AS i, user_id AS state, event_id % 5 / 4 AS reward, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS v FROM events)
SELECT i, round(reward + CASE WHEN v = 0 THEN 1 ELSE 1 / (1 + sqrt(v)) END, 6) AS total FROM e ORDER BY i DESC LIMIT 200""")
def replay_buffer(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("state"), (F.col("event_id") % 5 / 4).alias("reward"))
    return assist.replay(e, 200).select("i", r6("total"))


@query("""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_filter(range(8), lambda k: k <= vec_id % 8) AS kept FROM embeddings),
s AS (SELECT vec_id, list_transform(range(1, 9), lambda j: list_sum(list_transform(kept, lambda k: v[k * 8 + j])) / len(kept)) AS m FROM t)
SELECT vec_id, list_transform(m, lambda x: round(x / sqrt(list_dot_product(m, m)), 6)) AS pooled FROM s""")
def mean_pooled(spark, sf):
    """Each vector's 64 numbers as eight token vectors, of which the first few are real."""
    e = fx.table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k <= F.col("vec_id") % 8).cast("int"))
    return e.select("vec_id", "v", tokens.alias("tokens"), mask.alias("mask")).select("vec_id", vectors.rounded(assist.mean_pooled(F.col("tokens"), F.col("mask"))).alias("pooled"))


@query("""WITH t AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'remote' ELSE 'hash' END AS provider, CASE WHEN vec_id % 3 = 1 THEN (embedding::DOUBLE[])[1:16] ELSE (embedding::DOUBLE[])[1:32] END AS v FROM embeddings)
SELECT vec_id, provider, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) || CASE WHEN vec_id % 3 = 1 THEN list_transform(range(16), lambda i: 0.0::DOUBLE) ELSE [] END AS vector FROM t""")
def embedded_by_provider(spark, sf):
    e = fx.table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    k = F.col("vec_id") % 3
    vector, name = assist.embedded({"model": F.when(k == 0, F.col("v")), "remote": F.when(k == 1, F.slice("v", 1, 16)), "hash": F.col("v")}, 32)
    return e.select("vec_id", name.alias("provider"), vectors.rounded(vector).alias("vector"))


@query("SELECT event_id AS tick, CASE WHEN event_id % 100 = 0 THEN 'consolidate' ELSE 'tick' END AS step FROM events")
def maintenance_cycles(spark, sf):
    return assist.cycles(fx.table(spark, sf, "events").select(F.col("event_id").alias("tick")))


@query("SELECT 'g' || vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE least(vec_id / 100, 1) END::DOUBLE AS priority, CASE WHEN vec_id % 2 = 0 THEN 'Active' ELSE 'Pending' END AS status FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def goals_added(spark, sf):
    v = fx.table(spark, sf, "embeddings").select("vec_id")
    name = F.concat(F.lit("g"), F.col("vec_id").cast("string")).alias("id")
    goals = v.where("vec_id % 2 = 0").select(name, F.lit("d").alias("description"), F.lit(0.5).alias("priority"), F.lit(0.4).alias("progress"), lifecycle.goal_status(F.lit(0.4)).alias("status"))
    return assist.added_goals(goals, v.where("vec_id % 3 = 0").select(name, F.lit("d").alias("description"), (F.col("vec_id") / 100).alias("priority"))).select("id", "priority", "status")


@query(sql._with(sql.MEM, sql.EDGES) + "SELECT id, ['Memory', memory_type] AS labels, (SELECT count(*) FROM edges e WHERE e.src = m.id) AS out_edges FROM memories m")
def graph_nodes(spark, sf):
    out = fx.edges(spark, sf).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_edges"))
    return fx.memories(spark, sf).select("id", F.array(F.lit("Memory"), "memory_type").alias("labels")).join(out, "id", "left").select("id", "labels", F.coalesce("out_edges", F.lit(0)).alias("out_edges"))


KINDS = """kinds AS (SELECT kind, key, timestamp, searched FROM items UNION ALL SELECT 'mail', CAST(message_id AS VARCHAR), indexed_at, lower(subject || chr(10) || sender) FROM mail
  UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), 0, lower(url) FROM pages UNION ALL SELECT 'activity', CAST(id AS VARCHAR), timestamp, lower(window_title || chr(10) || app_name) FROM act
  UNION ALL SELECT 'chat', conv_id || '/' || turn, turn, lower(text) FROM conversations)"""


@query(sql._with(sql.MEM, sql.FILES, sql.MAIL, sql.ACT, sql.ITEMS, KINDS) + "SELECT kind, key, timestamp FROM kinds WHERE contains(searched, 'e') ORDER BY timestamp DESC, kind, key LIMIT 100")
def browse_all(spark, sf):
    """Items of six kinds."""
    kinds = [
        *_items(spark, sf), browse.items(fx.emails(spark, sf), "mail", "message_id", ["subject", "sender"], timestamp="indexed_at"), browse.items(fx.table(spark, sf, "pages"), "page", "page_id", ["url"]),
        browse.items(fx.activity(spark, sf), "activity", "id", ["window_title", "app_name"], timestamp="timestamp"),
        browse.items(fx.table(spark, sf, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn")), "chat", "key", ["text"], timestamp="turn"),
    ]
    return browse.browse(kinds, "E").select("kind", "key", "timestamp")


# Streams


CHANGES = f"""WITH c AS (SELECT ts, CASE event_id % 4 WHEN 0 THEN '/home/.cache/' WHEN 1 THEN '/home/sessions/' ELSE '/data/' END || user_id || CASE event_id % 3 WHEN 0 THEN '.jsonl' WHEN 1 THEN '/history.jsonl' ELSE '.md' END AS path FROM events),"""


def _changes(spark, sf):
    e = F.col("event_id")
    path = F.concat(F.when(e % 4 == 0, "/home/.cache/").when(e % 4 == 1, "/home/sessions/").otherwise("/data/"), F.col("user_id").cast("string"), F.when(e % 3 == 0, ".jsonl").when(e % 3 == 1, "/history.jsonl").otherwise(".md"))
    return _stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), path.alias("path"))


def _bursts_sql(where: str, seconds: int) -> str:
    return CHANGES + f"""e AS (SELECT ts, path, lag(ts) OVER (ORDER BY ts) AS before FROM c WHERE {where}), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL {seconds} SECOND THEN 1 ELSE 0 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS changes, list_sort(list(DISTINCT path)) AS paths FROM s GROUP BY n"""


def _run(spark, rows: DataFrame, seconds: int, then=None) -> DataFrame:
    stream = BurstStream(spark, _stream_dir(spark), seconds * 1_000_000, then=then)
    stream.close(rows)  # the input is bounded: its last burst too
    return stream.bursts().select(F.unix_millis("start").alias("start_ms"), "changes", "paths")


@query(_bursts_sql("path NOT LIKE '%/.cache/%' AND path LIKE '%.md'", 600))
def stream_admitted_files(spark, sf):
    """Bursts of changed files, of those that are admitted to the index."""
    return _run(spark, _changes(spark, sf).where(labels.should_index(F.col("path"), F.lit(1)) & F.endswith("path", F.lit(".md"))), 600)


@query(_bursts_sql("path LIKE '%.jsonl' AND path NOT LIKE '%history.jsonl'", 5))
def stream_conversations(spark, sf):
    """Bursts of changed conversations, five seconds apart; histories are no conversations."""
    return _run(spark, assist.conversation_changes(_changes(spark, sf)).select("ts", "path"), 5)


@query(
    CHANGES.rstrip(",") + """, p AS (SELECT DISTINCT path, CAST(regexp_extract(path, '([0-9]+)[.]jsonl$', 1) AS BIGINT) AS conv_id FROM c WHERE path LIKE '%.jsonl' AND path NOT LIKE '%history.jsonl'),
t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text || chr(10) || chr(10), '' ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id), t2 AS (SELECT * FROM t WHERE strlen(transcript) >= 50),
""" + sql._chunked("c2", "t2", "conv_id", "transcript", 400, 50) + " SELECT path, chunk_index, md5(content) AS chunk FROM c2 JOIN p USING (conv_id) WHERE chunk_index < 15"
)
def stream_conversation_import(spark, sf):
    """The first fifteen segments of each conversation file that a burst names; each burst's files are imported as it ends, and a file that was there adds nothing."""
    folder = _stream_dir(spark)
    schema = "path string, chunk_index long, chunk string"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/memories/batch=-1")
    transcripts = records.transcripts(fx.table(spark, sf, "conversations"))

    def take(bursts: DataFrame, n: int) -> None:
        paths = bursts.select(F.explode("paths").alias("path")).distinct().withColumn("conv_id", F.regexp_extract("path", r"([0-9]+)\.jsonl$", 1).cast("long"))
        known = spark.read.schema(schema + ", batch int").parquet(f"{folder}/memories").where(F.col("batch") < n).select("path").distinct()
        rows = records.segments(transcripts.join(paths, "conv_id").join(known, "path", "left_anti"), "path", "transcript", most=15)
        rows.select("path", F.col("chunk_index").cast("long"), F.md5("chunk").alias("chunk")).write.mode("overwrite").parquet(f"{folder}/memories/batch={n}")

    _run(spark, assist.conversation_changes(_changes(spark, sf)).select("ts", "path"), 5, take)
    return spark.read.schema(schema).parquet(f"{folder}/memories").select("path", "chunk_index", "chunk")
