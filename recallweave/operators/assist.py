"""From a text that comes in to the tables that change, and from a question to its answer."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text, vectors
from . import graph, search

#: The sentences of an answer that no model writes, and the confidence without a hit.
FOUND = "I couldn't reach the AI model, but here's what I found:\n\n"
BASED = "Based on %d relevant memories: %s"
NOTHING = "No relevant information found. The AI model may be loading — try again in a moment."
UNSURE = 0.1
#: Common folders below the home folder, by label.
COMMON_FOLDERS = {
    "Home": "",
    "Documents": "Documents",
    "Desktop": "Desktop",
    "Downloads": "Downloads",
    "iCloud Drive": "Library/Mobile Documents/com~apple~CloudDocs",
    "Projects": "Projects",
    "Developer": "Developer",
}


class Remembered(NamedTuple):
    memories: DataFrame
    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame


def fresh(existing: DataFrame, new: DataFrame, dim: int | None = None, least_bytes: int = 0) -> DataFrame:
    """The rows of new (id, content, vector, memory_type, importance, timestamp) that become memories: with enough content, a vector of
    the dimension and an id that isn't there; one for each id. Vectors are normalised, types parsed; decay and access count begin at 0."""
    rows = new.where(F.octet_length(text.strip(F.col("content"))) >= least_bytes)
    rows = rows if dim is None else rows.where(F.size("vector") == dim)
    rows = rows.join(existing.select("id"), "id", "left_anti")
    # Of new rows with one id the first by time, then by content, counts.
    once = rows.groupBy("id").agg(F.min(F.struct("timestamp", "content", F.col("memory_type").alias("memory_type"), "importance", F.col("vector").alias("vector"))).alias("r"))
    return as_memories(once.where("id is not null").select("id", "r.*"))


def as_memories(rows: DataFrame) -> DataFrame:
    """New memories' columns: vectors are normalised, types parsed; decay and access count begin at 0."""
    return rows.select("id", "content", vectors.normalize(vectors.doubles(F.col("vector"))).alias("vector"), labels.memory_type(F.col("memory_type")).alias("memory_type"), "importance", F.lit(0.0).alias("decay"), F.lit(0).cast("bigint").alias("access_count"), "timestamp")


def remember(existing: DataFrame, new: DataFrame, k: int = 5, above: float = 0.5, confidence: float = 0.6, dim: int | None = None, least_bytes: int = 0) -> Remembered:
    """The memories with the new ones; nodes of these (labels Memory and the type); edges from each to what a recall of k, itself
    among them, finds above a similarity; a hyperedge of itself and up to four where there are two. New memories see each other."""
    own = fresh(existing, new, dim, least_bytes)
    both = existing.select(*own.columns).unionByName(own)
    weighted = both.select("id", "vector", F.greatest(1 - F.col("decay"), F.lit(0.5)).alias("weight"))
    near = search.pairs_above(weighted, k - 1, above, only=own.select("id"), weight="weight")
    edges = near.select("src", "dst", "similarity", F.lit("similar_to").alias("kind"), F.lit(confidence).alias("confidence"))
    nodes = own.select("id", F.array(F.lit("Memory"), "memory_type").alias("labels"))
    return Remembered(both, nodes, edges, graph.hyperedges(near))


def merged(hits: DataFrame, more: DataFrame) -> DataFrame:
    """hits and those of a second recall that aren't among them."""
    return hits.unionByName(more.join(hits.select("id"), "id", "left_anti").select(*hits.columns))


def answer(hits: DataFrame, context: DataFrame, limit: int = 2000) -> DataFrame:
    """response, confidence, memories: what is said when no model answers, from a top-k of hits (id, similarity, content) and one row of
    further context; the confidence is the best similarity."""
    best = F.struct("similarity", "id")
    top = hits.agg(F.count("*").alias("memories"), F.max("similarity").alias("top"), F.max_by("content", best).alias("content"))
    one = top.crossJoin(F.broadcast(context))  # one row each
    extra = F.coalesce("context", F.lit(""))
    said = F.when(extra != "", F.concat(F.lit(FOUND), F.substring(extra, 1, limit))).when(F.col("memories") > 0, F.format_string(BASED, "memories", F.coalesce("content", F.lit("")))).otherwise(F.lit(NOTHING))
    return one.select(said.alias("response"), F.coalesce("top", F.lit(UNSURE)).alias("confidence"), "memories")


def recall_filtered(rows: DataFrame, query: DataFrame, k: int, source: str | None = None, types: list[str] | None = None) -> DataFrame:
    """As a vector index with a filter on its metadata answers: of the 2 k nearest of a source (4 k where types are asked for too) the
    k best of the types, weighed by their decay."""
    kept = rows if source is None else rows.where(F.col("source") == source)
    near = search.scored(kept, query).drop("vector").orderBy(F.desc("similarity"), "id").limit(k * (4 if types else 2))
    if types:
        near = near.where(F.lower("memory_type").isin(*[t.lower() for t in types]))
    near = near.withColumn("similarity", F.col("similarity") * F.greatest(1 - F.col("decay"), F.lit(0.5)))
    return near.orderBy(F.desc("similarity"), "id").limit(k)


def search_mail(chunks: DataFrame, files: DataFrame, mail: DataFrame, query: DataFrame, k: int, least: float = 0.15, fetch: int = 3) -> DataFrame:
    """Of the `fetch` * k nearest chunks those with at least `least`, with their file and, by the key `mail://id`, their message."""
    near = search.scored(chunks, query).drop("vector").orderBy(F.desc("similarity"), "file_path", "chunk_index").limit(k * fetch).where(F.col("similarity") >= least)
    near = files.select(F.col("path").alias("file_path")).join(F.broadcast(near), "file_path")  # near has k * fetch rows
    found = mail.withColumn("file_path", F.concat(F.lit("mail://"), F.col("message_id").cast("string"))).join(F.broadcast(near), "file_path")
    return found.orderBy(F.desc("similarity"), "message_id", "chunk_index").limit(k)


def folder_entries(files: DataFrame, parent: str, indexed: list[str]) -> DataFrame:
    """Folders right below a parent: their immediate children, how many of these are folders, the latest change, and whether they
    lie in, or hold, an indexed folder. Hidden names don't count."""
    root = parent.rstrip("/") + "/"
    parts = F.split(F.substring("path", len(root) + 1, 1 << 20), "/")
    inside = files.where(F.startswith("path", F.lit(root))).select(parts.alias("p"), "modified").where(F.size("p") > 1)
    rows = inside.select(F.col("p")[0].alias("name"), F.col("p")[1].alias("child"), (F.size("p") > 2).alias("folder"), "modified")
    seen = F.when(~F.startswith("child", F.lit(".")), F.col("child"))
    path = F.concat(F.lit(root), "name")
    flag = F.exists(F.array(*[F.lit(f) for f in indexed]), lambda f: F.startswith(path, f) | F.startswith(f, path)) if indexed else F.lit(False)
    out = rows.where(~F.startswith("name", F.lit("."))).groupBy("name").agg(F.count_distinct(seen).alias("items"), F.count_distinct(F.when(F.col("folder"), seen)).alias("subfolders"), F.max("modified").alias("modified"))
    return out.select("name", path.alias("path"), "items", "subfolders", "modified", flag.alias("indexed")).orderBy(F.lower("name"), "name")


def common_folders(files: DataFrame, home: str) -> DataFrame:
    """label, path, there: whether any file lies below it."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(f"{home}/{v}".rstrip("/")).alias("path")) for k, v in COMMON_FOLDERS.items()])
    folders = files.sparkSession.range(1).select(F.explode(rows).alias("f")).select("f.*")
    upto = F.substring(F.col("file"), F.lit(1), F.length("path") + 1)
    found = folders.join(files.select(F.col("path").alias("file")), upto == F.concat("path", F.lit("/")), "left_semi")  # seven folders
    return folders.join(found.select("path", F.lit(True).alias("there")), "path", "left").select("label", "path", F.coalesce("there", F.lit(False)).alias("there"))


def period_label(first: Column, last: Column) -> Column:
    """The months that a chat spans."""
    a, b = F.date_format(first, "MMM yyyy"), F.date_format(last, "MMM yyyy")
    return F.when(first.isNull() | last.isNull(), "unknown dates").when(a == b, a).otherwise(F.concat(a, F.lit(" – "), b))


def chat_texts(messages: DataFrame, whole: int = 100, snippets: int = 8, chars: int = 80) -> DataFrame:
    """chat, period, label, summary, content, messages, last of chats (chat, name, sender, text, ts, n): a memory each, or one a month if longer. The summary has the
    longest messages' beginnings, distinct whatever their case; the content every message in order. A memory's messages are what is collected."""
    said = messages.where(F.length("text") > 20)
    size = said.groupBy("chat").agg(F.count("*").alias("all"))
    rows = said.join(size, "chat").withColumn("period", F.when(F.col("all") <= whole, F.lit("all")).otherwise(F.date_format("ts", "yyyy-MM")))
    own = ["chat", "name", "period"]
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), "sender", F.lit(": "), "text")
    body = rows.groupBy(*own).agg(F.count("*").alias("messages"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "n", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    begin = rows.withColumn("snippet", F.substring("text", 1, chars)).groupBy(*own, F.lower("snippet").alias("key")).agg(F.max(F.struct(F.octet_length("text").alias("size"), (-F.col("n")).alias("n"), "snippet")).alias("best"))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("best.size"), F.desc("best.n")))
    topics = begin.withColumn("r", rank).where(F.col("r") <= snippets).groupBy(*own).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "best.snippet"))), lambda x: x["snippet"]), "; ").alias("topics"))
    label = period_label(F.col("first"), F.col("last"))
    head = F.concat(F.lit("WhatsApp conversation with "), "name")
    summary = F.concat(head, F.lit(" ("), label, F.lit(", "), F.col("messages").cast("string"), F.lit(" messages). Topics: "), "topics")
    return body.join(topics, own).select("chat", "period", label.alias("label"), summary.alias("summary"), F.concat(head, F.lit(" — "), label, F.lit("\n\n"), "lines").alias("content"), "messages", "last")


def profile_summary(profiles: DataFrame) -> DataFrame:
    """One text: how many profiles each browser has."""
    counts = profiles.groupBy("browser").agg(F.count("*").alias("n"))
    part = F.concat("browser", F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " profile)").otherwise(" profiles)"))
    return counts.agg(F.array_join(F.sort_array(F.collect_list(part)), ", ").alias("details"))  # a row for each browser


def activity_now(activity: DataFrame, as_of_ms: int, files: int = 10) -> DataFrame:
    """The latest activity, the seconds since, and the newest paths."""
    latest = activity.agg(F.max_by("app_name", F.struct("timestamp", "id")).alias("app_name"), F.max_by("window_title", F.struct("timestamp", "id")).alias("window_title"), F.max_by("project", F.struct("timestamp", "id")).alias("project"), F.max("timestamp").alias("last"))
    recent = activity.where("path is not null").orderBy(F.desc("timestamp"), F.desc("id")).limit(files).agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "id", "path")), asc=False), lambda x: x["path"]).alias("recent"))
    idle = F.when(F.col("last") > 0, F.floor(F.greatest(F.lit(as_of_ms) - F.col("last"), F.lit(0)) / 1000)).otherwise(F.lit(0))
    return latest.select("app_name", "window_title", "project", idle.alias("idle_seconds")).crossJoin(F.broadcast(recent))  # one row each


def of_accounts(mail: DataFrame, allowed: list[str]) -> DataFrame:
    """Mail of the allowed accounts, by their name or any of their addresses, whatever the case; all without a list."""
    wanted = [a.lower() for a in allowed]
    return mail.where(F.lower("account").isin(*wanted) | F.exists("addresses", lambda a: F.lower(a).isin(*wanted))) if wanted else mail


def _bridge_batch(memories: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """The oldest memories without a reference, with decoded vectors; what can't be decoded has an empty one."""
    rows = memories.join(refs.select("id"), "id", "left_anti").orderBy("timestamp", "id").limit(limit)
    vector = vectors.unpacked(F.col("blob"))
    return rows.withColumn("vector", F.coalesce(vector, F.slice(vector, 1, 0), F.array().cast("array<double>")))


def _bridged(batch: DataFrame, most_chars: int) -> DataFrame:
    c = labels.context_of(F.col("id"))
    kind = F.when(F.col("memory_type") == "Episodic", "Episodic").otherwise("Semantic")
    rows = batch.where(F.size("vector") > 0)
    return rows.select("id", F.substring("content", 1, most_chars).alias("content"), "vector", kind.alias("kind"), c["topic"].alias("topic"), text.gist(F.col("content")).alias("gist"), F.array_join(text.concepts(F.col("content")), ", ").alias("concepts"))


def bridge_import(memories: DataFrame, refs: DataFrame, limit: int, most_chars: int = 2000) -> DataFrame:
    """What a batch hands on: the oldest memories without a reference, with decoded vectors, cut content, kind and the context that their id tells."""
    return _bridged(_bridge_batch(memories, refs, limit), most_chars)


def bridge_run(store, memories: DataFrame, counters, at: int, limit: int, most_chars: int = 2000, table: str = "refs", handed: str = "handed") -> dict[str, int]:
    """One batch of the bridge: what is handed on goes to the store's table `handed`, and a reference (id, handed_id, processed_at, gist, concepts) for each to
    `table`, in the place of an older one. Memories without a vector are skipped and stay without a reference, so they come again. What is handed on
    is written first, under ids that follow the memory's, and read for the references: a run that stopped between the two is made good by the next."""
    refs = store.read(table, ["id"]) if store.exists(table) else memories.sparkSession.createDataFrame([], "id string")
    full = F.size("vector") > 0
    wire = F.concat(F.lit("bw-"), F.substring(F.sha2("id", 256), 1, 16))
    counts = {"imported": F.count_if(full), "skipped": F.count_if(~full)}

    def write(batch: DataFrame) -> int:
        return store.upsert(handed, _bridged(batch, most_chars).select(wire.alias("handed_id"), F.lit(at).alias("processed_at"), "*"))

    version, told = counters.run("bridge", _bridge_batch(memories, refs, limit), counts, write)
    store.upsert(table, store.version(handed, version).select("id", "handed_id", "processed_at", "gist", "concepts"))
    return told


def bridge_status(memories: DataFrame, refs: DataFrame) -> DataFrame:
    """total, processed, remaining memories."""
    known = refs.select("id", F.lit(1).alias("done"))
    out = memories.select("id").join(known, "id", "left").agg(F.count("*").alias("total"), F.count("done").alias("processed"))
    return out.withColumn("remaining", F.col("total") - F.col("processed"))


def migration(stores: dict[str, DataFrame], migrated: DataFrame, dim: int) -> DataFrame:
    """store, source, migrated, skipped, verified: vectors of each old store (id, vector); mail is known by its key, other dimensions are
    skipped; verified are stores all of whose good vectors are in the new one (id)."""
    out = None
    for name, df in stores.items():
        source = F.when(F.startswith("id", F.lit("mail://")), "email").otherwise("file" if name == "files" else "memory")
        rows = df.select(F.lit(name).alias("store"), source.alias("source"), "id", (F.size("vector") == dim).alias("good"))
        out = rows if out is None else out.unionByName(rows)
    there = out.join(migrated.select("id", F.lit(True).alias("there")), "id", "left")
    return there.groupBy("store", "source").agg(F.count_if("good").alias("migrated"), F.count_if(~F.col("good")).alias("skipped"), F.bool_and(~F.col("good") | F.coalesce("there", F.lit(False))).alias("verified"))


def thoughts(outcomes: DataFrame) -> DataFrame:
    """A thought for each learning outcome (id, reward, timestamp): an evaluation of a good one, else a reflection."""
    quality = labels.reward_quality(F.col("reward"))
    sure = F.least(F.abs("reward"), F.lit(1.0))
    said = F.format_string("Trajectory recorded: reward=%.2f, quality=%.2f", F.col("reward"), quality)
    return outcomes.select("id", F.when(F.col("reward") > 0, "Evaluation").otherwise("Reflection").alias("kind"), said.alias("content"), sure.alias("confidence"), F.lit(0.5).alias("novelty"), sure.alias("utility"), "timestamp")


def pattern_action(patterns: DataFrame, query: DataFrame) -> DataFrame:
    """The action that the nearest pattern's quality stands for; 0 without one."""
    near = search.scored(patterns, query).orderBy(F.desc("similarity"), "id").limit(1)
    return near.agg(F.coalesce(F.max(F.pmod(F.floor(F.col("quality") * 100), F.lit(100))), F.lit(0)).cast("bigint").alias("action"))


def learner_stats(experiences: DataFrame, q: DataFrame, batch: int = 32, window: int = 100, rate: float = 0.1) -> DataFrame:
    """Of experiences (i, reward) in order and Q-values: how many there are, how many batches trained, the mean and the trend of the last
    rewards, and the exploration rate after the last step."""
    from .learning import adapted_exploration

    last = experiences.orderBy(F.desc("i")).limit(window)
    shape = last.agg(F.coalesce(F.avg("reward"), F.lit(0.0)).alias("avg_reward"), F.coalesce(F.regr_slope(F.col("reward").cast("double"), F.col("i").cast("double")), F.lit(0.0)).alias("trend"), F.count("*").alias("seen"))
    counts = experiences.agg(F.count("*").alias("experiences"), F.greatest(F.count("*") - (batch - 1), F.lit(0)).alias("updates"))
    explored = F.when(F.col("seen") >= 50, adapted_exploration(F.lit(rate), F.col("trend"))).otherwise(F.lit(rate))
    one = shape.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(q.agg(F.count("*").alias("q_size"))))  # one row each
    return one.select("experiences", "updates", "q_size", "avg_reward", "trend", explored.alias("exploration"))


def replay(experiences: DataFrame, buffer: int) -> DataFrame:
    """The newest experiences, which a batch is drawn from, with the curiosity bonus that their state's earlier visits leave."""
    visits = F.row_number().over(Window.partitionBy("state").orderBy("i")) - 1
    return experiences.withColumn("total", F.col("reward") + labels.curiosity(visits)).orderBy(F.desc("i")).limit(buffer)


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask keeps, normalised."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] > 0)
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, x: F.zip_with(acc, x["t"], lambda a, b: a + b))
    return vectors.normalize(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def embedded(by_provider: dict[str, Column], dim: int) -> tuple[Column, Column]:
    """(vector, provider): of the first provider, in the order given, that has a vector, fitted to the dimension and normalised."""
    vector = F.coalesce(*[vectors.normalize(vectors.fit_dimension(v, dim)) for v in by_provider.values()])
    name = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in by_provider.items()])
    return vector, name


def stats_connected(memories: DataFrame) -> DataFrame:
    """lifecycle.stats and the number of connections, each of which two memories hold."""
    from .lifecycle import stats

    links = memories.agg(F.floor(F.coalesce(F.sum(F.size("connections")), F.lit(0)) / 2).alias("connections"))
    return stats(memories).crossJoin(F.broadcast(links))  # one row each


def cycles(ticks: DataFrame, every: int = 100) -> DataFrame:
    """What each tick of the maintenance loop does."""
    return ticks.select("tick", F.when(F.col("tick") % every == 0, "consolidate").otherwise("tick").alias("step"))


def added_goals(goals: DataFrame, new: DataFrame) -> DataFrame:
    """Goals (id, description, priority, progress, status) with new ones (id, description, priority), which begin active at 0; priorities are 0 to 1.
    Of new goals with one id the least by description, then priority, counts."""
    new = new.groupBy("id").agg(F.min(F.struct("description", "priority")).alias("r")).select("id", "r.description", "r.priority")
    rows = new.select("id", "description", F.least(F.greatest("priority", F.lit(0.0)), F.lit(1.0)).alias("priority"), F.lit(0.0).alias("progress"), F.lit("Pending").alias("status"))
    return goals.unionByName(rows.join(goals.select("id"), "id", "left_anti").select(*goals.columns))


def digest(hits: DataFrame, title: str) -> DataFrame:
    """A workflow's digest of a top-k of memories as one text."""
    line = F.concat(F.lit("- ["), "memory_type", F.lit("] "), F.substring("content", 1, 200))
    return hits.agg(F.concat(F.lit(f"{title}\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id", line.alias("line")))), lambda x: x["line"]), "\n")).alias("digest"))


def conversation_changes(changes: DataFrame) -> DataFrame:
    """Of changed files those that hold conversations, with the source that their path tells; histories are read otherwise."""
    source = F.when(F.contains("path", F.lit("/sessions/")), "desktop_sessions").otherwise("agent_conversations")
    return changes.where(F.endswith("path", F.lit(".jsonl")) & ~F.endswith("path", F.lit("history.jsonl"))).withColumn("source", source)


def topic_text(memories: DataFrame, topic: str) -> DataFrame:
    """A topic's memories as one markdown file, oldest first. A topic is what is collected."""
    entry = F.concat(F.lit("### "), "id", F.lit("\n"), "content", F.lit("\n"))
    rows = memories.groupBy(F.col(topic).alias("topic")).agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "id", entry.alias("e")))), lambda x: x["e"]).alias("parts"))
    return rows.select("topic", F.concat(F.lit("# "), "topic", F.lit("\n\n"), F.array_join("parts", "\n")).alias("body"))


def topic_entries(files: DataFrame) -> DataFrame:
    """The memories read back from topic files (topic, body): id and content."""
    parts = files.select("topic", F.explode(F.slice(F.split("body", "(?m)^### "), 2, 1 << 30)).alias("p"))
    return parts.select("topic", F.substring_index("p", "\n", 1).alias("id"), F.rtrim(F.regexp_replace("p", r"^[^\n]*\n", ""), F.lit("\n")).alias("content"))
