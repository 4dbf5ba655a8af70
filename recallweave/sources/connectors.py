"""Connectors: each turns a foreign source into items (id, content, memory_type, importance, timestamp), and a registry
that selects and runs them. Ids are made from what an item is, so importing it again adds nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import assist, chunking, records
from ..operators.counters import Counters
from .store import TableStore


def item_id(source: str, *parts) -> F.Column:
    pieces = [p if isinstance(p, F.Column) else F.col(p) for p in parts[1:]]
    return F.concat_ws("::", F.lit("bootstrap"), F.lit(source), text.stable_id(F.col(parts[0]) if isinstance(parts[0], str) else parts[0]), *[p.cast("string") for p in pieces])


def _items(df: DataFrame, kind: str, importance, timestamp: str = "timestamp") -> DataFrame:
    return df.select("id", "content", F.lit(kind).alias("memory_type"), (importance if isinstance(importance, F.Column) else F.lit(importance)).cast("double").alias("importance"), F.col(timestamp).cast("bigint").alias("timestamp"))


def agent_conversations(lines: DataFrame, source: str = "claude_code", most: int = 10, importance: float = 0.6) -> DataFrame:
    """lines (path, n, line, timestamp) of JSONL conversations: transcripts cut to 400/50 words, at least 50 bytes."""
    said = lines.withColumn("t", text.transcript_line(F.col("line"))).where("t is not null and t <> ''")
    whole = said.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "").alias("body"), F.max("timestamp").alias("timestamp"))
    parts = chunking.chunk(whole.where(F.octet_length("body") >= 50), "body", 400, 50, most)
    return _items(parts.withColumn("id", item_id(source, "path", "chunk_index")).withColumnRenamed("chunk", "content"), "Episodic", importance)


def markdown_files(files: DataFrame, source: str, kind: str, importance: float, least: int = 0) -> DataFrame:
    """files (path, text, timestamp): chunks of 512/128 words; used for memory notes and plans."""
    parts = chunking.chunk(files.where(F.octet_length("text") >= least), "text", 512, 128)
    return _items(parts.withColumn("id", item_id(source, "path", "chunk_index")).withColumnRenamed("chunk", "content"), kind, importance)


def prompt_history(prompts: DataFrame, source: str = "claude_history", size: int = 10) -> DataFrame:
    """prompts (prompt, command, cwd, timestamp): longer than 20 characters, with their project, in batches of ten."""
    said = F.coalesce(F.nullif("prompt", F.lit("")), "command")
    line = F.concat(F.when(F.col("cwd").isNotNull(), F.concat(F.lit("[Project: "), "cwd", F.lit("] "))).otherwise(""), said)
    rows = prompts.where(F.length(said) > 20).select(line.alias("line"), "timestamp", F.lit(0).alias("g"))
    rows = rows.withColumn("g", F.date_trunc("day", F.timestamp_millis("timestamp")))  # batches within a day: no single task
    out = records.batched(rows, F.struct("timestamp", "line"), "line", size, ["g"])
    return _items(out.withColumn("id", item_id(source, F.concat(F.col("g").cast("string"), F.col("batch").cast("string")))).withColumn("timestamp", F.unix_millis("g")), "Episodic", 0.5)


def chat(messages: DataFrame, sessions: DataFrame, source: str = "whatsapp") -> DataFrame:
    """messages (chat, sender, text, ts, n) joined to sessions (chat, name): a memory of all messages in order each, or one a month."""
    rows = assist.chat_texts(messages.join(sessions.select("chat", "name"), "chat"))
    return _items(rows.withColumns({"id": item_id(source, F.col("chat").cast("string"), "period"), "timestamp": F.unix_millis(F.col("last").cast("timestamp"))}), "Episodic", 0.4)


def browser_history(history: DataFrame, source: str = "chromium", most: int = 2000) -> DataFrame:
    """history (profile, url, title, visit_count, last_visit_time in Chromium's microseconds): the most visited of each profile."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("visit_count"), "url"))
    rows = history.withColumn("r", rank).where(F.col("r") <= most)
    content = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "url")
    return _items(rows.withColumns({"id": item_id(source, "url"), "content": content, "timestamp": labels.epoch_ms_from_chromium(F.col("last_visit_time"))}), "Semantic", labels.history_importance(F.col("visit_count")))


def frecency_history(history: DataFrame, source: str = "firefox", most: int = 2000) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("frecency"), "url"))
    rows = history.withColumn("r", rank).where(F.col("r") <= most)
    return _items(rows.withColumns({"id": item_id(source, "url"), "content": F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "url")}), "Semantic", labels.frecency_importance(F.col("frecency")))


def visited_items(items: DataFrame, visits: DataFrame, source: str = "safari", most: int = 2000) -> DataFrame:
    """items (item, url) joined to visits (item, title, seconds since 2001): by url the newest title and the number of visits."""
    rows = items.join(visits, "item").groupBy("url").agg(F.count("*").alias("visit_count"), F.max_by("title", F.struct("seconds", "title")).alias("title"), F.max("seconds").alias("last"))
    best = rows.orderBy(F.desc("visit_count"), "url").limit(most)
    return _items(best.withColumns({"id": item_id(source, "url"), "content": F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "url"), "timestamp": (labels.epoch_s_from_core_data(F.col("last")) * 1000)}), "Semantic", labels.history_importance(F.col("visit_count")))


def search_terms(terms: DataFrame, source: str = "chromium", most: int = 500, size: int = 20) -> DataFrame:
    """terms (profile, term): distinct ones in batches."""
    from pyspark.sql import Window

    distinct = terms.select("profile", "term").distinct().withColumn("r", F.row_number().over(Window.partitionBy("profile").orderBy("term"))).where(F.col("r") <= most)
    out = records.batched(distinct, "term", "term", size, ["profile"], "\n")
    return _items(out.withColumn("id", item_id(f"{source}_terms", F.concat("profile", F.lit("/"), F.col("batch").cast("string")))).withColumn("timestamp", F.lit(0)), "Semantic", 0.3)


def vault(notes: DataFrame, source: str = "obsidian") -> DataFrame:
    """notes (path, text, timestamp): without frontmatter; of more than 500 words the first five chunks of 400/50, else whole."""
    body = notes.select("path", "timestamp", text.frontmatter_body(F.col("text")).alias("body"))
    long = F.size(text.words(F.col("body"))) > 500
    parts = chunking.chunk(body.where(long), "body", 400, 50, 5).withColumnRenamed("chunk", "content")
    whole = body.where(~long & (F.col("body") != "")).select("path", "timestamp", F.lit(0).cast("bigint").alias("chunk_index"), F.col("body").alias("content"))
    return _items(parts.select("path", "timestamp", "chunk_index", "content").unionByName(whole).withColumn("id", item_id(source, "path", "chunk_index")), "Semantic", 0.6)


def marked_notes(raw: DataFrame, column: str = "text", source: str = "notes") -> DataFrame:
    rows = records.notes(raw, column)
    return _items(rows.withColumns({"id": F.concat_ws("::", F.lit("bootstrap"), F.lit(source), text.stable_id(F.col("id"))), "content": F.concat("title", F.lit("\n"), "body"), "timestamp": F.lit(0)}), "Semantic", 0.6)


def discovered_rows(spark: SparkSession, tables: list[str], source: str = "deepnote", most: int = 1000) -> DataFrame:
    """The first catalog table that is there, with its column `content` or else `text`, longer than 20 characters."""
    for name in tables:
        if spark.catalog.tableExists(name):
            df = spark.table(name)
            column = next((c for c in ("content", "text") if c in df.columns), None)
            if column:
                rows = df.select(F.col(column).alias("content")).where(F.length("content") > 20).orderBy("content").limit(most)
                return _items(rows.withColumns({"id": item_id(source, "content"), "timestamp": F.lit(0)}), "Procedural", 0.5)
    return spark.createDataFrame([], "id string, content string, memory_type string, importance double, timestamp bigint")


def indexed_documents(chunks: DataFrame, files: DataFrame, extensions: list[str], source: str = "file") -> DataFrame:
    """Indexed files back as memories: chunks in order, the first 4000 words, at most five chunks of 512/128."""
    docs = files.where(F.col("ext").isin(*extensions)).join(chunks, files.path == chunks.file_path).groupBy("path", "ext", F.col("modified")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), " ").alias("body"))
    cut = docs.withColumn("body", F.array_join(F.slice(text.words(F.col("body")), 1, 4000), " "))
    parts = chunking.chunk(cut, "body", 512, 128, 5).withColumnRenamed("chunk", "content").withColumn("timestamp", F.col("modified") * 1000)
    return _items(parts.withColumn("id", item_id(source, "path", "chunk_index")), "Semantic", labels.file_importance(F.col("ext")))


@dataclass
class Connector:
    name: str
    load: Callable[..., DataFrame]
    description: str = ""
    enabled: bool = True


@dataclass
class Registry:
    connectors: dict[str, Connector] = field(default_factory=dict)

    def register(self, connector: Connector) -> None:
        self.connectors[connector.name] = connector

    def select(self, wanted: list[str] | None = None, config: dict[str, bool] | None = None) -> list[Connector]:
        """The wanted connectors, or all, that are enabled; the user's config overrides defaults."""
        names = self.connectors if not wanted or wanted == ["all"] else [w for w in wanted if w in self.connectors]
        return [self.connectors[n] for n in names if (config or {}).get(n, self.connectors[n].enabled)]

    def _marked(self, inputs: dict[str, tuple], existing: DataFrame, wanted: list[str] | None, config: dict[str, bool] | None) -> tuple[DataFrame, list[str]]:
        """All items with `known`, whether their id is there already, and the connectors that ran. Of items with one id that of the connector
        selected first stays, and of one connector's the least by content and what follows."""
        chosen = [c for c in self.select(wanted, config) if c.name in inputs]
        if not chosen:
            raise ValueError("no connector is selected that has an input")
        rows = None
        for n, c in enumerate(chosen):
            part = c.load(*inputs[c.name]).select("id", F.lit(n).alias("nth"), "content", "memory_type", "importance", "timestamp", F.lit(c.name).alias("connector"))
            rows = part if rows is None else rows.unionByName(part)
        fields = [c for c in rows.columns if c != "id"]
        kept = rows.where(F.octet_length("content") >= 20).groupBy("id").agg(F.min(F.struct(*fields)).alias("r")).select("id", "r.*").drop("nth")
        known = existing.select("id").distinct().withColumn("known", F.lit(True))
        return kept.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(False))), [c.name for c in chosen]

    def run(self, inputs: dict[str, tuple], existing: DataFrame, wanted: list[str] | None = None, config: dict[str, bool] | None = None) -> tuple[DataFrame, DataFrame]:
        """(new items of all selected connectors, stats of created and skipped by connector). Ids that exist are skipped."""
        marked, _ = self._marked(inputs, existing, wanted, config)
        stats = marked.groupBy("connector").agg(F.count_if(~F.col("known")).alias("created"), F.count_if("known").alias("skipped"))
        return marked.where(~F.col("known")).drop("known"), stats

    def load_into(self, store: TableStore, table: str, inputs: dict[str, tuple], counters: Counters, wanted: list[str] | None = None, config: dict[str, bool] | None = None) -> DataFrame:
        """New items into a store's table, and connector, created, skipped, counted by the job that writes them. Connectors without items have a row of zeros."""
        spark = store.spark
        existing = store.read(table, ["id"]) if store.exists(table) else spark.createDataFrame([], "id string")
        marked, names = self._marked(inputs, existing, wanted, config)
        own = lambda n: F.col("connector") == n
        counts = {f"created {n}": F.count_if(own(n) & ~F.col("known")) for n in names} | {f"skipped {n}": F.count_if(own(n) & F.col("known")) for n in names}
        _, told = counters.run(f"import {table}", marked, counts, lambda rows: store.upsert(table, rows.where(~F.col("known")).drop("known")))
        return spark.createDataFrame([(n, told[f"created {n}"], told[f"skipped {n}"]) for n in names], "connector string, created bigint, skipped bigint")


def default_registry() -> Registry:
    out = Registry()
    for name, load in (
        ("agent_conversations", agent_conversations), ("desktop_sessions", lambda lines: agent_conversations(lines, "claude_desktop", 15, 0.65)), ("prompt_history", prompt_history),
        ("agent_memory", lambda files: markdown_files(files, "claude_memory", "Semantic", 0.8)), ("plans", lambda files: markdown_files(files, "claude_plan", "Goal", 0.75, 50)), ("chat", chat),
        ("chromium", browser_history), ("search_terms", search_terms), ("safari", visited_items), ("firefox", frecency_history), ("vault", vault), ("notes", marked_notes),
        ("notebook", discovered_rows), ("file_index", indexed_documents),
    ):
        out.register(Connector(name, load))
    return out
