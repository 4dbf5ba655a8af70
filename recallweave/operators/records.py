"""Mail, activity, history and conversation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from . import selection
from . import chunking


def ingest_mail(mail: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Mail worth keeping: no newsletters, no skipped mailboxes, no empty bodies, none that is known."""
    rows = mail.where(labels.newsletter_score(F.col("sender"), F.col("subject"), F.col("body")) < 3).where(~labels.skipped_mailbox(F.col("mailbox"))).where(text.strip(F.col("body")) != "")
    return rows if known is None else rows.join(known.select("message_id"), "message_id", "left_anti")


def mail_records(raw: DataFrame, column: str) -> DataFrame:
    """Fetched mail: records end with U+241F, fields with U+241E; those with fewer than seven fields go."""
    records_ = raw.select(F.explode(F.split(F.col(column), "␟")).alias("one"))
    rows = records_.select(F.split("one", "␞").alias("f")).where(F.size("f") >= 7)
    names = ("message_id", "subject", "sender", "date", "mailbox", "account", "body")
    return rows.select(*[text.strip(F.get("f", F.lit(i))).alias(n) for i, n in enumerate(names)])


def recent_mail(mail: DataFrame, now: int, days: int = 30, most: int = 2000) -> DataFrame:
    """Of mail_records those of the last days before `now` (s, as their date is) from mailboxes that are kept, with bodies cut to `most` characters. A date
    that is no number takes a mail out."""
    sent = F.expr("try_cast(date as bigint)")
    kept = mail.where(sent.between(now - days * 86400, now) & ~labels.skipped_mailbox(F.col("mailbox")))
    return kept.withColumns({"date": sent, "body": F.substring("body", 1, most)})


def changes(rows: DataFrame, keys: list[str], order: list, by: list[str]) -> DataFrame:
    """Rows whose keys differ from the row before, by partition."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for k in keys:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    return rows.withColumn("__same", same & (F.row_number().over(w) > 1)).where(~F.col("__same")).drop("__same")


def mask_apps(rows: DataFrame, excluded: list[str]) -> DataFrame:
    hidden = F.lower("app_name").isin(*[x.lower() for x in excluded])
    return rows.withColumns({"window_title": F.when(hidden, "[private]").otherwise(F.col("window_title")), "project": F.when(~hidden, F.col("project"))})


def filter_activity(rows: DataFrame, since: int | None = None, until: int | None = None, types: list[str] | None = None, project: str | None = None) -> DataFrame:
    if since is not None:
        rows = rows.where(F.col("timestamp") >= since)
    if until is not None:
        rows = rows.where(F.col("timestamp") <= until)
    if types:
        rows = rows.where(F.col("app_name").isin(*types))
    return rows.where(F.col("project") == project) if project is not None else rows


def last_n(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def batched(rows: DataFrame, order: Column | str, value: str, size: int, by: list[str], glue: str = "\n---\n") -> DataFrame:
    """Values joined in batches of a fixed number, in order within each group; a batch is what is collected. Groups may be few and
    large: they are numbered by ranges."""
    numbered = selection.numbered(rows, [F.col(order) if isinstance(order, str) else order], by, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size))
    grouped = numbered.groupBy(*by, "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", F.col(value).alias("v")))), lambda x: x["v"]), glue).alias("content"), F.count("*").alias("items"))
    return grouped


def transcripts(turns: DataFrame) -> DataFrame:
    """One text for each conversation: User and Assistant paragraphs in order of turns; other roles go."""
    prefix = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ")
    rows = turns.where(prefix.isNotNull() & (F.coalesce("text", F.lit("")) != "")).select("conv_id", "turn", F.concat(prefix, "text", F.lit("\n\n")).alias("line"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "").alias("transcript"))


def segments(documents: DataFrame, key: str, body: str, size: int = 400, overlap: int = 50, most: int = 10, least_bytes: int = 50) -> DataFrame:
    return chunking.chunk(documents.where(F.octet_length(body) >= least_bytes).select(key, body), body, size, overlap, most)


def chat_summary(turns: DataFrame, most: int = 8, chars: int = 80) -> DataFrame:
    """The longest messages' first characters, distinct whatever their case, by conversation."""
    rows = turns.where(F.coalesce("text", F.lit("")) != "").withColumn("snippet", F.substring("text", 1, chars)).withColumn("len", F.octet_length("text"))
    first = F.row_number().over(Window.partitionBy("conv_id", F.lower("snippet")).orderBy(F.desc("len"), "turn"))
    distinct = rows.withColumn("r", first).where("r = 1")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("len"), "turn"))
    best = distinct.withColumn("r", rank).where(F.col("r") <= most).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "snippet"))), lambda x: x["snippet"]), "; ").alias("topics"))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("messages"))
    return counts.join(best, "conv_id", "left")


def chat_memories(messages: DataFrame, whole: int = 100) -> DataFrame:
    """Chats of up to `whole` messages are one memory, longer ones one for each month; (chat, ts, text)."""
    n = F.count("*").over(Window.partitionBy("chat"))
    rows = messages.where(F.length("text") > 20).withColumn("n", n).withColumn("period", F.when(F.col("n") <= whole, F.lit("all")).otherwise(F.date_format("ts", "yyyy-MM")))
    return rows.groupBy("chat", "period").agg(F.count("*").alias("messages"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def incremental(history: DataFrame, watermark: int, limit: int = 500) -> DataFrame:
    """What was visited after the watermark, oldest first; the next watermark is the largest time returned."""
    return history.where(F.col("last_visit_time") > watermark).orderBy("last_visit_time", "page_id").limit(limit)


def notes(raw: DataFrame, column: str) -> DataFrame:
    """id, title, folder, body of notes between `<<<NOTE_START>>>` marks."""
    parts = raw.select(F.explode(F.slice(F.split(F.col(column), "<<<NOTE_START>>>"), 2, 1 << 30)).alias("one"))
    rows = parts.select(F.substring_index("one", "<<<NOTE_END>>>", 1).alias("p"))
    line = lambda k: text.strip(F.regexp_extract("p", rf"(?m)^{k}:(.*)$", 1))
    return rows.select(line("ID").alias("id"), line("TITLE").alias("title"), line("FOLDER").alias("folder"), text.strip(F.regexp_extract("p", r"(?s)(?:^|\n)BODY:(.*)$", 1)).alias("body")).where("title <> '' or body <> ''")


def projects_from_markers(files: DataFrame, markers: DataFrame, levels: int = 12) -> DataFrame:
    """Each file's project: the deepest folder above it that has a marker."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(levels))), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))
    folders = markers.select(F.regexp_replace("marker", "/[^/]*$", "").alias("folder")).distinct()
    found = files.select("path", F.explode(above).alias("folder")).join(folders, "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("project_root"))
    return files.join(found, "path", "left").withColumn("project", F.substring_index("project_root", "/", -1))


def folder_listing(files: DataFrame, parent: str) -> DataFrame:
    """Folders right below a parent with their number of files, by lower-case name."""
    root = parent.rstrip("/") + "/"
    rest = F.substring("path", len(root) + 1, 1 << 20)
    inside = files.where(F.startswith("path", F.lit(root)) & F.contains(rest, F.lit("/")))
    return inside.groupBy(F.substring_index(rest, "/", 1).alias("name")).agg(F.count("*").alias("files"))


def bursts(events: DataFrame, at: str, path: str, gap: int, slice_: int = 86_400_000_000) -> DataFrame:
    """start, end, changes, paths (distinct) of bursts of events (microseconds), which end with a quiet gap. Time is cut into
    slices: within one, an event's predecessor is near by; between them only the ends of slices meet, one row each. So no task
    sees more than a slice."""
    rows = events.select(F.col(at).alias("t"), F.col(path).alias("p"), F.floor(F.col(at) / slice_).alias("s"))
    within = rows.withColumn("new", (F.col("t") - F.lag("t").over(Window.partitionBy("s").orderBy("t")) >= gap).cast("int"))
    ends = within.groupBy("s").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("new").alias("inner"))
    order = Window.orderBy("s")  # a row for each slice
    ends = ends.withColumn("edge", F.coalesce((F.col("first") - F.lag("last").over(order) >= gap).cast("int"), F.lit(1)))
    upto = ends.withColumn("before", F.sum(F.coalesce("inner", F.lit(0)) + F.col("edge")).over(order) - F.coalesce("inner", F.lit(0))).select("s", "before")
    numbered = within.join(upto, "s").withColumn("n", F.col("before") + F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("s").orderBy("t")))
    by_path = numbered.groupBy("n", "p").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("*").alias("c"))
    return by_path.groupBy("n").agg(F.min("a").alias("start"), (F.max("z") + gap).alias("end"), F.sum("c").alias("changes"), F.count("p").alias("paths")).drop("n")
