"""Sources that are found in a listing of files: vaults of notes, browser profiles, folders to watch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking

#: Where vaults lie below the home folder, in the order they are tried, the folder that marks one, and folders of one that hold no notes.
VAULT_PLACES = ("Documents/Obsidian", "Documents/Obsidian Vault", "Obsidian", "vaults")
VAULT_MARK = ".obsidian"
NO_NOTES = ("templates", "node_modules")
#: Browsers and their folders below the application support folder.
APPLICATION_SUPPORT = "Library/Application Support"
BROWSERS = {
    "Chrome": "Google/Chrome",
    "Brave": "BraveSoftware/Brave-Browser",
    "Edge": "Microsoft Edge",
    "Arc": "Arc/User Data",
    "Vivaldi": "Vivaldi",
    "Opera": "com.operasoftware.Opera",
    "Comet": "Comet",
}


def _below(path: Column, folder: Column | str) -> Column:
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.startswith(path, F.concat(folder, F.lit("/")))


def find_vault(files: DataFrame, home: str, override: str | None = None) -> DataFrame:
    """root, at most one row: of the folders that hold the marking folder (files has a row for each path below it) the override, else the first
    that lies at one of the usual places or right below it; of several below one place the least by name."""
    mark = F.lit(f"/{VAULT_MARK}/")
    root = F.substring_index("path", f"/{VAULT_MARK}/", 1)
    rank = F.when(root == override.rstrip("/"), -1) if override else F.lit(None).cast("int")
    for n, place in enumerate(VAULT_PLACES):
        at = f"{home.rstrip('/')}/{place}"
        rank = F.coalesce(rank, F.when(root == at, 2 * n), F.when(_below(root, at) & (F.instr(F.substring(root, F.lit(len(at) + 2), F.length(root)), "/") == 0), 2 * n + 1))
    found = files.where(F.contains("path", mark)).select(root.alias("root"), rank.alias("rank")).where("rank is not null")
    return found.agg(F.min(F.struct("rank", "root")).alias("best")).where("best is not null").select("best.root")


def vault_notes(files: DataFrame, root: DataFrame, depth: int = 10) -> DataFrame:
    """Of files (path, ...) the notes of the vault at `root` (one row), with `relative`: names that end in .md, at most `depth` folders deep, the vault's own among
    them, in no hidden folder and none of those that hold no notes."""
    rows = files.crossJoin(F.broadcast(root)).where(_below(F.col("path"), F.col("root")) & F.endswith("path", F.lit(".md")))  # one row
    parts = F.split("relative", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    rows = rows.withColumn("relative", F.substring(F.col("path"), F.length("root") + 2, F.length("path")))
    return rows.where((F.size(parts) <= depth) & ~F.exists(folders, lambda f: F.startswith(f, F.lit(".")) | f.isin(*NO_NOTES))).drop("root")


def vault_texts(notes: DataFrame, source: str = "obsidian", importance: float = 0.6) -> DataFrame:
    """Texts to remember (id, content, summary, memory_type, importance, timestamp) of notes (relative, text, timestamp): the body without frontmatter, whole or, of more than 500
    words, its first five chunks of 400/50. What is embedded is the name, the tags and the first 200 characters, or the name and the number of a later chunk.
    Bodies of fewer than 20 bytes and notes that are null are left out."""
    body = text.frontmatter_body(F.col("text"))
    name = F.regexp_replace(F.element_at(F.split("relative", "/"), -1), r"\.md$", "")
    tags = F.array_join(text.frontmatter_tags(F.col("text")), ", ")
    rows = notes.select("relative", "timestamp", name.alias("name"), F.when(tags != "", F.concat(F.lit(" ["), tags, F.lit("]"))).otherwise("").alias("tags"), body.alias("body"))
    rows = rows.where(F.octet_length(text.strip(F.col("body"))) >= 20)
    long = F.size(text.words(F.col("body"))) > 500
    head = F.concat("name", "tags", F.lit(": "), F.substring("body", 1, 200))
    whole = rows.where(~long).select("relative", "timestamp", F.lit(0).cast("bigint").alias("chunk_index"), F.col("body").alias("content"), head.alias("summary"))
    parts = chunking.chunk(rows.where(long).withColumn("head", head), "body", 400, 50, 5)
    summary = F.when(F.col("chunk_index") == 0, F.col("head")).otherwise(F.concat("name", F.lit(" (part "), (F.col("chunk_index") + 1).cast("string"), F.lit(")")))
    both = whole.unionByName(parts.select("relative", "timestamp", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("chunk").alias("content"), summary.alias("summary")))
    own = F.concat_ws("::", F.lit("bootstrap"), F.lit(source), text.stable_id(F.col("relative")), F.col("chunk_index").cast("string"))
    return both.select(own.alias("id"), "content", "summary", F.lit("semantic").alias("memory_type"), F.lit(importance).alias("importance"), F.col("timestamp").cast("bigint").alias("timestamp"))


def browser_profiles(files: DataFrame, home: str) -> DataFrame:
    """browser, profile, path of each history file that a listing (path) holds: those of the default profile and of numbered ones."""
    support = f"{home.rstrip('/')}/{APPLICATION_SUPPORT}"
    browser, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, folder in BROWSERS.items():
        at = f"{support}/{folder}"
        browser = F.coalesce(browser, F.when(_below(F.col("path"), at), F.lit(name)))
        rest = F.coalesce(rest, F.when(_below(F.col("path"), at), F.substring("path", len(at) + 2, 1 << 20)))
    parts = F.split("rest", "/")
    rows = files.select("path", browser.alias("browser"), rest.alias("rest")).where("browser is not null")
    rows = rows.where((F.size(parts) == 2) & (parts[1] == "History") & ((parts[0] == "Default") | F.startswith(parts[0], F.lit("Profile "))))
    return rows.select("browser", parts[0].alias("profile"), "path").distinct()


def watched(configured: DataFrame, indexed: DataFrame, home: str) -> DataFrame:
    """folder: those that a user named (folder) and those of indexed files (path), each once, with `~` read as the home folder and without an ending slash."""
    plain = F.regexp_replace(F.regexp_replace("folder", "^~(?=/|$)", home.rstrip("/")), "(?<=.)/+$", "")
    named = configured.select("folder").unionByName(indexed.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")))
    return named.select(plain.alias("folder")).where("folder <> ''").distinct()
