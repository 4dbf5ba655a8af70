"""Classifications by fixed tables: memory types, file kinds, importance, newsletters, context, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MEMORY_TYPES = ("Episodic", "Semantic", "Procedural", "Working", "Meta", "Causal", "Goal", "Emotional")
TYPE_ALIASES = {
    "Semantic": "document fact reference info bookmark knowledge",
    "Episodic": "conversation event experience message query_history",
    "Procedural": "howto how-to steps process notebook tutorial",
    "Emotional": "preference feeling sentiment like dislike",
    "Goal": "plan intention objective target want",
    "Causal": "cause effect because reason leads-to",
    "Meta": "insight pattern reflection about-me",
    "Working": "temp scratch context active",
}
KINDS = {
    "email": "emlx eml", "pdf": "pdf", "document": "doc docx odt rtf txt md", "spreadsheet": "xls xlsx csv", "presentation": "ppt pptx key",
    "image": "png jpg jpeg gif heic webp", "audio": "mp3 aac wav m4a", "video": "mp4 mov avi mkv", "code": "rs ts tsx js py swift go java c cpp",
}
BOOSTED = "md txt pdf rtf docx doc xlsx xls csv ods".split()
LOWERED = "rs ts tsx js jsx py go java c cpp h swift".split()
SUPPORTED = (
    "md txt rst adoc tex org rtf json toml yaml yml csv xml conf cfg ini env rs ts tsx js jsx py swift go java c cpp h hpp rb lua sql sh bash "
    "zsh fish r scala kt dart vue svelte tf hcl html css ipynb log pdf emlx eml xlsx xls ods"
).split()
SKIP_DIRS = "node_modules target .git .svn .hg __pycache__ .venv venv .cache build dist .Trash .npm .cargo .rustup Pods .next .nuxt vendor bower_components".split()
WALK_SKIP_DIRS = (*SKIP_DIRS, "Library", "Movies", "Music", "Pictures", "Photos Library.photoslibrary")
LIBRARY_NOISE = (
    "Caches", "Logs", "WebKit", "Metadata", "Cookies", "HTTPStorages", "Saved Application State", "Group Containers", "KeyboardServices", "Accounts",
    "Assistant", "Biome", "DES", "Trial", "StatusKit", "IntelligencePlatform", "Daemon Containers", "Developer",
)
SUPPORT_NOISE = ("FileProvider", "Comet", "Antigravity", "AddressBook", "CallHistoryDB", "Knowledge", "CrashReporter", "Google", "CloudDocs")
SKIPPED_MAILBOXES = (
    "Junk", "Trash", "Sent", "Sent Messages", "Drafts", "Spam", "Deleted Messages", "Deleted Items", "Archive", "Papierkorb", "Gesendet",
    "Gesendete Nachrichten", "Entwürfe", "Werbung", "Gelöschte Nachrichten", "Archiv",
)
SENDER_STRONG = "noreply@ no-reply@ newsletter@ marketing@ bulk@ campaign@ mailer-daemon@ postmaster@ bounce@ donotreply@ do-not-reply@ promo@ announce@ news@".split()
SENDER_MEDIUM = "notifications@ notification@ updates@ digest@ automated@ alerts@ deals@".split()
SENDER_WEAK = "info@ hello@ team@ support@ store@".split()
SUBJECTS = (
    "unsubscribe", "newsletter", "weekly digest", "daily digest", "monthly update", "promotional", "weekly roundup", "your weekly",
    "your monthly", "your daily", "price drop", "flash sale", "top stories", "release notes",
)
MAX_FILE_BYTES = 1 << 20


def memory_type(name: Column) -> Column:
    """The canonical type of a name or alias, whatever its case; Semantic if unknown."""
    low = F.lower(name)
    out = F.lit("Semantic")
    for kind in MEMORY_TYPES:
        out = F.when(low.isin(kind.lower(), *TYPE_ALIASES[kind].split()), kind).otherwise(out)
    return out


def exact_memory_type(name: Column) -> Column:
    return F.when(name.isin(*MEMORY_TYPES), name).otherwise("Semantic")


def kind_of(ext: Column) -> Column:
    out = F.lit("file")
    for kind, names in KINDS.items():
        out = F.when(F.lower(ext).isin(*names.split()), kind).otherwise(out)
    return out


def type_boost(ext: Column, score: Column) -> Column:
    return F.when(ext.isin(*BOOSTED), score * 1.15).when(ext.isin(*LOWERED), score * 0.95).otherwise(score)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]*)$", 1))


def should_index(path: Column, size: Column) -> Column:
    """Whether a file is admitted: its extension, no hidden or skipped folder, no system noise, at most 1 MiB."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    skipped = F.exists(parts, lambda p: p.isin(*SKIP_DIRS))
    noise = F.lit(False)
    for x in LIBRARY_NOISE:
        noise = noise | F.contains(path, F.lit(f"/Library/{x}/"))
    for x in SUPPORT_NOISE:
        noise = noise | F.contains(path, F.lit(f"/Application Support/{x}/"))
    noise = F.contains(path, F.lit("/Library/")) & ~F.contains(path, F.lit("/Mobile Documents/")) & noise
    return extension(path).isin(*SUPPORTED) & ~hidden & ~skipped & ~noise & (size <= MAX_FILE_BYTES)


def _any(text: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.contains(text, F.lit(p))
    return found


def newsletter_score(sender: Column, subject: Column, body: Column) -> Column:
    """Weighted signs of a newsletter; from 3 on a mail is skipped."""
    s, j, b = F.lower(sender), F.lower(subject), F.lower(body)
    by_sender = F.when(_any(s, SENDER_STRONG), 3).when(_any(s, SENDER_MEDIUM), 2).when(_any(s, SENDER_WEAK), 1).otherwise(0)
    part = lambda found, n: F.when(found, n).otherwise(0)
    return by_sender + part(_any(j, SUBJECTS), 2) + part(_any(b, ("unsubscribe", "abmelden")), 2) + part(_any(b, ("view in browser", "im browser anzeigen")), 2) + part(_any(b, ("manage preferences", "opt out", "email preferences")), 1)


def skipped_mailbox(mailbox: Column) -> Column:
    return F.lower(mailbox).isin(*[m.lower() for m in SKIPPED_MAILBOXES])


def visit_importance(visits: Column) -> Column:
    return F.when(visits > 20, 0.7).when(visits > 5, 0.5).otherwise(0.3)


def history_importance(visits: Column, base: float = 0.3) -> Column:
    return F.least(F.lit(base) + F.when(visits > 20, 0.4).when(visits > 5, 0.2).when(visits > 2, 0.1).otherwise(0.0), F.lit(1.0))


def frecency_importance(frecency: Column, base: float = 0.3) -> Column:
    return F.least(F.lit(base) + F.when(frecency > 10000, 0.3).when(frecency > 1000, 0.2).when(frecency > 100, 0.1).otherwise(0.0), F.lit(1.0))


def file_importance(ext: Column, base: float = 0.5) -> Column:
    return F.when(ext.isin("pdf", "docx", "xlsx", "xls"), base + 0.05).otherwise(base - 0.05)


#: Id prefix -> (who, topic, project).
CONTEXTS = {
    "bootstrap::file::": (None, "file", "local_files"),
    "bootstrap::claude_code::": ("claude", "code", "claude_code"),
    "bootstrap::claude_memory::": ("claude", "memory", None),
    "bootstrap::claude_plan::": ("claude", "planning", None),
    "bootstrap::claude::": ("claude", "conversation", None),
    "bootstrap::comet::": (None, "browser", None),
    "browser::comet::": (None, "browser", None),
    "bootstrap::whatsapp::": ("whatsapp", "messaging", None),
    "bootstrap::deepnote::": (None, "notes", "deepnote"),
}


def context_of(id_: Column) -> Column:
    """A struct of who, topic, project and tags that an id's prefix tells."""
    fields = []
    for at, name in enumerate(("who", "topic", "project")):
        out = F.lit(None).cast("string")
        for prefix, values in CONTEXTS.items():
            if values[at]:
                out = F.when(F.startswith(id_, F.lit(prefix)), values[at]).otherwise(out)
        fields.append(out.alias(name))
    known = F.lit(False)
    for prefix in CONTEXTS:
        known = known | F.startswith(id_, F.lit(prefix))
    return F.struct(*fields, F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("source:direct"))).alias("tags"))


def time_ago(ms: Column, as_of_ms: int) -> Column:
    minutes = F.floor((F.lit(as_of_ms) - ms) / 60000)
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def epoch_ms_from_chromium(us: Column) -> Column:
    return F.floor(us / 1000).cast("bigint") - 11644473600000


def epoch_s_from_core_data(seconds: Column) -> Column:
    return seconds + 978307200


def recency_quality(age_days: Column) -> Column:
    return F.when(age_days <= 7, 0.7).when(age_days <= 30, 0.55).otherwise(0.4)


def reward_quality(reward: Column) -> Column:
    return F.least(F.greatest((reward + 1) / 2, F.lit(0.0)), F.lit(1.0))


def curiosity(visits: Column) -> Column:
    return F.when(visits.isNull() | (visits == 0), 1.0).otherwise(1 / (1 + F.sqrt(visits)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
