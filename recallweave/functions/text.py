"""Text functions as columns. White space is the explicit class below wherever it matters, since engines differ on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]"
#: Words that make no concept.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "used to of in for on with at by from as into through during before after above below between out off over under again further then "
    "once here there when where why how all both each few more most other some such no nor not only own same so than too very just "
    "because but and or if while about up it its this that these those i me my we our you your he him his she her they them their "
    "what which who whom"
).split()


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean_text(text: Column) -> Column:
    """Lines trimmed, empty ones dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_markup_compat(html: Column) -> Column:
    """Tags removed; bodies of scripts and styles stay, except that all text goes after a first tag that is one."""
    bare = F.replace(F.regexp_replace(html, r"<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))
    before = F.replace(F.substring_index(html, "<", 1), F.lit(">"), F.lit(""))
    return F.when(F.lower(html).rlike(r"^[^<]*<(script|style)"), before).otherwise(bare)


def strip_markup(html: Column) -> Column:
    """Tags and whole scripts and styles removed."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>", ""), r"<[^>]*(>|$)", "")


def concepts(text: Column, count: int = 5, first: int = 64) -> Column:
    """The first words of more than two bytes that are no stop words, without marks at their ends. The `first` words are tried
    before the whole text, which is split only where they give too few."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])

    def found(pieces: Column) -> Column:
        bare = F.transform(pieces, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
        return F.slice(F.filter(bare, lambda w: (F.octet_length(w) > 2) & ~F.array_contains(stops, w)), 1, count)

    head = found(F.slice(F.split(text, SPACE + "+", first + 1), 1, first))  # the piece after these is the unsplit rest
    return F.when(F.size(head) >= count, head).otherwise(found(words(text)))


def gist(text: Column) -> Column:
    """The text up to its first full stop, exclamation or question mark, at most 200 characters."""
    first = F.get(F.split(text, "[.!?]"), F.lit(0))
    return F.when(F.length(first) > 200, F.concat(F.substring(first, 1, 197), F.lit("..."))).otherwise(first)


def truncate_words(text: Column, limit: Column) -> Column:
    """At most `limit` characters, cut back to the last space within them."""
    head = F.substring(text, F.lit(1), limit)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def preview(text: Column) -> Column:
    """One line: of texts with more than 200 bytes the first 199 characters."""
    flat = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.when(F.octet_length(flat) > 200, F.substring(flat, F.lit(1), F.least(F.lit(199), F.length(flat) - 1))).otherwise(flat)


def sender_name(sender: Column) -> Column:
    """The display name before an address, without quotes; null where there is none."""
    name = F.regexp_replace(strip(F.substring_index(sender, "<", 1)), '^"+|"+$', "")
    return F.when(F.instr(sender, "<") > 0, F.nullif(strip(name), F.lit("")))


def project_from_title(title: Column) -> Column:
    """The part of a window title after its last separator, up to a bracket or blank."""

    def after(mark: str) -> Column:
        part = F.regexp_extract(strip(F.substring_index(title, mark, -1)), r"^[^\[\( ]*", 0)
        return F.when((F.instr(title, mark) > 0) & (part != "") & (F.octet_length(part) < 80), part)

    return F.coalesce(after(" — "), after(" - "), after(" – "))


def path_in_title(title: Column) -> Column:
    """The first word of a title that looks like a path."""
    return F.get(F.filter(words(title), lambda w: (F.startswith(w, F.lit("/")) | F.startswith(w, F.lit("~/"))) & (F.length(w) > 2)), F.lit(0))


def frontmatter_body(text: Column) -> Column:
    """The text after a leading block between lines of three dashes."""
    rest = F.substring(text, F.lit(4), F.length(text))
    at = F.instr(rest, "\n---")
    return F.when(F.startswith(text, F.lit("---")) & (at > 0), strip(F.substring(rest, at + 4, F.length(rest)))).otherwise(text)


def frontmatter_tags(text: Column) -> Column:
    """Tags of an inline list; items of later lines count only once a tag has been found."""
    rest = F.substring(text, F.lit(4), F.length(text))
    block = F.when(F.startswith(text, F.lit("---")) & (F.instr(rest, "\n---") > 0), F.substring_index(rest, "\n---", 1)).otherwise("")
    empty = F.array().cast("array<string>")

    def step(found: Column, line: Column) -> Column:
        line = strip(line)
        inline = F.transform(F.split(F.regexp_replace(F.regexp_replace(line, r"^tags:", ""), r"[\[\]]", ""), ","), lambda t: F.regexp_replace(strip(t), "^['\"]+|['\"]+$", ""))
        item = F.regexp_replace(strip(F.substring(line, F.lit(3), F.length(line))), "^['\"]+|['\"]+$", "")
        return (
            F.when(F.startswith(line, F.lit("tags:")), F.concat(found, F.filter(inline, lambda t: t != "")))
            .when(F.startswith(line, F.lit("- ")) & (F.size(found) > 0) & (item != ""), F.concat(found, F.array(item)))
            .otherwise(found)
        )

    return F.aggregate(F.split(block, "\n"), empty, step)


def metadata_value(text: Column, key: str) -> Column:
    """The value of a line `key = "value"`."""
    return F.nullif(F.regexp_extract(text, rf'(?m)^{key}\s*=\s*"([^"]*)"', 1), F.lit(""))


def sanitize_query(query: Column) -> Column:
    """Control characters dropped, backslashes and quotes escaped."""
    return F.regexp_replace(F.regexp_replace(query, r"[\x00-\x1F\x7F]", ""), r'([\\"])', r"\\$1")


def safe_slug(slug: Column) -> Column:
    return ~(F.contains(slug, F.lit("..")) | F.contains(slug, F.lit("/")) | F.contains(slug, F.lit("\\")))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([A-Z])", "_$1"))


def stable_id(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def rfc822_text(raw: Column) -> Column:
    """From, To, Subject and Date lines up to the first blank line, then the plain body."""
    lines = F.split(raw, "\r?\n")
    blank = F.array_position(F.transform(lines, lambda x: strip(x) == ""), True)
    head = F.when(blank > 0, F.slice(lines, F.lit(1), (blank - 1).cast("int"))).otherwise(lines)
    heads = F.transform(F.filter(head, lambda x: F.lower(x).rlike("^(from|to|subject|date):")), strip)
    body = F.when(blank > 0, mime_body(F.array_join(F.slice(lines, (blank + 1).cast("int"), F.size(lines)), "\n"))).otherwise("")
    return clean_text(F.concat(F.array_join(heads, "\n"), F.lit("\n\n"), body))


def mime_body(body: Column) -> Column:
    """Plain text lines of a MIME body: a fold over lines that keeps whether the part is HTML, base64 or plain."""
    start = F.struct(F.lit(False).alias("html"), F.lit(False).alias("coded"), F.lit(False).alias("plain"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        t = strip(line)
        low = F.lower(t)
        edge = F.startswith(t, F.lit("--")) & (F.length(t) > 4)
        kind = F.startswith(low, F.lit("content-type:"))
        transfer = F.startswith(low, F.lit("content-transfer-encoding:"))
        other = F.startswith(low, F.lit("content-"))
        to_plain, to_html = kind & F.contains(low, F.lit("text/plain")), kind & ~F.contains(low, F.lit("text/plain")) & F.contains(low, F.lit("text/html"))
        skip = edge | other | (s["coded"] & (F.length(t) > 60) & ~F.contains(t, F.lit(" "))) | s["html"] | (t == "")
        keep = ~skip & (s["plain"] | ~s["coded"])
        return F.struct(
            F.when(edge | to_plain, False).when(to_html, True).otherwise(s["html"]).alias("html"),
            F.when(edge, False).when(~edge & ~kind & transfer & F.contains(low, F.lit("base64")), True).otherwise(s["coded"]).alias("coded"),
            F.when(edge | to_html, False).when(to_plain, True).otherwise(s["plain"]).alias("plain"),
            F.when(keep, F.concat(s["out"], F.array(t))).otherwise(s["out"]).alias("out"),
        )

    return F.array_join(F.aggregate(F.split(body, "\n"), start, step, lambda s: s["out"]), "\n")


def emlx_text(raw: Column) -> Column:
    """A stored message: the byte count line and the property list after it cut off."""
    body = F.when(F.instr(raw, "\n") > 0, F.substring(raw, F.instr(raw, "\n") + 1, F.length(raw))).otherwise(raw)
    return rfc822_text(F.substring_index(body, "<?xml", 1))


def transcript_line(line: Column) -> Column:
    """`User: ...` or `Assistant: ...` paragraphs of one JSON line, whose content is a text or an array of {text}."""
    v = F.try_parse_json(line)
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    role = F.coalesce(get("$.message.role"), get("$.role"))
    prefix = F.when(role == "user", "User: ").when(role == "assistant", "Assistant: ")
    nested = get("$.message", "variant").isNotNull()
    parts = F.coalesce(F.when(nested, get("$.message.content", "array<variant>")).otherwise(get("$.content", "array<variant>")), F.array().cast("array<variant>"))
    listed = F.transform(parts, lambda x: F.try_variant_get(x, "$.text", "string"))
    plain = F.when(nested, get("$.message.content")).otherwise(get("$.content"))
    texts = F.when(F.size(parts) > 0, listed).otherwise(F.array(plain))
    return F.when(prefix.isNotNull(), F.array_join(F.transform(F.filter(texts, lambda t: t.isNotNull() & (t != "")), lambda t: F.concat(prefix, t, F.lit("\n\n"))), ""))
