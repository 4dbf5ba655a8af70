"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that
reply is trainable. Turns stand in `<|im_start|>role\\n` ... `<|im_end|>\\n`. A `<|` inside a text gets a
backslash between its two characters (and one more where backslashes are there already), so no text can
forge a mark and the escape can be undone exactly; in roles, `%`, `<` and line feeds are percent-encoded.

A conversation that doesn't end with an assistant turn gets a last example without a loss, so its output
holds every turn and reads back whole.

Edge cases: a null text or role is empty; rows of one conversation are in order of turn, then role, then
text, null turns first; rows with a null conversation id form one conversation. An example holds its whole
prefix, so output grows with the square of a conversation's length: that is the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def prefix_target(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples: conv_id, example (from 1), target (the turn's position from 1), formatted, loss_start and
    loss_chars (the trainable span in code points of `formatted`; 0 long where nothing is trained), and
    is_last for the example that holds the whole conversation."""
    own = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("row"))
    talks = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    heads = F.transform("rows", lambda w: F.concat(F.lit(START), escape_role(w["r"]), F.lit("\n")))
    bodies = F.transform("rows", lambda w: escape(w["x"]))
    talks = talks.select("conv_id", heads.alias("heads"), bodies.alias("bodies"), F.transform("rows", lambda w: w["r"] == "assistant").alias("says"))
    talks = talks.withColumn("segments", F.transform("heads", lambda h, i: F.concat(h, F.get("bodies", i), F.lit(END))))
    places = F.filter(F.sequence(F.lit(1), F.size("heads")), lambda i: F.get("says", i - 1) | (i == F.size("heads")))
    spread = talks.select("conv_id", "heads", "bodies", "says", "segments", F.posexplode(places).alias("p", "target"))
    at = F.col("target") - 1
    return spread.select(
        "conv_id",
        (F.col("p") + 1).alias("example"),
        "target",
        F.array_join(F.slice("segments", F.lit(1), F.col("target")), "").alias("formatted"),
        (F.coalesce(F.aggregate(F.slice("segments", F.lit(1), at), F.lit(0).cast("long"), lambda n, s: n + F.length(s)), F.lit(0)) + F.length(F.get("heads", at))).alias("loss_start"),
        F.when(F.get("says", at), F.length(F.get("bodies", at))).otherwise(0).cast("long").alias("loss_chars"),
        F.get("says", at).alias("trains"),
        (F.col("target") == F.size("segments")).alias("is_last"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) parsed from the formatted output, losses (each trainable text,
    unescaped, in order) and formatted_chars over all examples."""
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars")))
    whole = examples.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("formatted"))).alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("trains"), F.struct("example", loss.alias("loss"))))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.transform(F.filter(F.split("whole", r"<\|im_end\|>\n"), lambda s: s != ""), lambda s: F.substring(s, F.lit(len(START) + 1), F.length(s)))
    turns = F.transform(parts, lambda s: F.struct(unescape_role(F.substring_index(s, "\n", 1)).alias("role"), unescape(F.substring(s, F.locate("\n", s) + 1, F.length(s))).alias("text")))
    return whole.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: x["loss"]).alias("losses"), "formatted_chars")


def digests(parsed: DataFrame) -> DataFrame:
    """One row for each conversation with digests of its turns and of all text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("losses", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        "formatted_chars",
    )
