"""Chat formatting (operator 13): a template whose output is reparsed and compared with its source. DataFrame functions only.

A turn is a mark that opens it, its text, and a mark that closes it, by role::

    system     <<SYS>>text<</SYS>>        user       [INST]text[/INST]
    assistant  <s>text</s>                any other  [ROLE:hex]text[/ROLE], the hex digits of the role in UTF-8

The grammar's tokens are these marks and nothing else, so a rendered conversation has one reading: marks cut it into pieces, every
second piece is a text, the pieces between are empty, and each opening mark has its own closing one. A text may hold what
reads as a mark; a backslash after such a string's first character takes that away, and strings that have some already get one
more, so taking one off again gives the text back, whatever it was.

Each conversation is rendered with its texts as they are and reparsed; where the turns that come back are not those of the source, the
texts that hold such strings are escaped, and the result is reparsed and compared again. One escape is always enough,
as marks inside texts are the only thing that can be misread; a conversation that still differs would end the job with an error.

The stored output has the rendered text and the loss mask as run lengths in code points (mark, text, mark for each turn; only texts
of the assistant count). What the query returns is parsed from the output, where the mask's runs must be the pieces' lengths.

A conversation becomes one string, so its turns meet in one task, one conversation at a time; long tables spread by conv_id.

Defined cases: a null text or role counts as empty; rows lie by turn, null turns first, ties by role and text; repeated rows are turns each;
rows without a conv_id form one conversation, whose conv_id is null; an empty table gives the rows added by the query only; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The marks of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE:", "]", "[/ROLE]")
TAILS = r"/?INST\]|ROLE:[0-9A-F]*\]|/ROLE\]|</?SYS>>|/?s>"
TOKEN = rf"[\[<](?:{TAILS})"
PLAIN, ESCAPED = rf"([\[<]\\*)(?={TAILS})", rf"([\[<]\\*)\\(?={TAILS})"


def escape(text: Column) -> Column:
    """One more backslash in every string that is a mark, or is one but for backslashes after its first character."""
    return F.regexp_replace(text, PLAIN, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.hex(role), F.lit(OTHER[1]))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def closing(mark: Column) -> Column:
    """The mark that closes a turn which ``mark`` opens; null for marks that open nothing."""
    out = F.when(mark.startswith(OTHER[0]), OTHER[2])
    for begin, end in MARKS.values():
        out = F.when(mark == begin, end).otherwise(out)
    return out


def role_of(mark: Column) -> Column:
    coded = F.substring(mark, len(OTHER[0]) + 1, F.length(mark) - len(OTHER[0]) - len(OTHER[1]))
    out = F.when(mark.startswith(OTHER[0]), F.unhex(coded).cast("string"))
    for name, (begin, _) in MARKS.items():
        out = F.when(mark == begin, name).otherwise(out)
    return out


def render(turns: Column, text: str) -> Column:
    """The turns (role, plain, escaped) as one string, with the field ``text`` as their texts."""
    each = F.transform(turns, lambda t: F.concat(opening(t["role"]), t[text], closing(opening(t["role"]))))
    return F.array_join(each, "")


def parse(marks: Column, pieces: Column) -> Column:
    """Array of (role, text), or null where marks and the pieces between them follow no turns of the grammar."""
    inside = lambda i: i % 2 == 0
    begun = F.transform(marks, lambda m, i: F.when(inside(i), F.struct(role_of(m).alias("role"), unescape(F.get(pieces, i + 1)).alias("text"))))
    closed = F.transform(marks, lambda m, i: F.when(inside(i), F.coalesce(closing(m) == F.get(marks, i + 1), F.lit(False))).otherwise(True))
    apart = F.transform(pieces, lambda p, i: F.when(inside(i), p == "").otherwise(True))
    fine = F.forall(closed, lambda x: x) & F.forall(apart, lambda x: x)
    return F.when(fine, F.filter(begun, lambda t: t.isNotNull()))


def with_pieces(df: DataFrame, column: str) -> DataFrame:
    """df with the marks of a rendered text and the pieces between them."""
    return df.withColumn("marks", F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0))).withColumn("pieces", F.split(column, TOKEN, -1))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Stored (conv_id, formatted, loss_runs array<struct<length, loss>>), a row per conversation."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("plain"), escape(text).alias("escaped")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["plain"].alias("text")))
    chats = chats.select("conv_id", "turns", source.alias("source"), render(F.col("turns"), "plain").alias("plain"))
    same = F.coalesce(parse(F.col("marks"), F.col("pieces")) == F.col("source"), F.lit(False))
    chats = with_pieces(chats, "plain").withColumn("clean", same)
    chats = chats.select("conv_id", "turns", "source", "clean", F.when(F.col("clean"), F.col("plain")).otherwise(render(F.col("turns"), "escaped")).alias("formatted"))
    runs = F.transform("turns", lambda t: F.array(
        F.struct(F.length(opening(t["role"])).alias("length"), F.lit(False).alias("loss")),
        F.struct(F.length(F.when(F.col("clean"), t["plain"]).otherwise(t["escaped"])).alias("length"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.length(closing(opening(t["role"]))).alias("length"), F.lit(False).alias("loss")),
    ))
    chats = with_pieces(chats, "formatted")
    proven = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("a conversation can't be read back: "), F.col("conv_id").cast("string"))))
    return stored(chats.select("conv_id", proven.alias("formatted"), F.flatten(runs).alias("loss_runs")), "chats")


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (the unescaped texts under the mask) and formatted_chars, from the stored output."""
    read = with_pieces(chats, "formatted").withColumn("turns", parse(F.col("marks"), F.col("pieces")))
    lengths = F.transform("marks", lambda m, i: F.when(i % 2 == 0, F.array(F.length(m), F.length(F.get("pieces", i + 1)), F.length(F.get("marks", i + 1)))))
    laid = F.flatten(F.filter(lengths, lambda x: x.isNotNull())) == F.transform("loss_runs", lambda r: r["length"])
    masked = F.filter(F.transform("loss_runs", lambda r, i: F.when(r["loss"], unescape(F.get("pieces", (2 * F.floor(i / 3) + 1).cast("int"))))), lambda x: x.isNotNull())
    loss = F.when(laid, masked).otherwise(F.raise_error(F.lit("the loss mask does not fit the text")))
    return read.select("conv_id", "turns", loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The contract's row of each conversation, read back from the output."""
    read = read_chats(format_chats(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def with_case(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) and the contract's conversation -7."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    case = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("x"))
    case = case.select(F.lit(-7).cast("long").alias("conv_id"), F.col("x.turn").cast("long").alias("turn"), "x.role", F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(case)
