"""Chat formatting with a grammar round trip, on DataFrame functions only.

The grammar, with the four control strings ``<s> </s> [INST] [/INST]``:

    conversation := turn*
    turn         := "<s>[INST]" role "[/INST]\n" text "</s>"

The parser is deterministic and strict: a role or a text with a control string in it does not parse. An escaped
control string has a backslash after its first character; one that already has backslashes there gets one more, and
the parser takes one away from each, so escaping is reversible for every text.

Rendering goes by rounds, until the parse of what is rendered is the source. The conversation is first rendered as it is;
where that doesn't come back, the turns that alone don't are escaped, and should the parse still differ, all turns are. A
conversation that differs even then would be an error. Later rounds are computed only where the one before failed.

Defined cases: a null role or text is empty; turns go by number, then role, then text, nulls first, repeated rows
staying; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns are left out.
A conversation is the unit of the output, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textcols import let, running_sums

OPEN, HEAD, CLOSE = "<s>[INST]", "[/INST]\n", "</s>"
CONTROL = r"<\\*/?s>|\[\\*/?INST\]"
BARE_CONTROL = r"</?s>|\[/?INST\]"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])", r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])", r"$1$4$2$5$3$6")


def _render_turn(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(HEAD), turn["text"], F.lit(CLOSE))


def _parse_piece(piece: Column) -> Column:
    """A turn without its CLOSE; null if it isn't one."""
    inner = F.right(piece, F.length(piece) - len(OPEN))
    at = F.instr(inner, HEAD)
    role = F.left(inner, at - 1)
    text = F.right(inner, F.length(inner) - at - len(HEAD) + 1)
    fine = piece.startswith(OPEN) & (at > 0) & ~role.rlike(BARE_CONTROL) & ~text.rlike(BARE_CONTROL)
    return F.when(fine, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, or null if it isn't in the grammar."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _parse_piece)
    fine = (F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(fine, turns)


def _escaped(turn: Column) -> Column:
    return F.struct(escape(turn["role"]).alias("role"), escape(turn["text"]).alias("text"))


def _conflicts(turn: Column) -> Column:
    """Whether a turn, rendered as it is and parsed alone, doesn't come back as it was."""
    again = parse(_render_turn(turn))
    return again.isNull() | (F.size(again) != 1) | ~again[0].eqNullSafe(turn)


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render_turn), "")


def _until_identical(source: Column) -> Column:
    """(turns, formatted) of a conversation whose parse is the source: as it is, with conflicting turns escaped, or all escaped."""
    made = lambda turns: F.struct(turns.alias("turns"), _render(turns).alias("formatted"))
    same = lambda m: F.coalesce(parse(m["formatted"]).eqNullSafe(source), F.lit(False))
    part = F.transform(source, lambda t: F.when(_conflicts(t), _escaped(t)).otherwise(t))
    lost = F.raise_error(F.lit("a conversation did not come back from its format")).cast("struct<turns:array<struct<role:string,text:string>>,formatted:string>")
    last = let(made(F.transform(source, _escaped)), lambda m: F.when(same(m), m).otherwise(lost))
    second = let(made(part), lambda m: F.when(same(m), m).otherwise(last))
    return let(made(source), lambda m: F.when(same(m), m).otherwise(second))


def format_chats(rows: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, formatted, and loss_spans (start, end of each assistant text).

    A conversation that doesn't parse back to its source after the last round is an error.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    fixed = len(OPEN) + len(HEAD)

    def finished(source: Column, made: Column) -> Column:
        lengths = F.transform(made["turns"], lambda t: F.length(t["role"]) + F.length(t["text"]) + fixed + len(CLOSE))
        head = lambda t: fixed + F.length(t["role"])
        spans = F.zip_with(made["turns"], running_sums(lengths), lambda t, s: F.struct((s + head(t)).alias("start"), (s + head(t) + F.length(t["text"])).alias("end")))
        mask = F.filter(spans, lambda _, i: F.get(source, i)["role"] == "assistant")
        return F.struct(made["formatted"].alias("formatted"), mask.alias("loss_spans"))

    out = let(source, lambda src: let(_until_identical(src), lambda made: finished(src, made)))
    return chats.select("conv_id", out.alias("c_")).select("conv_id", "c_.formatted", "c_.loss_spans")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, read from the formatted conversation."""
    piece = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, piece), "")
