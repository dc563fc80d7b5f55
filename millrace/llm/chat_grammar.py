"""Chat formatting by a grammar round trip, in DataFrame functions only (operator 2).

Grammar of a conversation: turn*; turn: ``<s>`` role newline text ``</s>``. The parser is
deterministic: split at ``</s>``, role up to the first newline, text behind it, then one
backslash less in every escaped control string; a text with a control string that is not
escaped is rejected. Each turn is rendered and reparsed: where it differs from its source
or is rejected, its text is escaped (one backslash more behind the first character of each
control string, which is reversible), whatever its neighbours hold. The whole is reparsed;
a conversation that still differs or is rejected stops the job.

A conversation is dealt in segments of turn numbers, so that no task holds more of a long
conversation than SEGMENT turn numbers. Rendering needs no other shuffle.

Defined results: rows go by turn, ties by role, then text; null turns come first, in a
segment of their own; null role or text counts as empty; null conv_id is one
conversation; repeated rows are repeated turns; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"

#: The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: First character, backslashes, rest of a control string.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)"
LIVE = r"[<\[](/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>)"

#: Turn numbers per segment.
SEGMENT = 256
ROLE_TO_LEARN = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _rendered(turn: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(turn["role"]), F.lit("\n"), text, F.lit(CLOSE))


def conflicts(turn: Column) -> Column:
    """Whether the parser, given the turn's plain rendering, does not give the turn back."""
    parsed = parse(_rendered(turn, turn["text"]))
    same = _source(parsed) == _source(F.array(turn))
    return ~same | F.exists(parsed, lambda t: t["live"])


def render(turns: Column) -> Column:
    """The text of turns that tell whether they conflict."""

    def one(turn: Column) -> Column:
        text = F.when(turn["conflict"], escape(turn["text"])).otherwise(turn["text"])
        return _rendered(turn, text)

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text, live, head, size>> of a rendered text; live: whether a control
    string in the text is not escaped; head: code points before the text."""
    pieces = F.split(formatted, CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        head = F.length(role) + 1
        return F.struct(
            unescape_role(_behind(role, len(OPEN))).alias("role"),
            unescape(_behind(piece, head)).alias("text"),
            _behind(piece, head).rlike(LIVE).alias("live"),
            head.alias("head"),
            (F.length(piece) - head).alias("size"),
        )

    return F.transform(pieces, one)


def _behind(text: Column, count: int | Column) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    return F.substring(text, count + 1, F.length(text))


def _source(parsed: Column) -> Column:
    return F.transform(
        parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )


def _loss_spans(parsed: Column) -> Column:
    """Code points of the formatted text, end exclusive, that the loss is taken on."""
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + turn["head"]
        last = first + turn["size"]
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        spans = F.when(
            turn["role"] == ROLE_TO_LEARN, F.concat(state["spans"], span)
        ).otherwise(state["spans"])
        return F.struct((last + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(parsed, start, step, lambda state: state["spans"])


def format_conversations(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, formatted, escaped, turns, loss_spans): a row per segment of a
    conversation, in order of segment. escaped: whether any text in it is; turns are those
    read back from formatted."""
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / segment).alias("segment"),
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("row"),
    )
    grouped = rows.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list("row")).alias("rows")
    )
    source = grouped.select("conv_id", "segment", _source(F.col("rows")).alias("source"))
    flagged = source.withColumn(
        "flagged",
        F.transform(
            "source",
            lambda t: F.struct(
                t["role"].alias("role"), t["text"].alias("text"), conflicts(t).alias("conflict")
            ),
        ),
    )
    done = flagged.select(
        "conv_id",
        "segment",
        "source",
        F.exists("flagged", lambda t: t["conflict"]).alias("escaped"),
        render(F.col("flagged")).alias("formatted"),
    ).withColumn("parsed", parse(F.col("formatted")))
    back = _source(F.col("parsed"))
    return done.select(
        "conv_id",
        "segment",
        F.when(
            (back == F.col("source")) & ~F.exists("parsed", lambda t: t["live"]),
            F.col("formatted"),
        )
        .otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
        .alias("formatted"),
        "escaped",
        back.alias("turns"),
        _loss_spans(F.col("parsed")).alias("loss_spans"),
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from what was read back. A digest of a whole
    conversation needs its text in one row; only this step does."""
    turns_text = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
        "",
    )
    loss = F.array_join(
        F.transform(
            "loss_spans",
            lambda s: unescape(
                F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])
            ),
        ),
        "",
    )
    per_segment = formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.struct(
            F.col("segment"), turns_text.alias("turns_text"), loss.alias("loss_text")
        ).alias("part"),
    )
    whole = per_segment.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("part")).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["turns_text"]), "")
    loss_text = F.array_join(F.transform("parts", lambda p: p["loss_text"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same digests in SQL, from the table itself. An escape adds one character to each
#: control string, so the length needs only their number.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
    ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(role) + 2 * len(regexp_extract_all(role, '[%<\n]')) + length(text)
    + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|</?SYS>>)')))::BIGINT AS formatted_chars
FROM rows
GROUP BY conv_id
"""
