"""Chat formatting by event-sourced reconstruction.

A log has events (conv_id, turn, seq, event, role, text). They are dealt out by ranges of
(conv_id, turn), so that a long conversation spreads over tasks in order, sorted, and folded
as a stream that holds one message at a time:

    message     begins a message with role and text
    delta       appends to the text of the turn's latest message
    edit        replaces that text
    regenerate  empties that text for another attempt
    delete      removes that message

Each final message is rendered as `### ROLE: TEXT</turn>` and a line feed. In roles and texts
a backslash goes before every backslash and control string (`### `, `</turn>`; in roles also
a colon), so that the formatted text can be parsed back without loss.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts

# The template's control strings.
HEAD, COLON, TAIL = "### ", ": ", "</turn>"
LOSS_ROLES = ("assistant",)
#: Characters of a streamed delta.
PIECE = 4096
_IN_TEXT = re.compile(r"\\|### |</turn>")
_IN_ROLE = re.compile(r"\\|:|### |</turn>")
_TOKEN = re.compile(r"\\(\\|:|### |</turn>)|(### )|(: )|(</turn>\n)")
_ESCAPED = re.compile(r"\\(\\|:|### |</turn>)")
_RANK = {"message": 0, "delta": 1, "edit": 2, "regenerate": 3, "delete": 4}


def _add(m: re.Match) -> str:
    return "\\" + m.group()


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn and the code-point span of its (escaped) text."""
    head = HEAD + _IN_ROLE.sub(_add, role) + COLON
    body = _IN_TEXT.sub(_add, text)
    return head + body + TAIL + "\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, role, state, at = [], "", 0, 0
    for m in _TOKEN.finditer(formatted):
        if m.group(2) and state == 0:
            state, at = 1, m.end()
        elif m.group(3) and state == 1:
            role, state, at = unescape(formatted[at : m.start()]), 2, m.end()
        elif m.group(4) and state == 2:
            turns.append((role, unescape(formatted[at : m.start()])))
            state = 0
    if state:
        raise ValueError("a turn has no end")
    return turns


_PIECES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _fold(loss_roles: tuple[str, ...]):
    def run(batches):
        place, part = None, 0
        role: str | None = None
        text: list[str] = []
        out: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal role, part, held
            if role is not None:
                piece, lo, hi = render(role, "".join(text))
                learn = role in loss_roles
                out.append((*place, part, piece, lo if learn else None, hi if learn else None))
                part += 1
                held += len(piece)
            role = None
            text.clear()

        def flush():
            nonlocal held
            rows, held = out.copy(), 0
            out.clear()
            return pa.RecordBatch.from_pydict({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PIECES)}, schema=_PIECES)

        for batch in batches:
            for conv, turn, event, who, what in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "event", "role", "text"))):
                if (conv, turn) != place:
                    close()
                    place, part = (conv, turn), 0
                if event == "message":
                    close()
                    role = who or ""
                    text.append(what or "")
                elif event == "delta" and role is not None:
                    text.append(what or "")
                elif event in ("edit", "regenerate") and role is not None:
                    text.clear()
                    if event == "edit":
                        text.append(what or "")
                elif event == "delete":
                    role = None
                    text.clear()
                if held > 1 << 23:
                    yield flush()
        close()
        yield flush()

    return run


def format_turns(events: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, dealt: bool = False) -> DataFrame:
    """Formatted turns (conv_id, turn, part, formatted, loss_start, loss_end).

    A conversation's formatted text is the concatenation of its pieces by turn and part; a span
    of code points in the piece is set where its text is learned from. Null roles and texts
    count as empty. Events of equal place and seq go by kind (in the order above), role and
    text; two message events of one turn are two messages, and repeated rows repeat. Events
    other than message before the turn's first message, and unknown ones, change nothing.
    Null ids form one conversation, null turns come first. Other columns are ignored. An empty
    log gives an empty result. dealt: all events of a turn lie in one partition and partitions
    hold ranges of (conv_id, turn), as events_of() gives them; the log isn't moved then.
    """
    rank = F.coalesce(*(F.when(F.col("event") == k, v) for k, v in _RANK.items()), F.lit(9))
    rows = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), F.col("event").cast("string"), rank.alias("rank"), F.col("role").cast("string"), F.col("text").cast("string"))
    if not dealt:
        rows = rows.repartitionByRange(shuffle_parts(events.sparkSession), "conv_id", "turn")
    rows = rows.sortWithinPartitions("conv_id", "turn", "seq", "rank", "role", "text")
    return rows.mapInArrow(_fold(loss_roles), "conv_id long, turn long, part long, formatted string, loss_start long, loss_end long")


def events_of(conversations: DataFrame, streamed_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """A log of events that folds to the finished turns of a table (conv_id, turn, role, text).

    A turn of a streamed role begins empty, gets a first attempt (its text twice over), is
    regenerated and then streamed in deltas of PIECE characters; any other turn begins with a
    draft and is edited to its text. Rows of one turn follow each other by role and text, each
    with places of its own in the log, and repeated rows repeat. Null texts count as empty, null
    ids and turns stay null. Other columns are ignored; an empty table gives an empty log. The log
    lies by ranges of (conv_id, turn).
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the window takes the range partitions as they are
    turns = turns.repartitionByRange(shuffle_parts(conversations.sparkSession), "conv_id", "turn")
    turns = turns.withColumn("first", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) * F.lit(1 << 32))
    event = lambda kind, text: F.struct(F.lit(kind).alias("event"), text.alias("text"))
    text, none = F.col("text"), F.lit(None).cast("string")
    deltas = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda x: event("delta", x))
    streamed = F.concat(F.array(event("message", none), event("delta", text), event("delta", text), event("regenerate", none)), deltas)
    edited = F.array(event("message", F.upper(text)), event("edit", text))
    log = F.when(F.col("role").isin(*streamed_roles), streamed).otherwise(edited)
    out = turns.select("conv_id", "turn", "first", "role", F.posexplode(log).alias("k", "e"))
    return out.select("conv_id", "turn", (F.col("first") + F.col("k")).alias("seq"), "e.event", F.when(F.col("e.event") == "message", F.col("role")).alias("role"), "e.text")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches):
    """Per conversation, hashed as a stream of its formatted pieces."""
    now, seen = None, False
    n = chars = learned = 0
    turns = loss = None
    rows: list[tuple] = []

    def flush():
        cols = list(zip(*rows)) if rows else [()] * len(_DIGESTS)
        return pa.RecordBatch.from_pydict({f.name: pa.array(c, f.type) for f, c in zip(_DIGESTS, cols)}, schema=_DIGESTS)

    for batch in batches:
        for conv, piece, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if not seen or conv != now:
                if seen:
                    rows.append((now, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
                now, seen, n, chars, learned, turns, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                if len(rows) >= 10_000:
                    yield flush()
                    rows.clear()
            for role, text in parse(piece):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            if lo is not None:
                text = unescape(piece[lo:hi])
                loss.update(text.encode())
                learned += len(text)
            chars += len(piece)
    if seen:
        rows.append((now, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
    yield flush()


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the formatted turns.

    A digest over a whole conversation needs its pieces in order: a task streams through
    them, holding one at a time, however long the conversation is.
    """
    rows = pieces.repartition(shuffle_parts(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return rows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
