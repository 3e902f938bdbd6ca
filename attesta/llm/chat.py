"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string.  Successive
turn prefixes are rendered and consecutive outputs compared: what a prefix adds
to the one before is the span of its last turn.  If an output does not begin
with the one before, the template rewrites history, and no spans are given.
The place of a turn's text in its span is found by rendering the prefix once
more with a sentinel as its last text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import BLOCK_BYTES, column, partitions, tidy

Messages = list[tuple[str, str]]
Template = Callable[[Messages], str]

#: Turns that are rendered together. Longer conversations go on in windows that begin with the last turn of the one before.
SEGMENT = 64
SENTINEL = ""
LENGTHEN = "\ue001"

# --- the template that comes with the operator -------------------------------------------

#: Control strings of the template, fixed values; inside texts a backslash is put after their first character.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
_PLAIN = re.compile("|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """No control string is left; one more backslash where there were some already."""
    return _PLAIN.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def instruct_template(messages: Messages) -> str:
    """``<s>`` and the turns: [INST] user [/INST], assistant</s>, <<SYS>>system<</SYS>>, <<ROLE>>other line break text<</ROLE>>."""
    out = ["<s>"]
    for role, text in messages:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body}</s>")
        elif role == "system":
            out.append(f"<<SYS>>{body}<</SYS>>")
        else:
            name = escape(role).replace("\\", "\\\\").replace("\n", "\\n")
            out.append(f"<<ROLE>>{name}\n{body}<</ROLE>>")
    return "".join(out)


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of one turn of ``instruct_template``."""
    piece = piece.removeprefix("<s>")
    if piece.startswith("[INST] "):
        return "user", unescape(piece[7 : -len(" [/INST]")])
    if piece.startswith("<<SYS>>"):
        return "system", unescape(piece[7 : -len("<</SYS>>")])
    if piece.startswith("<<ROLE>>"):
        name, body = piece[8 : -len("<</ROLE>>")].split("\n", 1)
        name = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name)
        return unescape(name), unescape(body)
    return "assistant", unescape(piece[1 : -len("</s>")])


# --- rendering -----------------------------------------------------------------------------


def absent(*texts: str) -> str:
    """The sentinel, or the first of its extensions that no text contains; it begins with a character that it does not repeat, so it cannot overlap itself."""
    mark = SENTINEL
    while any(mark in t for t in texts):
        mark += LENGTHEN
    return mark


def spans(turns: Messages, template: Template, context: Messages = []) -> list[tuple[str, int, int]] | None:  # noqa: B006
    """(span, start of its text, end of its text) of each turn after ``context``; None if the template rewrites history.

    The text of a turn is -1, -1 where the template drops or repeats it.
    """
    out, before = [], template(context) if context else ""
    for k in range(len(turns)):
        prefix = [*context, *turns[: k + 1]]
        now = template(prefix)
        if not now.startswith(before):
            return None
        piece = now[len(before) :]
        mark = absent(now, *turns[k])
        probe = template([*prefix[:-1], (turns[k][0], mark)])
        if not probe.startswith(before) or probe[len(before) :].count(mark) != 1:
            out.append((piece, -1, -1))
        else:
            start = probe.index(mark, len(before)) - len(before)
            end = len(piece) - (len(probe) - len(before) - start - len(mark))
            ok = end >= start and piece[:start] == probe[len(before) :][:start] and piece[end:] == probe[len(before) + start + len(mark) :]
            out.append((piece, start, end) if ok else (piece, -1, -1))
        before = now
    return out


SCHEMA = "conv_id bigint, seq bigint, role string, piece string, start bigint, text_start bigint, text_end bigint, loss boolean, rewrites boolean"
_ARROW = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("start", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.bool_())])


def _segments(rows, window):
    """(conversation, number of its first turn, turns, last turn before) in order, of at most ``window`` turns; None is no limit."""
    at, seq, turns, last = None, 0, [], []
    for k, role, text in rows:
        if turns and (k != at or len(turns) == window):
            yield at, seq, turns, last
            seq, last, turns = seq + len(turns), turns[-2:], []
        if k != at or not (turns or seq):
            at, seq, last = k, 0, []
        turns.append((role or "", text or ""))
    if turns:
        yield at, seq, turns, last


def _windows(rows, template, window):
    """(conversation, seq, role, piece, text start, text end, rewrites) of each turn, window by window."""
    at, rewrites = None, False
    for k, seq, own, last in _segments(rows, window):
        rewrites = rewrites and seq > 0
        context = last[-1:]
        found = spans(own, template, context)
        if found and len(last) > 1:  # is the last turn's span the same without what came before?
            local = spans(last[-1:], template, last[:1])
            rewrites = rewrites or local is None or local[0][0] != at
        rewrites = rewrites or found is None
        whole = template([*context, *own]) if rewrites else ""
        for i, (role, _) in enumerate(own):
            piece, a, b = (whole if i == len(own) - 1 else None, -1, -1) if rewrites else found[i]
            yield k, seq + i, role, piece, a, b, rewrites
        at = found[-1][0] if found else None


def _whole(rows, template, window):
    """As _windows, a conversation at a time: beyond a window the output of all turns so far is compared with the joined pieces at each doubling and at the end."""
    for k, own in groupby(rows, key=itemgetter(0)):
        turns = [(role or "", text or "") for _, role, text in own]
        done = list(_windows(((k, *t) for t in turns), template, window))
        marks = [n for n in (window << i for i in range(1, 64)) if n < len(turns)] + [len(turns)] if window else []
        rewrites = any(r[-1] for r in done) or (bool(window) and len(turns) > window and any(template(turns[:n]) != "".join(r[3] for r in done[:n]) for n in marks))
        for i, r in enumerate(done):
            yield (*r[:3], template(turns) if i == len(turns) - 1 else None, -1, -1, True) if rewrites else r


def format_chats(turns: DataFrame, template: Template = instruct_template, loss_roles: tuple[str, ...] = ("assistant",), window: int | None = SEGMENT) -> DataFrame:
    """One row per turn: its span of the formatted conversation and the code points of its text there.

    Columns: conv_id, seq (from 0), role, piece, start (in the whole output),
    text_start and text_end (in the piece; -1 if it cannot be located), loss,
    rewrites.  The pieces of a conversation in a row are its output.  If the
    template rewrites history, its turns have no piece but the last one, which
    holds the whole output.  Rows are partitioned by conversation and sorted;
    over ``window`` turns a conversation is rendered in windows, which presumes
    (and checks, at each boundary) that a turn's span depends on no turn but
    the one before it.  ``window`` None renders every prefix whole: exact for
    any template, and quadratic in the length of a conversation.  The template of this module is read turn by turn, so
    that a conversation with a third of all turns needs no more memory than
    another.  Of other templates the pieces are compared with the output of all
    turns so far at each doubling of ``window`` and at the end, for which a task
    holds one conversation; a template that rewrites between two of these
    lengths only, and beyond the window, is not seen.

    Turns come in the order of ``turn``, then role and text; null turns first.
    Null texts and roles are empty.  Null conv_ids form one conversation.  Other
    columns are left behind and may have any name.
    """

    local = template is instruct_template

    @tidy
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(column(batch, "conv_id").to_pylist(), column(batch, "role").to_pylist(), column(batch, "text").to_pylist(), strict=True)

        out, size, total = [], 0, 0
        for k, seq, role, piece, a, b, rewrites in _windows(rows(), template, window) if local and window else _whole(rows(), template, window):
            total = total if seq else 0
            out.append((k, seq, role, piece, total, a, b, role in loss_roles and a >= 0, rewrites))
            total += len(piece or "")
            size += len(piece or "") + 64
            if size > BLOCK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    ordered = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the rows of ``format_chats`` with its own template, in their partitions and order.

    A digest is one pass over the turns in order, so a conversation is one
    task's work, a turn at a time in memory.  Null conv_ids are one conversation
    and rows that repeat a turn are turns like others; a conversation whose
    template rewrites history has null digests; an empty table gives an empty
    result.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    @tidy
    def run(batches):
        open_, at, done = False, None, []
        n, turns, chars, under, total, whole = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True

        def row():
            return (at, n, turns.hexdigest() if whole else None, chars if whole else None, under.hexdigest() if whole else None, total)

        for batch in batches:
            for k, seq, piece, a, b, loss, rewritten in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "seq", "piece", "text_start", "text_end", "loss", "rewrites")), strict=True):
                if not seq:
                    if open_:
                        done.append(row())
                    open_, at, n, turns, chars, under, total, whole = True, k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True
                if piece is None or rewritten:
                    whole, n, total = False, n + 1, total + len(piece or "")
                    continue
                role, text = read_turn(piece)
                turns.update(f"{role}\n{text}\n".encode())
                if loss:
                    own = unescape(piece[a:b])
                    chars += len(own)
                    under.update(own.encode())
                n, total = n + 1, total + len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), kinds, strict=True)], names=names)

    return formatted.select("conv_id", "seq", "piece", "text_start", "text_end", "loss", "rewrites").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
