"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events, (conv_id, seq, kind, role, text, target):

* ``message``  a whole message, named by its seq;
* ``delta``    text appended to the message ``target`` (made by the first delta if new);
* ``edit``     the text of message ``target`` replaced;
* ``regenerate`` message ``target`` and all after it dropped; what follows replaces them.

Logs are partitioned by conversation and sorted by sequence; each task folds one conversation
after the other from its sorted stream, so memory follows one conversation's final messages and
its rendered text.  Conversations are spread by hash; only one that is itself huge makes a long task,
since its text is one string in the end.

Rendered text marks every turn: ``<s>[ROLE] text [/ROLE]`` and, after assistant turns, ``</s>``.
Inside texts a control string is a ``\\``, ``<`` or ``[``; each gets a ``\\`` before it, so no text can
close a turn and ``parse`` gives back exactly what went in.  Roles are escaped alike, spaces and
``]`` included.  The loss mask covers the escaped assistant texts: ``spans`` are [first, past the
last) code points of the rendered text.

Null text is empty, null role is ``unknown``; null kind is ``message``; null seq sorts first; ties
are ordered by kind, role and text, and repeated rows are repeated turns; unknown targets of edits
and regenerations change nothing; null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"[\\<\[]")
_ROLE = re.compile(r"[\\<\[\] ]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[((?:\\.|[^\\\]])*)\] ((?:\\.|[^\\<\[])*) \[/((?:\\.|[^\\\]])*)\](</s>)?", re.S)
EVENTS = "conv_id bigint, seq bigint, kind string, role string, text string, target bigint"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: str) -> str:
    return _ROLE.sub(r"\\\g<0>", role)


def render(messages: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Rendered text and the spans under the loss mask."""
    out, at, spans = [], 0, []
    for role, text in messages:
        name, inner = _role(role), escape(text)
        head, tail = f"<s>[{name}] ", f" [/{name}]" + ("</s>" if role == learn else "")
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(inner)))
        out += [head, inner, tail]
        at += len(head) + len(inner) + len(tail)
    return "".join(out), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The messages of a rendered conversation; raises where the text is not one."""
    found, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m or m[1] != m[3]:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


class Fold:
    """Final messages of one conversation from its events in order."""

    def __init__(self):
        self.order: list[int | None] = []
        self.role: list[str] = []
        self.parts: list[list[str]] = []
        self.at: dict[int, int] = {}

    def add(self, seq, kind, role, text, target) -> None:
        role, text = role if role is not None else "unknown", text or ""
        place = self.at.get(target)
        if kind == "edit":
            if place is not None:
                self.parts[place] = [text]
        elif kind == "regenerate":
            if place is not None:
                for gone in self.order[place:]:
                    self.at.pop(gone, None)
                del self.order[place:], self.role[place:], self.parts[place:]
        elif kind == "delta" and place is not None:
            self.parts[place].append(text)
        else:
            name = target if kind == "delta" and target is not None else seq
            self.at[name] = len(self.order)
            self.order.append(name)
            self.role.append(role)
            self.parts.append([text])

    def messages(self) -> list[tuple[str, str]]:
        return [(r, "".join(p)) for r, p in zip(self.role, self.parts)]


_OUT = pa.schema([
    ("conv_id", pa.int64()), ("rendered", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))),
])


def _fold(batches):
    """Sorted events to rendered conversations; a conversation may go on over batch borders."""
    now, state, rows, size = object(), None, [], 0
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for conv, seq, kind, role, text, target in zip(*cols):
            if state is None or conv != now:
                if state is not None:
                    rows.append(_finished(now, state))
                    size += len(rows[-1]["rendered"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_OUT)
                        rows, size = [], 0
                now, state = conv, Fold()
            state.add(seq, kind, role, text, target)
    if state is not None:
        rows.append(_finished(now, state))
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_OUT)


def _finished(conv, state: Fold) -> dict:
    rendered, spans = render(state.messages())
    return {"conv_id": conv, "rendered": rendered, "spans": spans}


def formatted(events: DataFrame) -> DataFrame:
    """(conv_id, rendered, spans) per conversation of an event log."""
    kind = F.coalesce("kind", F.lit("message"))
    log = events.select("conv_id", "seq", kind.alias("kind"), "role", "text", "target")
    # the number stays open: a range of tasks follows the session's shuffle partitions
    return log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "role", "text").mapInArrow(
        _fold, "conv_id bigint, rendered string, spans array<array<bigint>>")


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log of whole messages."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("seq"), F.lit("message").alias("kind"),
        "role", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("bigint").alias("target"),
    )


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for conv, rendered, spans in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            turns, n = hashlib.sha256(), 0
            for role, text in parse(rendered):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            learned = [unescape(rendered[a:b]) for a, b in spans]
            loss = hashlib.sha256()
            for x in learned:
                loss.update(x.encode())
            rows.append((conv, n, turns.hexdigest(), sum(map(len, learned)), loss.hexdigest(), len(rendered)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)


def digest(rendered: DataFrame) -> DataFrame:
    """What each rendered conversation holds, read back from its text and its loss mask."""
    return rendered.mapInArrow(_digest, _DIGEST)
