"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns are read in order (turn, then role and text for equal turns).  The machine
checks the order of roles; the template says how a turn of each role is written and which parts
carry loss.  Control strings inside a text are escaped reversibly, so the formatted text can be
read back to exactly the turns that went in.

Turns are dealt to partitions by conversation and sorted there; the stage streams over them and
holds one turn at a time, so neither a long conversation nor many of them have to fit in memory.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``roles``: role -> (opening, closing, text carries loss); ``other`` writes every other role,
    its name stands between ``other[0]`` and ``other[1]``.  ``moves``: state -> role -> state;
    what is missing is out of order.  ``final`` are the states a conversation may end in."""

    roles: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": (" ", " </s>", True),
    })
    other: tuple = ("[ROLE] ", " [/ROLE]\n", "\n[END]\n", False)
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple = ("answered",)

    @property
    def controls(self) -> list[str]:
        """The template's control strings: its markers without the space around them."""
        marks = [m for o, c, _ in self.roles.values() for m in (o, c)] + list(self.other[:3])
        return sorted({m.strip() for m in marks if m.strip()} | {"<s>"}, key=lambda m: (-len(m), m))


ESCAPE = "\\"


class Writer:
    """Escapes, writes and reads back texts under a template."""

    def __init__(self, template: Template):
        self.t = template
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
        self._hit = re.compile(f"{re.escape(ESCAPE)}|{heads}")
        self._back = re.compile(re.escape(ESCAPE) + "(.?)", re.S)

    def escape(self, text: str) -> str:
        """An escape sign is doubled; one is put after the first character of a control string."""
        return self._hit.sub(lambda m: m[0] + ESCAPE, text)

    def unescape(self, text: str) -> str:
        return self._back.sub(lambda m: ESCAPE if m[1] == ESCAPE else m[1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) pieces of one formatted turn."""
        if role in self.t.roles:
            opening, closing, loss = self.t.roles[role]
        else:
            head, tail, closing, loss = self.t.other
            opening = head + self.escape(role) + tail
        return [(opening, False), (self.escape(text), loss), (closing, False)]

    def read(self, formatted: str, at: int = 0) -> tuple[str, str, int]:
        """(role, text, place after it) of the turn that begins at ``at``."""
        for role, (opening, closing, _) in sorted(self.t.roles.items(), key=lambda r: -len(r[1][0])):
            if formatted.startswith(opening, at):
                end = formatted.index(closing, at + len(opening))
                return role, self.unescape(formatted[at + len(opening):end]), end + len(closing)
        head, tail, closing, _ = self.t.other
        if not formatted.startswith(head, at):
            raise ValueError(f"no turn begins at {at}")
        middle = formatted.index(tail, at + len(head))
        end = formatted.index(closing, middle + len(tail))
        return (self.unescape(formatted[at + len(head):middle]), self.unescape(formatted[middle + len(tail):end]),
                end + len(closing))


def _in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn, place (from 0), in_order, segments array<struct<text, loss>> per turn.

    A null text or role is empty, a null turn comes first, rows with a null conv_id are one
    conversation.  Repeated rows are turns like any other (and then out of order).  ``in_order`` is
    false from the first turn on that the machine has no move for.
    """
    template = template or Template()
    ids = {f.name: f.dataType.simpleString() for f in conversations.schema.fields}
    schema = f"conv_id {ids['conv_id']}, turn {ids['turn']}, place long, in_order boolean, segments array<struct<text:string,loss:boolean>>"
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches):
        writer, current, state, place = Writer(template), object(), None, 0
        for b in batches:
            places, orders, parts = [], [], []
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if conv != current:
                    current, state, place = conv, "start", 0
                state = template.moves.get(state, {}).get(role)
                places.append(place)
                orders.append(state is not None)
                parts.append([{"text": t, "loss": loss} for t, loss in writer.segments(role, text)])
                place += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array(places, pa.int64()), pa.array(orders, pa.bool_()),
                 pa.array(parts, kind)], ["conv_id", "turn", "place", "in_order", "segments"])

    return _in_order(conversations).mapInArrow(run, schema)


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from the formatted turns in their order (the rows of ``format_turns``, not
    dealt anew): the turns read back from the formatted text, and the text under the loss mask."""
    template = template or Template()
    conv_type = turns.schema["conv_id"].dataType
    schema = (f"conv_id {conv_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
              "loss_sha256 string, formatted_chars long, valid boolean")

    def run(batches):
        writer, names = Writer(template), schema_names
        current, state = object(), None

        def result():
            return (current, state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(),
                    state["chars"], state["ok"] and state["last"] in template.final)

        def batch(rows, of):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], of), *[pa.array(c) for c in cols[1:]]], names)

        for b in batches:
            done = []
            for conv, ok, parts in zip(b.column("conv_id").to_pylist(), b.column("in_order").to_pylist(), b.column("segments").to_pylist()):
                if conv != current:
                    if state is not None:
                        done.append(result())
                    current = conv
                    state = {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0,
                             "ok": True, "last": "start"}
                formatted = "".join(p["text"] for p in parts)
                role, text, end = writer.read(formatted)
                if end != len(formatted):
                    raise ValueError(f"conversation {conv}: a turn does not read back")
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for p in parts:
                    if p["loss"]:
                        plain = writer.unescape(p["text"])
                        state["loss_n"] += len(plain)
                        state["loss"].update(plain.encode("utf-8", "surrogatepass"))
                state["chars"] += len(formatted)
                state["ok"] = state["ok"] and ok
                state["last"] = template.moves.get(state["last"], {}).get(role) if state["last"] else None
            if done:
                yield batch(done, b.schema.field("conv_id").type)
            of = b.schema.field("conv_id").type
        if state is not None:
            yield batch([result()], of)

    schema_names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return turns.mapInArrow(run, schema)


def formatted_text(turns: DataFrame) -> DataFrame:
    """conv_id, place and the formatted text of each turn (concatenated in order of place they
    are the conversation)."""
    return turns.select("conv_id", "place", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"))


def op5_format_chat(conversations: DataFrame) -> DataFrame:
    """The digest of every conversation and of conversation -1, a user and an assistant turn that
    both say a string of control marks."""
    probe = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(1).select(
        F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
                          F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t")
    ).select(F.lit(-1).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(probe).alias("text"))
    every = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_turns(every))
