"""Chat formatting: a finite-state machine over roles, and a declarative template.

A template names the roles, the states between turns and the moves that are in
order, a header for each role, the mark at a turn's end, and the roles whose
texts are learnt from.  The machine reads a conversation's turns and emits three
segments for each: header, text and end, each with its loss flag.  Inside texts
each place where a control string begins, and each escape character, gets the
escape character before it; so no text reads as a turn, and ``read`` gets the
turns back from the output alone.

How it is spread.  Rows are dealt by (conversation, block of ``BLOCK`` turns), so
a long conversation is formatted by many tasks.  A block's effect on the machine
is a table, from each state it may begin in to the state it ends in and the
first turn that was out of order; tables are put together in order, as each row
would have been.  The output is pieces of some ``PIECE_CHARS``, which are read
one after the other and never gathered; those of a conversation of one block by the
task that made them.  A digest over a whole conversation is
sequential by its definition: pieces of one conversation are hashed by one task,
as a stream.

Defined cases: a null text or role is empty; a role that the template doesn't
name is out of order, keeps its name in the header and is not learnt from; after
a turn out of order the machine goes on from the state that its role leads to,
or from the start if the template doesn't name it;
turns are taken by number, nulls first, equal numbers by role and text, and
repeated rows are turns of their own; rows without a conversation are one
conversation; a very long text is one piece; an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, table

#: Turns that are formatted by one task, and the code points after which a piece ends.
BLOCK, PIECE_CHARS = 256, 1 << 20
#: Ids of long conversations that are broadcast, at most; more are joined by a shuffle.
MOST_LONG = 100_000
START = "start"
MOVES = {
    (START, "system"): "system", (START, "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
    ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "tool"): "tool", ("tool", "assistant"): "assistant",
}


@dataclass(frozen=True)
class Template:
    """``moves``: (state, role) to state; ``headers``: role to the text before its turns; ``finals``: states that a whole conversation ends in."""

    moves: dict[tuple[str, str], str] = field(default_factory=lambda: dict(MOVES))
    headers: dict[str, str] = field(default_factory=lambda: {r: f"### {r.capitalize()}: " for r in ("system", "user", "assistant", "tool")})
    other: str = "### ="
    after_other: str = ": "
    end: str = "</turn>\n"
    escape: str = "\\"
    learnt: frozenset[str] = frozenset({"assistant"})
    finals: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        heads = [*self.headers.values(), self.other]
        if not self.end.strip() or len(self.escape) != 1 or any(not h.strip() for h in heads):
            raise ValueError("headers and the end need a mark, and the escape is one character")
        if any(a != b and b.startswith(a) for a in heads for b in heads):
            raise ValueError("a header begins with another one")
        # else a text's last characters and the end could be read as a mark that neither of them has
        if any(self.end[0] in c[1:] or self.escape in c for c in self.controls):
            raise ValueError("a control string holds the escape, or the first character of the end inside")

    @cached_property
    def controls(self) -> tuple[str, ...]:
        """What a text may not show as it is: the headers and the end, without the white space around them."""
        return tuple(dict.fromkeys(x.strip() for x in (*self.headers.values(), self.other, self.end)))

    @cached_property
    def states(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([START, *(s for s, _ in self.moves), *self.moves.values()]))

    @cached_property
    def after(self) -> dict[str, int]:
        """The state that a role leads to when it is out of order."""
        return {role: self.states.index(to) for (_, role), to in reversed(self.moves.items())}

    def step(self, state: int, role: str) -> tuple[int, bool]:
        """The next state, and whether the turn is in order."""
        to = self.moves.get((self.states[state], role))
        return (self.after.get(role, 0), False) if to is None else (self.states.index(to), True)

    @cached_property
    def _marks(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, (self.escape, *self.controls))) + ")")

    @cached_property
    def _role_marks(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, (self.escape, self.after_other[0], *self.controls))) + ")")

    def escaped(self, text: str) -> str:
        return self._marks.sub(lambda _: self.escape, text)

    def plain(self, text: str) -> str:
        return self._pair.sub(lambda m: m[1], text)

    @cached_property
    def _pair(self) -> re.Pattern:
        return re.compile(re.escape(self.escape) + "(.)", re.S)

    @cached_property
    def _turn(self) -> re.Pattern:
        """A header (a known role's, or another's with its name), a text and the end; nothing is tried twice."""
        until = lambda mark: rf"(?:[^{re.escape(self.escape + mark[0])}]++|{re.escape(self.escape)}.|(?!{re.escape(mark)})[^{re.escape(self.escape)}])*+"
        known = "|".join(f"(?P<r{i}>{re.escape(h)})" for i, h in enumerate(self.headers.values()))
        return re.compile(rf"(?:{known}|{re.escape(self.other)}(?P<other>{until(self.after_other)}){re.escape(self.after_other)})(?P<text>{until(self.end)}){re.escape(self.end)}", re.S)

    def segments(self, role: str, text: str) -> tuple[tuple[str, bool], ...]:
        """What a turn emits: each segment with its loss flag."""
        head = self.headers.get(role)
        if head is None:
            head = f"{self.other}{self._role_marks.sub(lambda _: self.escape, role)}{self.after_other}"
        return (head, False), (self.escaped(text), role in self.learnt), (self.end, False)

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """The (role, text) turns of formatted text."""
        at, roles = 0, list(self.headers)
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            which = next((i for i in range(len(roles)) if m[f"r{i}"] is not None), None)
            yield (self.plain(m["other"]) if which is None else roles[which]), self.plain(m["text"])
            at = m.end()


class _Piece:
    """What is gathered of consecutive turns: their text, loss spans and effect on the machine."""

    def __init__(self, template: Template):
        self.t, self.out, self.spans, self.size, self.turns = template, [], [], 0, 0
        self.ends = list(range(len(template.states)))
        self.bad: list[int | None] = [None] * len(self.ends)

    def add(self, role: str, text: str) -> None:
        self.turns += 1
        for text_, loss in self.t.segments(role, text):
            if loss:
                self.spans.append({"start": self.size, "end": self.size + len(text_)})
            self.out.append(text_)
            self.size += len(text_)
        for s, state in enumerate(self.ends):
            self.ends[s], fits = self.t.step(state, role)
            if not fits and self.bad[s] is None:
                self.bad[s] = self.turns


_PIECE = pa.schema([("block", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("ends", pa.list_(pa.int32())), ("bad", pa.list_(pa.int64()))])
_PIECE_SQL = "block long, piece long, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>, ends array<int>, bad array<long>"


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        # few rows at once: texts may be long
        for i in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns), strict=True)


def format_turns(turns: DataFrame, template: Template = Template(), *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of formatted conversations: (conv, block, piece, n_turns, formatted, loss_spans, ends, bad).

    ``formatted`` of a conversation's pieces, in order of block and piece, is its
    text; ``loss_spans`` are the code points of the piece that are learnt from.
    A conversation of one block and of moderate length is one piece.
    """
    kind = turns.schema[conv_col].dataType
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.floor(F.col(turn_col) / block).alias("block"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    dealt = rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "role", "text").select("conv", "block", "role", "text")

    def run(batches):
        key, piece, number = None, None, 0

        def row():
            values = [key[1], number, piece.turns, "".join(piece.out), piece.spans, piece.ends, piece.bad]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], to_arrow), *(pa.array([v], f.type) for v, f in zip(values, _PIECE, strict=True))], ["conv", *_PIECE.names])

        for conv, own_block, role, content in _rows(batches):
            if piece is not None and ((conv, own_block) != key or piece.size >= piece_chars):
                yield row()
                number = number + 1 if (conv, own_block) == key else 0
                piece = None
            if piece is None:
                key, piece = (conv, own_block), _Piece(template)
            piece.add(role, content)
        if piece is not None:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = to_arrow_type(kind)
    return dealt.mapInArrow(run, f"conv {kind.simpleString()}, {_PIECE_SQL}").withColumnRenamed("conv", conv_col)


class _Reader:
    """Reads a conversation's pieces one after the other, and keeps digests only."""

    def __init__(self, template: Template):
        self.t, self.turns, self.learnt = template, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.state = 0
        self.bad: int | None = None

    def add(self, formatted: str, spans: list[dict], ends: list[int], bad: list[int | None]) -> None:
        if self.bad is None and bad[self.state] is not None:
            self.bad = self.n_turns + bad[self.state]
        self.state = ends[self.state]
        for role, text in self.t.read(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for s in spans:
            text = self.t.plain(formatted[s["start"] : s["end"]])
            self.loss_chars += len(text)
            self.learnt.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learnt.hexdigest(), self.chars, self.bad, self.t.states[self.state] in self.t.finals


_READ = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "first_bad_turn": pa.int64(), "complete": pa.bool_()}


def read_pieces(pieces: DataFrame, template: Template = Template(), *, conv_col: str = "conv_id", dealt: bool = False) -> DataFrame:
    """What is read back from each conversation's pieces: counts and digests of its turns and of what is learnt from, its first turn out of order (from 1; null if none), and whether it ends as it should.

    With ``dealt`` the pieces of a conversation are together and in order already, as
    ``format_turns`` gives those of a conversation of one block.
    """
    kind = pieces.schema[conv_col].dataType
    own = pieces.select(F.col(conv_col).alias("conv"), "block", "piece", "formatted", "loss_spans", "ends", "bad")
    own = (own if dealt else own.repartition("conv").sortWithinPartitions("conv", "block", "piece")).drop("block", "piece")

    def run(batches):
        done: list[tuple] = []
        key, reader = None, None

        def out():
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow), *(pa.array(c, k) for c, k in zip(cols[1:], _READ.values(), strict=True))], ["conv", *_READ])

        for batch in batches:
            # a piece at a time: each may be long
            for i in range(batch.num_rows):
                conv, *piece = (c[i].as_py() for c in batch.columns)
                if reader is not None and conv != key:
                    done.append((key, *reader.row()))
                    reader = None
                if reader is None:
                    key, reader = conv, _Reader(template)
                reader.add(*piece)
            if done:
                yield out()
        if reader is not None:
            done.append((key, *reader.row()))
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = to_arrow_type(kind)
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, first_bad_turn long, complete boolean"
    return own.mapInArrow(run, f"conv {kind.simpleString()}, {fields}").withColumnRenamed("conv", conv_col)


def read_back(turns: DataFrame, template: Template = Template(), *, conv_col: str = "conv_id", turn_col: str = "turn", block: int = BLOCK, **cols) -> DataFrame:
    """``read_pieces`` of ``format_turns``; conversations of one block are read by the task that formats them, and only longer ones are dealt again."""
    at = F.coalesce(F.floor(F.col(turn_col) / block), F.lit(-1))
    own = fresh(turns, "_long")
    several = turns.groupBy(F.col(conv_col).alias(own)).agg(F.min(at).alias("least"), F.max(at).alias("most")).where("least < most").select(own)
    n = several.count()
    kinds = {"conv_col": conv_col, "turn_col": turn_col, "block": block, **cols}
    if not n:
        return read_pieces(format_turns(turns, template, **kinds), template, conv_col=conv_col, dealt=True)
    known = F.broadcast(several) if n <= MOST_LONG else several
    part = lambda how: turns.join(known, turns[f"`{conv_col}`"].eqNullSafe(F.col(own)), how)
    short = read_pieces(format_turns(part("left_anti"), template, **kinds), template, conv_col=conv_col, dealt=True)
    return short.unionByName(read_pieces(format_turns(part("left_semi"), template, **kinds), template, conv_col=conv_col))


#: A conversation whose texts look like control strings.
TRAP = (-7, "\\### Assistant: </turn> ok")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from all ``conversations``, and one that holds control strings, after they were formatted."""
    own = spark.createDataFrame([(TRAP[0], k, role, TRAP[1]) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(turns)


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (
  SELECT *, row_number() OVER w AS place, coalesce(lag(role) OVER w, 'start') || '>' || role AS move, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
         regexp_replace(text, '(\\|### System:|### User:|### Assistant:|### Tool:|### =|</turn>)', '\\\1', 'g') AS escaped
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) + 6 ELSE length(regexp_replace(role, '(\\|:|### =|</turn>)', '\\\1', 'g')) + 7 END + length(escaped) + 8) AS BIGINT) AS formatted_chars,
       min(place) FILTER (move NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>tool', 'tool>assistant')) AS first_bad_turn,
       bool_or(back = 1 AND role = 'assistant') AS complete
FROM placed GROUP BY conv_id
"""
