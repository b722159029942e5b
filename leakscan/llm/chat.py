"""Chat formatting by a finite-state machine over roles and a declarative template.

The template names, for each role, the text before and after a turn and whether its text is learnt from, and lists the moves
between roles that are in order. The machine walks over a conversation's turns and emits segments: control text or turn
text, each with a loss flag. Control strings inside turn texts are escaped, so the formatted conversation can be parsed back
to the very turns. A turn out of order is formatted like any other and marked, with the state it was met in.

Plan: one shuffle by conversation, sorted by turn; the machine streams over sorted rows and keeps only its state, so a long
conversation is never held as a whole. A segment is a row.

Cases: null text: empty. Null role: the empty role. Roles that the template does not name are written with their name and are
never in order. Equal turn numbers: ordered by role, then text. Repeated rows: each is a turn. Null conversation: one of its own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.common import table

START = ""


@dataclass(frozen=True)
class Template:
    """roles: role -> (before, after, learnt from); moves: role -> roles that may follow, ``START`` at the beginning."""

    roles: dict[str, tuple[str, str, bool]]
    moves: dict[str, tuple[str, ...]]
    #: Role names that the template lacks stand between these, before and after such turns.
    named: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|turn|>")
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = {m.strip() for before, after, _ in self.roles.values() for m in (before, after)} | set(self.named)
        object.__setattr__(self, "controls", tuple(sorted(marks - {""}, key=lambda m: (-len(m), m))))


INSTRUCT = Template(
    roles={
        "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
        "user": ("[INST] ", " [/INST]\n", False),
        "assistant": ("<s>", "</s>\n", True),
    },
    moves={
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
)


class Machine:
    """Formats the turns of one conversation after another."""

    def __init__(self, template: Template):
        self.template = template
        self._marks = re.compile("|".join(map(re.escape, (template.escape, *template.controls))))
        self.state = START

    def restart(self) -> None:
        self.state = START

    def escape(self, text: str) -> str:
        return self._marks.sub(lambda m: self.template.escape + m[0], text)

    def step(self, role: str, text: str) -> tuple[bool, list[tuple[str, str, bool]]]:
        """(in order, segments of (kind, text, loss))."""
        t = self.template
        in_order = role in t.moves.get(self.state, ())
        self.state = role
        before, after, loss = t.roles.get(role) or (t.named[0] + self.escape(role) + t.named[1], t.named[2], False)
        return in_order, [("control", before, False), ("text", self.escape(text), loss), ("control", after, False)]


class Parser:
    """Reads turns back from formatted text that comes in pieces cut between turns."""

    def __init__(self, template: Template):
        self.template = template
        self._by_start = {before: (role, after) for role, (before, after, _) in template.roles.items()}
        self._starts = re.compile("|".join(map(re.escape, sorted([*self._by_start, template.named[0]], key=len, reverse=True))))
        self._ends = {mark: self._until(mark) for mark in {after for _, after, _ in template.roles.values()} | set(template.named)}
        self._escaped = re.compile(re.escape(template.escape) + "(.)", re.S)

    def _until(self, mark: str) -> re.Pattern:
        """Text of escaped characters and others up to the mark."""
        e = re.escape(self.template.escape)
        return re.compile(rf"((?:{e}.|(?!{re.escape(mark)})[^{e}])*+){re.escape(mark)}", re.S)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def turns(self, formatted: str):
        at = 0
        while at < len(formatted):
            start = self._starts.match(formatted, at)
            if start is None:
                raise ValueError(f"no turn starts at {at}")
            at = start.end()
            if start[0] == self.template.named[0]:
                name = self._ends[self.template.named[1]].match(formatted, at)
                role, after, at = self.unescape(name[1]), self.template.named[2], name.end()
            else:
                role, after = self._by_start[start[0]]
            body = self._ends[after].match(formatted, at)
            if body is None:
                raise ValueError(f"the turn at {at} has no end")
            yield role, self.unescape(body[1])
            at = body.end()


SEGMENTS = "turn long, segment int, kind string, role string, text string, loss boolean, in_order boolean"


def format_conversations(
    rows: DataFrame, key: str, turn: str, role: str, text: str, template: Template = INSTRUCT
) -> DataFrame:
    """conversation, turn, segment, kind, role, text, loss, in_order: segments in order inside each partition.

    All segments of a conversation are in one partition. ``turn`` is the position from 0 on.
    """
    turns = rows.select(
        F.col(f"`{key}`").alias("conversation"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    kind = turns.schema["conversation"].dataType.simpleString()
    ordered = turns.repartition("conversation").sortWithinPartitions("conversation", "turn", "role", "text")

    def emit(batches):
        machine, current, at = Machine(template), (), 0
        for b in batches:
            keys, index, out = b.column("conversation"), [], []
            for i, (k, r, x) in enumerate(zip(keys.to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)):
                if current != (k,):
                    current, at = (k,), 0
                    machine.restart()
                good, segments = machine.step(r, x)
                for number, (what, part, loss) in enumerate(segments):
                    index.append(i)
                    out.append((at, number, what, r, part, loss, good))
                at += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(index, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["conversation", "turn", "segment", "kind", "role", "text", "loss", "in_order"],
            )

    return ordered.mapInArrow(emit, f"conversation {kind}, {SEGMENTS}")


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, from the formatted text and its mask alone: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, in_order (whether the machine met all turns in order). Takes what ``format_conversations`` returns."""
    kind = segments.schema["conversation"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]

    def read(batches):
        parser = Parser(template)
        state = None  # [key, turns, digest of turns, loss characters, digest of loss, characters, in order, pending text]

        def row():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6])

        def fold():
            """Parses the text of the turn that is complete."""
            for role, text in parser.turns("".join(state[7])):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[7] = []

        def batch(out, key_type):
            columns = list(zip(*out, strict=True))
            kinds = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conversation", *names]
            )

        key_type = None
        for b in batches:
            key_type, out = b.column("conversation").type, []
            columns = (b.column(c).to_pylist() for c in ("conversation", "segment", "text", "loss", "in_order"))
            for key, segment, text, loss, good in zip(*columns, strict=True):
                if state is not None and segment == 0:
                    fold()
                if state is None or state[0] != key:
                    if state is not None:
                        out.append(row())
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, []]
                state[5] += len(text)
                state[6] &= good
                state[7].append(text)
                if loss:
                    plain = parser.unescape(text)
                    state[3] += len(plain)
                    state[4].update(plain.encode("utf-8", "surrogatepass"))
            if out:
                yield batch(out, key_type)
        if state is not None:
            fold()
            yield batch([row()], key_type)

    columns = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"
    return segments.mapInArrow(read, f"conversation {kind}, {columns}")


#: A conversation that says the template's own control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    given = table(spark, sf_dir, "conversations").select(*names)
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    segments = format_conversations(given.unionByName(probe), *names)
    return read_back(segments).withColumnRenamed("conversation", "conv_id")


#: What the turns and the learnt text must hash to; the formatted length is the template's.
SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
),
e as (
  select *,
    regexp_replace(text, '(\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role\|>|<\|text\|>|<\|turn\|>)', '\\\1', 'g')
      as escaped,
    lag(role, 1, '') over (partition by conv_id order by turn, role, text) as before
  from c
)
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  sum(length(escaped) + case role when 'system' then 18 when 'user' then 16 when 'assistant' then 8
    else 24 + length(role) end)::bigint as formatted_chars,
  bool_and(case before when '' then role in ('system', 'user') when 'system' then role = 'user'
    when 'user' then role = 'assistant' when 'assistant' then role = 'user' else false end) as in_order
from e group by conv_id
"""
