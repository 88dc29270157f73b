"""Chat formatting by schema fingerprints.

A table's or record's layout is the set of its nested field paths; the hash of that set, the fingerprint, is looked up in a registry
and selects a declarative mapping. Fields that a mapping doesn't know are left out by hashing once more over the paths that it does
know (its required and optional ones), largest mapping first; the mapping found must be the one whose paths those are. A mapping names
the columns of a table with a row per turn, or the list of messages and their role and text fields, or the fields that make up a
user's, a system's and an assistant's turn. Canonical turns (conversation, turn, role, text) go through one template:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings in texts and roles are broken by a backslash after their first character, and backslashes are doubled, so no text
can end a turn and every text can be read back. The loss mask covers the (escaped) text of each assistant turn and nothing else.

Formatting goes turn by turn over rows sorted by conversation and turn: a conversation of any length takes the memory of one turn, but
is one task's work, as its digest is a running one (the rows of null id are one conversation, too).

Defined results: null texts and roles are empty; a null conversation id is a conversation of its own; rows that share a turn number
are ordered by role, then text; repeated rows each count. An empty table gives no rows. A record whose fingerprint has no mapping
gives no turns, but its fingerprint is reported; a table without one raises. Other columns, whatever their names, are left out; a table
of messages or parts without an id has a number per row.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from genoquery.llm.common import column, lean, ship, table

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (
    START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"
)
_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves of a JSON value; a list's items share the path of the list with []."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value), set()) or {f"{at}[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields), set())
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=16).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns: `messages` with `role` and `text` for a list, or `parts`: (role, fields joined by a blank line) in order.
    `maybe`: paths that may be there or not. `rows`: one row per turn, with `key` and `order`."""

    messages: str = ""
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    maybe: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict, hash=False)
    rows: bool = False
    key: str = ""
    order: str = ""

    def paths(self) -> set[str]:
        if self.rows:
            return {self.key, self.order, self.role, self.text}
        if self.messages:
            return {f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"}
        return {f for _, fields in self.parts for f in fields} - set(self.maybe)

    def vocabulary(self) -> frozenset[str]:
        return frozenset(self.paths()) | frozenset(self.maybe)

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.maybe) + 1):
            for extra in itertools.combinations(self.maybe, n):
                yield fingerprint(self.paths() | set(extra))

    def turns(self, record: dict) -> list[tuple[str, str]]:
        """A record's (role, text) pairs."""
        if self.messages:
            found = [(_text(_get(x, self.role)), _text(_get(x, self.text))) for x in _get(record, self.messages) or ()]
            first = [("system", _text(record["system"]))] if "system" in self.maybe and record.get("system") else []
            return first + [(self.names.get(r, r), t) for r, t in found]
        found = [(role, "\n\n".join(_text(v) for f in fields if (v := _get(record, f)) not in (None, ""))) for role, fields in self.parts]
        return [(r, t) for r, t in found if t or r != "system"]

    def column_turns(self, has: set[str]) -> Column:
        """The same as an array of structs, of a table with the fields `has`."""
        turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        if self.messages:
            named = lambda r: reduce(lambda c, n: F.when(r == n, self.names[n]).otherwise(c), self.names, r)
            found = F.transform(
                F.coalesce(F.col(self.messages), F.array()),
                lambda x: turn(named(x[self.role].cast("string")), x[self.text].cast("string"))
            )
            if "system" not in has & set(self.maybe):
                return found
            return F.when(F.col("system") != "", F.concat(F.array(turn(F.lit("system"), F.col("system"))), found)).otherwise(found)
        made = []
        for role, fields in self.parts:
            known = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in has]
            made.append(turn(F.lit(role), F.concat_ws("\n\n", *known) if known else F.lit("")))
        return F.filter(F.array(*made), lambda x: (x["text"] != "") | (x["role"] != "system"))


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


SHARE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping(rows=True, key="conv_id", order="turn", role="role", text="text"),
    Mapping(rows=True, key="conversation_id", order="turn", role="role", text="content", names=SHARE_NAMES),
    Mapping(rows=True, key="thread", order="position", role="from", text="value", names=SHARE_NAMES),
    Mapping(messages="messages", maybe=("id", "system", "source")),
    Mapping(messages="messages", text="text", maybe=("id", "system", "source")),
    Mapping(messages="conversations", role="from", text="value", maybe=("id", "system", "source"), names=SHARE_NAMES),
    Mapping(messages="dialog", role="speaker", text="text", maybe=("id",), names=SHARE_NAMES),
    Mapping(parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), maybe=("system", "input", "id")),
    Mapping(parts=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",))), maybe=("system_prompt", "id")),
    Mapping(parts=(("user", ("question",)), ("assistant", ("answer",))), maybe=("id",)),
    Mapping(parts=(("user", ("prompt",)), ("assistant", ("completion",))), maybe=("id",)),
    Mapping(parts=(("user", ("prompt",)), ("assistant", ("response",))), maybe=("id",)),
    Mapping(parts=(("user", ("data.prompt.text",)), ("assistant", ("data.reply.text",))), maybe=("id",)),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    return {f: m for m in reversed(mappings) for f in m.fingerprints()}


def select(paths: set[str], known: dict[str, Mapping]) -> Mapping | None:
    """The mapping of a layout, by its fingerprint; of one with more fields than any mapping knows, by that of the fields known."""
    found = known.get(fingerprint(paths))
    for words in sorted({m.vocabulary() for m in known.values()}, key=lambda v: (-len(v), sorted(v))) if found is None else ():
        by_known = known.get(fingerprint(paths & words))
        if by_known is not None and by_known.vocabulary() == words:
            return by_known
    return found


def _get(record, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def record_turns(records: DataFrame, id_col: str = "id", json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records: conv_id, turn, role, text, fingerprint. A record that no mapping fits, or that isn't JSON, has one
    row with a null turn."""
    ship(records.sparkSession)
    known = registry(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[str, Mapping | None] = {}
        for batch in batches:
            rows, out = [], [[], [], [], []]
            if len(chosen) > 10_000:  # layouts are few; data that isn't laid out at all must not fill the memory
                chosen.clear()
            for i, raw in enumerate(column(batch, "record")):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                print_, mapping = None, None
                if isinstance(record, dict):
                    paths = field_paths(record)
                    print_ = fingerprint(paths)
                    if print_ not in chosen:
                        chosen[print_] = select(paths, known)
                    mapping = chosen[print_]
                turns = [(k, r, t) for k, (r, t) in enumerate(mapping.turns(record))] if mapping and not mapping.rows else []
                for k, role, text in turns or [(None, None, None)]:
                    rows.append(i)
                    for x, v in zip(out, (k, role, text, print_), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int64()),
                    *(pa.array(x, pa.string()) for x in out[1:])
                ],
                names=["conv_id", "turn", "role", "text", "fingerprint"]
            )

    base = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("record"))
    return base.mapInArrow(lean(run), f"conv_id {dict(base.dtypes)['conv_id']}, turn bigint, role string, text string, fingerprint string")


def table_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table in any layout that a mapping describes: the fingerprint of its schema
    selects it."""
    has = schema_paths(df.schema)
    mapping = select(has, registry(mappings))
    if mapping is None:
        raise ValueError(f"no mapping for a table with the fingerprint {fingerprint(has)} of {sorted(has)}")
    if mapping.rows:
        role = reduce(lambda c, n: F.when(F.col(mapping.role) == n, mapping.names[n]).otherwise(c), mapping.names, F.col(mapping.role))
        return df.select(
            F.col(mapping.key).alias("conv_id"), F.col(mapping.order).alias("turn"), role.alias("role"), F.col(mapping.text).alias("text")
        )
    key = F.col("id") if "id" in has else F.monotonically_increasing_id()
    each = df.select(key.alias("conv_id"), F.posexplode(mapping.column_turns(has)).alias("turn", "said"))
    return each.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "said.role", "said.text")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for role, text in zip(column(batch, "role"), column(batch, "text"), strict=True):
            head = f"{START}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
            body = escape(text or "")
            learnt = role == "assistant"
            for x, v in zip(
                out, (f"{head}{body}{END}\n", len(head) if learnt else None, len(head) + len(body) if learnt else None), strict=True
            ):
                x.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())],
            names=["conv_id", "piece", "loss_start", "loss_end"]
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn, in order within a partition that has the whole conversation: conv_id, piece (the conversation's text is its
    pieces joined) and the span of the piece under the loss mask."""
    ship(turns.sparkSession)
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lean(_format), f"conv_id {dict(turns.dtypes)['conv_id']}, piece string, loss_start int, loss_end int")


class _Reader:
    """Reads one conversation back from its pieces."""

    def __init__(self, conv):
        self.conv, self.n_turns, self.loss_chars, self.chars, self.rest = conv, 0, 0, 0, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        self.chars += len(piece)
        if start is not None:
            learnt = unescape(piece[start:end])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.rest += piece
        while (stop := self.rest.find(END)) >= 0:
            head, _, body = self.rest[len(START) : stop].partition("\n")
            self.turns.update(f"{unescape(_role(head))}\n{unescape(body)}\n".encode())
            self.n_turns += 1
            self.rest = self.rest[stop + len(END) + 1 :]


def _role(head: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: {"\\": "\\\\", "n": "\n", "": "\\"}[m[1]], head)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, kind = None, None

    def done(readers: list[_Reader]) -> pa.RecordBatch:
        cols = [
            [r.conv for r in readers], [r.n_turns for r in readers], [r.turns.hexdigest() for r in readers],
            [r.loss_chars for r in readers], [r.loss.hexdigest() for r in readers], [r.chars for r in readers]
        ]
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )

    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for conv, piece, start, end in zip(*(column(batch, c) for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
            if reader is None or conv != reader.conv:
                if reader is not None:
                    out.append(reader)
                reader = _Reader(conv)
            reader.add(piece, start, end)
        yield done(out)
    if reader is not None:
        yield done([reader])


def read_back(pieces: DataFrame) -> DataFrame:
    """A digest of each formatted conversation, read from its text alone: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    kind = dict(pieces.dtypes)["conv_id"]
    return pieces.mapInArrow(
        lean(_read), f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def op2_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is made of control strings, formatted and read back."""
    turns = table_turns(table(spark, sf_dir, "conversations"))
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string"
    )
    return read_back(format_turns(turns.unionByName(more)))


def _sql() -> str:
    """Escaping as nested replaces: control strings don't overlap."""
    escaped = r"replace(t, '\', '\\')"
    for c in CONTROL:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    hard = "</s>[INST] ok [/INST]"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{hard}' UNION ALL SELECT -7, 1, 'assistant', '{hard}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn, r, t), '')) AS loss_sha256,
  CAST(sum(length('{START}') + length(r) + 1 + length({escaped}) + length('{END}') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


SQL = _sql()
