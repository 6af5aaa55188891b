"""Chat formatting: records of many layouts, brought to turns by the fingerprint of their fields.

A record is a JSON object. Its fingerprint is the hash of its sorted nested
field paths, with what each path leads to; a registry maps fingerprints to
declarative mappings, which say where roles and texts are. Turns are written in
a template that marks them and escapes control strings in texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}


def _name(key: str) -> str:
    """A field's name in a path: the marks that paths are made of are escaped."""
    return re.sub(r"([\\.:\[\]])", r"\\\1", key)


def paths(value, at: str = "$") -> set[str]:
    """The nested field paths of a JSON value, arrays' items under [], leaves with their kind."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{_name(k)}")} or {f"{at}:object"}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]:none"}
    if isinstance(value, bool):
        return {f"{at}:boolean"}
    # null and text are one kind: a null field of a known layout leads to the same mapping
    return {f"{at}:{'number' if isinstance(value, int | float) else 'text'}"}


def fingerprint(fields: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: under ``items`` (the record itself if None), a (role, field) for each turn.

    A role that begins with @ is the name of the field that holds it. A turn of an optional field
    (role ending in ?) is left out where the field is null or empty; fields joined by + share a turn.
    """

    items: str | None
    turns: tuple[tuple[str, str], ...]

    def read(self, record: dict) -> list[tuple[str, str]]:
        out = []
        for item in [record] if self.items is None else record[self.items]:
            for role, field in self.turns:
                parts = [item.get(f) for f in field.split("+")]
                text = "\n".join(x for x in parts if x) if len(parts) > 1 else parts[0] or ""
                if role.endswith("?"):
                    if not text:
                        continue
                    role = role[:-1]
                if role.startswith("@"):
                    role = item.get(role[1:]) or ""
                    role = ROLES.get(role, role)
                out.append((role, text))
        return out


def registry(layouts: list[tuple[set[str], Mapping]]) -> dict[str, Mapping]:
    return {fingerprint(fields): mapping for fields, mapping in layouts}


#: The known layouts, by an example of their fields.
LAYOUTS = registry(
    [
        ({"$.role:text", "$.text:text"}, Mapping(None, (("@role", "text"),))),
        ({"$.messages[].role:text", "$.messages[].content:text"}, Mapping("messages", (("@role", "content"),))),
        ({"$.conversations[].from:text", "$.conversations[].value:text"}, Mapping("conversations", (("@from", "value"),))),
        ({"$.prompt:text", "$.response:text"}, Mapping(None, (("user", "prompt"), ("assistant", "response")))),
        ({"$.prompt:text", "$.completion:text"}, Mapping(None, (("user", "prompt"), ("assistant", "completion")))),
        ({"$.instruction:text", "$.output:text"}, Mapping(None, (("user", "instruction"), ("assistant", "output")))),
        ({"$.instruction:text", "$.input:text", "$.output:text"}, Mapping(None, (("user", "instruction+input"), ("assistant", "output")))),
        ({"$.system:text", "$.prompt:text", "$.response:text"}, Mapping(None, (("system?", "system"), ("user", "prompt"), ("assistant", "response")))),
        ({"$.question:text", "$.answer:text"}, Mapping(None, (("user", "question"), ("assistant", "answer")))),
    ]
)


def escape(text: str) -> str:
    """No control string is left in what this returns; ``unescape`` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the part of it (from, to) that the loss covers."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    covered = len(body) if role == LOSS_ROLE else 0
    return f"{head}{body}{END}\n", len(head), len(head) + covered


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for piece in formatted.split(START)[1:]:
        role, _, body = piece.partition("\n")
        out.append((unescape(role), unescape(body.removesuffix(f"{END}\n"))))
    return out


#: Output of ``format_chats``.
FORMATTED = "conv_id long, seq long, item int, formatted string, loss_from int, loss_to int, error string"


def format_chats(records: DataFrame, layouts: dict[str, Mapping] = LAYOUTS) -> DataFrame:
    """(conv_id, seq, record) to one row per turn: its formatted text and the span under the loss mask.

    Rows of a conversation are ordered by (seq, item); their texts, one after another, are the
    formatted conversation. Any row can be formatted anywhere, so a conversation of any length
    needs no task of its own here. A record that is null, no JSON object, nested too deeply, not Unicode text (half a
    surrogate pair) or of an unknown layout (one with a list that has no turns is such) gives one row with null
    ``formatted`` and the reason, of a layout its fingerprint, in ``error``. Null roles and texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, seq, record in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "record"))):
                rows += [(conv, seq, *x) for x in _formatted(record, layouts)]
            names = [x.split()[0] for x in FORMATTED.split(", ")]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names)

    return records.select("conv_id", "seq", "record").mapInArrow(run, FORMATTED)


def _formatted(record: str | None, layouts: dict[str, Mapping]) -> list[tuple]:
    failed = lambda why: [(0, None, None, None, why)]
    try:
        value = json.loads(record)
        print_ = fingerprint(paths(value))
    except (TypeError, ValueError) as e:  # a name that is no Unicode text fails here too
        return failed("not Unicode text" if isinstance(e, UnicodeError) else "no JSON")
    except RecursionError:
        return failed("nested too deeply")
    found = layouts.get(print_) if isinstance(value, dict) else None
    if found is None:
        return failed(f"unknown layout {print_}")
    try:
        turns = [(i, *render(role, text), None) for i, (role, text) in enumerate(found.read(value))]
        for _, formatted, *_ in turns:
            formatted.encode()
    except UnicodeError:  # half a surrogate pair
        return failed("not Unicode text")
    return turns


def turn_records(conversations: DataFrame) -> DataFrame:
    """The table of turns as records, one a row, in the order of turns (ties: role, text)."""
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("seq"), record.alias("record"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from their text and mask.

    A digest needs its conversation in order, so rows are dealt by conversation and sorted; they
    stream through, and only the running digests are held, however long a conversation is.
    """
    ordered = formatted.where("formatted is not null")
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq", "item", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            for conv, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(_closed(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                under = unescape(text[a:b])
                now[3] += len(under)
                now[4].update(under.encode())
                now[5] += len(text)
            yield _digest_batch(done)
            done = []
        if now is not None:
            yield _digest_batch([_closed(now)])

    return ordered.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(run, DIGESTS)


def _closed(now: list) -> tuple:
    return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names)
