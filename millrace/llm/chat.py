"""Chat formatting: a fingerprint of their field paths selects the mapping of a layout, turns are marked by a
template whose control strings are escaped in texts, and a loss mask marks what assistants say."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that steer some chat template or other; in a text they get a backslash after the first character.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRST = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_REST = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
#: The same patterns for Java and Python: a control string with any number of backslashes after its first character.
ESCAPE, UNESCAPE = rf"([{_FIRST}])(\\*)({_REST})", rf"([{_FIRST}])\\(\\*)({_REST})"


def escape(text: str) -> str:
    return re.sub(ESCAPE, r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return re.sub(UNESCAPE, r"\1\2\3", text)


def paths(value: Any, at: str = "") -> set[str]:
    """Nested field paths of a record; the elements of a list share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else str(k))} or {at}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same paths from a Spark type."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(found: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def _role(role: Any) -> str:
    role = "" if role is None else str(role)
    return _NAMES.get(role, role)


def _text(text: Any) -> str:
    return "" if text is None else text if isinstance(text, str) else json.dumps(text, ensure_ascii=False)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. paths: the field paths that tell the layout; each: the list whose elements are turns
    of their own (none: the record itself); turns: (role, text) of each turn. "@x" is the field x, other roles are
    themselves; a text is one or more fields, joined by a blank line. optional: turns without any text are left
    out, except the assistant's."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    optional: bool = False

    @property
    def key(self) -> str:
        return fingerprint(self.paths)


def _asked(**turns: str | tuple[str, ...]) -> Mapping:
    """One turn for each role, from fields beside one another."""
    told = tuple((role, (f,) if isinstance(f, str) else f) for role, f in turns.items())
    return Mapping(tuple(f for _, fields in told for f in fields), told, optional=True)


#: Known layouts by the fingerprint of their paths.
MAPPINGS: dict[str, Mapping] = {
    m.key: m
    for m in (
        Mapping(("role", "text"), (("@role", ("text",)),)),
        Mapping(("role", "content"), (("@role", ("content",)),)),
        Mapping(("from", "value"), (("@from", ("value",)),)),
        Mapping(("messages[].role", "messages[].content"), (("@role", ("content",)),), "messages"),
        Mapping(("messages[].role", "messages[].text"), (("@role", ("text",)),), "messages"),
        Mapping(("conversations[].from", "conversations[].value"), (("@from", ("value",)),), "conversations"),
        Mapping(("messages[]",)),
        Mapping(("conversations[]",)),
        _asked(user="prompt", assistant="response"),
        _asked(user="prompt", assistant="completion"),
        _asked(system="system", user="prompt", assistant="response"),
        _asked(system="system", user="prompt", assistant="completion"),
        _asked(user="question", assistant="answer"),
        _asked(user="instruction", assistant="output"),
        _asked(user=("instruction", "input"), assistant="output"),
    )
}


def layout_of(found: set[str], mappings: dict[str, Mapping] | None = None) -> str | None:
    """The fingerprint by which paths select a mapping; None where none is known. Of the found paths only those count
    that a mapping names, so other fields (ids, names, sources) don't hide a layout. Where several fit, the one that names most
    paths is meant; of these, the first listed."""
    mappings = MAPPINGS if mappings is None else mappings
    fits = [k for k, m in mappings.items() if fingerprint(found.intersection(m.paths)) == k]
    return max(fits, key=lambda k: len(mappings[k].paths), default=None)


def canonical(record: dict, mappings: dict[str, Mapping] | None = None) -> list[tuple[str, str]] | None:
    """(role, text) turns of a record; None where no mapping knows its layout."""
    key = layout_of(paths(record), mappings)
    if key is None:
        return None
    how = (MAPPINGS if mappings is None else mappings)[key]
    out = []
    for r in [record] if how.each is None else record.get(how.each) or []:
        for role, fields in how.turns:
            said = "\n\n".join(t for f in fields if (t := _text(r.get(f))))
            role = _role(r.get(role[1:])) if role.startswith("@") else role
            if said or not how.optional or role == "assistant":
                out.append((role, said))
    return out


def turns_from_json(records: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """One row for each turn of each JSON record: id_col, turn, role, text, layout, problem.

    Null, empty, invalid records and unknown layouts give one row with null turn and a problem, so
    that nothing is lost silently. A record without turns gives none of either: problem 'no turns'. layout is the
    fingerprint of the mapping that was used, or that of all paths of an unknown record. Repeated records and null ids
    are records like others, very long ones are read whole, and an empty table gives no rows.
    """
    shape = T.ArrayType(T.StructType([T.StructField(n, t()) for n, t in (("turn", T.LongType), ("role", T.StringType), ("text", T.StringType), ("layout", T.StringType), ("problem", T.StringType))]))

    @F.udf(shape, useArrow=True)
    def read(raw: str | None) -> list:
        try:
            record = json.loads(raw or "")
        except ValueError:
            return [(None, None, None, None, "not JSON")]
        layout = layout_of(paths(record)) if isinstance(record, dict) else None
        if layout is None:
            return [(None, None, None, fingerprint(paths(record)), "unknown layout")]
        turns = canonical(record)
        return [(i, r, t, layout, None) for i, (r, t) in enumerate(turns)] or [(None, None, None, layout, "no turns")]

    return records.select(F.col(id_col), F.inline(read(F.col(json_col))))


def row_turns(rows: DataFrame) -> DataFrame:
    """Rows that are turns, beside other columns: adds role and text as the row's layout maps them. The layout of a
    DataFrame is its schema: the fingerprint of its paths selects the mapping once for all rows."""
    turns = {k: m for k, m in MAPPINGS.items() if m.each is None and len(m.turns) == 1 and m.turns[0][0].startswith("@")}
    key = layout_of(schema_paths(rows.schema), turns)
    if key is None:
        raise ValueError(f"no mapping for rows with {sorted(schema_paths(rows.schema))}")
    (role, texts), = turns[key].turns
    names = F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))
    said = F.coalesce(F.col(role[1:]), F.lit(""))
    return rows.withColumns({"role": F.coalesce(names[said], said) if role != "@role" else said, "text": F.concat_ws("\n\n", *texts)})


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds `formatted` and the loss span in it, loss_start and loss_length (code points; null where
    the turn is not an assistant's). A conversation's formatted text is that of its turns in order.

    Row by row, so a conversation of any length needs no task of its own. A line feed in a role is
    written as a backslash and n, and a backslash doubled, so roles read back, too.
    """
    role = _escaped(F.replace(F.replace("role", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    head, body = F.concat(F.lit(OPEN), role, F.lit(CLOSE)), _escaped(F.col("text"))
    says = F.col("role") == "assistant"
    return turns.withColumns({"formatted": F.concat(head, body, F.lit(END)), "loss_start": F.when(says, F.char_length(head)), "loss_length": F.when(says, F.char_length(body))})


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, text = part.removeprefix(OPEN).split(CLOSE, 1)
        role = re.sub(r"\\([\\n])", lambda m: {"n": "\n"}.get(m[1], m[1]), unescape(role))
        out.append((role, unescape(text)))
    return out


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """For each conversation, read back from the formatted rows: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. formatted: id_col, turn, role, text and format_turns()' columns.

    Rows are dealt by conversation, sorted in its turns' order (ties: role, then text; null turns
    first) and streamed through the digests: memory does not grow with a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []
        now: Any = None
        state: list = []

        def close() -> None:
            if state:
                out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for id_, text, start, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (id_,):
                    close()
                    now, state = (id_,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    said = unescape(text[start : start + length])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(out) > 1000:
                yield flush()
        close()
        yield flush()

    rows = formatted.select(F.col(id_col).cast("long").alias("id"), "formatted", "loss_start", "loss_length", "turn", "role", "text")
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "formatted", "loss_start", "loss_length")
    got = rows.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return got.withColumnRenamed("id", id_col)


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows that are turns: id_col, turn, role, text and format_turns()' columns.

    Null text or role: empty. Null id: one conversation of its own. Null turns come first; rows with
    equal turns are ordered by role, then text; repeated rows are repeated turns. Empty table: no rows.
    Other columns, whatever their names, are left behind.
    """
    return format_turns(row_turns(rows).select(F.col(id_col), F.col(turn_col).alias("turn"), "role", "text"))
