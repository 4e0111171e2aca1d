"""Chat formatting: heterogeneous layouts into canonical turns, and those into marked text with a loss mask.

A layout is known by its fingerprint: a hash of the sorted nested field paths of a schema (or of a JSON record) that the declared mappings speak of. The
mapping it selects says where roles and texts lie. Each turn becomes a segment

    ### <role>:
    <text>
    </turn>

in which a backslash stands before every backslash and control string of the text, so that the segment reads back exactly; its loss mask is the
range of the text if the role is the assistant's. A conversation's formatted text is its segments in order; being rows, they need no memory beyond one
turn, whatever the length of the conversation. Digests run over sorted segments as a stream: SHA-256 is sequential, so one conversation is read by
one task, which holds one batch of it.

Nulls and edge cases: a null text is empty; a null role is the empty role; turns of one conversation with equal numbers are ordered by role and text,
repeated rows both count; a null turn sorts first; null conv_ids are one conversation; an empty table gives no rows; columns beyond the layout's are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, by_batch, prepare, table

# Names that roles go by.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where turns lie: rows (role and text columns), a list (its path, role and text fields), or single fields, each of a fixed role."""

    name: str
    rows: tuple[str, str] | None = None
    list: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.rows:
            return ["turn", *self.rows]
        if self.list:
            at, role, text = self.list
            return [f"{at}[].{role}", f"{at}[].{text}"]
        return [path for _, path in self.fields]


LAYOUTS = (
    Layout("turn_rows", rows=("role", "text")),
    Layout("messages", list=("messages", "role", "content")),
    Layout("conversations", list=("conversations", "from", "value")),
    Layout("instruction_input", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


KNOWN = frozenset(p for layout in LAYOUTS for p in layout.paths())
BY_FINGERPRINT = {fingerprint(layout.paths()): layout for layout in LAYOUTS}


def schema_paths(schema: T.DataType, at: str = "") -> set[str]:
    if isinstance(schema, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in schema.fields))
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return {at}


def record_paths(record, at: str = "") -> set[str]:
    if isinstance(record, dict):
        return set().union(*(record_paths(v, f"{at}.{k}" if at else k) for k, v in record.items()))
    if isinstance(record, list):
        return set().union(*(record_paths(v, f"{at}[]") for v in record)) or {f"{at}[]"}
    return {at}


def layout_of(paths: set[str]) -> Layout | None:
    """By fingerprint; where paths of several layouts meet, the one with most paths among those that are there in full."""
    known = paths & KNOWN
    whole = [layout for layout in LAYOUTS if known.issuperset(layout.paths())]
    return BY_FINGERPRINT.get(fingerprint(known)) or max(whole, key=lambda x: len(x.paths()), default=None)


def canonical_role(role: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(role.cast("string"), F.lit(""))))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[low], low)


def turns(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """df of any known layout -> conv_id, turn, role, text. ValueError if the layout is unknown."""
    layout = layout_of(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(schema_paths(df.schema))}")
    key = df[conv].cast("long").alias("conv_id")
    if layout.rows:
        role, text = layout.rows
        rows = df.select(key, df["turn"].cast("long").alias("turn"), df[role].alias("role"), df[text].alias("text"))
    elif layout.list:
        at, role, text = layout.list
        rows = df.select(key, F.posexplode(at).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), F.col(f"m.{role}").alias("role"), F.col(f"m.{text}").alias("text"))
    else:
        each = F.array(*(F.struct(F.lit(role).alias("role"), df[path].cast("string").alias("text")) for role, path in layout.fields))
        rows = df.select(key, F.posexplode(each).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text").where("role <> 'system' or text <> ''")
    return rows.select("conv_id", "turn", canonical_role(rows["role"]).alias("role"), F.coalesce(rows["text"].cast("string"), F.lit("")).alias("text"))


def record_turns(record) -> list[tuple[str, str]]:
    """Turns of one JSON record; none if its layout is unknown."""
    layout = layout_of(record_paths(record)) if isinstance(record, dict) else None
    if layout is None or layout.rows:
        return []
    if layout.list:
        at, role, text = layout.list
        pairs = [(m.get(role), m.get(text)) for m in record[at] if isinstance(m, dict)]
    else:
        pairs = [(role, record[path]) for role, path in layout.fields if role != "system" or record[path]]
    out = []
    for role, text in pairs:
        low = str(role or "").strip(" ").lower()
        out.append((ROLES.get(low, low), "" if text is None else str(text)))
    return out


def json_turns(df: DataFrame, column: str, conv: str = "conv_id") -> DataFrame:
    """Rows that hold a JSON record each, of layouts that differ by row -> conv_id, turn, role, text; records of unknown layout give no turns."""
    prepare(df.sparkSession)
    schema = arrow_schema("conv_id long, turn long, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = record_turns(json.loads(raw or "null"))
                except ValueError:
                    found = []
                out += [{"conv_id": key, "turn": k, "role": role, "text": text} for k, (role, text) in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return df.select(df[conv].cast("long"), df[column].cast("string")).mapInArrow(run, "conv_id long, turn long, role string, text string")


_CONTROL = r"(\\|###|</turn>)"
_SEGMENT = re.compile(r"### ((?:[^\\:\n]|\\(?:\\|###|</turn>|:|\n))*+):\n((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")


def segments(rows: DataFrame) -> DataFrame:
    """Canonical turns -> conv_id, turn, role, formatted, loss_from, loss_to (code points of formatted; null where no loss is taken)."""
    head = F.concat(F.lit("### "), F.regexp_replace("role", r"(\\|###|</turn>|:|\n)", r"\\$1"), F.lit(":\n"))
    body = F.regexp_replace("text", _CONTROL, r"\\$1")
    ours = F.col("role") == "assistant"
    out = rows.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    return out.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit("\n</turn>\n")).alias("formatted"),
        F.when(ours, F.length("head")).alias("loss_from"), F.when(ours, F.length("head") + F.length("body")).alias("loss_to"),
    )


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text. ValueError if it is none."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if not m or not m[2].endswith("\n"):
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2][:-1])))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Segments -> conv_id, turn, role, text, loss (what the mask covers, unescaped; null where it is the text, or where no loss is taken), masked, chars: parsed where they lie."""
    schema = "conv_id long, turn long, role string, text string, loss string, masked boolean, chars long"

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in ("conv_id", "turn", "role", "text", "loss", "masked", "chars")}
            for key, turn, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                loss = None if start is None else unescaped(segment[start:end])
                for k, (role, text) in enumerate(parsed(segment)):
                    first = k == 0
                    row = (key, turn, role, text, loss if first and loss != text else None, first and start is not None, len(segment) if first else 0)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            return out

        return work

    return by_batch(formatted.select(formatted["conv_id"].cast("long"), formatted["turn"].cast("long"), "formatted", "loss_from", "loss_to"), schema, make)


def digests(formatted: DataFrame) -> DataFrame:
    """Segments -> what reading them back gives for each conversation. The task that a long conversation comes to only hashes: parsing is done before."""
    prepare(formatted.sparkSession)
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, now, state, done = False, None, None, []

        def close() -> None:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, role, text, loss, masked, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or key != now:
                    if began:
                        close()
                    began, now, state = True, key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[4] += chars
                if masked:
                    said = text if loss is None else loss
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
            if len(done) >= 1000:
                yield rows()
        if began:
            close()
        if done:
            yield rows()

    dealt = read_back(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text", "loss", "masked", "chars").mapInArrow(run, ddl)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(segments(turns(rows).unionByName(turns(extra))))


_HARD = "\\### Assistant: </turn> ok"
ORACLE_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, lower(trim(coalesce(role, ''))) AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}'
), f AS (
  SELECT *, length('### ' || role || ':' || chr(10) || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || chr(10) || '</turn>' || chr(10)) AS formatted FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(formatted)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
