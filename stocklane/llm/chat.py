"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

The fingerprint of a layout is a hash of its sorted nested field paths (``messages[].role`` ...), names only, so
column order and types do not matter. ``MAPPINGS`` holds, by the paths it needs, how to read each layout as
turns: either rows by turn or a list of turns in one row. ``canonical_turns`` looks the fingerprint up (an exact
registered layout first, else the mapping with the most paths of those whose paths the layout contains, of equals the one
listed first; so extra fields are harmless) and returns ``conv_id, turn, role, text``. JSON texts of mixed layouts go through
``canonical_json``: each value's own nested paths are hashed, and the distinct fingerprints select the mappings.

``format_turns`` writes a turn as ``### Label: text</turn>`` and a newline. Inside texts the backslash and the
template's control strings are replaced reversibly, so a formatted conversation (its turns joined in order) reads
back unambiguously. The loss mask covers assistant texts as code-point offsets into the formatted turn.

A conversation is never gathered in memory: turns are formatted where they lie, sorted by conversation and
turn, and digests run over the sorted stream. (One conversation's digest is one sequential hash by contract.)

Defined results: null roles and texts are empty; null turns come first; rows of equal turn go by role, then text;
repeated rows are repeated turns; a null conv_id is a conversation of its own; a very long text is one row of a stream; an
empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """The nested field paths of a type; ``[]`` stands for array elements, ``{}`` for map values."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{prefix}[]")
    if isinstance(kind, T.MapType):
        return paths(kind.valueType, f"{prefix}{{}}")
    return {prefix}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``turns``: SQL of array<struct<role,text>> in one row; or None for rows by turn,
    with ``turn``, ``role`` and ``text`` as SQL of a row."""

    needs: frozenset[str]
    conv_id: str
    turns: str | None = None
    turn: str = ""
    role: str = ""
    text: str = ""

    @property
    def key(self) -> str:
        return fingerprint(set(self.needs))


def one(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


def listed(needs: str, turns: str) -> Mapping:
    return Mapping(frozenset(["conv_id", *needs.split()]), "conv_id", turns)


#: Role names of other layouts and their canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
SHARED_ROLES = "CASE x.`from` " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items()) + " ELSE x.`from` END"

MAPPINGS = (
    Mapping(frozenset(["conv_id", "turn", "role", "text"]), "conv_id", None, "turn", "role", "text"),
    Mapping(frozenset(["conv_id", "turn", "role", "content"]), "conv_id", None, "turn", "role", "content"),
    listed("messages[].role messages[].content", "transform(messages, x -> named_struct('role', x.role, 'text', x.content))"),
    listed("conversations[].from conversations[].value", f"transform(conversations, x -> named_struct('role', {SHARED_ROLES}, 'text', x.value))"),
    listed("instruction input output", f"array({one('user', 'CASE WHEN input <> \"\" THEN concat(coalesce(instruction, \"\"), \"\\n\\n\", input) ELSE instruction END')}, {one('assistant', 'output')})"),
    listed("instruction output", f"array({one('user', 'instruction')}, {one('assistant', 'output')})"),
    listed("system prompt response", f"array({one('system', 'system')}, {one('user', 'prompt')}, {one('assistant', 'response')})"),
    listed("prompt response", f"array({one('user', 'prompt')}, {one('assistant', 'response')})"),
    listed("prompt completion", f"array({one('user', 'prompt')}, {one('assistant', 'completion')})"),
    listed("question answer", f"array({one('user', 'question')}, {one('assistant', 'answer')})"),
)
BY_FINGERPRINT = {m.key: m for m in MAPPINGS}


def mapping_of(found: set[str]) -> Mapping:
    """The mapping that a layout's fingerprint selects."""
    if (exact := BY_FINGERPRINT.get(fingerprint(found))) is not None:
        return exact
    fits = [m for m in MAPPINGS if m.needs <= found]
    if not fits:
        raise ValueError(f"no mapping for the layout {fingerprint(found)}: {', '.join(sorted(found))}")
    return max(fits, key=lambda m: len(m.needs))


def apply(df: DataFrame, mapping: Mapping) -> DataFrame:
    if mapping.turns is None:
        return df.selectExpr(f"CAST({mapping.conv_id} AS BIGINT) AS conv_id", f"CAST({mapping.turn} AS BIGINT) AS turn", f"coalesce({mapping.role}, '') AS role", f"coalesce({mapping.text}, '') AS text")
    spread = df.selectExpr(f"CAST({mapping.conv_id} AS BIGINT) AS conv_id", f"posexplode({mapping.turns}) AS (turn, x)")
    return spread.selectExpr("conv_id", "CAST(turn AS BIGINT) AS turn", "coalesce(x.role, '') AS role", "coalesce(x.text, '') AS text")


def canonical_turns(*sources: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of all sources, each by the mapping that its schema's fingerprint selects."""
    frames = [apply(df, mapping_of(paths(df.schema))) for df in sources]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def canonical_json(df: DataFrame, *, json_col: str = "json") -> DataFrame:
    """Turns of JSON objects of mixed layouts. A value that no mapping fits, or no JSON object, raises no error: it is
    one turn of role ``unmapped`` with the raw text, and conv_id if the object has one.

    ``schema_of_variant`` gives each value's nested layout. The distinct layouts are turned into paths, fingerprints and
    chosen mappings once each; every value then meets its layout's mapping, and the few mappings are applied side by side.
    """
    import pyarrow as pa

    parsed = df.select(F.col(json_col).alias("raw"), F.try_parse_json(json_col).alias("v")).withColumn("shape", F.schema_of_variant("v"))

    def choose(parts):
        for batch in parts:
            found = [layout_paths(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fingerprint, found), pa.string()), pa.array(map(number_of, found), pa.int32())], names=["shape", "layout", "chosen"])

    shapes = parsed.where("shape IS NOT NULL").select("shape").distinct().mapInArrow(choose, "shape string, layout string, chosen int")
    known = shapes.where("chosen IS NOT NULL")  # only layouts of a mapping: values of other layouts stay unmapped
    parsed = parsed.join(known, "shape", "left")
    frames = [parsed.where("chosen IS NULL").select(F.expr("try_variant_get(v, '$.conv_id', 'bigint') AS conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("unmapped").alias("role"), F.coalesce("raw", F.lit("")).alias("text"))]
    for k, m in enumerate(MAPPINGS):
        own = parsed.where(F.col("chosen") == k).select(F.from_json("raw", json_schema(m)).alias("o")).select("o.*")
        frames.append(apply(own, m))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


#: A field's name, the start of an object or array, its end, or a scalar type.
SHAPE = re.compile(r"(?:`((?:[^`]|``)*)`|(\w+)): |(OBJECT|ARRAY)<|(>)|[A-Z_]+(?:\([^)]*\))?")


def layout_paths(shape: str) -> set[str]:
    """The nested field paths of a variant's schema, such as ``OBJECT<messages: ARRAY<OBJECT<role: STRING>>>``."""
    found, around, at = set(), [], ""
    for m in SHAPE.finditer(shape):
        quoted, plain, opened, closed = m.groups()
        if quoted is not None or plain is not None:
            name = plain if quoted is None else quoted.replace("``", "`")
            at = f"{around[-1]}.{name}" if around and around[-1] else name
        elif opened:
            at += "[]" if opened == "ARRAY" else ""
            around.append(at)
        elif closed:
            around.pop()
        else:
            found.add(at)
    return found


def number_of(found: set[str]) -> int | None:
    """The place in ``MAPPINGS`` of the mapping that a layout selects, if any."""
    try:
        return MAPPINGS.index(mapping_of(found))
    except ValueError:
        return None


def json_schema(mapping: Mapping) -> str:
    top, lists = [], {}
    for need in sorted(mapping.needs):
        if "[]." in need:
            name, field = need.split("[].")
            lists.setdefault(name, []).append(field)
        else:
            top.append(f"`{need}` {'BIGINT' if need in ('conv_id', 'turn') else 'STRING'}")
    return ", ".join([*top, *(f"`{n}` ARRAY<STRUCT<{', '.join(f'`{x}`: STRING' for x in fs)}>>" for n, fs in lists.items())])


@dataclass(frozen=True)
class Template:
    """Marks of a turn. Control strings inside texts are written as a backslash and one letter."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>"
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    #: In this order when writing; reading goes backwards. The backslash comes first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))

    def escape(self, c: Column) -> Column:
        for plain, written in self.escapes:
            c = F.replace(c, F.lit(plain), F.lit(written))
        return c

    def unescape(self, c: Column) -> Column:
        for plain, written in reversed(self.escapes):
            c = F.replace(c, F.lit(written), F.lit(plain))
        return c

    def label(self, role: Column) -> Column:
        """A known role's label; another role behind ``\\r``, its colons escaped."""
        out = F.concat(F.lit("\\r"), F.replace(self.escape(role), F.lit(":"), F.lit("\\c")))
        for name, label in self.labels:
            out = F.when(role == name, F.lit(label)).otherwise(out)
        return out

    def role(self, label: Column) -> Column:
        out = self.unescape(F.replace(label.substr(F.lit(3), F.length(label)), F.lit("\\c"), F.lit(":")))
        for name, shown in self.labels:
            out = F.when(label == shown, F.lit(name)).otherwise(out)
        return out

    # The same marks, read from a stream of text.

    def plain(self, text: str) -> str:
        for written, shown in reversed(self.escapes):
            text = text.replace(shown, written)
        return text

    def turn(self, raw: str) -> tuple[str, str]:
        """Role and text of what stands before a close mark; text without an open mark and a label is a turn without role."""
        label, mark, text = raw.removeprefix(self.open).partition(self.after_role)
        if not raw.startswith(self.open) or not mark:
            return "", self.plain(raw)
        known = {shown: name for name, shown in self.labels}
        role = known.get(label)
        return self.plain(label[2:].replace("\\c", ":")) if role is None else role, self.plain(text)


class Reader:
    """Reads a conversation's turns back from its formatted text, which comes in portions cut anywhere, and its loss mask, offsets in
    the whole text. Only the marks say where a turn begins and ends; what is held is one turn at most."""

    def __init__(self, template: Template):
        self.template, self.end = template, template.close + "\n"
        self.held, self.offset, self.spans, self.searched = "", 0, [], 0

    def feed(self, portion: str, spans: list[tuple[int, int]]):
        """(role, text, loss text) of every turn that ends in what has come so far."""
        self.held += portion
        self.spans += spans
        while (at := self.held.find(self.end, max(0, self.searched - len(self.end)))) >= 0:
            raw, upto = self.held[:at], self.offset + at
            role, text = self.template.turn(raw)
            own = [s for s in self.spans if s[0] <= upto]
            self.spans = self.spans[len(own) :]
            yield role, text, "".join(self.template.plain(raw[a - self.offset : b - self.offset]) for a, b in own)
            self.held, self.offset, self.searched = self.held[at + len(self.end) :], upto + len(self.end), 0
        self.searched = len(self.held)


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Each turn as ``formatted``, with ``loss_start`` and ``loss_end`` (code points in it; equal where no loss)."""
    head = F.concat(F.lit(template.open), template.label(F.col("role")), F.lit(template.after_role))
    body = template.escape(F.col("text"))
    marked = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    start = F.length("head").cast("long")
    return marked.select(
        "conv_id", "turn", "role", "text",
        F.concat("head", "body", F.lit(template.close + "\n")).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("role") == "assistant", start + F.length("body")).otherwise(start).alias("loss_end"),
    )


def read_turns(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Role, text and loss text of formatted turns, from ``formatted`` and the mask alone."""
    inner = F.substring(F.col("formatted"), F.lit(len(template.open) + 1), F.length("formatted") - len(template.open) - len(template.close) - 1)
    cut = formatted.withColumn("inner", inner).withColumn("at", F.instr("inner", template.after_role))
    cut = cut.withColumn("label", F.substring(F.col("inner"), F.lit(1), F.col("at") - 1))
    return cut.select(
        *[c for c in formatted.columns if c not in ("role", "text")],
        template.role(F.col("label")).alias("role"),
        template.unescape(F.substring(F.col("inner"), F.col("at") + len(template.after_role), F.length("inner"))).alias("text"),
        template.unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss_text"),
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """Whole conversations as one text each, for conversations that fit a row."""
    row = F.struct(F.col("turn").isNotNull().alias("set"), "turn", "role", "text", "formatted")
    return formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("conv_id", F.array_join("rows.formatted", "").alias("formatted"))


REPORT = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def report(*sources: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, read back from the formatted output: counts and digests of its turns and its loss texts."""
    import pyarrow as pa

    formatted = format_turns(canonical_turns(*sources), template)
    # Order is taken from the canonical rows, everything else from the conversation's text and its mask.
    placed = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def digest(parts):
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        own, done = None, []

        def end() -> list:
            return [own[0], own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5]]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))

        for part in parts:
            for conv, text, start, stop in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if own is None or own[0] != conv:
                    done += [end()] if own else []
                    own, reader = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], Reader(template)
                mask = [(own[5] + start, own[5] + stop)] if stop > start else []
                own[5] += len(text)
                for role, said, loss in reader.feed(text, mask):
                    own[1] += 1
                    own[2].update(f"{role}\n{said}\n".encode())
                    own[3] += len(loss)
                    own[4].update(loss.encode())
            if len(done) > 1000:
                yield batch(done)
                done = []
        done += [end()] if own else []
        if done:
            yield batch(done)

    return placed.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(digest, REPORT)
