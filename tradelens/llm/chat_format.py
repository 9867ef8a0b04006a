"""Chat formatting by schema fingerprints, DataFrame functions only.

Chat records come in many layouts: a prompt and a response, an instruction with
an input and an output, lists of messages under one name or another. The *field
paths* a record really has (nested ones included, nulls left out) are hashed into
a fingerprint, and the fingerprint selects a declarative mapping: which paths it
covers and which expression turns them into canonical turns, an array of
(role, text). A record whose fingerprint no mapping knows gets null turns and keeps its
fingerprint for inspection, so it is reported and not lost.

The template marks every turn::

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

Control strings inside roles and texts are broken by a backslash after their
first character, and backslashes are doubled, so a text cannot end its turn and
every text comes back exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

# Control strings of public chat templates; none survives in a text.
CONTROL = [START, SEPARATOR, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
           "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>"]

# Other layouts' names of the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant",
              "chatgpt": "assistant", "bing": "assistant", "prompter": "user"}

TURNS = "array<struct<role:string,text:string>>"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}<>/" else c for c in text)


def _control_pattern() -> str:
    """Matches, with no width, between the first character of a control string and its rest."""
    firsts = sorted({c[0] for c in CONTROL})
    return "|".join("(?<={})(?={})".format(_quoted(f), "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == f))
                    for f in firsts)


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _control_pattern(), "\\\\")  # one backslash, as a replacement writes it


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


# ---- layouts --------------------------------------------------------------


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def role_name(role: Column) -> Column:
    """Canonical role of a foreign name; others stay."""
    named = reduce(lambda e, kv: e.when(F.lower(role) == kv[0], kv[1]), ROLE_NAMES.items(), F.when(F.lit(False), ""))
    return named.otherwise(role)


def _listed(column: str, role: str, text: str) -> Callable[[], Column]:
    def build():
        return F.transform(F.col(column), lambda m: _turn(role_name(m[role]), m[text]))
    return build


def _plain(*turns: tuple[str, str]) -> Callable[[], Column]:
    return lambda: F.array(*[_turn(role, F.col(path)) for role, path in turns])


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths it consists of and its canonical turns. Columns
    outside ``fields`` (ids, scores) are no part of a fingerprint."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column]


def _exact(column: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(column), lambda m: _turn(F.coalesce(m["role"].cast("string"), F.lit("")), m["content"]))


MAPPINGS = [
    Mapping("messages", ("messages[].content", "messages[].role"), _exact("messages")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "output"), _plain(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("input", "instruction", "output"), lambda: F.array(
        _turn("user", F.concat_ws("\n", "instruction", "input")), _turn("assistant", F.col("output")))),
    Mapping("prompt_response", ("prompt", "response"), _plain(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("completion", "prompt"), _plain(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"),
            _plain(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("answer", "question"), _plain(("user", "question"), ("assistant", "answer"))),
]

FIELDS = sorted({p.split("[")[0].split(".")[0] for m in MAPPINGS for p in m.paths})


def _some(column: Column, name: str) -> Column:
    return F.coalesce(F.exists(column, lambda e: e[name].isNotNull()), F.lit(False))


def _paths(field: T.StructField, column: Column, path: str, needed: set[str]) -> list[tuple[str, Column]]:
    """(path, is it there) of a column: a struct by its fields, an array of structs
    by its elements' fields. A field that a mapping needs is there with the list (an
    empty list has it, its type says so), any other if some element has a value."""
    kind = field.dataType
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _paths(f, column[f.name], f"{path}.{f.name}", needed)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [(p := f"{path}[].{f.name}", column.isNotNull() if p in needed else _some(column, f.name))
                for f in kind.elementType.fields]
    return [(path, column.isNotNull())]


def field_paths(df: DataFrame, fields: list[str] | None = None, mappings: list[Mapping] = MAPPINGS) -> Column:
    """Sorted array of the field paths a row has."""
    needed = {p for m in mappings for p in m.paths}
    there = [x for f in df.schema.fields if f.name in (fields or FIELDS) for x in _paths(f, F.col(f"`{f.name}`"), f.name, needed)]
    present = [F.when(ok, F.lit(path)) for path, ok in there]
    return F.sort_array(F.array_compact(F.array(*present))) if present else F.array().cast("array<string>")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical(records: DataFrame, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns``."""
    needed = {p for m in mappings for p in m.paths}
    here = {p for f in records.schema.fields for p, _ in _paths(f, F.col(f"`{f.name}`"), f.name, needed)}
    known = [m for m in mappings if set(m.paths) <= here]  # others cannot be resolved here, nor occur
    own = F.col("fingerprint")
    expected = [(m, fingerprint(F.array(*[F.lit(p) for p in sorted(m.paths)]))) for m in known]
    layout = reduce(lambda e, x: e.when(own == x[1], x[0].name), expected, F.when(F.lit(False), ""))
    turns = reduce(lambda e, x: e.when(own == x[1], x[0].turns()), expected, F.when(F.lit(False), F.lit(None).cast(TURNS)))
    marked = records.withColumn("fingerprint", fingerprint(field_paths(records, sorted({p.split("[")[0].split(".")[0] for m in mappings for p in m.paths}), mappings)))
    return marked.withColumns({"layout": layout, "turns": turns})


# ---- template -------------------------------------------------------------


def format_turns(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), escaped(t["role"]), F.lit(SEPARATOR), escaped(t["text"]), F.lit(END))), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    segments = F.split(formatted, _quoted(END))
    return F.transform(F.slice(segments, 1, F.size(segments) - 1), lambda s: F.struct(
        unescaped(F.substring(F.split_part(s, F.lit(SEPARATOR), F.lit(1)), len(START) + 1, 1 << 30)).alias("role"),
        unescaped(F.split_part(s, F.lit(SEPARATOR), F.lit(2))).alias("text")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array of longs, in rounds that add the sums of 1, 2, 4, ... places
    before (an appended-to array would be copied for every element)."""
    def summed(own: Column) -> Column:
        rounds = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k) < F.size(own))
        return F.aggregate(rounds, own, lambda sums, k: F.zip_with(
            F.concat(F.array_repeat(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("int")),
                     F.slice(sums, F.lit(1), F.size(sums) - F.pow(F.lit(2), k).cast("int"))),
            sums, lambda before, here: before + here))
    return _bound(numbers, summed)


def loss_spans(formatted: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """(start, length) in code points of the texts of the given roles' turns, as they
    stand in the formatted string: what a model is trained on."""
    segments = F.split(formatted, _quoted(END))
    size = lambda s: (F.length(s) + len(END)).cast("long")

    def spans(turns: Column) -> Column:
        marked = F.zip_with(turns, running_sums(F.transform(turns, size)), lambda s, end: F.struct(
            F.substring(F.split_part(s, F.lit(SEPARATOR), F.lit(1)), len(START) + 1, 1 << 30).alias("role"),
            (end - size(s) + F.length(F.split_part(s, F.lit(SEPARATOR), F.lit(1))) + len(SEPARATOR)).alias("start"),
            F.length(F.split_part(s, F.lit(SEPARATOR), F.lit(2))).cast("long").alias("length")))
        return F.transform(F.filter(marked, lambda t: t["role"].isin(*roles)),
                           lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))

    return _bound(F.slice(segments, F.lit(1), F.size(segments) - 1), spans)


PORTION = 4096


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order. A string is searched for a place from its
    beginning, so it is cut into portions first and every span looks into its own only."""
    portions = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PORTION}}}"), F.lit(0))

    def under(portion: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s["start"] / PORTION).cast("int")
            last = F.floor((s["start"] + F.greatest(s["length"], F.lit(1)) - 1) / PORTION).cast("int")
            own = F.array_join(F.slice(portion, first + 1, last - first + 1), "")
            return unescaped(F.substring(own, (s["start"] - first * PORTION + 1).cast("int"), s["length"].cast("int")))
        return F.array_join(F.transform(spans, one), "")

    return _bound(portions, under)


def format_chat(records: DataFrame, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """``records``, all columns, with ``fingerprint``, ``layout``, ``turns``,
    ``formatted`` and ``loss_spans`` (of assistant texts).

    A record of an unknown layout (or with nothing in it) has null layout, turns,
    formatted and spans. Null texts are empty; a null role is empty in the messages
    layout. Repeated records are formatted as often as they come. Columns of the
    results' names are replaced; other columns are carried along.
    """
    done = canonical(records, mappings).withColumn("formatted", format_turns(F.col("turns")))
    return done.withColumn("loss_spans", F.when(F.col("formatted").isNotNull(), loss_spans(F.col("formatted"))))


def gathered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record per conv_id in the messages
    layout, by turn (then role and text; a null turn comes first). A conversation
    is one value of one record, so its rows meet in one task by nature."""
    message = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    listed = rows.select("conv_id", message.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return listed.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
