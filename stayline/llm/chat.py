"""Chat formatting with built-in functions only.

A record's layout is told by its fingerprint: the hash of its nested field paths. Each known fingerprint selects a
mapping, declared as data, that turns the record into canonical turns (conv_id, turn, role, text, layout). Tables are told
apart by their schema, and by what is filled in a row if it fits several; JSON records by the shape of each record. Paths
that no layout names are left out first.

The template marks each turn as  <|im_start|>role\\ntext<|im_end|>\\n . Inside roles and texts, `<`, any carets and `|` get one
caret more, so no control string can appear there, and taking one caret away restores the text. A line feed inside a role
is written <|nl|>. The loss mask lists (start, length) in code points of every assistant text in the formatted string.

Defined results: null roles and texts are empty; turns are ordered by turn (nulls first), then role, then text, so ties and
repeated rows give the same string in any run; an empty table gives an empty table; in JSON records a field
that is a list or an object counts as its JSON text; records of an unknown layout come as one row without turn and layout,
also listed by `unknown`, and those without turns as one row without turn; none is dropped. A conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
TURN = "struct<role: string, text: string>"
#: Names of the same role in different layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """name; the field paths of a record; how to read its turns: (role or path of the role, path of the text) pairs over
    an array (`each`) or over single fields."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None


LAYOUTS = (
    Layout("prompt_completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), (("user", "instruction\ninput"), ("assistant", "output"))),
    Layout("question_answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Layout("messages", ("messages[].content", "messages[].role"), (("role", "content"),), "messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (("from", "value"),), "conversations"),
    Layout("dialogue", ("dialogue[].speaker", "dialogue[].text"), (("speaker", "text"),), "dialogue"),
)
#: One row per turn: no record to map, the rows are turns already.
ROWS = ("role", "text", "turn")


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}
KNOWN = {p for x in LAYOUTS for p in x.paths} | set(ROWS)


def paths_of(kind: DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a type, `[]` after an array."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return paths_of(kind.elementType, f"{at}[]") if isinstance(kind, ArrayType) else [at]


def layout_of(kind: StructType) -> Layout | None:
    """The layout of a table: by the fingerprint of the paths any layout knows, else the largest layout they contain (the
    first by name among equals). None if the rows are turns already. Raises for an unknown layout."""
    known = [p for p in paths_of(kind) if p in KNOWN]
    if fingerprint(known) == fingerprint(ROWS):
        return None
    if found := BY_FINGERPRINT.get(fingerprint(known)):
        return found
    if set(ROWS) <= set(known):
        return None
    inside = [x for x in LAYOUTS if set(x.paths) <= set(known)]
    if not inside:
        raise ValueError(f"no layout has the paths {sorted(paths_of(kind))}")
    return min(inside, key=lambda x: (-len(x.paths), x.name))


def _role(role: Column) -> Column:
    renamed = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(renamed, role), role)


def _mapped(layout: Layout, field) -> Column:
    """Turns of a record as an array; field(path, kind) reads one of its fields."""
    if layout.each:
        role, text = layout.turns[0]
        items = field(layout.each, f"array<struct<{role}: string, {text}: string>>")
        return F.transform(items, lambda x: F.struct(_role(x[role]).alias("role"), x[text].alias("text")))
    turns = [F.struct(F.lit(role).alias("role"), _joined([field(p, "string") for p in text.split("\n")]).alias("text")) for role, text in layout.turns]
    return F.array(*turns)


def _joined(fields: list[Column]) -> Column:
    return fields[0] if len(fields) == 1 else F.concat_ws("\n", *[F.when(f != "", f) for f in fields])


def _exploded(records: DataFrame, layout: Column, turns: Column) -> DataFrame:
    rows = records.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "of"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "of.role", "of.text", "layout")


def _chosen(candidates: list[Layout], filled) -> Column:
    """The name of the layout with the most fields filled in a row, the first among equals; null if none has any."""
    best, most = F.lit(None).cast("string"), F.lit(0)
    for layout in candidates:
        n = sum([filled(p).cast("int") for p in layout.paths], F.lit(0))
        best, most = F.when(n > most, F.lit(layout.name)).otherwise(best), F.greatest(n, most)
    return best


def from_table(table: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns and the layout of a table of any known layouts; in a table that holds several, each row has its own."""
    kind = StructType([f for f in table.schema.fields if f.name != conv_id])
    layout = layout_of(kind)
    if layout is None:
        return table.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit("rows").alias("layout"))
    known = set(paths_of(kind))
    candidates = [layout, *sorted((x for x in LAYOUTS if x != layout and set(x.paths) <= known), key=lambda x: (-len(x.paths), x.name))]
    records = table.select(F.col(conv_id).alias("conv_id"), *{p.split("[")[0] for x in candidates for p in x.paths})
    name = F.coalesce(_chosen(candidates, lambda p: F.col(p.split("[")[0]).isNotNull()), F.lit(layout.name))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for x in candidates:
        turns = F.when(F.col("layout") == x.name, _mapped(x, lambda path, kind: F.col(path).cast(kind) if "<" not in kind else F.col(path))).otherwise(turns)
    return _exploded(records.withColumn("layout", name), F.col("layout"), turns)


def shaped(records: DataFrame, json: str = "json") -> DataFrame:
    """(conv_id, record, fingerprint, layout) of JSON records: the hash of those of each one's own field paths that any layout
    knows. What is no JSON has no fingerprint; layout is the name of the one with exactly these paths, else of the largest they
    contain (the first by name among equals), else null. A list of turns is known by its items; an empty one has all their paths."""
    record = F.try_parse_json(F.col(json))
    named = records.select("conv_id", record.alias("record"))
    here = []
    for path in sorted(KNOWN - set(ROWS)):
        top, _, item = path.partition("[].")
        if item:
            items = F.try_variant_get("record", f"$.{top}", "array<variant>")
            inside = (F.size(items) == 0) | F.exists(items, lambda x: F.try_variant_get(x, f"$.{item}", "variant").isNotNull())
            here.append(F.when(inside, F.lit(path)))
        else:
            here.append(F.when(F.try_variant_get("record", f"$.{path}", "variant").isNotNull(), F.lit(path)))
    named = named.withColumn("paths", F.when(F.col("record").isNotNull(), F.array_compact(F.array(*here))))
    named = named.withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    layout = F.lit(None).cast("string")
    for x in sorted(LAYOUTS, key=lambda x: (-len(x.paths), x.name), reverse=True):
        layout = F.when(F.forall(F.array(*map(F.lit, x.paths)), lambda p: F.array_contains("paths", p)), F.lit(x.name)).otherwise(layout)
    for key, x in BY_FINGERPRINT.items():
        layout = F.when(F.col("fingerprint") == key, F.lit(x.name)).otherwise(layout)
    return named.select("conv_id", "record", "fingerprint", layout.alias("layout"))


def _read(records: DataFrame, json: str) -> DataFrame:
    """shaped, with `turns`; layout and turns are null where a record has none or its turns cannot be read."""
    turns = F.lit(None).cast(f"array<{TURN}>")
    for x in LAYOUTS:
        mapped = _mapped(x, lambda path, kind: F.try_variant_get(F.col("record"), f"$.{path}", kind))
        turns = F.when(F.col("layout") == x.name, mapped).otherwise(turns)
    rows = shaped(records, json).withColumn("turns", turns)
    return rows.withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout")))


def from_json(records: DataFrame, json: str = "json") -> DataFrame:
    """Canonical turns and the layout of (conv_id, json) records whose layouts may differ from row to row."""
    return _exploded(_read(records, json), F.col("layout"), F.col("turns"))


def unknown(records: DataFrame, json: str = "json") -> DataFrame:
    """The (conv_id, fingerprint) of JSON records no layout can read; a null fingerprint: no JSON."""
    return _read(records, json).where(F.col("layout").isNull()).select("conv_id", "fingerprint")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\^*)\|", r"<$1^|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\^*)\^\|", r"<$1|")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of canonical turns, formatted null for a conversation with a record no layout can read; loss: array of (start, length) in code points, in order.

    One shuffle, on the conversation: the running offsets and the final string need the same rows together.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(LINE))
    text = escaped(F.coalesce("text", F.lit("")))
    layout = F.col("layout") if "layout" in turns.columns else F.lit("rows")
    unread, turnless = layout.isNull(), layout.isNull() | (layout != "rows") & F.col("turn").isNull()
    rows = turns.select("conv_id", unread.alias("unread"), turnless.alias("turnless"), "turn", F.col("role").alias("r"), F.col("text").alias("t"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("r").asc_nulls_first(), F.col("t").asc_nulls_first())
    size = F.when(F.col("turnless"), 0).otherwise(F.length("head") + F.length("body") + len(END))
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("i"),
        "unread",
        F.when(F.col("turnless"), "").otherwise(F.concat("head", "body", F.lit(END))).alias("piece"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
        F.length("head").alias("skip"),
        F.length("body").alias("length"),
        (F.col("r") == "assistant").alias("learnt"),
    )
    start = (F.coalesce("before", F.lit(0)) + F.col("skip")).cast("int").alias("start")
    span = F.when(F.col("learnt"), F.struct(start, F.col("length").alias("length")))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss"), F.bool_or("unread").alias("unread"))
    return grouped.select("conv_id", F.when(~F.col("unread"), F.array_join("pieces.piece", "")).alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a formatted string."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    head = len(START)

    def turn(piece: Column) -> Column:
        line = F.locate("\n", piece)
        role = F.substring(piece, F.lit(head + 1), line - (head + 1))
        return F.struct(unescaped(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(F.substring(piece, line + 1, F.length(piece))).alias("text"))

    return F.transform(turns, turn)


def under_mask(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substring(formatted, x["start"] + 1, x["length"]))), "")
