"""Chat formatting of heterogeneous layouts by schema fingerprints.

A layout is known by the fingerprint of its nested field paths: a SHA-256 over the sorted paths that chat data use, array
levels marked ``[]``. The fingerprint selects a declarative mapping to canonical turns, an array of ``(role, text)``.
For JSON rows the paths are looked up in every row, so one table may mix layouts.

The template marks a turn as ``### Role: text</turn>`` and a line feed. Inside roles and texts the escape character and the
control strings are written as ``\\\\b`` (backslash), ``\\\\h`` (``###``), ``\\\\t`` (``</turn>``) and, in roles, ``\\\\c`` (colon),
so a marker in the output always is a marker and reading back is exact.

Everything is built from column functions. Null texts and roles are empty; turns that tie keep the order of role and
text, repeated rows are repeated turns, an empty table gives no conversations; rows with a null conversation id form one
conversation. Other columns are passed over. A conversation is one output row, so its turns meet in one task by contract.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"
KNOWN_ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
MARK, END = "### ", "</turn>\n"
#: Control string and what stands for it, in the order of escaping.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _listed(column: str, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    def turn(x: Column) -> Column:
        said = F.coalesce(x[role].cast("string"), F.lit(""))
        for known, canonical in (names or {}).items():
            said = F.when(said == known, canonical).otherwise(said)
        return F.struct(said.alias("role"), F.coalesce(x[text].cast("string"), F.lit("")).alias("text"))

    return F.transform(F.coalesce(F.col(column), F.array()), turn)


def _asked(*parts: tuple[str, str]) -> Column:
    return F.array(*[_turn(role, F.col(name)) for role, name in parts])


def _instruction() -> Column:
    extra = F.coalesce(F.col("input").cast("string"), F.lit(""))
    asked = F.concat(F.coalesce(F.col("instruction").cast("string"), F.lit("")), F.when(extra != "", F.concat(F.lit("\n"), extra)).otherwise(""))
    return F.array(_turn("user", asked), _turn("assistant", F.col("output")))


#: Paths of a layout, and its mapping to turns.
LAYOUTS = {
    "turn_rows": (("turn", "role", "text"), None),
    "messages": (("messages[].role", "messages[].content"), lambda: _listed("messages", "role", "content")),
    "shared": (("conversations[].from", "conversations[].value"), lambda: _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    "instruction_input": (("instruction", "input", "output"), _instruction),
    "instruction": (("instruction", "output"), lambda: _asked(("user", "instruction"), ("assistant", "output"))),
    "prompt_completion": (("prompt", "completion"), lambda: _asked(("user", "prompt"), ("assistant", "completion"))),
    "prompt_response": (("prompt", "response"), lambda: _asked(("user", "prompt"), ("assistant", "response"))),
    "system_prompt_response": (("system", "prompt", "response"), lambda: _asked(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question_answer": (("question", "answer"), lambda: _asked(("user", "question"), ("assistant", "answer"))),
}
PATHS = frozenset(path for paths, _ in LAYOUTS.values() for path in paths)


def fingerprint(paths) -> str:
    """SHA-256 of the sorted nested field paths that any layout uses; others do not matter."""
    return hashlib.sha256("\n".join(sorted(PATHS.intersection(paths))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def nested_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """All field paths of a schema, with ``[]`` for array levels."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in nested_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return nested_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def canonical_turns(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``id_column`` and ``turns`` of a table in any known layout; turn rows are gathered by conversation."""
    paths = nested_paths(df.schema)
    layout = BY_FINGERPRINT.get(fingerprint(paths))
    if layout is None:  # a column of another meaning may have a layout's name: take the largest layout that is there whole
        layout = max((n for n, (own, _) in LAYOUTS.items() if set(own) <= set(paths)), key=lambda n: (len(LAYOUTS[n][0]), n), default=None)
    if layout is None:
        raise ValueError(f"no mapping for the fields {sorted(PATHS.intersection(paths))} of {sorted(paths)}")
    if layout == "turn_rows":
        return gather_turns(df.select(df[id_column], "turn", "role", "text"), id_column)
    return df.select(df[id_column], LAYOUTS[layout][1]().cast(TURN).alias("turns"))


def gather_turns(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gathered = df.groupBy(id_column).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return gathered.select(id_column, F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


_JSON = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,`value`:string>>, "
    "instruction string, input string, output string, prompt string, completion string, response string, system string, question string, answer string"
)


def canonical_turns_json(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """Turns of JSON rows that may each have another layout; ``layout`` names it, null turns where none is known."""
    parsed = df.select(df[id_column].alias("_id"), F.from_json(df[json_column].cast("string"), _JSON).alias("_j")).select("_id", "_j.*")
    present = []
    for path in sorted(p for p in PATHS if p not in ("turn", "role", "text")):
        head, _, leaf = path.partition("[].")
        present.append(F.when(_holds(head, leaf) if leaf else F.col(head).isNotNull(), F.lit(path)))
    print_ = F.sha2(F.concat_ws("\n", *present), 256)
    turns, name = F.lit(None).cast(TURN), F.lit(None).cast("string")
    for known, layout in BY_FINGERPRINT.items():
        if LAYOUTS[layout][1] is not None:
            turns = F.when(F.col("_print") == known, LAYOUTS[layout][1]().cast(TURN)).otherwise(turns)
            name = F.when(F.col("_print") == known, layout).otherwise(name)
    return parsed.withColumn("_print", print_).select(F.col("_id").alias(id_column), name.alias("layout"), turns.alias("turns"))


def _holds(array: str, leaf: str) -> Column:
    return F.exists(array, lambda x: x[leaf].isNotNull())


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _header(role: Column) -> Column:
    shown = F.concat(F.lit("@"), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    for name, title in KNOWN_ROLES.items():
        shown = F.when(role == name, title).otherwise(shown)
    return F.concat(F.lit(MARK), shown, F.lit(": "))


def _role(shown: Column) -> Column:
    role = unescape(F.replace(F.substring(shown, 2, 1 << 30), F.lit("\\c"), F.lit(":")))
    for name, title in KNOWN_ROLES.items():
        role = F.when(shown == title, name).otherwise(role)
    return role


def format_turns(df: DataFrame, id_column: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """``formatted``, the conversation's string, and ``segments``: its pieces in order, marked where the loss applies."""
    def pieces(turn: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        none = F.lit(False)
        return F.array(piece(_header(turn["role"]), none), piece(escape(turn["text"]), turn["role"] == loss_role), piece(F.lit(END), none))

    cut = df.select(id_column, F.flatten(F.transform("turns", pieces)).alias("segments"))
    return cut.select(id_column, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    marked = F.filter(F.split(formatted, "</turn>\n", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        colon = F.instr(x, ": ")
        return F.struct(_role(F.substr(x, F.lit(len(MARK) + 1), colon - F.lit(len(MARK) + 1))).alias("role"), unescape(F.substr(x, colon + F.lit(2))).alias("text"))

    return F.transform(marked, turn)


def loss_text(segments: Column) -> Column:
    """Unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Counts and digests of turns and loss text, read back from the formatted strings."""
    back = formatted.select(id_column, "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        id_column,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
