r"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout is known by the hash of its nested field paths, written as one string
with sorted keys: ``{messages:[{content,role}]}``. Each known fingerprint names
a mapping, a few SQL expressions; JSON rows of many layouts are mapped row by
row, tables by their schema. Turns are then set in a template whose control
strings cannot occur in texts: a backslash after the first character of each
breaks them, and reading back removes just that one. DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Openings of the control strings of common chat templates, after their first character; fixed values.
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
TURNS = "array<struct<role:string,text:string>>"


# --- layouts ---------------------------------------------------------------


def paths_of(kind: T.DataType) -> str:
    """Nested field paths of a type, keys sorted, scalar types left out."""
    if isinstance(kind, T.StructType):
        return "{" + ",".join(sorted(f.name + ("" if not (p := paths_of(f.dataType)) else ":" + p) for f in kind)) + "}"
    if isinstance(kind, T.ArrayType):
        return "[" + paths_of(kind.elementType) + "]"
    return ""


def fingerprint(paths: str) -> str:
    return hashlib.sha256(paths.encode()).hexdigest()[:16]


def json_paths(col: Column) -> Column:
    """The same string for a JSON text, from the schema of its variant (whose keys are sorted)."""
    s = F.schema_of_variant(F.try_parse_json(col))
    s = F.regexp_replace(s, r": (?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9,]*\))?", "")
    s = F.regexp_replace(F.regexp_replace(s, "OBJECT<", "{"), "ARRAY<(?:[A-Z]+(?:\\([0-9,]*\\))?>)?", "[")
    return F.regexp_replace(s, " ", "")


#: Layout (field paths as above) to the SQL expression of its turns, over a variant ``v``; null parts drop out.
MAPPINGS: dict[str, tuple[str, ...]] = {
    "messages": ("{messages:[{content,role}]}", "transform(try_variant_get(v, '$.messages', 'array<struct<role:string,content:string>>'), m -> struct(m.role as role, m.content as text))"),
    "sharegpt": ("{conversations:[{from,value}]}", "transform(try_variant_get(v, '$.conversations', 'array<struct<from:string,value:string>>'), m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end as role, m.value as text))"),
    "prompt": ("{completion,prompt}", "array(struct('user' as role, try_variant_get(v, '$.prompt', 'string') as text), struct('assistant' as role, try_variant_get(v, '$.completion', 'string') as text))"),
    "response": ("{prompt,response}", "array(struct('user' as role, try_variant_get(v, '$.prompt', 'string') as text), struct('assistant' as role, try_variant_get(v, '$.response', 'string') as text))"),
    "instruction": ("{input,instruction,output}", "array(struct('user' as role, concat_ws('\\n', try_variant_get(v, '$.instruction', 'string'), nullif(try_variant_get(v, '$.input', 'string'), '')) as text), struct('assistant' as role, try_variant_get(v, '$.output', 'string') as text))"),
    "instruction_only": ("{instruction,output}", "array(struct('user' as role, try_variant_get(v, '$.instruction', 'string') as text), struct('assistant' as role, try_variant_get(v, '$.output', 'string') as text))"),
}
#: What a row needs for a mapping, other keys aside: an expression over ``v``, null or false where it is not there.
_LIST = "exists(try_variant_get(v, '$.{0}', 'array<struct<{1}:variant,{2}:variant>>'), m -> m.{1} is not null) and exists(try_variant_get(v, '$.{0}', 'array<struct<{1}:variant,{2}:variant>>'), m -> m.{2} is not null) and not exists(try_variant_get(v, '$.{0}', 'array<struct<{2}:variant>>'), m -> schema_of_variant(m.{2}) rlike '^(ARRAY|OBJECT)<')"
_KEYS = " and ".join
_KEY = "coalesce(schema_of_variant(try_variant_get(v, '$.{0}', 'variant')) not rlike '^(ARRAY|OBJECT)<', false)"
NEEDED: dict[str, str] = {
    "messages": _LIST.format("messages", "role", "content"), "sharegpt": _LIST.format("conversations", "`from`", "value"),
    **{name: _KEYS(_KEY.format(k) for k in keys) for name, keys in {"prompt": ("prompt", "completion"), "response": ("prompt", "response"), "instruction": ("instruction", "input", "output"), "instruction_only": ("instruction", "output")}.items()},
}
#: A system text beside the turns comes first.
_SYSTEM = "filter(array(struct('system' as role, try_variant_get(v, '$.system', 'string') as text)), t -> t.text <> '')"
#: Layout of a table with a row per turn.
TURN_ROWS = "{conv_id,role,text,turn}"


def _closed(paths: str) -> str:
    """The string as json_paths gives it: every closing bracket as '>'."""
    return paths.replace("}", ">").replace("]", ">")


def _mapped(name: str) -> Column:
    """Turns of a row ``v`` by a mapping, after its system text."""
    return F.concat(F.coalesce(F.expr(_SYSTEM).cast(TURNS), F.array().cast(TURNS)), F.expr(MAPPINGS[name][1]).cast(TURNS))


def from_json_rows(df: DataFrame, col: str = "json", id_col: str = "conv_id") -> DataFrame:
    """conv_id, fingerprint, layout, turns for each row of JSON text.

    A known fingerprint selects its mapping; else the first mapping whose
    required paths are there, whatever other keys the row has. A row for which
    there is none, or that is null or no JSON, keeps its fingerprint (null where
    it has none), with layout and turns null.
    """
    paths = json_paths(F.col(col))
    at = df.select(F.col(id_col).alias("conv_id"), F.try_parse_json(col).alias("v"), F.substring(F.sha2(paths, 256), 1, 16).alias("fingerprint"))
    marks = [(F.col("fingerprint") == fingerprint(_closed(known)), name) for name, (known, _) in MAPPINGS.items()] + [(F.expr(need), name) for name, need in NEEDED.items()]
    layout = F.coalesce(*(F.when(mark, F.lit(name)) for mark, name in marks))
    at = at.withColumn("layout", layout)
    turns = F.coalesce(*(F.when(F.col("layout") == name, _mapped(name)) for name in MAPPINGS))
    return at.select("conv_id", "fingerprint", "layout", turns.alias("turns"))


def _turn_rows(df: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _whole_rows(name: str, known: tuple[str, ...]):
    """A reader of tables with a conversation in a row, by the mapping of that layout."""
    def read(df: DataFrame) -> DataFrame:
        fields = [c for c in (*known, "system") if c in df.columns]
        return df.select("conv_id", F.to_variant_object(F.struct(*fields)).alias("v")).select("conv_id", _mapped(name).alias("turns"))

    return read


#: Fingerprint of a table's columns to the columns and the reader; the columns are what the layout needs.
TABLES = {fingerprint(TURN_ROWS): (("conv_id", "role", "text", "turn"), {}, _turn_rows)} | {
    fingerprint("{" + ",".join(sorted(["conv_id", *inner])) + "}"): (("conv_id", *keys), leaf, _whole_rows(name, keys))
    for name, keys, inner, leaf in (
        ("messages", ("messages",), ("messages:[{content,role}]",), {"messages": ("content", "role")}), ("sharegpt", ("conversations",), ("conversations:[{from,value}]",), {"conversations": ("from", "value")}),
        ("prompt", ("prompt", "completion"), ("prompt", "completion"), {}), ("response", ("prompt", "response"), ("prompt", "response"), {}),
        ("instruction", ("instruction", "input", "output"), ("instruction", "input", "output"), {}), ("instruction_only", ("instruction", "output"), ("instruction", "output"), {}),
    )
}


def _needed(schema: T.StructType, columns: tuple[str, ...], leaf: dict[str, tuple[str, ...]]) -> T.StructType:
    """The part of a schema that a layout speaks of: its columns, and in lists of structs its fields."""
    out = []
    for f in schema:
        if f.name in columns:
            kind = f.dataType
            if f.name in leaf and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                kind = T.ArrayType(T.StructType([x for x in kind.elementType if x.name in leaf[f.name]]))
            out.append(T.StructField(f.name, kind))
    return T.StructType(out)


def from_table(df: DataFrame) -> DataFrame:
    """conv_id and turns of a table: the fingerprint of the columns that a layout speaks of selects an entry of TABLES.

    Extra columns play no part (but for a system text beside a whole
    conversation). Rows by turn are put in the order of turn, role, text, so
    that ties and repeated rows have one order; nulls first. Rows with a null
    conv_id are one conversation.
    """
    for mark, (columns, leaf, read) in TABLES.items():
        if fingerprint(paths_of(_needed(df.schema, columns, leaf))) == mark:
            return read(df)
    raise ValueError(f"no mapping for the layout {paths_of(df.schema)}")


# --- template --------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # Pairs of backslashes part the text; what is left of a backslash stands before an n.
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_chat(turns: Column) -> Column:
    """One string: for each turn START role LF text END LF, with roles and texts escaped."""
    one = lambda t: F.concat(F.lit(START), _escape_role(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), escape(F.coalesce(t["text"], F.lit(""))), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def read_back(formatted: Column) -> Column:
    """Turns from the formatted string alone: role, text, and loss (the text is trained on)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, "\n")
        role = _unescape_role(F.substring(p, F.lit(1), at - 1))
        text = unescape(F.substring(p, at + 1, F.length(p) - at - len(END) - 1))
        return F.struct(role.alias("role"), text.alias("text"), (role == "assistant").alias("loss"))

    return F.transform(pieces, turn)
