"""Strict JSON as VARIANT values: one document or nothing, kinds of values, the tree of nodes in the row, typed reading.

Keys are compared with ASCII case folded. Everything here is SQL text over one row, as the expressions are deep and
their text is parsed in one step.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .text import ASCII_LOWER, ASCII_UPPER

LEVELS = 12  # deeper documents are refused


def fold(key: str) -> str:
    return f"translate({key}, '{ASCII_UPPER}', '{ASCII_LOWER}')"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def entries(v: str) -> str:
    """An object as a map, anything else as null."""
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def items(v: str) -> str:
    """A list as an array, anything else as null."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def is_numeric(v: str) -> str:
    return f"(schema_of_variant({v}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)')"


def is_string(v: str) -> str:
    return f"(schema_of_variant({v}) = 'STRING')"


def number(v: str) -> str:
    return f"try_variant_get({v}, '$', 'double')"


def string(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def boolean(v: str) -> str:
    return f"try_variant_get({v}, '$', 'boolean')"


def folded_keys(v: str) -> str:
    return f"transform(map_keys({entries(v)}), k -> {fold('k')})"


def whole_document(text: str) -> str:
    """The value of a text that is one JSON value and nothing else; otherwise null.

    Spark's parser stops behind the first value, so the text is read as a member of an object whose
    second key, a hash of the text, comes only if the first member has ended where the text does.
    """
    wrapped = f"""try_parse_json(concat('{{"text":', {text}, ',"', sha2({text}, 256), '":0}}'))"""
    return let(entries(wrapped), "m", f"CASE WHEN size(m) = 2 AND map_contains_key(m, sha2({text}, 256)) THEN try_element_at(m, 'text') END")


def kind(v: str) -> str:
    """null, boolean, number, string, object, list; a list of only numbers or only strings is numbers or strings."""
    of_list = (f"CASE WHEN size(a) = 0 THEN 'list' WHEN forall(a, x -> {is_numeric('x')}) THEN 'numbers' "
               f"WHEN forall(a, x -> {is_string('x')}) THEN 'strings' ELSE 'list' END")
    return (f"CASE WHEN is_variant_null({v}) THEN 'null' WHEN {entries(v)} IS NOT NULL THEN 'object' "
            f"WHEN {items(v)} IS NOT NULL THEN {let(items(v), 'a', of_list)} "
            f"WHEN {is_string(v)} THEN 'string' WHEN schema_of_variant({v}) = 'BOOLEAN' THEN 'boolean' ELSE 'number' END")


def node(path: str, pattern: str, v: str) -> str:
    return f"named_struct('path', {path}, 'pattern', {pattern}, 'kind', {kind(v)}, 'v', {v})"


def children(parent: str, maps: tuple[str, ...]) -> str:
    """Nodes of an object's members and of a mixed list's items; below a key in ``maps`` all keys share one pattern."""
    wild = f"substring_index({parent}.pattern, '.', -1) IN ({', '.join(map(repr, maps))})"
    key = fold("e.key")
    member = node(f"concat({parent}.path, '.', {key})", f"concat({parent}.pattern, '.', CASE WHEN {wild} THEN '*' ELSE {key} END)", "e.value")
    item = node(f"concat({parent}.path, '[', i, ']')", f"concat({parent}.pattern, '[*]')", "e")
    return (f"CASE {parent}.kind WHEN 'object' THEN transform(map_entries({entries(parent + '.v')}), e -> {member}) "
            f"WHEN 'list' THEN transform({items(parent + '.v')}, (e, i) -> {item}) END")


def folded_map(v: str, e: str, value: str) -> str:
    """An object as a map of folded keys; null if two keys fold to one."""
    keys = let(folded_keys(v), "k", "size(array_distinct(k)) = size(k)")
    return f"CASE WHEN {keys} THEN map_from_entries(transform(map_entries({entries(v)}), {e} -> struct({fold(e + '.key')}, {value}))) END"


def shaped(v: str, dtype: T.DataType, depth: int = 0) -> str:
    """A value read as a type; a value of another kind is null, a fraction is no integer. Keys are folded."""
    x, e = f"x{depth}", f"e{depth}"
    if isinstance(dtype, T.StructType):
        folded = folded_map(v, e, f"{e}.value")
        fields = ", ".join(f"'{f.name}', {shaped(f'try_element_at({x}, {f.name!r})', f.dataType, depth + 1)}" for f in dtype.fields)
        return let(folded, x, f"CASE WHEN {x} IS NOT NULL THEN named_struct({fields}) END")
    if isinstance(dtype, T.ArrayType):
        return f"transform({items(v)}, {x} -> {shaped(x, dtype.elementType, depth + 1)})"
    if isinstance(dtype, T.MapType):
        return folded_map(v, e, shaped(e + ".value", dtype.valueType, depth + 1))
    if isinstance(dtype, T.StringType):
        return f"CASE WHEN {is_string(v)} THEN {string(v)} END"
    if isinstance(dtype, T.BooleanType):
        return f"CASE WHEN schema_of_variant({v}) = 'BOOLEAN' THEN {boolean(v)} END"
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return f"CASE WHEN {is_numeric(v)} AND {number(v)} = floor({number(v)}) THEN try_variant_get({v}, '$', '{dtype.simpleString()}') END"
    return f"CASE WHEN {is_numeric(v)} THEN {number(v)} END"


# ---- plain texts: most documents, read without walking their tree --------

MARK = "~"
NESTING = LEVELS - 1  # containers inside containers that cannot make a document too deep


def is_plain(text: str) -> str:
    """Whether a text can be read in its marked form: an object without escapes, marks, numbers that may be beyond double,
    capital exponents and deep nesting. Others take the walk over their nodes, which decides alike but slower."""
    odd = rf"\\|{MARK}|[0-9.]E|[eE][+]?[0-9]{{3}}|[0-9]{{39}}"
    left = rf"""regexp_replace({text}, r'"[^"]*"|[^\[\]{{}}"]+', '')"""
    for _ in range(NESTING):
        left = rf"regexp_replace({left}, r'\{{\}}|\[\]', '')"
    return rf"({text} RLIKE r'^\s*\{{' AND NOT {text} RLIKE r'{odd}' AND {left} = '')"


def marked(text: str) -> str:
    """A plain text with a mark before each text value, true and false as texts with the mark in second place, and keys
    folded, so that one cast to a type cannot take a value of one kind for another. Keys that fold to one become equal."""
    kinds = rf"""regexp_replace({text}, r'"([^"]*)"|\b(true|false)\b(?=\s*([,\]}}]))', '"$3{MARK}$1$2"')"""
    keys = rf"""regexp_replace({kinds}, r'"{MARK}([^"]*"\s*:)', '"$1')"""
    capitals = rf"""array_distinct(regexp_extract_all(m, r'"([^"{MARK}]*[A-Z][^"]*)"', 1))"""
    return let(keys, "m", f"""aggregate({capitals}, m, (t, k) -> replace(t, concat('"', k, '"'), concat('"', {fold('k')}, '"')))""")


def raw(dtype: T.DataType) -> str:
    """The type a marked value is cast to; ``unmarked`` reads it."""
    if isinstance(dtype, T.StructType):
        return f"struct<{', '.join(f'{f.name}: {raw(f.dataType)}' for f in dtype.fields)}>"
    if isinstance(dtype, T.ArrayType):
        return f"array<{raw(dtype.elementType)}>"
    if isinstance(dtype, T.MapType):
        return f"map<string, {raw(dtype.valueType)}>"
    return "string" if isinstance(dtype, (T.StringType, T.BooleanType)) else "double"


def unmarked(x: str, dtype: T.DataType, depth: int = 0) -> str:
    """What a marked value of the raw type says in the type itself, as ``shaped`` reads the same value."""
    if raw(dtype) == dtype.simpleString() and "string" not in raw(dtype):  # numbers and arrays of them
        return x
    e = f"u{depth}"
    if isinstance(dtype, T.StructType):
        fields = ", ".join(f"'{f.name}', {unmarked(f'{x}.{f.name}', f.dataType, depth)}" for f in dtype.fields)
        return f"CASE WHEN {x} IS NOT NULL THEN named_struct({fields}) END"
    if isinstance(dtype, T.ArrayType):
        return f"transform({x}, {e} -> {unmarked(e, dtype.elementType, depth + 1)})"
    if isinstance(dtype, T.MapType):
        return x if raw(dtype.valueType) == dtype.valueType.simpleString() and "string" not in raw(dtype.valueType) else (
            f"transform_values({x}, (k{depth}, {e}) -> {unmarked(e, dtype.valueType, depth + 1)})")
    if isinstance(dtype, T.StringType):
        return f"CASE WHEN startswith({x}, '{MARK}') THEN substring({x}, 2) END"
    if isinstance(dtype, T.BooleanType):
        return f"CASE substring({x}, 2) WHEN '{MARK}true' THEN true WHEN '{MARK}false' THEN false END"
    return f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1e18 THEN try_cast({x} AS {dtype.simpleString()}) END"
