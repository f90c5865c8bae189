"""Functions on values, which are canonical JSON strings, and on names and locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZEROES = ('{"Int":0}', '"Null"')
#: Kinds of values that name a place which can be tracked.
PLACES = r'^\{"(Arg|Sym|Glob|Alloc|AllocOf)":'
CONSTANTS = r'^(\{"(ConstSym|Int|Func)":|"(Null|Asm|FuncPtr)")'


def is_zero(v: Column) -> Column:
    return v.isin(*ZEROES)


def number_of(v: Column) -> Column:
    """The number a constant stands for; the null pointer is 0, what is no number is null."""
    return F.when(v == '"Null"', F.lit(0).cast("long")).otherwise(F.regexp_extract(v, r'^\{"Int":(-?\d+)\}$', 1).try_cast("long"))


def inner(v: Column) -> Column:
    """What an AllocOf holds, or null."""
    return F.when(v.startswith('{"AllocOf":'), F.substr(v, F.lit(len('{"AllocOf":') + 1), F.length(v) - F.lit(len('{"AllocOf":') + 1)))


def candidates(v: Column, depth: int) -> Column:
    """The value and what it unwraps to, up to ``depth`` values."""
    found = [v]
    for _ in range(depth - 1):
        found.append(inner(found[-1]))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def base_of(v: Column, depth: int = 3) -> Column:
    """The root of a chain of GEPs."""
    for _ in range(depth):
        v = F.when(v.startswith('{"GEP":'), F.get_json_object(v, "$.GEP.loc")).otherwise(v)
    return v


def kind_of(v: Column) -> Column:
    """Glob, Arg, Const, Alloc or Other."""
    b = base_of(v)
    return F.when(b.startswith('{"Glob":'), "Glob").when(b.startswith('{"Arg":'), "Arg").when(b.rlike(CONSTANTS), "Const").when(b.rlike(r'^\{"Alloc(Of)?":'), "Alloc").otherwise("Other")


def simple_name(name: Column) -> Column:
    """A function's name up to the first dot; of an intrinsic llvm.X.Y it is X."""
    return F.when(name.startswith("llvm."), F.get(F.split(name, "[.]"), F.lit(1))).otherwise(F.substring_index(name, ".", 1))


def signature(ret: Column, name: Column, kinds: Column) -> Column:
    return F.concat(ret, F.lit(" "), name, F.lit("("), F.array_join(kinds, ", "), F.lit(")"))


def location(loc: Column) -> Column:
    """A struct path, line, col of "path:line:col"."""
    parts = F.split(loc, ":")
    return F.struct(F.get(parts, F.lit(0)).alias("path"), F.get(parts, F.lit(1)).try_cast("int").alias("line"), F.get(parts, F.lit(2)).try_cast("int").alias("col"))


def context(loc: Column) -> Column:
    """A location without its last two parts."""
    return F.substring_index(loc, ":", 1)


def prefix_match(col: Column, pattern: str) -> Column:
    """A match anchored at the start, unlike rlike."""
    return col.rlike(f"^(?:{pattern})")


def encode_bool(b: Column) -> Column:
    return F.coalesce(b.cast("int"), F.lit(-1))


def gaussian(distance2: Column, bandwidth: float) -> Column:
    """The kernel with the one-dimensional normaliser."""
    return F.exp(-distance2 / (2 * bandwidth**2)) / (bandwidth * F.sqrt(2 * F.pi()))


def distance2(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def _path(field: str) -> str:
    return "$" + "".join(f"['{x}']" for x in field.split("."))


def field(doc: Column, name: str) -> Column:
    """What a feature document (JSON text) holds under a dot-separated name, as text; null if it isn't there."""
    return F.get_json_object(doc, _path(name))


def has_field(doc: Column, name: str) -> Column:
    """Whether it is there, even if it is null."""
    above, _, last = name.rpartition(".")
    return F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(doc, _path(above)) if above else doc), last), F.lit(False))


def grouped(doc: Column, names: list[str]) -> Column:
    """A map from each name to the part of the document under it."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[field(doc, n) for n in names]))


def symbols(value: Column) -> Column:
    """The symbols and call ids that a value uses, at any depth; texts of names and strings are not searched."""
    bare = F.regexp_replace(value, r'("(?:Glob|Func|name)":)"(?:[^"\\]|\\.)*"', "$1null")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r'("Sym":\d+|"id":\d+)'), F.lit(1)))
