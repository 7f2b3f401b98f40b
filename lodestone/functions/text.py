"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

#: Code points in a term of the index.
WIDTH = 3


def trigrams(text: Column) -> Column:
    """Every run of three code points, in order; none for shorter texts and nulls.

    The text is split once, so the cost is linear; ``substr`` at each position isn't.
    """
    n = F.length(text)
    # the array of characters is the variable of a function, so it is made once and not at each place
    at = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - WIDTH), lambda i: F.concat(*[F.get(c, i + k) for k in range(WIDTH)]))
    terms = F.get(F.transform(F.array(F.split(text, "")), at), F.lit(0))
    return F.when(n >= WIDTH, terms).otherwise(F.array().cast("array<string>"))


def identity(*parts: Column) -> Column:
    """A text key that is the same wherever and whenever it is made."""
    return F.md5(F.concat_ws("::", *parts))


def symbol_name(query: Column) -> Column:
    """The name that a symbol query asks for, in upper case."""
    return F.upper(F.when(query.rlike(r"^(?s).*::.*$"), F.regexp_extract(query, r"^(?s)(.*)::(.*)$", 2)).when(query.contains(":"), F.regexp_extract(query, r"^(?s)(.*):(.*)$", 2)).otherwise(query))


def symbol_package(query: Column) -> Column:
    """The package that a symbol query names, in upper case; null if it names none."""
    found = F.when(query.rlike(r"^(?s).*::.*$"), F.regexp_extract(query, r"^(?s)(.*)::(.*)$", 1)).when(query.contains(":"), F.regexp_extract(query, r"^(?s)(.*):(.*)$", 1))
    return F.upper(F.nullif(found, F.lit("")))


def line_at(body: Column, start: Column) -> Column:
    """The line around the code point at ``start``; a line feed there ends the line before it."""
    before = F.substring_index(F.substr(body, F.lit(1), start), "\n", -1)
    return F.concat(before, F.substring_index(F.substr(body, start + 1), "\n", 1))


def relative_path(file: Column, root: Column) -> Column:
    """``file`` without the directory ``root`` and the separator after it; unchanged elsewhere."""
    root = F.coalesce(root, F.lit(""))
    return F.when(F.startswith(file, root), F.substr(file, F.length(root) + 2)).otherwise(file)


def parent(file: Column) -> Column:
    return F.regexp_replace(file, r"/[^/]*$", "")


def base_name(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def index_path(spec: Column, out_dir: Column, extension: str = ".index") -> Column:
    """Where the index of a spec file goes."""
    return F.concat(out_dir, F.lit("/"), without_extension(base_name(spec)), F.lit(extension))


def snake_case(name: Column) -> Column:
    return F.translate(F.lower(name), "-", "_")


def safe_name(system: Column) -> Column:
    """A system's name as a file name."""
    return F.replace(system, F.lit("/"), F.lit("_"))


def project_root(file: Column, root: Column) -> Column:
    """The directory right below ``root`` that holds ``file``; null if it isn't below it."""
    rest = F.substr(file, F.length(root) + 2)
    below = F.startswith(file, F.concat(root, F.lit("/"))) & rest.contains("/")
    return F.when(below, F.concat(root, F.lit("/"), F.substring_index(rest, "/", 1)))


def below(file: Column, name: str) -> Column:
    """Whether a directory of that name is above ``file``."""
    return F.exists(F.split(parent(file), "/"), lambda x: x == name)


def _snaked(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(f.name.lower().replace("-", "_"), _snaked(f.dataType), f.nullable) for f in kind])
    return ArrayType(_snaked(kind.elementType), kind.containsNull) if isinstance(kind, ArrayType) else kind


def json_encoded(value: Column, kind: DataType) -> Column:
    """A struct, or list of them, of the type ``kind`` as JSON, its keys in snake case; nulls are written."""
    return F.to_json(value.cast(_snaked(kind)), {"ignoreNullFields": "false"})


def json_escaped(text: Column) -> Column:
    """A text as JSON writes it between its quotes: control characters and, as pairs of
    surrogates, what lies beyond the basic plane are escaped."""
    quick = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, to in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quick = F.replace(quick, F.lit(raw), F.lit(to))
    rest = F.transform(F.split(quick, ""), _escaped_code)
    return F.when(quick.rlike(r"[\x00-\x1f\x{10000}-\x{10ffff}]"), F.array_join(rest, "")).otherwise(quick)


def _escaped_code(c: Column) -> Column:
    # ascii() is the code point of the first character
    code = F.ascii(c)
    u = lambda x: F.concat(F.lit("\\u"), F.lpad(F.hex(x.cast("int")), 4, "0"))
    high, low = F.floor((code - 0x10000) / 1024) + 0xD800, F.pmod(code - 0x10000, F.lit(1024)) + 0xDC00
    return F.when((c != "") & (code < 32), u(code)).when(code >= 0x10000, F.concat(u(high), u(low))).otherwise(c)
