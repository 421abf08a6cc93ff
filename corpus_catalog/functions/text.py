"""Expressions over paths and file contents.

Java's character classes are ASCII by default, so whitespace and word
characters are spelled out to cover the same code points as Unicode-aware
matching of text.  ``(?d)`` makes ``\\n`` the only line end for ``.``, ``^`` and ``$``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from corpus_catalog import config as C

# Code points that count as whitespace / line ends in text.
SPACE = (
    r"[\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Line ends other than \n.
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_END = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}])"
WORD = r"[\p{L}\p{N}_]"

# The look-ahead at the first letters lets most positions fail at once.
SECRET_WORD = rf"(?iu)(?=[tspabc])(?<!{WORD})(?:{C.SECRET_WORDS})(?!{WORD})"
QUOTED = r""""[^"\n]*"|'[^'\n]*'"""

JS_EXPORT = (
    rf"export{SPACE}+(?:default{SPACE}+)?"
    rf"(?:function|class|const|let|var){SPACE}+({WORD}+)"
)
JS_IMPORT = rf"""(?d)import{SPACE}+.*?from{SPACE}+["']([^"']+)["']"""
MD_TITLE = rf"(?md)^#{SPACE}+(.+)$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def strip(col: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.regexp_replace(col, rf"\A{SPACE}+|{SPACE}+\z", "")


# --- paths ----------------------------------------------------------------


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for ``.env`` and ``a.``."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def parent_dir(path: Column) -> Column:
    """Directory part of a path, empty at the top."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(file_name(path)) - 1)


def ancestor_dirs(path: Column) -> Column:
    """Every directory above the file, outermost first."""
    parts = F.split(path, "/")
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda _, i: F.call_function("substring_index", path, F.lit("/"), i + 1),
    )


def is_priority_name(path: Column) -> Column:
    pattern = "|".join(f"(?:{p})" for p in C.PRIORITY_NAMES)
    return file_name(path).rlike(f"(?iud){pattern}")


def order_key(path: Column) -> Column:
    """Sort key that orders paths component by component.

    NUL cannot occur in a path and sorts before every other character.
    """
    return F.replace(path, F.lit("/"), F.lit("\0"))


# --- bytes ----------------------------------------------------------------


def source_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, C.BINARY_WINDOW_BYTES), F.unhex(F.lit("00")))


def has_private_key(content: Column, strict_keys: bool = False) -> Column:
    """Private-key block header anywhere in the bytes.

    The default misses a bare ``BEGIN PRIVATE KEY`` header; ``strict_keys``
    adds it.
    """
    headers = C.PRIVATE_KEY_HEADERS + ([C.PLAIN_PRIVATE_KEY_HEADER] if strict_keys else [])
    text = content.cast("string")
    # A plain search settles nearly all files.
    return text.contains("-----BEGIN ") & text.rlike("|".join(headers))


def decode(content: Column) -> Column:
    """UTF-8 text; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def is_lossy(content: Column) -> Column:
    return ~F.is_valid_utf8(content.cast("string"))


# --- text -----------------------------------------------------------------


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def redact_line(line: Column) -> Column:
    return F.when(
        line.rlike(SECRET_WORD), F.regexp_replace(line, QUOTED, C.REDACTED_LITERAL)
    ).otherwise(line)


def redact(text: Column) -> Column:
    """Replace quoted literals on lines that hold a secret-like word.

    Texts without any such word, nearly all of them, are not split.
    """
    redacted = F.array_join(F.transform(lines(text), redact_line), "\n")
    return F.when(text.rlike(SECRET_WORD), redacted).otherwise(text)


def redaction_count(text: Column) -> Column:
    """Number of lines that redaction changes."""
    changed = F.size(F.filter(lines(text), lambda line: redact_line(line) != line))
    return F.when(text.rlike(SECRET_WORD), changed).otherwise(F.lit(0))


def line_count(text: Column) -> Column:
    """Number of lines, for all the line ends of text files."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    plain = newlines + ((text != "") & ~text.endswith("\n")).cast("int")
    unfinished = (text != "") & ~F.right(text, F.lit(1)).rlike(LINE_END)
    any_end = F.regexp_count(text, F.lit(LINE_END)) + unfinished.cast("int")
    return F.when(any_of([text.contains(c) for c in OTHER_LINE_ENDS]), any_end).otherwise(plain)


def markdown_title(text: Column) -> Column:
    """First level-one heading, null if there is none."""
    return F.nullif(F.regexp_extract(text, MD_TITLE, 1), F.lit(""))


def js_exports(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JS_EXPORT), F.lit(1))


def js_imports(text: Column) -> Column:
    """Package part of each import, in order, duplicates kept."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(JS_IMPORT), F.lit(1)),
        lambda module: F.substring_index(module, "/", 1),
    )


def role(path: Column, text: Column) -> Column:
    """Role from the name, the relative path and the text; first rule wins."""
    name = F.lower(file_name(path))
    rooted = F.concat(F.lit("/"), path)
    return (
        F.when(
            name.startswith("test_")
            | name.endswith("_test.py")
            | rooted.contains("/tests/")
            | rooted.contains("/test/"),
            "test",
        )
        .when(any_of([name.contains(p) for p in C.CONFIG_NAME_PARTS]), "config")
        .when(any_of([name.contains(p) for p in C.DOCS_NAME_PARTS]), "docs")
        .when(text.contains("if __name__") | name.isin(C.ENTRYPOINT_NAMES), "entrypoint")
        .when(any_of([name.endswith(s) for s in C.LIBRARY_SUFFIXES]), "library")
        .otherwise("unknown")
    )


def clip(text: Column, limit: int = C.MAX_SUMMARY_CHARS) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))
    ).otherwise(text)


def cell(text: Column, limit: int = C.TABLE_CELL_CHARS) -> Column:
    """Start of a summary, for one table cell."""
    return F.concat(
        F.left(text, F.lit(limit)), F.when(F.length(text) > limit, "...").otherwise("")
    )


def head_list(items: Column, n: int) -> Column:
    return F.array_join(F.slice(items, 1, n), ", ")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _quoted_length(text: Column) -> Column:
    """Characters of a string written as a Python literal."""
    # Fixed rule: backslash, newline, return and tab take one more, other unprintable
    # characters an escape by number; single quotes are escaped only beside double ones.
    unprintable = r"[\p{C}\p{Z}&&[^ \n\r\t]&&[%s]]"
    quotes = F.when(text.contains("'") & text.contains('"'), _count(text, "'")).otherwise(0)
    return (
        F.length(text) + 2 + quotes + _count(text, r"[\\\n\r\t]")
        + 3 * _count(text, unprintable % r"\x{0}-\x{FF}")
        + 5 * _count(text, unprintable % r"\x{100}-\x{FFFF}")
        + 9 * _count(text, unprintable % r"\x{10000}-\x{10FFFF}")
    )


def display_length(value: Column, kind: T.DataType) -> Column:
    """Characters of a value written as Python writes it: structs as dicts, null as None."""
    if isinstance(kind, T.StringType):
        size = _quoted_length(value)
    elif isinstance(kind, T.BooleanType):
        size = F.when(value, 4).otherwise(5)
    elif isinstance(kind, T.ArrayType):
        items = F.aggregate(
            F.transform(value, lambda x: display_length(x, kind.elementType)), F.lit(0), lambda a, n: a + n
        )
        size = 2 + items + 2 * F.greatest(F.size(value) - 1, F.lit(0))
    elif isinstance(kind, T.StructType):
        fields = [len(f.name) + 4 + display_length(value[f.name], f.dataType) for f in kind.fields]
        size = sum(fields, F.lit(2 * len(fields)))
    else:
        size = F.length(value.cast("string"))
    return F.when(value.isNull(), 4).otherwise(size)


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / C.CHARS_PER_TOKEN).cast("bigint")
