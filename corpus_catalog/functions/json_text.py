"""JSON string literals in the ASCII form that content digests are taken over."""

from pyspark.sql import Column, functions as F

# Escapes with a short form.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escaped(char: Column) -> Column:
    units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
    escaped = F.regexp_replace(units, r"(.{4})", r"\\u$1")
    result = F.when(char.rlike(r"\A[ -~]\z"), char).otherwise(escaped)
    for plain, short in _SHORT.items():
        result = F.when(char == plain, F.lit(short)).otherwise(result)
    return result


def json_string(text: Column) -> Column:
    """Quoted literal; characters outside printable ASCII become ``\\uXXXX``."""
    plain = text.rlike(r"\A[ !#-\[\]-~]*\z")
    escaped = F.array_join(F.transform(F.split(text, ""), _escaped), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))
