"""Row identity of a triple."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(c: Column) -> Column:
    """A string as a JSON literal; null is null. Control characters are escaped with lower-case digits."""
    text = F.to_json(F.struct(c.alias("v")))
    literal = F.substr(text, F.lit(6), F.length(text) - 6)
    # The escapes of control characters, whose hexadecimal digits are lower case.
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        literal = F.replace(literal, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.when(c.isNull(), F.lit("null")).otherwise(literal)


def triplet_id(sentence: Column, subject: Column, predicate: Column, object_: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of the four fields as a JSON object with sorted keys."""
    fields = (("object", object_), ("predicate", predicate), ("sentence", sentence), ("subject", subject))
    parts: list[Column] = []
    for name, c in fields:
        parts += [F.lit(("{" if not parts else ", ") + f'"{name}": '), json_string(c)]
    return F.substring(F.sha1(F.encode(F.concat(*parts, F.lit("}")), "UTF-8")), 1, 16)
