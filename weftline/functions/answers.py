"""Reading multiple-choice answers."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import stripped

# The patterns that are tried in order; the first that matches decides.
PATTERNS = (r"^([A-Z])\b", r"(?:answer[:\s]+)([A-Z])\b", r"(?:is\s+)([A-Z])\b", r"^\s*\**([A-Z])\**\s*$")


def strict_letter(answer: Column, candidates: Column | int) -> Column:
    """The letter that the first matching pattern gives, or null if it is not one of the candidates' letters."""
    n = F.lit(candidates) if isinstance(candidates, int) else candidates
    text = stripped(F.coalesce(answer, F.lit("")))
    # Each pattern gives one letter or nothing, so the first letter of all together is that of the first match. Nothing is written twice, as Spark would evaluate it twice.
    found = F.upper(F.substring(F.concat(*[F.regexp_extract(text, f"(?iU){p}", 1) for p in PATTERNS]), 1, 1))
    letters = F.array(F.lit(None).cast("string"), *[F.lit(x) for x in string.ascii_uppercase])
    return F.try_element_at(F.slice(letters, F.lit(1), F.greatest(n, F.lit(0)) + 1), F.greatest(F.ascii(found) - 64, F.lit(0)) + 1)


def strict_place(answer: str, candidates: int) -> int | None:
    """`strict_letter` of one text, as the place of the candidate from 0."""
    hits = (m for m in (re.search(p, answer.strip(), re.IGNORECASE) for p in PATTERNS) if m)
    letter = next((m[1].upper() for m in hits), "-")
    place = string.ascii_uppercase[:candidates].find(letter)
    return place if place >= 0 else None


def loose_letter(answer: Column, candidates: Column | int) -> Column:
    """The first candidate letter that occurs anywhere in the answer. It picks A from "F. None of the above"; offered for parity."""
    n = F.lit(candidates) if isinstance(candidates, int) else candidates
    letters = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.char(i + 65))
    return F.when(n > 0, F.try_element_at(F.filter(letters, lambda x: F.contains(F.upper(F.coalesce(answer, F.lit(""))), x)), F.lit(1)))


def letter_choice(letter: Column, relations: Column) -> Column:
    """The relation of a letter; null without one."""
    return F.when(letter.isNotNull(), F.try_element_at(relations, (F.ascii(letter) - 64).cast("int")))


def canonical_predicate(chosen: Column, predicate: Column) -> Column:
    return F.coalesce(F.nullif(chosen, F.lit("")), predicate)
