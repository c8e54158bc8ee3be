"""Text expressions: prompts, blocks, normal forms and scores. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the prompts, as formats with named places.
MAPPING_PROMPT = """You are an expert in ontology relation mapping.

Your goal is to map the extracted triplet to one ontology relation among the candidate relations.

Triplet:
- Subject: {subject}
- Predicate: {predicate}
- Object: {object}

Source sentence:
{sentence}

Candidate ontology relations:
{block}

Instructions:
- Choose the single best ontology relation among the candidates.
- Use the relation definition and the source sentence to understand the meaning.
- If none of the candidate relations fit well, return: not_mapped
- Return only the relation name or not_mapped
- Do not explain your answer.

Answer:"""
DEFINITION_PROMPT = """Given a piece of text and a relational triplet extracted from it, write a concise one-sentence definition for the relation (predicate) used in the triplet.

The definition must describe the *semantic role* of the relation{context}, not just paraphrase the sentence.

Text: {sentence}
Triplet: ['{subject}', '{predicate}', '{object}']

Write only the definition, nothing else."""
IN_CONTEXT = " in THIS specific context"
CHOICE_PROMPT = """Given a piece of text, a relational triplet extracted from it, and the definition of its predicate, choose the most appropriate canonical relation from the choices below to replace the predicate in this context.

Text: {sentence}
Triplet: ['{subject}', '{predicate}', '{object}']
Definition of '{predicate}': {definition}

Choices:
{choices}

Rules:
- Answer with ONLY the letter of the best match (e.g. A).
- Choose '{none}' if no candidate is semantically equivalent in this context; do NOT over-generalise.
- Do not explain."""
LABEL_PROMPT = """You are a knowledge graph expert. Below is a group of semantically related relation predicates extracted from biomedical text, along with their definitions.

Your task: choose ONE single canonical relation label that best represents ALL members of this group. Prefer concise snake_case labels (e.g. 'has_finding', 'location_of', 'associated_with').

Members:
{members}

Rules:
- Output ONLY the canonical label, nothing else.
- The label must be a single relation phrase (no spaces, use underscores).
- Do not invent a completely new concept; prefer the most representative   member if it is already clean."""
ALREADY_CANONICAL = "(already canonical — LLM not called)"

SPACE = r"(?U)\s"


def filled(template: str, **places: Column) -> Column:
    """A format with its {places} taken from columns; a null place is empty."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(places[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def stripped(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def display_name(relation: Column) -> Column:
    return F.replace(relation, F.lit("_"), F.lit(" "))


def triple_text(subject: Column, predicate: Column, object_: Column) -> Column:
    """The three fields with spaces between; a null reads None, as in a formatted string."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("None")) for c in (subject, predicate, object_)])


def pair_text(triplets: Column, most: int) -> Column:
    """`(s, o), (s, o)` of the first pairs."""
    return F.array_join(F.transform(F.slice(F.coalesce(triplets, F.array()), 1, most), lambda t: F.concat(F.lit("("), F.coalesce(t["s"], F.lit("")), F.lit(", "), F.coalesce(t["o"], F.lit("")), F.lit(")"))), ", ")


def enriched_definition(relation: Column, definition: Column, triplets: Column, most: int = 30) -> Column:
    return F.concat(F.lit("Relation name: "), relation, F.lit(". Definition: "), F.coalesce(definition, F.lit("")), F.lit(". Possible type pairs: "), pair_text(triplets, most), F.lit("."))


def plain_number(c: Column) -> Column:
    """A score of four places without an exponent."""
    return F.when((F.abs(c) < 0.001) & (c != 0), F.regexp_replace(c.cast("decimal(10,4)").cast("string"), "0+$", "")).otherwise(c.cast("string"))


def candidate_block(candidates: Column, pairs: int = 15, definition_chars: int | None = None) -> Column:
    """Numbered blocks of array<struct<relation, def, triplets, score>>; long form by default, pairs=5 and definition_chars=150 give the short one."""

    def block(c: Column, i: Column) -> Column:
        d = F.coalesce(c["def"], F.lit(""))
        if definition_chars:
            d = F.substring(d, 1, definition_chars)
        parts = (("{}. Relation: {}\n", (i + 1).cast("string"), c["relation"]), ("Definition: {}\n", d), ("Possible type pairs: {}\n", pair_text(c["triplets"], pairs)), ("Retrieval score: {}\n", plain_number(c["score"])))
        return F.concat(*[filled(p[0].replace("{}", "{a}", 1).replace("{}", "{b}", 1), **dict(zip("ab", p[1:], strict=False))) for p in parts])

    return F.array_join(F.transform(candidates, block), "\n")


def choices_text(candidates: Column) -> Column:
    """Lettered choices of array<struct<relation, def>> with the none-of-the-above line."""
    lines = F.transform(candidates, lambda c, i: F.concat(F.char(i + 65), F.lit(". '"), c["relation"], F.lit("': "), F.coalesce(c["def"], F.lit(""))))
    return F.array_join(F.concat(lines, F.array(F.concat(none_letter(candidates), F.lit(". None of the above")))), "\n")


def none_letter(candidates: Column) -> Column:
    return F.char(F.size(candidates) + 65)


def definition_prompt(sentence: Column, subject: Column, predicate: Column, object_: Column, in_context: bool = True) -> Column:
    return filled(DEFINITION_PROMPT, context=F.lit(IN_CONTEXT if in_context else ""), sentence=sentence, subject=subject, predicate=predicate, object=object_)


def choice_prompt(sentence: Column, subject: Column, predicate: Column, object_: Column, definition: Column, candidates: Column) -> Column:
    return choice_prompt_of(sentence, subject, predicate, object_, definition, choices_text(candidates), none_letter(candidates))


def choice_prompt_of(sentence: Column, subject: Column, predicate: Column, object_: Column, definition: Column, choices: Column, none: Column) -> Column:
    """`choice_prompt` of lettered choices and the letter for none of them."""
    return filled(CHOICE_PROMPT, sentence=sentence, subject=subject, predicate=predicate, object=object_, definition=definition, choices=choices, none=none)


def mapping_prompt(sentence: Column, subject: Column, predicate: Column, object_: Column, block: Column, framed: bool = False) -> Column:
    """framed: with a line feed before and after, as the single-row backends have it."""
    text = filled(MAPPING_PROMPT, sentence=sentence, subject=subject, predicate=predicate, object=object_, block=block)
    return F.concat(F.lit("\n"), text, F.lit("\n")) if framed else text


def label_prompt(members: Column) -> Column:
    """The prompt for a cluster's label; members is array<struct<predicate, definition>>."""
    return filled(LABEL_PROMPT, members=F.array_join(F.transform(members, lambda m: F.concat(F.lit("  - '"), m["predicate"], F.lit("': "), F.coalesce(m["definition"], F.lit("")))), "\n"))


# The patterns of a node's normal form and what stands for them, in order. The weights and patterns in `cleanliness` are fixed as well.
NORMAL_PATTERNS = ((r"(?U)\s*'\s*", "'"), (r"(?U)\s*-\s*", "-"), (r"[-_/]", " "), (r"(?U)[^\w\s']", " "), (r"(?U)\s+", " "))


def normalized(c: Column, lemma: dict[str, str] | None = None) -> Column:
    """The form that node variants share: lower case, tight apostrophes and hyphens, separators as spaces, no other punctuation.

    lemma maps words to their base form (a bounded table, at most some thousand entries); None leaves words alone.
    """
    t = F.lower(stripped(F.coalesce(c, F.lit(""))))
    for pattern, put in NORMAL_PATTERNS:
        t = F.regexp_replace(t, pattern, put)
    t = F.trim(t)
    if lemma:
        table = F.create_map(*[F.lit(x) for kv in sorted(lemma.items()) for x in kv])
        t = F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return t


def cleanliness(c: Column) -> Column:
    """How clean a node's spelling is; minus infinity for null or empty."""
    t = stripped(c)
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    # A text is lower case if it has a cased letter and none of them is upper or title case.
    upper, lower = t.rlike(r"\p{Lu}|\p{Lt}"), t.rlike(r"\p{Ll}")
    hit = lambda p, x: F.when(t.rlike(p), F.lit(float(x))).otherwise(0.0)
    score = (
        F.when(t == c, 2.0).otherwise(0.0)
        + hit(r"\p{Lu}", 3)
        + F.when(lower & ~upper, -2.0).otherwise(0.0)
        + 0.5 * F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        + hit(r"(?U)\s'|'\s", -3)
        + hit(r"(?U)\s-|-\s", -3)
        + hit(r"(?U)\s{2,}", -2)
        - 0.5 * F.regexp_count(t, F.lit(r"(?U)[^\w\s']"))
        + 0.02 * F.least(F.length(t), F.lit(50))
    )
    return F.when(c.isNull() | (c == ""), F.lit(float("-inf"))).otherwise(score)


def isa_normalized(predicate: Column) -> Column:
    return F.when(is_isa(predicate), F.lit("isa")).otherwise(predicate)


def is_isa(predicate: Column) -> Column:
    return F.coalesce(stripped(F.lower(predicate)).isin("is-a", "is"), F.lit(False))


def singleton_label(predicate: Column) -> Column:
    return F.translate(F.lower(predicate), " -", "__")


def cleaned_label(answer: Column, fallback: Column) -> Column:
    """The first word of an answer without quotes and punctuation at its ends; the fallback's if the answer is blank."""
    first = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?U)^\s*(\S+)", 1)
    return F.regexp_replace(F.when(first == "", fallback).otherwise(first), "^['\".,;:]+|['\".,;:]+$", "")


def cluster_text(predicate: Column, definition: Column) -> Column:
    return F.when(F.coalesce(definition, F.lit("")) != "", F.concat(predicate, F.lit(": "), definition)).otherwise(predicate)


def first_line(answer: Column, strip_first: bool = False) -> Column:
    return stripped(F.substring_index(stripped(answer) if strip_first else answer, "\n", 1))


def cache_key(predicate: Column) -> Column:
    return stripped(F.lower(predicate))
