"""Schemas of the tables. Order is data: rows carry an explicit position `pos`."""

from __future__ import annotations

PAIR = "struct<s: string, p: string, o: string>"
KG_OPEN = "pos bigint, sentence string, subject string, predicate string, object string"
CANDIDATE = "struct<relation: string, similarity: double>"
RETRIEVED = "struct<relation: string, score: double, pred_name_score: double, pred_def_score: double, triplet_def_score: double>"
CHOICE = "struct<relation: string, def: string>"
ONTOLOGY = f"relation string, rel_idx int, def string, triplets array<{PAIR}>"
TRIPLE = ("subject", "predicate", "object")
USAGE = "struct<prompt_tokens: int, completion_tokens: int, total_tokens: int>"
COMPLETION = f"struct<text: string, attempts: int, error: string, usage: {USAGE}>"
