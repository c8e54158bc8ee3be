"""Relational operators over triples, ontologies and answers."""
