"""Reading and writing graphs, ontologies, term lists and logs."""
