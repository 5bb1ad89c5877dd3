"""Column expressions: text folding, facts, names, citations, embeddings."""
