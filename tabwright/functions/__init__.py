"""Column-level building blocks: boundary normalisation, scalar functions, statistics."""
