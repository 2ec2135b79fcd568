"""DataFrame operators: profiling, cleaning, constraints, features, encoders,
splits, evaluation, leakage, selection, search, explanation, molecule tables."""
