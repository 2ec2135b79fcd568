"""Physical building blocks shared by operators: global order, running totals,
value ladders (distinct value → count → cumulative position)."""
