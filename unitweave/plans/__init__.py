"""Driver-side planning: schemas, budgets, sweeps, verdicts."""
