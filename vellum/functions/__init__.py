"""Column expressions of the dialect: values, predicates, keys."""
