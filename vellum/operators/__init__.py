"""Relational operators over bindings: scan rows, unnest, join, order, limit, project, distinct."""
