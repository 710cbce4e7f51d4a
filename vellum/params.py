"""${name} and ${name:default} in query texts.

Substitution is textual and happens once: a value may be any part of a query (a list, a number for
LIMIT), is not looked through for parameters again and is not escaped. Values from outside need care.
"""

from __future__ import annotations

import re

#: Fixed value: the syntax of parameters.
_PARAMETER = re.compile(r"\$\{([^}:]+)(?::([^}]*))?\}")


class ParameterError(ValueError):
    """Parameters without value or default."""


def parameter_names(text: str) -> list[str]:
    """Names in the order of their first use."""
    return list(dict.fromkeys(m[1].strip() for m in _PARAMETER.finditer(text or "")))


def has_parameters(text: str) -> bool:
    return bool(_PARAMETER.search(text or ""))


def replace_parameters(text: str, values: dict[str, str] | None = None) -> str:
    values = values or {}
    missing = [n for m in _PARAMETER.finditer(text) if (n := m[1].strip()) not in values and m[2] is None]
    if missing:
        raise ParameterError(f"Missing required parameters: {', '.join(dict.fromkeys(missing))}")
    return _PARAMETER.sub(lambda m: str(values[n]) if (n := m[1].strip()) in values else m[2], text)
