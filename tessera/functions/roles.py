"""Column-role resolution by name.

The reference finds a column's business role by a case-insensitive
substring test on the column name, first matching column wins.  The
pattern set differs per call site, so it is a parameter here.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

# Role name patterns used by the reference's call sites.
ROLE_PATTERNS = {
    "date": ("date",),
    "sales": ("sales", "revenue"),
    "sales_only": ("sales",),
    "product": ("product",),
    "region": ("region", "location"),
    "region_only": ("region",),
    "age": ("age",),
    "gender": ("gender",),
}


def _tokens(name: str) -> list[str]:
    parts = re.split(r"[_\W]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name))
    return [p.lower() for p in parts if p]


def find_columns(columns: Iterable[str], patterns: Sequence[str],
                 match: str = "substring") -> list[str]:
    """All columns whose name matches one of ``patterns``, in table order.

    ``match='substring'`` is the reference rule ('age' also hits
    'Percentage'); ``match='token'`` compares whole name tokens split on
    underscores and case changes ('Customer_Age' -> customer, age).
    """
    pats = [p.lower() for p in patterns]
    out = []
    for c in columns:
        if match == "substring":
            hit = any(p in c.lower() for p in pats)
        elif match == "token":
            toks = _tokens(c)
            hit = any(p in toks for p in pats)
        else:
            raise ValueError(f"unknown match mode {match!r}")
        if hit:
            out.append(c)
    return out


def resolve_role(columns: Iterable[str], role: str, match: str = "substring",
                 explicit: str | None = None) -> str | None:
    """First column for ``role`` (a key of ROLE_PATTERNS), or ``explicit``."""
    if explicit is not None:
        return explicit
    found = find_columns(columns, ROLE_PATTERNS[role], match)
    return found[0] if found else None


def resolve_roles(columns: Sequence[str], roles: dict | None = None,
                  match: str = "substring", call_site: str = "retrieval") -> dict:
    """Role -> column map; explicit entries in ``roles`` win.

    The call sites differ in two roles.  ``facts`` (A11, A13) takes a
    region only from a column named so, not from ``location``; ``simple``
    (A12) also takes sales only from a column named so, not from
    ``revenue``; ``retrieval`` (documents, charts) takes either."""
    own = {"retrieval": {}, "facts": {"region": "region_only"},
           "simple": {"region": "region_only", "sales": "sales_only"}}[call_site]
    roles = dict(roles or {})
    cols = list(columns)
    out = {}
    for role in ("date", "sales", "product", "region", "age", "gender"):
        out[role] = roles.get(role) or resolve_role(cols, own.get(role, role), match)
    return out
