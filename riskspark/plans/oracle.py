"""Composition of check SQL: named common table expressions pulled in by the names a query mentions."""
from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def r(x: str, k: int) -> str:
    """Round half up, the same arithmetic as functions.num.rnd."""
    return f"(floor(({x})*1e{k}+0.5)/1e{k})"


def r9(x: str) -> str:
    return r(x, 9)


def clamp(x: str, lo: str = "0.0", hi: str = "1.0") -> str:
    return f"greatest({lo}::double, least({hi}::double, {x}))"


def compose(sql: str) -> str:
    """Prefix the statement with every CTE it needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for w in dict.fromkeys(re.findall(r"\b[a-z]\w*", text)):
            if w in CTES and w not in order and w not in active:
                active.add(w)
                visit(CTES[w])
                order.append(w)

    active: set[str] = set()
    visit(sql)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s)?", sql)
    return f"WITH {(own[1] or '')}{head},\n{sql[own.end():]}" if own else f"WITH {head}\n{sql}"


def clone(root: str, prefix: str, sources: dict[str, str]) -> str:
    """Re-create a CTE and what it depends on over other source relations; returns the new root name."""
    words = lambda t: [w for w in dict.fromkeys(re.findall(r"\b[a-z]\w*", t)) if w in CTES]
    todo, names = [root], {}
    while todo:
        n = todo.pop()
        if n in names or n in sources:
            continue
        names[n] = prefix + n
        todo += words(CTES[n])
    table = {**names, **sources}
    pat = re.compile(r"\b(" + "|".join(sorted(table, key=len, reverse=True)) + r")\b")
    for old, new in names.items():
        cte(new, pat.sub(lambda m: table[m.group(1)], CTES[old]))
    return names[root]
