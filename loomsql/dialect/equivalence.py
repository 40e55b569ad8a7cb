"""Whether a query answers alike if unknown conditions are taken for false ones (two-valued against three-valued logic).

A sound hint, not a proof: conditions that are never unknown, or whose unknown only loses rows, are passed over. What
remains are places under a negation, and the one construct that turns a single null into an empty answer, NOT IN of a
subquery.
"""

from __future__ import annotations

from . import ast as A

SETTLED = (A.IsNull, A.IsBool, A.IsDistinct, A.Literal, A.Column)


def logics_agree(q: A.Query) -> bool:
    """False if evaluation of the WHERE clauses comes upon NOT IN of a subquery; the body must be a plain SELECT."""
    work: list[A.Node | None] = [q]
    while work:
        n = work.pop()
        if n is None or isinstance(n, SETTLED):
            continue
        if isinstance(n, A.InQuery):
            if n.negated:
                return False
        elif isinstance(n, A.Query):
            if not isinstance(n.body, A.Select):
                raise ValueError("only plain SELECT queries can be judged")
            work.append(n.body.where)
        elif isinstance(n, (A.InList, A.Between)):
            if n.negated:
                work.extend(n.children())
        elif isinstance(n, A.Exists):
            if n.negated:
                work.append(n.query)
        elif isinstance(n, A.Unary):
            if n.op == "NOT":
                work.append(n.e)
        elif isinstance(n, (A.Binary, A.Quantified, A.Scalar, A.Substring)):
            work.extend(n.children())
    return True
