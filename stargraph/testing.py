"""Order-insensitive result comparison used by the tests and ``tools/oracle_check.py``."""
from __future__ import annotations

import math


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, v)
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, int):
        return (2, float(v)) if abs(v) < 2**53 else (4, v)
    if hasattr(v, "isoformat"):
        return (5, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (6, tuple(norm(x) for x in v))
    if isinstance(v, dict):
        return (7, tuple(sorted((k, norm(x)) for k, x in v.items())))
    return (8, str(v))


def canonical(cols, rows):
    """Rows as sorted tuples of normalised values, columns ordered by name."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def close(a, b, rel=1e-9) -> bool:
    if a == b:
        return True
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        if len(a) == 2 and a[0] == b[0] == 2:
            x, y = a[1], b[1]
            return abs(x - y) <= rel * max(1.0, abs(x), abs(y))
        return all(close(x, y, rel) for x, y in zip(a, b))
    return False


def compare(cols, rows, ocols, orows) -> list[str]:
    """Problems found (empty when the results agree: same column names, row count and values)."""
    problems = []
    if sorted(cols) != sorted(ocols):
        problems.append(f"columns {sorted(cols)} vs {sorted(ocols)}")
    if len(rows) != len(orows):
        problems.append(f"rows {len(rows)} vs {len(orows)}")
    if not problems:
        a, b = canonical(cols, rows), canonical(ocols, orows)
        if a != b:
            bad = [(x, y) for x, y in zip(a, b) if not close(x, y)]
            if bad:
                problems.append(f"values differ, e.g. {bad[:2]}")
            else:
                problems.append("values equal only to 1e-9")
    return problems
