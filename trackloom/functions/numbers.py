"""Rounding that does not depend on the last bits of a sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column, digits: int = 6) -> Column:
    """Round after a nudge far below the last digit, so exact halves always go the same way; zero has no sign."""
    return F.round(value + F.lit(3.0 * 10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def settle_sql(sql: str) -> str:
    """The same rule for every ``round(x, n)`` of a statement."""
    out, at = [], 0
    while True:
        start = sql.find("round(", at)
        if start < 0 or (start > 0 and (sql[start - 1].isalnum() or sql[start - 1] == "_")):
            if start < 0:
                return "".join([*out, sql[at:]])
            out.append(sql[at : start + 6])
            at = start + 6
            continue
        depth, end, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        digits = int(sql[comma + 1 : end - 1])
        inner = settle_sql(sql[start + 6 : comma])
        out.append(f"{sql[at:start]}(round(({inner}) + 3e-{digits + 3}, {digits}) + 0.0)")
        at = end
