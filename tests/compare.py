"""Rows of two results, in any order, numbers to nine places."""

from __future__ import annotations

import math


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        try:
            x = float(v)
        except (TypeError, ValueError):
            return str(v)
        return None if math.isnan(x) else round(x, 9)

    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def assert_same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
