"""Plain definitions to test against, for small inputs."""

from itertools import combinations


def closed_sets(trans: dict, minsup: int) -> dict:
    """{(bucket, cols): rows} from {bucket: {row: set of items}}."""
    found = {}
    for bucket, rows in trans.items():
        items = sorted({i for s in rows.values() for i in s})
        for size in range(1, len(items) + 1):
            for cols in combinations(items, size):
                having = frozenset(r for r, s in rows.items() if s.issuperset(cols))
                if len(having) < minsup:
                    continue
                shared = set.intersection(*[rows[r] for r in having])
                if shared == set(cols):
                    found[bucket, cols] = having
    return found


def similar_biclusters(cells: dict, theta: float, minsup: int, min_cols: int) -> set:
    """{(rows, cols)}: full blocks with max - min <= theta that no row or column can join."""
    rows = sorted({r for r, _ in cells})
    cols = sorted({c for _, c in cells})

    def fits(rs, cs):
        values = [cells.get((r, c)) for r in rs for c in cs]
        return None not in values and max(values) - min(values) <= theta

    found = set()
    for n in range(minsup, len(rows) + 1):
        for rs in combinations(rows, n):
            for m in range(min_cols, len(cols) + 1):
                for cs in combinations(cols, m):
                    if (
                        fits(rs, cs)
                        and not any(fits((*rs, r), cs) for r in rows if r not in rs)
                        and not any(fits(rs, (*cs, c)) for c in cols if c not in cs)
                    ):
                        found.add((rs, cs))
    return found
