"""Groups of linked values and of similar names against brute force."""

import random

from munim.operators import recurring as R
from munim.operators.groups import linked_groups


def roots(values, links):
    group = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def test_linked_groups(spark):
    random.seed(4)
    links = [(f"n{random.randint(0, 200)}", f"n{random.randint(0, 200)}") for _ in range(120)]
    links += [(f"c{k:03}", f"c{k + 1:03}") for k in range(90)] + [("x", "x")]
    got = {r.v: r.group for r in linked_groups(spark.createDataFrame(links, "a string, b string")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == roots({v for pair in real for v in pair}, real)
    assert linked_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_similar_groups(spark):
    random.seed(5)
    base = ["swiggy order", "netflix monthly", "uber trip", "big bazaar", "a", "ab", "zz top shop"]
    names = [b + random.choice(["", "s", " x", " 12", "99"]) + random.choice("abcde ") for b in base for _ in range(9)]
    rows = [(n,) for n in names + names[:5]] + [(None,), ("",)]
    got = {r.name: (r.class_id, r.n_links) for r in R.similar_groups(spark.createDataFrame(rows, "name string")).collect()}

    def grams(s):
        return {s[k:k + 2] for k in range(len(s) - 1)}

    every = sorted({n for n, in rows if n is not None})
    close = [(a, b) for a in every for b in every if a < b and grams(a) | grams(b)
             and len(grams(a) & grams(b)) >= 0.6 * len(grams(a) | grams(b))]
    group = roots(every, close)
    assert got == {n: (group[n], sum(n in p for p in close)) for n in every}
