"""Similar pairs with and without a budget, and what a budget leaves out."""

import random
from collections import Counter, defaultdict
from math import comb

from shelfmark.operators import graph


def test_budget(spark):
    rng = random.Random(4)
    sets = {f"s{i}": set(rng.sample([f"t{j:02d}" for j in range(60)], 9)) for i in range(25)}
    frame = spark.createDataFrame([(s, t) for s, ts in sets.items() for t in ts], "skill string, term string")
    df = Counter(t for ts in sets.values() for t in ts)
    able = sorted((t for t in df if 2 <= df[t] <= 6), key=lambda t: (df[t], t))
    weight = {t: max(0.1, 1 + (25 - df[t] + 0.5) / (df[t] + 0.5)) for t in able}
    for budget in (None, 40, 10**6, 1):
        used, spent = [], 0
        for t in able:  # rarest first, until the pairs before it reach the budget
            if budget is None or spent < budget:
                used.append(t)
            spent += comb(df[t], 2)
        told = graph.similar_dropped(frame, (2, 6), budget).first()
        left = [t for t in able if t not in used]
        assert tuple(told) == (len(able), len(left), sum(comb(df[t], 2) for t in left))
        want, own = {}, defaultdict(set)
        for s, ts in sets.items():
            own[s] = ts & set(used)
        for a in own:
            for b in own:
                both = own[a] & own[b]
                if a < b and len(both) >= 2:
                    s = sum(weight[t] for t in both)
                    want[a, b] = (len(both), round(s / (sum(weight[t] for t in own[a] | own[b])), 6))
        got = {(r.u, r.v): (r.shared, r.weight) for r in graph.similar_pairs(frame, df_range=(2, 6), min_shared=2, budget=budget).collect()}
        assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 2e-6 and got[k][0] == want[k][0] for k in got)
