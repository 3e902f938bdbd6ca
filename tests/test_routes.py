"""Route search against plain recursion over small networks."""

import hashlib
import itertools
import random

import pytest

from attesta.operators import routes


def brute(reactions, inputs, starting, targets, max_steps, top):
    """Every route of every compound, as (path, its set of steps, what it makes)."""
    used = {r: sorted({c for q, c in inputs if q == r}) for r, _, _ in reactions}
    sure = {r: c for r, _, c in reactions}

    def routes_to(compound, above):
        if compound in starting:
            return [((), ())]
        out = {}
        for r, product, _ in reactions:
            if product != compound or not used[r] or len(above) >= max_steps:
                continue
            for some in itertools.product(*[[] if c in above or c == compound else routes_to(c, {*above, compound}) for c in used[r]]):
                steps = tuple(dict.fromkeys(s for own, _ in some for s in own)) + (r,)
                makes = tuple(dict.fromkeys(m for _, own in some for m in own)) + (compound,)
                if compound not in makes[:-1] and len(steps) == len(makes) == len(set(steps)) and len(steps) <= max_steps:
                    out[steps] = makes
        return list(out.items())

    rows = set()
    for t in targets:
        found = []
        for steps, _ in routes_to(t, frozenset()):
            path = ">".join(steps)
            found.append((len(steps), -sum(sure[s] for s in steps), "route:" + hashlib.sha256(f"{t}|{path}".encode()).hexdigest()[:24], path))
        rows |= {(t, path, n, -c, i, len(found)) for n, c, i, path in sorted(found)[:top]}
    return rows


def network(seed, levels, wide, arity, apart):
    """Compounds by level; a reaction takes one to ``arity`` of the levels below. Apart: every made compound is an input once at most."""
    r = random.Random(seed)
    reactions, inputs, free = [], [], set()
    names = [[f"l{i}_{j}" for j in range(wide)] for i in range(levels + 1)]
    unused = {c for own in names[:-1] for c in own}
    for i in range(1, levels + 1):
        for c in names[i]:
            for k in range(r.randrange(1, 4)):
                name = f"r{c}_{k}"
                reactions.append((name, c, r.choice((0.25, 0.5, 0.75))))
                for _ in range(r.randrange(1, arity + 1)):
                    below = r.choice(names[r.randrange(0, i)])
                    if apart and below not in names[0]:
                        if below not in unused or c == below:
                            continue
                        unused.discard(below)
                    inputs.append((name, below))
                if apart:
                    inputs.append((name, r.choice(names[0])))
                elif r.random() < 0.1:
                    inputs.append((name, r.choice(names[levels])))  # a way back up
    starting = {c for c in names[0] if r.random() < 0.8} | ({names[2][0]} if r.random() < 0.5 else set())
    return reactions, inputs, starting, names[levels]


def frames(spark, reactions, inputs, starting, targets):
    return (
        spark.createDataFrame(reactions, "reaction string, product string, confidence double"), spark.createDataFrame(inputs, "reaction string, compound string"),
        spark.createDataFrame([(c,) for c in starting], "compound string"), spark.createDataFrame([(c,) for c in targets], "compound string"),
    )


@pytest.mark.parametrize(("seed", "apart", "top"), [(1, True, 3), (14, True, 100), (6, False, 4), (28, False, 100)])
def test_equals_recursion(spark, seed, apart, top):
    net = network(seed, 4, 3, 3, apart)
    want = brute(*net, 6, top)
    got = {tuple(r) for r in routes.enumerate_routes(*frames(spark, *net), max_steps=6, top=top).collect()}
    assert got == want and len(want) > 2


def test_what_no_target_needs_is_not_looked_at(spark):
    reactions = [("a", "T", 0.5), ("b", "I", 0.5)] + [(f"x{i}", f"U{i + 1}", 0.5) for i in range(20)]
    inputs = [("a", "I"), ("a", "s"), ("b", "s")] + [(f"x{i}", f"U{i}") for i in range(20)]
    reactions_, inputs_, starting, target = frames(spark, reactions, inputs, {"s", "U0"}, ["T"])
    makers, wants = routes._network(reactions_, inputs_, starting, target, 6)
    assert {(r.reaction, r.room, r.made) for r in makers.collect()} == {("a", 6, 1), ("b", 5, 0)}
    assert {r.compound for r in wants.collect()} == {"I", "s"}


def test_separable(spark):
    check = lambda reactions, inputs: routes._separable(*routes._network(*frames(spark, [(r, p, 0.5) for r, p in reactions], inputs, {"s"}, ["T"]), 6), 6)
    assert check([("a", "T"), ("b", "I"), ("c", "J")], [("a", "I"), ("a", "J"), ("b", "s"), ("c", "s")])
    assert not check([("a", "T"), ("b", "I"), ("c", "J"), ("d", "K")], [("a", "I"), ("a", "J"), ("b", "K"), ("c", "K"), ("d", "s")])  # K for both
    assert not check([("a", "T"), ("b", "I"), ("c", "T")], [("a", "I"), ("b", "s"), ("c", "s"), ("b", "T")])  # a cycle


def test_counts_without_enumeration(spark):
    # ten ways at each of five levels: 10^5 routes, of which three are grown
    reactions = [(f"r{i}_{k}", f"c{i + 1}", 0.5 + (k == 3) / 4) for i in range(5) for k in range(10)]
    inputs = [(f"r{i}_{k}", f"c{i}") for i in range(5) for k in range(10)]
    out = routes.enumerate_routes(*frames(spark, reactions, inputs, {"c0"}, ["c5"]), top=1).collect()
    assert [(r.n_steps, r.confidence, r.n_routes) for r in out] == [(5, 3.75, 100_000)] and out[0].path == ">".join(f"r{i}_3" for i in range(5))
