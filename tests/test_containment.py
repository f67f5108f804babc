"""Partial name matching by q-grams against comparing every pair, and at the
size of a tenant with very many names."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from papyra.operators import matching as M
from papyra.operators.containment import containment_pairs

NAME = st.text("ab é", max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), NAME), max_size=25), st.lists(st.tuples(st.integers(1, 2), NAME), max_size=25))
def test_pairs_equal_brute_force(spark, one, two):
    a = spark.createDataFrame(one + [(1, None)], "_u long, _a string")
    b = spark.createDataFrame(two + [(2, None)], "_u long, _b string")
    got = [tuple(r) for r in containment_pairs(a, b).collect()]
    want = {(u, x, y) for u, x in one for v, y in two if u == v and x and y and (x in y or y in x)}
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), NAME), max_size=25), st.lists(st.tuples(st.sampled_from([1, 2, None]), NAME), max_size=25),
       st.sampled_from([0, 2, 5]))
def test_pairs_do_not_depend_on_how_many_are_few(spark, one, two, few):
    """Keys at the limit and beyond it, some of both in one call."""
    a = spark.createDataFrame(one, "_u long, _a string")
    b = spark.createDataFrame(two, "_u long, _b string")
    got = [tuple(r) for r in containment_pairs(a, b, few=few).collect()]
    want = {(u, x, y) for u, x in one for v, y in two if u is not None and u == v and x and y and (x in y or y in x)}
    assert len(got) == len(set(got)) and set(got) == want


def test_no_side_of_a_match_is_broadcast(spark):
    """Names and types as the planner sees them are as small as their files;
    exploded into grams they are not."""
    ty = spark.createDataFrame([(1, 1, "a b c"), (2, 1, "nota")], "id long, user_id long, name string")
    df = spark.createDataFrame([(1, 1, "a b c d", False), (2, 1, "x", None)], "id long, user_id long, classified_name string, is_others boolean")
    hit, miss = M.split_matched(df, ty)
    for out in (M.match_type_exact(df, ty), M.match_type_partial(df, ty), M.resolve_type(df, ty), hit, miss):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in hit.collect()] == [1] and [r.id for r in miss.collect()] == [2]


def test_a_tenant_of_100_000_names_and_10_000_types(spark):
    """Candidates stay near the matches: no product of names and types."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    types = [(k + 1, 1, f"tipo {rng.choice(words)} {rng.choice(words)}") for k in range(10_000)]
    items = []
    for k in range(100_000):
        t = types[rng.randrange(len(types))][2]
        items.append((k, 1, (t[3:-1], t + " anexo", f"{rng.choice(words)} {rng.choice(words)} x")[k % 3]))
    types += [(20_001, 2, "x"), (20_002, 2, "nota")]
    items += [(200_000, 2, "nota simple"), (200_001, 2, "ot"), (200_002, 2, "q"), (200_003, 2, " X ")]
    df = spark.createDataFrame(items, "id long, user_id long, classified_name string")
    ty = spark.createDataFrame(types, "id long, user_id long, name string")
    got = {r.id: (r.match_type_id, r.match_kind) for r in M.match_type_partial(df, ty).collect()}
    assert len(got) == len(items)
    assert [got[k] for k in range(200_000, 200_004)] == [(20_002, "partial"), (20_002, "partial"), (None, None), (20_001, "exact")]
    one = [(i, n.strip().lower()) for i, u, n in types if u == 1]
    for k in rng.sample(range(100_000), 150):
        name = items[k][2].strip().lower()
        exact = [i for i, n in one if n == name]
        near = [i for i, n in one if name in n or n in name]
        assert got[k] == ((min(exact), "exact") if exact else (min(near), "partial") if near else (None, None))


def test_plan_has_no_join_on_the_tenant_alone(spark):
    ty = spark.createDataFrame([(1, 1, "a b c")], "id long, user_id long, name string")
    df = spark.createDataFrame([(1, 1, "a b c d")], "id long, user_id long, classified_name string")
    plan = M.match_type_partial(df, ty)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for line in plan.splitlines():
        if "Join [" in line:
            assert "," in line.split("[", 1)[1].split("]", 1)[0], line
