"""Options of contexts from bounded lists of counters against all counters of the opponent's form."""

import random

import pytest

from touchline.operators import knowledge as kg

FORMS, PHASES, PROVIDERS = ["4-4-2", "4-3-3", "rare"], ["low-block", "mid block", "high-block", None], ["a", "b", "c", None]


def plain_options(context, counters, limit, any_phase):
    """Tiers, ranks and the cut, over every counter of the form."""
    _, provider, form, phase = context
    met = []
    for candidate, opponent, edge_phase, edge_provider, support in counters:
        if opponent != form:
            continue
        same_phase = edge_phase is not None and phase is not None and edge_phase.replace(" ", "-") == phase
        same_provider = provider is None or edge_provider in (None, provider)
        tier = 1 if same_phase and same_provider else 2 if same_phase else 3 if same_provider else 4
        rank = 0 if provider is not None and edge_provider == provider else 1 if edge_provider is None else 2
        low = lambda v: (v is not None, v or "")
        met.append((tier, rank, -support, candidate, low(edge_provider), low(edge_phase)))
    met = [m for m in met if any_phase or m[0] <= 2]
    best = sorted(m[1:] for m in met if m[0] == min(x[0] for x in met))[:limit]
    return [(m[2], -m[1], min(x[0] for x in met)) for m in best]


@pytest.mark.parametrize("any_phase", [True, False])
def test_options_equal_the_plain_rule(spark, any_phase):
    rng = random.Random(5)
    # most counters and contexts are of one form; ties in support are common
    counters = [(f"c{rng.randrange(40):02d}", rng.choice(FORMS[:1] * 8 + FORMS[1:2]), rng.choice(PHASES), rng.choice(PROVIDERS), float(rng.randrange(9))) for _ in range(1_500)]
    counters += [("only", "rare", "low-block", "b", 1.0), ("other", "rare", "mid block", "b", 2.0), ("third", "rare", "mid block", "c", 2.0)]
    asked = [(i, rng.choice(["a", "b", "zz", None]), rng.choice(FORMS[:1] * 5 + FORMS[1:] + ["unknown"]), rng.choice(["low-block", "mid-block", "high-block", "set-piece"])) for i in range(200)]
    k = spark.createDataFrame(counters, "candidate string, opponent string, phase string, provider string, support double")
    c = spark.createDataFrame(asked, "id long, provider string, opponent_form string, opponent_phase string")
    got = {}
    for r in kg.counter_options(c, k, ["id"], any_phase=any_phase).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.candidate, r.support, r.tier))
    want = {a[0]: plain_options(a, counters, 12, any_phase) for a in asked}
    assert got == {i: o for i, o in want.items() if o}
    tiers = {o[0][2] for o in want.values() if o}
    assert tiers == ({1, 2, 3, 4} if any_phase else {1, 2})


def test_a_hot_form_has_short_lists(spark):
    k = spark.range(20_000).selectExpr("CAST(id AS STRING) AS candidate", "'4-4-2' AS opponent", "'low-block' AS phase", "IF(id % 2 = 0, 'a', NULL) AS provider", "CAST(id AS DOUBLE) AS support")
    lists = kg.counter_lists(k)
    assert lists.count() == 6 * 12
    top = lists.where(f"_list = {kg.PHASE_PROVIDER}").orderBy("support", ascending=False).collect()
    assert [r.support for r in top] == [float(19_998 - 2 * i) for i in range(12)]


def test_no_join_on_the_form_alone(spark):
    k = spark.createDataFrame([("x", "4-4-2", "low-block", "a", 1.0)], "candidate string, opponent string, phase string, provider string, support double")
    c = spark.createDataFrame([(1, "a", "4-4-2", "low-block")], "id long, provider string, opponent_form string, opponent_phase string")
    plan = kg.counter_options(c, k, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_list_phase" in line and "_list_provider" in line for line in joins)
