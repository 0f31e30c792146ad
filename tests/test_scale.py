"""What the chain computes, shuffles and sorts, and that its windows are right at the bounds of their stretches of time."""

import random

from netquarry.operators import rules, scratch, signals, suppression
from netquarry.plans import queries

from .test_engine import events


def _scan(n=400, seed=3):
    pick = random.Random(seed)
    return [{"ts_us": pick.randrange(4000) * 1_000_000, "src_ip": f"45.83.64.{pick.randrange(3)}", "dst_ip": f"10.9.{pick.randrange(8, 10)}.{pick.randrange(12)}", "dst_port": pick.choice([22, 23, 445, 3389]), "action": pick.choice(["block", "block", "block", "pass"]), "inbound_zone": "wan"} for _ in range(n)]


def test_a_query_makes_only_the_tables_that_it_asks_for(spark):
    found = signals.correlated(scratch.stored(events(spark, _scan(60)), "events"))
    assert found["bridge"].columns and set(found.made) == {"raw", "merged", "bridge"}  # no clusters, no incidents


def test_no_address_is_parsed_again_for_each_rule(spark):
    df = scratch.stored(events(spark, _scan(20)), "events")
    plan = lambda policy: signals.all_signals(df, policy=policy)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan(suppression.Policy(destinations=queries.chain_queries.POLICY.destinations, pairs=queries.chain_queries.POLICY.pairs))


def test_events_are_copied_only_where_the_next_stretch_begins_within_their_window(spark):
    chosen = [r for r in rules.RULES if r.kind == "window"]
    df = scratch.stored(events(spark, _scan()), "events")
    rows = rules.evaluate_all(df, chosen, lean=True)
    generated = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x and "own" in x and "bucket" in x]
    assert generated and all("pmod" in x for x in generated)


def test_lean_signals_are_those_of_all_counts(spark):
    """Over stretches of several windows: times reach over many of them."""
    df = scratch.stored(events(spark, _scan(900)), "events")
    names = ("rule", "entity", "key", "event_id", "n", "b", "first_us", "first_id", "last_us", "severity", "confidence")
    rows = lambda lean: sorted(map(tuple, rules.evaluate_all(df, rules.RULES, lean=lean).select(*names).collect()))
    assert rows(True) == rows(False) != []


def test_no_join_sends_much_through_the_driver(spark):
    """Tables of which each row is short, but all are not: their join is by shuffles while stored tables are written, and settings are as before after it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    with scratch.bounded(spark):
        assert scratch._bytes(spark.conf.get(name)) <= scratch.BROADCAST
        a, b = scratch.stored(spark.range(200_000).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS x"), "a"), scratch.stored(spark.range(200_000).selectExpr("id", "sha2(CAST(id AS STRING), 512) AS y"), "b")
        plan = a.join(b, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and spark.conf.get(name) == before
    assert [scratch._bytes(x) for x in ("-1", "10485760b", "256k", "1MB")] == [-1, 10485760, 262144, 1048576]
