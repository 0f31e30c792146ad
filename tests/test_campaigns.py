"""Sessions, campaigns, streams and the life of stored rows, against plain readings of their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from netquarry.operators import campaigns, lifecycle, scratch, sessions, store
from netquarry.streaming import campaigns as streams

EVENT = "event_id string, event_no long, ts_us long, src_ip string, dst_ip string, dst_port int, blocked_legacy boolean"
MESSAGE = "event_id string, ts_us long, src_ip string, batch string, event_type string, message string"
ARRIVAL = "key string, job long, arrival_id string, version string, first_us long, last_us long, now_us long, alive boolean"
S = 1_000_000


def traffic(seed, n=400):
    pick = random.Random(seed)
    return [(f"E{i:04}", i, pick.choice([pick.randrange(1500) * S] * 9 + [None]), pick.choice(["a", "a", "b", None, ""]), pick.choice(["x", "y", None]), pick.choice([None, 0, 22, 23, 80]), pick.choice([True, True, True, False, None])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_first_port_sweep_is_that_of_a_plain_scan(spark, seed):
    rows = traffic(seed, 120)
    want = set()
    for src in {r[3] for r in rows} - {None}:
        own = sorted((r for r in rows if r[3] == src and r[6] and r[2] is not None), key=lambda r: (r[2], r[1]))
        for i, first in enumerate(own):
            window = [r for r in own[i:] if r[2] - first[2] <= 300 * S]
            if len({r[5] for r in window} - {None, 0}) >= 3:
                want |= {(src, first[2], r[0]) for r in window}
                break
    got = sessions.first_port_sweep(spark.createDataFrame(rows, EVENT))
    assert want and {tuple(r) for r in got.collect()} == want
    assert sessions.first_port_sweep(spark.createDataFrame([], EVENT)).count() == 0


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_first_flood_is_that_of_a_plain_scan(spark, seed):
    rows = traffic(seed)
    want = set()
    for pair in {(r[3], r[4]) for r in rows if r[3] and r[4]}:
        own = sorted((r for r in rows if (r[3], r[4]) == pair and r[2] is not None), key=lambda r: (r[2], r[1]))
        for i, first in enumerate(own):
            window = [r for r in own[i:] if r[2] - first[2] <= 60 * S]
            n, b = len(window), sum(bool(r[6]) for r in window)
            if n >= 5 and b / n > 0.6:
                want.add((*pair, first[2], n, b))
                break
    got = sessions.first_flood(spark.createDataFrame(rows, EVENT), least=5, share=0.6)
    assert want and {tuple(r) for r in got.collect()} == want


def test_ordinary_web_traffic_needs_a_batch_of_web_requests(spark):
    ok = "GET /index.html HTTP/1.1 200 OK"
    rows = [("1", 0, "a", "p", "HTTP_GET", ok), ("2", 0, "a", "p", None, ok), ("3", 0, "a", "q", "HTTP_GET", ok), ("4", 0, "a", "q", "SSH", ""), ("5", 0, "a", None, "HTTP_POST", ok),
            ("6", 0, "a", "p", "HTTP_GET", "GET /index.html HTTP/1.1 404"), ("7", 0, "a", "p", "HTTP_GET", ok + " <script>"), ("8", 0, "a", "p", "HTTP_GET", None), ("9", 0, "a", "p", "HTTP_GET", "GET /x HTTP/1.1 200 OK")]
    assert {r.event_id for r in sessions.benign_web(spark.createDataFrame(rows, MESSAGE), "batch").collect()} == {"1", "5"}


@pytest.mark.parametrize("seed", [6, 7])
def test_admin_logins_are_those_of_all_pairs(spark, seed):
    pick = random.Random(seed)
    texts = ["POST /login user=ADMIN 200 OK", "GET /dashboard 200 ok", "GET /dashboard 500", "POST /login user=bob 200 OK", None]
    rows = [(f"E{i}", pick.randrange(8000) * S, pick.choice(["10.0.0.1", "10.0.0.2", "45.1.1.1", None]), "p", "HTTP_GET", pick.choice(texts)) for i in range(120)]
    logins = [r for r in rows if r[5] == texts[0] and (r[2] or "").startswith("10.")]
    views = [r for r in rows if r[5] == texts[1] and (r[2] or "").startswith("10.")]
    pairs = [(a, b) for a in logins for b in views if a[2] == b[2] and 0 <= b[1] - a[1] <= 600 * S]
    want = {(a[0], a[2], "login") for a, _ in pairs} | {(b[0], b[2], "view") for _, b in pairs}
    assert want and {tuple(r) for r in sessions.admin_logins(spark.createDataFrame(rows, MESSAGE), F.col("src_ip").startswith("10.")).collect()} == want


def test_search_tells_that_there_is_more(spark):
    rows = spark.createDataFrame([(i, "An Idiom" if i % 2 else None, "x") for i in range(30)], "id int, a string, b string")
    got = sessions.search_text(rows, "IDIOM", ["a", "b"], "id").collect()
    assert [(r.id, r.place, r.truncated) for r in got] == [(2 * i + 1, i + 1, True) for i in range(10)]
    assert not sessions.search_text(rows.where("id < 4"), "idiom", ["a"], "id").first().truncated
    with pytest.raises(ValueError):
        sessions.search_text(rows, "", ["a"], "id")


def plain_campaigns(rows, window, ttl):
    """The definition, arrival by arrival."""
    out, states = [], {}
    for key, job, aid, version, first, last, now, alive in sorted(rows, key=lambda r: (r[1], r[2], r[4], r[5])):
        s = states.get(key)
        if s is None:
            said = "first"
        elif alive is False:
            said = "repair"
        elif s["v"] != version or now >= s["until"]:
            said = "new_generation"
        elif first > last:
            said = "stale"
        elif first - s["z"] > window:
            said = "new_generation"
        else:
            said = "stale" if s["a"] - last > window else "merge"
        if said == "merge":
            s.update(a=min(s["a"], first), z=max(s["z"], last), until=now + ttl)
        elif said != "stale":
            states[key] = s = {"v": version, "g": (s["g"] if s else 0) + 1, "a": first, "z": last, "until": now + ttl}
        out.append((key, job, aid, said, s["g"], s["a"], s["z"]))
    return sorted(out)


def some_arrivals(seed, n=160):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        first = pick.randrange(600)
        rows.append((pick.choice("abc"), i // 4, f"r{i:03}", pick.choice(["v1"] * 9 + [None]), first * S, (first + pick.randrange(-3, 40)) * S, i * S, pick.choice([True] * 8 + [False, None])))
    return rows


@pytest.mark.parametrize("seed", [8, 9])
def test_campaigns_are_those_of_a_plain_fold_in_batch_and_stream(spark, seed):
    rows = some_arrivals(seed)
    want = plain_campaigns(rows, 60 * S, 30 * S)
    assert {r[3] for r in want} == {"first", "repair", "new_generation", "stale", "merge"}
    table = spark.createDataFrame([*rows, (None, 1, "n", "v1", 1, 2, 3, True), ("a", 1, "n", "v1", None, 2, 3, True)], ARRIVAL)
    assert sorted(tuple(r) for r in campaigns.replay(table, 60 * S, 30 * S).collect()) == want
    # two files, read by two triggers in the order of their jobs: the second goes on from the state of the first
    path = scratch.written(table.where("job < 20 OR key IS NULL").coalesce(1), "arrivals")
    table.where("job >= 20").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted(tuple(r) for r in streams.run_available(streams.decisions(stream, 60 * S, 30 * S), "t").collect()) == want
    assert campaigns.replay(table.limit(0)).count() == 0


def test_provenance_counts_the_last_job_apart(spark):
    decided = spark.createDataFrame([("a", 1, "", "first", 1, 0, 1), ("a", 2, "", "merge", 1, 0, 1), ("a", 3, "", "stale", 1, 0, 1), ("a", 4, "", "repair", 2, 0, 1)], campaigns.DECIDED)
    n = spark.createDataFrame([("a", j, 10 * j) for j in (1, 2, 3, 4)] + [("a", 2, 1)], "key string, job long, n long")
    assert {tuple(r) for r in campaigns.provenance(decided, n).collect()} == {("a", 1, 2, 21, 10), ("a", 2, 1, 40, 0)}


def test_statuses_conflicts_offsets_and_delays(spark):
    incidents = spark.createDataFrame([("i", "new", None), ("j", "closed", 4), ("k", None, 2)], "incident_id string, status string, version int")
    asked = spark.createDataFrame([("i", "triaged"), ("i", "new"), ("j", "triaged"), ("k", "new"), ("absent", "new")], "incident_id string, new_status string")
    got = {(r.incident_id, r.new_status): (r.outcome, r.status, r.version) for r in lifecycle.transitions(incidents, asked).collect()}
    assert got == {("i", "triaged"): ("changed", "triaged", 2), ("i", "new"): ("unchanged", "new", None), ("j", "triaged"): ("refused", "closed", 4), ("k", "new"): ("refused", None, 2)}
    old, new = spark.createDataFrame([("i", 1, "a"), ("j", 1, None)], "id string, x int, y string"), spark.createDataFrame([("i", 2, "b"), ("j", 1, "z")], "id string, x int, y string")
    assert [tuple(r) for r in lifecycle.conflicts(old, new, "id", ["x", "y"]).collect()] == [("i", "x,y")]
    offsets = spark.createDataFrame([("a", "+02:00"), ("a", None), ("b", "+02:00"), ("b", "-01:00"), ("c", "+24:00"), ("d", None)], "k string, o string")
    assert dict(map(tuple, lifecycle.source_offset(offsets, "k", "o").collect())) == {"a": "+02:00", "b": None, "c": None, "d": None}
    assert [r[0] for r in spark.range(1, 12, 5).select(lifecycle.retry_delay(F.col("id"))).collect()] == [30, 960, 3600]


def test_retention_and_cleanup(spark):
    day, now = lifecycle.DAY_US, 1000 * lifecycle.DAY_US
    rows = spark.createDataFrame([("a", now - 31 * day), ("b", now - 29 * day), ("c", now - 31 * day), ("d", now - 31 * day), ("e", None), ("f", now - 31 * day)], "id string, at long")
    holds = spark.createDataFrame([("canonical_event", "c", None, None), ("canonical_event", "c", None, None), ("canonical_event", "a", 1, None), ("incident", "d", None, None), ("canonical_event", "d", None, now)], "entity string, id string, released_us long, until_us long")
    guard = spark.createDataFrame([("f",), ("f",), (None,)], "x string")
    got = lifecycle.retention(rows, "canonical_event", "id", "at", now, holds, [guard])
    assert sorted((r.id, r.candidate, r.protected, r.held) for r in got.collect()) == [("a", True, False, False), ("c", False, False, True), ("d", True, False, False), ("f", False, True, False)]
    ids = lambda text: spark.createDataFrame([(x,) for x in text], "id string")
    verdicts = lifecycle.cleanup(ids("abcdza"), ids("abcd"), ids("bcd"), ids("cd"), ids("d"))
    assert dict(map(tuple, verdicts.collect())) == {"z": "missing", "a": "not_eligible", "b": "not_archived", "d": "referenced", "c": "delete"}


def test_archives_that_lost_repeated_rows_are_found_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, t long")
    told = store.archive(rows, f"{tmp_path}/a", "t")
    read = spark.read.schema(rows.schema).json(f"{tmp_path}/a")
    assert store.archive_faults(read, "t", told).count() == 0
    assert {r.item for r in store.archive_faults(read.where("k = 'b'"), "t", told).collect()} == {"n", "least", "greatest", "checksum"}
