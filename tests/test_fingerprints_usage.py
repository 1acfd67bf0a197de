"""Fingerprint stages, links over alias chains, and foreground time against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberlog.operators import fingerprints as fp, indicators as ind, usage


def test_stages_shapes_and_clashing_columns(spark):
    known = spark.createDataFrame([
        ("ja4", "a_b_c", "bad", "one", "s"), ("ja4", "x_b_c", "bad", "two", "s"), ("ja4", "plain", "bad", "three", None)],
        "kind string, value string, class string, label string, source string")
    rows = spark.createDataFrame([(i, v, "old") for i, v in enumerate(
        [" a_b_c ", "a_z_c", "a_b_z", "z_b_c", "plain", "", None, "a_b"])], "id int, f string, label string")
    got = {r["id"]: (r["class"], r["label"], r["stage"]) for r in fp.reputations(rows, "ja4", "f", known).collect()}
    unknown = ("unknown", None, None)
    assert got == {0: ("bad", "one", "exact"), 1: ("bad", "one", "first_and_last"), 2: ("bad", "one", "first_and_middle"),
                   3: unknown, 4: ("bad", "three", "exact"), 5: unknown, 6: unknown, 7: unknown}  # 3: two labels
    assert fp.reputations(rows.filter("false"), "ja4", "f", known).count() == 0
    assert fp.reputations(rows, "ja4", "f", known.filter("false")).filter("class <> 'unknown'").count() == 0


def test_ja3_and_option_lists(spark):
    known = fp.known_fingerprints(spark)
    seen = spark.createDataFrame([("A0E9F5D64349FB13191BC781F81F42E1",), ("0f94a14c08c9bbcf8a8e23fe4a7f8fed",),
                                  ("a0e9",), ("g" * 32,)], "ja3 string")
    got = {r["ja3"][:4]: r["class"] for r in fp.reputations(seen, "ja3", "ja3", known).collect()}
    assert got == {"A0E9": "known_bad", "0f94": "benign_common", "a0e9": "unknown", "gggg": "unknown"}
    leases = spark.createDataFrame([("m", "i", "1 3 6  15,28", "h2"), ("m", "i", "1,3,6,15,28", "h1"), ("m", "j", "28,15,6,3,1", None),
                                    ("m", "k", None, None), ("m", "l", "1,2", None)], "mac string, ip string, params_list string, host_name string")
    got = {r["ip"]: (r["params_list"], r["host_name"], r["likely_os"], r["stage"]) for r in fp.dhcp_clients(leases, known).collect()}
    linux = "Linux (older systemd-networkd)"
    assert got == {"i": ("1,3,6,15,28", "h1", linux, "exact"), "j": ("28,15,6,3,1", None, linux, "any_order"),
                   "k": ("", None, None, None), "l": ("1,2", None, None, None)}


def test_links_over_alias_chains_and_loops(spark):
    log = spark.createDataFrame([
        ("A.example.", "b.example,10.0.0.1"), ("b.example", "c.example"), ("c.example", "d.example"),
        ("d.example", "e.example, a.example"), ("e.example", "2001:DB8::1,10.0.0.1"), ("x.example", "-"),
        ("y.example", None), (None, "10.0.0.9"), ("z.example", "z.example")], "query string, answers string")
    got = {(r["value"], r["linked"]): r["aliases"] for r in ind.dns_links(log).filter("relation = 'resolved_to'").collect()}
    six, four = "2001:db8::1", "10.0.0.1"
    assert got == {("a.example", four): 0, ("a.example", six): 4, ("b.example", four): 3, ("b.example", six): 3,
                   ("c.example", four): 2, ("c.example", six): 2, ("d.example", four): 1, ("d.example", six): 1,
                   ("e.example", four): 0, ("e.example", six): 0}
    back = ind.dns_links(log, follow=False)
    assert {(r["ioc_type"], r["value"], r["linked"]) for r in back.filter("relation = 'resolved_from'").collect()} == {
        ("ipv4", four, "a.example"), ("ipv4", four, "e.example"), ("ipv6", six, "e.example")}
    assert ind.dns_links(log.filter("false")).count() == 0


def test_foreground_time_counts_overlaps_once(spark):
    rng, start = random.Random(4), datetime(2024, 2, 27, 20)
    rows = []
    for _ in range(300):
        s = start + timedelta(seconds=rng.randrange(0, 5 * 86400))
        rows.append((rng.choice("ab"), s, s + timedelta(seconds=rng.choice([0, 30, 4000, 200_000]))))
    rows += rows[:40] + [("a", None, start), ("a", start, None), ("c", start, start - timedelta(1)),
                         ("d", datetime(2024, 2, 28), datetime(2024, 2, 29))]
    got = {r["app"]: (r["seconds"], r["raw_seconds"], r["intervals"]) for r in usage.foreground_seconds(spark.createDataFrame(
        rows, "app string, start timestamp, end timestamp"), ["app"]).collect()}
    for app in "ab":
        own = [(s, e) for a, s, e in rows if a == app and s and e]
        covered = set()
        for s, e in own:
            a = int((s - start).total_seconds())
            covered.update(range(a, a + int((e - s).total_seconds())))
        assert got[app] == (len(covered), sum((e - s).total_seconds() for s, e in own), len(own))
    assert got["c"] == (0, 0, 1) and got["d"] == (86400, 86400, 1)


def test_timeline_and_days(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    leases = spark.createDataFrame([("", "en0", "m", t[1]), ("net", "en0", None, t[0]), ("x", "y", "z", None)],
                                   "ssid string, interface string, router_mac string, lease_start timestamp")
    nets = spark.createDataFrame([("n", t[2], None, t[0], t[1])], "ssid string, added timestamp, joined_by_user timestamp, "
                                 "joined_by_system timestamp, updated timestamp")
    assert [tuple(r)[1:] for r in usage.network_timeline(leases, nets).collect()] == [
        ("dhcp_lease", "net via router "), ("wifi_joined_by_system", "n"), ("dhcp_lease", "en0 via router m"), ("wifi_added", "n")]
    days = [usage.networks_joined_on(nets, F.lit(d).cast("date")).count() for d in ("2024-01-02", "2024-01-04")]
    assert days == [1, 0]
