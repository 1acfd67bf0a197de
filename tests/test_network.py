from datetime import datetime, timedelta

import statistics
import random


from emberlog.operators import auth, network as net, web
from emberlog.operators.common import split_lag, spread_around_median

T0 = datetime(2024, 1, 1)


def flows(spark, rows):
    return spark.createDataFrame(
        [(i, s, d, p, "tcp", t) for i, (s, d, p, t) in enumerate(rows)],
        "flow_id LONG, src STRING, dst STRING, dport INT, proto STRING, ts TIMESTAMP")


def steady(n, seconds=60, src="a"):
    return [(src, "x", 443, T0 + timedelta(seconds=seconds * i)) for i in range(n)]


def test_beacon_fires_on_a_steady_key_only(spark):
    rng = random.Random(3)
    noisy = [("b", "x", 443, T0 + timedelta(seconds=rng.randint(0, 90000))) for _ in range(30)]
    lone = [("c", "x", 443, T0)]
    bad = [(None, "x", 443, T0), ("d", "x", None, T0)]
    hits = net.beacons(flows(spark, steady(12) + noisy + lone + bad)).collect()
    assert [h.src for h in hits] == ["a"]
    assert hits[0].score == 1.0 and hits[0].mean_interval == 60.0


def test_beacon_needs_ten_connections(spark):
    assert net.beacons(flows(spark, steady(9))).count() == 0


def test_large_keys_take_the_counting_way_with_equal_scores(spark):
    rng = random.Random(7)
    rows = [(s, "x", 443, T0 + timedelta(seconds=rng.randint(0, 50000)))
            for s in "ab" for _ in range(60)]
    df = flows(spark, rows)
    cols = ["src", "connections", "mean_interval", "stdev_interval", "score"]

    def rounded(d):
        return sorted((r.src, r.connections, round(r.mean_interval, 6),
                       round(r.stdev_interval, 6), round(r.score, 9))
                      for r in d.select(*cols).collect())
    assert rounded(net.beacon_scores(df)) == rounded(net.beacon_scores(df, large_key=10))


def test_median_and_deviation_against_statistics(spark):
    rng = random.Random(1)
    data = {k: [rng.randint(0, 1 << 24) for _ in range(n)] for k, n in (("o", 31), ("e", 40),
                                                                       ("one", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k STRING, v LONG")
    got = {r.k: r for r in spread_around_median(df, ["k"], "v", shift=10).collect()}
    for k, vs in data.items():
        m = statistics.median(vs)
        assert got[k].median == m
        assert abs(got[k].mad - statistics.fmean(abs(v - m) for v in vs)) < 1e-6


def test_split_lag_equals_plain_lag(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), T0 + timedelta(seconds=rng.randint(0, 5000))) for i in range(300)]
    df = spark.createDataFrame(rows, "id LONG, k STRING, ts TIMESTAMP")
    whole = split_lag(df, ["k"], "ts", "id", ["id"]).collect()
    pieces = split_lag(df, ["k"], "ts", "id", ["id"], piece_rows=20).collect()
    assert sorted(map(str, whole)) == sorted(map(str, pieces))


def test_split_lag_cuts_a_burst(spark):
    """All rows of the key within one second, but one: pieces still hold a few rows each."""
    rows = [(i, "a", T0 + timedelta(microseconds=37 * i)) for i in range(20_000)] + [
        (20_000, "a", T0 + timedelta(days=365))]
    df = spark.createDataFrame(rows, "id LONG, k STRING, ts TIMESTAMP")
    lagged = split_lag(df, ["k"], "ts", "id", ["id"], piece_rows=100)
    assert lagged.filter("prev_id IS NULL").count() == 1
    assert lagged.filter("prev_id = id - 1").count() == 20_000


def test_results_do_not_depend_on_partitioning(spark):
    df = flows(spark, steady(12) + steady(15, 77, "b"))
    one = sorted(map(str, net.beacon_scores(df.repartition(1)).collect()))
    many = sorted(map(str, net.beacon_scores(df.repartition(17)).collect()))
    assert one == many


def signins(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "event_id LONG, principal STRING, source STRING, failed BOOLEAN, country STRING, "
        "ts TIMESTAMP")


def test_failure_burst_threshold(spark):
    rows = [("u", "1", True, "US", T0)] * 10 + [("v", "1", True, "US", T0)] * 9 + [
        ("w", "1", None, "US", T0)] * 20
    df = signins(spark, rows)
    assert [r.principal for r in auth.failure_bursts(df).collect()] == ["u"]
    s = auth.burst_summary(df).first()
    assert s.event_count == 10 and s.principals == 1


def test_spray_needs_five_principals(spark):
    rows = [(f"u{i}", "s1", True, "US", T0) for i in range(5)] + [
        (f"u{i}", "s2", True, "US", T0) for i in range(4)]
    assert [r.source for r in auth.sprays(signins(spark, rows)).collect()] == ["s1"]


def test_impossible_travel_takes_the_first_adjacent_pair(spark):
    m = timedelta(minutes=1)
    rows = [("u", "", False, "US", T0), ("u", "", False, "de", T0 + 30 * m),
            ("u", "", False, "JP", T0 + 40 * m), ("v", "", False, "US", T0),
            ("v", "", False, "DE", T0 + 61 * m), ("w", "", True, "US", T0),
            ("w", "", False, "DE", T0 + m), ("x", "", False, None, T0)]
    got = auth.impossible_travel(signins(spark, rows)).collect()
    assert [(r.principal, r.country_from, r.country_to) for r in got] == [("u", "US", "DE")]


def test_dns_detectors(spark):
    names = [(f"{i:04d}aqzwsxedcr{i}.evil.com", "A", "NXDOMAIN", "30.0,90.0") for i in range(60)]
    dns = spark.createDataFrame(names + [("", "A", "NOERROR", "-"), (None, None, None, None)],
                                "query STRING, qtype_name STRING, rcode_name STRING, ttls STRING")
    t = net.dns_tunneling(dns).first()
    assert t.signals == 2 and t.confidence == "high"
    assert net.dns_short_ttl(dns).first().domain_count == 60
    assert net.dns_dga(dns, min_entropy=3.0).first().flagged_count == 60
    assert net.disposable_subdomains(dns.withColumnRenamed("query", "host")).first().host_count == 60
    assert net.dns_tunneling(dns.limit(0)).count() == 0


def test_http_ratios_on_empty_and_small_input(spark):
    http = spark.createDataFrame([("POST", "500", "evil-bot")] * 40 + [("GET", "x", None)] * 2,
                                 "method STRING, status_code STRING, user_agent STRING")
    assert net.http_post_ratio(http).first().posts == 40
    assert net.http_error_ratio(http).first().count_5xx == 40
    assert net.dominant_agent(http).first().user_agent == "evil-bot"
    assert net.http_post_ratio(http.limit(0)).count() == 0
    assert net.http_error_ratio(http.limit(5)).count() == 0


def test_web_detectors(spark):
    rows = ([("8.8.8.8", "POST", "/up/x.php", "", "200", "m", T0)] * 3
            + [("8.8.4.4", "GET", f"/p{i}", "", "404", "m", T0) for i in range(30)]
            + [("10.0.0.1", "GET", f"/p{i}", "", "404", "m", T0) for i in range(30)]
            + [("8.8.8.8", "GET", "/admin/", "", "200", "sqlmap", T0),
               ("10.1.1.1", "GET", "/admin/", "", "200", "m", T0),
               (None, None, None, None, None, None, None)])
    df = spark.createDataFrame(rows, "src STRING, method STRING, path STRING, query STRING, "
                               "status STRING, user_agent STRING, ts TIMESTAMP")
    got = {(r.rule_id, r.entity): r.event_count for r in web.web_hits(df).collect()}
    assert got[("WEB_UPLOAD_POST_BURST", "8.8.8.8 /up/x.php")] == 3
    assert got[("WEB_4XX_RECON_BURST", "8.8.4.4")] == 30
    assert ("WEB_4XX_RECON_BURST", "10.0.0.1") not in got
    assert got[("WEB_ADMIN_URI_HIT", "8.8.8.8")] == 1
    assert ("WEB_ADMIN_URI_HIT", "10.1.1.1") not in got
    assert got[("WEB_SCRIPTED_CLIENT_OFFENSIVE", "8.8.8.8")] == 1


def test_repeat_endpoint_signals(spark):
    rows = ([("20.40.1.1", 443, "CLOSED", "TCPv4", 50000 + i, 7) for i in range(4)]
            + [("9.9.9.9", 4444, "ESTABLISHED", "TCPv4", 50000, 7)] * 4
            + [("9.9.9.8", 4444, "CLOSED", "TCPv4", 50000, 7)] * 3
            + [("10.0.0.2", 389, "CLOSED", "TCPv4", 1, 1)] * 9
            + [("9.9.9.9", 3389, "CLOSED", "TCPv4", 1, 1)] * 9)
    df = spark.createDataFrame(rows, "foreign_addr STRING, foreign_port INT, state STRING, "
                               "proto STRING, local_port INT, pid INT")
    got = {r.foreign_addr: r for r in net.repeat_endpoints(df).collect()}
    assert set(got) == {"20.40.1.1", "9.9.9.9"}
    assert got["20.40.1.1"].provider == "Microsoft" and got["20.40.1.1"].low_signal
    assert got["9.9.9.9"].port_category == "registered" and not got["9.9.9.9"].low_signal
    assert got["9.9.9.9"].states == {"ESTABLISHED": 4}
    assert net.admin_port_sessions(df).first().service == "rdp"


def test_hits_have_the_common_schema(spark):
    from emberlog.operators.common import HIT_COLUMNS, to_hits
    bursts = auth.failure_bursts(signins(spark, [("u", "1", True, "US", T0)] * 10))
    hits = to_hits(bursts, "R", entity="principal", count="failures", hypotheses=["H_BRUTE_FORCE"],
                   techniques=["T1110"], facts=["failures"])
    assert hits.columns == HIT_COLUMNS
    row = hits.first()
    assert row.event_count == 10 and row.facts == {"failures": "10"}
