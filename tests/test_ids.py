import json

from emberlog.operators import ids
from emberlog.sources import json_logs as js

T = "2024-01-01T00:00:0%d.000000+0000"


def event(second, kind, **more):
    return json.dumps({"timestamp": T % second, "event_type": kind, "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", **more})


def test_facets_and_signatures(spark):
    def alert(second, sid="7", severity=2, src="1.1.1.1", port=80, **more):
        return event(second, "alert", dest_port=port, **{"alert": {
            "signature_id": sid, "signature": "s", "severity": severity, "category": f"c{second}", **more}}) .replace(
            '"src_ip": "1.1.1.1"', f'"src_ip": "{src}"')
    lines = [alert(3), alert(1, severity=0, port="443"), alert(5, src="0.0.0.9", port="x", metadata={
        "mitre_technique_id": ["T2", "T1"], "mitre_attack_technique_id": ["T1"]}), alert(2, sid="oops"),
        event(1, "HTTP", http={"hostname": "h", "http_user_agent": "a"}), event(1, "dns", dns={"type": "answer", "rrname": "no"}),
        event(1, "dns", dns={"type": "query", "rrname": "q"}), event(1, "dns", dns={"query": "old"}),
        event(1, "tls", tls={"sni": "s"}), event(1, "anomaly", anomaly={"event": "", "type": "t"}), "{}",
        "not json", '{"event_type": "http"', "", "17", None]
    events = js.eve_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    counts = ids.facet_counts(events)
    facets = {(r["facet"], r["value"]): r["n"] for r in ids.top_facets(counts).collect()}
    assert facets == {
        ("event_type", "alert"): 4, ("event_type", "http"): 1, ("event_type", "dns"): 3, ("event_type", "tls"): 1,
        ("event_type", "anomaly"): 1, ("event_type", ""): 1, ("src_ip", "1.1.1.1"): 9, ("src_ip", "0.0.0.9"): 1,
        ("dest_ip", "2.2.2.2"): 10, ("http_host", "h"): 1, ("http_agent", "a"): 1, ("dns_query", "q"): 1,
        ("dns_query", "old"): 1, ("tls_sni", "s"): 1, ("anomaly", "t"): 1}
    found = {r["signature_id"]: r for r in ids.signature_clusters(counts).collect()}
    seven = found[7]
    assert set(found) == {0, 7} and seven["event_count"] == 3 and seven["severity"] == 3 and seven["category"] == "c1"
    assert seven["src_ips"] == ["0.0.0.9", "1.1.1.1"] and seven["dest_ports"] == ["80", "443"]
    assert seven["techniques"] == ["T1", "T2"] and (seven["first_seen"].second, seven["last_seen"].second) == (1, 5)
    assert ids.signature_clusters(counts, 1).filter("signature_id = 7").collect()[0]["dest_ports"] == ["80"]
    assert ids.top_facets(counts, 1).filter("facet = 'dns_query'").collect()[0]["value"] == "old"
