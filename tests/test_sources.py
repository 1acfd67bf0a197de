import gzip
import json
import pathlib

from pyspark.sql import functions as F

from emberlog.plans import file_queries
from emberlog.sources import files as sf, json_logs as js, lines as ln


def text(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value STRING")


def test_zeek_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.log").write_text("#separator \\x09\n#fields\tts\tid.orig_h\tproto\n1.0\t1.1.1.1\ttcp\n2.0\t2.2.2.2\n#close\n")
    (tmp_path / "b.log").write_text("#fields\tuid\tts\nC1\t5.0\n\n")
    rows = ln.read_zeek(spark, str(tmp_path)).select("row").collect()
    got = sorted((dict(r.row) for r in rows), key=str)
    assert {"ts": "2.0", "id.orig_h": "2.2.2.2", "proto": ""} in got
    assert {"uid": "C1", "ts": "5.0"} in got and len(got) == 3


def test_zeek_header_in_force_and_separator(spark, tmp_path):
    (tmp_path / "a.log").write_text("#fields\tts\tuid\n1\ta\n#fields\tuid\tts\nb\t2\n")
    (tmp_path / "b.log").write_text("lost\n#separator \\x2c\n#fields,ts,uid\n3,c\n")
    got = sorted((r.row["ts"], r.row["uid"]) for r in ln.read_zeek(spark, str(tmp_path)).collect())
    assert got == [("1", "a"), ("2", "b"), ("3", "c")]


def test_w3c_header_change_and_gzip_access_log(spark, tmp_path):
    (tmp_path / "u.log").write_text(
        "#Software: IIS\n#Fields: date time c-ip cs-method cs-uri-stem sc-status cs(User-Agent)\n"
        "2024-01-02 03:04:05 8.8.8.8 GET /cmd.aspx 200 curl\n"
        "#Fields: c-ip cs-uri-stem\n9.9.9.9 /x\n")
    rows = {r.src: r for r in ln.web_rows(ln.read_w3c(spark, str(tmp_path))).collect()}
    assert rows["8.8.8.8"].user_agent == "curl" and str(rows["8.8.8.8"].ts) == "2024-01-02 03:04:05"
    assert rows["9.9.9.9"].path == "/x" and rows["9.9.9.9"].status == ""
    gz = tmp_path / "g"
    gz.mkdir()
    with gzip.open(gz / "access.log.1.gz", "wt") as f:
        f.write('1.2.3.4 - - [02/Jan/2024:03:04:05 +0100] "GET /a?b=c HTTP/1.1" 200 12\nbroken\n')
    got = ln.parse_access(ln.read_lines(spark, str(gz))).first()
    assert (got.path_only, got.query, got.bytes, got.user_agent) == ("/a", "b=c", 12, None)
    assert str(got.ts) == "2024-01-02 02:04:05"


def test_syslog_forms(spark):
    rows = ln.parse_syslog(text(
        spark, "<34>1 2024-01-02T03:04:05Z h su 1 ID47 - failed", "<13>Jan  2 03:04:05 h cron[9]: ok",
        "Jan  2 03:04:05 h app: no pri", "garbage")).collect()
    assert [(r.facility, r.severity, r.app, r.message) for r in rows] == [
        (4, 2, "su", "failed"), (1, 5, "cron", "ok"), (None, None, "app", "no pri")]


def test_vpc_and_bodyfile_drop_short_rows(spark):
    good = "2 123 eni 10.0.0.1 8.8.8.8 5000 22 6 1 840 1700000000 1700000060 ACCEPT OK"
    assert ln.parse_vpc_flow(text(spark, good, "2 too short", "# x")).count() == 1
    body = "0|/a b|1|r/rrw|0|0|77|1|2|3|4"
    r = ln.parse_bodyfile(text(spark, body, "x|y")).collect()
    assert [(x.path, x.size, x.crtime) for x in r] == [("/a b", 77, 4)]


def test_auditd_grouping(spark):
    rows = ln.parse_auditd(text(
        spark, 'type=SYSCALL msg=audit(1.500:7): auid=1000 key="k"',
        'type=EXECVE msg=audit(1.500:7): argc=1 a0="/bin/nc"', "type=EXECVE broken"), []).collect()
    assert len(rows) == 1 and [r.type for r in rows[0].records] == ["EXECVE", "SYSCALL"]


def test_event_xml_single_and_many_data(spark, tmp_path):
    one = ('<Event><System><EventID>10</EventID><Channel>Sysmon</Channel><Computer>pc</Computer>'
           '<TimeCreated SystemTime="2024-01-02T03:04:05Z"/></System><EventData>{}</EventData></Event>')
    data = '<Data Name="TargetImage">lsass.exe</Data>'
    (tmp_path / "e.xml").write_text("<Events>" + one.format(data) + one.format(
        data + '<Data Name="GrantedAccess">0x1410</Data>') + "</Events>")
    rows = ln.read_event_xml(spark, str(tmp_path / "e.xml")).collect()
    assert sorted(len(r.data) for r in rows) == [1, 2] and rows[0].event_id == 10


def test_evtx_csv_skips_rows_without_id(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "TimeCreated,EventId,Channel,Computer,PayloadData1\n2024-01-02 03:04:05,4624,Security,pc,\"a,b\"\n"
        "2024-01-02 03:04:05,x,Security,pc,z\n")
    rows = ln.read_evtx_csv(spark, str(tmp_path)).collect()
    assert [(r.event_id, r.payload) for r in rows] == [(4624, {"PayloadData1": "a,b"})]


def test_cloud_wrappers_and_bad_json(spark):
    rec = {"userPrincipalName": "A@x", "status": {"errorCode": 50126}}
    got = js.signin_rows(js.cloud_records(text(
        spark, json.dumps([rec]), json.dumps({"value": [rec, rec]}), json.dumps(rec), "{bad", "[]")))
    assert got.count() == 4 and got.filter("failed").count() == 4
    assert got.first().principal == "a@x"


def test_ual_address_and_parameters(spark):
    rec = {"Operation": "New-InboxRule", "UserId": "U", "ClientIP": "[2001:db8::1]:443",
           "AuditData": json.dumps({"Parameters": [{"Name": "ForwardTo", "Value": "a@b.com"}]})}
    r = js.ual_rows(js.cloud_records(text(spark, json.dumps(rec)))).first()
    assert r.source == "2001" and r.params == {"forwardto": "a@b.com"}


def test_cloudtrail_documents(spark, tmp_path):
    doc = {"Records": [{"eventName": "ConsoleLogin", "eventTime": "2024-01-02T03:04:05Z",
                        "userIdentity": {"arn": "a"}, "responseElements": {"ConsoleLogin": "Failure"}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(json.dumps(doc))
    rows = js.cloudtrail_rows(js.read_documents(spark, str(tmp_path))).collect()
    assert [r.console_login for r in rows] == ["Failure"] * 2


def test_stix_patterns(spark):
    doc = {"objects": [{"type": "indicator", "pattern":
                        "[ipv4-addr:value = '1.2.3.4'] OR [file:hashes.'SHA-256' = 'ab']"},
                       {"type": "malware", "name": "m"}]}
    got = {(r.ioc_type, r.value) for r in js.stix_indicators(text(spark, json.dumps(doc))).collect()}
    assert got == {("ipv4", "1.2.3.4"), ("sha256", "ab")}


def test_listing_and_router(spark, tmp_path):
    (tmp_path / "fw.log").write_text("x %ASA-4-106023: Deny tcp\n")
    (tmp_path / "a.json").write_text('{"object": "P", "action": "C"}')
    (tmp_path / "n.bin").write_bytes(b"\x00\x01")
    rows = sf.route_files(sf.read_file_listing(spark, str(tmp_path))).collect()
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in rows}
    assert got == {"fw.log": "asa", "a.json": "ecar", "n.bin": None}
    assert all(len(r.sha256) == 64 for r in rows)


def test_collection_profile(spark):
    df = spark.createDataFrame([("a", '{"Timestamp": "2024-01-02T03:04:05Z", "x": 1}'), ("a", "{}"),
                                ("a", "no")], "artifact STRING, value STRING")
    r = sf.collection_profile(df).first()
    assert (r.rows, r.columns) == (2, 2) and str(r.first_seen) == "2024-01-02 03:04:05"


def test_rank_list_first_rank_wins(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,Google.com\n2,x.org.\n9,google.com\nbad,y.org\n")
    got = {r.domain: r["rank"] for r in ln.read_rank_list(spark, str(tmp_path)).collect()}
    assert got == {"google.com": 1, "x.org": 2}


def test_large_files_are_listed_in_chunks(spark, tmp_path):
    import hashlib
    big, small = tmp_path / "big.bin", tmp_path / "a b.txt"
    with big.open("wb") as f:
        f.write(b"MZ first")
        f.truncate((1 << 31) + 7)  # a sparse file of more than 2 GiB
    small.write_bytes(b"x" * 5000)
    (tmp_path / "empty").write_bytes(b"")
    sha = hashlib.sha256()
    with big.open("rb") as f:
        while chunk := f.read(1 << 22):
            sha.update(chunk)
    got = {r["path"].rsplit("/")[-1]: r for r in sf.read_file_listing(spark, str(tmp_path)).collect()}
    assert got["big.bin"]["size"] == (1 << 31) + 7 and got["big.bin"]["sha256"] == sha.hexdigest()
    assert got["big.bin"]["head"] == b"MZ first" + bytes(4088) and set(got) >= {"big.bin"} and len(got) == 2
    text = next(r for n, r in got.items() if n.endswith("b.txt"))
    assert text["sha256"] == hashlib.sha256(b"x" * 5000).hexdigest() and len(text["head"]) == 4096
    assert "sha256" not in sf.read_file_listing(spark, str(tmp_path), digest=False).columns


def test_csv_profile_and_samples(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"na""me",Timestamp\n1,"x, y",2024-01-02T00:00:00Z\n\n2,"say ""hi""",2024-01-01T00:00:00Z\n3\n')
    (tmp_path / "b.csv").write_text("only\n" + "".join(f"{i}\n" for i in range(500)) + "z" * 300 + "\n")
    (tmp_path / "c.csv").write_text("")
    for parts in (1, 7):
        spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000 // parts ** 2)
        got = {r["artifact"]: r for r in sf.csv_profile(spark, str(tmp_path), sample=3).collect()}
        if parts == 1:
            first = got
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == first and set(got) == {"a.csv", "b.csv"}
    assert (got["a.csv"]["rows"], got["a.csv"]["columns"], got["b.csv"]["rows"], got["b.csv"]["columns"]) == (3, 3, 501, 1)
    assert str(got["a.csv"]["first_seen"]) == "2024-01-01 00:00:00" and got["b.csv"]["first_seen"] is None
    assert sorted(got["a.csv"]["sample"]) == [
        '{"id":"1","na\\"me":"x, y","Timestamp":"2024-01-02T00:00:00Z"}',
        '{"id":"2","na\\"me":"say \\"hi\\"","Timestamp":"2024-01-01T00:00:00Z"}', '{"id":"3","na\\"me":null,"Timestamp":null}']
    rows = [("x", f'{{"k": {i}}}') for i in range(100)] + [("y", "{}"), ("y", "nope")]
    df = spark.createDataFrame(rows, "artifact string, value string")
    samples = [{r["artifact"]: r["sample"] for r in sf.collection_profile(df.repartition(n), sample=4).collect()} for n in (1, 9)]
    assert samples[0] == samples[1] and len(samples[0]["x"]) == 4 and samples[0]["y"] == ["{}"]


def test_csv_profile_reads_lines_twice_and_parses_headers_once(spark, tmp_path):
    parallelism = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(parallelism)
    for folder, name, text in (
            ("a1", "x", "id,Timestamp\n1,2024-01-02T00:00:00Z\n\n2,2024-01-01T00:00:00Z\n"),
            ("a2", "y", "\n  \nid,EventTime,Timestamp\n3,2024-03-01T00:00:00Z,\n4\n5,2023-05-01T00:00:00Z,2025-01-01T00:00:00Z\n"),
            ("a3", "z", "only,header,here\n"), ("b", "w", "n,n\n1,2\n1,2\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{name}.csv").write_text(text)
    artifact = F.regexp_extract("path", "/([a-z])[0-9]*/[a-z].csv", 1)
    got = sf.csv_profile(spark, str(tmp_path), artifact)
    assert got.columns == ["artifact", "rows", "first_seen", "last_seen", "columns"]
    rows = {r["artifact"]: (r["rows"], str(r["first_seen"]), str(r["last_seen"]), r["columns"]) for r in got.collect()}
    # a header without rows gives no columns; a name that comes twice is one
    assert rows == {"a": (5, "2024-01-01 00:00:00", "2025-01-01 00:00:00", 3), "b": (2, "None", "None", 1)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert spark.conf.get(parallelism) == before


def test_written_files_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "scratch_path", lambda session, name: str(tmp_path / name))
    names = ["7-1", "a b.log", "x=1/y:2", "50%", "{[^]}", "\u00e9\u2603", "q\"'*?#\\", "", None, "t\tn"]
    rows = spark.createDataFrame([(i, n, f"line {i} \u00fc") for i in range(3) for n in names], "id INT, name STRING, line STRING")
    at = file_queries.written(spark, rows, F.col("name"), "id", F.col("line"), "new")
    text = "\n".join(f"line {i} \u00fc" for i in range(3))
    frame = spark.createDataFrame([(n, text) for n in names if n], "name STRING, value STRING")
    frame.write.partitionBy("name").text(str(tmp_path / "spark"))

    def found(folder):
        return {f.parent.name: b"".join(x.read_bytes() for x in f.parent.glob("*.txt")) for f in pathlib.Path(folder).rglob("*.txt")}
    got = found(at)
    assert len(got.pop("name=__HIVE_DEFAULT_PARTITION__").splitlines()) == 6
    assert got == found(tmp_path / "spark") and len(got) == 8
    assert not [f for f in pathlib.Path(at).rglob("*.crc")]  # Spark's writer makes these, and a process for each file
