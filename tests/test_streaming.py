from datetime import datetime, timedelta


from emberlog.streaming import detectors as st

T0 = datetime(2024, 1, 1)


def test_windowed_failures_match_batch(spark, tmp_path):
    schema = "principal STRING, failed BOOLEAN, ts TIMESTAMP"
    rows = [("u", True, T0 + timedelta(minutes=i)) for i in range(50)] + [
        ("v", True, T0)] * 3 + [("end", False, T0 + timedelta(days=2)),
                                ("end", True, T0 + timedelta(days=2))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    st.run_to_table(st.windowed_failures(stream), str(tmp_path / "out"),
                    str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = st.windowed_failures(spark.read.parquet(src))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [r.failures for r in got.collect()] == [50]


def test_rankings_follow_new_findings(spark, tmp_path):
    cols = ("finding_id STRING, case_id STRING, host STRING, agent STRING, claim STRING, confidence "
            "STRING, tags ARRAY<STRING>, tools ARRAY<STRING>, categories ARRAY<STRING>, severity "
            "STRING, techniques ARRAY<STRING>, evidence_count INT")
    row = ("f1", "c", "h", "a", "mimikatz", "high", ["H_CREDENTIAL_ACCESS"], [], [], None, [], 1)
    src = str(tmp_path / "in")
    spark.createDataFrame([row], cols).write.parquet(src)
    args = (str(tmp_path / "ledger"), str(tmp_path / "rank"), str(tmp_path / "cp"))
    for n in (1, 2):
        stream = spark.readStream.schema(cols).parquet(src)
        st.refresh_rankings(stream, *args).awaitTermination()
        top = spark.read.parquet(f"{args[1]}/batch={n - 1}").filter("rank = 1").first()
        assert (top.hypothesis, top.score) == ("H_CREDENTIAL_ACCESS", 5 * n)
        spark.createDataFrame([("f2", *row[1:])], cols).write.mode("append").parquet(src)


def test_replaced_finding_counts_once(spark, tmp_path):
    cols = ("finding_id STRING, case_id STRING, host STRING, agent STRING, claim STRING, confidence "
            "STRING, tags ARRAY<STRING>, tools ARRAY<STRING>, categories ARRAY<STRING>, severity "
            "STRING, techniques ARRAY<STRING>, evidence_count INT")
    row = ("f1", "7", "h", "a", "mimikatz", "high", ["H_CREDENTIAL_ACCESS"], [], [], None, [], 1)
    src = str(tmp_path / "in")
    args = (str(tmp_path / "ledger"), str(tmp_path / "rank"), str(tmp_path / "cp"))
    for n in range(2):
        spark.createDataFrame([row], cols).write.mode("append").parquet(src)
        st.refresh_rankings(spark.readStream.schema(cols).parquet(src), *args).awaitTermination()
        top = spark.read.parquet(f"{args[1]}/batch={n}").filter("rank = 1").first()
        assert (top.case_id, top.hypothesis, top.score) == ("7", "H_CREDENTIAL_ACCESS", 5)
