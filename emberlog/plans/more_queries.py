"""Queries for the remaining joins: modules, drives, roles, scopes, owners and fuzzy hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import endpoint, joins, similarity
from emberlog.plans.adapters import EVENT_K, events, table
from emberlog.plans.registry import query

E = f"e AS (SELECT *, {EVENT_K} FROM events)"


@query("unlinked_modules", f"""WITH {E} SELECT event_id FROM e WHERE k % 2 = 1 AND k % 3 = 0""")
def unlinked_modules(spark, sf):
    m = events(spark, sf).select("event_id", F.when(F.col("k") % 2 == 0, "True").otherwise(
        "False").alias("in_load"), (F.col("k") % 3 == 0).alias("in_mem"))
    return joins.unlinked_modules(m).select("event_id")


@query("removable_staging", f"""WITH {E},
o AS (SELECT event_id, 'h' || user_id % 20 AS host, CASE k % 3 WHEN 0 THEN 'E' ELSE 'C' END AS d,
  CASE WHEN k % 4 = 0 THEN 'vibranium' WHEN k % 4 = 1 THEN 'project' END AS fragment FROM e),
r AS (SELECT DISTINCT 'h' || s_suppkey % 20 AS host FROM supplier WHERE s_nationkey < 10)
SELECT event_id, host, fragment FROM o JOIN r USING (host) WHERE d = 'E'
AND fragment IS NOT NULL""")
def removable_staging(spark, sf):
    k = F.col("k")
    opened = events(spark, sf).select("event_id", F.concat(F.lit("h"), F.col("user_id") % 20).alias(
        "host"), F.concat(F.when(k % 3 == 0, "e:\\").otherwise("C:\\"), F.when(
            k % 4 == 0, "Vibranium\\a.docx").when(k % 4 == 1, "my project\\b.docx").otherwise(
            "c.txt")).alias("path"))
    drives = table(spark, sf, "supplier").filter("s_nationkey < 10").select(
        F.concat(F.lit("h"), F.col("s_suppkey") % 20).alias("host"), F.lit("E").alias("drive"))
    return joins.removable_staging(opened, drives, ["vibranium", "project"]).select(
        "event_id", "host", "fragment")


@query("role_assignments", """
WITH p AS (SELECT c_custkey AS id, c_name AS name, c_nationkey % 2 = 0 AS is_guest, CASE
  c_mktsegment WHEN 'MACHINERY' THEN 'Global Administrator' ELSE 'Reader' END AS m FROM customer),
g AS (SELECT o_custkey AS principal_id, CASE o_orderpriority WHEN '1-URGENT' THEN
  'Security Administrator' ELSE 'Reader' END AS role FROM orders
  UNION SELECT id, m FROM p)
SELECT principal_id, role, name, is_guest FROM g JOIN p ON id = principal_id
WHERE role <> 'Reader'""")
def role_assignments(spark, sf):
    p = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") % 2 == 0, "Guest").otherwise("Member").alias("user_type"),
        F.array(F.when(F.col("c_mktsegment") == "MACHINERY", "Global Administrator").otherwise(
            "Reader")).alias("member_of"))
    g = table(spark, sf, "orders").select(F.col("o_custkey").alias("principal_id"), F.when(
        F.col("o_orderpriority") == "1-URGENT", "Security Administrator").otherwise(
        "Reader").alias("role"))
    return joins.role_grants(p, g, ["global administrator", "security administrator"])


@query("risky_scopes", f"""WITH {E} SELECT event_id, 'mail.readwrite' AS risky FROM e
WHERE k % 4 = 0""")
def risky_scopes(spark, sf):
    g = events(spark, sf).select("event_id", F.when(
        F.col("k") % 4 == 0, "User.Read  Mail.ReadWrite").otherwise("User.Read").alias("scope"))
    return joins.risky_scopes(g, ["Mail.ReadWrite", "Files.ReadWrite.All"]).select(
        "event_id", F.array_join("risky", ",").alias("risky"))


@query("unknown_owners", f"""WITH {E} SELECT 'h' || user_id AS host, 'SSDT' AS table_name, count(*)
AS entries FROM e WHERE k % 5 IN (0, 1) GROUP BY user_id""")
def unknown_owners(spark, sf):
    k = F.col("k") % 5
    rows = events(spark, sf).select(
        F.concat(F.lit("h"), "user_id").alias("host"), F.lit("SSDT").alias("table_name"),
        F.when(k == 0, "UNKNOWN").when(k == 1, "").otherwise("ntoskrnl").alias("owner"))
    return endpoint.unknown_owners(rows)


@query("similar_fuzzy_hashes")
def similar_fuzzy_hashes(spark, sf):
    return similarity.fuzzy_neighbours(similarity.fuzzy_digests(table(spark, sf, "documents")))


@query("similar_locality_hashes")
def similar_locality_hashes(spark, sf):
    def level(i):  # of each dimension by itself, as an array of all levels would be made anew for each digit
        x = F.get("embedding", F.lit(i))
        return F.when(F.size("embedding") > i, F.when(x < -0.1, 0).when(x < 0, 1).when(x < 0.1, 2).otherwise(3))
    digit = [F.lower(F.hex((level(2 * i) * 4 + level(2 * i + 1)).cast("bigint"))) for i in range(32)]
    body = F.repeat(F.concat(*digit), 2)
    d = table(spark, sf, "embeddings").select(
        F.concat(F.lit("T10000"), F.lit("00"), body).alias("tlsh"), "label")
    return similarity.tlsh_neighbours(d, d.filter("label = 0"), 110)
