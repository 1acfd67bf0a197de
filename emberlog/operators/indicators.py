"""Indicators in text: extraction, noise filters, popularity, registries and cross-case views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import functions as fn
from emberlog.fixed import indicators as fx
from emberlog.operators.common import explode_rows, small

WORD = r"\p{L}\p{N}_"
HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}
PATH_TYPES = ["ipv4", "ipv6", "md5", "sha1", "sha256", "regkey", "winpath"]


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _when(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(F.array().cast("array<string>"))


def _hex_runs(text: Column, kind: str) -> Column:
    n = HASH_LENGTHS[kind]
    runs = _when(text.rlike("[A-Fa-f0-9]{%d}" % n), _all(text, "[A-Fa-f0-9]{%d,}" % n))
    return F.transform(F.filter(runs, lambda h: F.length(h) == n), F.lower)


def raw_indicators(text: Column) -> dict[str, Column]:
    """One array per type. A cheap test comes first, so most texts skip most patterns.

    Tokens that must not touch further token characters are taken as whole runs or guarded by
    lookarounds, which is the same thing; the word class is the Unicode one.
    """
    found = {
        "ipv4": _all(text, r"(?<![0-9.])" + fx.IPV4 + r"(?![0-9.])"),
        "ipv6": F.filter(_when(text.contains("::") | text.rlike("(:[0-9A-Fa-f]{1,4}){3}"), _all(
            text, f"(?<![{WORD}:])" + fx.IPV6 + f"(?![{WORD}:])")), lambda v: F.length(v) > 4),
        "domain": _all(text, f"(?<![{WORD}.-])" + fx.DOMAIN + f"(?![{WORD}-])"),
        "url": _when(text.contains("://"), _all(text, fx.URL)),
        "md5": _hex_runs(text, "md5"),
        "sha1": _hex_runs(text, "sha1"),
        "sha256": F.filter(_hex_runs(text, "sha256"), lambda h: ~h.isin(fx.CURVE_CONSTANTS)),
        "email": _when(text.contains("@"), _all(text, fx.EMAIL)),
        "regkey": _when(text.rlike("(?i)HK(LM|CU|U|CR|CC|EY_)"), F.transform(
            _all(text, fx.REGISTRY_KEY), lambda v: F.regexp_replace(v, r"\\+$", ""))),
        "winpath": _when(text.contains(":\\"), _all(text, fx.WINDOWS_PATH)),
        "btc_legacy": _all(text, "(?<![A-Za-z0-9])" + fx.BTC_LEGACY + "(?![A-Za-z0-9])"),
        "btc_bech32": _when(text.contains("bc1"), _all(
            text, "(?<![a-z0-9])" + fx.BTC_BECH32 + "(?![a-z0-9])")),
        "aws_access_key": _all(text, "(?<![A-Z0-9])" + fx.AWS_KEY_ID + "(?![A-Z0-9])"),
        "aws_secret_key": _when(text.rlike("(?i)aws[_-]?secret"), _all(
            text, fx.AWS_SECRET + "(?![A-Za-z0-9/+=])", 1)),
    }
    return found


def varied(token: Column, kind: str) -> Column:
    """Enough distinct characters to be a real value of its kind."""
    least = fx.MIN_DISTINCT.get(kind)
    return F.lit(True) if least is None else fn.distinct_chars(token) >= least


def _varied_only(values: Column, kind: str) -> Column:
    return F.filter(values, lambda v: varied(v, kind))


def ipv4_ok(ip: Column) -> Column:
    return ~ip.rlike(fx.PRIVATE_PREFIX) & ~ip.rlike(r"^[0-9]+\.0\.0\.0$")


def domain_ok(name: Column, tlds=None) -> Column:
    """A name that is no file name, protocol field, system name or padding.

    `tlds` is the list of public top-level domains, over a thousand and ever changing; without it
    every last label of two letters or more passes that is no file extension.
    """
    d = F.regexp_replace(F.lower(name), r"\.+$", "")
    last = F.substring_index(d, ".", -1)
    listed = last.isin(list(tlds)) if tlds is not None else (
        last.rlike("^(?:[a-z]{2,63}|xn--[a-z0-9-]{1,59})$"))
    prefixes = "|".join(p.replace(".", r"\.") for p in fx.NOISE_PREFIXES)
    noise = "|".join(n.replace(".", r"\.") for n in fx.NOISE_DOMAINS)
    return (d.contains(".") & ~last.rlike("^[0-9]+$")
            & ~last.isin(fx.FILE_EXTENSIONS) & (listed | last.isin(fx.INTERNAL_TLDS))
            & ~d.rlike(rf"(?:^|\.)(?:{noise})$") & ~d.isin(fx.OID_NAMES)
            & ~d.rlike(f"^(?:{prefixes})")
            & ~d.rlike(f"^(?:{'|'.join(fx.SYSTEM_NAME_PREFIXES)})")
            & ~(d.rlike(r"^[0-9]{1,3}\.") & last.contains("x"))
            & d.rlike(r"(?:^|\.)(?=[^.]*[^.0-9])[^.]{3,}(?:\.|$)") & ~d.rlike(r"([^.])\1{3}"))


def legacy_wallet_ok(a: Column) -> Column:
    body = F.substring(a, 2, 99)
    return body.rlike("[0-9]") & body.rlike("[A-Z]") & body.rlike("[a-z]")


def _clean(found: dict[str, Column], tlds) -> dict[str, Column]:
    def keep(kind, test):
        return F.filter(found[kind], test)
    out = dict(found)
    out["ipv4"] = keep("ipv4", ipv4_ok)
    out["domain"] = F.transform(keep("domain", lambda d: domain_ok(d, tlds)),
                                lambda d: F.regexp_replace(F.lower(d), r"\.+$", ""))
    out["url"] = keep("url", lambda u: domain_ok(F.split_part(u, F.lit("/"), F.lit(3)), tlds))
    for kind in HASH_LENGTHS:
        out[kind] = _varied_only(found[kind], kind)
    out["btc_legacy"] = keep("btc_legacy", lambda a: legacy_wallet_ok(a) & varied(a, "btc"))
    out["btc_bech32"] = keep("btc_bech32", lambda a: varied(a, "btc"))
    return out


def extract_indicators(rows: DataFrame, text: str = "text", keep=(), drop_noise: bool = True,
                       path_listing: bool = False, tlds=None) -> DataFrame:
    """Distinct (type, value) pairs of every row, with the kept columns.

    Path listings are searched for addresses, hashes, registry keys and paths only.
    """
    refanged = rows.select(*keep, fn.refang(F.col(text)).alias("_t"))
    found = raw_indicators(F.col("_t"))
    if path_listing:
        found = {k: v for k, v in found.items() if k in PATH_TYPES}
        if drop_noise:
            cleaned = {"ipv4": F.filter(found["ipv4"], ipv4_ok), **{
                k: _varied_only(found[k], k) for k in HASH_LENGTHS}}
            found = {**found, **cleaned}
    elif drop_noise:
        found = _clean(found, tlds)

    def tagged(kind, values):
        name = "btc" if kind.startswith("btc") else kind
        return F.transform(F.array_distinct(values), lambda v: F.struct(
            F.lit(name).alias("ioc_type"), v.alias("value")))
    pairs = F.concat(*[tagged(k, v) for k, v in found.items()])
    return explode_rows(refanged, pairs, "i", *keep).select(*keep, "i.ioc_type", "i.value")


def extract_more(rows: DataFrame, text: str = "text", keep=()) -> DataFrame:
    """Wallets of further chains, onion names, CVE ids, handles, phones and other identifiers."""
    def found(kind, patterns):
        hits = F.array_distinct(F.flatten(F.array(*[_all(F.col(text), p) for p in patterns])))
        return F.transform(F.filter(hits, lambda v: varied(v, kind)), lambda v: F.struct(
            F.lit(kind).alias("ioc_type"), v.alias("value")))
    pairs = F.concat(*[found(k, p) for k, p in fx.EXTRA_PATTERNS.items()])
    return explode_rows(rows, pairs, "i", *keep).select(*keep, "i.ioc_type", "i.value")


def fact_addresses(facts: DataFrame, keep=("case_id",)) -> DataFrame:
    """IPv4 addresses under the address keys of a fact map; private ones stay."""
    from emberlog.fixed.case import ADDRESS_KEYS
    values = F.filter(F.array(*[F.try_element_at("facts", F.lit(k)) for k in ADDRESS_KEYS]),
                      lambda v: v.isNotNull())
    first = F.transform(values, lambda v: F.regexp_extract(
        v, "(?<![0-9.])" + fx.IPV4 + "(?![0-9.])", 0))
    return facts.select(*keep, F.explode(F.array_distinct(F.filter(
        first, lambda v: v != ""))).alias("value")).withColumn("ioc_type", F.lit("ipv4"))


def host_of(ioc_type: Column, value: Column) -> Column:
    """Host an indicator is anchored to: the domain itself or the URL's host."""
    url_host = F.regexp_extract(value, r"^(?:[^:/]*://)?([^/?]*)", 1)
    return F.regexp_replace(F.lower(
        F.when(ioc_type == "domain", value).when(ioc_type == "url", url_host)), r"\.+$", "")


def drop_popular(iocs: DataFrame, ranks: DataFrame, threshold: int = 50_000) -> DataFrame:
    """Domains and URLs without those whose host ranks within the threshold.

    The ranking is broadcast only while its expected size is small; otherwise Spark shuffles.
    """
    top = ranks.filter(F.col("rank") <= threshold).select(F.col("domain").alias("_host"))
    return iocs.withColumn("_host", host_of(F.col("ioc_type"), F.col("value"))).join(
        small(top), "_host", "left_anti").drop("_host")


def union_indicators(parts) -> DataFrame:
    """Distinct indicators of several sources; well-known curve constants drop out of the hashes."""
    merged = reduce(lambda a, b: a.unionByName(b), parts).select(
        "case_id", "ioc_type", "value").distinct()
    constants = F.col("value").isin(fx.CURVE_CONSTANTS)
    return merged.filter(~((F.col("ioc_type") == "sha256") & constants))


# --- registry ---------------------------------------------------------------------------------

def unseen(observed: DataFrame, registry: DataFrame, key) -> DataFrame:
    """One row per key that the registry does not hold yet (insert-or-ignore)."""
    fresh = observed.dropDuplicates(list(key))
    return fresh.join(registry.select(*key), list(key), "left_anti")


def prior_cases(iocs: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry view of each indicator of a case: cases, first seen, feeds, sealed cases.

    Both sides are merged per (value, case) before the join; self matches are taken out by
    arithmetic, so a value known from very many cases never fans out into pairs.
    """
    key = ["ioc_type", "value"]
    per_case = registry.groupBy(*key, "case_id").agg(F.min("observed").alias("observed"))
    feed = F.col("case_id").startswith("feed:")
    totals = per_case.groupBy(*key).agg(
        F.count("*").alias("cases"), F.count_if(feed).alias("feeds"),
        F.min("observed").alias("first_seen"))
    mine = iocs.select("case_id", *key).distinct()
    own = per_case.select(*key, "case_id", F.lit(1).alias("own"))
    return mine.join(totals, key).join(own, [*key, "case_id"], "left").select(
        "case_id", *key, (F.col("cases") - F.coalesce("own", F.lit(0))).alias("prior_cases"),
        "feeds", "first_seen")


def cross_case_overlap(iocs: DataFrame, registry: DataFrame) -> DataFrame:
    """Low-confidence overlap rows: indicators known from other cases, ubiquitous ones dropped."""
    from emberlog.operators.intel import rarity_bucket
    seen = prior_cases(iocs, registry).filter(F.col("prior_cases") > 0)
    return seen.withColumn("bucket", rarity_bucket(F.col("prior_cases"))).filter(
        F.col("bucket") != "ubiquitous").withColumn(
        "origin", F.when(F.col("feeds") == F.col("prior_cases"), "feed").otherwise("case"))


# --- DNS answers -------------------------------------------------------------------------------

def resolved_pairs(dns: DataFrame) -> DataFrame:
    """Distinct (domain, ip) pairs of the answers."""
    answer = F.trim(F.col("a"))
    return dns.select(F.regexp_replace(F.lower(F.trim("query")), r"\.+$", "").alias("domain"),
                      F.explode(F.split("answers", ",")).alias("a")).select(
        "domain", answer.alias("ip")).filter(
        (F.col("domain") != "") & F.col("ip").rlike(f"^{fx.IPV4}$")).distinct()


def enrich_with_dns(iocs: DataFrame, dns: DataFrame) -> DataFrame:
    """Indicators with the number of names or addresses DNS ties them to, and the first of them."""
    pairs = resolved_pairs(dns)
    by_ip = pairs.groupBy(F.lit("ipv4").alias("ioc_type"), F.col("ip").alias("value")).agg(
        F.count("*").alias("linked"), F.min("domain").alias("first_link"))
    by_name = pairs.groupBy(F.lit("domain").alias("ioc_type"), F.col("domain").alias("value")).agg(
        F.count("*").alias("linked"), F.min("ip").alias("first_link"))
    return iocs.join(by_ip.unionByName(by_name), ["ioc_type", "value"], "left").withColumn(
        "relation", F.when(F.col("linked").isNotNull(), F.when(
            F.col("ioc_type") == "ipv4", "resolved_from").otherwise("resolved_to")))


def answers_of(dns: DataFrame) -> DataFrame:
    """Distinct (name, answer, is_address) of a log: lower-case names, answers as they are listed."""
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")
    rows = dns.select(name("query").alias("name"), F.explode(F.split("answers", ",")).alias("a")).select(
        "name", F.trim("a").alias("a"))
    # of 2 to 8 groups with at most one gap; a colon never stands in a name
    address = F.col("a").rlike(f"^{fx.IPV4}$") | F.col("a").rlike(r"^(?=.*:.*:)[0-9A-Fa-f:]{2,39}$")
    host = F.col("a").rlike(r"^(?=.*[A-Za-z])[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+\.?$")
    return rows.filter(F.col("name") != "").filter(address | host).select(
        "name", F.when(address, F.lower("a")).otherwise(name("a")).alias("answer"), address.alias(
            "is_address")).filter(F.col("name") != F.col("answer")).distinct()


def closed_aliases(aliases: DataFrame) -> DataFrame:
    """All names that each name leads to over aliases (name, answer), with the least number of steps.

    Pointer jumping: paths join paths, so a chain of n aliases is closed after log2(n) rounds; each round's
    paths are written to the shared folder, where the next reads them. Loops end, as no pair is new.
    """
    from emberlog.session import scratch_path
    spark = aliases.sparkSession

    def kept(paths: DataFrame) -> DataFrame:
        path = scratch_path(spark, "aliases")
        paths.write.parquet(path)
        return spark.read.schema(paths.schema).parquet(path)

    paths = kept(aliases.select("name", "answer", F.lit(1).alias("steps")))
    n = paths.count()
    while n:
        onward = paths.select(F.col("name").alias("answer"), F.col("answer").alias("then"), F.col("steps").alias("more"))
        longer = paths.join(onward, "answer").filter("name <> then").select(
            "name", F.col("then").alias("answer"), (F.col("steps") + F.col("more")).alias("steps"))
        paths = kept(paths.unionByName(longer).groupBy("name", "answer").agg(F.min("steps").alias("steps")))
        before, n = n, paths.count()
        if n == before:
            break
    return paths


def dns_links(dns: DataFrame, follow: bool = True) -> DataFrame:
    """Every link between a name and an address, in both directions: ioc_type, value, relation, linked, aliases.

    `aliases` is the least number of alias answers on the way, 0 for an address in the name's own answer.
    With `follow`, a name also has the addresses of all names that its aliases lead to; without it only
    its own answers count. Addresses are IPv4 and IPv6 literals in lower case.
    """
    answers = answers_of(dns)
    own = answers.filter("is_address").select("name", F.col("answer").alias("address"), F.lit(0).alias("aliases"))
    if follow:
        chains = closed_aliases(answers.filter("NOT is_address"))
        far = chains.join(own.select(F.col("name").alias("answer"), "address"), "answer").select(
            "name", "address", F.col("steps").alias("aliases"))
        own = own.unionByName(far).groupBy("name", "address").agg(F.min("aliases").alias("aliases"))
    kind = F.when(F.col("address").contains(":"), "ipv6").otherwise("ipv4")
    return own.select(F.explode(F.array(
        F.struct(F.lit("domain").alias("ioc_type"), F.col("name").alias("value"),
                 F.lit("resolved_to").alias("relation"), F.col("address").alias("linked"), "aliases"),
        F.struct(kind.alias("ioc_type"), F.col("address").alias("value"),
                 F.lit("resolved_from").alias("relation"), F.col("name").alias("linked"), "aliases"))).alias(
        "l")).select("l.*")
