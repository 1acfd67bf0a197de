"""Pattern, lexicon and URL matching over lines and texts."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from emberlog import functions as fn
from emberlog.fixed import patterns as fx
from emberlog.operators import matching
from emberlog.operators.common import explode_rows, top_list
from emberlog.session import ship

NONE = "array<string>"


def _present(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, as an array."""
    return F.filter(F.array(*[F.when(t, name) for name, t in tests.items()]),
                    lambda x: x.isNotNull())


# --- line families -----------------------------------------------------------------------------

def text_lines(rows: DataFrame, text: str = "text", keep=()) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    lines = rows.select(*keep, F.explode(F.split(text, r"\r?\n")).alias("line"))
    return lines.withColumn("line", F.trim("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#"))


def family_matches(lines: DataFrame, families: dict, line: str = "line") -> DataFrame:
    """One row per line and family; a line counts once per family, whatever the case of its letters.

    All patterns are searched in one pass per line.
    """
    return explode_rows(lines, matching.line_families(lines, line, matching.rules_of(families, flags="(?i)")), "family")


def family_summary(rows: DataFrame, families: dict, user: str, text: str = "text", k: int = 5) -> DataFrame:
    """Lines per family in whole texts, the busiest users and one sample line."""
    hits = matching.text_families(rows, matching.rules_of(families, flags="(?i)"), text, keep=[user])
    per_user = hits.groupBy("family", user).agg(F.count("*").alias("n"), F.min("line").alias("sample"))
    totals = per_user.groupBy("family").agg(F.sum("n").alias("event_count"),
                                            F.min("sample").alias("sample"))
    return totals.join(top_list(per_user, ["family"], user, "n", k), "family")


def family_triage(hits: DataFrame, host: str = "host", user: str = "user", ts: str = "ts",
                  priority=None, k: int = 5) -> DataFrame:
    """Per family: hits, first and last time, busiest hosts and users, and rank in the priority list.

    Hits are reduced to one row per family, host and user first; both top lists come from that table.
    """
    order = fx.SHELL_PRIORITY if priority is None else list(priority)
    per = hits.groupBy("family", host, user).agg(
        F.count("*").alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    totals = per.groupBy("family").agg(
        F.sum("n").alias("event_count"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    tops = [top_list(per.groupBy("family", c).agg(F.sum("n").alias("n")), ["family"], c, "n", k, name)
            for c, name in ((host, "top_hosts"), (user, "top_users"))]
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("family"))
    return totals.join(tops[0], "family").join(tops[1], "family").withColumn(
        "priority", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))


def script_matches(rows: DataFrame, families: dict, text: str = "text") -> DataFrame:
    """Families found in a script or in what its base64 runs decode to."""
    forms = explode_rows(rows, F.concat(
        F.array(text), fn.decode_base64_text(F.col(text))), "_form")
    found = family_matches(forms, families, "_form").drop("_form")
    return found.dropDuplicates()


# --- lexicons ---------------------------------------------------------------------------------------

def word_hits(low: Column, words) -> Column:
    """Words of a list that occur on their own (no letter before or after) in lower-cased text.

    A plain substring test comes first; the boundary pattern runs on texts that hold the word.
    """
    return _present({w: low.contains(w) & low.rlike(r"(?<![a-z])" + re.escape(w) + r"(?![a-z])")
                     for w in words})


@functools.lru_cache(16)
def _word_automaton(words: tuple[str, ...]):
    """Finds all words in one pass, in texts of one character per byte; built once per worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w.encode().decode("latin-1"), w)
    found.make_automaton()
    return found


def _words_in(raw: bytes, words: tuple[str, ...]) -> set[str]:
    """Words that occur on their own in lower-cased UTF-8 text, as `word_hits` has it."""
    low, found = raw.decode("latin-1"), set()
    for end, w in _word_automaton(words).iter(low) if words else ():
        if w not in found:
            start = end - len(w.encode())
            if not ("a" <= low[end + 1:end + 2] <= "z" or start >= 0 and "a" <= low[start] <= "z"):
                found.add(w)
    return found


def lexicon_hits(rows: DataFrame, text: str = "text", words: dict | None = None,
                 patterns: dict | None = None) -> DataFrame:
    """Texts with hits in enough categories: hits per category, category count and strength.

    Three categories are high; two with three hits, or one with four hits, are medium; the rest is
    left out. All words are looked for in one pass over a text, and a pattern's hits are taken once.
    """
    words = fx.PLANNING_WORDS if words is None else words
    patterns = fx.PLANNING_PATTERNS if patterns is None else patterns
    ship(rows.sparkSession)
    lists = [list(dict.fromkeys(ws)) for ws in words.values()]
    every = tuple(dict.fromkeys(w for ws in lists for w in ws))
    none = [[]] * len(lists)

    @F.pandas_udf("array<array<string>>")
    def found(lows: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for low, more in zip(lows, hits):
            here = _words_in(low, every) if low is not None else ()
            out.append(([[w for w in ws if w in here] for ws in lists] if here else none) + [
                [] if x is None else list(x) for x in more])
        return pd.Series(out, dtype=object)

    taken = F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns.values()]).cast(
        "array<array<string>>")
    # as Spark would otherwise call it again for the filter on its result
    once = found.asNondeterministic()
    out = rows.withColumn("_hits", once(F.lower(text).cast("binary"), taken))
    sizes = []
    for i, name in enumerate([*words, *patterns]):
        out = out.withColumn(f"{name}_hits", F.get("_hits", F.lit(i)))
        sizes.append(F.size(f"{name}_hits"))
    total, fired = sizes[0], (sizes[0] > 0).cast("int")
    for s in sizes[1:]:
        total, fired = total + s, fired + (s > 0).cast("int")
    strength = (F.when(F.col("categories") >= 3, "high")
                .when((F.col("categories") >= 2) & (F.col("total_hits") >= 3), "medium")
                .when((F.col("categories") == 1) & (F.col("total_hits") >= 4), "medium"))
    return out.withColumn("total_hits", total).withColumn("categories", fired).withColumn(
        "strength", strength).filter(F.col("strength").isNotNull()).drop("_hits")


def trade_hits(rows: DataFrame, text: str = "text", words=None, specific=(), common=()
               ) -> DataFrame:
    """Trade lexicon: words, units, prices, symbols and substance names; two hits at least.

    Common substance names count only beside another hit. `specific` and `common` are name lists.
    """
    t = F.col(text)
    none = F.array().cast(NONE)

    def names(values):
        if not values:
            return none
        p = "(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(v) for v in values) + ")(?![a-z0-9])"
        return F.sort_array(F.array_distinct(F.transform(
            F.regexp_extract_all(t, F.lit(p), F.lit(0)), F.lower)))

    def all_of(p):
        return F.regexp_extract_all(t, F.lit(p), F.lit(0))
    low = F.lower(t)
    out = (rows.withColumn("word_hits", word_hits(low, fx.TRADE_WORDS if words is None else words))
           .withColumn("unit_hits", all_of(fx.UNIT_PATTERN))
           .withColumn("price_hits", all_of(fx.PRICE_PATTERN))
           .withColumn("symbol_hits", _present({s: t.contains(s) for s in fx.TRADE_SYMBOLS}))
           .withColumn("_specific", names(list(specific))))
    groups = ["word_hits", "unit_hits", "price_hits", "symbol_hits", "_specific"]
    other = F.concat(*groups)
    out = out.withColumn("substance_hits", F.concat("_specific", F.when(
        F.size(other) > 0, names(list(common))).otherwise(none)))
    kinds = ["word_hits", "unit_hits", "price_hits", "symbol_hits", "substance_hits"]
    total, fired = F.lit(0), F.lit(0)
    for k in kinds:
        total, fired = total + F.size(k), fired + (F.size(k) > 0).cast("int")
    strong = (F.size("word_hits") >= 3) | (F.size("price_hits") >= 2) | (F.size("_specific") > 0)
    return out.withColumn("total_hits", total).withColumn("categories", fired).filter(
        F.col("total_hits") >= 2).withColumn("strength", F.when(
            (F.col("categories") >= 2) & strong, "high").otherwise("medium")).drop("_specific")


# --- fingerprints and keywords -------------------------------------------------------------------------

def fingerprint_families(lines: DataFrame, context: str | None = None, line: str = "line",
                         families: dict | None = None) -> DataFrame:
    """Families whose fingerprints occur in the lines of a context, benign lines skipped."""
    rules = matching.rules_of(families or fx.MALWARE_FAMILIES, context)
    return explode_rows(lines, matching.line_families(lines, line, rules), "family")


def fingerprint_lines(rows: DataFrame, context: str | None = None, text: str = "text", keep=(),
                      families: dict | None = None) -> DataFrame:
    """As `fingerprint_families`, over whole texts: the kept columns, line_no, line and family per hit line."""
    return matching.text_families(rows, matching.rules_of(families or fx.MALWARE_FAMILIES, context), text, keep)


def fingerprint_matches(rows: DataFrame, context: str | None = None, text: str = "text", keep=(),
                        families: dict | None = None) -> DataFrame:
    """Every match of a fingerprint in whole texts, with its pattern's number, place and snippet."""
    return matching.text_matches(rows, matching.rules_of(families or fx.MALWARE_FAMILIES, context), text, keep)


def fingerprint_snippets(matches: DataFrame, row: str, k: int = 5) -> DataFrame:
    """The first `k` matches of each family by pattern, row and place; tasks pass on `k` per family at most."""
    order = W.partitionBy("family").orderBy("pattern", row, "line_no", "start")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_tags(lines: DataFrame, line: str = "line", keywords=None) -> DataFrame:
    """Tag and label of every console keyword found in a line."""
    found = F.filter(F.array(*[
        F.when(F.col(line).rlike("(?i)" + p), F.struct(F.lit(tag).alias("tag"),
                                                      F.lit(label).alias("label")))
        for p, tag, label in (keywords or fx.CONSOLE_KEYWORDS)]), lambda x: x.isNotNull())
    return explode_rows(lines, found, "_k").select("*", "_k.tag", "_k.label").drop("_k")


# --- URLs --------------------------------------------------------------------------------------------------

def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def url_destinations(visits: DataFrame, url: str = "url") -> DataFrame:
    """Visits to sharing sites, webmail or upload forms; the first match counts."""
    host = url_host(F.col(url))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    kind = fn.first_match([
        (fn.ends_with_any(F.col("host"), fx.SHARE_HOSTS), "anon_share"),
        (fn.ends_with_any(F.col("host"), fx.WEBMAIL_HOSTS), "webmail"),
        (path.rlike(fx.UPLOAD_PATH), "forum_upload")])
    return visits.withColumn("host", host).filter(F.col("host") != "").withColumn(
        "destination", kind).filter(F.col("destination").isNotNull())


def download_sources(rows: DataFrame, url: str = "url") -> DataFrame:
    """Downloads from a bare address or a suspicious top-level domain."""
    u = F.col(url)
    reason = fn.first_match([(u.rlike(r"https?://\d+\.\d+\.\d+\.\d+"), "raw_ip"),
                             (fn.suspicious_tld(url_host(u)).isNotNull(), "suspicious_tld")])
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def cached_url_flags(rows: DataFrame, url: str = "url", long_query: int = 400) -> DataFrame:
    """Cached URLs that look odd, with the first reason that applies."""
    u = F.col(url)
    last = F.substring_index(F.lower(F.regexp_extract(u, r"^https?://([^/]+)/?", 1)), ".", -1)
    kind = fn.first_match([
        (u.rlike(fx.RAW_ADDRESS_URL), "raw_ip"), (last.isin(fx.CACHE_TLDS), "unusual_tld"),
        (fn.any_contains(F.lower(u), fx.TRACKER_HINTS), "tracker_sync"),
        (u.contains("?") & (F.length(u) > long_query), "long_query")])
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def reputation(rows: DataFrame, key: str, table: DataFrame, columns) -> DataFrame:
    """Entries of a fingerprint table beside each row; `unknown` when the table has none."""
    joined = rows.join(table.dropDuplicates([key]), key, "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(c), F.lit("unknown")).alias(c)
                                          for c in columns])
