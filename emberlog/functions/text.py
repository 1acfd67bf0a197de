"""Column expressions over strings, names and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from emberlog.fixed import text as fx


def any_contains(col: Column, needles) -> Column:
    """True when the text holds any of the needles; null text is false."""
    tests = [col.contains(n) for n in needles]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def first_match(pairs, default=None) -> Column:
    """First label whose test holds, in the order given."""
    chain = None
    for test, label in pairs:
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain if default is None else chain.otherwise(default)


def shannon_entropy(s: Column) -> Column:
    """Entropy of the characters in bits; 0 for an empty string."""
    n = F.length(s)
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    term = F.aggregate(
        chars, F.lit(0.0),
        lambda acc, c: acc + ((n - F.length(F.replace(s, c, F.lit("")))) / n)
        * F.log2((n - F.length(F.replace(s, c, F.lit("")))) / n))
    return F.when(n > 0, F.abs(term)).otherwise(F.when(s.isNotNull(), F.lit(0.0)))


def refang(s: Column) -> Column:
    """Undo defanged indicators."""
    return reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), fx.DEFANG_STEPS, s)


def has_repeat_run(s: Column, n: int) -> Column:
    """A run of n or more equal characters."""
    return s.rlike(r"(.)\1{%d}" % (n - 1))


def distinct_chars(s: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(F.lower(s), ""), lambda c: c != "")))


def win_basename(path: Column) -> Column:
    """Lower-cased last segment of a Windows or POSIX path."""
    return F.lower(F.substring_index(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/", -1))


def is_user_writable(path: Column) -> Column:
    return any_contains(F.lower(path), fx.USER_WRITABLE_MARKERS)


def reply_stem(subject: Column) -> Column:
    """Subject without one reply prefix, lower-cased; empty when there was none."""
    s = F.trim(F.coalesce(subject, F.lit("")))
    return F.when(s.rlike(fx.REPLY_PREFIX),
                  F.lower(F.trim(F.regexp_replace(s, fx.REPLY_PREFIX, "")))).otherwise("")


def subject_stem(subject: Column) -> Column:
    """Subject without any number of reply prefixes, lower-cased."""
    s = F.trim(F.coalesce(subject, F.lit("")))
    return F.lower(F.trim(F.regexp_replace(s, fx.REPLY_PREFIXES, "")))


def mail_domain(address: Column) -> Column:
    a = F.lower(F.trim(address))
    return F.when(a.contains("@"), F.substring_index(a, "@", -1)).otherwise("")


def display_is_email(display: Column) -> Column:
    return F.trim(display).rlike(r"^[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}$")


def name_root(name: Column) -> Column:
    """Device name without acquisition suffixes, stripped as long as one matches."""
    return F.regexp_replace(F.lower(F.trim(name)), fx.CAPTURE_SUFFIXES, "")


def ssdeep_band(score: Column) -> Column:
    return (F.when(score < 0, "invalid").when(score == 0, "uncorrelated")
            .when(score <= 10, "weak").when(score <= 20, "marginal").otherwise("strong"))


def tlsh_band(distance: Column) -> Column:
    return (F.when(distance.isNull(), "unknown").when(distance <= 30, "very-close-variant")
            .when(distance <= 70, "same-family-likely")
            .when(distance <= 150, "same-family-loose").otherwise("unrelated"))


def _hex_half(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")


def phash_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two 64-bit hex hashes; 64 for unlike lengths or bad input."""
    ok = (F.length(a) == 16) & (F.length(b) == 16) & a.rlike("^[0-9A-Fa-f]+$") & b.rlike(
        "^[0-9A-Fa-f]+$")
    bits = (F.bit_count(_hex_half(a, 1).bitwiseXOR(_hex_half(b, 1)))
            + F.bit_count(_hex_half(a, 9).bitwiseXOR(_hex_half(b, 9))))
    return F.when(ok, bits).otherwise(64).cast("int")
