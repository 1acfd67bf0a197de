"""Column expressions over addresses, ports and host names."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

from pyspark.sql import Column, functions as F

from emberlog.fixed import network as fx

OCTETS = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}(?<!\.)$"


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def suffix_pattern(suffixes) -> str:
    return "(?:^|\\.)(" + "|".join(re.escape(x) for x in suffixes) + ")$"


def ends_with_any(host: Column, suffixes) -> Column:
    """Host equals one of the suffixes or is a name below one."""
    return host.rlike(suffix_pattern(suffixes))


def ip_to_long(addr: Column) -> Column:
    """Dotted quad to BIGINT, null for anything else."""
    octets = F.transform(F.split(addr, r"\."), lambda o: o.try_cast("bigint"))
    return F.when(addr.rlike(OCTETS), F.aggregate(
        octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body` (a function of a Column)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_cidr(value: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr)
    return value.between(int(net.network_address), int(net.broadcast_address))


def is_rfc1918(addr: Column) -> Column:
    """Private IPv4 by prefix, or an IPv6 unique local address."""
    a = F.trim(addr)
    v4 = a.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])(\.|$))")
    return F.coalesce(v4 | (a.rlike("^f[cd]") & a.contains(":")), F.lit(False))


def is_private(addr: Column) -> Column:
    """Private, loopback, link-local or carrier-grade NAT address."""
    return F.coalesce(addr.rlike(
        r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|169\.254\."
        r"|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|::1$|fe80:|f[cd][0-9a-f]{2}:)"
    ), F.lit(False))


def is_external(addr: Column) -> Column:
    """A routable IPv4 address: not private, loopback, link-local, zero or multicast."""
    a = F.trim(addr)
    return F.coalesce(
        a.rlike(OCTETS)
        & ~a.rlike(r"^(10|127|0|22[4-9]|2[3-5][0-9])\.|^192\.168\.|^169\.254\."
                   r"|^172\.(1[6-9]|2[0-9]|3[01])\."), F.lit(False))


def is_bogon(addr: Column) -> Column:
    """Listening socket, loopback, link-local, multicast or an empty address."""
    a = F.trim(F.coalesce(addr, F.lit("")))
    return a.isin(fx.NOT_AN_ENDPOINT) | _any(
        [a.startswith(p) for p in fx.NOT_AN_ENDPOINT_PREFIXES])


def provider(addr: Column, port: Column) -> Column:
    """Provider of a public address on a web port, from the list of ranges; else null.

    The list is a constant of a few dozen ranges, so it becomes one codegen'd CASE and needs no join.
    """
    def named(value):
        chain = F
        for name, cidrs in fx.PROVIDER_CIDRS.items():
            chain = chain.when(_any([_in_cidr(value, c) for c in cidrs]), name)
        for prefix, name in fx.PROVIDER_V6_PREFIXES.items():
            chain = chain.when(F.lower(addr).startswith(prefix), name)
        return chain

    return F.when(port.isin(fx.CLOUD_WEB_PORTS), let(ip_to_long(addr), named))


def port_service(port: Column) -> Column:
    """Service name of a listed port, else null."""
    table = F.create_map(*[F.lit(x) for kv in fx.SERVICE_PORTS.items() for x in kv])
    return F.try_element_at(table, port.cast("int"))


def port_category(port: Column) -> Column:
    p = port.cast("int")
    return (F.when(p.isNull() | (p <= 0) | (p > 65535), "registered")
            .when(p.isin(list(fx.SERVICE_PORTS)), "known")
            .when(p <= 1023, "well_known").when(p <= 49151, "registered").otherwise("ephemeral"))


def port_annotation(port: Column) -> Column:
    kind = port_category(port)
    return F.coalesce(
        port_service(port),
        F.when(kind == "well_known", "unknown well-known port")
        .when(kind == "registered", "unregistered service (registered range)")
        .otherwise("ephemeral"))


def _bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r":[^:]*$", "")


def registered_parent(host: Column) -> Column:
    """Last two labels, or three under a two-label country suffix."""
    h = _bare_host(host)
    last_two = F.substring_index(h, ".", -2)
    return F.when(last_two.isin(fx.TWO_LABEL_CCTLDS), F.substring_index(h, ".", -3)).otherwise(
        last_two)


def _ddns(h: Column) -> Column:
    return F.nullif(F.regexp_extract(h, suffix_pattern(fx.DDNS_SUFFIXES), 1), F.lit(""))


def split_parent(host: Column) -> Column:
    """Dynamic-DNS suffix if any, else the last two labels; empty without a dot."""
    h = _bare_host(host)
    return F.when(~h.contains("."), "").otherwise(
        F.coalesce(_ddns(h), F.substring_index(h, ".", -2)))


def tld(host: Column) -> Column:
    h = _bare_host(host)
    return F.when(~h.contains("."), "").otherwise(
        F.coalesce(_ddns(h), F.substring_index(h, ".", -1)))


def suspicious_tld(host: Column) -> Column:
    """ddns, abuse, newgen or mixed (in that order), null when unremarkable."""
    h = _bare_host(host)
    last = F.substring_index(h, ".", -1)
    return (F.when(~h.contains("."), None)
            .when(_ddns(h).isNotNull(), "ddns")
            .when(last.isin(fx.ABUSE_TLDS), "abuse")
            .when(last.isin(fx.NEWGEN_TLDS), "newgen")
            .when(last.isin(fx.MIXED_TLDS), "mixed"))
