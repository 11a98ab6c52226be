"""Addresses of pages: hosts, canonical forms, owners."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists
from .text import slug

#: Query parameters that only track visits, fixed values.
TRACKING = r"(utm_[a-z]+|ref|source|campaign)"


def hostname(url: Column) -> Column:
    """Lower-case host without 'www.'; null for what is no address."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters; what is no address stays as it is."""
    out = F.regexp_replace(url, "#.*$", "")
    out = F.regexp_replace(out, rf"(?i)([?&]){TRACKING}=[^&]*", "$1")
    out = F.regexp_replace(out, r"&{2,}", "&")
    out = F.regexp_replace(F.regexp_replace(out, r"\?&+", "?"), r"[?&]+$", "")
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), url).otherwise(out)


def blocked_host(url: Column, hosts: list[str]) -> Column:
    """Whether the host is one of the hosts or below one."""
    h, out = hostname(url), F.lit(False)
    for v in hosts:
        out = out | (h == v) | h.endswith(f".{v}")
    return F.coalesce(out, F.lit(False))


def blocked_source(owner: Column, publisher: Column, platform: Column, url: Column, blocked: Column) -> Column:
    """Whether one of the blocked values (an array) is the lower-case owner, publisher or platform, or stands in the address
    as a host or the end of one, with or without a port, before a path. Nulls are no match."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    names, address = F.array(low(owner), low(publisher), low(platform)), low(url)
    at = lambda v: [F.like(address, F.concat(F.lit(f"%{mark}"), v, F.lit(end))) for mark in ("//", ".") for end in ("/%", ":%/%")]
    return F.exists(blocked, lambda v: (v != "") & (F.array_contains(names, v) | at(v)[0] | at(v)[1] | at(v)[2] | at(v)[3]))


def owner_of(url: Column, publisher: Column, owners: tuple = lists.OWNERS, fallback: Column | None = None) -> Column:
    """The owner by domain, then by a name in the publisher with no letter or digit beside it, else the fallback, which is
    the publisher's slug if none is given."""
    h, out = hostname(url), slug(publisher) if fallback is None else fallback
    for owner, _, names in reversed(owners):
        for name in reversed(names):
            out = F.when(F.lower(publisher).rlike(rf"(^|[^a-z0-9]){re.escape(name)}([^a-z0-9]|$)"), owner).otherwise(out)
    for owner, domains, _ in reversed(owners):
        for domain in reversed(domains):
            out = F.when((h == domain) | h.endswith(f".{domain}"), owner).otherwise(out)
    return out
