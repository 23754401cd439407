"""URL parts as ECMAScript's URL parser reports them, from expressions that never leave the JVM."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .patterns import let

_URL = r"(?i)^\s*([a-z][a-z0-9+.\-]*)://(?:[^/?#@\s]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\s<>\[\]\\^|%]+)(?::\d*)?(?=[/?#\s]|\z)"
# Second-level labels that sit under a country code.
_TWO_LEVEL = r"^(co|com|org|net|gov|ac|edu|or)\.[a-z]{2}$"
# Mail and portfolio hosts that say nothing about a company's own site.
FREE_MAIL = [
    "gmail.com", "googlemail.com", "hotmail.com", "hotmail.dk", "outlook.com", "outlook.dk", "live.com",
    "live.dk", "yahoo.com", "yahoo.dk", "icloud.com", "me.com", "mac.com", "msn.com", "mail.com", "gmx.com",
    "gmx.net", "protonmail.com", "proton.me", "pm.me", "aol.com",
]
SHARED_HOSTS = [
    "artstation.com", "itch.io", "github.com", "github.io", "behance.net", "wixsite.com", "linktr.ee",
    "carrd.co", "notion.site", "sites.google.com", "google.com", "facebook.com", "linkedin.com", "gumroad.com",
    "patreon.com", "youtube.com", "instagram.com", "x.com", "twitter.com", "steampowered.com",
    "store.steampowered.com", "discord.gg", "discord.com",
]
_SHARED_SUFFIX = r"\.(wixsite\.com|github\.io|itch\.io|notion\.site)$"
# Labels of a careers address that name the hosting, not the company.
GENERIC_LABELS = [
    "www", "jobs", "job", "careers", "career", "apply", "boards", "job-boards", "recruiting", "recruitment",
    "hire", "hiring", "talent", "join", "work", "app", "en", "us", "uk", "en-us", "en_us", "global", "home",
    "company", "about",
]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def hostname(url: Column) -> Column:
    """Lower-case host without port; '' when the text is no absolute URL."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2))


def host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def path(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.replace(F.when(rest == "", F.lit("/")).otherwise(F.rtrim(rest)), F.lit(" "), F.lit("%20"))


def query_param(url: Column, name: str) -> Column:
    """First value of a query parameter; '' when absent."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)", 1)


def is_web(url: Column) -> Column:
    return (hostname(url) != "") & scheme(url).isin("http", "https")


def on_hosts(host_col: Column, hosts: list[str]) -> Column:
    """True when the host is one of ``hosts`` or below one of them."""
    listed = "|".join(re.escape(h.lower()) for h in hosts)
    return F.rlike(host_col, F.lit(rf"(^|\.)({listed})$")) if hosts else F.lit(False)


def registrable_domain(host_col: Column) -> Column:
    def cut(labels: Column) -> Column:
        n = F.size(labels)
        tail2 = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
        tail3 = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
        return F.when(n <= 2, F.array_join(labels, ".")).when(F.rlike(tail2, F.lit(_TWO_LEVEL)), tail3).otherwise(tail2)

    return let(F.split(host_col, r"\."), cut)


def last_two_labels(value: Column) -> Column:
    """Loose domain of an address or bare host: scheme, path, query and port dropped, two labels kept."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"^[a-z]+://", "")
    labels = F.filter(F.split(F.regexp_extract(bare, r"^([^/?:]*)", 1), r"\."), lambda p: p != "")
    return F.array_join(F.when(F.size(labels) > 2, F.slice(labels, -2, 2)).otherwise(labels), ".")


def own_host(url: Column) -> Column:
    """Host usable as a company's own site hint; '' for shared portfolio hosts."""
    h = host(url)
    return F.when(h.isin(SHARED_HOSTS) | F.rlike(h, F.lit(_SHARED_SUFFIX)), F.lit("")).otherwise(h)


def mail_host(mail: Column) -> Column:
    """Host of an address unless it is a free-mail or shared host."""
    domain = F.split_part(F.lower(F.coalesce(mail, F.lit(""))), F.lit("@"), F.lit(2))
    return F.when(domain.isin(FREE_MAIL + SHARED_HOSTS), F.lit("")).otherwise(F.regexp_replace(domain, r"^www\.", ""))


def posting_id(url: Column) -> Column:
    """Requisition number: the gh_jid parameter, else the leading digits of the last path segment."""
    board = query_param(url, "gh_jid")
    last = F.regexp_extract(path(url), r"/(\d{5,})[^/]*/*$", 1)
    found = F.when(F.rlike(board, F.lit(r"^\d{5,}$")), board).otherwise(last)
    return F.when((hostname(url) != "") & (found != ""), found)


def link_key(url: Column) -> Column:
    """Canonical application link: host, path without closing slashes, and only gh_jid of the query."""
    board = query_param(url, "gh_jid")
    key = F.concat(host(url), F.lower(F.regexp_replace(path(url), "/+$", "")),
                   F.when(board != "", F.concat(F.lit("?gh_jid="), board)).otherwise(F.lit("")))
    return F.when(is_web(url), key)


def studio_slug(url: Column) -> Column:
    """A company's own handle in its careers address: sub-domain, else first telling path segment."""
    labels = F.split(hostname(url), r"\.")
    first = F.get(labels, F.lit(0))
    segments = F.filter(F.transform(F.split(path(url), "/"), lambda s: F.trim(s)),
                        lambda s: (s != "") & ~F.lower(s).isin(GENERIC_LABELS))
    return F.when(hostname(url) == "", F.lit(None)).when(
        (F.size(labels) > 2) & ~first.isin(GENERIC_LABELS), first).otherwise(F.get(segments, F.lit(0)))


# Hosts a fetch must never reach.
_PRIVATE = r"(?i)^localhost$|^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^169\.254\.|^::1$|^fc[0-9a-f]{2}:|^fe80:"


def guard_code(url: Column) -> Column:
    """Why an address must not be visited; NULL when it may."""
    has_scheme = scheme(url) != ""
    # a bare scheme such as mailto: parses, yet has no host
    parses = F.when(scheme(url).isin("http", "https", "ftp", "ws", "wss"), hostname(url) != "").otherwise(has_scheme)
    return (F.when(~parses, F.lit("invalid_url"))
            .when(~scheme(url).isin("http", "https"), F.lit("unsupported_protocol"))
            .when(F.rlike(hostname(url), F.lit(_PRIVATE)), F.lit("blocked_host")))


def guard_status(code: Column) -> Column:
    return F.when(code == "blocked_host", F.lit("skipped_blocked_host")).when(
        code.isNotNull(), F.lit("skipped_invalid_url"))


def posting_url(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` tokens of a url template; values are percent-encoded."""
    parts: list[Column] = []
    for literal, token in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if token:
            value = F.coalesce(values[token].cast("string"), F.lit("")) if token in values else F.lit("")
            parts.append(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")))
    return F.concat(*parts)


def template_prefix(template: Column) -> Column:
    """Landing page of a url template: the text before the first token, cut after the last slash."""
    head = F.substring_index(F.trim(template), "{", 1)
    cut = F.regexp_extract(head, r"^(.*/)", 1)
    return F.when(cut == "", head).otherwise(cut)
