"""URLs: domains, normal forms, and the predicates that keep a crawler out of private networks."""

from __future__ import annotations

import ipaddress
from functools import reduce
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track, and endings of files that are no pages.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
ASSETS = r"\.(png|jpg|jpeg|gif|svg|ico|pdf|zip|tar|gz|mp3|mp4|css|js|woff|woff2|json|xml)$"
# Networks that are not public.
BLOCKED_V4 = ("0.0.0.0/8", "255.255.255.255/32", "224.0.0.0/4", "169.254.0.0/16", "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10")
BLOCKED_V6 = ("::/128", "fe80::/10", "ff00::/8", "::1/128", "fc00::/7")
LOCAL_HOSTS = r"^localhost$|\.(localhost|local|internal|onion)$"
_URL = r"(?is)^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\s]+)(?::\d*)?(?:[/?#].*)?$"


def host(url: Column) -> Column:
    """Lower-cased host name of an absolute url, or null."""
    found = F.lower(F.regexp_extract(url, _URL, 1))
    return F.when(found != "", found)


def domain(url: Column) -> Column:
    """Host name without one leading ``www.``; ``other`` for what is no url."""
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit("other"))


def is_asset(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?s)^[^?#]*", 0)).rlike(ASSETS)


def _v4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return sum((F.try_element_at(parts, F.lit(i + 1)).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))


def _v4_blocked(ip: Column) -> Column:
    """The number is computed once and compared as a lambda's variable; written out for each network,
    the expression would outgrow a compiled method."""
    nets = [ipaddress.ip_network(n) for n in BLOCKED_V4]
    inside = lambda n: reduce(lambda a, b: a | b, (n.between(int(x.network_address), int(x.broadcast_address)) for x in nets))
    return F.exists(F.array(_v4_number(ip)), inside)


def _ip6_blocked(text: str | None) -> bool:
    try:
        ip = ipaddress.ip_address((text or "").strip("[]").partition("%")[0])
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    nets = BLOCKED_V4 if ip.version == 4 else BLOCKED_V6
    return any(ip in ipaddress.ip_network(n) for n in nets)


@F.pandas_udf(T.BooleanType())
def _other_blocked(ips: pd.Series) -> pd.Series:
    return ips.map(_ip6_blocked).astype(bool)


V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def is_blocked_ip(ip: Column) -> Column:
    """Whether an address is not public; empty and unreadable ones are blocked. Dotted addresses
    are compared as numbers; only others go to a vectorised function."""
    mapped = F.regexp_extract(ip, r"(?i)^\[?::ffff:(\d+\.\d+\.\d+\.\d+)\]?$", 1)
    v4 = F.when(ip.rlike(V4), ip).when(mapped.rlike(V4), mapped)
    six = F.when(ip.contains(":") & v4.isNull(), ip)
    return F.when(v4.isNotNull(), _v4_blocked(v4)).when(six.isNotNull(), _other_blocked(six)).otherwise(True)


def is_blocked_v4(ip: Column) -> Column:
    """As is_blocked_ip() for dotted addresses, without a function in Python."""
    return F.when(ip.rlike(V4), _v4_blocked(ip)).otherwise(True)


def url_problem(url: Column) -> Column:
    """Why a url must not be fetched: empty, format, protocol, host or address; null if it may."""
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    name = host(url)
    literal = name.rlike(V4) | name.startswith("[")
    bare = F.regexp_replace(name, r"^\[|\]$", "")
    return (
        F.when(url.isNull() | (url == ""), "empty")
        .when(scheme == "", "format")
        .when(~scheme.isin("http", "https"), "protocol")
        .when(name.isNull(), "format")
        .when(name.rlike(LOCAL_HOSTS), "host")
        .when(literal & is_blocked_ip(bare), "address")
    )


def normalize_url(url: str | None) -> str | None:
    """Lower-case host, no fragment, no tracking parameters, query re-encoded, no default port, one
    trailing slash less unless the path is the root. What is no absolute url stays as it is."""
    try:
        u = urlsplit((url or "").strip())
        if not u.scheme or not u.hostname:
            return url
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url
    name = f"[{u.hostname}]" if ":" in u.hostname else u.hostname
    user = u.netloc.rpartition("@")[0]
    path = quote(u.path or "/", safe="/%:@!$&'()*+,;=~-._[]|")
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    query = urlencode([(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k not in TRACKING], safe="*")
    return urlunsplit((u.scheme.lower(), f"{user}@{name}{port}" if user else name + port, path, query, ""))


@F.pandas_udf(T.StringType())
def normalized(urls: pd.Series) -> pd.Series:
    """normalize_url() of a column."""
    return urls.map(normalize_url)


def resolve(href: str, base: str) -> str | None:
    """The normal form of a link on a page, or null if it is no page of the web."""
    try:
        full = urljoin(base, href.strip())
        u = urlsplit(full)
        ok = u.scheme.lower() in ("http", "https") and u.hostname
    except ValueError:
        return None
    return normalize_url(full) if ok else None


def bare_host(url: str | None) -> str:
    """Host name in lower case without a leading ``www.``."""
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def display_url(url: Column) -> Column:
    """Host and path, or the text itself where it is no url."""
    path = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.when(host(url).isNull(), url).otherwise(F.concat(host(url), F.when(path == "", "/").otherwise(path)))
