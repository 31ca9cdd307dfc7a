"""URL, host and path functions as column expressions; exact re-encoding is one Arrow UDF."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.udf import arrow_udf

#: Hosts by site adapter, fixed values.
ADAPTER_HOSTS = {
    "x-article": ("x.com", "www.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com"),
    "langchain-blog": ("www.langchain.com", "langchain.com"),
    "recursive": ("recursive.com", "www.recursive.com"),
}
#: Query keys that the x-article adapter drops besides utm_*, fixed values.
X_KEYS = ("s", "ref_src", "ref_url")
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")


def host(url: Column) -> Column:
    """Lower-case host without userinfo and port; null where the text is no URL."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(authority == "", None).otherwise(F.lower(authority))


def split_url(url: Column) -> dict[str, Column]:
    """scheme, authority, path, query and fragment by the generic syntax; missing parts are empty."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    names = ("scheme", "authority", "path", "query", "fragment")
    return {n: F.regexp_extract(url, pattern, i + 1) for i, n in enumerate(names)}


def canonicalize(url: Column, adapter: Column) -> Column:
    """Fragment and utm_* keys dropped, and tracking keys of the x-article adapter; order kept."""
    part = split_url(url)
    pairs = F.filter(F.split(part["query"], "&"), lambda p: p != "")

    def kept(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        return ~key.startswith("utm_") & ~((adapter == "x-article") & key.isin(*X_KEYS))

    query = F.array_join(F.filter(pairs, kept), "&")
    path = F.when(part["path"] == "", "/").otherwise(part["path"])
    return F.concat(F.lower(part["scheme"]), F.lit("://"), F.lower(part["authority"]), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


@arrow_udf("string")
def normalize(urls: pd.Series) -> pd.Series:
    """Source URL identity: trimmed, http(s) only, lower-case host, no userinfo, default port or
    fragment, single slashes, no slash at the end, sorted and re-encoded query with blanks kept.
    Anything else gives null."""

    def one(raw):
        if raw is None:
            return None
        try:
            u = urlsplit(raw.strip())
            scheme, port = u.scheme.lower(), u.port
        except ValueError:
            return None
        if scheme not in ("http", "https") or not u.hostname:
            return None
        place = u.hostname.lower()
        place = f"[{place}]" if ":" in place else place
        if port and (scheme, port) not in (("http", 80), ("https", 443)):
            place += f":{port}"
        path = u.path or "/"
        while "//" in path:
            path = path.replace("//", "/")
        path = path.rstrip("/") or "/"
        return urlunsplit((scheme, place, path, urlencode(sorted(parse_qsl(u.query, keep_blank_values=True))), ""))

    return urls.map(one)


def is_private(name: Column) -> Column:
    """Hosts of private and local networks: names, IPv4 ranges and IPv6 prefixes."""
    h = F.lower(F.regexp_replace(name, r"^\[|\]$", ""))
    named = (h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal")
    octets = F.transform(F.split(h, r"\."), lambda x: x.try_cast("int"))
    v4 = h.rlike(r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$") & F.forall(octets, lambda x: x <= 255)
    a, b = octets[0], octets[1]
    private4 = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19))
    )
    v6 = h.contains(":")
    private6 = h.isin("::", "::1") | h.rlike(r"^(fc|fd|fe[89ab]|::ffff:127\.|::ffff:10\.|::ffff:192\.168\.)")
    return F.coalesce(named | F.when(v4, private4).otherwise(F.lit(False)) | (v6 & private6), F.lit(False))


def adapter(name: Column) -> Column:
    """Site adapter of a host."""
    out = F.lit("generic-article")
    for key, hosts in ADAPTER_HOSTS.items():
        out = F.when(name.isin(*hosts), key).otherwise(out)
    return out


def source_url_problem(url: Column, allowed=(), allow_http: bool = False) -> Column:
    """Why a source URL is refused, or null: no URL, credentials, private host, no HTTPS."""
    part, name = split_url(url), host(url)
    return (
        F.when(name.isNull(), "invalid")
        .when(part["authority"].contains("@"), "credentials")
        .when(~name.isin(*allowed) & is_private(name) if allowed else is_private(name), "private")
        .when((F.lower(part["scheme"]) != "https") & ~(F.lit(allow_http) & (F.lower(part["scheme"]) == "http")), "not-https")
    )


def video_id(url: Column) -> Column:
    """Id of a single video, or null: HTTPS, known hosts, no credentials, 11 characters.

    Short links take the first path step, watch pages their v key; shorts, channels and playlists
    are none.
    """
    part, name = split_url(F.trim(url)), host(F.trim(url))
    short = F.filter(F.split(part["path"], "/"), lambda x: x != "")[0]
    watch = F.regexp_extract(part["query"], r"(?:^|&)v=([^&]*)", 1)
    found = F.when(name == "youtu.be", short).when(part["path"] == "/watch", watch)
    fine = (F.lower(part["scheme"]) == "https") & name.isin(*VIDEO_HOSTS) & ~part["authority"].contains("@")
    return F.when(fine & found.rlike("^[A-Za-z0-9_-]{11}$"), found)


def video_url(url: Column) -> Column:
    """Canonical watch URL of a single video, or null."""
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(url))


def is_safe_relative(path: Column) -> Column:
    """Relative, not empty and without a parent step."""
    return F.coalesce((path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:[/\\]") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(False))
