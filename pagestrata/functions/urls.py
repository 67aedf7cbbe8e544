"""URL functions: Column expressions for the tables, plain Python where markup is parsed."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default ports by scheme.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_HEAD = r"^([^:/?#]+)://([^/?#\\]*)"


def _without_escapes_case(part: Column) -> Column:
    """Percent escapes in capitals."""
    pieces = F.split(part, "%")
    capital = F.transform(pieces, lambda p, i: F.when((i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30))).otherwise(p))
    return F.when(part.contains("%"), F.array_join(capital, "%")).otherwise(part)


def norm_url(url: Column) -> Column:
    """The key under which addresses are compared; the input itself where it is no absolute URL.

    Scheme and host in lower case, no default port, no fragment, query pairs sorted, percent escapes in
    capitals, no trailing slash except for the root path.
    """
    text = F.trim(url)
    # Each step is one replacement, so that the expression stays small wherever it is put.
    head = F.regexp_replace(F.lower(F.regexp_extract(text, _HEAD, 0)), r"(?s)^(https://.*):443\z|^(http://.*):80\z|^((?!https?:).*):\z", "$1$2$3")
    rest = F.regexp_replace(F.regexp_replace(text, _HEAD + "|(?s:#.*)", ""), r"^(?=\?|\z)", "/")
    pairs = F.array_sort(F.split(F.regexp_extract(rest, r"(?s)\?(.*)\z", 1), "&"))
    full = F.when(rest.rlike(r"(?s)\?.*&"), F.concat(F.substring_index(rest, "?", 1), F.lit("?"), F.array_join(pairs, "&"))).otherwise(rest)
    cut = F.regexp_replace(full, r"(?s)^(?!/(?:\?|\z))(.+)/\z", "$1")
    return F.when(head != "", F.concat(head, _without_escapes_case(cut))).otherwise(url)


def host_of(url: Column) -> Column:
    """Host without port, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def first_path_segment(url: Column) -> Column:
    """First non-empty path segment, else '(root)'."""
    return F.coalesce(F.get(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), 0), F.lit("(root)"))


def is_crawlable(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://"), F.lit(False))


def authority_of(url: Column) -> Column:
    """host:port with the scheme's known port filled in."""
    scheme = F.lower(F.regexp_extract(url, _HEAD, 1))
    port = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    known = F.when(port != "", port).when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    return F.concat(host_of(url), F.lit(":"), known)


def same_site(a: Column, b: Column) -> Column:
    """Same host and same known port: the scope of a crawl (links are split into internal and external by host alone)."""
    return F.coalesce((host_of(a) != "") & (authority_of(a) == authority_of(b)), F.lit(False))


def is_subdomain(a: Column, b: Column) -> Column:
    return F.coalesce((a != b) & (a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))), F.lit(False))


def is_local_host(url: Column) -> Column:
    return host_of(url).rlike(r"^(?:localhost|.*\.localhost|\[::1\]|127(?:\.\d{1,3}){3})$")


def has_utm(url: Column) -> Column:
    keys = F.transform(F.split(query_of(url), "&"), lambda p: F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), p)))
    return F.exists(keys, lambda k: k.startswith("utm_"))


def glob_matches(pattern: str, url: Column) -> Column:
    """A pattern without * is a prefix; with * the parts must follow each other, the first at the start."""
    if "*" not in pattern:
        return url.startswith(pattern)
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return url.like(escaped)


# Plain Python, for the parsers.


def resolve(base: str, reference: str) -> str | None:
    """Absolute form of a reference, or None where it cannot be parsed."""
    cleaned = re.sub(r"[\t\n\r]", "", reference.strip())
    try:
        joined = urljoin(base, cleaned.replace("\\", "/") if re.match(r"(?i)^(?:https?:|[^:]*$)", cleaned) else cleaned)
        parts = urlsplit(joined)
        if not parts.scheme:
            return None
        if parts.scheme in ("http", "https"):
            if not parts.hostname:
                return None
            host = parts.hostname.lower()
            host = host.encode("idna").decode() if not host.isascii() else host
            host = f"[{host}]" if ":" in host else host
            port = f":{parts.port}" if parts.port and str(parts.port) != DEFAULT_PORTS[parts.scheme] else ""
            path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._[]|^")
            query = f"?{quote(parts.query, safe='/%:@!$&()*+,;=~-._?[]|^{}`')}" if parts.query or "?" in joined.split("#")[0] else ""
            fragment = f"#{parts.fragment}" if parts.fragment else ""
            return f"{parts.scheme}://{host}{port}{path}{query}{fragment}"
        return joined
    except ValueError:
        return None


def norm(url: str) -> str:
    """norm_url in plain Python."""
    absolute = resolve(url, "") if re.match(_HEAD, url.strip()) else None
    if absolute is None:
        return url
    scheme, _, rest = absolute.split("#")[0].partition("://")
    host, slash, tail = rest.partition("/")
    path, mark, query = tail.partition("?")
    full = "/" + path + (mark and "?" + "&".join(sorted(query.split("&"))))
    if full.endswith("/") and path:
        full = full[:-1]
    return f"{scheme}://{host}" + re.sub(r"%[0-9a-fA-F]{2}", lambda m: m[0].upper(), full)
