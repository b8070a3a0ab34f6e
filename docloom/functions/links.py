"""Hrefs: extraction, bare hosts, resolution against a base path, safe relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HREF_PATTERN = r'<a\b[^>]*\bhref="([^"]*)"'
# Schemes of links that leave the corpus.
EXTERNAL_SCHEMES = ("http", "https", "ftp", "mailto")
_LEADING_NAV = r"^(?:\.{1,2}/)+"


def hrefs(html: Column) -> Column:
    """Every ``<a href>`` of a page, in page order."""
    return F.regexp_extract_all(html, F.lit(HREF_PATTERN), F.lit(1))


def path_part(href: Column) -> Column:
    return F.regexp_replace(href, r"(?s)[?#].*$", "")


def fragment_part(href: Column) -> Column:
    return F.when(F.contains(href, F.lit("#")), F.regexp_replace(href, r"(?s)^[^#]*#", "")).otherwise(F.lit(""))


def is_bare_host(href: Column) -> Column:
    """True for a host name without its scheme (``../www.site.org/a.html``)."""
    path = path_part(F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit("")).otherwise(href))
    first = F.split(F.regexp_replace(path, _LEADING_NAV, ""), "/")
    host = first[0]
    return (F.size(first) >= 2) & (host != "") & F.contains(host, F.lit(".")) & ~host.rlike(r"^\.")


def external_url(href: Column) -> Column:
    """The http URL a bare host names; query and fragment kept."""
    return F.concat(F.lit("http://"), F.regexp_replace(href, _LEADING_NAV, ""))


def is_same_site(href: Column) -> Column:
    """Kept by the crawler: not empty, not absolute or mail, not a bare host."""
    return (href != "") & ~href.rlike(r"^(?:https?://|mailto:)") & ~is_bare_host(href)


def is_safe_path(path: Column) -> Column:
    """False for an empty or absolute path, or one with an empty, ``.`` or ``..`` segment."""
    return ~F.exists(F.split(path, "/"), lambda part: part.isin("", ".", ".."))


def fold_path(path: Column) -> Column:
    """A joined path without ``.``, ``..`` and doubled slashes; leading ``..`` are kept."""
    relative = ~F.startswith(path, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        climbs = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        up = (
            F.when(climbs, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(relative, F.concat(done, F.array(part)))
            .otherwise(done)
        )
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    text = F.array_join(folded, "/")
    return F.when(~relative, F.concat(F.lit("/"), text)).when(text == "", F.lit(".")).otherwise(text)


def resolve_href(base: Column, href: Column) -> Column:
    """``struct(path, fragment, url)``: an in-corpus target, or the URL of an outside one."""
    link = F.trim(href)
    scheme = link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    bare = is_bare_host(link)
    path = path_part(link)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    joined = F.when(F.startswith(decoded, F.lit("/")), decoded).otherwise(F.concat(folder, decoded))
    inside = F.when(path == "", base).otherwise(fold_path(joined))
    outside = F.when(bare, external_url(link)).when(scheme, link)
    return F.struct(
        F.when(outside.isNull(), inside).alias("path"),
        F.when(outside.isNull(), fragment_part(link)).alias("fragment"),
        outside.alias("url"),
    )


def is_external_url(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).isin(*EXTERNAL_SCHEMES)


def relative_to_root(root: Column, url: Column) -> Column:
    """Path of ``url`` below ``root``; null outside it or when the path is unsafe."""
    rest = path_part(F.substr(url, F.length(root) + 1))
    return F.when(F.startswith(url, root) & is_safe_path(rest), rest)
