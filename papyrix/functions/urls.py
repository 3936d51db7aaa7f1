"""URL and link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings of static pages.
STATIC = tuple("html htm xhtml shtml css js json jpg jpeg png gif svg webp ico pdf doc docx ppt pptx xls xlsx txt csv xml woff woff2 ttf eot".split())

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def domain(url: Column) -> Column:
    """The authority, with user and port as they are."""
    return F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def is_static(url: Column) -> Column:
    """By the ending of the path; else dynamic with a query; else static if the path ends in / or its last part has no dot."""
    p = path(url)
    return F.lower(p).rlike(r"\.(" + "|".join(STATIC) + ")$") | (~url.rlike(r"^[^#]*\?.") & (p.endswith("/") | ~F.regexp_extract(p, "([^/]*)$", 1).contains(".")))


def html_links(html: Column) -> Column:
    """All href values of a elements, in page order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))


def resolve(base: Column, href: Column) -> Column:
    """An href against its page: absolute, //host, /path, ?query, #fragment or relative to the page's folder."""
    scheme, host = F.regexp_extract(base, "^([^:/?#]+:)//", 1), F.regexp_extract(base, "^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), "^(.*/)", 1)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("?"), F.concat(host, path(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .when(href == "", base)
        .otherwise(F.concat(host, F.when(folder == "", "/").otherwise(folder), href))
    )
