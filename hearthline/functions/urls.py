"""Addresses of pages: hosts, normal forms, links of a page."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of files that aren't pages.
ASSETS = "css js png jpg jpeg gif svg webp ico woff woff2 ttf map pdf zip mp4".split()
NEXT_PAGE = r"""(?is)<a\s[^>]*?rel\s*=\s*["']?next["']?[^>]*?href\s*=\s*["']([^"']+)"""


def host(url: Column) -> Column:
    """Lower-case host without a port; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(found, F.lit(""))


def domain(text: Column) -> Column:
    """"https://www.Site.cz/path" -> "site.cz": no scheme, www, path or port."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^(?:[a-z][a-z0-9+.\-]*:)?//", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^([^/?#:]*)", 1), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return domain(a).eqNullSafe(domain(b))


def is_asset(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^?#]*", 0)).rlike(r"\.(?:" + "|".join(ASSETS) + ")$")


def hrefs(html: Column) -> Column:
    """Targets of a page's links in order, with repeats."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href="([^"]*)\""""), 1)


def script_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<script\s[^>]*?src="([^"]*)\""""), 1)


def next_page(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, NEXT_PAGE, 1), F.lit(""))


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute address."""
    @F.pandas_udf("string")
    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        def one(b: str | None, x: str | None) -> str | None:
            try:
                return None if b is None or x is None else urljoin(b, x)
            except ValueError:
                return None

        return pd.Series([one(b, x) for b, x in zip(bases, links)], dtype=object)

    return run(base, link)


def listing_id(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^/inzerat/(\d+)/", 1), F.lit(""))


def page_kind(body: Column) -> Column:
    """listing, section or null of a fetched page."""
    return (F.when(body.rlike(r'<H1 class="?nadpisdetail"?>'), "listing")
            .when(body.contains('<div class="inzeraty inzeratyflex">') | body.rlike(r"(?i)<title>[^<]*inzerce</title>"), "section"))


def url_verdict(status: Column, asked: Column, reached: Column, location: Column, body: Column) -> Column:
    """What asking for a vanished listing's address says: unknown (it is gone), relisted, alive, or null (nothing can be concluded)."""
    path = lambda u: F.coalesce(F.parse_url(u, F.lit("PATH")), u)
    redirect = status.between(300, 399) & location.isNotNull() & F.coalesce(host(location) == host(asked), F.lit(True)) & ~path(location).startswith("/inzerat/")
    same = (path(asked) == path(reached)) | F.coalesce(listing_id(path(asked)) == listing_id(path(reached)), F.lit(False))
    kind, ok = page_kind(body), status.between(200, 299)
    return (F.when(status.isin(404, 410) | redirect, "unknown").when(ok & (kind == "listing") & same, "alive")
            .when(ok & (kind == "listing"), "relisted").when(ok & (kind == "section"), "unknown"))
