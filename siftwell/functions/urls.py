"""URL and file-name functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE = "https://wiki.example.org"

#: Paths that a crawl leaves out (fixed values).
DENIED = (
    r"/w/Bucket:", r"/w/File:", r"/w/User:", r"/w/Special:", r"/w/Talk:", r"/w/Template:", r"/w/Category:", r"/w/Help:", r"/w/MediaWiki:", r"/api\.php",
    r"/cdn-cgi/", r"/cors/", r"/rest_v1/", r"/rest\.php/", r"/tags/", r"\?action=", r"\?oldid=", r"\?diff=", r"\?curid=", r"\?search=",
)
#: Namespaces whose pages are no link targets (fixed values).
NAMESPACES = ("Category", "File", "Template", "Module", "Help", "Talk", "User", "MediaWiki", "Special")
#: Parts of image URLs that stand for decoration (fixed values).
DECORATION = ("editor", "sprite", "icon", "placeholder", "button")
INVALID = r'[<>:"/\\|?*]'


def allowed(url: Column, denied: tuple[str, ...] = DENIED) -> Column:
    return ~url.rlike("(?i)" + "|".join(denied))


def is_decoration(url: Column) -> Column:
    low = F.lower(url)
    out = F.lit(False)
    for part in DECORATION:
        out = out | F.contains(low, F.lit(part))
    return out


def is_vector_image(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(svg|gif)$")


def unquote(c: Column) -> Column:
    """Percent-decoding that leaves + alone; what cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def href_to_title(href: Column, prefix: str = "/w/") -> Column:
    """The page title that a link names; null for other links and for pages of special namespaces."""
    path = F.regexp_extract(href, f"^{prefix}([^#?]*)", 1)
    title = F.replace(unquote(path), F.lit("_"), F.lit(" "))
    special = title.rlike("^(" + "|".join(NAMESPACES) + "):")
    return F.when((path != "") & ~special, title)


def title_to_url(title: Column, site: str = SITE) -> Column:
    return F.concat(F.lit(f"{site}/w/"), F.replace(title, F.lit(" "), F.lit("_")))


def normal_path(url: Column) -> Column:
    """What follows the last /w/, lower-cased."""
    return F.lower(F.element_at(F.split(url, "/w/"), -1))


def path_to_filename(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/]*([^?#]*)", 1), "^/(w/)?", "")
    return F.concat(F.regexp_replace(path, INVALID, "_"), F.lit(".html"))


def original_url(url: Column) -> Column:
    """A thumbnail's original."""
    return F.regexp_replace(url, r"^(.*?)/thumb/(.+)/[^/]+$", "$1/$2")


def absolute(url: Column, site: str = SITE) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(site), url)).otherwise(url)


def image_filename(url: Column, folder: str = "/images/") -> Column:
    """The local file name of an image URL (thumbnails: of the original); null if it is none."""
    clean = unquote(F.regexp_replace(url, r"[?#].*$", ""))
    path = F.coalesce(
        F.nullif(F.regexp_extract(clean, rf"{folder}thumb/(.+)/[^/]+$", 1), F.lit("")), F.nullif(F.regexp_extract(clean, rf"{folder}(.+)$", 1), F.lit(""))
    )
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(stem != "", F.concat(F.regexp_replace(stem, INVALID, "_"), F.lit(".webp")))
