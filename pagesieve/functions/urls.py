"""Address functions (U1-U3) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCH_PREFIX = "https://www.google.com/search?q="


def authority(url: Column) -> Column:
    """Host with user and port; '' for an address without `//`."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """Authority without a leading `www.`."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def registrable(url: Column) -> Column:
    """Last two labels of the authority; NULL if it has fewer."""
    host = authority(url)
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -2))


def normalise_address(typed: Column, search_prefix: str = SEARCH_PREFIX) -> Column:
    """A search for what cannot be an address, else an address with a scheme."""
    search = F.concat(F.lit(search_prefix), F.replace(typed, F.lit(" "), F.lit("+")))
    has_scheme = F.startswith(typed, F.lit("http://")) | F.startswith(typed, F.lit("https://"))
    return (
        F.when(F.contains(typed, F.lit(" ")) | ~F.contains(typed, F.lit(".")), search)
        .when(has_scheme, typed)
        .otherwise(F.concat(F.lit("https://"), typed))
    )


def resolve(href: Column, base: Column) -> Column:
    """Absolute address of a link found on page `base` (RFC 3986), without its fragment."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_fragment = F.substring_index(base, "#", 1)
    no_query = F.substring_index(no_fragment, "?", 1)
    folder = F.when(no_query == site, F.concat(site, F.lit("/"))).otherwise(
        F.regexp_replace(no_query, r"[^/]*$", "")
    )
    link = F.substring_index(F.trim(href), "#", 1)
    return without_dots(
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(no_query, link))
        .when(link == "", no_fragment)
        .otherwise(F.concat(folder, link))
    )


def without_dots(url: Column) -> Column:
    """An address whose path has no `.` and `..` segments; one that leads above the root stays there."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)(/[^?#]*)", 1)
    path = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)(/[^?#]*)", 2)
    rest = F.substring(url, F.length(site) + F.length(path) + 1, F.length(url))
    # `.` and `..` at the end name a folder
    segments = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")

    def walk(done: Column, segment: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    # the first segment is the empty one in front of the root and stays
    walked = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), walk)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(site, F.array_join(walked, "/"), rest)).otherwise(url)
