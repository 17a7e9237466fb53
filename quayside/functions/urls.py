"""URLs: four normal forms, kept apart because they serve different comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: base-64 alphabet of post shortcodes.
SHORTCODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def http_url(url: Column) -> Column:
    """With a scheme (https where none is given); null for anything but http and https."""
    text = F.trim(url)
    full = (
        F.when(text.rlike("(?i)^https?://[^/\\s]+"), text)
        .when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(text.rlike(r"^[a-zA-Z0-9-]+(\.[a-zA-Z0-9-]+)+([/?#]|$)"), F.concat(F.lit("https://"), text))
    )
    return F.when(~full.rlike(r"\s"), full)


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def rsvp_identity(url: Column) -> Column:
    """Host and path in normal form with sorted query, without tracking; null for a bare site."""
    host = F.regexp_replace(F.lower(_part(url, "HOST")), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(_part(url, "PATH"), F.lit("")), "/+$", "")
    kept = F.filter(F.split(F.coalesce(_part(url, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(utm_[a-z]*|fbclid)="))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when((path != "") | (query != ""), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def canonical_url(url: Column) -> Column:
    """Scheme, host and path only."""
    return F.concat(F.lower(_part(url, "PROTOCOL")), F.lit("://"), F.lower(_part(url, "HOST")), F.regexp_replace(F.coalesce(_part(url, "PATH"), F.lit("")), "/+$", ""))


def media_key(url: Column) -> Column:
    """The file name of the path without its ending."""
    name = F.regexp_extract(F.coalesce(_part(url, "PATH"), F.lit("")), "([^/]+)/?$", 1)
    return F.nullif(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(""))


def shortcode_to_media_id(code: Column) -> Column:
    """The number that a shortcode writes in base 64, as decimal(20)."""
    digits = F.filter(F.transform(F.split(code, ""), lambda c: F.when(c != "", F.instr(F.lit(SHORTCODE), c) - 1)), lambda d: d.isNotNull())
    zero = F.lit(0).cast("decimal(20,0)")
    return F.aggregate(digits, zero, lambda total, d: (total * 64 + d).cast("decimal(20,0)"))


#: Fixed: a post's permalink; the third group is its shortcode.
PERMALINK = r"^https?://(www\.)?instagram\.com/(p|reel|tv)/([A-Za-z0-9_-]{1,11})/?([?#]|$)"


def permalink_media_id(url: Column) -> Column:
    """The number of the post that a permalink names, null for other links."""
    code = F.regexp_extract(F.coalesce(url, F.lit("")), PERMALINK, 3)
    return F.when(code != "", shortcode_to_media_id(code))


def media_id_to_shortcode(number: Column) -> Column:
    """A number in base 64, eleven digits."""
    letters = (F.substring(F.lit(SHORTCODE), (F.shiftrightunsigned(number.cast("long"), 6 * i).bitwiseAND(63) + 1).cast("int"), F.lit(1)) for i in reversed(range(11)))
    return F.concat(*letters)


def is_storage_path(path: Column) -> Column:
    return path.rlike(r"^[a-z0-9_]+/[0-9]+/[0-9]+\.(jpg|png|webp)$")


def storage_path(owner: Column, media_id: Column, index: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(F.lower(owner), "[^a-z0-9_]", "_"), media_id.cast("string"), F.concat(index.cast("string"), F.lit(".jpg")))


# Hosts of short links, and of maps, which lead to no form.
SHORTENERS = ("bit.ly", "tinyurl.com", "forms.gle")
MAP_HOSTS = ("maps.app.goo.gl", "maps.google.com", "maps.apple.com", "maps.apple", "waze.com", "ul.waze.com")
_SHORT_LINK = r"(?i)^(https?://)?(bit\.ly|tinyurl\.com|forms\.gle)/[\w-]+([ \t]+[\w-]+)+$"


def rsvp_url(url: Column, slide_text: Column) -> Column:
    """A link to sign up: no post, no bare short-link site, no map.

    A short link with spaces in it is joined only where it is a whole line of the slide's text.
    """
    bare = F.trim(url)
    lines = F.transform(F.split(F.lower(F.coalesce(slide_text, F.lit(""))), r"\r?\n"), lambda line: F.trim(line))
    joined = F.when(bare.rlike(_SHORT_LINK) & F.array_contains(lines, F.lower(bare)), http_url(F.regexp_replace(bare, r"[ \t]+", "")))
    full = F.coalesce(http_url(url), joined)
    host = F.regexp_replace(F.lower(_part(full, "HOST")), r"^www\.", "")
    path = F.coalesce(_part(full, "PATH"), F.lit(""))
    first = F.lower(F.regexp_extract(path, "^/*([^/]*)", 1))
    post = host.rlike(r"(^|\.)instagram\.com$") | (host == "instagr.am")
    empty = host.isin(*SHORTENERS) & (F.regexp_replace(path, "/", "") == "")
    maps = host.isin(*MAP_HOSTS) | host.startswith("maps.google.") | ((first == "maps") & ((host == "goo.gl") | host.rlike(r"^google\.[a-z.]+$")))
    return F.when(~(post | empty | maps), full)


def is_stored_image(url: Column, storage_host: str) -> Column:
    """Whether an image may go through the optimizer: https, of a content network's subdomain, or a flyer of the own storage."""
    host, path = F.lower(_part(url, "HOST")), F.coalesce(_part(url, "PATH"), F.lit(""))
    own = (host == storage_host) & path.startswith("/storage/v1/object/public/event-flyers/")
    return F.coalesce((F.lower(_part(url, "PROTOCOL")) == "https") & (host.rlike(r".\.cdninstagram\.com$") | own), F.lit(False))
