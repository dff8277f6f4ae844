"""Names, numbers, coordinates and markup in text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

#: Words of site names that mean the same, in this order.
SYNONYMS = ((r"\b(mount|mt\.?|mountain|mtn\.?)\b", "mt"), (r"\b(peak|pk\.?)\b", "pk"), (r"\b(point|pt\.?)\b", "pt"))


def normal_name(name) -> Column:
    x = F.lower(_c(name))
    for written, short in SYNONYMS:
        x = F.regexp_replace(x, written, short)
    return F.trim(F.regexp_replace(F.regexp_replace(x, "['`‘’]", ""), r"[^a-zA-Z0-9_\s]", " "))


def name_words(name) -> Column:
    """Distinct words of two letters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normal_name(name), r"\s+"), lambda w: F.length(w) > 1)))


def name_similarity(a, b) -> Column:
    """Jaccard similarity of the names' words; 1 if they are the same, 0.8 at least if one's words contain the other's."""
    return word_similarity(name_words(a), name_words(b))


def word_similarity(x: Column, y: Column) -> Column:
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    left, right = F.array_join(x, " "), F.array_join(y, " ")
    empty = x.isNull() | y.isNull() | (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(empty, 0.0).when(left == right, 1.0).when(F.contains(left, right) | F.contains(right, left), F.greatest(jaccard, F.lit(0.8))).otherwise(jaccard)


def clean(x) -> Column:
    """Without control characters, trimmed; an empty text is null."""
    return F.nullif(F.trim(F.regexp_replace(_c(x), r"[\x00-\x1F\x7F]", "")), F.lit(""))


def leading_number(x) -> Column:
    """The number a text begins with, else null."""
    found = F.regexp_extract(_c(x), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


#: Query parameters of map links that hold a place, as one pair or as two values, in order of trust. Fixed values.
URL_PLACES = (("q",), ("mlat", "mlon"), ("ll",), ("marker", "m"), ("lat", "lon"), ("lat", "lng"), ("lat", "long"))
_TWO = {("mlat", "mlon"), ("lat", "lon"), ("lat", "lng"), ("lat", "long")}


def url_value(url, *names: str) -> Column:
    """The first of a link's parameters that has one of the names, in any case; null if none has."""
    parts = F.transform(F.split(_c(url), "[?&#]"), lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.lit(1 << 20)).alias("v"), (F.instr(p, "=") > 0).alias("ok")))
    return F.get(F.filter(parts, lambda p: p["ok"] & p["k"].isin(*names)), F.lit(0))["v"]


def coords_from_url(url) -> tuple[Column, Column]:
    """(lat, lng) in a map link, from the first form of URL_PLACES that it has."""
    number = r"^(-?\d+(?:\.\d*)?|-?\.\d+)"
    read = lambda v, k: F.nullif(F.regexp_extract(v, number + ("," + number[1:] if k else ""), k or 1), F.lit(""))
    forms = []
    for names in URL_PLACES:
        if names in _TWO:
            forms.append([read(url_value(url, n), 0) for n in names])
        else:
            forms.append([read(url_value(url, *names), k) for k in (1, 2)])
    return tuple(F.coalesce(*[F.when(f[0].isNotNull() & f[1].isNotNull(), f[k].try_cast("double")) for f in forms]) for k in (0, 1))


#: An angle: degrees, then perhaps minutes and seconds. A decimal is one with three digits or more behind the point.
_ANGLE = r"\d{1,3}(?:\.\d+)?\s*(?:°\s*(?:(?:\d{1,2}(?:\.\d+)?)?\s*['′’]\s*(?:\d{1,2}(?:\.\d+)?\s*[\"″”]?)?)?)?"
_TOWARDS = rf"(?i:(?:[NSEW]\s*{_ANGLE}|{_ANGLE}\s*[NSEW]\b))"
_DECIMAL = r"[-+]?\d{1,3}\.\d{3,}"
_READ = r"(?i)^\s*([NSEW])?\s*([-+]?\d{1,3}(?:\.\d+)?)\s*(°)?\s*(?:(\d{1,2}(?:\.\d+)?)?\s*['′’])?\s*(?:(\d{1,2}(?:\.\d+)?)\s*[\"″”]?)?\s*([NSEW])?\s*$"


def angle(token: Column) -> Column:
    """(degrees, axis, minutes) of a written angle: south and west are negative; axis is lat, lng or null; minutes if it has a degree sign."""
    part = lambda k: F.nullif(F.regexp_extract(token, _READ, k), F.lit(""))
    size = part(2).try_cast("double") + F.coalesce(part(4).try_cast("double"), F.lit(0.0)) / 60 + F.coalesce(part(5).try_cast("double"), F.lit(0.0)) / 3600
    towards = F.upper(F.coalesce(part(1), part(6)))
    axis = F.when(towards.isin("N", "S"), "lat").when(towards.isin("E", "W"), "lng")
    return F.struct(F.when(towards.isin("S", "W"), -size).otherwise(size).alias("degrees"), axis.alias("axis"), F.contains(token, F.lit("°")).alias("sign"), part(4).isNotNull().alias("minutes"))


def _pairs(x: Column, token: str) -> Column:
    """Neighbouring angles, parted by blanks or a comma, as (lat, lng, dms)."""
    found = F.regexp_extract_all(x, F.lit(rf"({token}[\s,]+{token})"), F.lit(1))
    sides = rf"^({token})[\s,]+({token})$"
    read = F.transform(found, lambda s: F.struct(angle(F.regexp_extract(s, sides, 1)).alias("a"), angle(F.regexp_extract(s, sides, 2)).alias("b")))
    fit = F.filter(read, lambda r: F.coalesce(r["a"]["axis"], F.lit("lat")) == "lat")
    fit = F.filter(fit, lambda r: F.coalesce(r["b"]["axis"], F.lit("lng")) == "lng")
    return F.transform(fit, lambda r: F.struct(r["a"]["degrees"].alias("lat"), r["b"]["degrees"].alias("lng"), (r["a"]["minutes"] | r["b"]["minutes"]).alias("dms"), (r["a"]["sign"] & r["b"]["sign"]).alias("sign")))


def coords_from_dms(x) -> tuple[Column, Column]:
    """(lat, lng) of the first pair of angles with a direction before or behind them, minutes and seconds optional; null if out of range."""
    first = F.get(F.filter(_pairs(_c(x), _TOWARDS), lambda p: p["sign"] & (F.abs(p["lat"]) <= 90) & (F.abs(p["lng"]) <= 180)), F.lit(0))
    return first["lat"], first["lng"]


def coords_from_text(x) -> tuple[Column, Column]:
    """(lat, lng) of the first plausible pair: decimals with a direction, then signed decimals, then degrees and minutes."""
    text = unescape(x)
    towards = F.filter(_pairs(text, _TOWARDS), lambda p: plausible(p["lat"], p["lng"]))
    signed = F.filter(_pairs(text, _DECIMAL), lambda p: plausible(p["lat"], p["lng"]))
    first = F.coalesce(F.get(F.filter(towards, lambda p: ~p["dms"]), F.lit(0)), F.get(signed, F.lit(0)), F.get(F.filter(towards, lambda p: p["dms"]), F.lit(0)))
    return first["lat"], first["lng"]


def plausible(lat: Column, lng: Column) -> Column:
    """Within the globe, not next to the origin, and west of Greenwich where the latitude is that of the United States."""
    sound = (F.abs(lat) <= 90) & (F.abs(lng) <= 180) & (F.abs(lat) >= 1) & (F.abs(lng) >= 1)
    return F.coalesce(sound & ~((lat > 18) & (lat < 72) & (lng > 0)), F.lit(False))


def unescape(x) -> Column:
    """Common HTML entities decoded; the ampersand last."""
    out = _c(x)
    for written, char in (("&#0?39;|&apos;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&deg;", "°"), ("&amp;", "&")):
        out = F.regexp_replace(out, written, char)
    return out


def strip_tags(html) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_c(html), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(bare), r"\s+", " "))


def heading(html) -> Column:
    """Text of the first h1, else of the title; null if there is none."""
    inner = lambda tag: F.nullif(strip_tags(F.regexp_extract(_c(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return F.coalesce(inner("h1"), inner("title"))


def labelled_cell(html, label: str) -> Column:
    """Text of the table cell that follows the cell with the label."""
    found = F.regexp_extract(_c(html), rf"(?is)<t[dh][^>]*>[^<]*{label}[^<]*</t[dh]>\s*<td[^>]*>(.*?)</td>", 1)
    return F.nullif(strip_tags(found), F.lit(""))


def links(html) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))


def absolute_url(base, href) -> Column:
    b, h = _c(base), _c(href)
    root = F.regexp_extract(b, r"^([a-zA-Z][\w+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(b, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(h.rlike(r"^[a-zA-Z][\w+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(b, r"^([a-zA-Z][\w+.-]*:)", 1), h)).when(F.startswith(h, F.lit("/")), F.concat(root, h)).otherwise(F.concat(folder, h))


#: What a browser check's page says beside its maker's name.
CHECK_SIGNS = ("attention required", "checking your browser", "cf-chl", "cf-browser-verification")


def blocked_page(html, maker: str = "cloudflare", signs: tuple[str, ...] = CHECK_SIGNS) -> Column:
    """Whether a page is a browser check in place of its content."""
    t = F.lower(_c(html))
    return F.contains(t, F.lit(maker)) & reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in signs])


def url_path(url) -> Column:
    return F.regexp_extract(_c(url), r"^[a-zA-Z][\w+.-]*://[^/?#]+([^?#]*)", 1)


def followed(url, host: str, allow: str, deny: tuple[str, ...] = ()) -> Column:
    """Whether a crawl follows a link: on the host, with an allowed path, none of the denied parts, and a last part that is a slug."""
    path = F.lower(url_path(url))
    last = F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1)
    own = F.regexp_extract(_c(url), r"^[a-zA-Z][\w+.-]*://(?:www\.)?([^/?#:]+)", 1) == host
    good = own & path.rlike(allow) & F.coalesce(last.rlike(r"^[a-z0-9][a-z0-9-]*[a-z0-9]$"), F.lit(False))
    return reduce(lambda a, b: a & b, [~F.contains(path, F.lit(d)) for d in deny], good)


def table_rows(html) -> Column:
    """Cell texts of each table row."""
    rows = F.regexp_extract_all(_c(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_tags))


def feet_in(x) -> Column:
    """Metres of the first height in feet that a text names, with or without thousands separators."""
    found = F.regexp_extract(_c(x), r"(?i)(\d{1,2},\d{3}|\d{3,5})\s*(?:ft\b|feet\b|')", 1)
    return F.nullif(F.regexp_replace(found, ",", ""), F.lit("")).try_cast("double") * 0.3048


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def thousands(n) -> Column:
    return F.format_number(_c(n), 0)


def before_marker(x, marker: str) -> Column:
    """What a text says before a marker, without blanks at its end; the whole text if it has none."""
    return F.rtrim(F.substring_index(_c(x), marker, 1))


def some_of(names: Column, n: int = 3) -> Column:
    """The first n names, and how many more there are."""
    head, more = F.array_join(F.slice(names, F.lit(1), F.lit(n)), ", "), F.size(names) - n
    return F.when(more > 0, F.concat(head, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(head)


def notice(names: Column, one: str, many: str) -> tuple[Column, Column]:
    """Title and body of a notice about one or several things."""
    n = F.size(names)
    title = F.when(n == 1, F.lit(one)).otherwise(F.concat(n.cast("string"), F.lit(" "), F.lit(many)))
    return title, F.when(n == 1, F.get(names, F.lit(0))).otherwise(some_of(names))


def is_public(private) -> Column:
    """Whether an activity is public: its private flag is false, as a boolean or as text."""
    return F.coalesce(F.lower(_c(private).cast("string")) == "false", F.lit(False))


def percent(n, total, digits: int = 1) -> Column:
    """n of total in percent; 0 of nothing."""
    return F.when(_c(total) == 0, 0.0).otherwise(F.round(100.0 * _c(n) / _c(total), digits))


def property_of(properties, *names: str) -> Column:
    """The first non-empty property that has one of the names, in any case, in the order of the names."""
    lower = F.transform_keys(F.coalesce(_c(properties), F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    return F.coalesce(*[F.nullif(clean(F.try_element_at(lower, F.lit(n.lower()))), F.lit("")) for n in names])


#: The states' codes by their names.
STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA",
    "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC",
    "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}


def state_of(name) -> Column:
    """A state's code by its name; null for any other text."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STATE_CODES.items() for x in pair]), _c(name))


def short_code(code) -> Column:
    """"us-ca" -> "CA"; null without a second part."""
    return F.nullif(F.upper(F.split_part(_c(code), F.lit("-"), F.lit(2))), F.lit(""))


#: Elevation sources by a part of the raster's path, and the one of any other.
RASTERS, RASTER = (("1m", "usgs_3dep_1m"), ("10m", "usgs_3dep_10m")), "usgs_3dep"


def raster_source(path, given: str | None = None) -> Column:
    """The name of a raster's elevation source: the one given, else what its path tells."""
    return F.coalesce(F.lit(given), *[F.when(F.contains(_c(path), F.lit(part)), F.lit(name)) for part, name in RASTERS], F.lit(RASTER))


def padded(x, width: int, right: bool = False) -> Column:
    """A text of exactly so many characters, blank behind it or before it."""
    return (F.lpad if right else F.rpad)(F.coalesce(_c(x).cast("string"), F.lit("")), width, " ")


def fixed(x, digits: int) -> Column:
    """A number with so many decimals; a question mark for what isn't one."""
    number = _c(x).cast("string").try_cast("double")
    return F.when(number.isNull(), "?").otherwise(F.format_string(f"%.{digits}f", number))
