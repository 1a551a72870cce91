"""Record projections and admission rules of the feeds as Column expressions, with the code tables they go by."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo, text


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(_map(table), key)


# Fires

#: What the letters of a detection's confidence count for.
CONFIDENCE = {"l": 0.3, "n": 0.6, "h": 0.9}


def confidence(x) -> Column:
    """l, n, h or 0 to 100 as 0 to 1."""
    c = F.lower(F.trim(_c(x).cast("string")))
    return F.coalesce(_looked_up(CONFIDENCE, c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.try_cast("double") / 100)))


def sensor(x) -> Column:
    """VIIRS or MODIS, else the first twelve characters in capitals."""
    c = F.upper(F.coalesce(_c(x), F.lit("")))
    return F.when(c.contains("VIIRS"), "VIIRS").when(c.contains("MODIS"), "MODIS").otherwise(F.substring(c, 1, 12))


#: Short names of satellites by what feeds call them.
SATELLITES = {"N20": "N20", "NOAA-20": "N20", "N21": "N21", "NOAA-21": "N21", "N": "SNPP", "NPP": "SNPP", "SUOMI NPP": "SNPP"}


def satellite(x) -> Column:
    c = F.upper(F.trim(F.coalesce(_c(x), F.lit(""))))
    return F.coalesce(_looked_up(SATELLITES, c), F.substring(c, 1, 6))


def detection_key(source: str, lat, lon, acquired, kind) -> Column:
    """source:lat:lon:acquired:kind with the place cut to four decimals: the same detection in two snapshots has one key."""
    place = (F.format_string("%.4f", (F.floor(_c(x) * 10000) / 10000).cast("double")) for x in (lat, lon))
    return F.concat_ws(":", F.lit(source), *place, _c(acquired).cast("string"), _c(kind).cast("string"))


# Aircraft and vessels

#: Type designators by class; the first class that has a code takes it. Other codes are airliners.
AIRCRAFT = {
    "fastjet": "F15 F16 F18 F22 F35 A10 EUFI RFAL TOR T38 HAWK",
    "uav": "Q4 Q9 HRON",
    "helicopter": "A109 A119 A139 A169 A189 AC AS32 AS50 AS55 AS65 B06 B06T B105 B212 B214 B222 B407 B412 B427 B429 B430 B505 EC20 EC25 EC30 EC35 EC45 EC55 EXEC EXPL GAZL H47 H500 H60 H64 LYNX MD52 MD60 NH90 PUMA R22 R44 R66 S61 S64 S76 S92 SCAV UH1",
    "quadjet": "A124 A342 A343 A345 A346 A388 B741 B742 B743 B744 B748 C5M",
    "widebody": "A306 A310 A332 A333 A338 A339 A359 A35K B762 B763 B764 B772 B77L B77W B788 B789 B78X C17 K35R MD11",
    "turboprop": "AT43 AT45 AT72 AT75 AT76 B190 BE20 BE9L C208 C130 DH8A DH8B DH8C DH8D PC12 SF34 TBM9",
    "glider": "ASK21 DG1T GLID LS8",
    "bizjet": "C25A C25B C560 C56X C68A C700 C750 CL30 CL35 CL60 E50P E55P F2TH F900 FA7X GL5T GLEX GLF4 GLF5 GLF6 H25B LJ45 LJ60",
    "light": "BE36 BE58 C150 C152 C172 C182 C206 C210 DA40 DA42 M20P P28A P32R PA34 PA46 SR20 SR22",
}
#: Classes of emitter categories.
EMITTERS = {"A1": "light", "A2": "light", "A3": "airliner", "A4": "airliner", "A5": "widebody", "A6": "fastjet", "A7": "helicopter", "B1": "glider"}


def aircraft_class(code, category, codes: dict[str, str] | None = None) -> Column:
    """The class by type designator, else by emitter category, else airliner. codes: designators by class (AIRCRAFT)."""
    known: dict[str, str] = {}
    for kind, listed in (AIRCRAFT if codes is None else codes).items():
        for x in listed.split():
            known.setdefault(x, kind)
    c, e = (F.upper(F.trim(F.coalesce(_c(x), F.lit("")))) for x in (code, category))
    return F.when(c != "", F.coalesce(_looked_up(known, c), F.lit("airliner"))).otherwise(F.coalesce(_looked_up(EMITTERS, e), F.lit("airliner")))


def classified(rows: DataFrame, types: DataFrame, code: str, category: str) -> DataFrame:
    """rows with `class`: by a dimension table of designators (code, class), else as `aircraft_class` says.

    A table of any size serves where AIRCRAFT is too short; of a designator that it repeats the first class by name counts.
    """
    table = types.groupBy(F.upper(F.trim("code")).alias("_code")).agg(F.min("class").alias("_class"))
    j = rows.join(table, F.upper(F.trim(F.col(code))) == F.col("_code"), "left")
    return j.withColumn("class", F.coalesce("_class", aircraft_class(code, category))).drop("_code", "_class")


#: The feet below which an airborne aircraft flies low.
LOW_FEET = 3000


def low_flyer(kind, on_ground, feet) -> Column:
    """Why an aircraft counts as a low flyer: helicopter, low, or null."""
    return F.when(_c(kind) == "helicopter", "helicopter").when(~F.coalesce(_c(on_ground), F.lit(False)) & (_c(feet) <= LOW_FEET), "low")


#: Families of ship type codes by their first digit, and codes that have a name of their own.
SHIP_FAMILIES = {4: "HIGH-SPEED", 6: "PASSENGER", 7: "CARGO", 8: "TANKER", 9: "OTHER"}
SHIP_CODES = {30: "FISHING", 31: "TOWING", 32: "TOWING", 33: "DREDGER", 34: "DIVING", 35: "MILITARY", 36: "SAILING", 37: "PLEASURE", 50: "PILOT", 51: "SAR", 52: "TUG", 53: "PORT TENDER", 54: "ANTI-POLLUTION", 55: "LAW ENFORCE", 58: "MEDICAL"}


def vessel_type(x) -> Column:
    """A ship type code of one or two digits as its name or family; other texts as they are."""
    c = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    code = c.try_cast("int")
    named = F.coalesce(_looked_up(SHIP_CODES, code), _looked_up(SHIP_FAMILIES, F.floor(code / 10).cast("int")), F.lit("OTHER"))
    return F.when(~c.rlike(r"^\d{1,2}$"), c).when(code <= 0, "").otherwise(named)


def satellite_class(group, catalog, classes: dict[str, str], station: int = 25544) -> Column:
    """The class of an element set by its group; the space station is its own, whatever group lists it."""
    return F.when(_c(catalog) == station, "station").otherwise(F.coalesce(_looked_up(classes, _c(group)), F.lit("other")))


# Weather, quakes, places

#: Labels of the weather codes from and to.
WEATHER = ((0, 0, "CLEAR"), (1, 2, "PARTLY CLOUDY"), (3, 3, "OVERCAST"), (45, 45, "FOG"), (48, 48, "FOG"), (51, 57, "DRIZZLE"), (61, 67, "RAIN"), (71, 77, "SNOW"), (80, 82, "RAIN SHOWERS"), (85, 86, "SNOW SHOWERS"), (95, 1 << 30, "THUNDERSTORM"))


def weather_label(code) -> Column:
    c = _c(code)
    return F.when(c.isNull(), "CONDITIONS UNKNOWN").otherwise(F.coalesce(*(F.when(c.between(a, b), x) for a, b, x in WEATHER), F.lit("MIXED CONDITIONS")))


def utc_minute(x) -> Column:
    """A time to the minute without a zone, as UTC; null if it is anything else."""
    return F.when(_c(x).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d$"), F.concat(_c(x), F.lit("Z")))


def depth_band(km) -> Column:
    """Shallow to 70 km, intermediate to 300 km, deep beyond."""
    return F.when(_c(km) < 70, "shallow").when(_c(km) < 300, "intermediate").when(_c(km).isNotNull(), "deep")


#: Installation classes of mapped military tags, and the labels of classes that need one.
MILITARY = {"airfield": "airfield", "naval_base": "naval_base", "range": "range", "barracks": "military_land", "base": "military_land"}
MILITARY_LABELS = {"airfield": "Military airfield", "naval_base": "Naval base", "range": "Firing range", "military_land": "Military land"}


def installation_class(military, landuse) -> Column:
    return F.coalesce(_looked_up(MILITARY, F.lower(_c(military))), F.when(_c(landuse) == "military", "military_land"))


def installation_label(kind) -> Column:
    """The label of a class; another one is written out, an empty one is a mapped installation."""
    k = F.lower(F.trim(F.coalesce(_c(kind), F.lit(""))))
    words = F.trim(F.replace(k, F.lit("_"), F.lit(" ")))
    plain = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))
    return F.coalesce(_looked_up(MILITARY_LABELS, k), F.when(words == "", "Mapped installation").otherwise(plain))


def metres(x) -> Column:
    """A height such as 12, 12,5 m or 40 ft in metres; null if it is none above 0."""
    c = _c(x)
    n = F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(n > 0, F.when(c.rlike(r"(?i)(\d|\b)(ft|feet|foot)\b"), n * geo.FOOT).otherwise(n))


def building_height(tags) -> Column:
    """Height by a map of tags: explicit, else 3.3 metres a level and the roof; null if neither is there."""
    t = _c(tags)
    at = lambda k: F.try_element_at(t, F.lit(k))
    levels = F.regexp_extract(at("building:levels"), r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    explicit = F.coalesce(metres(at("height")), metres(at("building:height")))
    return F.coalesce(explicit, F.when(levels > 0, levels * 3.3 + F.coalesce(metres(at("roof:height")), F.lit(0.0))))


def place_label(*parts) -> Column:
    """The parts that are there, each once, comma-joined; null if none is."""
    some = F.array_distinct(F.filter(F.array(*(F.nullif(F.trim(_c(p)), F.lit("")) for p in parts)), lambda x: x.isNotNull()))
    return F.nullif(F.array_join(some, ", "), F.lit(""))


def best_level(note) -> Column:
    """The best (lowest) adult level that a note names, else the best pediatric one: Level I to V or 1 to 5."""
    roman = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5}
    levels = lambda pattern: F.array_min(F.transform(F.regexp_extract_all(_c(note), F.lit(pattern), 1), lambda x: F.coalesce(x.try_cast("int"), _looked_up(roman, F.upper(x)))))
    adult = levels(r"(?i)(?<!pediatric )level (IV|V|I{1,3}|[1-5])\b(?! pediatric)")
    return F.coalesce(adult, levels(r"(?i)level (IV|V|I{1,3}|[1-5])\b"))


# Layers and feeds

#: Feed states, the most severe first.
SEVERITY = ("unavailable", "loading", "degraded", "stale", "fallback", "partial", "nominal", "off")
#: States in which a layer asks the user for something.
GUIDANCE = ("zoom-in", "idle", "ready", "search")


def feed_state(status, error=None, loading=None, fallback=None, stale=None, degraded=None, partial=None, available=None, count=None) -> Column:
    """The state of a feed from what it reports, by precedence; arguments that are left out are not reported."""
    no = F.lit(False)
    flag = lambda x: no if x is None else F.coalesce(_c(x), no)
    s = F.lower(F.coalesce(_c(status), F.lit("")))
    failed = (no if error is None else F.coalesce(_c(error), F.lit("")) != "") | (no if available is None else ~F.coalesce(_c(available), F.lit(True)))
    had = no if count is None else F.coalesce(_c(count), F.lit(0)) > 0
    asks = s.isin(*GUIDANCE)
    return (
        F.when(s.isin("unavailable", "offline", "down", "error") | (failed & ~had & ~asks), "unavailable").when(flag(loading), "loading").when(asks, F.when(flag(stale), "stale").otherwise("nominal"))
        .when(flag(fallback) | (s == "fallback"), "fallback").when(flag(stale) | (s == "stale"), "stale").when(flag(degraded) | failed, "degraded").when(flag(partial), "partial").otherwise("nominal")
    )


def worst_state(state) -> Column:
    """Aggregate: the most severe state of a group."""
    return F.min_by(_c(state), F.array_position(F.array(*map(F.lit, SEVERITY)), _c(state)))


def flags(named: dict[str, Column]) -> Column:
    """The names whose condition holds, comma-joined."""
    return F.concat_ws(", ", *(F.when(c, n) for n, c in named.items()))


def sentence(x) -> Column:
    """Lower case but for the first letter."""
    low = F.lower(_c(x))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low)))


def safe_number(x) -> Column:
    """A number, or null where it is not finite."""
    c = _c(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def or_item(x, n) -> Column:
    """An identifier, or item-00001 by a number where there is none."""
    return F.coalesce(F.nullif(F.trim(_c(x)), F.lit("")), F.format_string("item-%05d", _c(n)))


def shown(x, kind) -> Column:
    """A value as reports print it: count, percent, money or text; a missing one is a dash."""
    v = _c(x)
    return F.when(v.isNull(), "—").otherwise(F.when(kind == "count", F.format_number(F.floor(v), 0)).when(kind == "percent", F.concat(F.format_string("%.1f", v.cast("double")), F.lit("%"))).when(kind == "money", F.concat(F.lit("$"), F.format_number(F.floor(v), 0))).otherwise(v.cast("string")))


#: What route hints say about the mode, in order.
MODES = ((r"(?i)\b(subway|metro|rail|train|steel)\b", "rail"), (r"(?i)\b(tram|streetcar|light rail|copper)\b", "tram"), (r"(?i)\b(ferry|boat|tin)\b", "ferry"), (r"(?i)\bbus\b", "bus"))


def transit_mode(hint, default) -> Column:
    """The mode that a route's hint names, else the feed's default, else unknown."""
    return F.coalesce(*(F.when(_c(hint).rlike(p), m) for p, m in MODES), _c(default), F.lit("unknown"))


def clamped(x, low: float, high: float, default: float | None = None) -> Column:
    v = _c(x) if default is None else F.coalesce(_c(x), F.lit(default))
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def completeness(flags_: list[Column], sizes: list[Column], most: int = 3) -> Column:
    """A point for each condition that holds, and one for each element of arrays of that size, up to `most` an array."""
    out = F.lit(0)
    for c in flags_:
        out = out + F.when(c, 1).otherwise(0)
    for s in sizes:
        out = out + F.least(s, F.lit(most))
    return out


#: Shares of the free speed from which traffic is free, or slow.
FREE, SLOW = 0.85, 0.55


def congestion(level) -> Column:
    return F.when(_c(level) >= FREE, "free").when(_c(level) >= SLOW, "slow").when(_c(level).isNotNull(), "jam")


def rate(count, people, per: float = 100_000.0, digits: int = 3) -> Column:
    """Count a `per` people; null if either is missing or nobody is there."""
    p = _c(people)
    return F.round(_c(count) * per / F.when(p > 0, p), digits)


def first_name(x) -> Column:
    """What stands before the first &, comma, slash or and."""
    return F.nullif(F.trim(F.element_at(F.split(_c(x), r"[&,/]|\band\b"), 1)), F.lit(""))


def path_index(*parts) -> Column:
    """The parts as a path, lower-cased words joined by -; null if one is missing or empty."""
    slugs = [text.slug(p) for p in parts]
    ok = F.lit(True)
    for s in slugs:
        ok = ok & F.coalesce(s != "", F.lit(False))
    return F.when(ok, F.concat_ws("/", *slugs))


def padded(x, digits: int) -> Column:
    """A number as text with leading zeros; null if it is no whole number of at most so many digits."""
    c = F.trim(_c(x).cast("string"))
    return F.when(c.rlike(rf"^\d{{1,{digits}}}$"), F.lpad(c, digits, "0"))


# Admission rules

#: Kinds of large parks and the acres from which on they are large; road classes and accesses; the span in
#: which a page is about an incident.
PARK_KINDS, PARK_ACRES = ("national-park", "national-forest", "state-park", "tribal-park"), 1000
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "minor")
CLOSED_ROADS = ("no", "private", "destination", "customers", "delivery", "agricultural", "forestry")
DAY_MS = 86_400_000


def large_park(kind, measured, acres) -> Column:
    return _c(kind).isin(*PARK_KINDS) & (F.greatest(_c(measured), F.coalesce(_c(acres), F.lit(0.0))) >= PARK_ACRES)


def drivable(kind, subclass, service, access, brunnel, indoor) -> Column:
    """Whether through traffic may use a mapped road on the surface."""
    none = lambda x: F.coalesce(_c(x).cast("string"), F.lit("")).isin("", "0", "false")
    return F.coalesce(_c(kind).isin(*ROADS), F.lit(False)) & none(subclass) & none(service) & ~F.coalesce(_c(access), F.lit("")).isin(*CLOSED_ROADS) & (F.coalesce(_c(brunnel), F.lit("")) != "tunnel") & none(indoor)


def radio_tag(x) -> Column:
    """A station's tag: lower case, _ and - as blanks, at most 80 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), "[_-]+", " "), r"\s+", " "), 1, 80)


def radio_tags(x) -> Column:
    """The tags of a comma list, each once, at most 24."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), radio_tag), lambda t: t != "")), 1, 24)


#: What tags of a category hold, and genres of music.
RADIO = {
    "news": ("news", "current affairs", "journalism"), "talk": ("talk", "spoken word", "interview", "podcast"), "weather": ("weather", "emergency", "noaa"),
    "public-safety": ("public safety", "scanner", "police", "fire", "ems", "dispatch", "emergency"), "aviation-marine": ("aviation", "air traffic", "atc", "airport", "marine", "maritime", "coast guard"),
    "traffic-transit": ("traffic", "transit", "transport", "rail", "metro"),
}
GENRES = ("alternative", "ambient", "blues", "classical", "country", "dance", "electronic", "folk", "funk", "hip hop", "house", "indie", "jazz", "latin", "metal", "oldies", "pop", "punk", "r&b", "reggae", "rock", "soul")


def radio_category(tags, category: str) -> Column:
    """Whether a station with such tags is of a category: a listed one, genre:x, music, or other (none of the rest)."""
    t = _c(tags)

    def has(needles) -> Column:
        return F.exists(t, lambda x: x.rlike("|".join(map(re.escape, needles))))

    if category == "all":
        return F.lit(True)
    if category.startswith("genre:"):
        return has([category.removeprefix("genre:")])
    if category == "music":
        return has([*GENRES, "music", "hits", "songs"])
    if category == "other":
        return ~has([*GENRES, "music", "hits", "songs", *(n for x in RADIO.values() for n in x)])
    return has(RADIO[category])


def contains_any(wanted: str, *columns) -> Column:
    """Whether any of some texts holds a wanted one, whatever the case."""
    return F.exists(F.array(*(F.coalesce(F.lower(_c(c)), F.lit("")) for c in columns)), lambda x: x.contains(wanted.lower()))


def identifier(x, most: int = 256) -> Column:
    """Whether a text may be an identifier: not empty, at most so many bytes, no control character, no slash."""
    c = _c(x)
    return (F.octet_length(c) > 0) & (F.octet_length(c) <= most) & ~c.rlike(r"[\x00-\x1f\x7f/\\]")


def current_publication(created_ms, changed_ms, discovered_ms, now_ms) -> Column:
    """Whether a page is about an incident: made from 60 days before its discovery on, else changed within 180 days."""
    created, changed, found = _c(created_ms), _c(changed_ms), _c(discovered_ms)
    return F.when(created.isNotNull() & found.isNotNull(), created >= found - 60 * DAY_MS).when(changed.isNotNull(), _c(now_ms) - changed <= 180 * DAY_MS).otherwise(False)


def failed_status(x) -> Column:
    """Whether a status names a failure."""
    return F.coalesce(_c(x).rlike(r"(?i)\b(fail(ed|ure)?|anomaly|lost|partial failure)\b"), F.lit(False))


def trailing(at_ms, now_ms, before_ms: int = DAY_MS, after_ms: int = 2 * 3_600_000) -> Column:
    """Whether a time lies from `before_ms` before now to `after_ms` after it, both included."""
    return _c(at_ms).between(_c(now_ms) - before_ms, _c(now_ms) + after_ms)


#: Bounds of a map query: metres around a point, degrees of a box.
MOST_AROUND_M, MOST_BOX_DEGREES = 50_000, 12.0
_NUMBER = r"(-?\d+(?:\.\d+)?)"


def bounded_query(x) -> Column:
    """Why a map query is refused, or null: every selector must be bounded by a small radius or box of its own.

    Texts in quotes and comments are blanked first. A selector that is bounded through a named set only, which the
    statement before it would have to bound, is refused as well.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(x), r'"(?:[^"\\]|\\.)*"', '""'), r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    around = F.transform(F.regexp_extract_all(plain, F.lit(r"(?i)around(?:\.\w+)?:\s*([\d.eE+-]+)"), 1), lambda n: n.try_cast("double"))
    box = rf"\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)"
    side = lambda k: F.transform(F.regexp_extract_all(plain, F.lit(box), k), lambda n: n.try_cast("double"))
    wide = F.zip_with(F.zip_with(side(3), side(1), lambda a, b: F.abs(a - b)), F.zip_with(side(4), side(2), lambda a, b: F.abs(a - b)), lambda a, b: F.greatest(a, b))
    statements = F.transform(F.split(plain, ";"), lambda s: F.trim(F.regexp_replace(s, r"\[[^\]]*\]", " ")))
    selectors = F.filter(statements, lambda s: s.rlike(r"(?i)^\(?\s*(node|way|rel|relation|nwr|nw|nr|wr|area)\b"))
    loose = F.exists(selectors, lambda s: ~(s.rlike(r"(?i)around:\s*\d") | s.rlike(box) | s.rlike(r"(?i)\barea\s*\(\s*\d")))
    return (
        F.when(F.coalesce(F.trim(_c(x)), F.lit("")) == "", "no query").when(F.exists(around, lambda r: r.isNull() | (r > MOST_AROUND_M)), "radius too large").when(F.exists(wide, lambda w: w > MOST_BOX_DEGREES), "box too large")
        .when(plain.rlike(r"(?i)\b(foreach|complete|retro|compare|convert|make)\b"), "unsupported construct").when(plain.rlike(r"(?i)\bpoly\s*:"), "polygon filter").when(loose, "unbounded selector")
    )


# Waiting

def retry_delay(retry_after_s, failures, first_ms: int = 30_000, most_ms: int = 300_000) -> Column:
    """Milliseconds to wait: what the answer asks for (a second at least), else doubling by failures up to a bound."""
    doubled = F.least(F.lit(most_ms), (first_ms * F.pow(F.lit(2.0), F.least(_c(failures), F.lit(4)))).cast("long"))
    return F.when(_c(retry_after_s).isNotNull(), F.greatest(F.lit(1000), (_c(retry_after_s) * 1000).cast("long"))).otherwise(doubled)


def served(fresh_at_ms, failed_at_ms, now_ms, live_ms: int, stale_ms: int) -> Column:
    """What a cache gives: fresh, stale (after a failure, while not too old), or none."""
    age = _c(now_ms) - _c(fresh_at_ms)
    return F.when(age <= live_ms, "fresh").when(_c(failed_at_ms).isNotNull() & (age <= stale_ms), "stale").otherwise("none")


# Forecasts

def cycle_hour(now_ms, lag_ms: int = 6 * 3_600_000, every: int = 6) -> Column:
    """The hour of the latest model run that is out."""
    return (F.floor(F.pmod(_c(now_ms) - lag_ms, F.lit(DAY_MS)) / 3_600_000 / every) * every).cast("int")


def nearest_step(hours, cycle) -> Column:
    """The forecast step nearest to some hours: by 3 to 144, by 6 beyond; runs of 6 and 18 end at 144."""
    most = F.when(_c(cycle).isin(6, 18), 144).otherwise(360)
    h = F.greatest(F.lit(0.0), F.coalesce(_c(hours).cast("double"), F.lit(0.0)))
    step = F.when(h <= 144, F.floor(h / 3 + 0.5) * 3).otherwise(F.floor(h / 6 + 0.5) * 6)
    return F.least(step.cast("int"), most)


# Scales

def log_scale(x, low: float, high: float, out_low: float, out_high: float) -> Column:
    """A value between two bounds on a logarithmic scale; the lower end for what is not above 0."""
    v = F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))
    if not (low > 0 and high > 0):
        return F.lit(out_low)
    if high <= low:
        return F.when(_c(x) > 0, (out_low + out_high) / 2).otherwise(out_low)
    part = (F.log10(v) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low)))
    return F.when(_c(x) > 0, out_low + part * (out_high - out_low)).otherwise(out_low)


def lerp_angle(start, end, part) -> Column:
    """An angle between two, along the shorter way round."""
    delta = F.pmod(_c(end) - _c(start) + 540, F.lit(360.0)) - 180
    return _c(start) + delta * _c(part)


def clamp_box(west, south, east, north, lat, lon, most: float) -> tuple[Column, Column, Column, Column]:
    """A box of at most so many degrees around a centre."""
    high = F.least(_c(north) - _c(south), F.lit(most)) / 2
    wide = F.least(F.pmod(_c(east) - _c(west), F.lit(360.0)), F.lit(most)) / 2
    return geo.wrap_lon(_c(lon) - wide), _c(lat) - high, geo.wrap_lon(_c(lon) + wide), _c(lat) + high


def nice_scale(most) -> tuple[Column, Column]:
    """(end, step) of an axis of five steps: the step is 1, 2, 5 or 10 times a power of ten."""
    v = F.when(_c(most) > 0, _c(most).cast("double")).otherwise(1.0)
    raw = v / 5
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw) + 1e-12))
    f = raw / power
    step = F.when(f <= 1 + 1e-9, 1.0).when(f <= 2 + 1e-9, 2.0).when(f <= 5 + 1e-9, 5.0).otherwise(10.0) * power
    return F.ceil(v / step - 1e-9) * step, step


def symmetric_breaks(most, n: int = 4) -> Column:
    """Breaks of residual classes, the same on both sides of 0, from the largest absolute residual."""
    if n % 2:
        raise ValueError("an even number of breaks")
    parts = [(2 * k + 1 - n) / (n + 1) for k in range(n)]
    return F.array(*(_c(most) * p for p in parts))
