"""Column functions of the catalog.  All are built from native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULTS, ORIENTATIONS


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def suffix(name: Column) -> Column:
    """The last dot and what follows; a name that only begins with a dot has none."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def extension(name: Column) -> Column:
    return F.lower(suffix(name))


def normal_extension(ext: Column) -> Column:
    return F.when(ext.startswith("."), F.lower(ext)).otherwise(F.concat(F.lit("."), F.lower(ext)))


def _stamp(text: Column, shape: str, form: str) -> Column:
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)))


def exif_seconds(text: Column, epoch: Column) -> Column:
    """Seconds of a capture date: a number as it is, a text of one of three forms read as UTC; no time zones."""
    clock = r"\d{1,2}:\d{1,2}:\d{1,2}$"
    got = F.coalesce(_stamp(text, r"^\d{4}:\d{1,2}:\d{1,2} " + clock, "y:M:d H:m:s"), _stamp(text, r"^\d{4}-\d{1,2}-\d{1,2}T" + clock, "y-M-d'T'H:m:s"), _stamp(text, r"^\d{4}-\d{1,2}-\d{1,2} " + clock, "y-M-d H:m:s"))
    return F.coalesce(epoch, F.unix_micros(got) / 1e6)


#: Fixed value: a date and time as it stands in file names.
NAME_DATE = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[-_](\d{2})[-_]?(\d{2})[-_]?(\d{2})"
DIGITS = "yyyyMMddHHmmss"


def name_seconds(name: Column) -> Column:
    """Seconds of the first date and time in a file name; null if the calendar or clock has none such."""
    digits = F.regexp_replace(F.regexp_extract(name, NAME_DATE, 0), "[-_]", "")
    return F.unix_micros(F.try_to_timestamp(digits, F.lit(DIGITS))) / 1e6


def date_name(text: Column) -> Column:
    """YYYYMMDD_HHMMSS of a text that begins with such a date before its first plus sign; the calendar isn't checked."""
    shape = r"^(\d{4}):(\d{2}):(\d{2})\s+(\d{2}):(\d{2}):(\d{2})"
    found = F.regexp_extract(F.split_part(text, F.lit("+"), F.lit(1)), shape, 0)
    return F.nullif(F.regexp_replace(found, shape, "$1$2$3_$4$5$6"), F.lit(""))


_ZONED = r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:([+-])(\d{2}):?(\d{2}))?$"


def _plain(text: Column) -> Column:
    """A date text as its fourteen digits and, where it has a time zone, +HHMM or -HHMM; empty for other texts."""
    return F.regexp_replace(F.regexp_extract(F.trim(text), _ZONED, 0), _ZONED, "$1$2$3$4$5$6$7$8$9")


def local_seconds(text: Column) -> Column:
    """Wall-clock seconds of a date text with or without a time zone."""
    return F.unix_micros(F.try_to_timestamp(F.substring(_plain(text), 1, 14), F.lit(DIGITS))) / 1e6


def utc_seconds(text: Column) -> Column:
    """The instant, where the text has a time zone."""
    plain = _plain(text)
    shift = F.substring(plain, 16, 2).try_cast("int") * 3600 + F.substring(plain, 18, 2).try_cast("int") * 60
    sign = F.substring(plain, 15, 1)
    return F.when(sign == "+", local_seconds(text) - shift).when(sign == "-", local_seconds(text) + shift)


def name_to_exif(name: Column) -> Column:
    s = stem(name)
    part = lambda a, n: F.substring(s, a, n)
    text = F.concat(part(1, 4), F.lit(":"), part(5, 2), F.lit(":"), part(7, 2), F.lit(" "), part(10, 2), F.lit(":"), part(12, 2), F.lit(":"), part(14, 2))
    return F.when(s.rlike(r"^\d{8}_\d{6}"), text)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = DEFAULTS.earth_radius_m) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    x = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(x), F.sqrt(1 - x))


def geo_key(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.2f,%.2f", lat, lon))


def lat_ref(lat: Column) -> Column:
    return F.when(lat >= 0, "N").when(lat < 0, "S")


def lon_ref(lon: Column) -> Column:
    return F.when(lon >= 0, "E").when(lon < 0, "W")


def parse_gps(text: Column) -> Column:
    """lat and lon of a text "lat,lon" of two numbers within their ranges; null for any other."""
    number = r"\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*"
    part = lambda i: F.trim(F.split_part(text, F.lit(","), F.lit(i))).try_cast("double")
    lat, lon = part(1), part(2)
    return F.when(text.rlike(f"^{number},{number}$") & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def orientation_label(value: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in ORIENTATIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, value), F.concat(F.lit("Unknown ("), value.cast("string"), F.lit(")")))


def bits_to_long(bits: Column) -> Column:
    """A text of 64 binary digits as a signed 64-bit number."""
    half = lambda a: F.conv(F.substring(bits, a, 32), 2, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity64(distance: Column) -> Column:
    return F.round(1 - distance / 64, 4)


def quality(width: Column, height: Column, size: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(12,0)")
    return (z(width) * z(height) * z(size)).cast("decimal(38,0)")


def format_size(n: Column) -> Column:
    show = lambda unit, name: F.concat(F.format_string("%.1f", n / F.lit(unit)), F.lit(f" {name}"))
    return F.when(n >= 1e9, show(1e9, "GB")).when(n >= 1e6, show(1e6, "MB")).when(n >= 1e3, show(1e3, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def location_label(city: Column, town: Column, county: Column, state: Column, country: Column, code: Column, language: str = DEFAULTS.accept_language) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    name = F.coalesce(some(city), some(town), some(county), some(state), F.lit("Unknown"))
    home = language.split("-")[-1].lower()
    return F.when(F.coalesce(code, F.lit("")) == home, name).otherwise(F.concat(F.coalesce(country, F.lit("Unknown")), F.lit("_"), name))


def snap_rotation(value: Column) -> Column:
    return F.when(value <= 45, 0).when(value <= 135, 90).when(value <= 225, 180).otherwise(270)


def model_reply(text: Column) -> Column:
    """rotation and confidence of a model's JSON reply, fenced or not; null for what isn't JSON."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""))
    got = F.from_json(body, "rotation int, confidence double")
    return F.when(body.rlike(r"^\{.*\}$"), F.struct(F.coalesce(got["rotation"], F.lit(0)).alias("rotation"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence")))


def decide(logits: Column) -> Column:
    """rotation of the largest logit (the first of equals) and its softmax probability."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.struct(((F.array_position(logits, top) - 1) * 90).cast("int").alias("rotation"), (1 / total).alias("confidence"))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "High").when(c >= 0.7, "Medium").otherwise("Low")


def path_within(path: Column, base: Column) -> Column:
    return (path == base) | path.startswith(F.concat(base, F.lit("/")))


def falsy_chain(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def any_pattern(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def ancestors(path: Column) -> Column:
    """The path and all folders above it, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
