"""Scalar formulas as column expressions: sound, geometry, geodesy, keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\u001f"
#: Speed of sound in m/s at 0 degrees C and its slope; WGS84 axis and flattening.
C0, C_PER_DEGREE = 331.3, 0.606
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
_E2 = WGS84_F * (2 - WGS84_F)


def sound_speed(temp_c: Column) -> Column:
    return C0 + C_PER_DEGREE * temp_c


def temperature(speed: Column) -> Column:
    return (speed - C0) / C_PER_DEGREE


def mach_angle_deg(speed: Column, c: Column) -> Column:
    """Null below the speed of sound."""
    return F.when(speed > c, F.degrees(F.asin(c / speed)))


def crack_blast_interval(range_m: Column, theta_deg: Column, c: Column, mach: Column) -> Column:
    """Seconds from the shock wave to the muzzle blast at a range and an angle off the path."""
    cone = F.acos(1 / mach)
    theta = F.radians(theta_deg)
    return F.when((mach > 1) & (theta < cone), range_m / c * (1 - F.cos(theta - cone)))


def range_difference(tau_s: Column, c: Column) -> Column:
    return tau_s * c


def asymptote_deg(delta_m: Column, baseline_m: Column) -> Column:
    """Angle of the hyperbola's asymptote off the baseline; null where the difference exceeds the baseline."""
    return F.when(F.abs(delta_m) <= baseline_m, F.degrees(F.acos(delta_m / baseline_m)))


def ecef(lat_deg: Column, lon_deg: Column, h_m: Column) -> list[Column]:
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    n = WGS84_A / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
    return [(n + h_m) * F.cos(lat) * F.cos(lon), (n + h_m) * F.cos(lat) * F.sin(lon), (n * (1 - _E2) + h_m) * F.sin(lat)]


def enu(lat_deg: Column, lon_deg: Column, h_m: Column, origin: tuple[float, float, float]) -> list[Column]:
    """East, north and up of a point seen from an origin (degrees, degrees, metres)."""
    la, lo = math.radians(origin[0]), math.radians(origin[1])
    n = WGS84_A / math.sqrt(1 - _E2 * math.sin(la) ** 2)
    o = ((n + origin[2]) * math.cos(la) * math.cos(lo), (n + origin[2]) * math.cos(la) * math.sin(lo), (n * (1 - _E2) + origin[2]) * math.sin(la))
    x, y, z = (p - q for p, q in zip(ecef(lat_deg, lon_deg, h_m), o))
    return [
        -math.sin(lo) * x + math.cos(lo) * y,
        -math.sin(la) * math.cos(lo) * x - math.sin(la) * math.sin(lo) * y + math.cos(la) * z,
        math.cos(la) * math.cos(lo) * x + math.cos(la) * math.sin(lo) * y + math.sin(la) * z,
    ]


def stamp_sigma(capture_s: Column, stated_ns: Column) -> Column:
    """Root sum of squares; 0 and null both mean not stated and give null."""
    stated = F.when(stated_ns > 0, stated_ns / 1e9)
    return F.sqrt(capture_s * capture_s + stated * stated)


def backoff_seconds(attempts: Column, cap: float) -> Column:
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(20))), F.lit(cap))


def content_key(*parts: Column, body: Column | None = None) -> Column:
    """First 32 hex digits of SHA-256 over the parts, each ended by a unit separator; null counts as empty."""
    text = F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit(UNIT)) for p in parts])
    data = F.encode(text, "UTF-8")
    return F.left(F.sha2(data if body is None else F.concat(data, body), 256), F.lit(32))


def day_partition(t_us: Column) -> Column:
    """UTC day, or ``unanchored`` where the time is null or 0."""
    return F.when(t_us > 0, F.date_format(F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=(t_us / 1000000).cast("decimal(18,6)")), "yyyy-MM-dd")).otherwise("unanchored")


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many digits as SQL engines do it on doubles: half away from zero after scaling, and what is negative but rounds to nothing is -0.0."""
    scale = F.lit(10.0**digits)
    r = F.round(x * scale) / scale
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def range_from_interval(dt_s: Column, theta_deg: Column, c: Column, mach: Column) -> Column:
    """The inverse of ``crack_blast_interval``; null at the cone's limit, where any range fits."""
    part = 1 - F.cos(F.radians(theta_deg) - F.acos(1 / mach))
    return F.when(part > 1e-9, c * dt_s / part)


def range_lower_bound(dt_s: Column, c: Column, mach: Column) -> Column:
    return c * dt_s / (1 - 1 / mach)


def theta_from_interval(dt_s: Column, range_m: Column, c: Column, mach: Column) -> Column:
    """Degrees off the path; null where no angle of at least zero gives this interval."""
    s = 1 - c * dt_s / range_m
    theta = F.asin(s) - F.asin(1 / mach)
    return F.when(s.between(-1.0, 1.0) & (theta >= -1e-9), F.degrees(theta))


def subtended_angle_deg(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """The angle between two receivers as seen from a source."""
    a, b, p, q = x1 - x, y1 - y, x2 - x, y2 - y
    return F.degrees(F.abs(F.atan2(a * q - b * p, a * p + b * q)))


def angle_difference_deg(a: Column, b: Column) -> Column:
    return F.pmod(a - b + 180, F.lit(360)) - 180


def closest_approach(p: list[Column], v: list[Column]) -> tuple[Column, Column]:
    """Seconds until a straight track passes the origin nearest (negative: it has), and the range there; a source at rest is nearest now."""
    vv = sum(x * x for x in v)
    t = F.when(vv > 0, -sum(a * b for a, b in zip(p, v)) / vv).otherwise(0.0)
    return t, F.sqrt(sum((a + b * t) * (a + b * t) for a, b in zip(p, v)))


def bearing_elevation(e: Column, n: Column, u: Column) -> tuple[Column, Column, Column]:
    """Range, azimuth from north and elevation in degrees."""
    r = F.sqrt(e * e + n * n + u * u)
    return r, F.pmod(F.degrees(F.atan2(e, n)), F.lit(360)), F.degrees(F.atan2(u, F.sqrt(e * e + n * n)))


def doppler_hz(f: Column, p: list[Column], v: list[Column], c: Column) -> Column:
    """What is heard at the origin of a tone from a moving source."""
    r = F.sqrt(sum(x * x for x in p))
    return f / (1 + sum(a * b for a, b in zip(p, v)) / r / c)


def attenuation_db_m(f: Column, temp_c: Column, humidity: Column, pressure_kpa: Column) -> Column:
    """Absorption of sound by air in dB a metre, by the international standard's relaxation formulas. Fixed values as there."""
    k, p = temp_c + 273.15, pressure_kpa / 101.325
    h = humidity * 101.325 * F.pow(F.lit(10.0), -6.8346 * F.pow(273.16 / k, F.lit(1.261)) + 4.6151) / pressure_kpa
    oxygen = p * (24.0 + 4.04e4 * h * (0.02 + h) / (0.391 + h))
    nitrogen = p * F.sqrt(293.15 / k) * (9.0 + 280.0 * h * F.exp(-4.17 * (F.pow(293.15 / k, F.lit(1 / 3)) - 1)))
    losses = 0.01275 * F.exp(-2239.1 / k) / (oxygen + f * f / oxygen) + 0.1068 * F.exp(-3352.0 / k) / (nitrogen + f * f / nitrogen)
    return 8.685889638 * f * f * (1.84e-11 / p * F.sqrt(k / 293.15) + F.pow(k / 293.15, F.lit(-2.5)) * losses)


def band_edges_hz(fs: Column, bands: int, low: float, high: float, fixed: bool) -> Column:
    """bands + 2 edges, equal steps apart on the mel scale, up to ``high`` or what the rate allows."""
    def mel(hz):
        return 2595.0 * F.log10(1 + hz / 700.0)

    top = F.lit(high) if fixed else F.least(F.lit(high), fs / 2.0 * 0.98)
    step = (mel(top) - mel(F.lit(low))) / (bands + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(bands + 1)), lambda k: 700.0 * (F.pow(F.lit(10.0), (mel(F.lit(low)) + k * step) / 2595.0) - 1))


def valid_bands(edges: Column, fs: Column, strict: bool = False) -> Column:
    """Bands that begin (or, strictly, end) below half the rate."""
    asked = F.slice(edges, 3 if strict else 1, F.size(edges) - 2)
    return F.size(F.filter(asked, lambda e: (e <= fs / 2) if strict else (e < fs / 2)))


def unwrapped_utc(us_of_day: Column, ref_s: Column) -> Column:
    """The time with this microsecond of the day that is nearest to a reference, in seconds."""
    t = F.floor(ref_s / 86400.0) * 86400.0 + us_of_day / 1e6
    return t - F.when(t - ref_s > 43200.0, 86400.0).when(ref_s - t > 43200.0, -86400.0).otherwise(0.0)


def dbfs(x: Column) -> Column:
    """Level of an array of samples against full scale; null of silence or nothing."""
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(x))
    return F.when(rms > 0, 20 * F.log10(rms))


def crest_factor(x: Column) -> Column:
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(x))
    return F.when(rms > 0, F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))) / rms)


def kurtosis(x: Column) -> Column:
    """Excess kurtosis of an array; null where it doesn't vary."""
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(x)

    def moment(k: int) -> Column:
        return F.aggregate(F.transform(x, lambda v: F.pow(v.cast("double") - mean, F.lit(float(k)))), F.lit(0.0), lambda s, v: s + v) / F.size(x)

    return F.when(moment(2) > 0, moment(4) / (moment(2) * moment(2)) - 3)


def logistic_score(x: Column, w: Column, bias: float) -> Column:
    """Probability of a linear model, its logit held to 60; null where a feature is missing."""
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), dot(x, w) + bias))
    return F.when(F.size(x) == F.size(w), 1 / (1 + F.exp(-z)))


def tdoa_variance(tau_s: Column, sigma_tau_s: Column, c: Column, sigma_c: Column) -> Column:
    """Variance of a range difference from that of its delay and of the speed of sound."""
    return F.pow(c * sigma_tau_s, F.lit(2.0)) + F.pow(tau_s * sigma_c, F.lit(2.0))


def clip_name(name: Column) -> Column:
    """node, boot, sample, prio and reason of a clip's path ``/clips/<prio->?<node>-<boot>-<sample>.wav``."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    base = F.regexp_extract(raw, "^/clips/(.*)$", 1)
    pattern = "^(?:([0-9]{2})-)?([A-Za-z][A-Za-z0-9_]*)-([0-9a-fA-F]+)-([0-9]+)[.]wav$"
    reason = (
        F.when(raw == "", "empty").when(raw.contains(".."), "dots").when(~raw.startswith("/clips/"), "outside").when(base.contains("/"), "nested").when(F.length(base) > 64, "long").when(~base.rlike(pattern), "pattern")
    )

    def part(k: int) -> Column:
        return F.when(reason.isNull(), F.nullif(F.regexp_extract(base, pattern, k), F.lit("")))

    return F.struct(part(2).alias("node"), part(3).alias("boot"), part(4).cast("long").alias("sample"), part(1).cast("int").alias("prio"), reason.alias("reason"))


def chunk_span(index: Column, total: Column, size: int) -> Column:
    """First and last byte (exclusive) of a chunk; null beyond the last one."""
    return F.when((index >= 0) & (index * size < total), F.struct((index * size).alias("first"), F.least((index + 1) * size, total).alias("last")))


def days_touched(t0_us: Column, t1_us: Column) -> Column:
    """Numbers of the UTC days that an interval touches."""
    return F.sequence(F.floor(t0_us / 86_400_000_000), F.floor(t1_us / 86_400_000_000))
