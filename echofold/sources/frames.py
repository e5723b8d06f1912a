"""Binary frames of sensors as column expressions: a sketch of bands by frames in signed bytes behind a header. Fixed values and layouts of the two versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000
V1_HEADER, V2_HEADER, VERSION, BANDS, FRAMES = 12, 13, 2, 20, 8
#: Rates that the profiles of version 2 name; 0 states none.
PROFILE_FS = {0: None, 1: 48000.0, 2: 16000.0, 3: 32000.0, 4: 24000.0}


def little_endian(value: Column, n: int) -> Column:
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * n))
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))]))


def unsigned(data: Column, at: int, n: int) -> Column:
    digits = F.hex(F.substring(data, at + 1, F.lit(n)))
    return F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")


def _signed(x: Column, bits: int) -> Column:
    return F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x)


def signed_bytes(data: Column, at: int) -> Column:
    """The bytes from ``at`` on as numbers from -128 to 127."""
    pairs = F.regexp_extract_all(F.hex(F.substring(data, at + 1, F.octet_length(data))), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: ((F.conv(x, 16, 10).cast("int") + 128) % 256) - 128)


def pack_v2(us_of_day: Column, node_id: Column, seq: Column, ref_db: Column, peak: Column, q: Column, retrigger: Column, profile: Column) -> Column:
    """A frame of version 2 from a body in bytes; null where a field doesn't fit, as nothing is wrapped or clamped."""
    ref4 = F.bround(ref_db * 4).cast("long")
    fits = us_of_day.between(0, US_PER_DAY - 1) & node_id.between(0, 65535) & seq.between(0, 255) & peak.between(0, 65535) & ref4.between(-32768, 32767) & profile.between(1, 4) & (F.octet_length(q) == BANDS * FRAMES)
    flags = retrigger.cast("int") + profile * 2 + VERSION * 32 + seq * 256
    return F.when(fits, F.concat(little_endian(us_of_day, 5), little_endian(ref4, 2), little_endian(peak, 2), little_endian(node_id, 2), little_endian(flags, 2), q))


def unpack_v2(data: Column) -> Column:
    """us_of_day, node_id, seq, ref_db, peak, retrigger, profile, fs_hz, q and reason (the first thing wrong, with all else null)."""
    n, flags, us = F.octet_length(data), unsigned(data, 11, 2), unsigned(data, 0, 5)
    profile, version = F.shiftright(flags, 1).bitwiseAND(F.lit(15)), F.shiftright(flags, 5).bitwiseAND(F.lit(7))
    reason = (
        F.when(data.isNull() | (n < V2_HEADER), F.format_string("header_short_%d", F.coalesce(n, F.lit(0))))
        .when(profile > max(PROFILE_FS), F.format_string("unknown_profile_%d", profile))
        .when(n != V2_HEADER + BANDS * FRAMES, F.format_string("length_%d", n))
        .when(version != VERSION, F.format_string("version_%d", version))
        .when(us >= US_PER_DAY, "time_of_day")
    )
    fs = F.lit(None).cast("double")
    for k, rate in PROFILE_FS.items():
        fs = F.when(profile == k, rate).otherwise(fs)
    fields = {
        "us_of_day": us, "node_id": unsigned(data, 9, 2), "seq": F.shiftright(flags, 8), "ref_db": _signed(unsigned(data, 5, 2), 16) / 4, "peak": unsigned(data, 7, 2), "retrigger": flags % 2 == 1,
        "profile": profile, "fs_hz": fs, "q": signed_bytes(data, V2_HEADER),
    }
    return F.struct(*[F.when(reason.isNull(), c).alias(k) for k, c in fields.items()], reason.alias("reason"))


def unpack_v1(data: Column) -> Column:
    """node_us, ref_db, peak, bands, frames, retrigger, fs_code, fixed_layout, q and reason of a frame whose header states its own shape."""
    n, bands, frames, flags = F.octet_length(data), unsigned(data, 8, 1), unsigned(data, 9, 1), unsigned(data, 10, 2)
    reason = (
        F.when(data.isNull() | (n < V1_HEADER), F.format_string("header_short_%d", F.coalesce(n, F.lit(0))))
        .when((bands == 0) | (frames == 0), F.format_string("shape_%dx%d", bands, frames))
        .when(n != V1_HEADER + bands * frames, F.format_string("length_%d", n))
    )
    fields = {
        "node_us": unsigned(data, 0, 4), "ref_db": _signed(unsigned(data, 4, 2), 16) / 4, "peak": unsigned(data, 6, 2), "bands": bands, "frames": frames, "retrigger": flags % 2 == 1,
        "fs_code": F.shiftright(flags, 8).bitwiseAND(F.lit(15)), "fixed_layout": F.shiftright(flags, 12) % 2 == 1, "q": signed_bytes(data, V1_HEADER),
    }
    return F.struct(*[F.when(reason.isNull(), c).alias(k) for k, c in fields.items()], reason.alias("reason"))


def decibels(q: Column, ref_db: Column) -> Column:
    """A sketch in dB: a step is half a decibel over the reference."""
    return F.transform(q, lambda x: x / 2 + ref_db)
