"""Sensor records from captured messages, and rows of three sources under one set of columns; what can't be used stays a row with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.classify import ADMITTED, first_reason
from echofold.sources import frames as X
from echofold.sources.logs import csv_generations, salvaged_rows, sensor_messages

#: Rates by the code in a frame of the first version, and columns of the card's files by layout.
FS_BY_CODE = {1: 8000.0, 2: 16000.0, 3: 22050.0, 4: 24000.0, 5: 32000.0, 6: 44100.0, 7: 48000.0, 8: 96000.0, 9: 192000.0}
_BASE = ["utc_us", "uptime_s", "sample", "pps_n", "us_since_pps", "trigger", "flags", "fs_hz"]
_CLIP = ["frame_hex", "clip", "clip_why"]
_CLOCK = ["clock_state", "anchor_age_us", "boot_epoch_us", "boot_id", "clock_discontinuity_flags"]
GENERATIONS = {
    "G1": ([*_BASE, "frame_hex"], [*_BASE, "frame_hex"]),
    "G2": ([*_BASE, *_CLIP], [*_BASE, *_CLIP]),
    "G3": (["node", *_BASE, *_CLIP], [*_BASE, *_CLIP]),
    "G4": (["node_id", *_BASE, *_CLIP], ["node_id", *_BASE, *_CLIP]),
    "G5": (["node_id", *_BASE, "sketch_back", *_CLIP], ["node_id", *_BASE, "sketch_back", *_CLIP]),
    "G6": (["node_id", *_BASE, "sketch_back", *_CLIP, "sync_sigma_ns"], ["node_id", *_BASE, "sketch_back", *_CLIP, "sync_sigma_ns"]),
    "G7": (["node_id", *_BASE, "sketch_back", *_CLIP, "sync_sigma_ns", *_CLOCK], ["node_id", *_BASE, "sketch_back", *_CLIP, "sync_sigma_ns", *_CLOCK]),
}
SCENE = ["utc_us", "uptime_s", "sample", "bands", "slices", "span_ms", "ref_db4", "frames", "fft_us", "mel_hex"]
#: The one set of columns: numbers as longs or doubles, features as bytes.
ROW = {
    "utc_us": "long", "uptime_s": "double", "sample": "long", "pps_n": "long", "us_since_pps": "long", "trigger": "string", "flags": "long", "fs_hz": "double", "sync_sigma_ns": "double",
    "bands": "long", "slices": "long", "span_ms": "double", "ref_db4": "long", "frame": "binary", "mel": "binary",
}
_MAX_SHAPE, _PADDING = 64, 16


def frame_version(data: Column) -> Column:
    """2 for a whole frame that says so and whose time is a time of day, else 1 for one that is as long as its shape (with some padding), else null. The order is fixed."""
    n, flags = F.octet_length(data), X.unsigned(data, 11, 2)
    profile, version = F.shiftright(flags, 1).bitwiseAND(F.lit(15)), F.shiftright(flags, 5).bitwiseAND(F.lit(7))
    # The five bytes of the time hold 37 bits.
    second = (n >= X.V2_HEADER + X.BANDS * X.FRAMES) & (version == X.VERSION) & profile.isin(*X.PROFILE_FS) & (F.shiftright(X.unsigned(data, 0, 5), 37) == 0)
    bands, frames = X.unsigned(data, 8, 1), X.unsigned(data, 9, 1)
    first = (n >= X.V1_HEADER) & bands.between(1, _MAX_SHAPE) & frames.between(1, _MAX_SHAPE) & (n - X.V1_HEADER - bands * frames).between(0, _PADDING)
    return F.when(second, 2).when(first, 1)


def nearest_second_us(ts_ms: Column, us: Column) -> Column:
    """Microseconds since 1970 from a time rounded to milliseconds and the microseconds within its second: the second that brings both nearest."""
    coarse = (F.round(ts_ms * 1000.0)).cast("long")
    at = F.floor(coarse / 1000000).cast("long") * 1000000 + us
    return F.when(at - coarse > 500000, at - 1000000).when(at - coarse < -500000, at + 1000000).otherwise(at)


def sketch_records(lines: DataFrame) -> DataFrame:
    """Records from captured messages (path, day, line): one row a line.

    Returns path, day, node, node_from, version, bands, frames, layout, fs_hz, fs_from (frame or json), q, ref_db, peak, retrigger, node_us, utc_us, clock_tier, sync_sigma_ns and reason. A
    message that contradicts its frame in bands, frames or layout is refused; nobody's word is taken over the other's.
    """
    more = "payload struct<bands: bigint, frames: bigint, layout: string, fs: double, sync_sigma_ns: double>"
    # The message's own facts stay beside it while its frame is read.
    kept = sensor_messages(lines.withColumn("path", F.to_json(F.struct("path", "line"))))
    origin = F.from_json("path", "path string, line string")
    kept = kept.withColumn("_o", origin).withColumn("path", F.col("_o.path"))
    payload = F.from_json("_o.line", more).getField("payload")
    bare = F.from_json("_o.line", more.removeprefix("payload struct<").removesuffix(">").replace(": ", " "))
    kept = kept.withColumn("said", F.coalesce(payload, bare)).withColumn("version", frame_version(F.col("frame")))
    size = F.when(F.col("version") == 2, F.lit(X.V2_HEADER + X.BANDS * X.FRAMES)).otherwise(X.V1_HEADER + X.unsigned(F.col("frame"), 8, 1) * X.unsigned(F.col("frame"), 9, 1))
    whole = F.substring(F.col("frame"), F.lit(1), size.cast("int"))
    kept = kept.withColumn("one", F.when(F.col("version") == 1, X.unpack_v1(whole))).withColumn("two", F.when(F.col("version") == 2, X.unpack_v2(whole)))
    rate = F.lit(None).cast("double")
    for code, fs in FS_BY_CODE.items():
        rate = F.when(F.col("one.fs_code") == code, fs).otherwise(rate)
    second = F.col("version") == 2
    rows = kept.withColumns({
        "bands": F.when(second, F.lit(X.BANDS)).otherwise(F.col("one.bands")).cast("long"),
        "frames": F.when(second, F.lit(X.FRAMES)).otherwise(F.col("one.frames")).cast("long"),
        "layout": F.when(second | F.col("one.fixed_layout"), "fixed").when(F.col("version") == 1, "nyquist"),
        "stated_fs": F.when(second, F.col("two.fs_hz")).otherwise(rate),
        "node_us": F.when(second, F.col("two.us_of_day") % 1000000).otherwise(F.col("one.node_us")),
    })
    damaged = F.coalesce(F.col("one.reason"), F.col("two.reason"))
    fits = (F.col("reason") == ADMITTED)
    reason = first_reason([
        (~fits, "unused"), (F.col("version").isNull(), "unrecognised_frame"), (damaged.isNotNull(), "damaged_frame"),
        (F.col("said.bands") != F.col("bands"), "bands_disagree"), (F.col("said.frames") != F.col("frames"), "frames_disagree"), (F.col("said.layout") != F.col("layout"), "layout_disagrees"),
    ])
    reason = F.when(fits, reason).otherwise(F.col("reason"))
    fs = F.coalesce("stated_fs", F.nullif("said.fs", F.lit(0.0)))
    used = {
        "version": F.col("version"), "bands": F.col("bands"), "frames": F.col("frames"), "layout": F.col("layout"), "fs_hz": fs, "fs_from": F.when(F.col("stated_fs").isNotNull(), "frame").when(fs.isNotNull(), "json"),
        "q": F.when(second, F.col("two.q")).otherwise(F.col("one.q")), "ref_db": F.when(second, F.col("two.ref_db")).otherwise(F.col("one.ref_db")), "peak": F.when(second, F.col("two.peak")).otherwise(F.col("one.peak")),
        "retrigger": F.when(second, F.col("two.retrigger")).otherwise(F.col("one.retrigger")), "node_us": F.col("node_us"), "utc_us": nearest_second_us(F.col("ts_ms"), F.col("node_us")), "clock_tier": F.col("clock_tier"), "sync_sigma_ns": F.col("said.sync_sigma_ns"),
    }
    rows = rows.withColumn("why", reason)
    return rows.select("path", "day", "node", "node_from", *[F.when(F.col("why") == ADMITTED, c).alias(k) for k, c in used.items()], F.col("why").alias("reason"))


def _typed(value, name: str) -> Column:
    return F.expr(f"try_cast({value} AS {ROW[name]})").alias(name)


def _bytes(text: Column) -> Column:
    return F.try_to_binary(F.nullif(text, F.lit("")), F.lit("hex"))


def card_rows(lines: DataFrame, src: str) -> DataFrame:
    """Rows of a card's CSV files (path, line_no, line) of any known layout, ``src`` being dets or scene."""
    layouts = GENERATIONS if src == "dets" else {"scene": (SCENE, SCENE)}
    rows = csv_generations(lines, layouts)
    cell = lambda name: f"nullif(try_element_at(cells, '{name}'), '')"
    numbers = [_typed(cell(n), n) for n in ROW if n not in ("frame", "mel")]
    features = [_bytes(F.expr(cell(f"{n}_hex"))).alias(n) for n in ("frame", "mel")]
    broken = [(F.expr(f"{cell(f'{n}_hex')} IS NOT NULL") & _bytes(F.expr(cell(f"{n}_hex"))).isNull(), f"bad_{n}_hex") for n in ("frame", "mel")]
    reason = F.when(F.col("reason") != ADMITTED, F.col("reason")).otherwise(first_reason(broken))
    return rows.select("path", F.lit(src).alias("src"), "generation", *numbers, *features, reason.alias("reason"))


def ring_rows(pages: DataFrame) -> DataFrame:
    """Rows of pages of the live ring (path, line). An object whose frame isn't as long as it says is refused."""
    schema = ", ".join(f"{n} {k}" for n, k in ROW.items() if k != "binary") + ", frame string, frame_hex string, frame_len long, i long"
    rows = salvaged_rows(pages, schema)
    text = F.coalesce("row.frame", "row.frame_hex", F.lit(""))
    short = F.col("row.frame_len").isNotNull() & (F.length(text) != 2 * F.col("row.frame_len"))
    reason = first_reason([(short, "frame_length"), ((text != "") & _bytes(text).isNull(), "bad_frame_hex")])
    values = [F.col(f"row.{n}").alias(n) for n in ROW if n not in ("frame", "mel")]
    return rows.select("path", F.lit("ring").alias("src"), F.col("page").alias("generation"), *values, _bytes(text).alias("frame"), F.lit(None).cast("binary").alias("mel"), reason.alias("reason"))


def bridge_rows(dets: DataFrame | None = None, scene: DataFrame | None = None, ring: DataFrame | None = None) -> DataFrame:
    """Rows of the sources given, under one set of columns: path, src, generation, those of ROW, and reason."""
    parts = [p for p in (dets is not None and card_rows(dets, "dets"), scene is not None and card_rows(scene, "scene"), ring is not None and ring_rows(ring)) if p is not False]
    if not parts:
        raise ValueError("no source is given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
