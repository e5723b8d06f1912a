"""Append-only text logs: JSON lines that may be torn, logs where the last line wins, and CSV of several generations.

Lines are read by Spark's text reader, one row each, so a large file is split over tasks. A line that can't be read
stays a row with a reason; nothing is lost without being counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.operators.classify import ADMITTED, first_reason


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, day (from a folder named day=YYYY-MM-DD, else null) and line, blank lines left out."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("path", F.col("_metadata.file_path"))
    day = F.nullif(F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1), F.lit(""))
    return lines.where(F.trim("value") != "").select("path", day.alias("day"), F.col("value").alias("line"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines per path in a pass that parses nothing, against which a parse can be held."""
    return text_lines(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


def salvaged_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of pages of JSON objects (path, line): a bare array, an envelope with ``detections``, or either of them torn off after some whole objects.

    Returns path, at (place on the page), row (a struct of ``schema``), and page (array, envelope, torn). Objects hold no nested ones.
    """
    whole = F.schema_of_variant(F.try_parse_json("line"))
    page = F.when(F.coalesce(whole.startswith("ARRAY"), F.lit(False)), "array").when(F.coalesce(whole.startswith("OBJECT"), F.lit(False)), "envelope").otherwise("torn")
    body = F.regexp_replace("line", r'^\s*\{[^\[]*"detections"\s*:', "")
    found = lines.select("path", page.alias("page"), F.posexplode(F.regexp_extract_all(body, F.lit(r"(\{[^{}]*\})"), F.lit(1))).alias("at", "object"))
    return found.select("path", "page", "at", F.from_json("object", schema).alias("row")).where("row is not null")


def tail_rows(lines: DataFrame, order: str, is_partial: Column) -> DataFrame:
    """Cells of headerless CSV tails (path, ``order``, line): the first line of a tail that may begin anywhere is dropped and counted, and the most
    frequent width of a file is taken for its layout; other widths are refused. Returns path, order, cells, reason."""
    rows = lines.withColumn("cells", F.transform(F.split("line", ","), lambda c: F.trim(c))).withColumn("width", F.size("cells"))
    first = rows.groupBy("path").agg(F.min(order).alias("_first"))
    rows = rows.join(first, "path").withColumn("_cut", is_partial & (F.col(order) == F.col("_first")))
    counts = rows.where("not _cut").groupBy("path", "width").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("path").agg(F.max(F.struct("n", (-F.col("width")).alias("less"))).alias("m")).select("path", (-F.col("m.less")).alias("modal"))
    reason = F.when(F.col("_cut"), "partial_first_line").when(F.col("width") != F.col("modal"), F.format_string("row_width_%d_expected_%d", F.col("width"), F.col("modal"))).otherwise(ADMITTED)
    return rows.join(modal, "path", "left").select("path", order, F.when(reason == ADMITTED, F.col("cells")).alias("cells"), reason.alias("reason"))


def wav_header(data: Column) -> Column:
    """channels, rate, bits, duration_s and reason from the first 44 bytes of a WAV file's content."""
    def text(at: int, n: int) -> Column:
        return F.decode(F.substring(data, at + 1, F.lit(n)), "ISO-8859-1")

    def number(at: int, n: int) -> Column:
        digits = F.hex(F.substring(data, at + 1, F.lit(n)))
        return F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")

    frame = number(32, 2)
    duration = number(40, 4) / F.nullif(frame * number(24, 4), F.lit(0).cast("long"))
    reason = (
        F.when(F.octet_length(data) < 44, F.format_string("header_short_%d", F.octet_length(data)))
        .when(text(0, 4) != "RIFF", "not_riff").when(text(8, 4) != "WAVE", "not_wave").when(text(12, 4) != "fmt ", "no_fmt").when(number(20, 2) != 1, "not_pcm").when(text(36, 4) != "data", "no_data")
        .when(duration.isNull() | (duration <= 0) | (duration > 60), "duration_outside")
    )
    return F.struct(number(22, 2).alias("channels"), number(24, 4).alias("rate"), number(34, 2).alias("bits"), duration.alias("duration_s"), reason.alias("reason"))


def latest_placements(lines: DataFrame) -> DataFrame:
    """The last placement of each name in a field log (line: JSON with name, utc, e_m, n_m), with how many it replaced; a line that can't be read raises."""
    rows = lines.select(F.from_json("line", "name string, utc string, e_m double, n_m double", {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return last_line_wins(rows, "name", ["utc"])


def versions_held(tags: DataFrame) -> DataFrame:
    """Models, versions and digests in a tag store, counted and never merged."""
    return tags.groupBy("name", "version", "sha256").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


def frozen_range(rows: DataFrame, position: str, after: Column, freeze: Column) -> DataFrame:
    """Rows after a position that was read before, up to one frozen beforehand."""
    return rows.where((F.col(position) > after) & (F.col(position) <= freeze))


def is_object(line: Column) -> Column:
    """Whether a line is a whole JSON object."""
    return holds_object(F.try_parse_json(line))


def holds_object(v: Column) -> Column:
    """Whether a variant is an object."""
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def json_rows(lines: DataFrame, schema: str) -> DataFrame:
    """``lines`` with ``row`` (a struct of ``schema``; null for a line that is no JSON object) and ``reason``."""
    whole = is_object(F.col("line"))
    return lines.withColumn("row", F.when(whole, F.from_json("line", schema))).withColumn("reason", first_reason([(~whole, "bad_json")]))


def last_line_wins(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, and how many it replaced; rows without a key are left out."""
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(last, (F.count(F.lit(1)) - 1).alias("superseded")).select(key, "last.*", "superseded")


def sensor_messages(lines: DataFrame) -> DataFrame:
    """Captured messages of the form {topic, node_id, payload}: node, node_from, frame (bytes), ts_ms, clock_tier and reason.

    The node is the message's, else the topic's second part of three or more, else the payload's. A message without
    a frame is ``phone_skipped`` if it says so and ``no_sketch_b64`` otherwise; one whose frame isn't base64 is ``bad_base64``.
    """
    body = "node_id string, sketch_b64 string, ts_utc_ms bigint, clock_tier string"
    rows = json_rows(lines, f"topic string, node_id string, payload struct<{body.replace(' string', ': string').replace(' bigint', ': bigint')}>")
    raw = F.try_parse_json("line")
    rows = rows.withColumn("body", F.when(F.is_variant_null(F.coalesce(F.try_variant_get(raw, "$.payload", "variant"), F.parse_json(F.lit("null")))), F.from_json("line", body)).otherwise(F.col("row.payload")))
    skipped = F.try_variant_get(raw, "$.payload.sketch_skipped", "variant").isNotNull() | F.try_variant_get(raw, "$.sketch_skipped", "variant").isNotNull()
    parts = F.split("row.topic", "/")
    stated = F.coalesce(F.nullif(F.col("row.node_id"), F.lit("")), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))))
    empty = F.coalesce(F.col("body.sketch_b64"), F.lit("")) == ""
    frame = F.try_to_binary("body.sketch_b64", F.lit("base64"))
    reason = first_reason([(F.col("reason") != ADMITTED, "bad_json"), (empty & skipped, "phone_skipped"), (empty, "no_sketch_b64"), (frame.isNull(), "bad_base64")])
    return rows.select(
        "path",
        "day",
        F.coalesce(stated, F.col("body.node_id"), F.lit("?")).alias("node"),
        F.when(stated.isNull(), "payload").otherwise("topic").alias("node_from"),
        frame.alias("frame"),
        F.col("body.ts_utc_ms").alias("ts_ms"),
        F.col("body.clock_tier").alias("clock_tier"),
        reason.alias("reason"),
    )


def csv_generations(lines: DataFrame, generations: Mapping[str, tuple[Sequence[str], Sequence[str]]], order: str = "line_no") -> DataFrame:
    """Rows of CSV files (path, line_no, line) whose first line tells which of several layouts wrote them.

    ``generations``: by name, the columns of the header and those of the rows, which may differ. Returns path, line_no, generation,
    cells (a map from column to trimmed value) and reason: ``unknown_header`` or ``row_width_a_expected_b``. Cells hold no quoted commas.
    The header is matched whole. The headers are one row per file, joined to the lines by path.
    """
    cells = F.transform(F.split("line", ","), lambda c: F.trim(c))
    first = lines.groupBy("path").agg(F.min_by("line", order).alias("head"), F.min(order).alias("head_no"))
    head = F.transform(F.split("head", ","), lambda c: F.trim(c))
    name, width, columns = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    for label, (declared, written) in reversed(list(generations.items())):
        here = head == F.array(*[F.lit(c) for c in declared])
        name = F.when(here, label).otherwise(name)
        width = F.when(here, len(written)).otherwise(width)
        columns = F.when(here, F.array(*[F.lit(c) for c in written])).otherwise(columns)
    files = first.select("path", "head_no", name.alias("generation"), width.alias("width"), columns.alias("columns"))
    rows = lines.join(files, "path").where(F.col(order) != F.col("head_no")).withColumn("values", cells)
    wide = F.size("values")
    reason = F.when(F.col("generation").isNull(), "unknown_header").when(wide != F.col("width"), F.format_string("row_width_%d_expected_%d", wide, F.col("width"))).otherwise(ADMITTED)
    return rows.withColumn("reason", reason).select("path", order, "generation", F.when(F.col("reason") == ADMITTED, F.map_from_arrays("columns", "values")).alias("cells"), "reason")


def task_states(log: DataFrame, order: str = "seq") -> DataFrame:
    """State of each task in a log of (task_id, type, retryable): done once published, whatever follows.

    ``failed`` is a failure that may not be retried. Publishing clears what came before it; a later deferral is stated beside it.
    """
    after = Window.partitionBy("task_id")
    published = F.max(F.when(F.col("type") == "published", F.col(order))).over(after)
    rows = log.where(F.col("task_id").isNotNull()).withColumn("_done", published)
    later = F.col("_done").isNull() | (F.col(order) > F.col("_done"))
    final = (F.col("type") == "failed") & ~F.coalesce(F.col("retryable"), F.lit(False))
    return rows.groupBy("task_id").agg(
        F.bool_or(F.col("type") == "claim").alias("claimed"),
        F.bool_or(F.col("type") == "published").alias("published"),
        F.bool_or((F.col("type") == "deferred") & later).alias("deferred"),
        F.bool_or(final & later).alias("failed"),
    )


def aircraft_states(lines: DataFrame) -> DataFrame:
    """Aircraft with a position and an altitude, from one snapshot per line; either dialect's names are accepted.

    The time is the snapshot's less the seconds since the aircraft was last heard. An altitude that isn't a number counts as none.
    """
    numbers = ["lat", "lon", "alt_baro", "altitude", "gs", "speed", "track", "true_heading", "baro_rate", "geom_rate", "vert_rate", "seen"]
    words = ["hex", "icao", "icao24", "flight", "callsign"]
    craft = ", ".join(f"{n}: string" for n in numbers + words)
    rows = json_rows(lines, f"now double, aircraft array<struct<{craft}>>").select("path", F.col("row.now").alias("now"), F.explode("row.aircraft").alias("a"))
    num = {n: F.expr(f"try_cast(a.`{n}` AS double)") for n in numbers}
    word = {n: F.nullif(F.col(f"a.{n}"), F.lit("")) for n in words}
    out = rows.select(
        "path",
        F.lower(F.trim(F.coalesce(word["hex"], word["icao"], word["icao24"]))).alias("icao"),
        F.nullif(F.trim(F.coalesce(word["flight"], word["callsign"])), F.lit("")).alias("callsign"),
        num["lat"].alias("lat_deg"),
        num["lon"].alias("lon_deg"),
        F.coalesce(num["alt_baro"], num["altitude"]).alias("alt_ft"),
        F.coalesce(num["gs"], num["speed"], F.lit(0.0)).alias("ground_speed_kts"),
        F.coalesce(num["track"], num["true_heading"], F.lit(0.0)).alias("track_deg"),
        F.coalesce(num["baro_rate"], num["geom_rate"], num["vert_rate"], F.lit(0.0)).alias("vertical_rate_fpm"),
        (F.col("now") - F.coalesce(num["seen"], F.lit(0.0))).alias("ts_s"),
    )
    return out.where("icao is not null and lat_deg is not null and lon_deg is not null and alt_ft is not null")
