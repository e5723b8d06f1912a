"""What an annotator sees: stored clips from an index log, and what taggers said of them in any of the shapes they write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.scratch import written
from echofold.sources.logs import holds_object, last_line_wins

#: Most predictions shown of a row.
SHOWN = 5


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, which is worked out once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def predictions(line: Column) -> Column:
    """label and score of a tag row's predictions, best first: a list of objects or of pairs, or an object by label, under scores, top_scores or predictions, else the one under top or top1.

    A prediction without a label is left out; one without a finite score has null and is placed as if it were sure.
    """
    return _predictions(F.try_parse_json(line))


def _predictions(v: Column) -> Column:
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    first = lambda x, paths, kind: F.coalesce(*[F.try_variant_get(x, p, kind) for p in paths])
    labels, scores = ("$.label", "$.name", "$.display_name", "$.common_name", "$.scientific_name", "$[0]"), ("$.score", "$.prob", "$.p", "$[1]")
    kind = "array<struct<label:string,score:double>>"
    of_list = lambda p: F.transform(get(p, "array<variant>"), lambda x: F.struct(first(x, labels, "string").alias("label"), _finite(first(x, scores, "double")).alias("score")))
    of_map = lambda p: F.transform(F.map_entries(get(p, "map<string,variant>")), lambda e: F.struct(e["key"].alias("label"), _finite(F.try_variant_get(e["value"], "$", "double")).alias("score")))
    listed = [_let(F.coalesce(of_list(p), of_map(p)).cast(kind), lambda x: F.when(F.size(x) > 0, x)) for p in ("$.scores", "$.top_scores", "$.predictions")]
    named = F.filter(F.coalesce(*listed, F.array().cast(kind)), lambda p: F.coalesce(p["label"], F.lit("")) != "")
    top = F.coalesce(get("$.top.label", "string"), get("$.top.name", "string"), get("$.top1.label", "string"), get("$.top1.name", "string"))
    alone = F.when(F.coalesce(top, F.lit("")) != "", F.array(F.struct(top.alias("label"), _finite(F.coalesce(get("$.top.score", "double"), get("$.top1.score", "double"))).alias("score")))).otherwise(F.array().cast(kind))
    all_ = _let(named, lambda x: F.when(F.size(x) > 0, x).otherwise(alone.cast(kind)))
    placed = F.array_sort(F.transform(all_, lambda p, k: F.struct((-F.coalesce(p["score"], F.lit(1.0))).alias("o"), k.alias("k"), p.alias("p"))))
    return F.slice(F.transform(placed, lambda x: x["p"]), 1, SHOWN)


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines as variants (_v), each parsed once: filters on what is read of them aren't moved to before an explode, where each would parse the line again."""
    return lines.select(F.explode(F.array(F.try_parse_json("line"))).alias("_v"))


def tag_rows(lines: DataFrame, lane: str) -> DataFrame:
    """clip_key, lane, model, version and predictions of a tag log (path, line); lines that are no object or have no key are left out."""
    v = F.col("_v")
    get = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])
    rows = _parsed(lines).where(holds_object(v)).select(
        get("$.clip_key", "$.key").alias("clip_key"), F.lit(lane).alias("lane"), F.coalesce(get("$.model.name", "$.model_name", "$.lane"), F.lit("model")).alias("model"),
        get("$.model.version", "$.model_version").alias("version"), _predictions(v).alias("predictions"),
    )
    return rows.where("clip_key is not null")


def stored_clips(lines: DataFrame) -> DataFrame:
    """clip_key and path of the clips that an index log (path, line) says are stored, the last line of a key counting. Paths that leave the pool are refused."""
    v = F.col("_v")
    get = lambda p: F.nullif(F.try_variant_get(v, p, "string"), F.lit(""))
    rows = _parsed(lines).where(holds_object(v)).select(F.coalesce(get("$.clip_key"), get("$.key")).alias("clip_key"), get("$.path").alias("clip_path"), get("$.outcome").alias("outcome"), F.coalesce(F.try_variant_get(v, "$.at", "double"), F.lit(0.0)).alias("at"))
    inside = ~F.col("clip_path").rlike(r"^/|(^|/)\.\.(/|$)|^\.?/*$")
    good = rows.where((F.col("outcome") == "stored") & F.col("clip_path").isNotNull() & inside)
    return last_line_wins(good.drop("outcome"), "clip_key", ["at", "clip_path"]).select("clip_key", "clip_path")


def annotation_items(index: DataFrame, lanes: Mapping[str, DataFrame]) -> DataFrame:
    """Every stored clip with its tag rows by lane (clip_key, clip_path, tags: lane, model, version, predictions), in order of lane and model, and its best prediction (top, top_score)."""
    tags = None
    for lane, lines in lanes.items():
        rows = tag_rows(lines, lane)
        tags = rows if tags is None else tags.unionByName(rows)
    clips = written(stored_clips(index))
    entry = F.struct("lane", "model", "version", "predictions")
    # As many as models have tagged one clip.
    grouped = tags.join(clips.select("clip_key"), "clip_key", "left_semi").groupBy("clip_key").agg(F.sort_array(F.collect_list(entry)).alias("tags"))
    best = F.array_max(F.transform(F.filter(F.flatten(F.transform("tags", lambda t: t["predictions"])), lambda p: p["score"].isNotNull()), lambda p: F.struct(p["score"].alias("score"), p["label"].alias("label"))))
    out = clips.join(grouped, "clip_key", "left").withColumn("best", best)
    return out.select("clip_key", "clip_path", "tags", F.col("best.label").alias("top"), F.col("best.score").alias("top_score"))
