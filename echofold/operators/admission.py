"""Which rows may take part in an analysis, and the one reason why another may not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.classify import ADMITTED, first_reason

#: Fixed values.
TRUSTED_TIERS = ("gnss", "location")
CLOCK_STATES = ("LOCKED", "HOLDOVER")
REASONS = (
    "line_unparseable", "unanchored", "outside_window", "pending_settle", "outside_lookback_emitted", "outside_lookback_unassociated", "not_arrival_class", "unsurveyed_node",
    "heterogeneous_receiver_class", "clock_unstated", "clock_untrusted", "clock_state_inadmissible", "sync_sigma_exceeds", "stamp_sigma_over_class_budget", "capture_path_bias",
    "onset_not_found", "onset_unstated", "latency_uncorrected",
)


@dataclass(frozen=True)
class Policy:
    """What an operator decides; times in seconds."""

    since: float | None = None
    until: float | None = None
    settle_s: float = 7_200.0
    lookback_s: float = 259_200.0
    max_sync_sigma_ns: float | None = None
    stamp_sigma_max_s: float = 129.4e-6
    bias_max_s: float = 62.5e-6
    refuse_clock_unstated: bool = True
    refuse_onset_unstated: bool = False
    heterogeneous: bool = False
    reference_class: str = "reference"
    phone_class: str = "phone"


def clock_trust(source: Column, tier: Column, onset_dated: Column, stated: Column) -> Column:
    """Three states: null for what isn't a phone or says nothing; a stamp that dates no onset is never trusted; a statement beats the tier."""
    of_phone = F.when(F.coalesce(onset_dated, F.lit(True)) == False, False).when(stated.isNotNull(), stated).when(tier.isNotNull(), tier.isin(*TRUSTED_TIERS))  # noqa: E712
    return F.when(source == "phone", of_phone)


def gate_class(source: Column, stated: Column, phone_class: str) -> Column:
    """The class whose limits a row is held to: the stated one, for phones without one their own, for nodes null (the strictest)."""
    return F.coalesce(F.nullif(stated, F.lit("")), F.when(source == "phone", F.lit(phone_class)))


def is_heterogeneous(source: Column, stated: Column, reference: str) -> Column:
    return F.coalesce(source == "phone", F.lit(False)) | F.coalesce((stated != "") & (stated != reference), F.lit(False))


def stamp_admissible(sigma_ns: Column, capture_s: Column, time_source: Column, most_s: float) -> Column:
    """Null where no sigma is stated; never true of a clock that nothing disciplines."""
    total = F.sqrt(capture_s * capture_s + F.pow(sigma_ns / 1e9, 2))
    return F.when(sigma_ns.isNotNull(), F.when(F.coalesce(time_source, F.lit("")) == "none", False).otherwise(total <= most_s))


def bias_refusal(bias_s: Column, most_s: float) -> Column:
    """bias_unmeasured, bias_too_large or null: unlike an unstated clock, a bias that nobody measured is refused."""
    return F.when(bias_s.isNull(), "bias_unmeasured").when(bias_s > most_s, "bias_too_large")


def admit(rows: DataFrame, survey: DataFrame, classes: DataFrame, emitted: DataFrame, now: float, policy: Policy = Policy()) -> DataFrame:
    """``rows`` with ``class``, ``trusted`` and ``reason``: admitted or the first of 18 reasons that holds.

    rows: key, node, source, ts (seconds, null without an anchor), parsed, clock_tier, onset_dated, utc_trusted, clock_state, sync_sigma_ns, onset_found, latency_ns.
    survey: node, class (null if unstated), arrives (whether its class may give arrivals). classes: class, capture_s, time_source, bias_s; the row whose class is null is
    the strictest and holds for nodes without one. emitted: keys associated earlier. Nulls in any flag are "not stated". Every row comes out once.
    """
    known = survey.select(F.col("node").alias("_node"), F.col("class").alias("stated"), "arrives")
    limits = classes.select(F.col("class").alias("_class"), "capture_s", "time_source", "bias_s")
    old = emitted.select(F.col("key").alias("_key")).distinct()
    joined = rows.join(known, F.col("node") == F.col("_node"), "left").withColumn("class", gate_class(F.col("source"), F.col("stated"), policy.phone_class))
    joined = joined.join(limits, F.col("class").eqNullSafe(F.col("_class")), "left").join(old, F.col("key") == F.col("_key"), "left")
    joined = joined.withColumn("trusted", clock_trust(F.col("source"), F.col("clock_tier"), F.col("onset_dated"), F.col("utc_trusted")))
    ts, state = F.col("ts"), F.upper(F.trim(F.coalesce("clock_state", F.lit(""))))
    phone = F.coalesce(F.col("source") == "phone", F.lit(False))
    outside = F.lit(False)
    if policy.since is not None:
        outside = outside | (ts < policy.since)
    if policy.until is not None:
        outside = outside | (ts > policy.until)
    over = F.lit(False) if policy.max_sync_sigma_ns is None else F.coalesce(F.col("sync_sigma_ns") > policy.max_sync_sigma_ns, F.lit(False))
    early = ts < now - policy.lookback_s
    rules = [
        (~F.coalesce("parsed", F.lit(False)), "line_unparseable"),
        (ts.isNull(), "unanchored"),
        (outside, "outside_window"),
        (ts > now - policy.settle_s, "pending_settle"),
        (early & F.col("_key").isNotNull(), "outside_lookback_emitted"),
        (early, "outside_lookback_unassociated"),
        (F.col("_node").isNotNull() & ~F.coalesce("arrives", F.lit(False)), "not_arrival_class"),
        (F.col("_node").isNull(), "unsurveyed_node"),
        (is_heterogeneous(F.col("source"), F.col("stated"), policy.reference_class) & F.lit(not policy.heterogeneous), "heterogeneous_receiver_class"),
        (phone & F.col("trusted").isNull() & F.lit(policy.refuse_clock_unstated), "clock_unstated"),
        (~F.coalesce("trusted", F.lit(True)), "clock_untrusted"),
        ((state != "") & ~state.isin(*CLOCK_STATES), "clock_state_inadmissible"),
        (over, "sync_sigma_exceeds"),
        (~F.coalesce(stamp_admissible(F.col("sync_sigma_ns"), F.col("capture_s"), F.col("time_source"), policy.stamp_sigma_max_s), F.lit(True)), "stamp_sigma_over_class_budget"),
        (bias_refusal(F.col("bias_s"), policy.bias_max_s).isNotNull(), "capture_path_bias"),
        (~F.coalesce("onset_found", F.lit(True)), "onset_not_found"),
        (F.col("onset_found").isNull() & F.lit(policy.refuse_onset_unstated), "onset_unstated"),
        (phone & F.col("latency_ns").isNull(), "latency_uncorrected"),
    ]
    return joined.withColumn("reason", first_reason(rules, ADMITTED)).select(*rows.columns, "class", "trusted", "reason")


def resolved_identity(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` (node, node_from, ...) under declared names (aliases: alias, name), the raw name kept as ``node_alias_of``."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_name"))
    out = rows.join(a, F.col("node") == F.col("_alias"), "left")
    out = out.withColumn("node_alias_of", F.when(F.col("_name").isNotNull(), F.col("node"))).withColumn("node_from", F.when(F.col("_name").isNotNull(), "alias").otherwise(F.col("node_from")))
    return out.withColumn("node", F.coalesce("_name", "node")).drop("_alias", "_name")


def pair_bound_check(members: DataFrame, speed: float, margin: float) -> DataFrame:
    """Per event (event, node, x, y, z, t): admissible, margin_dependent, n_violating and worst_excess_m over all pairs of its members."""
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.event") == F.col("b.event")) & (F.col("a.node") < F.col("b.node")))
    apart = F.sqrt(sum(F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in "xyz"))
    rows = pairs.select(F.col("a.event").alias("event"), F.abs(F.col("b.t") - F.col("a.t")).alias("dt"), (apart / speed).alias("bound"))
    out = rows.groupBy("event").agg(
        F.bool_and(F.col("dt") <= F.col("bound")).alias("admissible"),
        F.bool_and(F.col("dt") <= F.col("bound") + margin).alias("_loose"),
        F.count_if(F.col("dt") > F.col("bound")).alias("n_violating"),
        F.max(F.greatest(F.lit(0.0), F.col("dt") - F.col("bound")) * speed).alias("worst_excess_m"),
    )
    return out.select("event", "admissible", (F.col("_loose") & ~F.col("admissible")).alias("margin_dependent"), "n_violating", "worst_excess_m")


def clamped_band(low: Column, high: Column, apart_m: Column, speed: float, margin: float = 1.0) -> Column:
    """(low, high) cut at the pair's spatial Nyquist limit, null where nothing is left."""
    limit = margin * speed / (2.0 * apart_m)
    return F.when(low < limit, F.struct(low.alias("low"), F.least(high, limit).alias("high")))


def band_reach(high: Column, fs: Column, mic: Column, usable: float = 0.95) -> Column:
    """What bounds a band from above: nyquist, microphone or null."""
    nyq, mic = fs / 2 * usable, F.coalesce(mic, F.lit(float("inf")))
    return F.when((nyq < high) & (nyq <= mic), "nyquist").when(mic < high, "microphone")


def frame_refusal(frame: dict[str, Column], bands: int, frames: int, layout: str, fs: float | None, weights: int) -> Column:
    """Why a frame can't be scored by a model, the most specific cause first; null where none of these holds."""
    return F.nullif(
        first_reason(
            [
                (frame["frames"] != frames, "frames"),
                (frame["bands"] < bands, "bands_short"),
                (frame["layout"].isNull(), "layout_unstated"),
                (frame["layout"] != layout, "layout_mismatch"),
                (F.lit(fs is not None) & ~frame["fs_hz"].eqNullSafe(F.lit(fs)), "fs_mismatch"),
                (frame["valid_bands"] < bands, "bands_for_rate"),
                (F.lit(weights != bands * frames), "model_weights"),
            ],
            "unclassified",
        ),
        F.lit("unclassified"),
    )


def key_rule(key: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the most specific rule (pattern, name): a literal one, else the longest pattern with ``{}`` parts that fits whole."""
    out = F.lit(None).cast("string")
    templated = sorted((r for r in rules if "{" in r[0]), key=lambda r: len(r[0]))
    for pattern, name in templated + [r for r in rules if "{" not in r[0]]:
        import re

        fits = key.rlike("^" + "".join("[^:]+" if p.startswith("{") else re.escape(p) for p in re.split(r"(\{[a-z_]+\})", pattern)) + "$")
        out = F.when(fits, name).otherwise(out)
    return out


def of_tenant(rows: DataFrame, tenant: str | int) -> DataFrame:
    """The only way to a table with rows of several tenants; rows without a tenant are nobody's."""
    if tenant is None:
        raise ValueError("a tenant must be named")
    return rows.where(F.col("tenant_id") == F.lit(tenant))


def reconstructible_fields(rows: DataFrame, allowed: set[str]) -> list[str]:
    """Paths of columns that could carry sound: binary, or arrays of numbers outside the allowed ones."""
    from pyspark.sql import types as T

    found = []

    def walk(kind, path: str) -> None:
        if path in allowed:
            return
        if isinstance(kind, T.BinaryType):
            found.append(path)
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.NumericType):
                found.append(path)
            else:
                walk(kind.elementType, path)
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, path)

    walk(rows.schema, "")
    return found
