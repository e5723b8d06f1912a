"""Terminal classes of compared pairs, as ordered rules: one row per pair, the first rule that holds decides.

A pair has columns of both sides (``l_`` and ``r_``) and of its own. Columns that a pair doesn't have count as not stated, as nulls do, and what isn't
stated never makes a rule hold unless the rule asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.classify import first_reason

#: Fixed values, in seconds.
LIVE_GRACE_S, ORDER_GRACE_S, SETTLE_S, LATE_ARRIVAL_S, SKEW_S, RETENTION_EDGE_S, CURSOR_TTL_S = 300, 300, 900, 3_600, 5, 3_600, 86_400
DRIFT_KINDS = ("none", "insert_drift", "delete_drift", "update_drift", "reorder_drift", "snapshot_drift", "pin_absent")
#: How grave a class is, and what repairs it.
WRITE_CLASSES = {
    "match": ("info", "none"),
    "pending": ("info", "none"),
    "missing_canonical": ("critical", "replay_inbox"),
    "missing_legacy": ("warn", "manual_review"),
    "duplicate_canonical": ("critical", "manual_review"),
    "duplicate_legacy": ("warn", "manual_review"),
    "stale_canonical": ("warn", "replay_outbox"),
    "stale_legacy": ("warn", "manual_review"),
    "outcome_divergence": ("critical", "manual_review"),
    "value_divergence": ("critical", "manual_review"),
    "order_divergence": ("warn", "none"),
    "identity_divergence": ("critical", "manual_review"),
    "error_legacy": ("critical", "manual_review"),
    "error_canonical": ("warn", "replay_inbox"),
    "unclassified": ("critical", "manual_review"),
}
#: Classes of lists that stop a release; the others are warnings, but for match and pending.
LIST_CRITICAL = (
    "cursor_divergence", "tie_break_divergence", "count_divergence", "membership_divergence", "aggregate_divergence", "export_divergence",
    "filter_divergence", "projection_divergence", "tombstone_divergence", "threshold_divergence", "scope_divergence", "comparator_fault", "unclassified",
)


class Pair:
    """The columns of a table of pairs by name; null where the table has none."""

    def __init__(self, pairs: DataFrame):
        self.names = set(pairs.columns)

    def __call__(self, name: str, default=None) -> Column:
        stated = F.col(name) if name in self.names else F.lit(None)
        return stated if default is None else F.coalesce(stated, F.lit(default))

    def differ(self, name: str) -> Column:
        """Both sides state it, and not the same."""
        return F.coalesce(self(f"l_{name}") != self(f"r_{name}"), F.lit(False))

    def either(self, name: str, value) -> Column:
        return F.coalesce(self(f"l_{name}") == value, F.lit(False)) | F.coalesce(self(f"r_{name}") == value, F.lit(False))

    def holds(self, name: str) -> Column:
        return F.coalesce(self(name).cast("double") > 0, F.lit(False))


def _other_producer(p: Pair) -> Column:
    return p.differ("device_id") | p.differ("site_id") | p.differ("principal_id")


def write_class(pairs: DataFrame) -> Column:
    """One of 15 classes of a dual write: l_ is the authoritative side, r_ the mirror.

    Columns: outcome (absent, errored, ...), row_count, state_hash, device_id, site_id and principal_id of both sides; age_s, grace_s, sequence_gap,
    order_grace_s, n_differences and stale_side (legacy or canonical) of the pair.
    """
    p = Pair(pairs)
    here, there = p("l_outcome", "absent") != "absent", p("r_outcome", "absent") != "absent"
    age = p("age_s", 0.0)
    return first_reason(
        [
            (~here & ~there, "unclassified"),
            (here & there & _other_producer(p), "identity_divergence"),
            (p("l_outcome", "absent") == "errored", "error_legacy"),
            (p("r_outcome", "absent") == "errored", "error_canonical"),
            (p("r_row_count", 0) > 1, "duplicate_canonical"),
            (p("l_row_count", 0) > 1, "duplicate_legacy"),
            (here & ~there & (age < p("grace_s", float(LIVE_GRACE_S))), "pending"),
            (here & ~there, "missing_canonical"),
            (there & ~here, "missing_legacy"),
            (p("l_outcome") != p("r_outcome"), "outcome_divergence"),
            (p.holds("sequence_gap") & (age >= p("order_grace_s", float(ORDER_GRACE_S))), "order_divergence"),
            (p.holds("n_differences"), "value_divergence"),
            (p("stale_side", "") == "canonical", "stale_canonical"),
            (p("stale_side", "") == "legacy", "stale_legacy"),
            (p("l_state_hash").isNull() | p("r_state_hash").isNull(), "unclassified"),
            (p("l_state_hash") != p("r_state_hash"), "value_divergence"),
        ],
        "match",
    )


def _near_retention(p: Pair) -> Column:
    """The row is no younger than a stated horizon less the edge."""
    near = F.lit(False)
    for side in ("l", "r"):
        near = near | F.coalesce(p("age_s", 0.0) >= p(f"{side}_retention_horizon_s") - RETENTION_EDGE_S, F.lit(False))
    return near


def _read_rules(p: Pair) -> dict[str, list[tuple[Column, str]]]:
    """The rules that both read comparators ask, in groups."""
    here, there = p("l_row_state", "absent") == "present", p("r_row_state", "absent") == "present"
    young = p("age_s", 0.0) < p("settle_s", float(SETTLE_S))
    late = F.coalesce((p("late_s") > 0) & (p("late_s") <= LATE_ARRIVAL_S), F.lit(False))
    return {
        "skew": [(~F.coalesce(F.abs(p("snapshot_skew_s")) <= SKEW_S, F.lit(False)), "comparator_fault")],
        "reach": [(p.either("outcome", "unavailable"), "comparator_fault")],
        "projection": [(p.differ("projection_version"), "comparator_fault")],
        "version": [(p.differ("read_contract_major"), "version_divergence")],
        "question": [(p.differ("fingerprint"), "filter_divergence")],
        "cursor": [(p.either("cursor_stable", False) | p.holds("cursor_duplicates") | p.holds("cursor_gaps"), "cursor_divergence")],
        "deletion": [(p.either("row_state", "tombstoned") & p.either("row_state", "present"), "tombstone_divergence")],
        "retention": [(p.either("row_state", "retention_expired") & _near_retention(p), "match"), (p.either("row_state", "retention_expired"), "retention_divergence")],
        "absence": [(here & ~there & young, "pending"), (here & ~there & late, "late_arrival")],
        "extent": [(p.holds("truncated_side_only"), "pagination_divergence")],
        "order": [(p.holds("inversions") & (p("age_s", 0.0) >= p("order_grace_s", float(ORDER_GRACE_S))), "order_divergence"), (p.holds("inversions"), "match")],
        "sides": [(here & ~there, "left_only"), (there & ~here, "right_only"), (~here & ~there, "match")],
    }


def read_class(pairs: DataFrame) -> Column:
    """One of 19 classes of a shadow read of a row or a result set (``grain``: row or result_set)."""
    p = Pair(pairs)
    rules = _read_rules(p)
    whole = p("grain", "") == "result_set"
    hashes = [F.when(whole, p(f"{s}_result_hash")).otherwise(p(f"{s}_state_hash")) for s in "lr"]
    left, right, neither = (x for x, _ in rules["sides"])
    return first_reason(
        [
            (~p("grain", "").isin("row", "result_set"), "comparator_fault"),
            *rules["skew"],
            (F.coalesce(p("cursor_age_s") > CURSOR_TTL_S, F.lit(False)), "comparator_fault"),
            *rules["reach"],
            (_other_producer(p), "identity_divergence"),
            *rules["projection"],
            *rules["version"],
            *rules["question"],
            *rules["cursor"],
            ((p("r_row_count", 0) > 1) & ~whole, "duplicate_canonical_row"),
            ((p("l_row_count", 0) > 1) & ~whole, "duplicate_legacy_row"),
            *rules["deletion"],
            *rules["retention"],
            *rules["absence"],
            (left, "missing_canonical_row"),
            (right, "missing_legacy_row"),
            (neither, "match"),
            (whole & p.differ("row_count"), "count_divergence"),
            *rules["extent"],
            *rules["order"],
            (p.holds("n_differences"), "value_divergence"),
            (hashes[0].isNull() | hashes[1].isNull(), "unclassified"),
            (hashes[0] != hashes[1], "value_divergence"),
            (p.differ("outcome"), "value_divergence"),
        ],
        "match",
    )


def list_class(pairs: DataFrame) -> Column:
    """One of 23 classes of a compared list, window, aggregate or export (``grain``: page, window, aggregate or export).

    ``pin_kind`` and ``pin_fresh`` of both sides say how the read was held still; ``drift_kind`` what a pinned second read saw, ``export_class`` what
    comparing the exports gave. A difference left over on a grain other than aggregate is one of counts, and unlike digests over the same membership
    are one of membership.
    """
    p = Pair(pairs)
    rules = _read_rules(p)
    grain, drift = p("grain", ""), p("drift_kind", "none")
    left, right, neither = (x for x, _ in rules["sides"])
    young = p("age_s", 0.0) < p("settle_s", float(SETTLE_S))
    export = p("export_class", "match")
    return first_reason(
        [
            (~grain.isin("page", "window", "aggregate", "export"), "comparator_fault"),
            (p.either("surface_known", False), "comparator_fault"),
            *rules["skew"],
            *rules["reach"],
            (p.differ("threshold_fingerprint"), "threshold_divergence"),
            (p.differ("site_id") | p.differ("device_id"), "scope_divergence"),
            *rules["projection"],
            (p.differ("projection_fields_digest"), "projection_divergence"),
            *rules["version"],
            *rules["question"],
            ((p("l_pin_kind", "none") == "none") | (p("r_pin_kind", "none") == "none") | p.either("pin_fresh", False), "comparator_fault"),
            (~drift.isin(*DRIFT_KINDS) | (drift == "pin_absent"), "comparator_fault"),
            (drift == "snapshot_drift", "snapshot_drift"),
            *rules["cursor"],
            (p.holds("tie_rows_reordered"), "tie_break_divergence"),
            *rules["deletion"],
            *rules["retention"],
            *rules["absence"],
            (left | right, "membership_divergence"),
            (neither, "match"),
            (p.differ("row_count") & young, "pending"),
            (p.differ("row_count"), "count_divergence"),
            (p.differ("membership_digest"), "membership_divergence"),
            ((grain == "aggregate") & p.holds("n_differences"), "aggregate_divergence"),
            ((grain == "export") & (export == "export_divergence"), "export_divergence"),
            ((grain == "export") & (export == "export_bound_exceeded"), "export_bound_exceeded"),
            ((grain == "export") & (export != "match"), "unclassified"),
            *rules["extent"],
            *rules["order"],
            (drift != "none", "boundary_drift"),
            (p.holds("n_differences"), "count_divergence"),
            (p("l_result_hash").isNull() | p("r_result_hash").isNull(), "unclassified"),
            (p("l_result_hash") != p("r_result_hash"), "membership_divergence"),
            (p.differ("outcome"), "unclassified"),
        ],
        "match",
    )


def severity(cls: Column) -> Column:
    """info, warn or critical for a class of a compared list or read."""
    return F.when(cls.isin("match", "pending"), "info").when(cls.isin(*LIST_CRITICAL), "critical").otherwise("warn")


def mapped(cls: Column, which: int) -> Column:
    """Severity (0) or repair (1) of a class of a dual write; an unknown class counts as unclassified."""
    out = F.lit(WRITE_CLASSES["unclassified"][which])
    for name, values in WRITE_CLASSES.items():
        out = F.when(cls == name, values[which]).otherwise(out)
    return out


def export_class(pages: DataFrame, export: DataFrame, key: list[str], bound: Column, most: int = 50_000) -> DataFrame:
    """Per key: whether an export holds what the pages held, slice by slice (``slice``, ``digest``, ``n`` of both).

    export_bound_exceeded (unbounded or more than ``most`` rows), export_divergence (a slice is missing or differs) or match.
    """
    both = pages.alias("a").join(export.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "slice"]], "full_outer")
    same = F.coalesce((F.col("a.digest") == F.col("b.digest")) & (F.col("a.n") == F.col("b.n")), F.lit(False))
    rows = both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], same.alias("same"), F.coalesce("a.n", F.lit(0)).alias("paged"), F.coalesce("b.n", F.lit(0)).alias("exported"))
    out = rows.groupBy(*key).agg(F.sum("paged").alias("rows_paged"), F.sum("exported").alias("rows_exported"), F.count_if(~F.col("same")).alias("slices_off"))
    rules = [(~bound | (F.col("rows_exported") > most), "export_bound_exceeded"), ((F.col("slices_off") > 0) | (F.col("rows_paged") != F.col("rows_exported")), "export_divergence")]
    return out.withColumn("class", first_reason(rules, "match"))
