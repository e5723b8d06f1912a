"""Table functions for SQL, and functions that are known by name.

The table functions take a table by partition: ``SELECT * FROM claim_pending(TABLE(ledger) PARTITION BY (tenant) ORDER BY (next_attempt_at, record_id), 10, 100.0D)``. They
hold counters only, whatever the partition's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from echofold.operators import fusion


@udtf(returnType="tenant string, record_id string, next_attempt_at double, place long")
class ClaimPending:
    """The first ``most`` due rows (tenant, record_id, next_attempt_at) of a partition, in the order that they come in."""

    def __init__(self):
        self.n = 0

    def eval(self, row, most: int, now: float):
        if self.n < most and row["next_attempt_at"] is not None and row["next_attempt_at"] <= now:
            self.n += 1
            yield row["tenant"], row["record_id"], float(row["next_attempt_at"]), self.n


@udtf(returnType="day string, n long, n_unfinished long, verdict string")
class EnforceRetention:
    """For a day's partition of rows (day, finished, received_at): ``drop`` if all are finished and before the horizon, else why it stays."""

    def __init__(self):
        self.day, self.n, self.open, self.latest, self.horizon = None, 0, 0, None, None

    def eval(self, row, horizon: float):
        self.day, self.n, self.horizon = row["day"], self.n + 1, horizon
        self.open += not row["finished"]
        at = row["received_at"]
        self.latest = at if self.latest is None or (at is not None and at > self.latest) else self.latest

    def terminate(self):
        if self.n:
            young = self.latest is None or self.latest >= self.horizon
            yield self.day, self.n, self.open, "unfinished_rows" if self.open else "within_horizon" if young else "drop"


@udtf(returnType="tenant string, record_id string, stated string, actual string")
class VerifyPayloadIntegrity:
    """Rows (tenant, record_id, body, sha256) whose body hasn't the digest stated for it; a null body or digest isn't one that agrees."""

    def eval(self, row):
        actual = None if row["body"] is None else hashlib.sha256(row["body"].encode()).hexdigest()
        if actual is None or row["sha256"] != actual:
            yield row["tenant"], row["record_id"], row["sha256"], actual


@udtf(returnType="tenant string, class string, n long")
class UnroutedRecords:
    """How many rows (tenant, class) of a partition belong to each class that isn't among the ``known`` ones, separated by commas."""

    def __init__(self):
        self.tenant, self.counts = None, {}

    def eval(self, row, known: str):
        self.tenant = row["tenant"]
        if row["class"] not in known.split(","):
            self.counts[row["class"]] = self.counts.get(row["class"], 0) + 1

    def terminate(self):
        for name, n in sorted(self.counts.items(), key=lambda x: (x[0] is not None, x[0] or "")):
            yield self.tenant, name, n


TABLE_FUNCTIONS = {"claim_pending": ClaimPending, "enforce_retention": EnforceRetention, "verify_payload_integrity": VerifyPayloadIntegrity, "unrouted_records": UnroutedRecords}


def register_table_functions(spark: SparkSession) -> None:
    for name, kind in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, kind)


class Registry:
    """Functions by name. A name is given once."""

    def __init__(self, what: str, **known: Callable):
        self.what, self._known = what, dict(known)

    def register(self, name: str, f: Callable) -> None:
        if name in self._known:
            raise ValueError(f"there is a {self.what} of the name {name}")
        self._known[name] = f

    def names(self) -> list[str]:
        return sorted(self._known)

    def __getitem__(self, name: str) -> Callable:
        if name not in self._known:
            raise ValueError(f"no {self.what} of the name {name}; known are {', '.join(self.names())}")
        return self._known[name]


def _by_logodds(p: Column) -> Column:
    return fusion.sigmoid(F.avg(F.when(p.isNotNull(), fusion.logit(p))))


#: Aggregates of several probabilities for one event.
FUSERS = Registry("fuser", logodds=_by_logodds, linear=lambda p: F.avg(p))
#: Pairs (fit, score): ``fit(rows, by, vector)`` gives a table of models, ``score(rows, models, by, vector)`` adds ``distance`` and ``threshold``.
MODELS = Registry("model", gaussian=(fusion.gaussian_fit, fusion.gaussian_distance), axes=(lambda rows, by, vector: fusion.gaussian_fit(rows, by, vector, shrinkage=1.0), fusion.gaussian_distance))


def fused(rows: DataFrame, by: str, p: str, how: str) -> DataFrame:
    """(by, n, p): probabilities fused by the function of a name; nulls take no part."""
    return rows.groupBy(by).agg(F.count(p).alias("n"), FUSERS[how](F.col(p)).alias("p"))


def held_out_rates(rows: DataFrame, block: str, by: str, vector: str, how: str, held: Column) -> DataFrame:
    """Share of rows above their model's threshold in each block (block, held_out, n, n_above), the model of a name being fitted on the blocks that aren't held out."""
    fit, score = MODELS[how]
    marked = rows.withColumn("_held", held)
    models = fit(marked.where("not _held"), by, vector)
    scored = score(marked, models, by, vector)
    return scored.groupBy(block, F.col("_held").alias("held_out")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") > F.col("threshold")).alias("n_above"))
