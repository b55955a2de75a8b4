"""Pluggable predictions: capabilities with an expression or pandas function, chosen by priority."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import blank_to_null, half_up, text_hash


@dataclass(frozen=True)
class Capability:
    """What a predictor offers; ``evaluate`` makes struct(value, uncertainty, applicability, status)."""

    name: str
    endpoint: str
    evaluate: Callable[[Column], Column]
    priority: int = 0


@dataclass
class Registry:
    held: dict[str, Capability] = field(default_factory=dict)

    def register(self, capability: Capability) -> None:
        """A later capability of the same name takes the place of the earlier one."""
        self.held[capability.name] = capability

    def for_endpoint(self, endpoint: str | None = None) -> list[Capability]:
        found = [c for c in self.held.values() if endpoint is None or c.endpoint == endpoint]
        return sorted(found, key=lambda c: (-c.priority, c.name))

    def predict(self, rows: DataFrame, endpoint: str, input_column: str) -> DataFrame:
        """``rows`` with the columns value, uncertainty, applicability and status of the best capability."""
        chosen = self.for_endpoint(endpoint)
        if not chosen:
            raise ValueError(f"no capability for {endpoint}")
        made = rows.withColumn("_p", chosen[0].evaluate(F.col(input_column)))
        return made.select(*rows.columns, *[F.col(f"_p.{c}").alias(f"{endpoint}_{c}") for c in ("value", "uncertainty", "applicability", "status")])


def reference_predictor(text: Column) -> Column:
    """A predictor that follows from its input's hash alone: a stand-in to test runs with."""
    h = text_hash(text)
    value = half_up(F.lit(4.0) + F.pmod(h, F.lit(500)) / 100.0)
    applicability = half_up(F.lit(0.5) + F.pmod(F.shiftright(h, 8), F.lit(50)) / 100.0)
    status = F.when(blank_to_null(text).isNull(), "FAILURE").when(applicability < 0.6, "OUT_OF_DOMAIN").otherwise("SUCCESS")
    return F.struct(F.when(status != "FAILURE", value).alias("value"), half_up(F.lit(1.0) - applicability).alias("uncertainty"), applicability.alias("applicability"), status.alias("status"))


def capabilities_for(capabilities: DataFrame, endpoint: str) -> DataFrame:
    """Rows of a table of capabilities (endpoint_id, predicted_endpoint_id) that stand for an endpoint or predict it."""
    return capabilities.where((F.col("endpoint_id") == endpoint) | (F.col("predicted_endpoint_id") == endpoint))


def needing_prediction(rows: DataFrame, measured: str, predicted: str) -> DataFrame:
    """Rows with neither a measured nor a predicted value."""
    return rows.where(F.coalesce(blank_to_null(F.col(measured).cast("string")), blank_to_null(F.col(predicted).cast("string"))).isNull())


def run_summary(rows: DataFrame, status: str, group: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s.lower()) for s in ("SUCCESS", "OUT_OF_DOMAIN", "FAILURE")])


def published(rows: DataFrame, predicted: DataFrame, row_id: str, name: str) -> DataFrame:
    """``rows`` with a prediction run's result (value, uncertainty, applicability, status by row id) as columns of its name."""
    columns = [F.col(c).alias(f"{name}_{c}") for c in ("value", "uncertainty", "applicability", "status")]
    return rows.join(predicted.select(row_id, *columns), row_id, "left")


def with_status(rows: DataFrame, row_id: str, status: str, wanted: str) -> DataFrame:
    """The row set of a run's failures or of its out-of-domain rows: row_id, ordinal (the id itself)."""
    return rows.where(F.col(status) == wanted).select(F.col(row_id).alias("row_id"), F.col(row_id).alias("ordinal")).distinct()


def spread(rows: DataFrame, a_core: int = 4) -> DataFrame:
    """``rows`` dealt over all cores, however few files or splits they are read from: predicting costs far more than moving
    a row's inputs."""
    return rows.repartition(a_core * rows.sparkSession.sparkContext.defaultParallelism)


RESULT = "value double, uncertainty double, applicability double, status string, message string"


def batched(function: Callable[[pd.Series], pd.DataFrame], in_domain: float = 0.0) -> Callable[[Column], Column]:
    """An ``evaluate`` for a capability from a function over whole batches (value, uncertainty, applicability by row). A
    batch that fails is halved until the rows that make it fail are alone: those are ``FAILURE`` with their message, all
    others keep their values. Missing inputs and values that aren't finite are failures too; below ``in_domain`` of
    applicability a row is ``OUT_OF_DOMAIN``."""

    def tried(part: pd.Series) -> pd.DataFrame:
        found, messages = np.full((len(part), 3), np.nan), np.full(len(part), None, object)

        def ran(first: int, end: int, fails: bool) -> bool:
            """Whether rows first to end ran as one batch; one that is known to fail is halved untried."""
            if not fails or end - first == 1:
                try:
                    made = function(part[first:end].reset_index(drop=True))
                    if len(made) != end - first:
                        raise ValueError(f"{len(made)} results for {end - first} rows")
                    found[first:end] = made[["value", "uncertainty", "applicability"]].astype(float).to_numpy()
                    return True
                except Exception as e:
                    if end - first == 1:
                        messages[first] = f"{type(e).__name__}: {e}"
                        return False
            half = first + (end - first) // 2
            ran(half, end, ran(first, half, False))  # after a sound first half the second holds what fails
            return False

        ran(0, len(part), False)
        return pd.DataFrame(found, columns=["value", "uncertainty", "applicability"]).assign(message=messages)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            given = batch.notna() & (batch.astype(str).str.strip() != "")
            out = pd.DataFrame({"value": np.nan, "uncertainty": np.nan, "applicability": np.nan, "message": "no input"}, index=batch.index)
            if given.any():
                made = tried(batch[given].reset_index(drop=True)).set_index(batch.index[given])
                out.loc[given, ["value", "uncertainty", "applicability"]] = made[["value", "uncertainty", "applicability"]]
                out["message"] = out["message"].where(~given, made["message"].reindex(batch.index))
            sound = np.isfinite(out["value"].astype(float))
            out["message"] = out["message"].where(sound | out["message"].notna(), "no finite value")
            out.loc[~sound, ["value", "uncertainty", "applicability"]] = np.nan
            status = np.where(~sound, "FAILURE", np.where(out["applicability"].fillna(1.0) < in_domain, "OUT_OF_DOMAIN", "SUCCESS"))
            none = lambda c: out[c].astype(object).where(out[c].notna(), None)
            yield pd.DataFrame({"value": none("value"), "uncertainty": none("uncertainty"), "applicability": none("applicability"), "status": status, "message": none("message")})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RESULT)
