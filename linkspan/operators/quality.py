"""Statuses that keep "none" apart from "could not check", completeness, health, and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded

# ---- fixed values -------------------------------------------------------------------------------------------------------
NEAR_MISS_REASONS = ("NO_API_KEY", "EMPTY_AFTER_NORMALIZATION", "SEARCH_FAILED", "SEMANTIC_TYPE_LOOKUP_FAILED", "NO_SEMANTIC_TYPE", "TYPE_REJECTED", "SUPPORT_LOOKUP_FAILED", "SINGLE_VOCABULARY_ONLY", "NOT_THE_LAY_MEANING", "REGISTRY_LOOKUP_FAILED")
HEALTH = ("ok", "absent", "error")
# -------------------------------------------------------------------------------------------------------------------------

def three_valued(checked: Column, payload: Column, found: str, none: str, failed: str) -> Column:
    """``failed`` where it could not be checked, ``none`` where nothing is there, else ``found``."""
    return F.when(~F.coalesce(checked, F.lit(False)), failed).when(payload.isNull() | (F.size(payload) <= 0), none).otherwise(found)


def sealed(steps: dict[str, Column], failed: tuple[str, ...] = ("LOOKUP_FAILED", "INCOMPLETE_RETRIEVAL", "RETRIEVAL_ERROR")) -> tuple[Column, Column]:
    """(map of step to status and note, sorted names of degraded steps)."""
    pairs = [v for k, s in steps.items() for v in (F.lit(k), F.struct(s.alias("status"), F.when(s.isin(*failed), F.concat(F.lit("could not complete: "), s)).alias("note")))]
    names = F.array_compact(F.array(*[F.when(s.isin(*failed), F.lit(k)) for k, s in sorted(steps.items())]))
    return F.create_map(*pairs), names


def completeness(pages: DataFrame, key: str, item: str, total: str) -> DataFrame:
    """Key, retrieved, total, status: OK only when the reported total is known and as many distinct items came."""
    out = pages.groupBy(key).agg(F.count_distinct(item).alias("retrieved"), F.max(total).alias("total"))
    return out.withColumn("status", F.when(F.col("total").isNull() | (F.col("retrieved") < F.col("total")), "INCOMPLETE_RETRIEVAL").otherwise("OK"))


def validity(rows: DataFrame, ok: Column) -> DataFrame:
    """n_valid and n_malformed."""
    good = F.coalesce(ok, F.lit(False))
    return rows.agg(F.count_if(good).alias("n_valid"), F.count_if(~good).alias("n_malformed"))


def assert_row_parity(parsed: DataFrame, raw: DataFrame, what: str = "table") -> int:
    """The number of rows, or ValueError when parsing lost or made some."""
    a, b = parsed.count(), raw.count()
    if a != b:
        raise ValueError(f"{what}: {b} rows were read and {a} parsed")
    return a


def over_band(rates: DataFrame, bands: DataFrame, name: str = "gauge", floor: float = 0.0) -> DataFrame:
    """Gauge, rate, band, over_band: report only; rates at or below the floor never count as over."""
    return rates.join(bounded(bands.select(name, "band")), name, "left").withColumn("over_band", F.coalesce((F.col("rate") >= F.col("band")) & (F.col("rate") > floor), F.lit(False)))


def source_health(events: DataFrame, header_ok: Column | None = None) -> DataFrame:
    """Degraded (sorted sources whose first verdict is not ok), n_sources. A drifted header is an error."""
    status = F.col("status") if header_ok is None else F.when(~header_ok, "error").otherwise(F.col("status"))
    first = events.withColumn("status", status).groupBy("source").agg(F.min_by("status", "_ord").alias("status"))
    return first.agg(F.sort_array(F.collect_set(F.when(F.col("status") != "ok", F.col("source")))).alias("degraded"), F.count("*").alias("n_sources"))
