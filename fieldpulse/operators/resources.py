"""Container resource samples: service filter, per-container avg/peak, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.numeric import py_repr2, round2
from fieldpulse.functions.parsing import parse_cpu, parse_mem_mb, parse_net_mb
from fieldpulse.schema import BENCHMARK_SERVICES, SAMPLE_DEFAULTS

REPORT_FIELDS = ("avg_cpu", "peak_cpu", "avg_ram_mb", "peak_ram_mb", "avg_net_mb", "peak_net_mb")


def container_name(samples: DataFrame) -> Column:
    """``container`` or, when the file has no such column, ``name``; trimmed."""
    cols = set(samples.columns)
    src = F.col("container") if "container" in cols else (F.col("name") if "name" in cols else F.lit(""))
    return F.trim(F.coalesce(src, F.lit("")))


def is_service_container(name: Column, services: Sequence[str] = BENCHMARK_SERVICES) -> Column:
    """True when the name contains ``-<service>-`` for one of the services."""
    return reduce(lambda a, b: a | b, [name.contains(f"-{s}-") for s in services], F.lit(False))


def service_filter(samples: DataFrame, services: Sequence[str] = BENCHMARK_SERVICES) -> DataFrame:
    name = container_name(samples)
    return samples.withColumn("container", name).where((name != "") & is_service_container(name, services))


def parsed_samples(samples: DataFrame) -> DataFrame:
    cols = set(samples.columns)

    def col_or(name: str) -> Column:
        default = F.lit(SAMPLE_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in cols else default

    return samples.select(
        "*",
        parse_cpu(col_or("cpu_percent")).alias("cpu"),
        parse_mem_mb(col_or("mem_used")).alias("ram_mb"),
        parse_net_mb(col_or("net_io")).alias("net_mb"))


def resource_by_container(samples: DataFrame, services: Sequence[str] = BENCHMARK_SERVICES) -> DataFrame:
    """Per benchmark container: avg and peak of cpu, ram and net, rounded to 2 decimals."""
    p = parsed_samples(service_filter(samples, services))
    aggs = []
    for metric in ("cpu", "ram_mb", "net_mb"):
        aggs.append(round2(F.avg(metric)).alias(f"avg_{metric}"))
        aggs.append(round2(F.max(metric)).alias(f"peak_{metric}"))
    return p.groupBy("container").agg(*aggs).select("container", *REPORT_FIELDS)


def pair_format(report: DataFrame, prefixes: str | Sequence[str]) -> DataFrame:
    """``avg/peak`` text per container for each metric prefix (``N/A`` for a missing side).

    One projection over the report, one ``<prefix>_pair`` column per prefix.
    """
    prefixes = [prefixes] if isinstance(prefixes, str) else list(prefixes)

    def side(c: str) -> Column:
        return F.coalesce(py_repr2(F.col(c)), F.lit("N/A")) if c in report.columns else F.lit("N/A")
    return report.select("container", *[F.concat_ws("/", side(f"avg_{p}"), side(f"peak_{p}")).alias(f"{p}_pair")
                                        for p in prefixes])


def report_field_lookup(report: DataFrame, containers: DataFrame, field: str) -> DataFrame:
    """Value text of ``field`` for each requested container; ``N/A`` when absent."""
    value = py_repr2(F.col(field)) if field in report.columns else F.lit(None).cast("string")
    r = report.select("container", value.alias("_v"))
    return containers.select("container").join(r, "container", "left").select(
        "container", F.coalesce(F.col("_v"), F.lit("N/A")).alias(field))


def report_object(report: DataFrame) -> DataFrame:
    """The whole report as one JSON object keyed by container (one row).

    The report has one row per container of a benchmark stack (a handful),
    which is the only reason it may be folded into a single value.
    """
    entry = F.struct(F.col("container"), F.struct(*[F.col(c) for c in REPORT_FIELDS]))
    return report.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("report"))
