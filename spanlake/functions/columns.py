"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.schemas import NS, STATUS_ERROR


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division; ``/`` would go through doubles and lose nanoseconds."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def floor_to(col: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above ``col`` (also for negative values)."""
    return col - F.pmod(col, F.lit(step).cast("bigint"))


def window_start(ns: Column, window_seconds: int) -> Column:
    """Epoch-aligned tumbling window of a nanosecond instant, in unix seconds."""
    return int_div(floor_to(ns, window_seconds * NS), NS)


def duration_ns() -> Column:
    return F.col("end_time_unix_nano") - F.col("start_time_unix_nano")


def is_error(status: str = "status_code") -> Column:
    return F.col(status) == STATUS_ERROR


def ns_to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(int_div(floor_to(ns, 1000), 1000))


def seconds_to_date(sec: Column) -> Column:
    return F.timestamp_seconds(sec).cast("date")


def safe_ratio(num: Column, den: Column, otherwise=None) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(otherwise).cast("double"))


def edge_label(caller: Column, callee: Column) -> Column:
    return F.concat(caller, F.lit("->"), callee)


def target_label() -> Column:
    """Display label of a (target_type, caller, callee) target."""
    return F.when(
        F.col("target_type") == "edge", edge_label(F.col("caller"), F.col("callee"))
    ).otherwise(F.col("callee"))


def split_target() -> list[Column]:
    """(caller, callee) of a label; an edge label is cut at its first arrow."""
    edge = F.col("target_type") == "edge"
    at = F.instr("target", "->")
    return [
        F.when(edge, F.expr("substring(target, 1, instr(target, '->') - 1)")).otherwise("").alias("caller"),
        F.when(edge & (at > 0), F.expr("substring(target, instr(target, '->') + 2)"))
        .otherwise(F.col("target"))
        .alias("callee"),
    ]


def log_bucket(value: Column, bits: int) -> Column:
    """Order-preserving log-linear bucket of a BIGINT: ``2**bits`` buckets per octave.

    A group of any size has at most ``64 * 2**bits`` buckets on either side of
    zero, which is what bounds the per-group work of the exact percentiles.
    """
    size = F.abs(value)
    octave = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int") - bits, F.lit(0))
    bucket = octave.cast("bigint") * (1 << bits) + F.call_function("shiftright", size, octave)
    return F.when(value < 0, -bucket).otherwise(bucket)


def round6(names: Sequence[str]) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]
