"""OTLP/JSON trace exports: parse, flatten, validate, normalise to span rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERVICE_KEY = "service.name"
UNKNOWN_SERVICE = "unknown_service"

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# 64-bit integers are JSON strings in OTLP/JSON; a plain number is read as its text.
ANY_VALUE = _struct(
    stringValue=_S,
    boolValue=T.BooleanType(),
    intValue=_S,
    doubleValue=T.DoubleType(),
    arrayValue=_S,
    kvlistValue=_S,
    bytesValue=_S,
)
ATTRIBUTES = T.ArrayType(_struct(key=_S, value=ANY_VALUE))
SPAN = _struct(
    traceId=_S,
    spanId=_S,
    parentSpanId=_S,
    name=_S,
    startTimeUnixNano=_S,
    endTimeUnixNano=_S,
    status=_struct(code=T.IntegerType()),
    attributes=ATTRIBUTES,
)
RESOURCE_SPANS = T.ArrayType(
    _struct(
        resource=_struct(attributes=ATTRIBUTES),
        scopeSpans=T.ArrayType(_struct(spans=T.ArrayType(SPAN))),
    )
)
CORRUPT = "_corrupt_record"
REQUEST = _struct(resourceSpans=RESOURCE_SPANS, **{CORRUPT: _S})


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """One export request per JSON line; undecodable lines keep their text."""
    return spark.read.schema(REQUEST).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def parse_otlp(lines: DataFrame, value: str = "value") -> DataFrame:
    """The same for a text column, batch or stream (e.g. the value of a topic)."""
    parsed = F.from_json(F.col(value).cast("string"), REQUEST, {"columnNameOfCorruptRecord": CORRUPT})
    # A generator keeps the parse from being repeated for every column used above it.
    return lines.select(F.inline(F.array(parsed)))


def split_corrupt(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded, quarantine): a bad record is set aside and the rest continues."""
    bad = F.col(CORRUPT).isNotNull()
    return requests.filter(~bad).drop(CORRUPT), requests.filter(bad).select(CORRUPT)


def skip_corrupt(requests: DataFrame) -> DataFrame:
    return split_corrupt(requests)[0]


def resolve_service_name(attributes: Column) -> Column:
    """The first ``service.name`` resource attribute; its non-string value is ''."""
    first = F.get(F.filter(attributes, lambda a: a["key"] == SERVICE_KEY), 0)
    return F.when(first.isNull(), UNKNOWN_SERVICE).otherwise(F.coalesce(first["value"]["stringValue"], F.lit("")))


def otlp_flatten(requests: DataFrame) -> DataFrame:
    """Resource -> scope -> span, with the resource's service on every span."""
    resources = requests.select(F.explode("resourceSpans").alias("r"))
    scopes = resources.select(
        resolve_service_name(F.col("r.resource.attributes")).alias("resource_service"),
        F.explode("r.scopeSpans").alias("s"),
    )
    return scopes.select("resource_service", F.explode("s.spans").alias("span")).select("resource_service", "span.*")


def _identified() -> Column:
    return (F.length(F.coalesce("traceId", F.lit(""))) > 0) & (F.length(F.coalesce("spanId", F.lit(""))) > 0)


def validate_spans(flat: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Drop spans without trace or span id; ``observation`` counts both kinds."""
    if observation is not None:
        flat = flat.observe(
            observation,
            F.count(F.lit(1)).alias("received"),
            F.count_if(~_identified()).alias("invalid"),
        )
    return flat.filter(_identified())


def validation_counts(flat: DataFrame) -> DataFrame:
    return flat.agg(F.count(F.lit(1)).alias("received"), F.count_if(~_identified()).alias("invalid"))


def fixed_notation(value: Column) -> Column:
    """Shortest decimal text of a double without an exponent (1.0 -> 1, 1e21 -> 22 digits)."""
    text = F.abs(value).cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).try_cast("int")).otherwise(0)
    whole = F.substring_index(mantissa, ".", 1)
    part = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(whole, part)
    point = F.length(whole) + exponent  # digits before the decimal point
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    large = F.concat(digits, zeros(point - F.length(digits)))
    middle = F.concat(
        F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))
    )
    small = F.concat(F.lit("0."), zeros(-point), digits)
    fixed = F.when(point >= F.length(digits), large).when(point > 0, middle).otherwise(small)
    # A zero whole part leaves a leading zero digit, e.g. "0.25" -> "025".
    fixed = F.when(exponent == 0, F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))).otherwise(fixed)
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == float("inf"), "+Inf")
        .when(value == float("-inf"), "-Inf")
        .otherwise(F.concat(sign, fixed))
    )


def stringify(value: Column) -> Column:
    """An attribute value as text; arrays, key-value lists and bytes become ''."""
    return (
        F.when(value["stringValue"].isNotNull(), value["stringValue"])
        .when(value["boolValue"].isNotNull(), value["boolValue"].cast("string"))
        .when(value["intValue"].isNotNull(), value["intValue"])
        .when(value["doubleValue"].isNotNull(), fixed_notation(value["doubleValue"]))
        .otherwise("")
    )


def attribute_map(attributes: Column) -> Column:
    """The last entry of every key stands (map key policy LAST_WIN, set by the session's settings)."""
    kept = F.filter(attributes, lambda a: a["key"] != SERVICE_KEY)
    return F.map_from_entries(F.transform(kept, lambda a: F.struct(a["key"], stringify(a["value"]))))


def _readable(field: Callable[[str], Column] = F.col) -> Column:
    """Whether both times are absent or 64-bit numbers."""
    times = (field("startTimeUnixNano"), field("endTimeUnixNano"))
    return ~(
        (times[0].isNotNull() & times[0].try_cast("bigint").isNull())
        | (times[1].isNotNull() & times[1].try_cast("bigint").isNull())
    )


def unreadable_spans() -> Column:
    """How many spans of a request :func:`split_unreadable` would set aside (bigint)."""
    add = lambda total, n: total + n
    count = lambda items, of: F.when(items.isNotNull(), F.aggregate(F.transform(items, of), F.lit(0).cast("bigint"), add)).otherwise(0)
    bad = lambda span: F.when(_readable(span.getField), 0).otherwise(1).cast("bigint")
    return count(F.col("resourceSpans"), lambda r: count(r["scopeSpans"], lambda s: count(s["spans"], bad)))


def split_unreadable(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, quarantine): spans whose times are no 64-bit numbers are set aside."""
    return flat.filter(_readable()), flat.filter(~_readable())


def normalize_span_row(flat: DataFrame, ingested_at_ns: Column | None = None) -> DataFrame:
    """Flattened spans as rows of the span table.

    The resource's service is appended as the last attribute before the split,
    so it wins over a ``service.name`` among the span's own attributes. Spans with
    unreadable times are left out; :func:`split_unreadable` has them.
    """
    flat = split_unreadable(flat)[0]
    own = F.coalesce(F.col("attributes"), F.array().cast(ATTRIBUTES))
    now = F.unix_micros(F.current_timestamp()) * 1000 if ingested_at_ns is None else ingested_at_ns
    return flat.select(
        F.lower("traceId").alias("trace_id"),
        F.lower("spanId").alias("span_id"),
        F.lower(F.coalesce("parentSpanId", F.lit(""))).alias("parent_span_id"),
        F.col("resource_service").alias("service_name"),
        F.coalesce("name", F.lit("")).alias("span_name"),
        F.coalesce(F.col("startTimeUnixNano").try_cast("bigint"), F.lit(0)).alias("start_time_unix_nano"),
        F.coalesce(F.col("endTimeUnixNano").try_cast("bigint"), F.lit(0)).alias("end_time_unix_nano"),
        F.coalesce(F.col("status.code"), F.lit(0)).alias("status_code"),
        attribute_map(own).alias("attributes"),
        now.cast("bigint").alias("ingested_at_unix_nano"),
    )


BATCH_SPANS, BATCH_SECONDS = 5000, 2.0


def topic_options(servers: str, topic: str, batch_size: int = BATCH_SPANS, batch_seconds: float = BATCH_SECONDS, **options) -> dict[str, str]:
    """Options of the Kafka source: a micro-batch begins once ``batch_size`` records wait or the first has
    waited ``batch_seconds``, whichever comes first. ``options`` go over these."""
    own = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "minOffsetsPerTrigger": str(batch_size),
        "maxTriggerDelay": f"{round(batch_seconds * 1000)}ms",
    }
    return own | {name: str(value) for name, value in options.items()}


def span_topic(spark: SparkSession, servers: str, topic: str, batch_size: int = BATCH_SPANS, batch_seconds: float = BATCH_SECONDS, **options) -> DataFrame:
    """Export requests from a Kafka topic (needs the Kafka connector on the class path).

    The source itself waits for a batch's size or time, so start its stream with an
    interval well below ``batch_seconds``.
    """
    stream = spark.readStream.format("kafka").options(**topic_options(servers, topic, batch_size, batch_seconds, **options))
    return parse_otlp(stream.load())


def any_value(**kinds: Column) -> Column:
    """An AnyValue struct with one kind set (for building requests from tables)."""
    return F.struct(*[kinds.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ANY_VALUE.fields])


def attribute(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))
