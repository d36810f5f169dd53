"""Row layouts of the engine's tables. Timestamps are UTC epoch milliseconds."""

from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


TOKENS = ("input", "cached", "cache_write", "output", "reasoning")

EVENT = _struct(
    id=StringType(), agent=StringType(), session=StringType(), project=StringType(),
    model=StringType(), ts=LongType(), input=LongType(), cached=LongType(),
    cache_write=LongType(), output=LongType(), reasoning=LongType(),
    path=StringType(), line=LongType(),
)
ACTIVITY = _struct(
    id=StringType(), agent=StringType(), session=StringType(), ts=LongType(),
    name=StringType(), path=StringType(), line=LongType(),
)
QUOTA = _struct(
    path=StringType(), agent=StringType(), session=StringType(), ts=LongType(),
    payload=StringType(),
)
CREDIT = _struct(
    path=StringType(), agent=StringType(), request_id=StringType(), session=StringType(),
    project=StringType(), model=StringType(), ts=LongType(), requests=LongType(),
    credits=DoubleType(), original_credits=DoubleType(), billable_requests=LongType(),
    context_usage_ratio=DoubleType(),
)
SOURCE_FILE = _struct(
    path=StringType(), agent=StringType(), size=LongType(), mtime=LongType(),
    title=StringType(), error=StringType(), updated_at=LongType(),
)
SOURCE_HEALTH = _struct(path=StringType(), agent=StringType(), malformed_lines=LongType())
RATE = _struct(
    model=StringType(), effective_from_ms=LongType(), currency=StringType(),
    input=DoubleType(), cached=DoubleType(), cache_write=DoubleType(), output=DoubleType(),
)
ALIAS = _struct(alias=StringType(), model=StringType())
