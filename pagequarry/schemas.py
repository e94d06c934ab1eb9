"""Schemas of the rows that travel between stages."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

_S, _MAP = StringType(), MapType(StringType(), StringType())


def _struct(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


RAW_PAGE = _struct(ord=LongType(), url=_S, original_url=_S, status=IntegerType(), html=_S, headers=_MAP, error=_S)
STRUCTURED = _struct(open_graph=_MAP, twitter_card=_MAP, json_ld=ArrayType(_S), tables=ArrayType(ArrayType(_MAP)), lists=ArrayType(ArrayType(_S)), canonical=_S, favicon=_S)
PARSED = _struct(title=_S, text=_S, links=ArrayType(_S), meta=_MAP, language=_S, structured=STRUCTURED)
PROGRESS = _struct(event=_S, url=_S, total=LongType(), done=LongType(), errors=LongType(), cached=LongType(), elapsed=DoubleType(), eta=DoubleType(), message=_S)
CACHE_ENTRY = _struct(key=_S, page=_S, ts=TimestampType())
