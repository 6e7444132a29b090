"""Types of the memory tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

_S, _T, _I, _L, _D, _B = StringType(), TimestampType(), IntegerType(), LongType(), DoubleType(), BooleanType()
_LIST, _MAP = ArrayType(_S), MapType(_S, _S)


def _table(**columns) -> StructType:
    return StructType([StructField(k, v) for k, v in columns.items()])


TABLES = {
    "sources_config": _table(id=_S, path=_S, enabled=_B, exclude_patterns=_LIST, added_at=_T),
    "documents": _table(document_id=_S, filename=_S, modality=_S, source_type=_S, source_uri=_S, checksum=_S, ingested_at=_T, status=_S, enrichment_status=_S),
    "chunks": _table(chunk_id=_S, document_id=_S, content=_S, chunk_index=_I, total_chunks=_I, page_number=_I, summary=_S, category=_S, action_items=_LIST, vec_id=_S),
    "nodes": _table(id=_S, type=_S, name=_S, properties=_MAP, first_seen=_T, last_seen=_T, mention_count=_L),
    "node_chunks": _table(node_id=_S, chunk_id=_S),
    "edges": _table(id=_S, source=_S, target=_S, relationship=_S, properties=_MAP, created_at=_T, source_chunk=_S),
    "beliefs": _table(id=_S, node_id=_S, belief=_S, confidence=_D, source_chunk=_S, ts=_T, superseded_by=_S),
    "audit_log": _table(id=_S, event_type=_S, payload=_S, timestamp=_T),
    "insights": _table(id=_S, type=_S, title=_S, description=_S, related_entities=_LIST, created_at=_T),
    "incidents": _table(timestamp=_T, subsystem=_S, operation=_S, reason=_S, severity=_S, blocked=_B, payload=_S),
}
