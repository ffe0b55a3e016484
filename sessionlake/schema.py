"""Schemas of the archive's tables."""

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_A = T.ArrayType(T.StringType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SESSION = struct(
    id=_S, project=_S, date=_S, title=_S, tool=_S, fill_pct=_D, session_timestamp=_S, updated_at=_S, session_type=_S, error_tags=_A, topic_tags=_A,
    archive_path=_S, source_jsonl=_S, source_size_bytes=_L, provider=_S, fill_estimated=_B, output_tokens=_L, tokens_estimated=_B, transcript_hash=_S, secret_flags=_A, raw_path=_S,
)
MESSAGE = struct(session_id=_S, turn=_L, role=_S, text=_S, ts=T.TimestampType(), speaker=_S)
RAW_LINE = struct(session_id=_S, line_no=_L, line=_S)
CAPTURED = struct(id=_S, source_path=_S, size=_L, mtime_secs=_L, captured_at=_S)
TOMBSTONE = struct(id=_S, deleted_at=_S, source_path=_S)
REDACTION = struct(seq=_L, session_id=_S, find=_S, replace=_S)
EMBEDDING = struct(session_id=_S, model_name=_S, summary_hash=_S, embedding=T.ArrayType(T.FloatType()))
FACT = struct(section=_S, fact=_S, evidence=_A, date=_S)
#: Values of late-added columns where an older index has none.
DEFAULTS = {"updated_at": "", "session_timestamp": "", "raw_path": "", "transcript_hash": "", "output_tokens": 0, "source_size_bytes": 0, "fill_estimated": False, "tokens_estimated": True}
