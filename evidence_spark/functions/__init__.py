from evidence_spark.functions.metrics import (
    clamp0_report,
    clamp01,
    f1,
    repair_precision,
    round_half_up,
)
from evidence_spark.functions.text import (
    BEGIN_MARKER,
    END_MARKER,
    QUOTE_PATTERN,
    format_score,
    is_blank,
    normalize_text,
    normalize_variant,
    nz,
    parse_quotes,
    py_strip,
    question_key,
    quote_block,
    remove_whitespace,
    tokenize,
)

__all__ = [
    "BEGIN_MARKER",
    "END_MARKER",
    "QUOTE_PATTERN",
    "clamp0_report",
    "clamp01",
    "f1",
    "format_score",
    "is_blank",
    "normalize_text",
    "normalize_variant",
    "nz",
    "parse_quotes",
    "py_strip",
    "question_key",
    "quote_block",
    "remove_whitespace",
    "repair_precision",
    "round_half_up",
    "tokenize",
]
