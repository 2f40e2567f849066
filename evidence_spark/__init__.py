"""Quote-grounded QA dataset curation and evaluation as Spark DataFrame operators.

Sub-packages
- ``functions``  column expressions (quote parsing, format check, tokens, metrics)
- ``operators``  DataFrame -> DataFrame operators (BM25, judging, scoring, reports,
                 curation, chat rendering, keyed upserts)
- ``sources``    readers and writers (corpus files, inference files, score tables)
- ``plans``      composed jobs and the fixture tables used by the checks
- ``streaming``  Structured Streaming ingest and live reports
"""

from evidence_spark.session import build_session, ensure_checkpoint_dir, scratch_path

__all__ = ["build_session", "ensure_checkpoint_dir", "scratch_path"]
