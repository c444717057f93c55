"""Row-local stages on a stream (the reference has no streaming operators).

See ``farelens.streaming.enrich``: the row features, the enrichment joins
(stream-static, broadcast) and model scoring run unchanged on a streaming
DataFrame; group counts come from a batch fit.
"""

from farelens.streaming.enrich import enrich_stream, score_stream

__all__ = ["enrich_stream", "score_stream"]
