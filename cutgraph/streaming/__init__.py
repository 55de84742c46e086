"""Incremental forms of operators over an event stream. Late rows beyond the watermark are dropped, as Spark does."""
