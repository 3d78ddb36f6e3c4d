"""Structured Streaming: incremental snapshot archive (E3/E4 at scale)."""

from dawnchorus.streaming.archive import archive_stream, read_archive  # noqa: F401
