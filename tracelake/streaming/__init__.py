"""Structured Streaming operators; each is a function of a DataFrame, streaming or not."""

from __future__ import annotations

from .events import dedup_points, session_volume, sliding_volume, tumbling_volume
from .lines import follow, reassemble, reassemble_stream, remap, render_logfmt, tail

__all__ = ["dedup_points", "follow", "reassemble", "reassemble_stream", "remap", "render_logfmt", "session_volume", "sliding_volume", "tail", "tumbling_volume"]
