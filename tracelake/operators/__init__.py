"""Typed queries over the telemetry tables; every method returns a lazy DataFrame."""

from .attributes import attribute_names, attribute_values
from .logs import LogQuery
from .metrics import ExpHistogramQuery, HistogramQuery, MetricQuery, metric_catalog, metric_dimensions, metric_exemplars, metric_series
from .traces import SpanMetricsQuery, TraceQuery, get_traces, summaries, waterfall

__all__ = [
    "ExpHistogramQuery", "HistogramQuery", "LogQuery", "MetricQuery", "SpanMetricsQuery", "TraceQuery", "attribute_names", "attribute_values",
    "get_traces", "metric_catalog", "metric_dimensions", "metric_exemplars", "metric_series", "summaries", "waterfall",
]
