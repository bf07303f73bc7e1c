"""Query languages compiled to DataFrame plans."""

from .common import Diagnostic, EvalRange, LimitExceeded
from .logql import logql
from .promql import promql
from .traceql import traceql

__all__ = ["Diagnostic", "EvalRange", "LimitExceeded", "logql", "promql", "traceql"]
