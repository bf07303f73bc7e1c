"""Scalar functions as Column builders; everything stays inside Catalyst."""

from .histograms import classic_histogram_quantile, exp_histogram_quantile, histogram_quantile
from .jsonattr import canonical_json, json_get_num, json_get_str, json_keys
from .register import register
from .text import floor_div, hex_lower, matches, parse_bytes, parse_duration, severity_band, severity_name, severity_number, tokens

__all__ = [
    "canonical_json", "classic_histogram_quantile", "exp_histogram_quantile", "floor_div", "hex_lower", "histogram_quantile", "json_get_num",
    "json_get_str", "json_keys", "matches", "parse_bytes", "parse_duration", "register", "severity_band", "severity_name", "severity_number", "tokens",
]
