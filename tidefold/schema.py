"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

SERIES = "obs string, b bigint, v double"
SPECTRUM = "obs string, bin bigint, re double, im double"
SPECTRUM_PAGE = "obs string, page bigint, lo_bin bigint, re array<double>, im array<double>"
OBSERVATION = "path string, object string, epoch_mjd double, n_samples bigint, dt double, dm double"
TRIAL_METRIC = "obs string, block bigint, k int, t bigint, r double, nharm int, metric double"
CANDIDATE = "obs string, freq double, metric double, r double, nharm int, ducy double"
