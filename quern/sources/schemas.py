"""Explicit schemas of the logical tables; nothing is inferred."""

from __future__ import annotations

from ..functions.coders import VARIABLES

CODES = ", ".join(f"{v} int" for v in VARIABLES)
RAW_CORPUS = "date string, speakers string, title string, subtitle string, contents string"
CORPUS = "speech_id string, date date, year int, quarter int, speakers string, title string, subtitle string, contents string"
EXCERPTS = "speech_id string, date date, year int, quarter int, speakers string, title string, subtitle string, excerpt_words int, excerpt string"
RUN = "model string, prompt_version string, excerpt_words int, reasoning_effort string, timestamp_utc timestamp"
SIGNALS = f"speech_id string, date date, speakers string, title string, {RUN}, {CODES}"
EXTRACTION_ERRORS = f"speech_id string, date date, speakers string, title string, {RUN}, error_type string, error_message string"
HUMAN_AUDIT = "speech_id string, " + ", ".join(f"{v}_h int, {v}_flag string" for v in VARIABLES)
HUMAN_CODES = "speech_id string, date date, speaker string, borderline_vars string, notes string, " + ", ".join(f"{v} double" for v in VARIABLES)
SEALED_KEY = f"speech_id string, date date, speaker string, stratum string, {CODES}"
SERIES = "TIME_PERIOD string, OBS_VALUE double"
POLICY_EVENTS = "date date, target double, timing double, fg double, qe double"
ERROR_RATES = "source map<string,string>, caveats array<string>, variables map<string,struct<sensitivity:double,specificity:double,sensitivity_ci:array<double>,specificity_ci:array<double>,n_true_one:int,n_true_zero:int>>"
RECORD = f"struct<{', '.join(f'{v}:int' for v in VARIABLES)}>"
