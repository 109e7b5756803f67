"""Names, sizes and formats that every run must produce as they stand."""

SCHEMA_VERSION = "1.1.0"

SUMMARY = "summary.json"
TREND_30D = "trend_30d.json"
TOP_SITES = "top_sites.json"
EXCEPTIONS = "exceptions.json"
MANIFEST = "manifest.json"

PAYLOAD_ARTIFACTS = (SUMMARY, TREND_30D, TOP_SITES, EXCEPTIONS)
ALL_ARTIFACTS = PAYLOAD_ARTIFACTS + (MANIFEST,)

STATUS_SUCCESS = "SUCCESS"
STATUS_ERROR = "ERROR"

REQUIRED_METRICS = (
    "failures_last_24h",
    "failures_last_7d",
    "top_sites_by_failures",
    "trend_30d",
    "top_sites_30d",
    "exceptions_7d",
)

TOP_K = 10
TREND_DAYS = 30
TOP_SITES_WINDOW_DAYS = 30
EXCEPTIONS_WINDOW_DAYS = 7

# Synthetic fact table.
SYNTHETIC_SEED = 42
SYNTHETIC_ANCHOR = "2026-03-07T12:00:00Z"
SYNTHETIC_DAYS = 10
SYNTHETIC_SITES = ("site_alpha", "site_bravo", "site_charlie", "site_delta", "site_echo")
SYNTHETIC_FAILURE_TYPES = (
    "TIMEOUT",
    "AUTH_ERROR",
    "PARSE_FAILURE",
    "CONNECTION_RESET",
    "SCHEMA_MISMATCH",
)
SYNTHETIC_SUFFIX_MIN = 1000
SYNTHETIC_SUFFIX_MAX = 9999
