"""Fixed values that results depend on, and the small dimension tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: authentication --------------------------------------------------------------------
AUTH_RESULTS = ("pass", "fail", "softfail", "neutral", "none", "temperror", "permerror", "policy")
DMARC_POLICIES = ("none", "quarantine", "reject")

# --- fixed values: anomaly thresholds ----------------------------------------------------------------
MAX_HOPS = 8
LARGE_GAP_SECONDS = 6 * 3600
EARLIEST_YEAR = 1990
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
ANOMALY_TYPES = (
    "impossible_timestamp",
    "negative_time_delta",
    "large_timezone_jump",
    "bogon_ip_in_path",
    "hop_count_outlier",
    "forged_internal_origin",
    "missing_expected_field",
    "dkim_signature_expired",
)
FORGERY_TYPES = ("forged_internal_origin", "negative_time_delta")

# --- fixed values: risk weights ----------------------------------------------------------------------
WEIGHTS = {
    "spf": {"fail": 20, "softfail": 8, "neutral": 3, "temperror": 3, "permerror": 5},
    "dkim": {"fail": 20, "none": 8},
    "dmarc_fail": {"reject": 35, "quarantine": 20, "none": 10, "unknown": 5},
    "severity": {"critical": 30, "high": 20, "medium": 10, "low": 3, "info": 0},
    "sender_lookalike": {"homoglyph_skeleton": 30, "levenshtein": 20, "jaro_winkler": 15, "brand_substring": 20},
    "url_lookalike": {"homoglyph_skeleton": 20, "levenshtein": 12, "jaro_winkler": 10, "brand_substring": 12},
}
PUNYCODE_BONUS = 10
PHISHING_THRESHOLD, PHISHING_WEIGHT = 0.7, 25
IP_LITERAL_WEIGHT, ANCHOR_MISMATCH_WEIGHT, NEW_DOMAIN_WEIGHT = 12, 10, 15
LOW_PERPLEXITY_WEIGHT = 5
MALICIOUS_FROM, SUSPICIOUS_FROM = 70, 30

# --- fixed values: lookalike rules -------------------------------------------------------------------
#: Most brands that domains are set against at once.
MOST_BRANDS = 10_000
MAX_EDITS, MIN_JARO_WINKLER, MAX_TOKEN_EDITS = 2, 0.92, 1
TRUSTED_BRANDS = (
    "paypal.com apple.com microsoft.com google.com amazon.com facebook.com instagram.com linkedin.com netflix.com dropbox.com "
    "docusign.com adobe.com ebay.com chase.com wellsfargo.com bankofamerica.com americanexpress.com citibank.com hsbc.com coinbase.com "
    "binance.com github.com salesforce.com zoom.us office.com outlook.com icloud.com yahoo.com"
).split()
# letters and digits of a domain, and below each the Latin letter it passes for
CONFUSABLE_FROM = "аеорсхуіѕјһԁԛѡцАВЕКМНОРСТХαβορυνκτχΑΒΕΖΗΙΚΟΡΤΥΧ0134578"
CONFUSABLE_TO = "aeopcxyisjhdqwuABEKMHOPCTXabopuvktxABEZHIKOPTYXoleastb"

# --- fixed values: links -----------------------------------------------------------------------------
#: In this order; where several are given, the first in the list counts.
REDIRECT_PARAMETERS = ("url", "next", "redirect", "redirect_uri", "target", "dest", "destination", "u", "r", "continue", "return", "to", "link")
NEW_DOMAIN_DAYS = 30

# --- fixed values: address ranges that are not public ---------------------------------------------------
BOGON_V4 = (
    "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.168.0.0/16 198.18.0.0/15 224.0.0.0/4 240.0.0.0/4"
).split()
DOCUMENTATION_V4 = "192.0.2.0/24 198.51.100.0/24 203.0.113.0/24".split()
DOCUMENTATION_V6 = ("2001:db8::/32",)

# --- fixed values: uploads -------------------------------------------------------------------------------
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
OLE_MAGIC = "D0CF11E0A1B11AE1"
REQUIRED_HEADERS = ("From", "Date", "Subject", "Message-ID")


def weights_table(spark: SparkSession, group: str) -> DataFrame:
    """key, weight of one group."""
    return spark.createDataFrame(list(WEIGHTS[group].items()), "key string, weight int")


def brands_table(spark: SparkSession, brands: list[str] | None = None) -> DataFrame:
    """position, brand. A list of brands is a setting, not data; it is checked against a bound before it is broadcast."""
    names = list(brands if brands is not None else TRUSTED_BRANDS)
    if len(names) > 10_000:
        raise ValueError("more than 10 000 trusted brands: join them by blocks instead")
    return spark.createDataFrame([(i, b) for i, b in enumerate(names)], "position int, brand string")
