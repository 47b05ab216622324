"""Business constants shared by the operators.

Everything here is a fixed value: results only agree with the systems that
feed the tables when these match.  Operators take them as arguments, so a
deployment can pass its own.
"""

from __future__ import annotations

# --- fixed values: order status codes --------------------------------------
STOREFRONT_REALISED = (2, 10, 11, 3)
WHOLESALE_EXCLUDED = (0, 5, 6)
WHOLESALE_REALISED = (2, 10)
WHOLESALE_FUTURE = (8, 11)
VARIATION_STATUSES = (2, 10)
SKU_REPORT_EXCLUDED = (4, 6)

# --- fixed values: SKU rules ------------------------------------------------
WEB_ONLY_PREFIXES = ("web", "tweb")
REPORT_PREFIXES = ("btkn", "bta", "btc", "btd", "tr-", "trk-")

# --- fixed values: web traffic ----------------------------------------------
ORGANIC_GROUPS = ("Organic Search", "Organic Social", "Organic Video", "Organic Shopping")
SESSION_EVENT = "session_start"
PURCHASE_EVENT = "purchase"

# --- fixed values: sync queue -----------------------------------------------
QUEUE_STATUSES = ("not_ready", "pending", "in_flight", "applied", "error")
RETRY_DELAYS_SECONDS = (60, 300, 900, 3600)
MAX_RETRIES = 10
NON_RETRYABLE_CODES = ("3100", "3140", "3170", "3200", "3250")
STALE_IN_FLIGHT_SECONDS = 600
APPROVAL_THRESHOLD = 25.0
BALANCE_EPSILON = 1e-9
PARITY_TOLERANCE = 1e-6

# --- fixed values: alert thresholds, percentage points ----------------------
MARKETPLACE_CVR_DROP = -2.0
STOREFRONT_CVR_DROP = -1.5

# --- fixed values: accounting list names and identifiers --------------------
LIST_NAME_MAX = 31
LIST_HASH_LEN = 6
MEMO_MAX = 4095
UUID_URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"

# Which cost wins for each channel, first entry first.
COGS_PRECEDENCE = {
    "storefront": ("line", "dimension"),
    "wholesale": ("dimension", "line"),
    "marketplace": ("dimension",),
}
