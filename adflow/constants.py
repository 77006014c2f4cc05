"""Fixed values that must equal the reference's for identical results.

Fixed values (do not change; they define the data contract):
"""

# Feature vector contract: version and the 17 positions, in order.
FEATURE_VERSION = 2
FEATURE_NAMES = (
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_mobile",
    "is_desktop",
    "is_tablet",
    "keyword_overlap",
    "keyword_overlap_ratio",
    "n_ad_keywords",
    "n_page_keywords",
    "target_cpm",
    "ad_ctr_prior",
    "placement_ctr_prior",
    "pair_ctr_prior",
    "pair_impressions_log",
    "ad_age_days",
    "budget_pacing",
)
N_FEATURES = len(FEATURE_NAMES)

# Attribution and labelling.
ATTRIBUTION_WINDOW_HOURS = 1
LABEL_CUTOFF_HOURS = 2
TARGET_NEGATIVES_PER_POSITIVE = 20.0
TRAINING_DAYS = 30

# Priors.
DEFAULT_GLOBAL_CTR = 0.010
PRIOR_STRENGTH = 200.0
MIN_GLOBAL_IMPRESSIONS = 1000  # global CTR used only when impressions > this
STATS_LOOKBACK_DAYS = 30

# Serving-side CTR clip and baseline keyword boost.
MIN_CTR = 0.0001
MAX_CTR = 0.25
KEYWORD_BOOST_PER_MATCH = 0.15
KEYWORD_BOOST_CAP = 0.6

# Gate baseline clip (training side).
GATE_BASELINE_MIN = 1e-6
GATE_BASELINE_MAX = 0.5

# Auction.
EXPLORATION_EPSILON = 0.08
PRICE_TICK_CPM = 0.01
MIN_WINNER_CTR = 1e-9
DEVICES = ("mobile", "desktop", "tablet")
DEVICE_ALL = "all"

# Downsampling correction clip and metric clip.
CORRECTION_CLIP = 1e-9
METRIC_CLIP = 1e-7

# IPS weighting clip.
IPS_MIN_PROPENSITY = 0.01

# Promotion gates.
GATE_CALIBRATION_LOW = 0.85
GATE_CALIBRATION_HIGH = 1.15
GATE_MIN_AUC = 0.55
CALIBRATOR_MIN_POSITIVES = 30

# Budget / spend.
SPEND_DRIFT_TOLERANCE = 0.001
BUDGET_KEY_TTL_SECONDS = 60 * 60 * 48

# Retention.
IMPRESSION_RETENTION_DAYS = 90

# Click signing.
CLICK_URL_TTL_SECONDS = 60 * 60 * 24
CLICK_MAX_FUTURE_SLACK_SECONDS = 300
SIGNATURE_BYTES = 16
DEFAULT_PUBLIC_BASE_URL = "http://localhost:8000"
CLICK_MACRO = "{{CLICK_URL}}"
API_KEY_PREFIX_LEN = 16

# Request validation limits.
REQUEST_ID_MAX = 64
USER_ID_MAX = 128
URL_MAX = 2048
VIEWPORT_MAX = 10000
CLIENT_CLOCK_SKEW_MS = 60_000
CONVERSION_TYPE_MAX = 64

# Campaign / ad validation limits.
CAMPAIGN_NAME_MAX = 200
BUDGET_MAX = 1_000_000
CPM_MAX = 1000
MAX_KEYWORDS = 100
CREATIVE_MAX = 20_000
STATUSES = ("active", "paused", "archived")
PUBLISHER_ID_PATTERN = r"^[a-z0-9_]+$"
DEVICE_TARGET_PATTERN = r"^(all|mobile|desktop|tablet)$"
PAGE_KEYWORDS_MAX = 10
