"""Column-expression building blocks.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F1 -- keyword normalisation: trim, lower, drop empty, distinct, sort.
def normalize_keywords(kws) -> Column:
    arr = F.coalesce(_c(kws), F.array().cast("array<string>"))
    cleaned = F.filter(F.transform(arr, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_sort(F.array_distinct(cleaned))


def ad_keyword_set(kws) -> Column:
    """Ad keywords are only lower-cased (not trimmed), then used as a set."""
    arr = F.coalesce(_c(kws), F.array().cast("array<string>"))
    return F.array_distinct(F.transform(arr, lambda x: F.lower(x)))


# F2 -- keyword overlap count and ratio (0 when the ad has no keywords).
def keyword_overlap(ad_set, page_kws) -> Column:
    return F.size(F.array_intersect(_c(ad_set), F.coalesce(_c(page_kws), F.array().cast("array<string>"))))


def keyword_overlap_ratio(overlap, ad_set) -> Column:
    n = F.size(_c(ad_set))
    return F.when(n > 0, _c(overlap).cast("double") / n).otherwise(F.lit(0.0))


# F3 -- hour, weekday (0 = Monday), weekend flag.
def hour_of_day(ts) -> Column:
    return F.hour(_c(ts)).cast("double")


def day_of_week(ts) -> Column:
    return F.weekday(_c(ts)).cast("double")


def is_weekend(dow) -> Column:
    return F.when(_c(dow) >= 5, 1.0).otherwise(0.0)


# F4 -- device one-hot.
def one_hot(device, value: str) -> Column:
    return F.when(_c(device) == value, 1.0).otherwise(0.0)


def normalize_device(device) -> Column:
    return F.lower(F.trim(F.coalesce(_c(device), F.lit(""))))


# F5 -- beta smoothing; missing counts fall back to the global rate.
def smoothed_ctr(impressions, clicks, global_ctr, strength: float = K.PRIOR_STRENGTH) -> Column:
    g = _c(global_ctr)
    alpha = g * F.lit(strength)
    beta = (F.lit(1.0) - g) * F.lit(strength)
    value = (_c(clicks) + alpha) / (_c(impressions) + alpha + beta)
    return F.when(_c(impressions).isNull(), g).otherwise(value)


# F6 -- log1p of pair impressions (0 when unseen).
def log_impressions(impressions) -> Column:
    return F.log1p(F.coalesce(_c(impressions), F.lit(0)).cast("double"))


# F7 -- ad age in fractional days, floored at 0, null created_at -> 0.
def ad_age_days(request_ts, created_at) -> Column:
    micros = (F.unix_micros(_c(request_ts).cast("timestamp"))
              - F.unix_micros(_c(created_at).cast("timestamp")))
    age = F.greatest(F.lit(0.0), micros / 86400000000.0)
    return F.when(_c(created_at).isNull(), F.lit(0.0)).otherwise(age)


# F8 -- budget pacing, 0 when the budget is not positive.
def budget_pacing(spent, budget) -> Column:
    b = F.coalesce(_c(budget), F.lit(0.0))
    s = F.coalesce(_c(spent), F.lit(0.0))
    return F.when(b > 0, s / b).otherwise(F.lit(0.0))


# F9 -- feature vector assembly in the fixed order, and its inverse.
def assemble_features(cols: dict) -> Column:
    missing = [n for n in K.FEATURE_NAMES if n not in cols]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return F.array(*[_c(cols[n]).cast("double") for n in K.FEATURE_NAMES]).cast("array<float>")


def features_to_columns(vec) -> list[Column]:
    return [F.element_at(_c(vec), i + 1).alias(n) for i, n in enumerate(K.FEATURE_NAMES)]


# F10 -- undo negative downsampling; identity when keep_rate >= 1.
def undo_downsampling(p, keep_rate) -> Column:
    k = _c(keep_rate) if not isinstance(keep_rate, (int, float)) else F.lit(float(keep_rate))
    q = F.least(F.greatest(_c(p), F.lit(K.CORRECTION_CLIP)), F.lit(1 - K.CORRECTION_CLIP))
    return F.when(k >= 1.0, _c(p)).otherwise((k * q) / (k * q + F.lit(1.0) - q))


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


# F11 -- serving baseline CTR: pair prior x keyword boost, clipped.
def baseline_ctr(pair_prior, overlap) -> Column:
    boost = F.lit(1.0) + F.least(F.lit(K.KEYWORD_BOOST_CAP), F.lit(K.KEYWORD_BOOST_PER_MATCH) * _c(overlap))
    return clip(_c(pair_prior) * boost, K.MIN_CTR, K.MAX_CTR)


# F12 -- gate baseline from the logged vector (pair_ctr_prior position).
def gate_baseline(features) -> Column:
    idx = K.FEATURE_NAMES.index("pair_ctr_prior") + 1
    return clip(F.element_at(_c(features), idx).cast("double"), K.GATE_BASELINE_MIN, K.GATE_BASELINE_MAX)


# F13 -- bid value.
def bid_value(ctr, cpm) -> Column:
    return F.round(_c(ctr) * _c(cpm), 6)


# F14 -- second-price clearing CPM (order of operations matters).
def clearing_cpm(winner_ctr, runner_up_bid, floor_price, target_cpm) -> Column:
    ctr = F.greatest(_c(winner_ctr), F.lit(K.MIN_WINNER_CTR))
    price = _c(runner_up_bid) / ctr + F.lit(K.PRICE_TICK_CPM)
    price = F.round(F.greatest(price, _c(floor_price)), 6)
    return F.least(price, _c(target_cpm))


# F15 -- cost of one impression.
def cost_usd(cpm) -> Column:
    return _c(cpm) / 1000.0


# F16 -- serve propensity.
def serve_propensity(n, explored, epsilon: float = K.EXPLORATION_EPSILON) -> Column:
    eps = F.lit(float(epsilon))
    return (F.when(_c(n) <= 1, F.lit(1.0))
            .when(_c(explored), eps / _c(n))
            .otherwise((F.lit(1.0) - eps) + eps / _c(n)))


# F17 -- IPS weight before normalisation (normalise by the mean separately).
def ips_weight(propensity) -> Column:
    return F.lit(1.0) / clip(_c(propensity).cast("double"), K.IPS_MIN_PROPENSITY, 1.0)


# F18 -- JSON list decode.
def json_string_list(col) -> Column:
    return F.from_json(_c(col), "array<string>")


# F19 -- timestamps.
def parse_ts(col) -> Column:
    return F.try_to_timestamp(_c(col))


def millis_to_ts(col) -> Column:
    return F.timestamp_millis(_c(col).cast("bigint"))


# F20 -- UUID validation.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def is_uuid(col) -> Column:
    return F.coalesce(_c(col).rlike(UUID_PATTERN), F.lit(False))


# F21 -- UTC day bucket.
def utc_day(ts) -> Column:
    return F.to_date(_c(ts))


# F24 -- click URL out of ad markup.
def extract_click_url(markup) -> Column:
    return F.regexp_extract(_c(markup), r'href="([^"]+)"', 1)


# F26 -- strip credentials from a connection URL.
def redact_url(url) -> Column:
    u = _c(url)
    pos = F.locate("://", u)
    scheme = F.when(pos > 0, F.substring_index(u, "://", 1)).otherwise(u)
    rest = F.when(pos > 0, u.substr(pos + F.lit(3), F.lit(1 << 30))).otherwise(F.lit(""))
    return F.when(~u.contains("@"), u).otherwise(
        F.concat(scheme, F.lit("://***@"), _after_first_at(rest)))


def _after_first_at(rest: Column) -> Column:
    at = F.locate("@", rest)
    return F.when(at > 0, rest.substr(at + F.lit(1), F.lit(1 << 30))).otherwise(F.lit(""))


# F27 -- device class from a user agent: tablet is tested before mobile.
TABLET_UA = r"(?i)iPad|Android(?!.*Mobile)|Tablet"
MOBILE_UA = r"(?i)Mobi|Android|iPhone"


def device_class(ua) -> Column:
    u = F.coalesce(_c(ua), F.lit(""))
    return F.when(u.rlike(TABLET_UA), "tablet").when(u.rlike(MOBILE_UA), "mobile").otherwise("desktop")


# F28 -- page keywords from the <meta name="keywords"> tag: first 10.
META_KEYWORDS = r'(?is)<meta[^>]*name="keywords"[^>]*content="([^"]*)"'


def page_keywords(html, most: int = K.PAGE_KEYWORDS_MAX) -> Column:
    """The first ``most`` keywords of the page's meta tag, as the ad tag sends them."""
    content = F.regexp_extract(F.coalesce(_c(html), F.lit("")), META_KEYWORDS, 1)
    parts = F.filter(F.transform(F.split(content, ","), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.slice(parts, 1, most))


# F29 -- CTR with zero guard, rounded to 6 places.
def safe_ctr(clicks, impressions) -> Column:
    return F.when(_c(impressions) > 0, F.round(_c(clicks) / _c(impressions), 6)).otherwise(F.lit(0.0))


# F30 -- prediction clip.
def clip_prediction(p) -> Column:
    return clip(p, K.MIN_CTR, K.MAX_CTR)
