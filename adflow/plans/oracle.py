"""DuckDB oracle SQL: fixture CTEs mirroring ``adflow.sources.fixtures``.

The driver pre-registers the raw tables as views; each oracle statement
re-derives the domain views it needs as CTEs, then runs plain ANSI SQL.
"""

from __future__ import annotations

FIXTURE_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "n_campaigns": ((), "SELECT count(*) AS c FROM supplier"),
    "n_ads": ((), "SELECT count(*) AS c FROM part"),
    "part_words": ((), "SELECT p_partkey, string_split(p_name, ' ') AS words FROM part"),
    "advertisers_v": ((), """
        SELECT n_nationkey AS advertiser_id, n_name AS name,
               'ads@' || lower(n_name) || '.example' AS contact_email,
               n_nationkey <> 24 AS active
        FROM nation"""),
    "campaigns_v": (("part_words", "n_ads"), """
        SELECT s.s_suppkey AS campaign_id, s.s_nationkey AS advertiser_id,
               'campaign ' || CAST(s.s_suppkey AS VARCHAR) AS name,
               CAST(0.01 AS DOUBLE) * (1 + s.s_suppkey % 5) AS daily_budget_usd,
               CAST(s.ct AS DOUBLE) / CAST(100.0 AS DOUBLE) AS target_cpm,
               floor(s.ct * 3 / 10) / CAST(100.0 AS DOUBLE) AS floor_price,
               CASE s.s_suppkey % 6 WHEN 3 THEN 'mobile' WHEN 4 THEN 'desktop'
                    WHEN 5 THEN 'tablet' ELSE 'all' END AS target_device,
               w.words AS target_keywords,
               CASE WHEN s.s_suppkey % 4 = 1 THEN DATE '2024-01-08' END AS start_date,
               CASE WHEN s.s_suppkey % 5 = 2 THEN DATE '2024-01-22' END AS end_date,
               CASE WHEN s.s_suppkey % 10 = 9 THEN 'paused' ELSE 'active' END AS status,
               TIMESTAMP '2023-12-01 00:00:00' + to_minutes(CAST(s.s_suppkey % 1440 AS BIGINT)) AS created_at
        FROM (SELECT *, 200 + CAST(round(abs(s_acctbal) * 100) AS BIGINT) % 1200 AS ct FROM supplier) s
        LEFT JOIN part_words w ON w.p_partkey = s.s_suppkey % (SELECT c FROM n_ads)"""),
    "ads_v": (("n_campaigns",), """
        SELECT p_partkey AS ad_id, p_partkey % (SELECT c FROM n_campaigns) AS campaign_id,
               p_name AS name,
               '<div class="ad"><a href="{{CLICK_URL}}">' || p_name || '</a></div>' AS creative_html,
               'https://shop' || CAST(p_partkey % 7 AS VARCHAR) || '.example/p/' || CAST(p_partkey AS VARCHAR)
                   AS destination_url,
               CASE WHEN p_partkey % 13 = 12 THEN 'paused' ELSE 'active' END AS status,
               CAST(DATE '2024-01-01' - CAST(p_partkey % 90 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM part"""),
    "impressions_v": (("n_campaigns", "n_ads"), """
        SELECT e.event_id AS impression_id, e.ts,
               'pub_' || CAST(e.user_id % 3 AS VARCHAR) AS publisher_id,
               'plc_' || CAST(e.user_id % 6 + 1 AS VARCHAR) AS placement_id,
               (e.event_id * 7 + e.user_id) % (SELECT c FROM n_ads) AS ad_id,
               ((e.event_id * 7 + e.user_id) % (SELECT c FROM n_ads)) % (SELECT c FROM n_campaigns) AS campaign_id,
               e.user_id,
               CASE WHEN e.event_id % 6 < 3 THEN 'mobile' WHEN e.event_id % 6 < 5 THEN 'desktop'
                    ELSE 'tablet' END AS device_type,
               1 + e.value % 9 AS win_price,
               e.event_id % 13 = 0 AS is_exploration,
               CASE WHEN e.event_id % 13 = 0 THEN CAST(0.08 AS DOUBLE) / (2 + e.event_id % 5)
                    ELSE CAST(0.92 AS DOUBLE) + CAST(0.08 AS DOUBLE) / (2 + e.event_id % 5) END
                   AS serve_propensity,
               CASE WHEN e.user_id % 4 = 0 THEN 'baseline' ELSE 'v20240101_000000' END AS model_version,
               s.s_nationkey AS advertiser_id
        FROM events e
        LEFT JOIN supplier s
          ON s.s_suppkey = ((e.event_id * 7 + e.user_id) % (SELECT c FROM n_ads)) % (SELECT c FROM n_campaigns)
        WHERE e.event_type <> 'click'"""),
    "raw_clicks_v": ((), """
        SELECT event_id - 1 - (event_id * 7919) % 20 AS impression_id, ts, event_id AS click_event_id
        FROM events WHERE event_type = 'click'"""),
    "clicks_v": (("raw_clicks_v", "impressions_v"), """
        SELECT r.impression_id, r.ts, r.click_event_id, i.ad_id, i.placement_id, i.publisher_id
        FROM raw_clicks_v r JOIN impressions_v i ON i.impression_id = r.impression_id"""),
    "conversions_v": ((), """
        SELECT event_id - 1 - event_id % 7 AS impression_id, user_id, 'purchase' AS conversion_type,
               value AS conversion_value, ts, event_id AS conversion_event_id
        FROM events WHERE event_type = 'purchase'"""),
    "requests_v": (("part_words", "n_ads"), """
        SELECT e.event_id AS request_id,
               'pub_' || CAST(e.user_id % 3 AS VARCHAR) AS publisher_id,
               'plc_' || CAST(e.user_id % 6 + 1 AS VARCHAR) AS placement_id,
               'https://site' || CAST(e.user_id % 3 AS VARCHAR) || '.example/a/' || CAST(e.event_id AS VARCHAR)
                   AS page_url,
               CAST(e.user_id AS VARCHAR) AS user_id,
               CASE WHEN e.event_id % 6 < 3 THEN 'mobile' WHEN e.event_id % 6 < 5 THEN 'desktop'
                    ELSE 'tablet' END AS device_type,
               CAST(320 + (e.event_id % 8) * 240 AS INTEGER) AS viewport_width,
               epoch_us(e.ts) // 1000 AS timestamp_ms,
               e.ts AS server_ts,
               w.words AS page_keywords,
               (e.event_id * 7 + e.user_id) % (SELECT c FROM n_ads) AS served_ad_id
        FROM events e
        LEFT JOIN part_words w ON w.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
        WHERE e.event_type <> 'click'"""),
}


def register(name: str, deps: tuple[str, ...], body: str) -> None:
    FIXTURE_CTES[name] = (deps, body)


def _resolve(names, out: list[str]) -> None:
    for n in names:
        if n in out:
            continue
        deps, _ = FIXTURE_CTES[n]
        _resolve(deps, out)
        if n not in out:
            out.append(n)


def with_views(names: tuple[str, ...] | list[str], body: str) -> str:
    order: list[str] = []
    _resolve(list(names), order)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURE_CTES[n][1].strip()})" for n in order)
    return f"WITH {ctes}\n{body.strip()}"
