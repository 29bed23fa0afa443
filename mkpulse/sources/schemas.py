"""Declared schemas of the landed platform reports (JSON lines).

Landed files are read with these schemas - never inferred - so a renamed or
reordered field can not load silently wrong, and the reader prunes the
nested fields a projection does not use.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# search ads (nested report rows)
SEARCH_ADS_RAW = _st(
    ("customer", _st(("id", L), ("descriptive_name", S))),
    ("campaign", _st(("id", L), ("name", S), ("status", S), ("advertising_channel_type", S))),
    ("ad_group", _st(("id", L), ("name", S), ("status", S), ("type", S))),
    ("ad_group_ad", _st(("status", S), ("ad", _st(("id", L), ("type", S))))),
    ("ad_group_criterion", _st(("criterion_id", L), ("status", S), ("keyword", _st(("text", S), ("match_type", S))))),
    ("segments", _st(("date", S), ("device", S), ("ad_network_type", S), ("click_type", S), ("conversion_action", S),
                     ("conversion_action_name", S), ("hour", I), ("day_of_week", S))),
    ("geographic_view", _st(("country_criterion_id", L), ("location_type", S))),
    ("metrics", _st(("impressions", L), ("clicks", L), ("cost_micros", L), ("ctr", D), ("average_cpc", D),
                    ("average_cpm", D), ("conversions", D), ("conversions_value", D), ("all_conversions", D),
                    ("all_conversions_value", D), ("view_through_conversions", L), ("interactions", L),
                    ("interaction_rate", D), ("engagement_rate", D), ("search_impression_share", D),
                    ("top_impression_percentage", D), ("absolute_top_impression_percentage", D))),
)

# search console: positional keys
SEARCH_CONSOLE_RAW = _st(("keys", T.ArrayType(S)), ("clicks", L), ("impressions", L), ("ctr", D), ("position", D))

# web analytics: positional dimension / metric values
_VAL = T.ArrayType(_st(("value", S)))
WEB_REPORT_RAW = _st(("dimension_values", _VAL), ("metric_values", _VAL))

# social ads insights
_ACTIONS = T.ArrayType(_st(("action_type", S), ("value", S)))
SOCIAL_INSIGHTS_RAW = _st(
    ("date_start", S), ("date_stop", S), ("account_id", S), ("campaign_id", S), ("campaign_name", S),
    ("adset_id", S), ("adset_name", S), ("ad_id", S), ("ad_name", S),
    ("impressions", S), ("reach", S), ("clicks", S), ("unique_clicks", S), ("spend", S), ("ctr", S), ("cpc", S),
    ("cpm", S), ("frequency", S), ("cost_per_unique_click", S),
    ("actions", _ACTIONS), ("action_values", _ACTIONS),
    ("video_p25_watched_actions", _ACTIONS), ("video_p50_watched_actions", _ACTIONS),
    ("video_p75_watched_actions", _ACTIONS), ("video_p100_watched_actions", _ACTIONS),
    ("country", S), ("device_platform", S), ("publisher_platform", S), ("age", S), ("gender", S),
)

SOCIAL_ADSET_RAW = _st(
    ("id", S), ("name", S), ("campaign_id", S), ("status", S), ("effective_status", S), ("optimization_goal", S),
    ("billing_event", S), ("bid_strategy", S), ("daily_budget", S), ("lifetime_budget", S), ("budget_remaining", S),
    ("targeting", _st(("geo_locations", _st(("countries", T.ArrayType(S)))))),
    ("created_time", S), ("start_time", S), ("end_time", S),
)

SOCIAL_CAMPAIGN_RAW = _st(
    ("id", S), ("name", S), ("status", S), ("effective_status", S), ("objective", S), ("daily_budget", S),
    ("lifetime_budget", S), ("budget_remaining", S), ("created_time", S), ("start_time", S), ("stop_time", S),
)

SOCIAL_AD_RAW = _st(
    ("id", S), ("name", S), ("adset_id", S), ("campaign_id", S), ("status", S), ("effective_status", S),
    ("creative", _st(("id", S))), ("created_time", S),
)

POST_RAW = _st(
    ("id", L), ("text", S), ("lang", S), ("source", S), ("created_at", TS), ("conversation_id", L),
    ("in_reply_to_user_id", L), ("referenced_tweets", T.ArrayType(_st(("type", S), ("id", L)))),
    ("public_metrics", _st(("impression_count", L), ("like_count", L), ("retweet_count", L), ("reply_count", L),
                           ("quote_count", L), ("bookmark_count", L))),
)

PROFILE_RAW = _st(
    ("id", S), ("username", S), ("name", S), ("description", S), ("location", S), ("verified", B),
    ("verified_type", S), ("created_at", S), ("profile_image_url", S),
    ("public_metrics", _st(("followers_count", L), ("following_count", L), ("tweet_count", L), ("listed_count", L))),
)
