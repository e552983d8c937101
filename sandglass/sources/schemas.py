"""Schemas of inputs and logs; names are fixed values. Ids are longs, dates timestamps in UTC, missing values NULL."""

from __future__ import annotations

CHART_IDS = "pulled_at_utc string, url string, genre_id int, storefront string, result_ids array<bigint>"
FRAME_COLUMNS = (
    "rank", "collection_id", "show_name", "publisher", "feed_url", "primary_genre", "genres", "apple_category", "apple_subcategory",
    "track_count", "country", "release_date", "apple_url", "artwork_url", "lookup_found",
)
FRAME = ", ".join(f"{c} string" for c in FRAME_COLUMNS)
EPISODES = (
    "collection_id bigint, show_name string, episode_title string, episode_description string, pub_date timestamp, audio_url string, "
    "audio_bytes bigint, duration_sec double, duration_source string"
)
ITEM = "struct<title:string, description:string, pubDate:string, duration:string, enclosure:struct<_url:string, _length:string>>"
FEED = f"channel struct<description:string, language:string, author:string, owner:struct<name:string>, item:array<{ITEM}>>"
TRANSCRIPT = (
    "episode_id string, show_id string, episode_title string, engine string, model string, language string, duration double, audio_sha256 string, "
    "segments array<struct<start:double, end:double, text:string>>"
)
STATUS = "episode_id string, show_id string, engine string, model string, language string, n_segments int, n_words int, realtime_factor double, wall_seconds double"
FAILURES = "show_id string, episode_id string, audio_url string, episode_title string, reason string"
CORPUS = (
    "rank int, collection_id string, show_name string, publisher string, feed_url string, primary_genre string, genres string, apple_category string, "
    "apple_subcategory string, track_count int, country string, release_date string, apple_url string, artwork_url string, lookup_found boolean, "
    "rss_description string, rss_language string, rss_author string, rss_owner_name string, episode_count long, episodes_with_audio long, "
    "hours_available double, hours_estimated_share double, avg_episode_minutes double, episodes_per_week double, first_pub_date timestamp, last_pub_date timestamp"
)
