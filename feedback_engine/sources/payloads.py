"""Landed API payloads and manifests to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions.rules import rating_to_label
from feedback_engine.operators.ranking import keep_first
from feedback_engine.schemas import REVIEW_SOURCE

SEARCH_PAYLOAD = """
    items array<struct<
        id: struct<videoId: string>,
        snippet: struct<title: string, description: string, channelId: string,
                        channelTitle: string, publishedAt: string>>>
"""
THREAD_PAYLOAD = """
    snippet struct<
        videoId: string,
        totalReplyCount: bigint,
        topLevelComment: struct<
            id: string,
            snippet: struct<textOriginal: string, authorDisplayName: string,
                            authorChannelId: struct<value: string>,
                            publishedAt: string, updatedAt: string, likeCount: bigint>>>
"""


def flatten_search_results(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Search pages to video rows; items without a video id are dropped."""
    page = F.from_json(payload, SEARCH_PAYLOAD)
    items = df.withColumn("_page", page).select(
        *[c for c in df.columns if c != payload], F.posexplode_outer("_page.items").alias("item_rank", "_i")
    )
    snippet = "_i.snippet"
    return items.where(F.coalesce("_i.id.videoId", F.lit("")) != "").select(
        F.col("_i.id.videoId").alias("video_id"),
        F.col(f"{snippet}.title").alias("video_title"),
        F.col(f"{snippet}.description").alias("video_description"),
        F.col(f"{snippet}.channelId").alias("channel_id"),
        F.col(f"{snippet}.channelTitle").alias("channel_title"),
        F.col(f"{snippet}.publishedAt").alias("video_published_at"),
        "query",
        *[c for c in items.columns if c in ("query_rank", "item_rank")],
    )


def flatten_comment_threads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Thread payloads to one row per top comment."""
    parsed = df.select(F.from_json(payload, THREAD_PAYLOAD).alias("_t"))
    top = "_t.snippet.topLevelComment"
    return parsed.select(
        F.lit("youtube_comments").alias("source"),
        F.col("_t.snippet.videoId").alias("video_id"),
        F.col(f"{top}.id").alias("comment_id"),
        F.try_to_timestamp(F.col(f"{top}.snippet.publishedAt")).alias("review_date"),
        F.col(f"{top}.snippet.textOriginal").alias("content"),
        F.col(f"{top}.snippet.authorDisplayName").alias("user_name"),
        F.col(f"{top}.snippet.authorChannelId.value").alias("author_channel_id"),
        F.col(f"{top}.snippet.likeCount").alias("like_count"),
        F.col("_t.snippet.totalReplyCount").alias("reply_count"),
        F.col(f"{top}.snippet.updatedAt").alias("comment_updated_at"),
        F.lit(None).cast("string").alias("sentiment"),
    )


VIDEO_ATTRIBUTES = (
    "video_title",
    "video_description",
    "channel_id",
    "channel_title",
    "video_published_at",
    "query",
)


def attach_video_attributes(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Each comment with the metadata of its video (inner equi-join).

    A viral video can hold a large part of the comments; Spark broadcasts the video table when
    its measured size allows and splits skewed partitions (AQE) when it does not.
    """
    return comments.join(videos.select("video_id", *VIDEO_ATTRIBUTES), "video_id", "inner")


def project_reviews(df: DataFrame) -> DataFrame:
    """Review payload to 7 columns; the version is the first filled of two fields."""

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return df.select(
        F.col("reviewId").alias("record_id"),
        F.lit(REVIEW_SOURCE).alias("source"),
        F.to_date("at").alias("published_at"),
        F.col("content").alias("raw_text"),
        F.col("score").alias("rating"),
        F.coalesce(filled("reviewCreatedVersion"), filled("appVersion")).alias("app_version"),
        rating_to_label(F.col("score")).alias("label"),
    )


def manifest_select(df: DataFrame, target_months: Sequence[str]) -> DataFrame:
    """Files to fetch: first download link per item whose title names a target month."""
    links = df.where(F.contains("href", F.lit("/download/")))
    first = keep_first(links, ["item"], [F.col("link_rank")])
    wanted = F.lit(False)
    for month in target_months:
        wanted = wanted | F.contains(F.trim("title"), F.lit(month))
    return first.where(wanted).select(
        "item",
        F.trim("title").alias("title"),
        F.trim("href").alias("url"),
        F.substring_index(F.trim("href"), "/", -1).alias("file_name"),
    )
