"""Whole jobs over the events."""

from pyspark.sql import functions as F

from tidemark.catalog.base import items, query
from tidemark.operators.feed import Profile
from tidemark.plans.jobs import Options, cluster, consolidated, make_feed
from tidemark.sources.scratch import Scratch


@query()
def cluster_and_feed(spark, d):
    options = Options(types=("day_album", "video_stories", "device_similarity", "burst"), as_of=1706745600)
    made = consolidated(cluster(items(spark, d), options, Scratch(spark, "cluster")))
    return make_feed(made.drafts, options.as_of, Profile(min_members=2, quality_floor=0.0)).select("rank", "draft_id", "algorithm", "n", F.round("score", 6).alias("score"))
