"""Whole jobs: items to drafts, drafts to a feed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import hex_bits, member_digest
from tidemark.operators import consolidate, curate, feed, novelty, score, strategies
from tidemark.operators.aggregates import home_places
from tidemark.operators.away import trip_runs
from tidemark.operators.scans import eligible
from tidemark.plans.trips import trip_days
from tidemark.sources.scratch import Scratch

@dataclass
class Context:
    """What strategies may ask for besides items."""

    owner: list[str]
    home: DataFrame
    scratch: Scratch
    as_of: str


#: A strategy turns items into drafts.
Strategy = Callable[[DataFrame, Context], DataFrame]


def _plain(f: Callable[[DataFrame, list[str]], DataFrame]) -> Strategy:
    return lambda items, c: f(items, c.owner)


_WEEKDAYS, _WEEKEND = (1, 2, 3, 4, 5), (6, 7)
#: All strategies, in the order of their priority.
STRATEGIES: dict[str, Strategy] = {
    "vacation": lambda r, c: strategies.vacations(r, c.owner, trip_runs(trip_days(r, c.owner, c.home, c.scratch), c.owner)),
    "weekend_getaways_over_years": lambda r, c: strategies.weekend_getaways(r, c.owner, c.home),
    "transit_travel_day": _plain(strategies.transit_days),
    "first_visit_place": _plain(strategies.first_visits),
    "significant_place": _plain(strategies.significant_places),
    "year_in_review": lambda r, c: strategies.per_year(r, c.owner, 110, 4),
    "monthly_highlights": _plain(strategies.monthly_highlights),
    "this_month_over_years": lambda r, c: strategies.this_month(r, c.owner, c.as_of),
    "on_this_day_over_years": lambda r, c: strategies.on_this_day(r, c.owner, c.as_of),
    "one_year_ago": lambda r, c: strategies.one_year_ago(r, c.owner, c.as_of),
    "people_cohort": lambda r, c: strategies.cohorts(r),
    "anniversary": lambda r, c: _digested(r, c.owner, strategies.anniversaries(r, c.owner)),
    "holiday_event": _plain(strategies.holidays),
    "new_year_eve": _plain(strategies.new_years_eve),
    "nightlife_event": _plain(strategies.nightlife),
    "season_over_years": _plain(strategies.seasons_over_years),
    "season": _plain(strategies.seasons),
    "golden_hour": _plain(strategies.golden_hours),
    "day_album": _plain(strategies.day_albums),
    "at_home_weekend": lambda r, c: strategies.at_home(r, c.owner, c.home, _WEEKEND, 0.62, 3, 6, algorithm="at_home_weekend"),
    "at_home_weekday": lambda r, c: strategies.at_home(r, c.owner, c.home, _WEEKDAYS, 0.60, 3, 5, algorithm="at_home_weekday"),
    "location_similarity": lambda r, c: strategies.similar_places(r, c.owner, c.scratch),
    "cross_dimension": _plain(strategies.cross_dimension),
    "time_similarity": lambda r, c: strategies.similar_times(r, c.owner, c.scratch),
    "panorama": _plain(strategies.panoramas),
    "panorama_over_years": _plain(strategies.panoramas_over_years),
    "portrait_orientation": _plain(strategies.portraits),
    "video_stories": _plain(strategies.video_stories),
    "device_similarity": _plain(strategies.device_groups),
    "phash_similarity": lambda r, c: strategies.phash_groups(r, c.scratch),
    "burst": _plain(strategies.bursts),
}
#: Priority of the drafts of each strategy, the first the highest.
PRIORITY = {name: len(STRATEGIES) - k for k, name in enumerate(STRATEGIES)}


def _digested(items: DataFrame, owner: list[str], made: DataFrame) -> DataFrame:
    """Anniversaries as drafts."""
    rows = items.withColumn("month_day", F.date_format("day", "MM-dd")).join(made.select(*owner, "month_day"), [*owner, "month_day"], "left_semi")
    return rows.groupBy(*owner, "month_day").agg(F.count("*").alias("n"), F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), member_digest(F.col("item_id")).alias("digest")).withColumn("algorithm", F.lit("anniversary"))


@dataclass(frozen=True)
class Options:
    owner: list[str] = field(default_factory=lambda: ["user_id"])
    since: str | None = None
    until: str | None = None
    types: tuple[str, ...] = ()
    as_of: int = 0
    least: int = 2
    min_score: float = 0.25


def register(name: str, strategy: Strategy) -> None:
    """Adds a strategy of the caller's own."""
    STRATEGIES[name] = strategy


def home_of(items: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, home_lat, home_lon) as inferred from the items."""
    return home_places(items, owner).select(*owner, "home_lat", "home_lon")


def strategy_drafts(items: DataFrame, options: Options, scratch: Scratch, home: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drafts of all strategies that are asked for, unscored, and their members (draft_id, item_id, position by time), both stored. draft_id is strategy, digest and start hashed."""
    rows = eligible(items)
    if options.since:
        rows = rows.where(F.col("ts") >= F.lit(options.since).cast("timestamp"))
    if options.until:
        rows = rows.where(F.col("ts") <= F.lit(options.until).cast("timestamp"))
    day = datetime.fromtimestamp(options.as_of, UTC).date().isoformat()
    context = Context(list(options.owner), home if home is not None else scratch.table(home_of(rows, options.owner), "home"), scratch, day)
    names = options.types or tuple(STRATEGIES)
    if unknown := set(names) - set(STRATEGIES):
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    made, members = [], []
    for name in names:
        drafts, inside = strategies.with_members(lambda name=name: STRATEGIES[name](rows, context))
        for c in options.owner:
            if c not in drafts.columns:
                drafts = drafts.withColumn(c, F.lit(None).cast(items.schema[c].dataType))
        lacks = [c for c in ("lat", "lon") if c not in drafts.columns]
        made.append(drafts.withColumns({c: F.lit(None).cast("double") for c in lacks}).select(*options.owner, "algorithm", "n", "t_from", "t_to", "lat", "lon", "digest"))
        members.append(inside)
    key = F.xxhash64("algorithm", "digest", "t_from", "n")
    drafts = scratch.table(strategies.union(*made).withColumn("draft_id", key), "drafts")
    rows = strategies.union(*members).withColumn("draft_id", key).join(drafts.select("draft_id").distinct(), "draft_id", "left_semi")
    position = F.row_number().over(Window.partitionBy("draft_id").orderBy("t", "item_id")).cast("bigint")
    return drafts, scratch.table(rows.select("draft_id", "item_id", "t").distinct().withColumn("position", position).select("draft_id", "item_id", "position"), "members")


def scored(drafts: DataFrame, members: DataFrame, items: DataFrame, scratch: Scratch, as_of: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Drafts with all parts of the score, their weighted sum (raw), and score, the sum normalised within each algorithm; priority by strategy."""
    detail = ["item_id", "t", "lat", "lon", "quality", "persons", "is_video", "tag", "device", "phash"]
    rows = scratch.table(members.join(items.select(*detail), "item_id"), "scored_members")
    parts = score.draft_parts(rows, ["draft_id"], as_of)
    new = novelty.novelty(rows.withColumn("stay", F.lit(None).cast("string")), items, ["draft_id"]).select("draft_id", "novelty")
    place = rows.groupBy("draft_id").agg(F.max("tag").alias("label"))
    parts = parts.join(new, "draft_id").join(place, "draft_id").withColumns({"poi": score.poi(F.col("label"), F.lit(None), F.lit(None), F.lit(None)), "aesthetics": F.col("quality")})
    names = [c for c in score.WEIGHTS if c in parts.columns]
    total = score.weighted({c: F.col(c) for c in names}, weights)
    out = drafts.join(parts.select("draft_id", *names, total.alias("raw")), "draft_id")
    out = score.normalise(out, score="raw").withColumnRenamed("normalised", "score")
    order = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return scratch.table(out.withColumn("priority", F.coalesce(order[F.col("algorithm")], F.lit(0))), "scored")


def cluster(items: DataFrame, options: Options, scratch: Scratch, home: DataFrame | None = None) -> consolidate.State:
    """Scored drafts of all strategies that are asked for, and their members."""
    drafts, members = strategy_drafts(items, options, scratch, home)
    return consolidate.State(scored(drafts.dropDuplicates(["draft_id"]), members, items, scratch, options.as_of), members, scratch)


def consolidated(state: consolidate.State, settings: dict | None = None, only: tuple[str, ...] = (), watch: Callable[[str, int], None] | None = None) -> consolidate.State:
    """The state after the consolidation's stages, all or those named, in their order."""
    stages = consolidate.default_stages(settings)
    return consolidate.run_stages(state, {k: v for k, v in stages.items() if not only or k in only}, watch)


def curated(items: DataFrame, policies: dict[str, curate.Policy] | None = None) -> consolidate.Stage:
    """A stage that chooses the members of the drafts, each algorithm's by its policy (those without one keep all): candidates are scored, of each burst the best is taken, and the rules of the policy choose."""
    policies = policies or {"vacation": curate.policy("trip")}
    detail = items.select("item_id", "t", F.col("day").cast("string").alias("day"), "lat", "lon", hex_bits(F.col("phash")).alias("hash"), "quality", "is_video", "persons", "burst_uuid", "no_show", "low_quality", (F.col("height") > F.col("width")).alias("upright"), F.when(F.col("is_video"), "video").otherwise(F.col("device")).alias("scene"))

    def stage(state: consolidate.State) -> consolidate.State:
        algorithms = state.drafts.select("draft_id", "algorithm")
        kept = state.members.join(algorithms.where(~F.col("algorithm").isin(*policies)), "draft_id", "left_semi").select("draft_id", "item_id", "position")
        for name, policy in policies.items():
            mine = state.members.join(algorithms.where(F.col("algorithm") == name), "draft_id", "left_semi").select("draft_id", "item_id", "position").join(detail, "item_id")
            faces = F.size(F.coalesce("persons", F.array().cast("array<string>")))
            scored = curate.candidate_scores(mine.withColumns({"faces": faces, "largest_face": F.lit(0.0), "is_selfie": F.lit(False)}), video=0.05, face=0.05, cohort=0.01)
            best = curate.collapse_bursts(scored.withColumn("score", F.col("candidate_score")), ["draft_id"])
            kept = kept.unionByName(curate.curate(best, policy).withColumn("position", F.col("position").cast("bigint")))
        members = state.scratch.table(kept, "curated")
        sizes = members.groupBy("draft_id").agg(F.count("*").alias("__n"))
        drafts = state.drafts.join(sizes, "draft_id", "left").withColumn("n", F.coalesce("__n", F.lit(0)).cast("bigint")).select(*state.drafts.columns)
        return consolidate.State(state.scratch.table(drafts.where("n > 0"), "curated_drafts"), members, state.scratch)

    return stage


def make_feed(drafts: DataFrame, as_of: int, profile: feed.Profile | None = None) -> DataFrame:
    """The ranked feed of the drafts, under the profile's caps."""
    profile = profile or feed.Profile()
    lacks = {c: F.lit(None).cast(t) for c, t in (("quality", "double"), ("mentions", "int"), ("coverage", "double"), ("place", "string")) if c not in drafts.columns}
    rows = drafts.withColumns({**lacks, "day": F.to_date(F.timestamp_seconds("t_from"))})
    return feed.build(feed.eligible(rows, as_of, profile), profile)
