"""Consolidation of drafts: filters, duplicates, nesting, overlaps and caps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.density import components
from tidemark.operators.islands import scan_sorted
from tidemark.sources.scratch import Scratch

#: Numbers of the tables that stages write.
_NUMBERS = count()


def effective_score(drafts: DataFrame) -> DataFrame:
    """The score if it is above 0, else the number of members."""
    return drafts.withColumn("effective", F.when(F.col("score") > 0, F.col("score")).otherwise(F.col("n").cast("double")))


def filter_drafts(drafts: DataFrame, least: int = 2, score: float = 0.25, need_time: bool = False) -> DataFrame:
    out = effective_score(drafts).where((F.col("n") >= least) & (F.col("effective") >= score))
    return out.where("t_from is not null and t_to >= t_from") if need_time else out


def collapse_duplicates(drafts: DataFrame, by: list[str], order: list) -> DataFrame:
    """One draft of each group with equal values: the first in the order; of equals the later draft_id."""
    w = Window.partitionBy(*by).orderBy(*order, F.desc("draft_id"))
    return drafts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def insert_new(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """Drafts whose (algorithm, fingerprint) isn't stored yet, each once, the smallest draft_id; stored ones are never changed."""
    once = collapse_duplicates(drafts.withColumn("__o", F.col("draft_id")), ["algorithm", "fingerprint"], ["__o"]).drop("__o")
    return once.join(stored.select("algorithm", "fingerprint").distinct(), ["algorithm", "fingerprint"], "left_anti")


def nest(pairs: DataFrame, drafts: DataFrame) -> DataFrame:
    """(other_id, preferred_id): of each pair of a draft and one that contains it, the one that is preferred (priority, score, size, id) holds the other as its part; every draft gets its best holder."""
    rank = F.struct((-F.col("priority")).alias("p"), (-F.col("effective")).alias("s"), (-F.col("n")).alias("n"), "draft_id")
    key = effective_score(drafts).select("draft_id", rank.alias("rank"))
    a, b = (key.select(F.col("draft_id").alias(c), F.col("rank").alias(f"{c}_rank")) for c in ("child", "parent"))
    both = pairs.join(a, "child").join(b, "parent")
    first = F.col("child_rank") < F.col("parent_rank")
    both = both.select(F.when(first, F.col("parent")).otherwise(F.col("child")).alias("other_id"), F.when(first, F.col("child")).otherwise(F.col("parent")).alias("preferred_id"), F.least("child_rank", "parent_rank").alias("best"))
    return both.groupBy("other_id").agg(F.min_by("preferred_id", "best").alias("preferred_id"))


def dominant(drafts: DataFrame, conflicts: DataFrame, order: str, scratch: Scratch, rounds: int = 20) -> DataFrame:
    """Drafts that a pass in the order accepts, when a draft conflicting (a, b) with an accepted one is rejected. `order` is a unique rank, the smallest first.

    The pass is sequential by definition but settles in few rounds: a draft is accepted once no undecided draft
    before it conflicts with it, which rejects its conflicts. Every round is a join on the conflicts. What long chains of
    conflicts leave after `rounds` is passed through in order, each component of undecided drafts by a task that holds the ids of those it has rejected.
    """
    rank = drafts.select("draft_id", F.col(order).alias("r"))
    edges = conflicts.join(rank.select(F.col("draft_id").alias("a"), F.col("r").alias("ra")), "a").join(rank.select(F.col("draft_id").alias("b"), F.col("r").alias("rb")), "b")
    left = F.col("ra") < F.col("rb")
    edges = edges.select(F.when(left, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("then"), F.when(left, F.col("rb")).otherwise(F.col("ra")).alias("r")).distinct()
    edges = scratch.table(edges, "edges")
    rejected = None
    for k in range(rounds):
        if not edges.limit(1).count():
            break
        # Accepted in this round: drafts with conflicts behind but none before them.
        winners = edges.select(F.col("first").alias("draft_id")).distinct().join(edges.select(F.col("then").alias("draft_id")), "draft_id", "left_anti")
        losers = scratch.table(edges.join(winners.withColumnRenamed("draft_id", "first"), "first", "left_semi").select(F.col("then").alias("draft_id")).distinct(), f"losers{k}")
        rejected = losers if rejected is None else rejected.unionByName(losers)
        gone = losers.select(F.col("draft_id").alias("then"))
        kept = edges.join(gone, "then", "left_anti").join(gone.withColumnRenamed("then", "first"), "first", "left_anti")
        edges = scratch.table(kept, f"edges{k}")
    else:
        if edges.limit(1).count():
            roots = components(edges.select(F.col("first").alias("a"), F.col("then").alias("b")), scratch, "undecided")
            keyed = edges.join(roots.select(F.col("node").alias("then"), F.col("root").alias("component")), "then")
            losers = scratch.table(scan_sorted(keyed, ["component"], ["r", "then"], _rejections, "draft_id bigint"), "losers")
            rejected = losers if rejected is None else rejected.unionByName(losers)
    return drafts if rejected is None else drafts.join(rejected, "draft_id", "left_anti")


def _rejections(_):
    """Passes through conflicts (first, then) in the order of `then`: it is rejected if a draft before it isn't."""
    rejected: set = set()

    def step(row):
        if row is not None and row["then"] not in rejected and row["first"] not in rejected:
            rejected.add(row["then"])
            yield {"draft_id": row["then"]}

    return step


def overlap_actions(pairs: DataFrame, drafts: DataFrame, same: float = 0.45, any_: float = 0.85, least_iou: float = 0.55) -> DataFrame:
    """(winner, loser, action) of overlapping drafts: same algorithm from the lower, others from the higher similarity; merged if their times overlap enough, else the loser is dropped. Parts of other drafts (sub_story) are left alone."""
    from tidemark.functions.hashing import interval_iou

    d = effective_score(drafts.where(~F.coalesce("sub_story", F.lit(False))))
    side = lambda c: d.select(F.col("draft_id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("algorithm", "effective", "n", "t_from", "t_to", "priority")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    hits = (F.col("jaccard") >= any_) | ((F.col("algorithm_a") == F.col("algorithm_b")) & (F.col("jaccard") >= same))
    left = F.struct("priority_a", "effective_a", "n_a", -F.col("a")) >= F.struct("priority_b", "effective_b", "n_b", -F.col("b"))
    merge = interval_iou(F.col("t_from_a"), F.col("t_to_a"), F.col("t_from_b"), F.col("t_to_b")) >= least_iou
    return both.where(hits).select(F.when(left, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("loser"), F.when(merge, "merge").otherwise("drop").alias("action"))


def linked(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(draft_id, component) of drafts that share members (draft_id, member), directly or by others. Decisions of different components don't touch."""
    first = rows.groupBy("member").agg(F.min("draft_id").alias("b"))
    edges = rows.join(first, "member").where("draft_id != b").select(F.col("draft_id").alias("a"), "b").distinct()
    roots = components(scratch.table(edges, f"{name}_links"), scratch, name)
    return rows.select("draft_id").distinct().join(roots.withColumnRenamed("node", "draft_id"), "draft_id", "left").select("draft_id", F.coalesce("root", "draft_id").alias("component"))


def prune_annotations(drafts: DataFrame, annotate: dict[str, float], scratch: Scratch, rounds: int = 12) -> DataFrame:
    """(draft_id) of the drafts that stay: annotating algorithms need a least share of members that no draft kept so far uses; other drafts always stay and use theirs first. Annotating drafts (draft_id, algorithm, members) are taken in the order of draft_id.

    The order settles in rounds of joins on the members: a draft stays if it has enough members that no undecided draft before it could take
    either, and goes if too many are taken for sure. What long chains leave undecided after `rounds` is passed through in order, each component of such
    drafts with common members by itself, in a task that holds the members it has given away.
    """
    later = F.col("algorithm").isin(*annotate) if annotate else F.lit(False)
    stay = drafts.where(~later).select("draft_id")
    if not annotate:
        return stay
    taken = drafts.where(~later).select(F.explode("members").alias("member")).distinct()
    least = F.create_map(*[x for k, v in annotate.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = drafts.where(later & (F.size("members") > 0)).select("draft_id", least[F.col("algorithm")].alias("least"), F.explode(F.array_distinct("members")).alias("member"))
    open_ = scratch.table(rows.join(taken.withColumn("taken", F.lit(True)), "member", "left").withColumn("taken", F.col("taken").isNotNull()), "annotations")
    kept: list[DataFrame] = []
    for k in range(rounds):
        if not open_.limit(1).count():
            break
        first = open_.groupBy("member").agg(F.min("draft_id").alias("first"))
        state = open_.join(first, "member").groupBy("draft_id", "least").agg(F.avg((~F.col("taken")).cast("double")).alias("most"), F.avg((~F.col("taken") & (F.col("first") == F.col("draft_id"))).cast("double")).alias("sure"))
        settled = scratch.table(state.where((F.col("sure") >= F.col("least")) | (F.col("most") < F.col("least"))).select("draft_id", (F.col("sure") >= F.col("least")).alias("stays")), f"settled{k}")
        won = settled.where("stays").select("draft_id")
        kept.append(won)
        # A draft that stays takes its members from those behind it; one before it has been looked at with this one as undecided.
        news = open_.join(won, "draft_id").groupBy("member").agg(F.min("draft_id").alias("by"))
        rest = open_.join(settled.select("draft_id"), "draft_id", "left_anti").join(news, "member", "left")
        open_ = scratch.table(rest.withColumn("taken", F.col("taken") | F.coalesce(F.col("by") < F.col("draft_id"), F.lit(False))).drop("by"), f"annotations{k}")

    def start(_):
        used: set = set()

        def step(row):
            if row is None:
                return
            members = row["members"]
            if sum(m["free"] and m["member"] not in used for m in members) / len(members) >= row["least"]:
                used.update(m["member"] for m in members)
                yield {"draft_id": row["draft_id"]}

        return step

    if open_.limit(1).count():
        marked = open_.groupBy("draft_id", "least").agg(F.collect_list(F.struct("member", (~F.col("taken")).alias("free"))).alias("members"))
        keyed = scratch.table(marked.join(linked(open_.where("not taken").select("draft_id", "member"), scratch, "linked_annotations"), "draft_id", "left").withColumn("component", F.coalesce("component", "draft_id")), "keyed_annotations")
        kept.append(scan_sorted(keyed, ["component"], ["draft_id"], start, "draft_id bigint"))
    for made in kept:
        stay = stay.unionByName(made)
    return stay


def per_member_cap(drafts: DataFrame, scratch: Scratch, cap: int = 2) -> DataFrame:
    """(draft_id) of the drafts that stay when in each group, best first, a member may be in `cap` accepted drafts. A draft whose cover is used up evicts one accepted draft that has it, but not as its own cover. Drafts have draft_id, grouping, score, priority, members, cover; sub-stories aren't given here. Each component of a group's drafts with common members is gone through on its own."""

    def start(_):
        users: dict = {}
        accepted: dict = {}

        def blocked(members):
            return next((m for m in members if len(users.get(m, ())) >= cap), None)

        def step(row):
            if row is None:
                yield from ({"draft_id": d} for d in accepted)
                return
            members = row["members"]
            full = blocked(members)
            if full is not None and full == row["cover"]:
                weaker = next((d for d in users[full] if accepted[d][1] != full), None)
                if weaker is not None:
                    for m in accepted.pop(weaker)[0]:
                        users[m].remove(weaker)
                    full = blocked(members)
            if full is None:
                accepted[row["draft_id"]] = (members, row["cover"])
                for m in members:
                    users.setdefault(m, []).append(row["draft_id"])

        return lambda row: step(row)

    rows = drafts.select("grouping", (-F.col("score")).alias("s"), (-F.col("priority")).alias("p"), (-F.size("members")).alias("z"), "draft_id", F.array_sort(F.array_distinct("members")).alias("members"), "cover")
    pairs = rows.select("draft_id", F.explode("members").alias("m"), "grouping").select("draft_id", F.struct("grouping", "m").alias("member"))
    keyed = scratch.table(rows.join(linked(pairs, scratch, "caps"), "draft_id"), "keyed_caps")
    return scan_sorted(keyed, ["component"], ["s", "p", "z", "draft_id"], start, "draft_id bigint")


def member_ranks(members: DataFrame) -> DataFrame:
    """Ranks the members of each draft (draft_id, item_id, quality, aesthetics, phash, position): 0.7 quality and 0.3 aesthetics, less a penalty that grows with every earlier member of the same hash."""
    repeat = F.row_number().over(Window.partitionBy("draft_id", "phash").orderBy("position")) - 1
    out = members.withColumn("repeat", F.when(F.col("phash").isNull(), 0).otherwise(repeat))
    penalty = F.when(F.col("repeat") > 0, F.least(F.lit(1.0), 0.35 * (1 + 0.5 * (F.col("repeat") - 1)))).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 0.7 * F.coalesce("quality", F.lit(0.0)) + 0.3 * F.coalesce("aesthetics", "quality", F.lit(0.0)) - penalty)
    out = out.withColumn("score", F.round(score, 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("draft_id").orderBy(F.desc("score"), "position")))


def titled(drafts: DataFrame) -> DataFrame:
    """Adds a title from the place and the days, and a subtitle with the number of items."""
    a, b = (F.date_format(F.timestamp_seconds(c), "dd.MM.yyyy") for c in ("t_from", "t_to"))
    days = F.when(a == b, a).otherwise(F.concat_ws(" – ", a, b))
    return drafts.withColumns({"title": F.concat_ws(", ", F.col("place"), days), "subtitle": F.concat(F.col("n").cast("string"), F.lit(" items"))})


def member_quality(members: DataFrame, megapixels: float = 12.0, weights: tuple[float, float] = (0.7, 0.3), penalties: dict[str, float] | None = None, limited: bool = True) -> DataFrame:
    """Adds quality_part, aesthetics_part, penalty, score and rank to the members of drafts.

    Members have draft_id, item_id, position; quality, width, height, sharpness, noise, iso; exposure, brightness, contrast, entropy,
    colorfulness; phash, dhash, burst_uuid; and the draft's means avg_quality, avg_aesthetics, avg_resolution, avg_sharpness, avg_iso, any of them null.
    Without a quality of its own an item has the mean of resolution, sharpness and noise, where the draft's means stand in for what
    it lacks. Both parts are set in relation to the draft's mean. Every earlier member with the same hash or burst adds to the penalty.
    Unless `limited`, an item's own quality may lie outside 0 to 1, and so may the parts and the score. Ranks are by the score to nine digits.
    """
    from tidemark.functions.scoring import balanced, clamp01, iso_score, weighted_mean

    penalties = penalties or {"phash": 0.35, "dhash": 0.25, "burst_uuid": 0.15}
    c = F.col
    limit = clamp01 if limited else lambda x: x
    relative = clamp01 if limited else lambda x: F.when(x.isNotNull(), F.least(F.lit(1.0), x))
    resolution = F.when((c("width") > 0) & (c("height") > 0), clamp01(c("width").cast("double") * c("height") / 1e6 / megapixels))
    noise = F.coalesce(clamp01(c("noise")), iso_score(c("iso")), c("avg_iso"))
    own = weighted_mean([(F.coalesce(resolution, c("avg_resolution")), 0.45), (F.coalesce(clamp01(c("sharpness")), c("avg_sharpness")), 0.35), (noise, 0.20)])
    quality = F.coalesce(limit(c("quality")), own, c("avg_quality"), F.lit(0.0))
    light = [(F.when(c("exposure").isNull(), balanced(clamp01(c("brightness")), 0.55, 0.35)), 0.30), (F.when(c("exposure").isNull(), clamp01(c("contrast"))), 0.20), (clamp01(c("exposure")), 0.50)]
    looks = F.coalesce(weighted_mean([*light, (clamp01(c("entropy")), 0.25), (clamp01(c("colorfulness")), 0.25)]), c("avg_aesthetics"), F.lit(0.0))

    def related(x: Column, mean: Column) -> Column:
        # Within a transform the value is worked out once; written out, its copies would outgrow the generated code.
        return F.transform(F.array(x), lambda v: F.when(mean > 0, limit(0.6 * v + 0.4 * relative(v / F.greatest(mean, F.lit(0.0001))))).otherwise(limit(v)))[0]

    def repeats(name: str, base: float) -> Column:
        k = F.row_number().over(Window.partitionBy("draft_id", name).orderBy("position", "item_id")) - 1
        return F.when((F.length(c(name)) > 0) & (k > 0), F.least(F.lit(0.9), base * (1 + 0.5 * (k - 1)))).otherwise(0.0)

    out = members.withColumns({"quality_part": related(quality, c("avg_quality")), "aesthetics_part": related(looks, c("avg_aesthetics"))})
    out = out.withColumn("penalty", F.least(F.lit(0.9), sum((repeats(n, p) for n, p in penalties.items()), F.lit(0.0))))
    score = limit((weights[0] * c("quality_part") + weights[1] * c("aesthetics_part")) * F.greatest(F.lit(0.0), 1 - c("penalty")))
    out = out.withColumn("score", score)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("draft_id").orderBy(F.desc(F.round("score", 9)), "position", "item_id")))


#: Limits of a merge of overlapping drafts.
MERGE = {"iou": 0.55, "metres": 25_000.0, "core": 0.5, "hash": 0.18, "gap": 0.35}


def kinds_of(drafts: DataFrame) -> DataFrame:
    """(draft_id, kind): a number for the algorithm, the same for the same name."""
    return drafts.select("draft_id", F.hash("algorithm").alias("kind"))


def overlap_decisions(pairs: DataFrame, drafts: DataFrame, same: float = 0.45, any_: float = 0.85) -> DataFrame:
    """(winner, loser, action) of the pairs (a, b, jaccard) that must be settled: of one algorithm from the lower similarity on, others from the higher.

    Drafts have draft_id, algorithm, priority, score, n, t_from, t_to, lat, lon, core (names of places and people) and hash_median (a number up to 2**64), the last four may be
    null; sub-stories aren't given here. The winner takes the loser's members (`merge`) if their times overlap, they are near in space, share half of
    their names, have like hashes and like scores; else the loser is dropped (`drop`).
    """
    from tidemark.functions.geo import haversine_m
    from tidemark.functions.hashing import interval_iou

    d = effective_score(drafts).withColumn("names", F.array_distinct(F.transform(F.filter("core", lambda x: F.length(x) > 0), lambda x: F.lower(x))))
    side = lambda c, names: d.select(F.col("draft_id").alias(c), *[F.col(x).alias(f"{x}_{c[0]}") for x in names])
    known = lambda ok: F.coalesce(ok, F.lit(True))
    # Few pairs agree in time and score, and only these carry places, names and hashes.
    first, second = ("algorithm", "priority", "effective", "n", "t_from", "t_to"), ("lat", "lon", "names", "hash_median")
    close = pairs.select("a", "b", (F.col("jaccard") >= any_).alias("any"), (F.col("jaccard") >= same).alias("same")).where(F.col("any") | F.col("same"))
    both = close.join(side("a", first), "a").join(side("b", first), "b").where(F.col("any") | (F.col("same") & (F.col("algorithm_a") == F.col("algorithm_b"))))
    left = F.struct("priority_a", "effective_a", "n_a", -F.col("a")) >= F.struct("priority_b", "effective_b", "n_b", -F.col("b"))
    overlap = F.coalesce(interval_iou(F.col("t_from_a"), F.col("t_to_a"), F.col("t_from_b"), F.col("t_to_b")), F.lit(0.0)) >= MERGE["iou"]
    best = F.when(left, F.col("effective_a")).otherwise(F.col("effective_b"))
    even = F.abs(F.col("effective_a") - F.col("effective_b")) <= F.greatest(F.lit(1.0), best) * MERGE["gap"] + 1e-9
    both = both.select(F.when(left, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("loser"), F.coalesce(overlap & even, F.lit(False)).alias("like"))
    rest = both.where("like").join(side("winner", second), "winner").join(side("loser", second), "loser")
    near = known(haversine_m(F.col("lat_w"), F.col("lon_w"), F.col("lat_l"), F.col("lon_l"), 6371000.0) <= MERGE["metres"])
    shared = F.size(F.array_intersect("names_w", "names_l")) / F.size(F.array_union("names_w", "names_l"))
    core = F.when((F.size("names_w") > 0) & (F.size("names_l") > 0), shared >= MERGE["core"]).otherwise(True)
    alike = known(F.abs(F.col("hash_median_w") - F.col("hash_median_l")) / float(2**64 - 1) <= MERGE["hash"])
    rest = rest.select("winner", "loser", F.when(near & core & alike, "merge").otherwise("drop").alias("action"))
    return both.where("not like").select("winner", "loser", F.lit("drop").alias("action")).unionByName(rest)


def merged_members(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """Members (draft_id, item_id, position) with those that merges add: behind a winner's own, in order, what only its losers have, by the loser's id and position."""
    won = decisions.where("action = 'merge'").select("winner", "loser").join(members.withColumnRenamed("draft_id", "loser"), "loser")
    # Of all members only the winners' own are compared with what they win.
    winners = members.withColumnRenamed("draft_id", "winner").join(won.select("winner").distinct(), "winner", "left_semi")
    last = winners.groupBy("winner").agg(F.max("position").alias("last"))
    new = won.join(winners.select("winner", "item_id"), ["winner", "item_id"], "left_anti").groupBy("winner", "item_id").agg(F.min(F.struct("loser", "position")).alias("at"))
    added = new.join(last, "winner").withColumn("position", F.col("last") + F.row_number().over(Window.partitionBy("winner").orderBy("at", "item_id")))
    return members.unionByName(added.select(F.col("winner").alias("draft_id"), "item_id", F.col("position").cast(members.schema["position"].dataType).alias("position")))


def resolve_overlaps(drafts: DataFrame, members: DataFrame, scratch: Scratch, same: float = 0.45, any_: float = 0.85, rounds: int = 30) -> tuple[DataFrame, DataFrame]:
    """Drafts and members after all overlaps are settled, in rounds: in each, drafts that lose to no other take in or drop those that lose to them (a loser goes to its best winner), and what has grown is compared again.

    A round ends the draft of every loser of an undefeated winner, so there are as many rounds as drafts defeat each other in a chain.
    """
    from tidemark.operators.joins import set_overlaps

    for k in range(rounds):
        pairs = set_overlaps(members.select("draft_id", F.col("item_id").alias("member")), same, kinds_of(drafts), any_)
        made = scratch.table(overlap_decisions(pairs, drafts, same, any_), f"decisions{k}")
        if not made.limit(1).count():
            return drafts, members
        free = made.join(made.select(F.col("loser").alias("winner")).distinct(), "winner", "left_anti")
        rank = effective_score(drafts).select(F.col("draft_id").alias("winner"), F.struct("priority", "effective", "n", (-F.col("draft_id")).alias("i")).alias("rank"))
        best = free.join(rank, "winner").groupBy("loser").agg(F.max_by(F.struct("winner", "action"), "rank").alias("w")).select("w.winner", "loser", "w.action")
        best = scratch.table(best, f"settled{k}")
        gone = best.select(F.col("loser").alias("draft_id"))
        grown = best.where("action = 'merge'").join(effective_score(drafts).select(F.col("draft_id").alias("loser"), F.col("t_from").alias("f"), F.col("t_to").alias("u"), F.col("score").alias("s")), "loser")
        grown = grown.groupBy(F.col("winner").alias("draft_id")).agg(F.min("f").alias("f"), F.max("u").alias("u"), F.max("s").alias("s"))
        members = scratch.table(merged_members(best, members).join(gone, "draft_id", "left_anti"), f"members{k}")
        sizes = members.groupBy("draft_id").agg(F.count("*").alias("__n"))
        kept = drafts.join(gone, "draft_id", "left_anti").join(grown, "draft_id", "left").join(sizes, "draft_id", "left")
        new = {"t_from": F.least("t_from", F.coalesce("f", "t_from")), "t_to": F.greatest("t_to", F.coalesce("u", "t_to")), "score": F.greatest("score", F.coalesce("s", "score")), "n": F.coalesce("__n", "n")}
        drafts = scratch.table(kept.withColumns(new).select(*drafts.columns), f"drafts{k}")
    raise RuntimeError(f"overlaps did not settle in {rounds} rounds")


def composite_fingerprint(members: Column, t_from: Column, t_to: Column, cell: Column, cover: Column) -> Column:
    """A hash of what makes two drafts the same story: member set, time range, place cell and cover; parts that are null are left out."""
    return F.sha1(F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct(members)), ","), t_from.cast("string"), t_to.cast("string"), cell, cover.cast("string")))


def clamp_members(members: DataFrame, most: int) -> DataFrame:
    """The first `most` members of each draft by position; all if `most` isn't above 0."""
    if most <= 0:
        return members
    return members.withColumn("__r", F.row_number().over(Window.partitionBy("draft_id").orderBy("position", "item_id"))).where(F.col("__r") <= most).drop("__r")


@dataclass
class State:
    """What stages hand on: drafts (one row each) and their members (draft_id, item_id, position, ...)."""

    drafts: DataFrame
    members: DataFrame
    scratch: Scratch


#: A stage of the consolidation; callers may give their own.
Stage = Callable[[State], State]


def _only(state: State, drafts: DataFrame) -> State:
    """The state with some of its drafts, stored, and their members."""
    kept = state.scratch.table(drafts, f"kept{next(_NUMBERS)}")
    return State(kept, state.members.join(kept.select("draft_id"), "draft_id", "left_semi"), state.scratch)


def default_stages(settings: dict | None = None) -> dict[str, Stage]:
    """The stages by name, in the order in which a job runs them. Settings: least, score, conflict, same, any, annotate, cap, most, groups (by algorithm), curate (a stage of the caller's own)."""
    from tidemark.operators.joins import set_overlaps, subsets

    s = {"least": 2, "score": 0.25, "conflict": 0.5, "same": 0.45, "any": 0.85, "annotate": {}, "cap": 2, "most": 0, "groups": {}, "curate": None} | (settings or {})
    sets = lambda state: state.members.select("draft_id", F.col("item_id").alias("member"))

    def ranked(state: State) -> State:
        """Members in the order of their score, where they are scored."""
        if "score" not in state.members.columns:
            return state
        w = Window.partitionBy("draft_id").orderBy(F.desc("score"), "position", "item_id")
        return State(state.drafts, state.members.withColumn("rank", F.row_number().over(w)), state.scratch)

    def curated(state: State) -> State:
        state = s["curate"](state) if s["curate"] else state
        return State(state.drafts, clamp_members(state.members, s["most"]), state.scratch)

    def collapsed(state: State) -> State:
        return _only(state, collapse_duplicates(effective_score(state.drafts), ["digest", "n"], [F.desc("effective"), F.desc("priority")]).select(*state.drafts.columns))

    def nested(state: State) -> State:
        """Marks drafts that another one holds as its parts."""
        held = nest(subsets(sets(state)), state.drafts)
        parts = held.select(F.col("other_id").alias("draft_id"), F.col("preferred_id").alias("holder"))
        drafts = state.drafts.drop("holder", "sub_story").join(parts, "draft_id", "left").withColumn("sub_story", F.col("holder").isNotNull())
        return State(state.scratch.table(drafts, f"nested{next(_NUMBERS)}"), state.members, state.scratch)

    def apart(state: State) -> tuple[DataFrame, DataFrame]:
        whole = state.drafts.where(~F.coalesce("sub_story", F.lit(False))) if "sub_story" in state.drafts.columns else state.drafts
        return whole, state.drafts.join(whole.select("draft_id"), "draft_id", "left_anti")

    def dominated(state: State) -> State:
        whole, parts = apart(state)
        ids = whole.select("draft_id")
        pairs = set_overlaps(sets(state).join(ids, "draft_id", "left_semi"), s["conflict"])
        group = whole.select("draft_id", F.coalesce(*[F.when(F.col("algorithm") == k, F.lit(v)) for k, v in s["groups"].items()], F.col("algorithm")).alias("g"))
        pairs = pairs.join(group.select(F.col("draft_id").alias("a"), F.col("g").alias("ga")), "a").join(group.select(F.col("draft_id").alias("b"), F.col("g").alias("gb")), "b").where("ga = gb").select("a", "b")
        order = effective_score(whole).withColumn("order", F.struct((-F.col("priority")).alias("p"), (-F.col("effective")).alias("s"), (-F.col("n")).alias("n"), "draft_id"))
        return _only(state, dominant(order, pairs, "order", state.scratch).select(*state.drafts.columns).unionByName(parts))

    def overlapped(state: State) -> State:
        whole, parts = apart(state)
        lacks = {c: F.lit(None).cast(t) for c, t in (("lat", "double"), ("lon", "double"), ("core", "array<string>"), ("hash_median", "double")) if c not in whole.columns}
        inside = state.members.join(whole.select("draft_id"), "draft_id", "left_semi")
        drafts, members = resolve_overlaps(whole.withColumns(lacks), inside.select("draft_id", "item_id", "position"), state.scratch, s["same"], s["any"])
        rest = state.members.join(parts.select("draft_id"), "draft_id", "left_semi").select("draft_id", "item_id", "position")
        return State(drafts.select(*state.drafts.columns).unionByName(parts), members.unionByName(rest), state.scratch)

    def pruned(state: State) -> State:
        listed = sets(state).groupBy("draft_id").agg(F.collect_list("member").alias("members"))
        stay = prune_annotations(state.drafts.select("draft_id", "algorithm").join(listed, "draft_id"), s["annotate"], state.scratch)
        return _only(state, state.drafts.join(stay, "draft_id", "left_semi"))

    def capped(state: State) -> State:
        whole, parts = apart(state)
        listed = sets(state).groupBy("draft_id").agg(F.collect_list("member").alias("members"))
        rows = whole.select("draft_id", F.coalesce(*[F.when(F.col("algorithm") == k, F.lit(v)) for k, v in s["groups"].items()], F.col("algorithm")).alias("grouping"), "score", "priority").join(listed, "draft_id")
        stay = per_member_cap(rows.withColumn("cover", F.col("members")[0]), state.scratch, s["cap"])
        return _only(state, whole.join(stay, "draft_id", "left_semi").unionByName(parts))

    def named(state: State) -> State:
        place = state.drafts if "place" in state.drafts.columns else state.drafts.withColumn("place", F.lit(None).cast("string"))
        return State(titled(place), state.members, state.scratch)

    return {
        "filter": lambda state: _only(state, filter_drafts(state.drafts, s["least"], s["score"]).select(*state.drafts.columns)), "rank_members": ranked, "curate": curated, "collapse": collapsed, "nest": nested,
        "dominate": dominated, "overlaps": overlapped, "annotations": pruned, "caps": capped, "titles": named,
    }


def run_stages(state: State, stages: dict[str, Stage], watch: Callable[[str, int], None] | None = None) -> State:
    """Runs the stages one after the other; `watch` is told each one's name and how many drafts it has left."""
    for name, stage in stages.items():
        state = stage(state)
        if watch:
            watch(name, state.drafts.count())
    return state
