"""Selection of a draft's members under quotas, spacing and diversity."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import array_jaccard, hamming_bits
from tidemark.operators.islands import _metres, scan_sorted


@dataclass(frozen=True)
class Policy:
    """Limits of a selection. None switches a rule off."""

    target: int = 12
    least: int = 6
    per_day: int | None = 4
    per_slot: int | None = 2
    slot_hours: int = 3
    gap_s: int | None = 600
    per_place: int | None = 4
    place_m: float = 120.0
    bits: int | None = 9
    scene_share: float | None = 0.6
    upright_share: float | None = 0.6
    person_share: float | None = 0.5
    mmr: float = 0.75
    pool: int = 120

    def relaxed(self, step: int) -> Policy:
        """Step 1: shorter gaps; 2: fewer bits as well; 3: no place quota; 4: no caps."""
        out = self
        if step >= 1:
            out = replace(out, gap_s=None if self.gap_s is None else int(self.gap_s * 0.6))
        if step >= 2:
            out = replace(out, bits=None if self.bits is None else int(self.bits * 0.75))
        if step >= 3:
            out = replace(out, per_place=None)
        if step >= 4:
            out = replace(out, per_day=None, per_slot=None, scene_share=None, upright_share=None, person_share=None, gap_s=None, bits=None)
        return out


PROFILES = {"default": Policy(), "trip": Policy(target=25, least=12, per_day=5, slot_hours=2), "session": Policy(target=8, least=3, per_day=None)}


def policy(algorithm: str, days: int = 1, **changes) -> Policy:
    """The profile of an algorithm, its target raised by long runs, 25 at most."""
    base = PROFILES.get(algorithm, PROFILES["default"])
    return replace(base, target=min(25, max(base.target, 3 * days)), **changes)


def _differs(a: dict, b: dict) -> int:
    return ((a["hash"] ^ b["hash"]) & (1 << 64) - 1).bit_count() if None not in (a["hash"], b["hash"]) else 64


def _fits(c: dict, chosen: list[dict], p: Policy) -> bool:
    """Whether a candidate may join what has been chosen."""
    same = lambda k: sum(x[k] == c[k] for x in chosen)
    if p.per_day is not None and same("day") >= p.per_day:
        return False
    slot = c["t"] // (3600 * p.slot_hours)
    if p.per_slot is not None and sum(x["t"] // (3600 * p.slot_hours) == slot for x in chosen) >= p.per_slot:
        return False
    if p.gap_s is not None and any(abs(x["t"] - c["t"]) < p.gap_s for x in chosen):
        return False
    if p.per_place is not None and c["lat"] is not None and sum(x["lat"] is not None and _metres(x, c) <= p.place_m for x in chosen) >= p.per_place:
        return False
    if p.bits is not None and any(_differs(x, c) < p.bits for x in chosen):
        return False
    n = len(chosen) + 1
    for key, share in (("scene", p.scene_share), ("upright", p.upright_share)):
        if share is not None and n > 3 and c[key] is not None and same(key) + 1 > share * max(n, p.least):
            return False
    return not (p.person_share is not None and n > 3 and any(sum(q in (x["persons"] or ()) for x in chosen) + 1 > p.person_share * max(n, p.target) for q in c["persons"] or ()))


def _diverse(pool: list[dict], p: Policy) -> list[dict]:
    """The pool in the order of maximal marginal relevance: the score against the likeness to what comes before."""
    left, out = pool[: p.pool], []
    likeness = {c["item_id"]: 0.0 for c in left}
    while left:
        best = min(left, key=lambda c: (-(p.mmr * c["score"] - (1 - p.mmr) * likeness[c["item_id"]]), -c["score"], c["item_id"]))
        left.remove(best)
        out.append(best)
        for c in left:
            likeness[c["item_id"]] = max(likeness[c["item_id"]], 1 - _differs(best, c) / 64)
    return out


class Survivors:
    """What the rules leave of candidates that come best first, for each step of relaxing: `pool` of them at most. Holds no other candidates."""

    def __init__(self, p: Policy):
        self.p, self.seen = p, 0
        self.steps = [(p.relaxed(step), [], Counter(), Counter()) for step in range(5)]

    def offer(self, c: dict) -> None:
        self.seen += 1
        for now, kept, days, slots in self.steps:
            slot = c["t"] // (3600 * now.slot_hours)
            if len(kept) >= now.pool or (now.per_day is not None and days[c["day"]] >= now.per_day) or (now.per_slot is not None and slots[slot] >= now.per_slot):
                continue
            if _fits(c, kept, now):
                kept.append(c)
                days[c["day"]] += 1
                slots[slot] += 1

    def choose(self) -> list[dict]:
        """The survivors in the order of relevance, under the policy; it is relaxed step by step until there are enough."""
        chosen: list[dict] = []
        for now, kept, _, _ in self.steps:
            for c in _diverse(kept, now):
                if len(chosen) >= now.target:
                    break
                if all(c is not x for x in chosen) and _fits(c, chosen, now):
                    chosen.append(c)
            if len(chosen) >= min(now.least, self.seen):
                break
        return chosen


CANDIDATE = ["item_id", "t", "day", "lat", "lon", "hash", "score", "scene", "upright", "persons"]


def curate(candidates: DataFrame, p: Policy, key: str = "draft_id") -> DataFrame:
    """(key, item_id, position) of the chosen members. The rules see every candidate; the `pool` best that they leave are ordered by relevance, so a task holds no more of any draft."""
    rows = candidates.select(key, *CANDIDATE, (-F.col("score")).alias("__s"))

    def start(now):
        survivors = Survivors(p)

        def step(row):
            if row is not None:
                survivors.offer(row)
                return
            for n, c in enumerate(sorted(survivors.choose(), key=lambda c: (c["t"], c["item_id"]))):
                yield {key: now[0], "item_id": c["item_id"], "position": n}

        return step

    return scan_sorted(rows, [key], ["__s", "item_id"], start, f"{key} bigint, item_id bigint, position int")


def collapse_bursts(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The best item of each burst, and all items without one."""
    w = Window.partitionBy(*key, "burst_uuid").orderBy(F.desc("score"), "t", "item_id")
    single = candidates.where("burst_uuid is null")
    best = candidates.where("burst_uuid is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return single.unionByName(best)


def scene_bucket(is_panorama: Column, faces: Column, tags: Column, hour: Column, indoor: Column) -> Column:
    """What a picture shows, by the first that holds: panorama, group, food, landmark, night, indoor, outdoor."""
    has = lambda *words: F.coalesce(F.exists(tags, lambda x: F.lower(x).isin(*words)), F.lit(False))
    return (
        F.when(F.coalesce(is_panorama, F.lit(False)), "panorama")
        .when(faces >= 3, "group")
        .when(has("food", "meal", "restaurant"), "food")
        .when(has("landmark", "monument", "tower"), "landmark")
        .when((hour >= 21) | (hour < 5), "night")
        .when(F.coalesce(indoor, F.lit(False)), "indoor")
        .otherwise("outdoor")
    )


def interleave(rows: DataFrame, groups: list[str], order: list[str], most: int) -> DataFrame:
    """Numbers each group's rows (rn), so that ordering by rn takes turns; `most` of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rn") <= most)


def similarity(a: str, b: str) -> dict[str, Column]:
    """Likeness of two aliased items: time, hash, place, people and device."""
    from tidemark.functions.geo import haversine_m

    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return {
        "time_gap": F.abs(x("t") - y("t")),
        "hash_likeness": 1 - hamming_bits(x("hash"), y("hash")) / 64,
        "metres": haversine_m(x("lat"), x("lon"), y("lat"), y("lon")),
        "people": array_jaccard(x("persons"), y("persons")),
        "same_device": x("device") == y("device"),
    }


def covers(members: DataFrame, key: str = "draft_id") -> DataFrame:
    """The cover of each draft: quality, size, shape, people and place by weight, less a penalty for repeated hashes; ties by item."""
    copies = F.count("*").over(Window.partitionBy(key, "phash"))
    size = F.least(F.lit(1.0), F.col("width") * F.col("height") / 12e6)
    shape = F.when(F.col("width") >= F.col("height"), 1.0).otherwise(0.6)
    value = 0.4 * F.coalesce("quality", F.lit(0.0)) + 0.2 * size + 0.15 * shape + 0.15 * (F.size("persons") > 0).cast("double") + 0.1 * F.col("lat").isNotNull().cast("double") - 0.1 * (copies - 1)
    ranked = members.withColumn("cover_score", F.round(value, 9))
    w = Window.partitionBy(key).orderBy(F.desc("cover_score"), "item_id")
    return ranked.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, F.col("item_id").alias("cover"), "cover_score")


def candidate_scores(members: DataFrame, floor: float = 0.0, video: float = 0.0, face: float = 0.0, selfie: float = 0.0, cohort: float = 0.0) -> DataFrame:
    """Adds candidate_score to the members (draft_id, item_id, position, quality, is_video, faces, largest_face, is_selfie, persons) that may be chosen; others are left out.

    Quality and bonuses for videos, faces and groups, less penalties for close faces and selfies, and for every earlier candidate of the draft that shows
    one of the same people. Not below 0.
    """
    fits = members.where(~F.coalesce("no_show", F.lit(False)) & ~F.coalesce("low_quality", F.lit(False)) & (F.coalesce("quality", F.lit(0.0)) >= floor))
    faces, largest = F.coalesce("faces", F.lit(0)), F.coalesce("largest_face", F.lit(0.0))
    group = F.when(faces >= 3, face * F.least(F.lit(1.0), (faces - 2) / 4)).otherwise(0.0)
    close = selfie * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (largest - 0.25) / 0.35))
    base = F.coalesce("quality", F.lit(0.0)) + F.when(F.col("is_video"), video).otherwise(0.0) + F.when(faces > 0, face).otherwise(0.0) + group - close - F.when(F.coalesce("is_selfie", F.lit(False)), selfie).otherwise(0.0)
    seen = fits.select("draft_id", "item_id", "position", F.explode(F.array_distinct("persons")).alias("p"))
    before = F.row_number().over(Window.partitionBy("draft_id", "p").orderBy("position", "item_id")) - 1
    repeats = seen.withColumn("k", before).groupBy("draft_id", "item_id").agg(F.sum("k").alias("__repeats"))
    out = fits.join(repeats, ["draft_id", "item_id"], "left")
    return out.withColumn("candidate_score", F.greatest(F.lit(0.0), base - cohort * F.coalesce("__repeats", F.lit(0)))).drop("__repeats")


def assign_stays(members: DataFrame, metres: float = 120.0) -> DataFrame:
    """Adds stay to the members: in order of position, a located one belongs to the first centre of its draft within `metres`, else it is a new centre. Numbered from 1; null without a place. A draft's centres are held, not its members."""
    from pyspark.sql import types as T

    def start(_):
        centers: list[dict] = []

        def step(row):
            if row is None:
                return
            stay = None
            if row["lat"] is not None and row["lon"] is not None:
                stay = next((k for k, c in enumerate(centers, 1) if _metres(c, row) <= metres), None)
                if stay is None:
                    centers.append({"lat": row["lat"], "lon": row["lon"]})
                    stay = len(centers)
            yield {**row, "stay": stay}

        return step

    return scan_sorted(members, ["draft_id"], ["position", "item_id"], start, T.StructType([*members.schema.fields, T.StructField("stay", T.IntegerType())]))


def day_quotas(days: dict[str, tuple[str, float]], target: int, per_day: int | None = None, least: int = 0, core_bonus: int = 1, peripheral_penalty: int = 1) -> dict[str, int]:
    """How many members each day of a run may have. days: of each its category (`core` or `peripheral`) and score.

    Each day gets an even part of the target, core days more, peripheral ones fewer, these together 30 to 40 % of the target and one or two each. If that is
    more than the target (or `least`), peripheral days give way first, the lowest scored first, then core days down to one.
    """
    if not days:
        return {}
    even = -(-target // len(days))
    base = max(1, even if per_day is None else min(per_day, even))
    outer = [d for d, (kind, _) in days.items() if kind == "peripheral"]
    share = len(outer) / len(days)
    limit = min(target, max(len(outer), int(target * (0.4 if share >= 0.6 else 0.3 if share <= 0.25 else 0.35))))
    hard = 2 if target >= 2 * len(outer) else 1
    quota = {d: min(hard, max(0, base - peripheral_penalty)) if kind == "peripheral" else max(1, base + (core_bonus if kind == "core" else 0)) for d, (kind, _) in days.items()}
    # The largest peripheral quotas give one each in turn until they are within their share.
    over = sum(quota[d] for d in outer) - limit
    while over > 0 and any(quota[d] for d in outer):
        for d in sorted(outer, key=lambda d: -quota[d]):
            if over > 0 and quota[d] > 0:
                quota[d] -= 1
                over -= 1
    floor = {d: 0 if kind == "peripheral" else 1 for d, (kind, _) in days.items()}
    total = sum(quota.values())
    goal = min(target, total)
    lowest = max(sum(floor.values()), least)
    excess = total - (goal if goal >= lowest else min(total, lowest))
    for kind in ("peripheral", "core"):
        for d in sorted((d for d, (k, _) in days.items() if k == kind), key=lambda d: (days[d][1], d)):
            cut = min(excess, max(0, quota[d] - floor[d]))
            quota[d] -= cut
            excess -= cut
    return quota
