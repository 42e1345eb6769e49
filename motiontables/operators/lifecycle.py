"""Debounced partition lifecycle: births, deaths, splits and merges over unknown gaps.

Rows compress to islands of equal consecutive values first. An island of at least K rows
confirms; islands below K change nothing; unknown rows are islands of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SAFE_ID_PATTERN, is_text
from .blocks import FRAME_BLOCK, Scan, block_scan, count_changes
from .fold import sorted_fold
from .lineage_cut import cut


def canonical_partition(groups: Column) -> Column:
    """Text form of a partition: members sorted in a group, groups sorted; null stays null."""
    inner = F.transform(groups, lambda g: F.array_join(F.array_sort(g), ","))
    return F.when(groups.isNotNull(), F.array_join(F.array_sort(inner), "|"))


def parse_partition(text: Column) -> Column:
    return F.transform(F.split(text, r"\|"), lambda g: F.split(g, ","))


def membership_issues(df: DataFrame, keys: Sequence[str] = ("clip_id",), confirmation: int = 3,
                      width: int = FRAME_BLOCK) -> DataFrame:
    """Rows that break the membership contract."""
    flat = F.flatten("groups")
    base = df.withColumn("__members", F.array_join(F.array_sort(F.array_distinct(flat)), ","))
    isl = islands(base.withColumn("__p", canonical_partition(F.col("groups"))), keys, ["frame"], "__p", width)
    # The member set is established by the first confirmed partition.
    first = isl.filter(F.col("value").isNotNull() & (F.col("rows") >= confirmation)).groupBy(*keys).agg(
        F.min_by("value", "start").alias("__first"), F.min("start").alias("__since"))
    established = F.array_join(F.array_sort(F.flatten(parse_partition(F.col("__first")))), ",")
    scanned = block_scan(base, keys, ["frame"], [Scan("prev", F.col("frame"), "__prev")], width)
    rows = scanned.join(first.select(*keys, established.alias("__set"), "__since"), list(keys), "left")
    has = F.col("groups").isNotNull()
    issue = F.array_compact(F.array(
        F.when(F.col("__prev").isNotNull() & (F.col("frame") != F.col("__prev") + 1), "frames must be consecutive"),
        F.when(~is_text(F.col("kind")) | ~is_text(F.col("description")), "evidence text missing"),
        F.when(F.col("supported").isNull(), "support flag not explicit"),
        F.when(F.col("supported").isNotNull() & (F.col("supported") != has), "support flag contradicts groups"),
        F.when(has & ((F.size("groups") == 0) | F.exists("groups", lambda g: F.size(g) == 0)), "empty group"),
        F.when(has & ~F.forall(flat, lambda m: m.rlike(SAFE_ID_PATTERN)), "unsafe member id"),
        F.when(has & (F.size(F.array_distinct(flat)) < F.size(flat)), "groups are not disjoint"),
        F.when(has & (F.col("frame") > F.col("__since")) & (F.col("__members") != F.col("__set")),
               "member set changed")))
    return rows.select(*keys, "frame", F.explode(issue).alias("message"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
            width=FRAME_BLOCK, consecutive: bool = False) -> DataFrame:
    """(keys, start, end, rows, value, first_row, island) for runs of equal consecutive values.

    ``start``/``end`` are values of ``order[0]``; null values form runs too. ``consecutive`` ends a run where
    ``order[0]`` leaves out a number, too: within a run it rises as the row number does. A run is then named by
    its first row.
    """
    rows = df.select(*keys, *order, F.col(value).alias("__value"))
    tagged = count_changes(rows, keys, order, F.col("__value"), lambda a, b: ~a.eqNullSafe(b), lambda v: F.lit(1),
                           "island", width, row_number="__rn")
    parts = [(F.col(order[0]) - F.col("__rn")).alias("__offset")] if consecutive else []
    runs = tagged.groupBy(*keys, "island", *parts).agg(
        F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("rows"),
        F.min("__rn").alias("first_row"), F.first("__value", True).alias("value"))
    return runs.drop("__offset").withColumn("island", F.col("first_row")) if consecutive else runs


def confirmed_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, confirmation: int,
                     width=FRAME_BLOCK, island_width: int = FRAME_BLOCK) -> DataFrame:
    """Confirmed changes of a debounced value.

    Columns: ``start`` (first row of the new state), ``confirmed_row`` and ``value`` with
    ``previous`` (null for the initial state). A long island equal to the active state is
    no change; since every long island leaves its own value active, the active state before
    an island is simply the previous long island's value.
    """
    isl = islands(df, keys, order, value, width)
    long = cut(isl.filter(F.col("value").isNotNull() & (F.col("rows") >= confirmation)))
    scanned = block_scan(long, keys, ["island"], [Scan("prev", F.col("value"), "previous")], island_width)
    changed = scanned.filter(F.col("previous").isNull() | (F.col("previous") != F.col("value")))
    return changed.select(*keys, "island", "start", "first_row",
                          (F.col("first_row") + (confirmation - 1)).alias("confirmed_row"), "value", "previous")


def lifecycle_changes(df: DataFrame, keys: Sequence[str] = ("clip_id",), confirmation: int = 3,
                      width: int = FRAME_BLOCK) -> DataFrame:
    """Accepted partition changes per clip with the last frame the old partition was seen.

    Changes whose overlap components are one-to-many or many-to-one are accepted. A clip
    with any other change replays its islands (not its rows) through a sequential fold,
    because a rejected change leaves the old partition active. A frame nobody has seen ends
    an island: ``confirmation`` frames in a row must show a partition.
    """
    rows = df.withColumn("__p", canonical_partition(F.col("groups")))
    isl = cut(islands(rows, keys, ["frame"], "__p", width, consecutive=True).filter(F.col("value").isNotNull()))
    long = isl.filter(F.col("rows") >= confirmation)
    linked = block_scan(long, keys, ["island"], [Scan("prev", F.col("value"), "before")], width)
    bad = linked.filter(F.col("before").isNotNull() & (F.col("before") != F.col("value"))
                        & ~is_star(F.col("before"), F.col("value")))
    rejected = bad.select(*keys).distinct()
    keep = [*keys, "island", "start", "end", "rows", "value"]
    simple = _closed_form(isl.join(rejected, list(keys), "left_anti").select(*keep), keys, confirmation, width)
    replay = _replay(isl.join(rejected, list(keys), "left_semi").select(*keep), keys, confirmation)
    return simple.unionByName(replay)


CHANGE_COLUMNS = "island bigint, start bigint, confirmed_at bigint, value string, previous string, last_old bigint, accepted boolean"


def _closed_form(isl: DataFrame, keys, confirmation, width) -> DataFrame:
    is_long = F.col("rows") >= confirmation
    # Active before an island: the value of the long island before it.
    prior = block_scan(isl, keys, ["island"], [
        Scan("last_before", F.when(is_long, F.col("value")), "__before")], width)
    before = F.col("__before")
    seen = F.when(is_long | (before == F.col("value")), F.col("end"))
    lagged = block_scan(prior, keys, ["island"], [Scan("last_before", seen, "last_old")], width)
    changed = lagged.filter(is_long & (before.isNull() | (before != F.col("value"))))
    return changed.select(*keys, F.col("island").cast("long"), F.col("start").cast("long").alias("start"),
                          (F.col("start") + confirmation - 1).cast("long").alias("confirmed_at"), "value",
                          before.alias("previous"), F.col("last_old").cast("long").alias("last_old"),
                          F.lit(True).alias("accepted"))


def is_star(before: Column, after: Column) -> Column:
    """True when every overlap component of the changed groups is one-to-many or many-to-one."""
    a, b = F.split(before, r"\|"), F.split(after, r"\|")
    old, new = F.array_except(a, b), F.array_except(b, a)

    def hits(group, others):
        return F.filter(others, lambda o: F.arrays_overlap(F.split(group, ","), F.split(o, ",")))

    def good(group, others, back):
        touched = hits(group, others)
        return (F.size(touched) > 1) & F.forall(touched, lambda t: F.size(hits(t, back)) == 1) | (
            (F.size(touched) == 1) & (F.size(hits(touched.getItem(0), back)) > 1))

    return F.forall(old, lambda g: good(g, new, old)) & F.forall(new, lambda g: good(g, old, new))


def star_components(old: tuple, new: tuple):
    """(left groups, right groups) of each overlap component, or None when one is not a star."""
    gone, came = [g for g in old if g not in new], [g for g in new if g not in old]
    touch = {g: [h for h in came if set(g.split(",")) & set(h.split(","))] for g in gone}
    back = {h: [g for g in gone if h in touch[g]] for h in came}
    parts = []
    for g in gone:
        if len(touch[g]) > 1 and all(len(back[h]) == 1 for h in touch[g]):
            parts.append(([g], touch[g]))
        elif not (len(touch[g]) == 1 and len(back[touch[g][0]]) > 1
                  and all(len(touch[x]) == 1 for x in back[touch[g][0]])):
            return None
    for h in came:
        if len(back[h]) > 1:
            parts.append((back[h], [h]))
        elif not back[h]:
            return None
    return parts


def _replay(isl: DataFrame, keys, confirmation) -> DataFrame:
    """Sequential form over islands: at most one state tuple per clip in memory."""
    def new_state():
        return {"active": None, "last": None}

    def step(state, row):
        if row is None:
            return []
        value, size = row["value"], int(row["rows"])
        if value == state["active"]:
            state["last"] = int(row["end"])
            return []
        if size < confirmation:
            return []
        old = state["active"]
        accepted = old is None or star_components(tuple(old.split("|")), tuple(value.split("|"))) is not None
        out = []
        # A rejected proposal is reported again each time it collects K more rows.
        for k in range(1 if accepted else size // confirmation):
            start = int(row["start"]) + k * confirmation
            out.append({"island": int(row["island"]), "start": start, "confirmed_at": start + confirmation - 1,
                        "value": value, "previous": old, "last_old": state["last"], "accepted": accepted})
        if accepted:
            state["active"], state["last"] = value, int(row["end"])
        return out

    types = dict(isl.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys]) + ", " + CHANGE_COLUMNS
    return sorted_fold(isl, keys, ["island"], new_state, step, schema)


def lifecycle_nodes(changes: DataFrame, timeline: DataFrame, keys: Sequence[str] = ("clip_id",),
                    width: int = FRAME_BLOCK) -> DataFrame:
    """(keys, members, birth_frame, death_frame, death_reason) from accepted changes.

    A group is born where it enters the partition and dies one frame before the next
    accepted change that drops it; the rest die with the clip. ``timeline`` has one row
    per frame and gives the last frame.
    """
    ok = changes.filter("accepted")
    ends = timeline.groupBy(*keys).agg(F.max("frame").cast("long").alias("__last"))
    new = F.split("value", r"\|")
    old = F.coalesce(F.split("previous", r"\|"), F.array().cast("array<string>"))
    born = ok.select(*keys, F.col("start").alias("at"), F.lit(True).alias("birth"), F.lit(None).cast("string").alias("why"),
                     F.explode(F.array_except(new, old)).alias("members"))
    gone = ok.select(*keys, "start", F.explode(F.array_except(old, new)).alias("members"),
                     new.alias("new"))
    covered = F.filter("new", lambda g: F.arrays_overlap(F.split(g, ","), F.split("members", ",")))
    died = gone.select(*keys, F.col("start").alias("at"), F.lit(False).alias("birth"),
                       F.when(F.size(covered) > 1, "split").otherwise("merge").alias("why"), "members")
    both = born.unionByName(died)
    paired = block_scan(both, [*keys, "members"], ["at", "birth"], [
        Scan("next", F.struct("at", "why"), "__next")], width)
    return (paired.filter("birth").join(ends, list(keys))
            .select(*keys, "members", F.col("at").alias("birth_frame"),
                    F.coalesce(F.col("__next.at") - 1, F.col("__last")).alias("death_frame"),
                    F.coalesce(F.col("__next.why"), F.lit("end_of_observed_clip")).alias("death_reason")))


def lifecycle_events(changes: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Split and merge events with their observation bracket; rejected changes are ``unresolved``."""
    old = F.split("previous", r"\|")
    new = F.split("value", r"\|")
    gone, came = F.array_except(old, new), F.array_except(new, old)

    def touching(group, others):
        return F.filter(others, lambda o: F.arrays_overlap(F.split(group, ","), F.split(o, ",")))

    later = changes.filter(F.col("previous").isNotNull()).select("*", gone.alias("gone"), came.alias("came"))
    bracket = F.struct((F.col("last_old") + 1).alias("first_possible"), F.col("start").alias("last_possible"))

    def event(kind, group, members):
        return F.struct(F.lit(kind).alias("kind"), group.alias("subject"), members.alias("members"))

    splits = F.transform(F.filter("gone", lambda g: F.size(touching(g, F.col("came"))) > 1),
                         lambda g: event("split", g, touching(g, F.col("came"))))
    merges = F.transform(F.filter("came", lambda g: F.size(touching(g, F.col("gone"))) > 1),
                         lambda g: event("merge", g, touching(g, F.col("gone"))))
    open_case = F.array(event("unresolved", F.col("value"), F.col("gone")))
    return later.select(*keys, F.col("start").alias("frame"), "confirmed_at", bracket.alias("bracket"),
                        F.inline(F.when(F.col("accepted"), F.concat(splits, merges)).otherwise(open_case)))


def terminal_pending(df: DataFrame, keys: Sequence[str] = ("clip_id",), confirmation: int = 3,
                     width: int = FRAME_BLOCK) -> DataFrame:
    """Partitions still unconfirmed when the clip ends."""
    rows = df.withColumn("__p", canonical_partition(F.col("groups")))
    isl = islands(rows, keys, ["frame"], "__p", width, consecutive=True)
    last = isl.groupBy(*keys).agg(F.max("island").alias("island"))
    tail = isl.join(last, [*keys, "island"]).filter(F.col("value").isNotNull() & (F.col("rows") < confirmation))
    active = lifecycle_changes(df, keys, confirmation, width).filter("accepted").groupBy(*keys).agg(
        F.max_by("value", "start").alias("__active"))
    return tail.join(active, list(keys), "left").filter(~F.col("value").eqNullSafe(F.col("__active"))) \
        .select(*keys, "start", "end", "rows", "value")


def group_overlaps(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new groups that share a member, found through the member, not by pairing groups.

    ``old``/``new`` have (keys, group_id, members); result (keys, old_id, new_id, shared).
    """
    a = old.select(*keys, F.col("group_id").alias("old_id"), F.explode(F.array_distinct("members")).alias("m"))
    b = new.select(*keys, F.col("group_id").alias("new_id"), F.explode(F.array_distinct("members")).alias("m"))
    return a.join(b, [*keys, "m"]).groupBy(*keys, "old_id", "new_id").agg(F.count(F.lit(1)).alias("shared"))


def last_active_frames(df: DataFrame, keys: Sequence[str], frame: str, value: Column, active: Column,
                       width: int = FRAME_BLOCK) -> DataFrame:
    """Last earlier-or-equal frame at which the row's value equalled the active one."""
    return block_scan(df, keys, [frame], [Scan("last_known", F.when(value == active, F.col(frame)), "last_active")], width)
