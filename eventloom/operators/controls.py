"""Matched controls: sampling under exclusions in three rounds, with its diagnostics and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import key_with_null_token
from eventloom.operators.joins import salted_join
from eventloom.operators.ordered import CHUNK, chunk_by_range, chunked_prefix, keep_first
from eventloom.session import pin

# ---- fixed values: notes per relaxation level ----
LEVEL_NOTES = {1: "same_road_same_elev_same_shore", 2: "same_elev_same_shore", 3: "same_borough_same_tide_same_precip"}
# ---- end of fixed values ----


def stratum_keys(df: DataFrame, base: Sequence[str], road: str, bands: Sequence[str]) -> DataFrame:
    """Keys of the three pools: everything matched, without the road class, base only."""
    col = lambda names: key_with_null_token(*[F.col(n) for n in names])
    return df.withColumns({"k1": col([*base, road, *bands]), "k2": col([*base, *bands]), "k3": col(base)})


def exclusion_flags(positives: DataFrame, spatial: DataFrame, unreported: DataFrame) -> DataFrame:
    """Per (storm, segment): reported in the storm, near a reported one, possibly unreported."""
    tag = lambda d, f: d.select("storm", "segment", *[F.lit(int(f == x)).alias(x) for x in ("p", "s", "u")])
    rows = tag(positives, "p").union(tag(spatial, "s")).union(tag(unreported, "u"))
    return rows.groupBy("storm", "segment").agg(F.max("p").alias("p"), F.max("s").alias("s"), F.max("u").alias("u"))


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based place of each row within its keys; a hot key is spread over ranges."""
    run = chunked_prefix(chunk_by_range(df, [*keys, *order]), keys, list(order), {out: ("cum_sum", F.lit(1).cast("bigint"))})
    return run.withColumn(out, F.col(out) - 1).drop(CHUNK)


def _marks_up_to(asks: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, out: str) -> DataFrame:
    """``asks`` with the number of ``marks`` of the same keys whose ``at`` is not above their own.

    Both sides are one ordered run, in which marks come first among equals, so no pair of rows is formed."""
    rest = [c for c in asks.columns if c not in (*keys, at)]
    both = marks.select(*keys, at, F.lit(0).alias("__ask"), F.lit(None).cast(asks.select(F.struct(*rest)).schema[0].dataType).alias("__row")).unionByName(
        asks.select(*keys, at, F.lit(1).alias("__ask"), F.struct(*rest).alias("__row"))
    )
    run = chunked_prefix(chunk_by_range(both, [*keys, at, "__ask", "__row"]), keys, [at, "__ask", "__row"], {out: ("cum_sum", (1 - F.col("__ask")).cast("bigint"))})
    return run.where("__ask = 1").select(*keys, at, out, "__row.*")


def _skipping(asks: DataFrame, gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``asks`` with ``at``, a 0-based rank among the places not in ``gaps``, turned into the place itself.

    The gap of rank k lies behind ``at - k`` free places, so the gaps before the free place of rank r are those with ``at - k <= r``."""
    behind = _numbered(gaps.select(*keys, "at").distinct(), keys, ["at"], "__k").select(*keys, (F.col("at") - F.col("__k")).alias("at"))
    out = _marks_up_to(asks, behind, keys, "at", "__gaps")
    return out.withColumn("at", F.col("at") + F.col("__gaps")).drop("__gaps")


def _choose(asking: DataFrame, members: DataFrame, flags: DataFrame, taken: DataFrame | None, most: int) -> DataFrame:
    """``event_id, start, end, control`` for the asking positives of one level that have a free segment in their pool ``k``.

    A positive's turn within its pool, in order of time, is its rank among the segments its storm leaves free, modulo their
    number.  Positives of one window have turns in a row, so they get different segments as long as there are any.
    No window has more than ``most`` positives."""
    storm, window = ["storm", "k"], ["storm", "k", "start", "end"]
    asked = _numbered(asking, ["k"], ["start", "end", "event_id"], "turn")
    size = members.groupBy("k").agg(F.count("*").alias("n"))
    pairs = pin(asking.select(*storm).distinct())
    shut = pin(salted_join(flags, members, ["segment"]).select("storm", "k", "at").join(pairs, storm, "left_semi"))
    counts = shut.groupBy(*storm).agg(F.count("*").alias("n_shut"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    pairs = pin(pairs.join(size, "k").join(counts, storm, "left").select(*storm, (F.col("n") - z("n_shut")).alias("free")))
    open_ = asked.join(pairs, storm)
    at = F.pmod("turn", F.when(F.col("free") > 0, F.col("free"))).alias("at")
    if taken is None:
        # pools with as many free segments as a window can have turns need no look at the windows; an open window has no control
        roomy = (F.col("free") >= most) & F.col("start").isNotNull() & F.col("end").isNotNull()
        asks = open_.where(roomy).select(*storm, "start", "end", "event_id", at)
        if not pairs.where(F.col("free") < most).isEmpty():
            tight = open_.where(F.col("free") < most)
            firsts = tight.groupBy(*window).agg(F.min("turn").alias("first"))
            asks = asks.unionByName(tight.join(firsts, window).where(F.col("turn") - F.col("first") < F.col("free")).select(*storm, "start", "end", "event_id", at))
    else:
        windows = asked.groupBy(*window).agg(F.min("turn").alias("first"))
        # segments that other positives of the same window hold already, as ranks among those the storm leaves free
        held = taken.join(windows.select(*window), ["start", "end"]).join(members, ["k", "segment"])
        held = held.join(shut, [*storm, "at"], "left_anti").select(*window, "at").distinct()
        held = _marks_up_to(held, shut, storm, "at", "__shut").withColumn("at", F.col("at") - F.col("__shut")).select(*window, "at")
        held = pin(held)
        windows = windows.join(held.groupBy(*window).agg(F.count("*").alias("n_held")), window, "left")
        open_ = open_.join(windows, window).withColumn("free", F.col("free") - z("n_held"))
        asks = _skipping(open_.where(F.col("turn") - F.col("first") < F.col("free")).select(*window, "event_id", at), held, window)
    asks = pin(asks)
    # turns go round the pool, so there are far fewer places than turns: each is looked up once
    places = _skipping(asks.select(*storm, "at").distinct().withColumn("rank", F.col("at")), shut, storm).join(members, ["k", "at"])
    found = asks.withColumnRenamed("at", "rank").join(places.select(*storm, "rank", "segment"), [*storm, "rank"])
    return found.select("event_id", "start", "end", F.col("segment").alias("control"))


def matched_controls(positives: DataFrame, universe: DataFrame, flags: DataFrame) -> DataFrame:
    """One control per positive where any pool has a free segment: ``(event_id, control, level, score)``.

    ``positives``: event_id, start, end, storm, segment, k1, k2, k3; ``universe``: segment, k1, k2, k3;
    ``flags``: excluded (storm, segment).  The three levels are three rounds, whatever the number of rows.  In each, a
    positive without a control takes the segment of its turn among those of its pool that are not excluded for its storm, not
    reported in it and not used for the same window; it goes on to the next level only where none is left.  Turns go round the
    pool in (start, end, event_id) order, so controls spread evenly.  ``score`` is the number of earlier controls on the segment.

    Positives without a storm share the exclusions of their window.  Where one window belongs to several storms, the smallest event
    keeps a segment that two of them chose, the others ask at the next level.
    """
    kind = F.coalesce(F.concat(F.lit("s"), F.col("storm").cast("string")), F.concat_ws("_", F.lit("w"), F.col("start").cast("string"), F.col("end").cast("string")))
    open_ = pin(positives.select("event_id", "start", "end", kind.alias("storm"), "segment", "k1", "k2", "k3"))
    tagged = flags.where(F.col("storm").isNotNull()).select(F.concat(F.lit("s"), F.col("storm").cast("string")).alias("storm"), "segment")
    shut = pin(tagged.union(open_.select("storm", "segment")).distinct())
    per = open_.groupBy("start", "end").agg(F.count("*").alias("n"), (F.min("storm") != F.max("storm")).alias("mixed"))
    most, mixed = per.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("mixed"), F.lit(False))).first()
    picks, left = None, open_.count()
    for level in (1, 2, 3):
        k = f"k{level}"
        members = pin(_numbered(universe.select("segment", F.col(k).alias("k")).where("k IS NOT NULL").distinct(), ["k"], ["segment"], "at"))
        taken = None if picks is None else picks.select("start", "end", F.col("control").alias("segment"))
        chosen = _choose(open_.select("event_id", "start", "end", "storm", F.col(k).alias("k")).where("k IS NOT NULL"), members, shut, taken, most)
        # the turns of a storm's window, and the pools of a level, never meet on a segment
        first = keep_first(chosen, ["control", "start", "end"], [F.col("event_id")]) if mixed else chosen
        if picks is not None:
            first = first.join(taken.withColumnRenamed("segment", "control"), ["control", "start", "end"], "left_anti")
        first = pin(first.select("event_id", "start", "end", "control", F.lit(level).alias("level")))
        picks = first if picks is None else pin(picks.unionByName(first))
        left -= first.count()
        if not left:  # nobody asks at the next level
            break
        open_ = pin(open_.join(first, "event_id", "left_anti"))
    return _numbered(picks, ["control"], ["start", "end", "event_id"], "score").select("event_id", "control", "level", F.col("score").cast("double").alias("score"))


def control_rows(picks: DataFrame, positives: DataFrame, copied: Sequence[str] = ()) -> DataFrame:
    """Control events: the positive's window, and its ``copied`` columns, on the chosen segment, with no outcome."""
    j = picks.join(positives.select("event_id", "start", "end", "storm", *copied), "event_id")
    note = F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL_NOTES.items() for x in kv]), F.col("level"))
    return j.select(
        F.concat(F.lit("NEG_"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_id").cast("string").alias("matched_positive_event_id"), F.col("control").alias("segment"),
        "start", "end", "storm", F.lit(False).alias("occurrence"), F.lit(0).alias("intensity"), F.col("level").alias("negative_sampling_level"),
        (F.col("level") > 1).alias("negative_sampling_relaxed"), note.alias("negative_sampling_notes"), F.col("score").alias("negative_match_score"), *copied,
    )


def sampling_diagnostics(positives: DataFrame, universe: DataFrame, flags: DataFrame) -> DataFrame:
    """Pool sizes and exclusions by reason for every positive, as counts per (storm, base key)."""
    base = universe.groupBy("k3").agg(F.count("*").alias("before"))
    f = salted_join(flags, universe.select("segment", "k3"), ["segment"])
    per = f.groupBy("storm", "k3").agg(
        F.sum("p").alias("np"), F.sum("s").alias("ns"), F.sum(F.col("p") * F.col("s")).alias("nps"), F.sum("u").alias("nu"), F.count("*").alias("nany")
    )
    own = f.select("storm", "segment", "k3", F.col("p").alias("op"), F.col("s").alias("os"))
    j = positives.select("event_id", "storm", "segment", "k3").join(base, "k3", "left").join(per, ["storm", "k3"], "left").join(own, ["storm", "segment", "k3"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    mine = F.col("op").isNotNull()
    return j.select(
        "event_id", z("before").alias("pool_before"), (z("before") - z("nany")).alias("pool_after"), F.when(mine, 1).otherwise(0).alias("excluded_by_same_segment"),
        (z("np") - z("op")).alias("excluded_by_temporal_overlap"), (z("ns") - z("os")).alias("excluded_by_spatial_buffer"),
        (z("nps") - z("op") * z("os")).alias("excluded_by_spatiotemporal_buffer"), z("nu").alias("excluded_by_possible_unreported"),
    )


def analysis_views(balanced: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """Balanced rows alone, with high-confidence candidates, and with every candidate."""
    strict = balanced.withColumns({"possible_unreported_flood": F.lit(False), "include_in_supervised_training": F.lit(True)})
    weak = candidates.withColumns({"occurrence": F.lit(None).cast("boolean"), "possible_unreported_flood": F.lit(True), "include_in_supervised_training": F.lit(False)})
    join = lambda w: strict.unionByName(w, allowMissingColumns=True)
    return {"strict_main": strict, "main_plus_high_conf_possible": join(weak.where("confidence = 'high'")), "semi_supervised_pool": join(weak)}


def view_summary(view: DataFrame, name: str) -> DataFrame:
    return view.agg(
        F.lit(name).alias("view_name"), F.count("*").alias("rows"), F.count_if("occurrence").alias("observed_positive"),
        F.count_if(~F.col("occurrence")).alias("matched_negative"), F.count_if("possible_unreported_flood").alias("possible_rows"),
    )
