"""Feature catalog, leakage rules and predictor selection: small rule tables joined to one-pass column facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# ---- fixed values: feature groups and leakage rules ----
FEATURE_GROUPS = {
    "targets": ["occurrence", "intensity", "resolution", "resolution_bool"],
    "event_time": ["start", "end", "duration", "month", "season", "hour", "day_of_week", "storm_event_id"],
    "hydrometeorology": ["n_prec", "prec_intensity_max", "prec_intensity_mean", "prec_depth_total", "prec_duration_total", "max_tide"],
    "terrain_coastal": ["elevation", "slope", "shore_dist", "fema_fld_zone", "fema_zone_subty", "fema_overlap_ft", "fema_overlap_share", "fema_sfha_any"],
    "network": [
        "road_class", "travel_time", "edge_betweenness", "component_count_after_removal", "giant_component_size_after_removal",
        "giant_component_size_loss", "additional_disconnected_node_pairs", "pct_giant_component_loss", "high_network_criticality",
    ],
    "infrastructure": ["drainage_catch_basin_nearest_ft", "outfall_nearest_ft", "pump_nearest_ft", "critical_infra_exposure"],
    "socioeconomic": ["census_poverty_rate", "census_renter_share", "census_no_vehicle_share", "census_median_household_income"],
    "governance": ["gov_city", "gov_borough", "mayoral_administration"],
    "spatial_controls": ["borough", "tide_polygon", "tide_station", "precipitation_polygon", "precipitation_station"],
}
IDENTIFIERS = ["event_id", "segment_id", "analysis_view_name", "dataset_split_role", "label_definition", "possible_unreported_flood", "has_all_selected_fields"]
DUPLICATES = [
    "event_start_local", "event_end_local", "event_window_end_local", "event_window_duration_hours", "event_month", "segment_borough",
    "segment_edge_betweenness", "segment_travel_time_s", "shore_dist_ft", "shore_graph_steps", "station_p_id", "tide_id", "tide_polygon_id",
    "precip_polygon_id", "dem_mean", "dem_slope", "catch_basin_nearest_ft",
]
IDENTIFIER_REASON = "identifier_or_derived_selection"
DUPLICATE_REASON = "technical_duplicate_use_canonical_feature_name_instead"
PRESENCE_REASON = "presence_indicator_or_selection_metadata"
SHARED_REASONS = {"storm_event_id": "grouping_only_not_predictor", "start": "raw_timestamp_use_calendar_derivatives_instead"}
OUTCOME = "post_event_service_outcome"
TASK_REASONS = {
    "occurrence": {
        "occurrence": "target_column",
        "intensity": "post_event_complaint_count",
        "resolution": OUTCOME,
        "resolution_bool": OUTCOME,
        "end": "event_close_time_not_available_at_prediction",
        "duration": "event_window_outcome_not_available_at_prediction",
    },
    "intensity": {
        "intensity": "target_column",
        "occurrence": "constant_or_label_column",
        "resolution": OUTCOME,
        "resolution_bool": OUTCOME,
        "end": "close_time_not_available_at_event_start",
        "duration": "event_window_outcome_not_available_at_event_start",
    },
    "resolution_closure": {
        "resolution_bool": "target_column",
        "resolution": "target_magnitude_or_post_event_outcome",
        "end": "close_time_target_related",
        "duration": "derived_from_event_end_and_target_related",
        "occurrence": "constant_label_for_positive_events",
        "intensity": "observed_complaint_count_accumulates_during_event",
    },
    "resolution_time": {
        "resolution": "target_column",
        "resolution_bool": "target_closure_indicator",
        "end": "close_time_target_related",
        "duration": "derived_from_event_end_and_target_related",
        "occurrence": "constant_label_for_positive_events",
        "intensity": "observed_complaint_count_accumulates_during_event",
    },
}
# ---- end of fixed values ----


def column_facts(df: DataFrame) -> DataFrame:
    """Per column: type, share of non-null values, distinct values.

    Columns are laid out as (column, value) rows and folded map-side, so no row is expanded once per distinct aggregate.
    """
    names = df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "i int, feature string, dtype string")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(df.columns)])).alias("c")
    values = df.select(cells).select("c.*").groupBy("i", "v").agg(F.count("*").alias("n"))
    facts = values.groupBy("i").agg((F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("non_null_rate"), F.count("v").alias("n_unique"))
    return names.join(facts, "i", "left").select("feature", "dtype", "non_null_rate", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def feature_catalog(df: DataFrame) -> DataFrame:
    """Expected features with their availability, plus extra columns of the table."""
    spark = df.sparkSession
    expected = spark.createDataFrame([(g, f) for g, fs in FEATURE_GROUPS.items() for f in fs], "feature_group string, feature string")
    facts = column_facts(df)
    j = facts.join(F.broadcast(expected), "feature", "full")
    extra = F.col("feature_group").isNull()
    hidden = extra & (F.col("feature").startswith("present_") | F.col("feature").isin(IDENTIFIERS))
    return j.where(~hidden).select(
        F.coalesce("feature_group", F.lit("extra")).alias("feature_group"), "feature", F.col("dtype").isNotNull().alias("available"),
        "dtype", "non_null_rate", F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
    )


def feature_group_summary(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("feature_group").agg(
        F.count("*").alias("expected_features"),
        F.count_if("available").alias("available_features"),
        F.avg("non_null_rate").alias("mean_non_null_rate"),
        F.count_if(~F.col("available")).alias("missing_features"),
    )


def unavailable_features(catalog: DataFrame) -> DataFrame:
    return catalog.where(~F.col("available"))


def leakage_rules(task: str) -> dict[str, str]:
    rules = {c: IDENTIFIER_REASON for c in IDENTIFIERS} | {c: DUPLICATE_REASON for c in DUPLICATES}
    return rules | SHARED_REASONS | TASK_REASONS[task]


def leakage_audit(df: DataFrame, task: str, facts: DataFrame | None = None) -> DataFrame:
    """Every column with its exclusion verdict and reason for the task; ``facts`` spares counting them again."""
    rules = df.sparkSession.createDataFrame(list(leakage_rules(task).items()), "feature string, reason string")
    j = (column_facts(df) if facts is None else facts).join(F.broadcast(rules), "feature", "left")
    present = F.col("feature").startswith("present_")
    reason = F.when(present, F.lit(PRESENCE_REASON)).otherwise(F.col("reason"))
    return j.select("feature", reason.isNotNull().alias("excluded_from_predictors"), reason.alias("reason"), "dtype", "non_null_rate", "n_unique")


def predictor_columns(audit: DataFrame) -> DataFrame:
    """Columns a model may use: not excluded, not all null, not a timestamp, not a constant text."""
    usable = (F.col("non_null_rate") > 0) & ~F.col("dtype").startswith("timestamp") & (F.col("dtype") != "date")
    text = (F.col("dtype") == "string") & (F.col("n_unique") <= 1)
    kind = F.when(F.col("dtype").isin("string", "boolean"), "categorical").otherwise("numeric")
    return audit.where(~F.col("excluded_from_predictors") & usable & ~text).select("feature", "dtype", kind.alias("kind"))
