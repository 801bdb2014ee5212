"""Every registered query: name -> function of (spark, folder of test tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail import contract
from cashtrail.functions import draws, geo, money, risk, texts, times
from cashtrail.operators import analytics, clean, heatmap, lookup, metrics, profile, quality, scoring, splits
from cashtrail.session import new_folder
from cashtrail.sources import demo_tables, readers, writers

Query = Callable[[SparkSession, str], DataFrame]

# Time the look-back questions are asked at, and the limit that counts as HIGH
# (the rules give at most 0.693, so the default limit would select nothing).
AS_OF = "2024-01-31 00:00:00"
ALERT_LIMIT = 0.5
CITY = "NATION_2"

_QUERIES: dict[str, Query] = {}


def register(function: Query) -> Query:
    """Register under the function's name, without the mark that keeps it from hiding a module."""
    _QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def queries() -> dict[str, Query]:
    from cashtrail.plans import catalog_models, catalog_streams  # noqa: F401  (they register theirs)

    return dict(_QUERIES)


def _text_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn(column, times.iso_text(F.col(column)))


def _ts():
    return F.col("timestamp")


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return clean.prepare_complaints(demo_tables.complaints(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = demo_tables.complaints(spark, sf).drop(*scoring.RESULT_COLUMNS[1:])
    return scoring.score(rows, high=ALERT_LIMIT, medium=contract.LIMITS.single_medium)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.prediction_log(_scored(spark, sf))


# --- rows and columns ---------------------------------------------------------


@register
def clean_rows(spark, sf):
    return demo_tables.gappy_complaints(spark, sf).transform(clean.drop_incomplete).transform(
        clean.keep_available
    ).transform(_text_time)


@register
def time_features(spark, sf):
    hr, day, mon = times.hour(_ts()), times.day_of_week(_ts()), times.month(_ts())
    return demo_tables.reports(spark, sf).select(
        "complaint_id",
        hr.alias("hour"),
        day.alias("day_of_week"),
        mon.alias("month"),
        times.is_weekend(day).alias("is_weekend"),
        times.is_peak_hours(hr).alias("is_peak_hours"),
        times.is_peak_withdrawal(hr).alias("is_peak_withdrawal"),
        times.is_night_time(hr).alias("is_night_time"),
        times.is_business_hours(hr).alias("is_business_hours"),
        times.is_business_hours(hr, day).alias("is_business_hours_serving"),
    )


@register
def distance_features(spark, sf):
    ends = [
        F.col(c)
        for c in ("complaint_lat", "complaint_lng", "predicted_withdrawal_lat", "predicted_withdrawal_lng")
    ]
    return demo_tables.complaints(spark, sf).select(
        "complaint_id",
        F.round(geo.haversine_km(*ends), 4).alias("distance_km"),
        F.round(geo.planar_km(*ends), 4).alias("planar_km"),
    )


@register
def alert_priority(spark, sf):
    return demo_tables.complaints(spark, sf).select(
        "complaint_id",
        "risk_score",
        "amount_lost",
        money.alert_priority(F.col("risk_score"), F.col("amount_lost")).alias("alert_priority"),
    )


@register
def amount_levels(spark, sf):
    return demo_tables.reports(spark, sf).select(
        "complaint_id",
        money.amount_risk_level(F.col("amount_lost")).alias("amount_risk_level"),
        money.serving_amount_level(F.col("amount_lost")).alias("serving_amount_level"),
    )


@register
def urgency_rule(spark, sf):
    return demo_tables.reports(spark, sf).select("complaint_id", "crime_type", "amount_lost", "urgency_level")


@register
def composite_risk(spark, sf):
    rows = lookup.with_state_facts(demo_tables.complaints(spark, sf))
    raw = risk.composite_risk(
        F.col("crime_rate_factor"), times.hour(_ts()), F.col("amount_lost"), F.col("crime_type")
    )
    return rows.select(
        "complaint_id",
        "crime_rate_factor",
        risk.composite_probability(raw).alias("withdrawal_probability"),
        risk.composite_score(raw).alias("risk_score"),
    )


@register
def multipliers(spark, sf):
    mon = times.month(_ts())
    return demo_tables.complaints(spark, sf).select(
        "complaint_id",
        times.season_multiplier(mon).alias("season"),
        times.dashboard_season_multiplier(mon).alias("dashboard_season"),
        risk.regional_multiplier(F.col("complaint_state")).alias("regional"),
    )


@register
def geo_factor(spark, sf):
    at = F.col("complaint_lat"), F.col("complaint_lng")
    return demo_tables.complaints(spark, sf).select(
        "complaint_id",
        F.round(geo.degrees_to_major_city(*at), 6).alias("degrees"),
        geo.city_factor(*at).alias("city_factor"),
    )


@register
def city_box_flag(spark, sf):
    return demo_tables.complaints(spark, sf).select(
        "complaint_id", geo.in_major_city_box(F.col("complaint_lat"), F.col("complaint_lng")).alias("high_risk_zone")
    )


@register
def fallback_score(spark, sf):
    p = scoring.rule_probability()
    low, high = risk.hours_band(p)
    limits = contract.LIMITS
    return demo_tables.complaints(spark, sf).select(
        "complaint_id",
        F.round(p, 3).alias("withdrawal_probability"),
        low.alias("hours_from"),
        high.alias("hours_before"),
        risk.risk_level(p, limits.single_high, limits.single_medium).alias("risk_level"),
        F.round(risk.confidence(p), 3).alias("confidence_score"),
        F.round(risk.rule_radius_km(p), 6).alias("alert_radius_km"),
    )


@register
def seeded_location(spark, sf):
    return _scored(spark, sf).select(
        "complaint_id",
        F.round("predicted_withdrawal_lat", 6).alias("predicted_withdrawal_lat"),
        F.round("predicted_withdrawal_lng", 6).alias("predicted_withdrawal_lng"),
        "predicted_hours_to_withdrawal",
    )


@register
def serving_risk(spark, sf):
    p = F.col("base_risk")
    urgency = F.col("urgency_level")
    level = risk.risk_level(p, contract.LIMITS.bulk_high, contract.LIMITS.bulk_medium)
    rows = scoring.serving_features(demo_tables.complaints(spark, sf))
    modelled = scoring.from_model(rows, "base_risk")
    return modelled.select(
        "complaint_id",
        F.round("base_risk", 9).alias("base_risk"),
        "requires_bank_alert",
        "high_risk_zone",
        "amount_risk_level",
        F.round("atm_distance_km", 4).alias("atm_distance_km"),
        "withdrawal_probability",
        "predicted_hours_to_withdrawal",
        "risk_level",
        "confidence_score",
        "alert_radius_km",
        risk.urgency_hours(p, urgency).alias("hours_by_urgency"),
        risk.level_radius_km(level).alias("radius_by_level"),
    )


@register
def text_formats(spark, sf):
    return _scored(spark, sf).select(
        "complaint_id",
        texts.complaint_id(F.year(_ts()), F.substring("complaint_id", 7, 20).cast("bigint")).alias("rebuilt_id"),
        texts.alert_id(F.col("complaint_id"), _ts()).alias("alert_id"),
        texts.alert_message(
            F.col("predicted_withdrawal_lat"),
            F.col("predicted_withdrawal_lng"),
            F.col("predicted_hours_to_withdrawal"),
        ).alias("message"),
        times.month_label(_ts()).alias("month_label"),
        times.hour_label(times.hour(_ts())).alias("hour_label"),
        times.iso_text(_ts()).alias("iso_time"),
        texts.title_words(F.lower(F.replace("status", F.lit(" "), F.lit("_")))).alias("title"),
        money.thousands(F.col("amount_lost")).alias("amount_text"),
    )


@register
def day_part(spark, sf):
    return demo_tables.reports(spark, sf).select("complaint_id", times.day_part(times.hour(_ts())).alias("day_part"))


@register
def mask_pii(spark, sf):
    rows = demo_tables.reports(spark, sf).withColumn("pattern", F.col("victim_phone"))
    masked = rows.transform(clean.mask_phone).transform(clean.mask_phone, "pattern", whole=False)
    return masked.select("complaint_id", F.col("victim_phone").alias("hidden"), "pattern")


@register
def schema_ops(spark, sf):
    """Projection by availability and type, defaults, required input, membership, rename."""
    rows = demo_tables.gappy_complaints(spark, sf)
    defaults = {"amount_lost": 0.0, "jurisdiction": "Unknown"}
    ready = rows.transform(clean.require_columns).transform(clean.fill_defaults, defaults)
    ready = ready.where(F.col("bank_involved").isin("Harbour Bank", "Meadow Bank", "Summit Bank"))
    stamped = clean.default_timestamp(ready.drop("timestamp"), F.lit(AS_OF))
    numbers = clean.numeric_columns(stamped, exclude=contract.TARGETS)
    return stamped.select(
        "complaint_id", "jurisdiction", times.iso_text(_ts()).alias("event_time"), *[F.col(c).alias(f"x_{c}") for c in numbers]
    )


@register
def urgent_cases(spark, sf):
    rows = clean.where_equal(demo_tables.complaints(spark, sf), "urgency_level", "High")
    return rows.select(
        "complaint_id",
        F.round(money.crores(F.col("amount_lost")), 4).alias("crores"),
        money.fraction(F.col("risk_score")).alias("risk"),
    )


@register
def clean_features(spark, sf):
    texted = demo_tables.complaints(spark, sf).transform(_text_time)
    return (
        clean.prepare_complaints(texted)
        .withColumn("distance_km", F.round("distance_km", 4))
        .select("complaint_id", *contract.DERIVED_SCHEMA.names)
    )


@register
def model_features(spark, sf):
    rows = _prepared(spark, sf).withColumns(
        {
            "jurisdiction": F.upper("complaint_state"),
            "nearest_atm_lat": F.col("complaint_lat") + 0.005,
            "nearest_atm_lng": F.col("complaint_lng") - 0.005,
        }
    )
    return clean.add_model_features(rows).select(
        "complaint_id",
        "high_risk_zone",
        "is_night_time",
        "is_business_hours",
        "amount_risk_level",
        F.round("distance_to_atm", 4).alias("distance_to_atm"),
    )


@register
def dimension_lookup(spark, sf):
    rows = lookup.with_crime_facts(lookup.with_state_facts(demo_tables.complaints(spark, sf)))
    return rows.select(
        "complaint_id",
        "crime_rate_factor",
        F.col("lat_range.lo").alias("state_south"),
        F.col("lng_range.hi").alias("state_east"),
        "crime_weight",
        F.col("amount_lost").between(F.col("usual_amount.lo"), F.col("usual_amount.hi")).alias("usual"),
    )


# --- aggregates ---------------------------------------------------------------


@register
def overview(spark, sf):
    return profile.overview(demo_tables.complaints(spark, sf))


@register
def risk_distribution(spark, sf):
    return analytics.risk_distribution(demo_tables.reports(spark, sf))


@register
def system_stats(spark, sf):
    return analytics.system_stats(demo_tables.reports(spark, sf))


@register
def value_counts(spark, sf):
    return profile.value_counts(demo_tables.reports(spark, sf), "crime_type")


@register
def frequent_values(spark, sf):
    return profile.frequent_values(demo_tables.reports(spark, sf), "investigation_officer", 5)


@register
def topk_categories(spark, sf):
    return profile.top_categories(demo_tables.complaints(spark, sf))


@register
def dataset_summary(spark, sf):
    return analytics.dataset_summary(demo_tables.complaints(spark, sf))


@register
def dataset_breakdown(spark, sf):
    return analytics.dataset_breakdown(demo_tables.complaints(spark, sf))


@register
def distinct_counts(spark, sf):
    rows = demo_tables.complaints(spark, sf)
    return profile.distinct_counts(rows, ["complaint_state", "complaint_city", "investigation_officer"])


@register
def numeric_profile(spark, sf):
    return profile.numeric_profile(demo_tables.gappy_complaints(spark, sf))


@register
def column_profile(spark, sf):
    return profile.column_profile(demo_tables.gappy_complaints(spark, sf))


@register
def date_range(spark, sf):
    return profile.date_range(demo_tables.reports(spark, sf))


@register
def peak_times(spark, sf):
    return profile.peak_times(demo_tables.reports(spark, sf))


@register
def city_stats(spark, sf):
    return analytics.city_stats(demo_tables.complaints(spark, sf))


@register
def city_stats_by_state(spark, sf):
    return analytics.city_stats(demo_tables.complaints(spark, sf), by_state=True)


@register
def state_stats(spark, sf):
    return analytics.state_stats(demo_tables.complaints(spark, sf))


@register
def state_distribution(spark, sf):
    return analytics.state_distribution(demo_tables.complaints(spark, sf))


@register
def high_risk_zones(spark, sf):
    return analytics.high_risk_zones(demo_tables.complaints(spark, sf))


@register
def crime_type_analysis(spark, sf):
    return analytics.crime_type_analysis(demo_tables.complaints(spark, sf))


@register
def bank_incidents(spark, sf):
    return analytics.bank_incidents(demo_tables.reports(spark, sf))


@register
def month_counts(spark, sf):
    return analytics.month_counts(demo_tables.reports(spark, sf))


@register
def summary_row(spark, sf):
    return analytics.summary_row(demo_tables.complaints(spark, sf))


@register
def weekly_trend(spark, sf):
    return analytics.weekly_trend(demo_tables.reports(spark, sf))


@register
def hourly_distribution(spark, sf):
    return analytics.hourly_distribution(demo_tables.reports(spark, sf))


@register
def monthly_trend(spark, sf):
    return analytics.monthly_trend(demo_tables.reports(spark, sf), F.lit("2024-03-15").cast("date"))


@register
def growth(spark, sf):
    return analytics.crime_growth(demo_tables.reports(spark, sf), "week")


@register
def correlations(spark, sf):
    found = profile.correlations(_prepared(spark, sf), floor=contract.LIMITS.correlation_floor)
    return found.withColumn("r", F.round("r", 6))


@register
def geo_error(spark, sf):
    found = metrics.geo_error(
        demo_tables.complaints(spark, sf),
        ("complaint_lat", "complaint_lng"),
        ("predicted_withdrawal_lat", "predicted_withdrawal_lng"),
        radii_km=(0.5, 1.0, 5.0, 25.0),
        digits=4,
    )
    return found.select([F.round(c, 4).alias(c) for c in found.columns])


@register
def regression_metrics(spark, sf):
    rows = demo_tables.complaints(spark, sf).withColumn("p_hat", scoring.rule_probability())
    rows = rows.withColumn("score_hat", F.col("p_hat") * 100)
    found = metrics.regression_metrics(rows, {"withdrawal_probability": "p_hat", "risk_score": "score_hat"})
    return found.select([F.round(c, 6).alias(c) for c in found.columns])


@register
def classification_metrics(spark, sf):
    rows = demo_tables.complaints(spark, sf).select(
        (F.col("withdrawal_probability") > 0.8).cast("int").alias("y"),
        (scoring.rule_probability() > 0.3).cast("int").alias("y_hat"),
    )
    found = metrics.classification_metrics(rows, "y", "y_hat")
    return found.select([F.round(c, 9).alias(c) for c in found.columns])


# --- quality ------------------------------------------------------------------


@register
def contract_query(spark, sf):
    rows = quality.require_contract(_prepared(spark, sf), types_too=True)
    return quality.contract_report(rows.withColumn("jurisdiction", F.col("complaint_state")).drop("bank_involved"))


def _strict_limits() -> contract.Limits:
    return contract.Limits(latitude=(13.0, 28.0), longitude=(73.0, 88.0))


@register
def content_checks(spark, sf):
    return quality.content_checks(demo_tables.complaints(spark, sf), _strict_limits())


@register
def quarantine(spark, sf):
    _, held = quality.split_by_quality(demo_tables.complaints(spark, sf), _strict_limits())
    return held.select("complaint_id", F.array_join("violations", ",").alias("violations"))


@register
def valid_rows(spark, sf):
    kept, _ = quality.split_by_quality(demo_tables.complaints(spark, sf), _strict_limits())
    return kept.select("complaint_id", "amount_lost")


@register
def mean_drift(spark, sf):
    train, test = splits.train_test(demo_tables.complaints(spark, sf))
    report = quality.mean_drift(train, test, threshold=0.001)
    # a mean is a sum of doubles taken in no fixed order: compare rounded
    return report.select(
        "column_name",
        F.round("base_mean", 6).alias("base_mean"),
        F.round("current_mean", 6).alias("current_mean"),
        F.round("drift_ratio", 9).alias("drift_ratio"),
        "drift_detected",
    )


@register
def ks_drift(spark, sf):
    train, test = splits.train_test(demo_tables.complaints(spark, sf))
    report = quality.ks_drift(train, test)
    return report.select(
        "column_name",
        "base_rows",
        "current_rows",
        F.round("ks_statistic", 9).alias("ks_statistic"),
        F.round("p_value", 6).alias("p_value"),
        "drift_detected",
    )


@register
def split(spark, sf):
    return splits.with_split(demo_tables.reports(spark, sf)).select("complaint_id", "split")


# --- predictions and logs -----------------------------------------------------


def _rounded_predictions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            c: F.round(c, 6)
            for c in ("predicted_withdrawal_lat", "predicted_withdrawal_lng", "alert_radius_km")
            if c in df.columns
        }
    )


@register
def bulk_score(spark, sf):
    rows = demo_tables.complaints(spark, sf).select(*contract.SCORING_INPUT, "timestamp")
    limits = contract.Limits(bulk_high=0.6, bulk_medium=0.3)
    return scoring.bulk_score(rows, F.lit(AS_OF), limits).select(*scoring.RESULT_COLUMNS).transform(_rounded_predictions)


@register
def bulk_high_risk(spark, sf):
    rows = demo_tables.complaints(spark, sf).select(*contract.SCORING_INPUT, "timestamp")
    return scoring.high_risk_count(scoring.bulk_score(rows, F.lit(AS_OF), contract.Limits(bulk_high=0.6)))


@register
def result_page(spark, sf):
    return scoring.result_page(_scored(spark, sf), 10).transform(_rounded_predictions)


@register
def single_score(spark, sf):
    """Requests without a time are scored as of the time of the run."""
    rows = demo_tables.complaints(spark, sf).select(*contract.SCORING_INPUT)
    return scoring.score(rows, F.lit(AS_OF)).select(*scoring.RESULT_COLUMNS).transform(_rounded_predictions)


@register
def heatmap_query(spark, sf):
    recent = _log(spark, sf).transform(clean.within_days, F.lit(AS_OF), 14)
    found = heatmap.risk_heatmap(recent)
    return found.withColumn("risk_score", F.round("risk_score", 6))


@register
def heatmap_city(spark, sf):
    city = _log(spark, sf).transform(clean.where_equal, "input_data.complaint_city", CITY)
    return heatmap.risk_heatmap(city, 1).withColumn("risk_score", F.round("risk_score", 6))


@register
def recent_counts(spark, sf):
    return heatmap.recent_counts(_log(spark, sf), F.lit(AS_OF), 7)


@register
def rolling_heatmap(spark, sf):
    found = heatmap.rolling_heatmap(_log(spark, sf), 30, 2).withColumn("risk_score", F.round("risk_score", 6))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@register
def rolling_counts(spark, sf):
    found = heatmap.rolling_counts(_log(spark, sf), 7)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@register
def alerts(spark, sf):
    return scoring.alerts(_scored(spark, sf)).select(
        "alert_id",
        "complaint_id",
        "alert_type",
        "message",
        F.round(F.col("location")["lat"], 6).alias("lat"),
        F.round(F.col("location")["lng"], 6).alias("lng"),
        times.iso_text(_ts()).alias("timestamp"),
        "severity",
    )


def recipient_role():
    """A recipient role per alert, spread over the three kinds."""
    return F.get(F.array(F.lit("lea"), F.lit("bank"), F.lit("other")), draws.bucket(F.col("complaint_id"), 3))


@register
def alert_routing(spark, sf):
    return scoring.route(scoring.alerts(_scored(spark, sf)), recipient_role()).select("alert_id", "recipient")


@register
def notifications(spark, sf):
    log = scoring.notifications(scoring.alerts(_scored(spark, sf)), recipient_role())
    return scoring.latest_notifications(log, 50).transform(_text_time)


# --- stored tables --------------------------------------------------------------


@register
def json_records(spark, sf):
    return writers.json_records(
        demo_tables.reports(spark, sf).select("complaint_id", "crime_type", "amount_lost", "status")
    )


@register
def csv_json_roundtrip(spark, sf):
    base = new_folder(spark, "export") + "/complaints"
    _, csv_path = writers.export_both(demo_tables.complaints(spark, sf), base)
    sides = {"json": readers.load_complaints(spark, base), "csv": readers.read_csv(spark, csv_path)}
    shown = [
        rows.transform(_text_time).select(F.lit(name).alias("source"), *contract.RAW_COLUMNS)
        for name, rows in sides.items()
    ]
    return shown[0].unionByName(shown[1])


@register
def json_array_roundtrip(spark, sf):
    """Files of one JSON array each, a thousand complaints at most."""
    folder = new_folder(spark, "arrays")
    rows = demo_tables.complaints(spark, sf).transform(_text_time)
    thousand = F.floor(F.substring("complaint_id", 7, 20).cast("bigint") / 1000)
    whole = rows.groupBy(thousand.alias("thousand")).agg(F.collect_list(F.struct(*contract.RAW_COLUMNS)).alias("records"))
    # a text file of one row is one array
    texts = whole.select(F.to_json("records", {"ignoreNullFields": "false"}).alias("value"))
    texts.write.option("maxRecordsPerFile", 1).text(f"{folder}/data.json")
    found = readers.load_complaints(spark, f"{folder}/data")
    return found.transform(_text_time).select("complaint_id", "timestamp", "crime_type", "amount_lost", "status")


@register
def score_gappy(spark, sf):
    """Scores of complaints whose amount, place or time is missing or no number."""
    rows = demo_tables.damaged_complaints(spark, sf).drop(*scoring.RESULT_COLUMNS[1:])
    p = scoring.rule_probability()
    low, high = risk.hours_band(p)
    limits = contract.LIMITS
    base = risk.base_risk(F.col("amount_lost"), F.col("urgency_level"))
    return rows.select(
        "complaint_id",
        F.round(p, 3).alias("withdrawal_probability"),
        low.alias("hours_from"),
        high.alias("hours_before"),
        risk.risk_level(p, limits.single_high, limits.single_medium).alias("risk_level"),
        F.round(risk.confidence(p), 3).alias("confidence_score"),
        F.round(base, 9).alias("base_risk"),
        risk.model_hours(base).alias("model_hours"),
        money.serving_amount_level(F.col("amount_lost")).alias("serving_level"),
        money.amount_risk_level(F.col("amount_lost")).alias("amount_level"),
        money.requires_bank_alert(F.col("amount_lost"), F.col("urgency_level")).alias("bank_alert"),
        money.alert_priority(F.lit(0.0), F.col("amount_lost")).alias("priority"),
    )


@register
def distance_gappy(spark, sf):
    at = F.col("complaint_lat"), F.col("complaint_lng")
    to = F.col("predicted_withdrawal_lat"), F.col("predicted_withdrawal_lng")
    return demo_tables.damaged_complaints(spark, sf).select(
        "complaint_id", F.round(geo.haversine_km(*at, *to), 4).alias("distance_km"), geo.city_factor(*at).alias("city_factor")
    )


@register
def alerts_gappy(spark, sf):
    """No alert without a probability."""
    rows = demo_tables.damaged_complaints(spark, sf).drop(*scoring.RESULT_COLUMNS[1:])
    return scoring.alerts(scoring.score(rows, high=ALERT_LIMIT)).select("alert_id", "complaint_id", "severity")


@register
def ingest_roundtrip(spark, sf):
    folder = new_folder(spark, "ingest")
    source = demo_tables.gappy_complaints(spark, sf)
    source.repartition(3, "complaint_id").write.options(**writers.CSV_OPTIONS).csv(f"{folder}/upload.csv")
    writers.ingest(spark, f"{folder}/upload.csv", f"{folder}/published")
    return (
        readers.read_stage(spark, f"{folder}/published")
        .transform(_text_time)
        .select("complaint_id", "timestamp", "amount_lost", "alert_priority", "hour", "day_of_week")
    )


@register
def sink_roundtrip(spark, sf):
    """Feature store, split, replaced and appended tables, then read back."""
    base, run = new_folder(spark, "stages"), "2024-01-31"
    stored = writers.write_feature_store(
        splits.with_split(_prepared(spark, sf)), writers.stage_path(base, run, "feature_store")
    )
    split_path = writers.stage_path(base, run, "split")
    writers.write_split(stored, split_path)
    table = writers.stage_path(base, run, "published")
    writers.replace_table(readers.read_split(spark, split_path, "test"), table)
    added = writers.append_table(readers.read_split(spark, split_path, "train"), table)
    report = writers.stage_path(base, run, "report")
    writers.write_report(analytics.risk_distribution(readers.read_stage(spark, table)), report)
    stored_report = spark.read.schema("high bigint, medium bigint, low bigint, total bigint").json(report)
    return stored_report.withColumn("appended", F.lit(added).cast("bigint"))


@register
def prediction_log(spark, sf):
    """Append the log, then read part of it back by time, city and level."""
    path = new_folder(spark, "predictions")
    writers.append_prediction_log(_log(spark, sf), path)
    found = readers.read_prediction_log(spark, path, AS_OF, 10, city=CITY, risk_level="HIGH")
    return found.select(
        "complaint_id",
        times.iso_text(_ts()).alias("timestamp"),
        F.col("input_data.amount_lost").alias("amount_lost"),
        F.col("prediction.withdrawal_probability").alias("withdrawal_probability"),
        F.date_format("log_date", "yyyy-MM-dd").alias("log_date"),
        "model_version",
    )


@register
def bulk_output(spark, sf):
    rows = demo_tables.complaints(spark, sf).select(*contract.SCORING_INPUT, "timestamp")
    scored = scoring.bulk_score(rows, F.lit(AS_OF), contract.Limits(bulk_high=0.6, bulk_medium=0.3))
    path = writers.write_bulk_result(scored, new_folder(spark, "bulk"), "20240131T000000")
    return readers.read_stage(spark, path).select("complaint_id", "withdrawal_probability", "risk_level")
