"""Schemas of the listing domain's tables as DDL, and creation of those that are missing."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

_RING = "array<array<struct<x:double,y:double>>>"
SCHEMAS = {
    "currencies": "code string, exponent smallint",
    "fx_rates": "base string, quote string, rate decimal(20,10), rate_date date, source string",
    "zones": f"id bigint, country string, level string, parent_id bigint, external_code string, name string, rings {_RING}, source string",
    "zone_reference_prices": "zone_id bigint, deal_type string, property_type string, price_min_minor bigint, price_max_minor bigint, currency string, unit string, period_start date, data_kind string, source string",
    "attribute_registry": "country string, key string, data_type string, allowed_values array<string>, used_in_pricing boolean, label string, source_evidence string, value_min decimal(20,4), value_max decimal(20,4)",
    "sources": "source_id string, name string, domain string, country string, state string, cooldown_until timestamp, url_check_allowed boolean, cooldown_strikes int, rate_factor double, paused_at timestamp, pause_reason string",
    "objects": ("id bigint, country string, property_country string, deal_type string, zone_id bigint, lng double, lat double, address string, area_sqm decimal(10,2), rooms smallint, property_type string, attributes map<string,string>, attributes_unmapped map<string,string>, "
                "current_price_minor bigint, currency string, title string, description_original string, language_original string, status string, delisted_reason string, match_confidence string, posted_date_unreliable boolean, first_seen_at timestamp, last_seen_at timestamp, "
                "delisted_at timestamp, geo_confidence string, geo_source string, seller_type string, seller_name string, detail_fetched_at timestamp, detail_hash string, zone_dirty boolean, zone_terminal boolean"),
    "search_configs": "config_id bigint, source_id string, country string, deal_type string, property_type string, filter_attributes map<string,string>, min_area_sqm decimal(10,2), max_area_sqm decimal(10,2), min_price_minor bigint, max_price_minor bigint, currency string, active boolean, created_at timestamp, updated_at timestamp",
    "scan_runs": "run_id bigint, source_id string, config_id bigint, started_at timestamp, finished_at timestamp, completeness string, failure_kind string, listings_found int, new_objects int",
    "raw_listings": "id bigint, run_id bigint, source_id string, external_id string, source_url string, fetched_at timestamp, price_minor bigint, currency string, area_sqm decimal(10,2), rooms smallint, property_type string, lng double, lat double, address string, posted_at timestamp, attributes map<string,string>, description_original string",
    "object_listings": "object_id bigint, source_id string, external_id string, raw_listing_id bigint, match_method string, match_confidence string, first_matched_at timestamp",
    "price_history": "id bigint, object_id bigint, source_id string, price_minor bigint, currency string, change_at timestamp",
    "object_translations": "object_id bigint, lang string, source_hash string, text string, model string, token_cost int, translated_at timestamp",
    "valuations": "id bigint, object_id bigint, model_version string, price_deviation decimal(8,5), deviation_null_reason string, predicted_price_minor bigint, interval_low_minor bigint, interval_high_minor bigint, sample_size int, r_squared decimal(6,4), zone_fallback boolean, computed_at timestamp",
    "liquidity_estimates": "object_id bigint, horizon_days int, hazard_probability decimal(6,5), null_reason string, model_version string, events_in_training int, computed_at timestamp",
    "liquidity_models": "id bigint, model_version string, country string, deal_type string, status string, reject_reason string, horizon_days int, n_completed_events int, n_train int, n_test int, calibration array<struct<decile:int,predicted:double,actual:double,n:bigint>>, max_calib_dev decimal(6,4), brier_score decimal(8,5), c_index decimal(6,4), params map<string,double>, computed_at timestamp",
    "scan_windows": "window_id bigint, source_id string, country string, day_of_week smallint, hour_start smallint, hour_end smallint, timezone string, weight decimal(8,4), max_requests_per_hour int",
    "scan_yield": "source_id string, slot_key string, day date, scans bigint, new_objects bigint",
    "notifications": "id bigint, channel string, recipient string, queue_ns string, kind string, payload map<string,string>, status string, error string, created_at timestamp, sent_at timestamp",
    "attribute_values": "object_id bigint, attr_key string, extracted_by string, confidence decimal(4,3), model string, attr_list_version string, source_hash string, extracted_at timestamp",
    "object_photos": "object_id bigint, ord smallint, original_url string, file_card string, file_list string, download_error string",
    "llm_extractions": "object_id bigint, model string, attr_list_version string, source_hash string, tokens int, extracted_at timestamp",
    "attribute_templates": "id bigint, country string, attr_key string, pattern_type string, pattern string, value string, status string, confidence double, source string, evidence string, occurrences bigint, conflicts bigint, example_object_ids array<bigint>, last_ids array<bigint>, promoted_at timestamp, demoted_at timestamp, shadow_mismatches bigint",
    "template_shadow_checks": "template_id bigint, object_id bigint, attr_key string, template_value string, status string, llm_value string, checked_at timestamp, created_at timestamp",
    "geocode_cache": "query_norm string, lat double, lng double, nominatim_type string, hit boolean, fetched_at timestamp",
    "source_candidates": "domain string, discovered_via string, class string, class_reason string, evidence_path string, probed_at timestamp, channel string, mirror_of string, created_at timestamp",
}
#: Tables by the column that new files are split by, where a column of few values exists.
PARTITIONED = {"raw_listings": "source_id", "scan_yield": "day", "objects": "country"}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def create_missing(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the tables that the database lacks, as Parquet; the names of those made. Doing it again makes none."""
    made = []
    for name, columns in SCHEMAS.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            by = f" PARTITIONED BY ({PARTITIONED[name]})" if name in PARTITIONED else ""
            spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet{by}")
            made.append(name)
    return made
