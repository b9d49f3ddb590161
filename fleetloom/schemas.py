"""Schemas of the records that streams carry and of the tables, written out: JSON is never inferred."""

from __future__ import annotations

# The enumerations of the records.
VAN_STATUS = ("EN_ROUTE", "DELIVERING", "IDLE", "RETURNING", "RETURNED")
DELIVERY_EVENT_TYPE = ("ARRIVAL", "DELIVERY_COMPLETED", "DELIVERY_FAILED", "DEPARTURE")
RISK = ("NONE", "WARNING", "CRITICAL", "UNKNOWN")

LOCATION = "struct<latitude:double,longitude:double>"

GPS_EVENT = (
    f"event_id string, van_id string, sequence_number bigint, device_timestamp timestamp, ingestion_timestamp timestamp, location {LOCATION}, "
    "speed_kmh double, heading_degrees double, battery_pct int, route_id string, current_stop_index int, total_stops int, status string"
)
DELIVERY_EVENT = (
    "event_id string, van_id string, route_id string, stop_index int, customer_id string, event_type string, timestamp timestamp, "
    f"location {LOCATION}, parcels_delivered int, delivery_duration_seconds int, sla_deadline timestamp, total_stops int, notes string"
)
STOP = f"struct<stop_index:int,customer_id:string,location:{LOCATION},sla_deadline:timestamp,planned_arrival:timestamp,parcels:int,waypoint_index:int>"
ROUTE_PLAN = (
    "route_id string, van_id string, version int, created_at timestamp, time_scale double, base_speed_kmh double, "
    f"stops array<{STOP}>, waypoints array<array<double>>"
)
ASSIGNMENT = (
    "order_id string, van_id string, route_id string, latitude double, longitude double, insert_before int, stops_after_insert int, extra_km double, "
    "predicted_arrival timestamp, sla_deadline timestamp, stops_made_late int, on_time boolean, options_considered int, created_at timestamp"
)
LIVE_VANS = (
    "van_id string, route_id string, status string, lat double, lon double, speed_kmh double, battery_pct int, current_stop int, total_stops int, "
    "eta_seconds bigint, sla_risk string, slack_seconds bigint, in_zone boolean, zone_name string, updated_epoch_ms bigint"
)
GEOFENCE_ZONES = (
    "id string, name string, zone_type string, geometry string, speed_factor decimal(3,2), active boolean, created_at timestamp, updated_at timestamp"
)
COMPLETED_ROUTES = (
    "id string, route_id string, van_id string, planned_start timestamp, actual_start timestamp, planned_end timestamp, actual_end timestamp, "
    "total_stops int, completed_stops int, failed_stops int, total_distance_km decimal(8,2), total_duration_min decimal(8,2), "
    "avg_speed_kmh decimal(5,2), battery_start_pct smallint, battery_end_pct smallint, status string, created_at timestamp, "
    "plan_version int, time_scale decimal(6,2), planned_distance_km decimal(8,2)"
)
DELIVERY_LOGS = (
    f"id string, event_id string, route_id string, van_id string, stop_index int, customer_id string, location {LOCATION}, sla_deadline timestamp, "
    "actual_arrival timestamp, actual_departure timestamp, parcels_delivered int, delivery_status string, sla_breached boolean, breach_seconds int, created_at timestamp"
)
SLA_BREACHES = (
    "id string, event_id string, route_id string, van_id string, stop_index int, customer_id string, sla_deadline timestamp, predicted_arrival timestamp, "
    "actual_arrival timestamp, breach_seconds int, severity string, cause string, geofence_id string, detected_at timestamp"
)
DEAD_LETTER_LOG = (
    "original_topic string, van_id string, event_payload string, error_reason string, reconciled boolean, created_at timestamp, reconciled_at timestamp"
)
