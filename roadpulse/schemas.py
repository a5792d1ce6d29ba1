"""Declared schemas of the record layers, as DDL text. Nothing is inferred."""

from __future__ import annotations

_identity = "vehicle_id string, boot_id string, seq long"

#: One sample of one channel: values in three maps by type.
SIGNALS = (
    f"{_identity}, scene_id string, channel string, sensor_time timestamp, log_time timestamp, ingest_time timestamp, "
    "values_num map<string,double>, values_vec map<string,array<double>>, values_str map<string,string>, lat double, lon double"
)
#: One 3-D box of one keyframe.
PERCEPTION = (
    f"{_identity}, scene_id string, sample_id string, sensor_time timestamp, ingest_time timestamp, track_id string, category string, attribute string, "
    "center_x double, center_y double, center_z double, size_w double, size_l double, size_h double, rot_w double, rot_x double, rot_y double, rot_z double, "
    "visibility string, num_lidar_pts int, num_radar_pts int, lat double, lon double"
)
#: A pointer to a recording in object storage.
SEGMENTS = (
    f"{_identity}, segment_id string, scene_id string, blob_uri string, t_start timestamp, t_end timestamp, ingest_time timestamp, sensor_channels array<string>, "
    "size_bytes long, checksum string, sample_count int, state string, drop_reason string, calibration map<string,string>"
)
#: What a message broker's source gives.
ENVELOPE = ("topic string, partition int, offset long, key binary, value binary, headers array<struct<key string, value binary>>, timestamp timestamp")
ALERTS = (
    "eventId string, type string, severity string, vehicleId string, bootId string, sourceSeq long, eventTimeMs long, detectedAtMs long, location string, latitude double, longitude double, message string"
)
DEAD_LETTER = (
    "error_class string, error_step string, error_message string, original_value binary, original_key binary, vehicle_id string, boot_id string, source_boot_id string, seq long, kind string, stream_id string, report_interval_ms long, "
    "source_topic string, source_partition int, source_offset long, failed_at timestamp, headers array<struct<key string, value binary>>, attempt int, format_version int"
)
#: Tables of the storage job and the kind header of their records.
KINDS = {"signals": "RECORD_KIND_SIGNAL", "perception": "RECORD_KIND_PERCEPTION", "segments": "RECORD_KIND_SEGMENT_REF"}
