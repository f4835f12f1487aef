"""Schemas of the tables, declared rather than inferred."""

from __future__ import annotations

LAYOUT = "sensor_index int, sensor_id string, layout_channel int, data_channel int, segment_id string, geometry_type string, burial_depth_cm double, x_cm double, y_cm double, z_cm double, analysis_role string"
STAGES = "stage_id int, stage_name string, start_time timestamp_ntz, end_time timestamp_ntz, center_time timestamp_ntz"
NUISANCE = "start_time timestamp_ntz, end_time timestamp_ntz, kind string, buffer_s int, hard_exclude boolean, note string"
REFERENCE_WINDOWS = "reference_class string, start_time timestamp_ntz, end_time timestamp_ntz, eligible_for_calibration boolean, note string"
RECORDS = "file_name string, start_ns bigint, end_ns bigint, fs double, sample_count bigint, channel_count int, start_channel int"
WAVEFORM_BLOCK = "experiment string, file_name string, channel int, block_start_ns bigint, fs double, samples array<float>"
PRIMITIVE = "key bigint, depth double, peak_us bigint, start_us bigint, end_us bigint, channel int, segment_id string, x_cm double, y_cm double, env array<double>, psd array<double>, score double"
EVENT = "event_id bigint, node bigint, peak_us bigint, start_us bigint, end_us bigint, activity double, event_type string, label string"
NODES = "node_index int, original_node_index int, node_id string, burial_depth_cm double, x_cm double, y_cm double, z_cm double, geometry_type string, stratum string, region string, selected boolean, raw_channels string, raw_channel_count int, segment_ids string, gauge_opportunity_profile string, gauge_support_channels string, permutation_group string"
CUMULATIVE = "minute_time timestamp_ntz, event_count int, activity_increment double, excluded_from_analysis boolean, cumulative_activity double, count_trailing_10min_mean double"
