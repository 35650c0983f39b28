"""Explicit schemas of the stored relations."""

GPS = "survey_id bigint, seq bigint, timestamp_s double, lat double, lon double, accuracy_m double, speed_mps double"
DETECTION = (
    "survey_id bigint, track_id bigint, class_name string, frame_idx bigint, x1 double, y1 double, x2 double, "
    "y2 double, confidence double, frame_w int, frame_h int"
)
SURVEY = "survey_id bigint, surveyed_on date, route_name string, source string, status string, created_at timestamp"
DEFECT = (
    "defect_id bigint, class_name string, lat double, lon double, severity string, priority double, "
    "estimated_cost double, area_px bigint, confidence double, bbox_x1 double, bbox_y1 double, bbox_x2 double, "
    "bbox_y2 double, status string, recurrence boolean, unverified boolean, matched_prev_id bigint, "
    "crop_path string, review_status string, survey_id bigint"
)
SEGMENT = "segment_id bigint, start_m double, end_m double, damage_index double, condition string, survey_id bigint"
OSM_CACHE = (
    "highways array<struct<tags:map<string,string>,geometry:array<array<double>>>>, "
    "amenities array<struct<tags:map<string,string>,lat:double,lon:double>>"
)
OSM_RAW = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,"
    "geometry:array<struct<lat:double,lon:double>>>>"
)
