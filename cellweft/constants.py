"""They must equal the published ones for results to agree."""

# Request types that count as an event, after normalisation (fixed values).
TARGET_REQUEST_TYPES = (
    "MAIN BREAK",
    "WATER BREAK",
    "WATER MAIN",
    "WATER MAIN BREAK",
)
EVENT_COLUMNS = ("objectid", "reqtype", "category", "createddate", "cell_id")
PAGE_SIZE = 1_000
MAX_PAGES = 500

# Service extent in degrees: west, south, east, north (fixed values).
EXTENT = (-76.35, 45.25, -75.50, 45.60)
MAX_BBOX_SPAN = 0.5
MIN_BBOX_SPAN = 0.02
DEFAULT_MAP_FEATURES = 500
MAX_MAP_FEATURES = 2_000

# Hourly file headers and the column each becomes (fixed values).
HOURLY_COLUMNS = {
    "Date/Time (LST)": "timestamp",
    "Climate ID": "climate_id",
    "Station Name": "station_name",
    "Temp (°C)": "temperature_c",
    "Dew Point Temp (°C)": "dew_point_c",
    "Rel Hum (%)": "relative_humidity",
    "Precip. Amount (mm)": "precip_mm",
    "Wind Spd (km/h)": "wind_speed_kmh",
    "Stn Press (kPa)": "pressure_kpa",
}
HOURLY_REQUIRED = (
    "Date/Time (LST)",
    "Temp (°C)",
    "Rel Hum (%)",
    "Precip. Amount (mm)",
)
HOURLY_NUMERIC = (
    "temperature_c",
    "dew_point_c",
    "relative_humidity",
    "precip_mm",
    "wind_speed_kmh",
    "pressure_kpa",
)
OBSERVATION_COLUMNS = (
    "timestamp",
    "station_id",
    "climate_id",
    "station_name",
    *HOURLY_NUMERIC,
)
WEATHER_REQUIRED = ("timestamp", "temperature_c", "relative_humidity", "precip_mm")

# Weather thresholds and the heat-index regression in Fahrenheit, as
# (coefficient, power of temperature, power of humidity) (fixed values).
DRY_HOUR_MM = 0.2
HEAT_INDEX_MIN_F = 80.0
HEAT_INDEX_TERMS = (
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-0.00683783, 2, 0),
    (-0.05481717, 0, 2),
    (0.00122874, 2, 1),
    (0.00085282, 1, 2),
    (-0.00000199, 2, 2),
)

# Cell feature columns and what an empty cell gets (fixed values).
CELL_FEATURE_COLUMNS = (
    "cell_id",
    "centroid_lat",
    "centroid_lon",
    "line_length_km_water",
    "line_count_water",
    "line_length_km_road",
    "line_count_road",
    "building_count",
    "median_year_built",
    "pct_pre_1980",
)
AGGREGATE_FEATURE_COLUMNS = CELL_FEATURE_COLUMNS[1:]
CELL_DEFAULTS = {
    "line_length_km_water": 0.0,
    "line_count_water": 0,
    "line_length_km_road": 0.0,
    "line_count_road": 0,
    "building_count": 0,
    "median_year_built": 1980.0,
    "pct_pre_1980": 0.0,
}
YEAR_BUILT_RANGE = (1600, 2100)
VINTAGE_YEAR = 1980

# Label rule, split and training settings (fixed values).
LABEL = "break_in_next_48h"
RULE_DEFAULTS = {
    "line_length_km_water": 0.0,
    "pct_pre_1980": 0.0,
    "heat_index_c": 20.0,
    "consecutive_dry_days": 0.0,
    "rainfall_48h": 0.0,
}
PREDICTION_HORIZON_HOURS = 48
MAX_TRAINING_DAYS = 92
MIN_TRAINING_DAYS = 10
TRAIN_FRACTION = 0.60
VALIDATION_FRACTION = 0.20
ARTIFACT_SCHEMA_VERSION = 1
SOURCE_MODES = ("mock", "hybrid", "live")
TARGET_MODES = ("synthetic", "observed")

# Display bands (fixed values).
HIGH_RISK = 0.70
MEDIUM_RISK = 0.30

# Metric plane EPSG:3347: GRS80, two standard parallels (fixed values).
SEMI_MAJOR_M = 6378137.0
INVERSE_FLATTENING = 298.257222101
PARALLELS = (49.0, 77.0)
ORIGIN_LAT = 63.390675
ORIGIN_LON = -91.86666666666666
FALSE_EASTING = 6200000.0
FALSE_NORTHING = 3000000.0

# Mean hexagon edge at resolution 8, kilometres (fixed value); each finer
# resolution divides the edge by the square root of seven.
EDGE_KM_RES_8 = 0.531414010
DEFAULT_RESOLUTION = 8
