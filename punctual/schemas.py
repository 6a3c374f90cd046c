"""Schemas of the inputs that are written down."""

from __future__ import annotations

FLIGHTS = "YEAR int, QUARTER int, MONTH int, DAY_OF_MONTH int, DAY_OF_WEEK int, FL_DATE string, OP_UNIQUE_CARRIER string, TAIL_NUM string, ORIGIN string, DEST string, CRS_DEP_TIME int, DEP_DEL15 double, CANCELLED double"
WEATHER_RAW = "STATION string, DATE string, LATITUDE string, LONGITUDE string, ELEVATION string, HourlyAltimeterSetting string, HourlyDewPointTemperature string, HourlyDryBulbTemperature string, HourlyPrecipitation string, HourlyPresentWeatherType string, HourlyPressureChange string, HourlyPressureTendency string, HourlyRelativeHumidity string, HourlySkyConditions string, HourlySeaLevelPressure string, HourlyStationPressure string, HourlyVisibility string, HourlyWetBulbTemperature string, HourlyWindDirection string, HourlyWindGustSpeed string, HourlyWindSpeed string"
STATIONS = "station_id string, neighbor_id string, neighbor_call string, neighbor_name string, distance_to_neighbor double, lat double, lon double"
AIRPORT_CODES = "type string, name string, elevation_ft int, iso_country string, iso_region string, municipality string, gps_code string, iata_code string, local_code string, coordinates string"
ZONES = "iata_code string, zone string"
AUDIT = "dataset string, sequence int, step string, rows_after long"
RATINGS = "user_id int, movie_id int, rating float, timestamp long"
