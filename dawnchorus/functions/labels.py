"""Fixed values that must equal the reference's for identical results.

Kept together, in their natural order, as plain text.
"""

# --- fixed values -----------------------------------------------------------
# Meteorological seasons, in factor order.
SEASONS = ["Frühling", "Sommer", "Herbst", "Winter"]
# Months of each season (same order as SEASONS).
SEASON_MONTHS = [[3, 4, 5], [6, 7, 8], [9, 10, 11], [12, 1, 2]]

# Precipitation indicator labels for codes 0 and 1.
PRECIPITATION_LABELS = ["kein Niederschlag", "Niederschlag"]

# Cloud cover labels for okta codes 0 to 8.
CLOUD_LABELS = [
    "wolkenlos",
    "sonnig",
    "heiter",
    "leicht bewölkt",
    "wolkig",
    "bewölkt",
    "stark bewölkt",
    "fast bedeckt",
    "bedeckt",
]

# Weather variables requested from the station index.
WEATHER_VARIABLES = [
    "air_temperature",
    "pressure",
    "soil_temperature",
    "sun",
    "cloudiness",
    "precipitation",
    "wind",
]

# Raw weather observation columns -> weather schema names.
WEATHER_RENAMES = {
    "tt_tu_lufttemperatur": "lufttemperatur",
    "rf_tu_relative_feuchte": "luftfeuchtigkeit",
    "p_luftdruck_nn": "luftdruck",
    "v_te005_erdbodentemperatur_005cm": "bodentemperatur",
    "r1_niederschlagshoehe": "niederschlagshoehe",
    "sd_so_sonnenscheindauer": "sonnenscheindauer",
    "f_windgeschwindigkeit": "windgeschwindigkeit",
}

# Regression terms -> readable names in the coefficient chart.
TERM_LABELS = {
    "lufttemperatur_in_grad": "Lufttemperatur",
    "luftfeuchtigkeit_in_prozent": "Luftfeuchtigkeit",
    "luftdruck_in_hpa": "Luftdruck",
    "bodentemperatur_in_grad": "Erdbodentemperatur",
    "niederschlagshoehe_in_mm": "Niederschlagshöhe",
    "sonnenscheindauer_in_min": "Sonnenscheindauer",
    "bedeckungsgrad_in_okta": "Bewölkung",
    "windgeschwindigkeit_in_m_pro_s": "Windgeschwindigkeit",
}

# Column labels of the five report tables.  Where the printed table sets two columns of one
# label under the headings of two groups, the heading stands before the label.
TABLE_LABELS = {
    "top_bottom_vogelarten": {
        "rang": "Rang", "top10": "Top 10 Vogelarten", "top10_haeufigkeit": "Top 10 Erkennungen",
        "bottom10": "Bottom 10 Vogelarten", "bottom10_haeufigkeit": "Bottom 10 Erkennungen"},
    "vogelarten_haeufigkeiten": {
        "rang": "Rang", "deutscher_name": "Deutscher Name",
        "wissenschaftlicher_name": "Wissenschaftlicher Name", "absolut": "Absolut", "relativ": "Relativ"},
    "woechentliche_veraenderungen": {"deutscher_name": "Vogelart"},
    "neue_vogelarten": {"nummer": "Nr."},
    "unterbrechungen": {"beginn": "Beginn", "ende": "Ende", "dauer_in_tage": "Dauer in tage"},
}

# Thresholds and defaults.
MIN_OBSERVATIONS = 10          # detections a species needs to be counted
MIN_PER_DAY = 250              # detections of a normal (complete) day
PERIOD_FROM = "2024-03-01"     # earliest start of the observation period
STATION_RADIUS_KM = 50         # search radius around the microphone
STUDY_SPECIES = "Amsel"        # species of the event study
STUDY_START = "2024-03-01"
STUDY_END = "2024-12-31"
STUDY_MARK_FROM = "2024-05-01"
SIGNIFICANCE = 0.05
CI_Z = 1.96
EARTH_RADIUS_KM = 6371.0
# ---------------------------------------------------------------------------
