"""Fixed values that results must agree on."""

from datetime import date

# Member names, their long names and service types.
CARRIERS = [
    ("Academy", "Academy Bus", "Regional"),
    ("Greyhound", "Greyhound Lines", "Intercity"),
    ("Martz", "Martz Trailways", "Regional"),
    ("NJ Transit", "NJ Transit", "Regional"),
    ("Lakeland", "Lakeland Bus", "Commuter"),
    ("Trailways", "Trailways", "Intercity"),
    ("Coach USA", "Coach USA Inc", "Commuter"),
    ("TransBridge", "TransBridge Lines", "Regional"),
    ("Peter Pan/Bonanza", "Peter Pan/Bonanza", "Intercity"),
    ("C & J Bus Lines", "C&J Bus Lines (Ceased)", "Intercity"),
    ("HCEE - Community", "HCEE Community Coach", "Commuter"),
    ("Total", "All Carriers Total", "Aggregate"),
]
CARRIER_NAMES = [name for name, _, _ in CARRIERS]

# Words that mark the carrier column of a sheet.
CARRIER_COLUMN_MARKERS = ["NJ Transit", "Martz", "Total", "Academy"]

# The row that sums all members, and its service type.
ROLLUP_CARRIER = "Total"
ROLLUP_SERVICE_TYPE = "Aggregate"

# Spellings of the months accepted in sheet labels.
MONTH_NUMBERS = {
    "Jan": 1, "January": 1,
    "Feb": 2, "February": 2,
    "Mar": 3, "March": 3,
    "Apr": 4, "April": 4,
    "May": 5,
    "Jun": 6, "June": 6,
    "Jul": 7, "July": 7,
    "Aug": 8, "August": 8,
    "Sep": 9, "Sept": 9, "September": 9,
    "Oct": 10, "October": 10,
    "Nov": 11, "November": 11,
    "Dec": 12, "December": 12,
}

# Abbreviations whose trailing dot is dropped from labels.
DOTTED_MONTHS = ["Jan", "Feb", "Mar", "Apr", "Sept", "Oct", "Nov", "Dec"]

# Status by calendar year; every other year is "Normal".
STATUS_BY_YEAR = {2020: "Lockdown", 2021: "Recovery", 2022: "Recovery", 2023: "Recovery"}
STATUS_DEFAULT = "Normal"

# Weather placeholders of the consolidated table.
WEATHER_PLACEHOLDERS = {
    "Avg_Temp_F": 50.0,
    "Precipitation_Inches": 0.1,
    "Snow_Inches": 0.0,
    "Weather_Condition": "Normal",
}

# Feature columns of the importance model, in model order.
FEATURE_COLUMNS = [
    "Year_Num", "Quarter", "Month_Num", "Week_Num",
    "Avg_Temp_F", "Precipitation_Inches", "Is_Severe_Weather",
    "Is_Holiday", "Is_Tourism_Peak", "Days_Since_Pandemic_Start",
    "Is_COVID_Period", "Is_High_Inflation",
    "Is_Summer", "Is_Winter", "Baseline_2019_Passengers",
]
FEATURE_TARGET = "Passenger_Departures"

# Forest size, depth and seed.
FOREST_TREES = 100
FOREST_DEPTH = 10
FOREST_SEED = 42

# Weeks forecast per series, and the baseline year.
FORECAST_WEEKS = 312
BASELINE_YEAR = 2019

# Fixed value: text of an absent event, and of an unknown weather condition.
NO_EVENT = "None"
UNKNOWN_CONDITION = "Unknown"

# Header search depth and carrier column search width of a sheet.
HEADER_ROWS = 40
CARRIER_COLUMNS = 10

# Suffixes of the service description (default first, then the older one).
SERVICE_SUFFIX = " transportation service"
SERVICE_SUFFIX_SHORT = " service"

# Normal quantile of an 80 % two-sided interval.
INTERVAL_Z = 1.28155

# Roles that the driver tables play (see FIXTURES.md section 5).
FIXTURE_BASELINE_YEAR = 1995
FIXTURE_REFERENCE_DATE = date(1997, 1, 1)
