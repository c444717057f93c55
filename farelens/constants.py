"""Fixed values that must equal the reference behaviour for equal results.

Everything here is a plain lookup table or list; the code that uses them is
in ``functions`` and ``operators``. Lists are defaults: every operator that
uses one takes it as a parameter.
"""

# --- fixed values: column renames of the clean fare file -------------------
CLEAN_RENAMES = {
    "source_city": "from",
    "destination_city": "to",
    "departure_time": "dep_time",
    "arrival_time": "arr_time",
    "stops": "stop",
}

# --- fixed values: base date used when only days_left is known -------------
DAYS_LEFT_BASE_DATE = "2024-01-01"

# --- fixed values: time label clean-up -------------------------------------
TIME_LABEL_FIXES = {
    "Early_Morning": "Early Morning",
    "Late_Night": "Night",
    "early_morning": "Early Morning",
    "late_night": "Night",
}

# --- fixed values: time slot numbers (default 3) ---------------------------
TIME_SLOTS = {
    "Early Morning": 1,
    "Morning": 2,
    "Afternoon": 3,
    "Evening": 4,
    "Night": 5,
    "Late Night": 6,
}
TIME_SLOT_DEFAULT = 3
PEAK_TIMES = ["Morning", "Evening"]

# --- fixed values: hour of a raw slot label (notebook feature set) ---------
SLOT_HOURS = {
    "Early_Morning": 6,
    "Morning": 9,
    "Afternoon": 14,
    "Evening": 18,
    "Night": 22,
    "Late_Night": 2,
}

# --- fixed values: seasons by month ------------------------------------------
SEASONS = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Spring", 4: "Spring", 5: "Spring",
    6: "Summer", 7: "Summer", 8: "Summer",
    9: "Autumn", 10: "Autumn", 11: "Autumn",
}
SEASON_CODES = {"Winter": 0, "Spring": 1, "Summer": 2, "Autumn": 3}

# --- fixed values: city and carrier lists ----------------------------------
MAJOR_CITIES = ["Delhi", "Mumbai", "Bangalore", "Chennai", "Kolkata", "Hyderabad"]
MAJOR_CITIES_FORM = ["Delhi", "Mumbai", "Bangalore", "Chennai"]
BUDGET_AIRLINES = ["SpiceJet", "IndiGo", "GO_FIRST", "AirAsia"]
BUDGET_AIRLINES_NOTEBOOK = ["SpiceJet", "IndiGo", "AirAsia", "GoAir"]
PREMIUM_AIRLINES = ["Vistara", "Air India"]

# --- fixed values: holiday impact scores (1-5; unknown name -> 3) ----------
HOLIDAY_IMPACT_SCORES = {
    "Diwali": 5,
    "Holi": 4,
    "Dussehra": 4,
    "Christmas Day": 5,
    "New Year's Day": 4,
    "Independence Day": 3,
    "Republic Day": 3,
    "Gandhi Jayanti": 3,
    "Eid al-Fitr": 4,
    "Eid al-Adha": 4,
    "Janmashtami": 3,
    "Ganesh Chaturthi": 3,
    "Baisakhi": 3,
    "Guru Nanak Jayanti": 2,
    "Good Friday": 2,
    "Ram Navami": 2,
    "Maha Shivratri": 2,
}
HOLIDAY_IMPACT_DEFAULT = 3
HOLIDAY_WINDOW_DAYS = 7

# --- fixed values: feature list of the model matrix -------------------------
NUMERIC_FEATURES = [
    "year", "month", "quarter", "day", "day_of_week", "day_of_year", "week_of_year",
    "is_weekend", "is_month_end", "route_popularity", "from_major_city", "to_major_city",
    "major_to_major", "dep_time_slot", "arr_time_slot", "is_peak_departure",
    "flight_hours", "flight_minutes", "total_flight_minutes", "airline_market_share",
    "fuel_price_usd_per_barrel", "fuel_price_inr_per_liter", "is_holiday",
    "holiday_impact_score", "is_holiday_season",
]
CATEGORICAL_FEATURES = [
    "airline", "from", "to", "class", "stop", "dep_time", "arr_time",
    "season", "duration_category", "airline_type", "route_type",
]
NOTEBOOK_CATEGORICALS = [
    "airline", "flight", "source_city", "destination_city",
    "departure_time", "arrival_time", "stops", "class",
    "route", "booking_category", "duration_category",
]

# --- fixed values: band edges (right-closed, left edge excluded) -----------
DURATION_MINUTE_BANDS = [(0, 120, "Short"), (120, 240, "Medium"), (240, 480, "Long"), (480, None, "Very Long")]
DURATION_HOUR_BANDS = [(0, 2, "Short"), (2, 4, "Medium"), (4, 8, "Long"), (8, None, "Very_long")]
BOOKING_BANDS = [(0, 7, "Last_minute"), (7, 21, "Short_term"), (21, 60, "Medium_term"), (60, None, "Long_term")]
BOOKING_WINDOW_BANDS = [
    (0, 7, "0-7 days"), (7, 14, "8-14 days"), (14, 30, "15-30 days"),
    (30, 60, "31-60 days"), (60, 90, "61-90 days"), (90, None, "90+ days"),
]

# --- fixed values: weekday names, Monday first -------------------------------
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- fixed values: booking optimiser and scenario defaults -------------------
BOOKING_DAYS_START, BOOKING_DAYS_STOP, BOOKING_DAYS_STEP = 1, 90, 7
PATTERN_BASE_PRICE = 7000.0
SCENARIO_DEFAULTS = {
    "route_popularity": 1000,
    "dep_time_slot": 2,
    "arr_time_slot": 4,
    "is_peak_departure": 1,
    "flight_hours": 2.5,
    "flight_minutes": 30,
    "total_flight_minutes": 150,
    "airline_market_share": 5000,
}
LITRE_FACTOR = 0.53

# --- fixed values: synthetic daily series -----------------------------------
SPINE_BASE_PRICE = 100.0
SPINE_SEASONAL_AMPLITUDE = 0.1
SPINE_TREND_PER_DAY = 0.0001
