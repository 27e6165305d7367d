"""Fixed values of the entry table: names, codes and constants.

Everything in this module must equal the data's conventions for results to be
right. Nothing here is computed.
"""

# Label columns that may be read from the entry table.
ALLOWED_LABELS = [
    "hr_OrderOfFinish", "hr_TimeDelta", "hr_PaybackWin",
    "hr_PaybackPlace", "hr_FinishingTime", "hr_Distance",
]

# Label and bookkeeping columns that are never model features.
PROCESS_FEATURES = [
    "hi_RaceID", "ri_Year", "hr_OrderOfFinish", "hr_Distance", "li_WinOdds", "pops_order",
    "margin", "hr_FinishingTime", "hr_TimeDelta", "norm_time", "div_time", "is_win", "is_place",
    "div_margin", "norm_margin", "hr_PaybackPlace", "hr_PaybackWin", "win_return",
    "place_return", "oof_over_pops", "pop_prediction",
]

# Extra columns the buy/skip run keeps out of its features, and the one it lets in.
POLICY_EXTRA_PROCESS_FEATURES = [
    "hi_Distance", "ri_Year", "hr_PaybackPlace_eval", "hr_PaybackWin_eval",
]
POLICY_ALLOWED_FEATURES = ["li_WinOdds"]

# Derived columns that hold codes.
DERIVED_CODES = [
    "hoof_size", "hoof_type", "distance_category", "grade_change", "inout_change",
    "leftright_change", "course_change", "has_pre1", "has_pre2", "has_pre3",
    "has_li", "has_ri", "has_ti",
]

# Columns the appended group z-score leaves out.
NOT_NORMALISED = [
    "hr_OrderOfFinish", "hr_PaybackWin", "hr_PaybackPlace", "hr_TimeDelta", "hr_FinishingTime",
    "is_win", "is_place", "win_return", "place_return", "margin", "norm_time", "pops_order",
    "ri_Year", "hi_Prize", "ri_Distance", "li_FiledStatus", "hi_Times", "ri_FirstPrize",
    "ri_SecondPrize", "ri_ThirdPrize", "ri_HaedCount", "ri_Month", "oof_over_pops",
    "pop_prediction",
]

# Columns that are equal within a group, scaled over the whole table.
GROUP_LEVEL_FEATURES = [
    "ri_Distance", "li_FieldStatus", "hi_Times", "ri_FirstPrize", "ri_HaedCount", "ri_Month",
    "li_WinOdds", "nige_ratio", "senko_ratio", "sasi_ratio", "oikomi_ratio", "kouji_ratio",
    "jizai_ratio", "null_count_raw", "season_sin", "season_cos", "pre1_Distance_raw",
    "pre2_Distance_raw", "pre3_Distance_raw",
]

# 0/1 columns no normaliser touches, and labels it leaves alone.
BINARY_FEATURES = ["has_pre1", "has_pre2", "has_pre3", "has_li", "has_ei"]
UNSCALED_LABELS = [
    "hr_OrderOfFinish", "ri_Year", "hi_RaceID", "hr_PaybackWin", "hr_PaybackPlace",
    "hr_PaybackWin_eval", "hr_PaybackPlace_eval",
]

# Presence columns the keep-or-drop step always drops.
ALWAYS_DROPPED = ["has_li", "has_ti", "has_ri"]

# Running-style code -> name of its share column.
STYLE_SHARES = {
    "1s": "nige_ratio", "2s": "senko_ratio", "3s": "sasi_ratio",
    "4s": "oikomi_ratio", "5s": "kouji_ratio", "6s": "jizai_ratio",
}

# Career-count families, and the three that make up the total.
CAREER_FAMILIES = [
    "Jra", "Inter", "Other", "Surf", "SurfDist", "Dist", "Rotation", "Course", "Jockey",
    "SurfaceGood", "SurfaceMiddle", "SurfaceBad", "SlowPace", "MiddlePace", "HighPace",
    "Season", "Frame", "JockeyDist", "JockeyTrack", "JockeyTrainer", "JockeyBrinker",
    "JockeyOwner", "TrainerOwner", "JockeyTrackDist",
]
CAREER_TOTAL_OF = ["Jra", "Inter", "Other"]

# Fixed values: (left, right, result) of the equality flags.
CHANGE_PAIRS = [
    ("pre1_Discipline", "ri_Discipline", "discipline_change"),
    ("pre1_RaceGrade", "ri_RaceGrade", "grade_change"),
    ("pre1_InOut", "ri_InOut", "inout_change"),
    ("pre1_LeftRight", "ri_LeftrRight", "leftright_change"),
    ("pre1_CourseCode", "ri_CourseCode", "course_change"),
]

# Fixed values: (minuend, subtrahend, result) of the difference columns.
DELTA_PAIRS = [
    ("li_HorseWeight", "pre1_Weight", "weight_delta"),
    ("pre1_Weight", "pre2_Weight", "weight_delta_pre1"),
    ("pre2_Weight", "pre3_Weight", "weight_delta_pre2"),
    ("li_BasisWeight", "pre1_BasisWeight", "basis_weight_delta"),
    ("pre1_OrderOfFinish", "pre1_Pass4", "nobi_pre1"),
    ("pre2_OrderOfFinish", "pre2_Pass4", "nobi_pre2"),
    ("pre3_OrderOfFinish", "pre3_Pass4", "nobi_pre3"),
    ("pre1_Pass4", "pre1_Pass3", "pass_delta_pre1"),
    ("pre2_Pass4", "pre2_Pass3", "pass_delta_pre2"),
    ("pre3_Pass4", "pre3_Pass3", "pass_delta_pre3"),
    ("ri_Distance", "pre1_Distance", "distance_delta"),
    ("pre1_Distance", "pre2_Distance", "distance_delta_1_2"),
    ("pre2_Distance", "pre3_Distance", "distance_delta_2_3"),
    ("pre1_First3FTime", "pre1_Last3FTime", "first_last_delta_pre1"),
    ("pre2_First3FTime", "pre2_Last3FTime", "first_last_delta_pre2"),
    ("pre3_First3FTime", "pre3_Last3FTime", "first_last_delta_pre3"),
]

# Fixed values: (later, earlier, result) of the elapsed-day columns.
DATE_PAIRS = [
    ("ri_Datetime", "pre1_RegisterdDate", "elapsed_time"),
    ("pre1_RegisterdDate", "pre2_RegisterdDate", "elapsed_time_1_2"),
    ("pre2_RegisterdDate", "pre3_RegisterdDate", "elapsed_time_2_3"),
]

# Id column -> its missing flag.
PRESENCE_FLAGS = {
    "pre1_RaceID": "has_pre1", "pre2_RaceID": "has_pre2", "pre3_RaceID": "has_pre3",
    "li_RaceID": "has_li", "ei_RaceID": "has_ei",
}

# Codes paired by target encoding, and the prefixes its names drop.
ENCODED_RACE_CODES = [
    "ri_Discipline", "distance_category", "li_FieldCode", "li_WeatherCode", "hi_FrameNumber",
]
ENCODED_ENTRY_CODES = [
    "hi_RunningType", "bi_MFPedigreeCode2", "bi_FPedigreeCode2", "hoof_type", "hoof_size",
    "hi_RunningStyle", "hi_SexCode", "bi_FatherName",
]
ENCODED_PREFIXES = ["ri", "hi", "hr", "li"]

# Past slots, and the key sets and targets of their scores.
SLOTS = ["pre1", "pre2", "pre3"]
SLOT_KEYS = [
    ["Distance"], ["Distance", "Discipline"], ["Distance", "FieldStatus"],
    ["Distance", "CourseCode"],
]
SLOT_TARGETS = ["TimeDelta", "FinishingTime"]

# Smoothing of target encoding, rare-code limits, floors and caps.
SMOOTHING_ROWS = 500
SMOOTHING_SCALE = 30
KEEP_ABOVE = 1000
FEW_BELOW = 20
STD_FLOOR = 1e-5
SLOT_STD_FLOOR = 1e-8
DEFAULT_ODDS = 99
GROUP_WIDTH = 18
PADDED_FINISH = 19
REWARD_LIMIT = 0.4
SWEEP_STEPS = 50
FOLD_SEED = 16
HOLDOUT_SEED = 32
HOLDOUT_GROUPS = 1000

# Hoof codes by size and by type; any other code is "o".
HOOF_SIZES = {
    "l": ("01s", "05s", "09s", "17s", "21s"),
    "m": ("02s", "06s", "10s", "18s", "22s"),
    "s": ("03s", "07s", "11s", "19s", "23s"),
    "qs": ("04s", "08s", "12s", "20s", "24s"),
}
HOOF_TYPES = {
    "t1": ("01s", "02s", "03s", "04s"),
    "t2": ("05s", "06s", "07s", "08s"),
    "t3": ("09s", "10s", "11s", "12s"),
    "t4": ("17s", "18s", "19s", "20s"),
    "t5": ("21s", "22s", "23s", "24s"),
}
OTHER_HOOF = "o"
