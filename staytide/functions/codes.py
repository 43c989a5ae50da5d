"""Code lists, limits and label names.

Every literal in this module is a fixed value: a source-system item code, a
diagnosis code, a plausibility limit or a label that results depend on.
"""

# --- fixed values: urine output items; URINE_NEGATED is subtracted ----------
URINE_ITEMS = [
    40055, 40056, 40057, 40069, 40085, 40086, 40094, 40096, 40405, 40428,
    40473, 40651, 40715, 43175,
    226557, 226558, 226559, 226560, 226561, 226563, 226564, 226565, 226567,
    226584, 227488, 227489,
]
URINE_NEGATED = 227488
URINE_VALUE_BELOW = 5000

# --- fixed values: creatinine lab item ---------------------------------------
CREATININE_ITEM = 50912

# --- fixed values: label -> (item codes, upper limit; larger becomes NULL) ---
LABS = {
    "albumin": ([50862], 10),
    "aniongap": ([50868], 10000),
    "bands": ([51144], 100),
    "bicarbonate": ([50882], 10000),
    "bilirubin": ([50885], 150),
    "bun": ([51006], 300),
    "chloride": ([50806, 50902], 10000),
    "creatinine": ([50912], 150),
    "glucose": ([50809, 50931], 10000),
    "hematocrit": ([50810, 51221], 100),
    "hemoglobin": ([50811, 51222], 50),
    "inr": ([51237], 50),
    "lactate": ([50813], 50),
    "platelet": ([51265], 10000),
    "potassium": ([50822, 50971], 30),
    "pt": ([51274], 150),
    "ptt": ([51275], 150),
    "sodium": ([50824, 50983], 200),
    "wbc": ([51300, 51301], 1000),
}

# --- fixed values: vital sign -> [(item codes, low, high, high included)] ----
# The low bound is exclusive; high None means unbounded.
VITALS = {
    "heartrate": [([211, 220045], 0, 300, False)],
    "sysbp": [([51, 442, 455, 6701, 220050, 220179], 0, 400, False)],
    "diasbp": [([8368, 8440, 8441, 8555, 220051, 220180], 0, 300, False)],
    "meanbp": [([52, 443, 456, 6702, 220052, 220181, 225312], 0, 300, False)],
    "resprate": [([615, 618, 220210, 224690], 0, 70, False)],
    "tempc": [([678, 223761], 70, 120, False), ([676, 223762], 10, 50, False)],
    "spo2": [([646, 220277], 0, 100, True)],
    "glucose": [([807, 811, 1529, 3744, 3745, 220621, 225664, 226537], 0, None, False)],
}
FAHRENHEIT_ITEMS = [678, 223761]

# --- fixed values: weight items and unit factors -----------------------------
WEIGHT_ADMIT_ITEMS = [762, 226512]
WEIGHT_DAILY_ITEMS = [763, 224639]
NEONATE_KG, NEONATE_LB, NEONATE_OZ = 3580, 3581, 3582
BIRTH_TEXT_ITEM, BIRTH_NUM_ITEM = 4183, 3723
KG_PER_LB, KG_PER_OZ = 0.45359237, 0.0283495231
KG_PER_LB_NOTE = 0.453592

# --- fixed values: diagnosis code lists --------------------------------------
PRIOR_AKI_CODES = ["5845", "5846", "5847", "5848"]
CKD_CODES = ["5851", "5852", "5853", "5854", "5855"]

# --- fixed values: flag -> (whole codes, 4-char prefixes, 3-char prefixes) ---
COMORBIDITY_CODES = {
    "chf": (
        ["39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493"],
        ["4254", "4255", "4257", "4258", "4259"],
        ["428"],
    ),
    "arrhy": (
        ["42610", "42612", "42613", "99601", "99604"],
        ["4260", "4267", "4269", "4270", "4271", "4272", "4273", "4274", "4276", "4278", "4279",
         "7850", "V450", "V533"],
        [],
    ),
    "valve": (
        [],
        ["0932", "7463", "7464", "7465", "7466", "V422", "V433"],
        ["394", "395", "396", "397", "424"],
    ),
    "perivasc": (
        [],
        ["0930", "4373", "4431", "4432", "4438", "4439", "4471", "5571", "5579", "V434"],
        ["440", "441"],
    ),
    "htn": ([], [], ["401"]),
    "htncx": ([], [], ["402", "403", "404", "405"]),
    "dm": ([], ["2500", "2501", "2502", "2503"], []),
    "dmcx": ([], ["2504", "2505", "2506", "2507", "2508", "2509"], []),
    "hypothy": ([], ["2409", "2461", "2468"], ["243", "244"]),
    "renlfail": (
        ["40301", "40311", "40391", "40402", "40403", "40412", "40413", "40492", "40493"],
        ["5880", "V420", "V451"],
        ["585", "586", "V56"],
    ),
    "liver": (
        ["07022", "07023", "07032", "07033", "07044", "07054"],
        ["0706", "0709", "4560", "4561", "4562", "5722", "5723", "5724", "5728", "5733", "5734",
         "5738", "5739", "V427"],
        ["570", "571"],
    ),
    "arth": (
        ["72889", "72930"],
        ["7010", "7100", "7101", "7102", "7103", "7104", "7108", "7109", "7112", "7193", "7285"],
        ["446", "714", "720", "725"],
    ),
    "coag": ([], ["2871", "2873", "2874", "2875"], ["286"]),
    "obese": ([], ["2780"], []),
    "lytes": ([], ["2536"], ["276"]),
    "alcohol": (
        [],
        ["2652", "2911", "2912", "2913", "2915", "2918", "2919", "3030", "3039", "3050", "3575",
         "4255", "5353", "5710", "5711", "5712", "5713", "V113"],
        ["980"],
    ),
    "drug": (
        ["V6542"],
        ["3052", "3053", "3054", "3055", "3056", "3057", "3058", "3059"],
        ["292", "304"],
    ),
}

# --- fixed values: output condition -> flag it repeats unchanged -------------
COMORBIDITY_OUTPUTS = {
    "congestive_heart_failure": "chf",
    "cardiac_arrhythmias": "arrhy",
    "valvular_disease": "valve",
    "peripheral_vascular": "perivasc",
    "renal_failure": "renlfail",
    "diabetes_complicated": "dmcx",
    "hypothyroidism": "hypothy",
    "liver_disease": "liver",
    "obesity": "obese",
    "alcohol_abuse": "alcohol",
    "drug_abuse": "drug",
}

# --- fixed values: ethnicity group code -> admission strings -----------------
ETHNICITY_GROUPS = {
    -1: ["MULTI RACE ETHNICITY", "OTHER", "PATIENT DECLINED TO ANSWER", "UNABLE TO OBTAIN",
         "UNKNOWN/NOT SPECIFIED"],
    0: ["WHITE", "WHITE - BRAZILIAN", "WHITE - EASTERN EUROPEAN", "WHITE - OTHER EUROPEAN",
        "WHITE - RUSSIAN"],
    1: ["BLACK/AFRICAN", "BLACK/AFRICAN AMERICAN", "BLACK/CAPE VERDEAN", "BLACK/HAITIAN"],
    2: ["ASIAN", "ASIAN - ASIAN INDIAN", "ASIAN - CAMBODIAN", "ASIAN - CHINESE",
        "ASIAN - FILIPINO", "ASIAN - JAPANESE", "ASIAN - KOREAN", "ASIAN - OTHER", "ASIAN - THAI",
        "ASIAN - VIETNAMESE"],
    3: ["HISPANIC OR LATINO", "HISPANIC/LATINO - CENTRAL AMERICAN (OTHER)",
        "HISPANIC/LATINO - COLOMBIAN", "HISPANIC/LATINO - CUBAN", "HISPANIC/LATINO - DOMINICAN",
        "HISPANIC/LATINO - GUATEMALAN", "HISPANIC/LATINO - HONDURAN",
        "HISPANIC/LATINO - MEXICAN", "HISPANIC/LATINO - PUERTO RICAN",
        "HISPANIC/LATINO - SALVADORAN", "PORTUGUESE"],
    4: ["AMERICAN INDIAN/ALASKA NATIVE",
        "AMERICAN INDIAN/ALASKA NATIVE FEDERALLY RECOGNIZED TRIBE"],
    5: ["CARIBBEAN ISLAND", "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER"],
    6: ["SOUTH AMERICAN"],
    7: ["MIDDLE EASTERN"],
}
ETHNICITY_UNLISTED = 0
SOURCE_CODES = {"carevue": 0, "metavision": 1}

# --- fixed values: kidney function formula -----------------------------------
EGFR_FACTOR, EGFR_CREAT_POWER, EGFR_AGE_POWER = 186.0, -1.154, -0.203
EGFR_FEMALE, EGFR_BLACK = 0.742, 1.21
EGFR_BLACK_GROUP = "BLACK/AFRICAN AMERICAN"

# --- fixed values: note label patterns (first capture group is the field) ----
NOTE_TIME = r"Date/Time: [\[\]0-9*-]+ at ([0-9:]+)"
NOTE_TEXT_FIELDS = {
    "indication": r"Indication: (.*?)\n",
    "bp": r"BP \(mm Hg\): (.*?)\n",
    "status": r"Status: (.*?)\n",
    "test": r"Test: (.*?)\n",
    "doppler": r"Doppler: (.*?)\n",
    "contrast": r"Contrast: (.*?)\n",
    "technicalquality": r"Technical Quality: (.*?)\n",
}
NOTE_NUMBER_FIELDS = {
    "height": r"Height: \(in\) (.*?)\n",
    "weight": r"Weight \(lb\): (.*?)\n",
    "bsa": r"BSA \(m2\): (.*?) m2\n",
    "bpsys": r"BP \(mm Hg\): ([0-9]+)/[0-9]+?\n",
    "bpdias": r"BP \(mm Hg\): [0-9]+/([0-9]+?)\n",
    "hr": r"HR \(bpm\): ([0-9]+?)\n",
}


def lab_item_labels() -> dict[int, str]:
    return {code: label for label, (codes, _) in LABS.items() for code in codes}


def lab_item_limits() -> dict[int, float]:
    return {code: limit for codes, limit in LABS.values() for code in codes}


def vital_items() -> list[int]:
    return sorted(code for rules in VITALS.values() for codes, *_ in rules for code in codes)


# The model inputs in their fixed order, from labels and labs only (79) and with urine rates (82).
FEATURES = {
    "creatinine": """
        creatinine_max creatinine_min creat egfr potassium_max glucose_max platelet_min bun_max wbc_min platelet_max tempc_mean
        glucose_mean ptt_max tempc_min bun_min hematocrit_min spo2_mean meanbp_mean age dbsource heartrate_mean pt_max tempc_max
        resprate_mean chloride_max glucose_min wbc_max diasbp_mean sysbp_max diasbp_min chloride_min spo2_min heartrate_max
        hemoglobin_max sysbp_mean hematocrit_max diasbp_max heartrate_min sysbp_min sodium_min meanbp_max bicarbonate_max
        meanbp_min sodium_max aniongap_max aniongap_min hemoglobin_min lactate_min bicarbonate_min ptt_min pt_min bilirubin_max
        resprate_min lactate_max resprate_max albumin_min potassium_min inr_max albumin_max bilirubin_min inr_min bands_min
        ethnicity bands_max hypertension diabetes_uncomplicated valvular_disease congestive_heart_failure spo2_max alcohol_abuse
        gender cardiac_arrhythmias peripheral_vascular obesity hypothyroidism diabetes_complicated liver_disease drug_abuse
        renal_failure""".split(),
    "urine": """
        uo_rt_24hr uo_rt_12hr uo_rt_6hr creatinine_max creatinine_min creat egfr platelet_max wbc_max bun_max platelet_min age
        dbsource glucose_min tempc_min wbc_min glucose_max diasbp_mean bun_min resprate_mean sysbp_max potassium_max chloride_max
        heartrate_max heartrate_mean spo2_mean ptt_max meanbp_mean chloride_min glucose_mean ptt_min tempc_max meanbp_min
        aniongap_max sodium_min hemoglobin_max hematocrit_max meanbp_max diasbp_max hematocrit_min spo2_min sodium_max tempc_mean
        diasbp_min heartrate_min resprate_max hemoglobin_min bicarbonate_max sysbp_min sysbp_mean bicarbonate_min potassium_min
        bilirubin_max lactate_max aniongap_min albumin_max pt_min bilirubin_min inr_min albumin_min resprate_min pt_max ethnicity
        lactate_min inr_max bands_max bands_min hypertension hypothyroidism congestive_heart_failure gender cardiac_arrhythmias
        spo2_max alcohol_abuse drug_abuse valvular_disease obesity peripheral_vascular diabetes_complicated liver_disease
        diabetes_uncomplicated renal_failure""".split(),
}


def feature_columns(variant: str) -> list[str]:
    """Model inputs of a variant in their fixed order; "urine" has the urine rates, any other name has not."""
    return FEATURES["urine" if variant == "urine" else "creatinine"]


LABEL_COLUMNS = ["aki", "aki_stage_7day"]
