"""Small fixed tables of the health-record jobs."""

from __future__ import annotations

# They have to be these for results to agree with existing records.

SYSTEMS = [
    "integumentary", "muscular", "skeletal", "cardiovascular", "nervous", "digestive", "respiratory", "renal", "lymphatic", "endocrine", "reproductive",
]
DEFAULT_SYSTEM = "integumentary"
SYSTEM_ALIASES = {
    "integ": "integumentary", "skin": "integumentary", "muscle": "muscular", "musculoskeletal": "muscular", "bone": "skeletal",
    "cardio": "cardiovascular", "circulatory": "cardiovascular", "heart": "cardiovascular", "neuro": "nervous", "gi": "digestive",
    "gastrointestinal": "digestive", "pulm": "respiratory", "pulmonary": "respiratory", "kidney": "renal", "urinary": "renal",
    "lymph": "lymphatic", "endo": "endocrine", "repro": "reproductive", "reproductive": "reproductive",
}
#: Default place of each system on the body map, in per cent.
ANCHORS = {
    "integumentary": (50, 14), "muscular": (56, 31), "skeletal": (48, 38), "cardiovascular": (50, 31), "nervous": (50, 17), "digestive": (50, 48),
    "respiratory": (50, 30), "renal": (50, 52), "lymphatic": (58, 39), "endocrine": (50, 24), "reproductive": (50, 68),
}
#: Bounds of a default place, and the seeds of its two offsets.
PLACE_X, PLACE_Y, SALT_X, SALT_Y = (12, 88), (8, 88), 17, 53

#: Keyword rules by which a name is put in a system; the first that matches counts. (word boundaries are ASCII)
KEYWORDS = [
    ("endocrine", "diabet|thyro|hormon|endocrin|adrenal|pituitary|hypoglyc|hyperglyc|glucose|obesity"),
    ("nervous", "depress|anxiety|seizure|epilep|migraine|headache|stroke|neuro|dementia|parkinson|alzheimer|mental|psychiat|bipolar|nerve|cognit"),
    ("integumentary", "skin|derma|rash|eczema|psoriasis|acne|melanoma|(^|[^0-9a-z_])mole($|[^0-9a-z_])|wart|verruca|follicul"),
    ("cardiovascular", "heart|cardiac|cardio|hypertension|blood pressure|arrhythmia|coronary|artery|arterial|vascular|aort"),
    ("respiratory", "lung|respirat|asthma|copd|pneumonia|bronch|pulmonary|throat|pharyn|larynx|nasopharyn|sinus"),
    ("renal", "kidney|renal|urinary|bladder|nephro|ureter|proteinuria|hematuria"),
    ("digestive", "stomach|intestin|bowel|liver|gastro|gastric|esophag|digest|colon|pancrea|hepat|polyp|hemorrhoid|diarrhea|dysphagia|lactose|alpha-fetoprotein|(^|[^0-9a-z_])afp($|[^0-9a-z_])"),
    ("lymphatic", "lymph|spleen|immune|allerg|epstein.?barr|(^|[^0-9a-z_])ebv($|[^0-9a-z_])"),
    ("muscular", "muscle|muscular|myopath|fibromyalgia"),
    ("skeletal", "bone|joint|fracture|arthritis|skeletal|spine|disc|osteo"),
    ("reproductive", "prostate|ovary|ovarian|uterus|testic|reproduct|menstru|pregnan|erectile"),
]
KEYWORD_DEFAULT = "skeletal"

CONDITION_ALIASES = {
    "htn": "hypertension", "essential htn": "essential hypertension", "t2dm": "type 2 diabetes mellitus", "t1dm": "type 1 diabetes mellitus",
    "dm2": "type 2 diabetes mellitus", "dm type 2": "type 2 diabetes mellitus", "dm type 1": "type 1 diabetes mellitus",
    "gerd": "gastroesophageal reflux disease", "copd": "chronic obstructive pulmonary disease", "cad": "coronary artery disease",
    "chf": "congestive heart failure", "ckd": "chronic kidney disease", "afib": "atrial fibrillation", "a fib": "atrial fibrillation",
    "osa": "obstructive sleep apnea", "uti": "urinary tract infection", "hld": "hyperlipidemia", "ibs": "irritable bowel syndrome",
    "ra": "rheumatoid arthritis", "oa": "osteoarthritis", "mi": "myocardial infarction",
}

MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
RAIL_K = 2.5
SCANNED_CHARS = 50
GLUCOSE_FACTOR = 18.018

#: Names that show that a class of conditions is documented already.
DOCUMENTED = {
    "hypertension": ["hypertension", "high blood pressure"],
    "diabetes": ["diabetes", "diabetic", "hyperglycaemia", "hyperglycemia"],
    "prediabetes": ["pre-diabet", "prediabet", "impaired fasting"],
    "hyperlipid": ["hyperlipid", "dyslipid", "hypercholesterol"],
    "anaemia": ["anaemia", "anemia"],
    "ckd": ["chronic kidney", "ckd", "renal failure", "renal insufficiency"],
}
MALE_TERMS = "prostat|testicular|(^|[^0-9a-z_])bph($|[^0-9a-z_])"
FEMALE_TERMS = "ovar|uter|cervi|pcos|fibroid|menstr|pregnan|endometr"

STATUSES = ["documented", "resolved", "suspected", "inferred"]
CARE_EVENT_TYPES = ["diagnosed", "revisited", "treated", "monitored", "referred", "other"]
SECTION_TYPES = ["visit", "problem_list", "labs", "imaging", "summary", "other"]
ORGANIZATIONS = ["chronological", "problem_based", "mixed"]

SECRET_PATTERNS = ["(?i)Bearer\\s+\\S+", "sk-or-[a-zA-Z0-9-_]+", "sk-[a-zA-Z0-9-_]+", "AIza[a-zA-Z0-9-_]+"]
SCORE_WEIGHTS = {"intelligence": 0.35, "agentic": 0.25, "document": 0.25, "instruction": 0.15}
