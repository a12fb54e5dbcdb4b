"""Fixed vocabularies and limits, and the small lookup frames built from them.

Every lookup frame here is built from the constants in this file, so its size is
fixed by the code (at most 91 rows) and never grows with the data.  Those are the
only frames the library broadcasts unconditionally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------
# Canonical signal, raw channel names
# --------------------------------------------------------------------------
_SIGNALS = {
    "ABP": ("ABP", "ART"),
    "PLETH": ("PLETH", "PLETH L", "PLETH R", "PLETHl", "PLETHr", "PLTHPR", "Pleth"),
    "AVR": ("AVR", "aVR"),
    "AVL": ("AVL", "aVL"),
    "I": ("I",),
    "II": ("II",),
    "III": ("III",),
    "V": ("V",),
    "MCL1": ("MCL1", "MCL"),
    "RESP": ("RESP", "Resp"),
    "PAP": ("PAP",),
    "CVP": ("CVP",),
    "ICP": ("ICP",),
}

# Signals a recording must hold to be usable, and for how long
FINAL_SIGNALS = ("II", "PLETH", "ABP")
MIN_SIGNAL_HOURS = 0.5
TARGET_FS = 125.0
CHUNK_SECONDS = 60.0

# --------------------------------------------------------------------------
# Weight charting items, accepted labels, plausible range in kg
# --------------------------------------------------------------------------
WEIGHT_ITEMIDS = (
    580, 581, 733, 763, 3580, 3581, 3582, 3583, 3692, 3693, 3723,
    45271, 227854, 226846, 224639, 226512, 226531,
)
WEIGHT_LABELS = (
    "Previous WeightF",
    "Daily Weight",
    "Admission Weight (Kg)",
    "Admission Weight (lbs.)",
    "Previous Weight",
)
WEIGHT_LABEL_LBS = "Admission Weight (lbs.)"
KG_PER_LB = 0.453592
WEIGHT_MIN_KG = 20
WEIGHT_MAX_KG = 500

# --------------------------------------------------------------------------
# Laboratory label, feature name
# --------------------------------------------------------------------------
LAB_ROWS = [
    ("Hematocrit", "hematocrit"),
    ("Platelet Count", "platelets"),
    ("Creatinine", "creatinine"),
    ("Potassium", "potassium"),
    ("Hemoglobin", "hemoglobin"),
    ("White Blood Cells", "wbc"),
    ("MCHC", "mchc"),
    ("Red Blood Cells", "rbc"),
    ("MCV", "mcv"),
    ("MCH", "mch"),
    ("RDW", "rdw"),
    ("Urea Nitrogen", "bun"),
    ("Sodium", "sodium"),
    ("Chloride", "chloride"),
    ("Bicarbonate", "bicarbonate"),
    ("Anion Gap", "anion_gap"),
    ("Glucose", "glucose"),
    ("Magnesium", "magnesium"),
    ("Calcium, Total", "calcium"),
    ("Phosphate", "phosphate"),
    ("INR(PT)", "inr"),
    ("PT", "pt"),
    ("PTT", "ptt"),
    ("Basophils", "basophils"),
    ("Neutrophils", "neutrophils"),
    ("Monocytes", "monocytes"),
    ("Eosinophils", "eosinophils"),
    ("Lymphocytes", "lymphocytes"),
    ("RDW-SD", "rdw_sd"),
    ("H", "h"),
    ("L", "l"),
    ("I", "i"),
    ("Alanine Aminotransferase (ALT)", "alt"),
    ("Asparate Aminotransferase (AST)", "ast"),
    ("Lactate", "lactate"),
    ("Alkaline Phosphatase", "alp"),
    ("Bilirubin, Total", "bilirubin"),
    ("pH", "ph"),
    ("Albumin", "albumin"),
    ("Base Excess", "base_excess"),
    ("pO2", "po2"),
    ("Calculated Total CO2", "tco2"),
    ("pCO2", "pco2"),
    ("Absolute Neutrophil Count", "anc"),
    ("Absolute Eosinophil Count", "aec"),
    ("Absolute Monocyte Count", "amc"),
    ("Absolute Basophil Count", "abc"),
    ("Absolute Lymphocyte Count", "alc"),
    ("Creatine Kinase (CK)", "ck"),
    ("Immature Granulocytes", "ig"),
]

# --------------------------------------------------------------------------
# Charted item label, drug, drug category
# --------------------------------------------------------------------------
DRUG_ROWS = [
    ("Levophed-k", "norepinephrine", "vasopressor"),
    ("Levophed", "norepinephrine", "vasopressor"),
    ("Norepinephrine", "norepinephrine", "vasopressor"),
    ("Epinephrine-k", "epinephrine", "vasopressor"),
    ("Epinephrine", "epinephrine", "vasopressor"),
    ("Dopamine", "dopamine", "vasopressor"),
    ("Dopamine Drip", "dopamine", "vasopressor"),
    ("Neosynephrine-k", "phenylephrine", "vasopressor"),
    ("Neosynephrine", "phenylephrine", "vasopressor"),
    ("Phenylephrine", "phenylephrine", "vasopressor"),
    ("Phenylephrine (50/250)", "phenylephrine", "vasopressor"),
    ("Phenylephrine (200/250)", "phenylephrine", "vasopressor"),
    ("Vasopressin", "vasopressin", "vasopressor"),
    ("Sandostatin", "octreotide", "vasopressor"),
    ("OCTREOTIDE", "octreotide", "vasopressor"),
    ("Octreotide", "octreotide", "vasopressor"),
    ("octreotide", "octreotide", "vasopressor"),
    ("Isuprel", "isoproterenol", "vasopressor"),
    ("Milrinone", "milrinone", "inotrope"),
    ("Dobutamine", "dobutamine", "inotrope"),
    ("Amrinone", "amrinone", "inotrope"),
    ("Aminophylline", "aminophylline", "inotrope"),
    ("Atropine", "atropine", "inotrope"),
    ("Nitroprusside", "nitroprusside", "vasodilator"),
    ("Nitroglycerine-k", "nitroglycerin", "vasodilator"),
    ("Nitroglycerine", "nitroglycerin", "vasodilator"),
    ("Nitroglycerin", "nitroglycerin", "vasodilator"),
    ("Nicardipine", "nicardipine", "vasodilator"),
    ("nicardipine gtt", "nicardipine", "vasodilator"),
    ("Nicardipine 40mg/200", "nicardipine", "vasodilator"),
    ("Labetolol", "labetalol", "vasodilator"),
    ("Labetalol", "labetalol", "vasodilator"),
    ("Diltiazem", "diltiazem", "vasodilator"),
    ("Esmolol", "esmolol", "vasodilator"),
    ("Natrecor", "nesiritide", "vasodilator"),
    ("Nesiritide", "nesiritide", "vasodilator"),
    ("FLOLAN", "epoprostenol", "vasodilator"),
    ("Prostaglandin", "prostaglandin", "vasodilator"),
    ("Metoprolol", "metoprolol", "vasodilator"),
    ("Hydralazine", "hydralazine", "vasodilator"),
    ("Verapamil", "verapamil", "vasodilator"),
    ("Angiotensin II (Giapreza)", "angiotensin_ii", "vasodilator"),
    ("Furosemide (Lasix)", "furosemide", "vasodilator"),
    ("Lasix", "furosemide", "vasodilator"),
    ("FENOLDOPAM 10MG/250C", "fenoldopam", "vasodilator"),
    ("Fendolapam", "fenoldopam", "vasodilator"),
    ("Amiodarone", "amiodarone", "antiarrhythmic"),
    ("Amiodarone 600/500", "amiodarone", "antiarrhythmic"),
    ("Amiodarone 450/250", "amiodarone", "antiarrhythmic"),
    ("Lidocaine", "lidocaine", "antiarrhythmic"),
    ("Procainamide", "procainamide", "antiarrhythmic"),
    ("Adenosine", "adenosine", "antiarrhythmic"),
    ("Propofol", "propofol", "sedative_analgesic"),
    ("Fentanyl", "fentanyl", "sedative_analgesic"),
    ("Fentanyl (Conc)", "fentanyl", "sedative_analgesic"),
    ("Fentanyl Base", "fentanyl", "sedative_analgesic"),
    ("Fentanyl (Concentrate)", "fentanyl", "sedative_analgesic"),
    ("Fentanyl Drip", "fentanyl", "sedative_analgesic"),
    ("Midazolam", "midazolam", "sedative_analgesic"),
    ("Midazolam (Versed)", "midazolam", "sedative_analgesic"),
    ("Ativan", "lorazepam", "sedative_analgesic"),
    ("Lorazepam (Ativan)", "lorazepam", "sedative_analgesic"),
    ("Morphine Sulfate", "morphine", "sedative_analgesic"),
    ("Dilaudid", "hydromorphone", "sedative_analgesic"),
    ("Hydromorphone (Dilaudid)", "hydromorphone", "sedative_analgesic"),
    ("Precedex", "dexmedetomidine", "sedative_analgesic"),
    ("Dexmedetomidine (Precedex)", "dexmedetomidine", "sedative_analgesic"),
    ("Precedex (mcg/kg/hr)", "dexmedetomidine", "sedative_analgesic"),
    ("PRECEDEX CC/HR", "dexmedetomidine", "sedative_analgesic"),
    ("Pentobarbitol", "pentobarbital", "sedative_analgesic"),
    ("demerol", "meperidine", "sedative_analgesic"),
    ("Meperidine (Demerol)", "meperidine", "sedative_analgesic"),
    ("Ketamine", "ketamine", "sedative_analgesic"),
    ("Methadone Hydrochloride", "methadone", "sedative_analgesic"),
    ("Diazepam (Valium)", "diazepam", "sedative_analgesic"),
    ("Haloperidol (Haldol)", "haloperidol", "sedative_analgesic"),
    ("bupivacaine", "bupivacaine", "sedative_analgesic"),
    ("Epidural", "epidural", "sedative_analgesic"),
    ("epidural", "epidural", "sedative_analgesic"),
    ("Acetaminophen-IV", "acetaminophen_iv", "sedative_analgesic"),
    ("Cisatracurium", "cisatracurium", "nm_blocker"),
    ("CISATRICURIUM", "cisatracurium", "nm_blocker"),
    ("cisatricurium", "cisatracurium", "nm_blocker"),
    ("Cisat mcg/kg/hr", "cisatracurium", "nm_blocker"),
    ("Cisat mcg/kg/min", "cisatracurium", "nm_blocker"),
    ("NIMBEX", "cisatracurium", "nm_blocker"),
    ("nimbex", "cisatracurium", "nm_blocker"),
    ("Vecuronium", "vecuronium", "nm_blocker"),
    ("Pancuronium", "pancuronium", "nm_blocker"),
    ("Atracurium", "atracurium", "nm_blocker"),
    ("Doxacurium", "doxacurium", "nm_blocker"),
]

# Norepinephrine-equivalent weight of each vasoactive drug
NOREPI_FACTORS = {
    "norepinephrine": 1.0,
    "epinephrine": 1.0,
    "dopamine": 0.01,
    "phenylephrine": 0.06,
    "vasopressin": 2.5,
    "angiotensin_ii": 2.5,
}

# Administration routes and category names found in the tables
CONTINUOUS_ROUTES = ("Continuous Med", "Continuous IV")
BOLUS_ROUTES = ("Bolus", "Drug Push")
DRIP_ROUTE = "IV Drip"
PUSH_ROUTE = "Intravenous Push"
REBUILT_ROUTE = "Continuous Med"

# Hours before a recording whose events still count
LOOKBACK_HOURS = 2


SIGNAL_ROWS = [
    (raw, canon, i)
    for i, (canon, raw) in enumerate((c, r) for c, names in _SIGNALS.items() for r in names)
]
SIGNALS = tuple(dict.fromkeys(canon for _, canon, _ in SIGNAL_ROWS))

LAB_LABELS = tuple(label for label, _ in LAB_ROWS)
LAB_FEATURES = tuple(feature for _, feature in LAB_ROWS)

DRUG_LABELS = tuple(label for label, _, _ in DRUG_ROWS)
DRUG_CATEGORY = {drug: category for _, drug, category in DRUG_ROWS}
DRUGS = tuple(DRUG_CATEGORY)
CATEGORIES = tuple(dict.fromkeys(DRUG_CATEGORY.values()))

#: Integer 0/1 features; every other feature is a nullable double.
FLAG_FEATURES = (
    tuple(f"{c}_on" for c in CATEGORIES)
    + tuple(f"{d}_{suffix}" for d in DRUGS for suffix in ("bolus", "on"))
    + ("vasoactive_on",)
)


def feature_names() -> list[str]:
    """The 214 per-chunk features in the order of the wide row."""
    names = [f"{c}_on" for c in CATEGORIES]
    for d in DRUGS:
        names += [f"{d}_ratenorm", f"{d}_bolus", f"{d}_on"]
    return names + ["norepi_eq", "vasoactive_on", *LAB_FEATURES]


def values_frame(spark: SparkSession, rows, columns: str) -> DataFrame:
    """An inline ``VALUES`` relation, so Spark knows its size exactly."""

    def literal(v):
        return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def drug_frame(spark: SparkSession) -> DataFrame:
    """label, drug, category — 91 rows."""
    return values_frame(spark, DRUG_ROWS, "label, drug, category")


def lab_frame(spark: SparkSession) -> DataFrame:
    """label, feature — 50 rows."""
    return values_frame(spark, LAB_ROWS, "label, feature")


def signal_frame(spark: SparkSession) -> DataFrame:
    """raw_signal, signal, variant_rank — 24 rows."""
    return values_frame(spark, SIGNAL_ROWS, "raw_signal, signal, variant_rank")
