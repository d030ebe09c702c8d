"""Fixed values. They must equal the audited product's own settings for results to match."""

# --- fixed values: trust weights and presets -------------------------------------------
DEFAULT_WEIGHTS = {"truth": 0.40, "bias": 0.40, "confidence": 0.20}

PRESETS = {
    "general": {"truth": 0.40, "bias": 0.40, "confidence": 0.20},
    "healthcare": {"truth": 0.45, "bias": 0.35, "confidence": 0.20},
    "finance": {"truth": 0.38, "bias": 0.42, "confidence": 0.20},
    "hiring": {"truth": 0.35, "bias": 0.45, "confidence": 0.20},
}

# --- fixed values: thresholds ----------------------------------------------------------
APPROVE_AT = 0.70
REVIEW_BELOW = 0.60
HALLUCINATED_BELOW = 0.65
BANDS = {"critical": 0.50, "elevated": 0.60, "moderate": 0.75}
PARITY_LIMIT = 0.10
FOUR_FIFTHS = 0.80
SPARSE_TRUTH_AT = 0.18
DENSE_TRUTH_AT = 0.60
TOP_K = 3
VOCABULARY_SIZE = 4096
CLUSTERS = 4
DEFAULT_CONFIDENCE = 0.85
TEXT_NEUTRAL = 0.5
FAST_CLUSTER = 0.85
FAST_DISTRIBUTION = 0.9
DRIFT_WARNING = 0.05
DRIFT_CRITICAL = 0.10
DRIFT_HISTORY = 5
MANUAL_MINUTES = 240
RATE_WINDOW_SECONDS = 3600
API_CALLS_PER_HOUR = 300
UPLOADS_PER_HOUR = 10
KEEP_AUDITS = 75
KEEP_REVIEWS = 100
REPORT_CHARS = 18000
ARTICLE_CHARS = 2500
SOURCE_CHARS = 300
MIN_ARTICLE_CHARS = 10
REWEIGH_FACTORS = {(1, 1): 3.0, (1, 0): 0.5, (0, 1): 0.5, (0, 0): 3.0}
VERDICT_SCORES = {"Supported": 1.0, "Contradicted": 0.0, "Unverifiable": 0.4}
UNKNOWN_VERDICT = "Unverifiable"
MISSING_WORDS = ["", "nan", "None", "null", "NaN"]
ROLES = ["target", "protected_attribute", "feature", "ignore"]
UPLOAD_EXTENSIONS = ["csv", "xlsx", "xls", "json"]
CONTENT_ALIASES = ["text", "body", "article", "document", "passage"]

# --- fixed values: patterns ------------------------------------------------------------
EMAIL_PATTERN = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b"
PHONE_PATTERN = r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)"
REDACTED = "[REDACTED]"

# --- fixed values: compliance frameworks -----------------------------------------------
FRAMEWORKS = [
    ("eeoc", "EEOC / Title VII (US employment)", "EEOC §1691, 29 CFR 1607 (four-fifths rule)", "hiring"),
    ("ecoa", "ECOA / Regulation B (US fair lending)", "ECOA 15 U.S.C. §1691", "finance"),
    ("eu_ai_act", "EU AI Act (high-risk AI systems)", "Regulation (EU) 2024/1689, Art. 10 (data governance)", "general"),
    ("nist_ai_rmf", "NIST AI Risk Management Framework", "NIST AI 100-1 (Measure / Manage functions)", "general"),
    ("gdpr", "GDPR automated decision-making", "Regulation (EU) 2016/679, Art. 22", "general"),
    ("who", "WHO / clinical safety", "WHO Essential Medicines & clinical-guidance integrity", "healthcare"),
]

# --- fixed values: column-name hints and domain keywords -------------------------------
PROTECTED_COLUMN_HINTS = ["gender", "sex", "race", "ethnicity", "disability", "veteran", "marital"]

PROTECTED_NAME_HINTS = [
    "gender", "sex", "race", "ethnicity", "age", "disability", "religion",
    "nationality", "national_origin", "marital", "pregnan", "veteran", "zip",
    "postal", "orientation",
]

DOMAIN_KEYWORDS = {
    "hiring": [
        "gender", "sex", "race", "ethnicity", "age", "disability", "veteran",
        "applicant", "candidate", "hire", "hired", "interview", "resume", "promotion",
    ],
    "finance": [
        "loan", "credit", "mortgage", "income", "debt", "default", "fico",
        "collateral", "approval", "lending", "transaction",
    ],
    "healthcare": [
        "patient", "diagnosis", "drug", "dose", "dosage", "treatment", "clinical",
        "disease", "symptom", "mortality", "readmission", "icd", "medical",
    ],
    "insurance": [
        "premium", "claim", "policyholder", "underwrit", "actuarial", "coverage",
        "deductible", "insured", "risk_score", "peril",
    ],
    "education": [
        "student", "grade", "gpa", "admission", "enrollment", "scholarship",
        "school", "graduation", "test_score", "tuition",
    ],
    "government": [
        "benefit", "eligibility", "citizen", "welfare", "tax", "permit",
        "applicant_id", "case_id", "public", "constituent",
    ],
}

# domain -> (weight preset, framework label)
DOMAIN_PROFILES = {
    "hiring": ("hiring", "EEOC / Title VII (employment fairness)"),
    "finance": ("finance", "ECOA / Fair Lending (Regulation B)"),
    "healthcare": ("healthcare", "HIPAA / clinical safety & FDA SaMD guidance"),
    "insurance": ("finance", "NAIC model bulletin / fair pricing & underwriting"),
    "education": ("general", "FERPA / equal educational access"),
    "government": ("general", "OMB M-24-10 / algorithmic accountability"),
    "general": ("general", "EU AI Act & NIST AI RMF (general governance)"),
}

# --- fixed values: words behind the regulatory flags -----------------------------------
LENDING_WORDS = ["zip code", "zip_code", "mortgage", "loan"]
MEDICAL_WORDS = ["drug", "dosage", "medicine", "patient"]

# --- fixed values: English function words dropped before tf-idf ------------------------
STOP_WORDS = [
    "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "did", "do", "does", "doing", "don", "down", "during", "each",
    "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here",
    "hers", "herself", "him", "himself", "his", "how", "if", "in", "into", "is", "it",
    "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not",
    "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves",
    "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that",
    "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they",
    "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will",
    "with", "you", "your", "yours", "yourself", "yourselves",
]

# --- fixed values: the census income table ---------------------------------------------
CENSUS_COLUMNS = [
    ("age", "int"), ("workclass", "string"), ("fnlwgt", "int"), ("education", "string"),
    ("education-num", "int"), ("marital-status", "string"), ("occupation", "string"),
    ("relationship", "string"), ("race", "string"), ("sex", "string"),
    ("capital-gain", "int"), ("capital-loss", "int"), ("hours-per-week", "int"),
    ("native-country", "string"), ("income", "string"),
]
