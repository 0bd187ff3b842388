"""Values that must equal the published behaviour for results to agree.

Everything here is data, not logic: labels, patterns, word lists, weights,
thresholds and messages.
"""

# ---------------------------------------------------------------- fixed values
# Personal-data patterns, in the order they are applied.
PII_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?){2}\d{4}",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
    "DATE": r"\b\d{4}-\d{2}-\d{2}\b",
}
# The nested-record scrub and the corpus hit counters leave dates alone.
PII_LABELS_WITHOUT_DATE = ("EMAIL", "PHONE", "SSN", "CREDIT_CARD")

PII_STATUS_FOUND = "Scrubbed %d cell(s) containing sensitive PII."
PII_STATUS_CLEAN = "No sensitive PII detected."

# Header words that hint at personal data.
PII_NAME_HINTS = (
    "name", "first_name", "last_name", "full_name", "email", "phone", "mobile",
    "ssn", "social", "dob", "birth", "address", "zip", "postal", "passport",
    "license", "account", "iban", "credit", "card",
)

# Domain keywords; matched as substrings of the lower-cased text.
CATEGORY_KEYWORDS = {
    "Financial": (
        "finance", "financial", "trading", "stock", "market", "invoice",
        "payment", "revenue", "expense", "bank",
    ),
    "Health/Medical": (
        "health", "medical", "patient", "hospital", "diagnosis", "clinical",
        "doctor", "drug", "treatment",
    ),
    "Legal/Government": (
        "legal", "court", "contract", "law", "government", "permit",
        "regulation", "policy",
    ),
    "Creative/Media": (
        "media", "creative", "music", "video", "image", "photo", "ad",
        "campaign",
    ),
    "Engineering/Manufacturing": (
        "engineering", "manufacturing", "machine", "sensor", "factory", "cad",
        "production", "supply",
    ),
    "Environmental/Sustainability": (
        "environment", "sustainability", "climate", "carbon", "emission",
        "weather", "energy",
    ),
    "Education/Research": (
        "education", "research", "student", "study", "experiment", "paper",
        "survey",
    ),
    "Consumer/Retail": (
        "retail", "consumer", "customer", "basket", "sku", "store",
        "ecommerce", "purchase",
    ),
    "Transportation/Logistics": (
        "transport", "logistics", "shipment", "delivery", "fleet", "route",
        "warehouse",
    ),
    "IT/Software": (
        "software", "it", "app", "api", "code", "server", "database", "cyber",
        "latency", "bug",
    ),
    "Real Estate/Construction": (
        "real estate", "property", "building", "construction", "listing",
        "rent", "lease", "mortgage",
    ),
}
DEFAULT_CATEGORY = "General/Other"
# Confidence by number of keyword hits: none, one, two, three or more.
CATEGORY_CONFIDENCE = (0.5, 0.72, 0.84, 0.93)

# Upload bins and the access rules derived from them.
UPLOAD_CATEGORIES = (
    "medical", "finance", "retail", "text", "images", "geospatial", "general",
)
PLAN_RANK = {"free": 0, "basic": 1, "business": 2, "enterprise": 3}
KYB_STATUSES = ("pending", "verified", "rejected")
SENSITIVITY_RULES = {  # sensitivity -> (least plan, KYB needed)
    "public": ("free", False),
    "internal": ("basic", False),
    "confidential": ("basic", False),
    "sensitive": ("business", True),
    "special_category": ("enterprise", True),
}
CATEGORY_SENSITIVITY = {
    "medical": "special_category",
    "finance": "confidential",
    "retail": "internal",
    "text": "internal",
    "images": "internal",
    "geospatial": "confidential",
    "general": "internal",
}
PERMITTED_USES = ("analytics", "research", "product_development")
PROHIBITED_USES = (
    "re_identification", "secondary_sale_without_consent", "individual_profiling",
)
ALWAYS_PERMITTED_PURPOSES = ("buyer_download", "buyer_preview")
TRANSFORMATIONS = (
    "sha256_hash", "pii_scan_and_redaction", "category_prediction",
    "quality_scoring", "metadata_persistence",
)
PIPELINE_VERSION = "fast-compliance-pipeline-v1"

# Fast quality score.
FAST_WEIGHTS = {
    "Completeness": 0.35, "Uniqueness": 0.25, "Consistency": 0.20,
    "Representativeness": 0.20,
}
BEST_USE_LADDER = (
    (90.0, "Production analytics and model training"),
    (80.0, "Business intelligence and exploratory analysis"),
    (70.0, "Exploratory Data Analysis (EDA)"),
)
BEST_USE_OTHERWISE = "Needs cleaning before reuse"
UNREAD_SCORE = 75.0
UNREAD_BEST_USE = "Exploratory Data Analysis (EDA)"
PASS_SCORE = 80.0

# Quality engine.
DIMENSIONS = (
    "Completeness", "Validity", "Consistency", "Uniqueness",
    "Representativeness", "Balance", "Timeliness",
)
DIMENSION_WEIGHTS = {
    "Completeness": 0.16, "Validity": 0.16, "Consistency": 0.14,
    "Uniqueness": 0.14, "Representativeness": 0.14, "Balance": 0.13,
    "Timeliness": 0.13,
}
STATUS_SCORE = {"PASS": 100.0, "WARN": 70.0, "FAIL": 20.0, "SKIP": 70.0, "NA": 70.0}
NEUTRAL_SCORE = 70.0
CHECK_CATEGORY_DIMENSION = {
    "Data Integrity & Validation": "Consistency",
    "Missingness Analysis": "Completeness",
    "Distribution & Normality": "Validity",
    "Multivariate Tests": "Validity",
    "Outlier Detection": "Validity",
    "Two-Sample/Drift Tests": "Representativeness",
    "Multivariate Divergences": "Representativeness",
    "Coverage & Sampling": "Representativeness",
    "Time Series: Stationarity": "Timeliness",
    "Time Series: Autocorrelation": "Timeliness",
    "Time Series: Spectral & Cointegration": "Timeliness",
    "Change-Point Detection": "Timeliness",
    "Complexity & Causality": "Consistency",
    "Information Theory": "Consistency",
    "Manifold & Geometry": "Representativeness",
    "Privacy & Anonymity": "Validity",
    "Data Leakage": "Validity",
    "Label Quality": "Balance",
    "Text Quality": "Consistency",
    "Vision Quality": "Validity",
    "Geospatial Quality": "Validity",
    "Graph Quality": "Consistency",
    "Metadata & Governance": "Completeness",
}
DEFAULT_DIMENSION = "Validity"
# First group with a word inside the check name decides the dimension.
DIMENSION_KEYWORDS = (
    ("Completeness", ("missing", "null", "completeness")),
    ("Uniqueness", ("duplicate", "unique", "primary-key", "composite-key")),
    ("Timeliness", (
        "timeliness", "stationarity", "autocorrelation", "change-point",
        "chow", "adf", "kpss", "cointegration", "granger",
    )),
    ("Representativeness", (
        "drift", "shift", "coverage", "sampling", "representative",
        "wasserstein", "psi", "mmd", "divergence", "hellinger", "tv distance",
        "energy distance",
    )),
    ("Balance", ("label", "class", "parity", "imbalance", "balance")),
    ("Consistency", (
        "schema", "format", "regex", "datatype", "consistency", "metadata",
        "governance",
    )),
)
REMEDIATION_KEYWORDS = (
    (("missing", "null"),
     "Backfill missing values and enforce required-field checks at ingestion."),
    (("outlier", "hbos", "isolation", "lof", "mahalanobis"),
     "Review outlier policy: cap, winsorize, or remove extreme records by column."),
    (("duplicate", "unique", "primary-key"),
     "Deduplicate records and enforce stable unique identifiers in source systems."),
    (("drift", "shift", "psi", "wasserstein", "mmd"),
     "Address training-serving drift with recent data refresh and segment-aware monitoring."),
    (("timeliness", "stationarity", "change-point", "autocorrelation"),
     "Improve freshness and temporal ordering; update late-arrival handling windows."),
    (("pii", "privacy", "leakage"),
     "Mask or tokenize sensitive fields and enforce leakage controls before model use."),
    (("schema", "format", "regex", "encoding"),
     "Harden schema contracts (types/ranges/formats) and block malformed records."),
    (("label", "class", "balance"),
     "Mitigate label imbalance with stratified sampling or class weighting."),
)
REMEDIATION_NONE = (
    "No critical failures detected; maintain data quality monitoring cadence."
)
IMPROVEMENT_ACTIONS = {
    "Completeness": "Backfill nulls and enforce mandatory fields at data ingestion boundaries.",
    "Validity": "Apply schema/type/range validation and reject malformed records early.",
    "Consistency": "Normalize formats (dates, booleans, casing) and standardize feature engineering logic.",
    "Uniqueness": "Deduplicate assets/rows and enforce stable primary keys or perceptual hashes.",
    "Representativeness": "Expand data coverage and monitor segment drift to improve generalization.",
    "Balance": "Use class reweighting, stratified sampling, or targeted data collection for minority classes.",
    "Timeliness": "Increase refresh cadence and enforce freshness SLAs for time-sensitive use cases.",
}
IMPROVEMENT_EXTRA = {
    "image": "Increase image sharpness and resolution quality gates during data capture.",
    "text": "Reduce symbol noise and normalize document formatting before tokenization.",
}
TIER_LADDER = ((85.0, "Excellent"), (70.0, "Good"), (55.0, "Fair"))
TIER_OTHERWISE = "Poor"
# Advice by modality: rungs for overall >= 85, >= 70, >= 55, below.
ADVICE = {
    "tabular": (
        ("Excellent for production ML training, feature stores, and KPI dashboards.",
         "Strong candidate for LLM/RAG structured fine-tuning datasets.",
         "Suitable for high-confidence forecasting with monitoring."),
        ("Good for model development and analytics with targeted cleanup.",
         "Suitable for segmentation, anomaly detection, and BI iterations."),
        ("Fair for exploratory analysis and preprocessing pipelines.",
         "Use for prototyping before promotion to training data."),
        ("Poor for direct model training; use only for profiling and remediation.",),
    ),
    "image": (
        ("Excellent for computer vision training and benchmark-grade validation sets.",
         "Strong candidate for high-quality fine-tuning pipelines."),
        ("Good for transfer learning and prototype vision models.",
         "Usable for visual search with preprocessing."),
        ("Fair for labeling workflow development and coarse visual tasks.",),
        ("Poor for direct training; use for cleaning and recapture planning.",),
    ),
    "text": (
        ("Excellent for LLM fine-tuning, RAG ingestion, and semantic search.",
         "Suitable for production NLP training corpora."),
        ("Good for classification, topic modeling, and summarization workflows.",),
        ("Fair for exploratory NLP and prototype search/QA systems.",),
        ("Poor for model training; prioritize curation and normalization first.",),
    ),
}
# Cautions by modality: dimension, exclusive upper bound, message.
CAUTIONS = {
    "tabular": (
        ("Timeliness", 55.0, "Low timeliness: avoid near-real-time forecasting and rapid-response decision systems."),
        ("Balance", 60.0, "Low balance: supervised tasks require class reweighting or resampling."),
        ("Representativeness", 60.0, "Low representativeness: generalization risk is high for production deployments."),
    ),
    "image": (
        ("Validity", 60.0, "Image quality issues (resolution/blur/exposure) can degrade OCR and detection accuracy."),
        ("Uniqueness", 70.0, "High duplicate likelihood: deduplicate before train/validation split."),
    ),
    "text": (
        ("Validity", 60.0, "High symbol/noise ratio reduces downstream NLP quality."),
        ("Consistency", 60.0, "Low text consistency; normalize casing, encoding, and formatting."),
    ),
}
WEAKEST_CAUTION = "Weakest dimension is %s (%s); avoid high-stakes use cases dependent on it."
WEAKEST_CAUTION_BELOW = 65.0
ADVICE_CAVEAT = "Best fit now, but weaker for scenarios requiring strong %s (current %s)."

# Check thresholds: warn, fail.
MISSING_PCT = (5.0, 20.0)
OUTLIER_PCT = (10.0, 30.0)
VIF_LIMITS = (10.0, 50.0)
CONDITION_LIMITS = (1e5, 1e8)
SAMPLE_ROWS = 200_000
SAMPLE_SEED = 42
CATEGORICAL_CARDINALITY = (2, 100)
FREE_TEXT_LIMITS = (5.0, 0.6)  # mean length, distinct share

# Text corpora.
ENGLISH_HINT_WORDS = (
    "the", "and", "is", "are", "to", "of", "for", "with", "in", "on", "this",
    "that",
)
HINT_TOKENS = 400
SHORT_TOKENS = 5
LONG_TOKENS = 1500

# File families.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tif", ".tiff")
TABULAR_SUFFIXES = (".csv", ".parquet", ".pq", ".json", ".xlsx", ".xls")
TEXT_SUFFIXES = (".txt", ".md", ".log")

# Spellings read as null in delimited text (the published pandas defaults).
NULL_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
BOOLEAN_SPELLINGS = ("True", "False", "true", "false", "TRUE", "FALSE")

# Media types by suffix (public registry entries for the supported families).
GENERIC_MIME = ("application/octet-stream", "binary/octet-stream")
MIME_BY_SUFFIX = {
    "csv": "text/csv", "json": "application/json", "txt": "text/plain",
    "md": "text/markdown", "log": "text/plain", "html": "text/html",
    "xml": "text/xml", "pdf": "application/pdf", "zip": "application/zip",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "bmp": "image/bmp", "gif": "image/gif", "webp": "image/webp",
    "tif": "image/tiff", "tiff": "image/tiff",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}

# Governance.
SCHEMA_VERSION = 1
DESCRIPTION_LIMIT = 1000
RETENTION_DAYS = 365
RETENTION_BASIS = "standard_marketplace_retention"
RETENTION_ACTION = "restrict_metadata_and_disable_download"
REVIEW_MONTHS = 24
REVIEW_MONTHS_RANGE = (1, 120)
REVIEW_LENGTH = (30, 1000)
REVIEW_STATUSES = ("pending", "approved", "rejected")
REVIEW_WAIT_SECONDS = 60
BLOCKED_METADATA_WORDS = ("password", "token", "secret", "key", "authorization", "cookie")
REDACTED = "[REDACTED]"
# ------------------------------------------------------------ end fixed values
