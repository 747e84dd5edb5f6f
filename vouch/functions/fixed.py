"""Fixed values.

Names, patterns, thresholds and sentences that decide results and therefore
must stay exactly as they are.  All of them can be overridden by passing other
values to the operators that use them.
"""

# --- fixed values: column roles by name -------------------------------------
ID_PATTERNS = [
    r"(^|_)id$",
    r"(^|_)id(_|$)",
    r"^[a-z]+id$",
    r"(^|_)code$",
    r"uuid",
    r"identifier",
]
DATE_PATTERNS = ["date", "time", "timestamp", "month", "year"]
MEASURE_PATTERNS = [
    "sales", "revenue", "amount", "price", "cost", "profit", "quantity",
    "units", "discount", "margin", "salary", "wage", "compensation",
]
DIMENSION_PATTERNS = [
    "region", "country", "state", "city", "category", "product",
    "department", "segment", "type", "status",
]
DIMENSION_MAX_DISTINCT = 50

# --- fixed values: personal data by column name and by cell value -----------
PII_NAME_PATTERNS = {
    "email": ["email", "e_mail", "email_address"],
    "phone": ["phone", "mobile", "telephone", "contact_number"],
    "address": ["address", "street", "postal_address"],
    "name": [
        "full_name", "fullname", "first_name", "firstname", "last_name",
        "lastname", "customer_name", "customername", "employee_name",
        "employeename",
    ],
    "government_id": [
        "aadhaar", "pan", "passport", "ssn", "social_security",
        "driving_license",
    ],
    "financial": ["credit_card", "card_number", "bank_account", "account_number"],
}
PII_VALUE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+91[\s-]?)?[6-9]\d{9}",
    "aadhaar": r"\d{4}[\s-]?\d{4}[\s-]?\d{4}",
    "pan": r"[A-Z]{5}\d{4}[A-Z]",
    "credit_card": r"\d{13,19}",
}
PII_MATCH_SHARE = 0.8

# --- fixed values: limits ----------------------------------------------------
ALPHA = 0.05
TOLERANCE = 1e-6
MIN_GROUP_SIZE = 3
MIN_TREND_POINTS = 3
MOVING_AVERAGE_WINDOW = 3
IQR_FENCE = 1.5
TOP_VALUES = 10
TOP_INSIGHTS = 10
SCATTER_POINTS = 200
SERIES_POINTS = 240
BAR_GROUPS = 12
EXPLAIN_LIMIT = 3
EXPLAIN_LIMIT_MAX = 10
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_FILE_NAME = 255

# --- fixed values: steps (upper bound, score) --------------------------------
SAMPLE_SIZE_STEPS = [(5, 0.2), (10, 0.4), (30, 0.6), (100, 0.8)]
P_VALUE_STEPS = [(0.001, 1.0), (0.01, 0.9), (0.05, 0.75), (0.10, 0.4)]
CONFIDENCE_LEVELS = [(0.80, "high"), (0.60, "medium")]
CORRELATION_LABELS = [(0.8, "strong"), (0.5, "moderate"), (0.3, "weak")]
TREND_LABELS = [(0.80, "strong"), (0.50, "moderate")]

# --- fixed values: limitations per insight type ------------------------------
LIMITATIONS = {
    "group_difference": [
        "Group-level differences may be affected by sample size.",
        "A difference in averages does not establish causation.",
        "Statistical significance requires sufficient observations per group.",
    ],
    "time_series_trend": [
        "Historical trend direction does not forecast future performance.",
        "Trend regression uses chronological observation order and does not "
        "model unequal time intervals.",
        "Short time series can make trend estimates less reliable.",
    ],
    "correlation": [
        "Correlation does not imply causation.",
        "Pearson correlation measures linear relationships.",
        "Small sample sizes can reduce reliability.",
    ],
    "outlier": [
        "An outlier is not necessarily an error.",
        "Outliers may represent legitimate business events.",
        "IQR-based detection does not determine the cause of an outlier.",
    ],
}

# --- fixed values: method names ----------------------------------------------
METHODS = {
    "group_difference": "group_mean_comparison",
    "time_series_trend": "deterministic_time_series_trend",
    "correlation": "pearson_correlation",
    "outlier": "iqr_outlier_detection",
}
ANALYSIS_OF = {
    "group_difference": "group_comparison",
    "time_series_trend": "time_series",
    "correlation": "correlation",
    "outlier": "descriptive_statistics",
}

# --- fixed values: reasons ---------------------------------------------------
REASONS = {
    "few_pairs": "Pearson correlation requires at least two paired observations.",
    "no_variation": "Pearson correlation requires variation in both columns.",
    "small_group": "Each group must contain at least three observations.",
    "short_series": "Time-series trend analysis requires at least three valid observations.",
    "no_result": "No matching analysis result found.",
    "no_describe_result": "No matching descriptive statistics result found.",
    "unsupported_type": "Unsupported insight type",
    "corr_no_size": "Sample size is required for verification.",
    "corr_small": "At least 3 observations are required for Pearson correlation testing.",
    "corr_no_value": "Correlation value is missing.",
    "corr_no_p": "P-value is missing.",
    "corr_no_claimed_size": "Sample size is missing from insight evidence.",
    "corr_mismatch": "Insight numeric claims do not match the deterministic analysis result.",
    "group_few": "At least two groups are required.",
    "group_small": "Each group must contain at least three observations for a reliable group comparison.",
    "group_no_test": "No statistical test was provided.",
    "group_no_p": "Statistical test is missing p-value.",
    "group_no_means": "Group means are required for verification.",
    "group_mismatch": "Insight numeric or group claims do not match the deterministic analysis result.",
    "trend_mismatch": "Time-series evidence does not match the deterministic analysis.",
    "outlier_no_column": "No source column found for outlier insight.",
    "outlier_mismatch": "Reported outliers do not match the deterministic analysis result.",
}

# --- fixed values: evidence fields that verification compares ----------------
TREND_NUMBER_FIELDS = [
    "first_value", "last_value", "absolute_change", "percentage_change",
    "latest_period_change", "latest_period_percentage_change", "peak_value",
    "trough_value", "sample_size", "r_squared", "moving_average_window",
    "latest_moving_average",
]
TREND_TEXT_FIELDS = [
    "trend_direction", "trend_strength", "first_date", "last_date",
    "peak_date", "trough_date",
]

# --- fixed values: recommendations -------------------------------------------
RECOMMENDATIONS = {
    "correlation": (
        "Investigate the relationship between {first} and {second} before "
        "making policy or operational changes.",
        "The analysis identified a statistically supported relationship, but "
        "correlation alone does not establish causation.",
        "medium",
    ),
    "group_difference": (
        "Investigate why {highest_group} differs from {lowest_group} and "
        "determine whether the difference requires operational action.",
        "A measurable difference between groups was identified and should be "
        "investigated before taking action.",
        "medium",
    ),
    "outlier": (
        "Review the identified outlier records to determine whether they "
        "represent legitimate business events or data-quality issues.",
        "The analysis detected values that fall outside the expected "
        "IQR-based range.",
        "medium",
    ),
    "time_series_trend": (
        "Monitor {first} and investigate the business drivers behind the "
        "{direction} historical trend before making forecasts or operational "
        "changes.",
        "The trend was calculated and verified from historical observations, "
        "but historical movement alone does not establish future performance "
        "or causation.",
        "medium",
    ),
    None: (
        "Review this insight and determine whether further investigation is required.",
        "The insight passed the available deterministic analysis checks.",
        "low",
    ),
}

# --- fixed values: explanation sentences -------------------------------------
# Each sentence is used when every field it names has a value.
EXPLANATIONS = {
    "time_series_trend": [
        "{first} has a verified {trend_strength} {trend_direction} historical trend.",
        "The verified series moves from {first_value} on {first_date} to {last_value} on {last_date}.",
        "The verified overall percentage change is {percentage_change}%.",
        "The verified R-squared value is {r_squared}.",
    ],
    "correlation": [
        "The verified correlation between {first} and {second} is {correlation}.",
        "The relationship is based on {sample_size} observations.",
        "The verified p-value is {p_value}.",
        "This relationship is an association and does not establish causation.",
    ],
    "group_difference": [
        "{highest_group} has a verified average value of {highest_value}.",
        "{lowest_group} has a verified average value of {lowest_value}.",
        "The verified absolute difference is {absolute_difference}.",
        "The verified percentage difference is {percentage_difference}%.",
        "A difference between groups does not by itself establish causation.",
    ],
    "outlier": [
        "{first} contains {outlier_count} verified IQR outlier observations.",
        "The verified IQR bounds are {lower_bound} to {upper_bound}.",
        "An outlier is not automatically a data error and should be reviewed in business context.",
    ],
    None: ["{title}. This insight passed deterministic verification."],
}
EXPLANATION_LIMITATION = "Limitation: {limitation}"

# --- fixed values: report columns --------------------------------------------
REPORT_COLUMNS = [
    "rank", "insight_type", "title", "source_columns", "method",
    "verification_status", "confidence_level", "confidence_score",
    "priority_score", "evidence", "limitations", "explanation_status",
    "explanation", "recommendation_action", "recommendation_reason",
    "recommendation_priority",
]

# --- fixed values: text patterns ---------------------------------------------
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
LIST_MARKER_PATTERN = r"(?m)^[^\S\n]*\d+\.\s"
BEARER_PATTERN = r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+"
BEARER_REPLACEMENT = "Bearer [REDACTED]"
SECRET_REPLACEMENT = "[REDACTED]"
FORMULA_PATTERN = r"^[=+\-@\t\r]"

# --- fixed values: cell texts read as missing in CSV files (pandas default) --
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
