"""Fixed values.

Thresholds, name patterns, strategy names and message formats that decide what
the engine reports.  They are part of the product's contract: changing one
changes results, so they live together here, as plain text.
"""

# --- thresholds -----------------------------------------------------------
NULL_RATIO_LIMIT = 0.20
Z_LIMIT = 3.0
MINORITY_LIMIT = 0.20
DROP_NULL_RATIO = 0.50
BALANCE_TARGET = 0.35
SYNTHETIC_ID_OFFSET = 1000
DEFAULT_SEED = 42

# --- inference ------------------------------------------------------------
ID_UNIQUENESS = 0.7
ID_FEW_VALUES = 10
TEXT_UNIQUENESS = 0.7
TEXT_UNIQUE_WITH_RATIO = 30
TEXT_UNIQUE = 1000
BINARY_MIN_VALUES = 5
NOMINAL_UNIQUENESS = 0.9
NOMINAL_UNIQUE = 100
CODE_UNIQUE = 25
DISCRETE_UNIQUE = 10
DISCRETE_MIN_VALUES = 50
FENCE_FACTOR = 1.5
NONNEGATIVE_SHARE = 0.95
ALIAS_SAMPLE = 500
SAMPLE_SIZE = 5

# Column-name patterns (case-insensitive, searched anywhere in the name).
ID_NAME = r"(?:^id$|_id$|^index$|^key$|_key$|^uuid$|^pk$|product_code|item_code|customer_code)"
IGNORE_NAME = (
    r"(?:name|description|comment|note|text|address|detail|summary"
    r"|street|block|lot|parcel|ward|tract|precinct|district"
    r"|\bunit\b|\bapt\b|\bsuite\b|\broom\b|floor"
    r"|zip(?:code)?|postal|(?:area.?code)"
    r"|phone|tel(?:ephone)?|fax|mobile|cell"
    r"|latitude|longitude|(?:^lat$)|(?:^lng$)|(?:^lon$)"
    r"|(?:^ssn$)|(?:^ein$)|(?:^tin$))"
)
CATEGORY_NAME = r"(?:type|code|category|class|group|status|mode|level|grade|tier|stage)"
TARGET_NAME = (
    r"(?:target|label|class|churn|outcome|^y$|result|flag|status|converted|survived|default|fraud)"
)

# --- vocabulary -----------------------------------------------------------
ROLES = ("id", "target", "feature", "ignore")
SEMANTIC_TYPES = ("numerical", "categorical", "binary", "text")

HIGH_NULL_RATIO = "HIGH_NULL_RATIO"
INVALID_BOUNDS = "INVALID_BOUNDS"
CLASS_IMBALANCE = "CLASS_IMBALANCE"
STATISTICAL_OUTLIER = "STATISTICAL_OUTLIER"

DROP = "DROP"
DROP_COLUMN = "DROP_COLUMN"
STATISTICAL_IMPUTE = "STATISTICAL_IMPUTE"
SYNTHETIC_SYNTHESIS = "SYNTHETIC_SYNTHESIS"
MANUAL_INPUT = "MANUAL_INPUT"
STRATEGIES = (DROP, STATISTICAL_IMPUTE, SYNTHETIC_SYNTHESIS, MANUAL_INPUT)

# --- messages (printf style) ----------------------------------------------
MSG_HIGH_NULL = "Column '%s' has a missingness ratio of %.1f%% (Threshold: 20%%)."
MSG_BOUNDS = "Column '%s' contains %d values (%.1f%%) outside valid domain [%s, %s]."
MSG_OUTLIER = "Column '%s' contains %d severe outliers (%.1f%%) (|Z-score| > 3.0)."
MSG_IMBALANCE = (
    "Column '%s' has severe class imbalance: minority class (%s) is only %.1f%% (Threshold: 20%%)."
)
MSG_TARGET_IMBALANCE = (
    "Target column '%s' has severe class imbalance: "
    "minority class (%s) is only %.1f%% (Threshold: 20%%)."
)

LABEL_NULLS = "%d Nulls (%.1f%%)"
LABEL_BOUNDS = "%d Out-of-bounds (%.1f%%)"
LABEL_OUTLIERS = "%d Outliers (%.1f%%)"
LABEL_IMBALANCE = "Imbalance (%.1f%%)"
LABEL_HEALTHY = "Healthy"

DESC_ID = "Identifier column (%d unique values)"
DESC_TEXT = "High-cardinality or free text (%d unique values)"
DESC_BINARY = "Binary feature (%d unique values)"
DESC_NOMINAL = "Nominal/identifier numeric column (%d unique values)"
DESC_DISCRETE = "Discrete categorical feature (%d unique values)"
DESC_NUMERICAL = "Numerical feature (%d unique values)"
DESC_CATEGORICAL = "Categorical feature (%d unique values)"

ISSUE_BOUNDS = "Invalid Bounds"
ISSUE_OUTLIER = "Statistical Outliers"
ISSUE_IMBALANCE = "Class Imbalance - %.1f%%"
ISSUE_NULLS = "High Missing Ratio - %.1f%%"

IMPACT_DROP = (
    "High missingness (%.1f%%) exceeds the 50%% threshold for reliable imputation; "
    "dropping the column preserves data integrity without losing records."
)
IMPACT_BALANCE = (
    "Synthesize records for minority class (%s) to reach 35%% balance; "
    "mitigates model bias and increases total row count."
)
IMPACT_BOUNDS_AND_OUTLIER = (
    "Both out-of-bounds values and statistical outliers are resolved in a single step "
    "using median imputation; preserves data integrity and keeps row count constant."
)
IMPACT_BOUNDS = (
    "Corrupted and out-of-bounds cells are imputed with the median; "
    "avoids row loss and maintains sample size."
)
IMPACT_OUTLIER = (
    "Outliers are replaced with realistic Gaussian distribution values; "
    "preserves sample variance and bell-curve geometry."
)
IMPACT_MODE = (
    "Missing categorical values are imputed with the most frequent value (mode) to prevent row loss."
)
IMPACT_MEDIAN = "Missing cells are populated with the statistical median to prevent row loss."
IMPACT_OTHER = "Anomalous cells are imputed to maintain data integrity."

ADVICE_HEADER = "[Local Rule-Engine Fallback]:"
ADVICE_NONE = "[Local Rule-Engine Fallback]: No critical remediation required."
ADVICE_ENTRY = "• '%s' (%s):\n  ➜ Recommended Decision: %s\n  ➜ Decision Impact: %s"
ADVICE_DECISION = r"Recommended Decision:\s*([A-Z_]+)"

FILE_READ, FILE_CREATE, FILE_WRITE = "[READ]", "[CREATE]", "[WRITE]"
FILE_ROWS = "%d rows"
FILE_STATE = "State: {run_id}"
EXPORT_PARTS = ("data", "decisions", "delta", "profile", "residual", "report")
ACTION_STRIP = "Strip whitespace padding across string features"
ACTION_ALIAS = "Normalize aliases to canonical values"
ACTION_SYNTHESIS = "Generate +%d synthetic rows to balance class"
ACTION_MANUAL = "Manual override: %s"

# --- ledger messages (str.format) -------------------------------------------
LOG_STRIP = "Applied whitespace stripping across {n} string features."
LOG_ALIAS = "Normalized {n} aliases in '{column}' to canonical values: {canonicals}."
LOG_STRIPPED_CELLS = "Stripped {n} cells of '{column}'."
LOG_ALIASED_CELLS = "Replaced {n} cells of '{column}' by their canonical value."
LOG_NO_COLUMN = "Skipped '{column}': column not found in dataset."
LOG_DROP = (
    "Applied DROP strategy on '{column}': removed feature column "
    "from dataset (preserved all {rows} records)."
)
LOG_MEDIAN = "Applied STATISTICAL_IMPUTE on '{column}': imputed anomalies with median ({value})."
LOG_MODE = "Applied STATISTICAL_IMPUTE on '{column}': imputed nulls with mode ('{value}')."
LOG_IMPUTE_EMPTY = "STATISTICAL_IMPUTE skipped for '{column}': no valid values to compute {what}."
LOG_IMPUTE_TYPE = "STATISTICAL_IMPUTE skipped for '{column}': unsupported type '{dtype}'."
LOG_MANUAL = (
    "Applied MANUAL_INPUT on '{column}': replaced {n} "
    "anomalous records with override value '{value}'."
)
LOG_MANUAL_EMPTY = "MANUAL_INPUT on '{column}' skipped: no override value provided."
LOG_MANUAL_CAST = "MANUAL_INPUT failed on '{column}': could not cast '{value}' to {dtype} ({error})."
LOG_UNKNOWN = "Unknown strategy '{strategy}' for column '{column}'. Skipped."
LOG_GAUSS = (
    "Synthesized and imputed {n} anomalous/missing values in '{column}' using "
    "Gaussian distribution (mean={mean:,.0f}, bounds=[{low:,.0f}, {high:,.0f}])."
)
LOG_NOT_BALANCED = " Not the target: no rows were added, its rarer class keeps {share:.1f}%."
LOG_GAUSS_EMPTY = "No valid data in '{column}' to compute distribution. Skipped synthesis."
LOG_GAUSS_NONE = "No anomalous values in '{column}'. Nothing synthesized."
LOG_GAUSS_TYPE = (
    "SYNTHETIC_SYNTHESIS selected for '{column}', "
    "but no synthesis method available for type '{dtype}'. Skipped."
)
LOG_ROWS = (
    "Synthesized {n} realistic minority records for '{column}'. "
    "Imbalance corrected from {old:.1f}% to {new:.1f}%."
)
LOG_ROWS_EMPTY = "Empty dataset provided for '{column}'. Skipped synthesis."
LOG_ROWS_CLASS = "Could not determine minority class for '{column}'. Skipped synthesis."
LOG_ROWS_BALANCED = (
    "Class balance already adequate for '{column}' ({old:.1f}%). Skipped synthesis."
)
LOG_ROWS_NONE = "No whole row is missing for '{column}'. Skipped synthesis."
LOG_INFERRED = (
    "Schema inferred via {method}: target='{target}', id_cols={ids}, "
    "ignore_cols={ignored}, {n} columns classified."
)
LOG_PROFILED = "Dataset profiling completed: {n} critical issues detected."
LOG_RESIDUAL = "Post-remediation verification: {n} residual issues detected."
LOG_VERIFIED = "Post-remediation verification passed: dataset is clean and validated."
LOG_EXPORTED = "Final clean dataset exported to '{path}'."

# texts read as true for a boolean override
TRUE_WORDS = ("true", "1", "yes", "t")

# --- characters trimmed as whitespace (Unicode White_Space) -----------------
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- dirty sample rows ------------------------------------------------------
DIRTY_CITIES = ("New York", "San Francisco", "Austin", "Seattle", "Chicago")
DIRTY_COUNTRIES = ("US", "USA", "United States", "united states", "US_OFFICIAL", None)
DIRTY_AGE_CUTS = (0.05, 0.08, 0.20)
DIRTY_SALARY_CUTS = (0.03, 0.10)
DIRTY_CITY_MISSING = 0.15
DIRTY_CHURN_RATE = 0.08
