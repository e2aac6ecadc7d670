"""Fixed values the results depend on.

These are domain constants (status lists, thresholds, bounds, labels and
formats). They are stated as they are, because changing one changes results.
"""

# Loan statuses that carry a usable repayment signal.
POSITIVE_STATUSES = ("Fully Paid", "Current")
NEGATIVE_STATUSES = ("Charged Off", "Default")

# Statuses that mark a row of a vintage file as a loan rather than a note.
LOAN_ROW_STATUSES = (
    "Fully Paid",
    "Current",
    "Charged Off",
    "Default",
    "Late (31-120 days)",
    "Late (16-30 days)",
    "In Grace Period",
    "Does not meet the credit policy. Status:Fully Paid",
    "Does not meet the credit policy. Status:Charged Off",
)

# Employment lengths in display order.
EMP_LENGTHS = (
    "< 1 year", "1 year", "2 years", "3 years", "4 years", "5 years",
    "6 years", "7 years", "8 years", "9 years", "10+ years", "n/a",
)

# Sampling and splitting.
SAMPLE_RATE = 0.07
SAMPLE_FLOOR = 30
SEED = 42

# Features.
TOP_N_STATES = 10
USER_NUMERIC = ("annual_inc", "dti", "fico_range_low", "fico_range_high")
USER_CATEGORICAL = ("home_ownership", "addr_state")
ITEM_NUMERIC = ("int_rate", "loan_amnt")
ITEM_CATEGORICAL = ("grade", "purpose", "term")
MISSING_CATEGORY = "Unknown"
RARE_CATEGORY = "other"

# Negative sampling.
NEGATIVES_PER_POSITIVE = 4
POPULARITY_POWER = 0.75
TRIES_PER_NEGATIVE = 20

# Collaborative filtering.
ALS_FACTORS = 64
ALS_ITERATIONS = 20
ALS_REGULARISATION = 0.1
ALS_CONFIDENCE = 40.0

# Cell-based retrieval.
IVF_MIN_CELLS = 64
IVF_MAX_CELLS = 4096
IVF_PROBE_DIVISOR = 8

# Repayment model.
GBT_ROUNDS = 300
GBT_DEPTH = 6
GBT_STEP = 0.1
GBT_SUBSAMPLE = 0.8

# Decisions.
APPROVAL_THRESHOLD = 0.65
REPORT_APPROVAL_THRESHOLD = 0.60
REPAY_BAND_HIGH = 70
REPAY_BAND_MEDIUM = 50
DEFAULT_RATE = 12.0
DEFAULT_PURPOSE = "other"
DEFAULT_TERM = "Unknown"

# Request bounds and defaults.
TOP_K_RANGE, TOP_K_DEFAULT = (1, 100), 10
RERANK_POOL_RANGE, RERANK_POOL_DEFAULT = (1, 100), 20
RETRIEVAL_POOL_RANGE, RETRIEVAL_POOL_DEFAULT = (10, 500), 100

# Explanation: field -> label.
FIELD_LABELS = {
    "annual_inc": "Annual Income ($)",
    "dti": "Debt-to-Income Ratio",
    "fico_range_low": "FICO Score (Low)",
    "fico_range_high": "FICO Score (High)",
    "home_ownership": "Home Ownership",
    "addr_state": "State",
    "loan_amnt": "Requested Loan Amount ($)",
}

# Improvement search: field -> (direction that helps, lower bound, upper bound).
IMPROVEMENT_FIELDS = {
    "annual_inc": (1, 0.0, 500_000.0),
    "dti": (-1, 0.0, 50.0),
    "fico_range_low": (1, 300.0, 850.0),
    "fico_range_high": (1, 300.0, 850.0),
    "loan_amnt": (-1, 500.0, 40_000.0),
}
MIN_SUGGESTED_CHANGE = 0.5
HOME_OPTIONS = ("OWN", "MORTGAGE", "RENT", "OTHER")

# Significance reporting.
MIN_PAIRED_USERS = 5
LOW_POWER_USERS = 30
SIGNIFICANCE_LEVEL = 0.05

# Reports.
RECENT_APPLICATIONS = 50
HISTOGRAM_BINS = {"loan_amnt": 60, "annual_inc": 60, "fico_range_low": 40, "dti": 50}
QUANTILE_CAP = 0.99
MISSING_SHARE = 1e-9
# Verdict on a sample by its divergence: below the bound, else the last word.
DIVERGENCE_VERDICTS = ((0.001, "Excellent"), (0.01, "Good"))
DIVERGENCE_REST = "Acceptable"

# Split boundaries of the test tables, whose orders run from 1995 to 2001.
VAL_START = "1997-01-01"
TEST_START = "1998-01-01"
