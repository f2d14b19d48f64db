"""Values that results depend on. Rules are (regular expression, replacement), applied in the order given."""

# ---- fixed values -------------------------------------------------------------------------------

# Shortening of index labels.
INDEX_LABEL_RULES = [
    ("and", ""),
    ("  ", " "),
    ("domain", "dmn"),
    ("environment", "environ"),
    ("education", "edu"),
    ("social", "soc"),
    ("economic", "econ"),
    ("opportunity", "oppty"),
    ("child ", ""),
    (" ", "_"),
]

# Shortening of subdomain labels: one more step, the longer word before the shorter one.
SUBDOMAIN_LABEL_RULES = [
    ("and", ""),
    ("  ", " "),
    ("domain", "dmn"),
    ("environment", "environ"),
    ("educational", "edu"),
    ("education", "edu"),
    ("social", "soc"),
    ("economic", "econ"),
    ("opportunity", "oppty"),
    ("child ", ""),
    (" ", "_"),
]

# Clean-up of district names. The dot is a regular expression dot: any character matches.
DISTRICT_NAME_RULES = [
    ("school district", ""),
    ("st. ", "st "),
    ("city city", "city"),
]

# Column families that are cut from the measure files, and the rows kept from their dictionaries.
DROPPED_SUFFIXES = ["_nat", "_met"]
DROPPED_PREFIX = "c5_"
KEPT_SUFFIX = "_stt"
STANDARDISED_MARK = "z_"
STANDARDISED_SUFFIX = " std"

# Suffixes of clashing columns after a join.
RIGHT_SUFFIX = "_right"
LEFT_SUFFIX = "_left"

# Join keys, state code and code modulus of the measure files.
MEASURE_KEYS = ["geoid10", "year"]
STATE_CODE = 1
COUNTY_MODULUS = 1000

# Cells read as null by the bulk loader (the default set of the common Python CSV reader).
NULL_MARKERS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Cells that reader takes as truth values.
TRUTH_WORDS = ["True", "TRUE", "true", "False", "FALSE", "false"]

# Raw data folders: (level, category).
RAW_LEVELS = ["school", "student", "teacher"]
RAW_CATEGORIES = ["edunomics"]

# Columns of the district table view and their labels; rows per page.
TABLE_VIEW_COLUMNS = [
    ("grade", "Grade"),
    ("year", "Year"),
    ("math", "Math Score"),
    ("rla", "Reading Score"),
]
PAGE_SIZE = 10

# Factor of the cleaned sample, rows per database batch.
VALUE_FACTOR = 1.1
BATCH_ROWS = 1000

# Scenario forms: number of district and grade fields, range of random values, text of a missing result.
DISTRICT_FIELDS = 10
GRADE_FIELDS = 2
PERCENT_LOW = -100.0
PERCENT_HIGH = 100.0
MISSING_TEXT = "N/A"
REQUIRED_MESSAGE = "This field is required."
NUMBER_MESSAGE = "Must be a number"

# ---- end of fixed values ------------------------------------------------------------------------

# Patterns of our own.
WHITESPACE_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
WORDS_AND_GAPS = r"([\p{L}\p{N}]+[^\p{L}\p{N}]*|[^\p{L}\p{N}]+)"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|inf|NaN)$"
PADDED_DECIMAL_PATTERN = r"^[\s\p{Z}]*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?[\s\p{Z}]*$"
