"""Fixed values. Results depend on these texts and numbers being exactly what they are."""

# Text patterns
MENTION_PATTERN = r"@\w+"
MENTION_MASK = "<USER>"
RETWEET_PATTERN = r"^RT @\w+:"
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"

# County codes
COUNTY_PATTERN = r"^\d{5}$"
SHORT_COUNTY_PATTERN = r"^\d{1,4}$"
COUNTY_WIDTH = 5

# Messages per user-week: low and high end of each band, both inclusive
QUIET_WEEK = (1, 10)
ACTIVE_WEEK = (11, 100)
SUPER_WEEK_FROM = 101

# Message limit of a batch, and the largest batch number
BATCH_LIMIT = 3_000_000
LARGE_BATCH_LIMIT = 5_000_000
LAST_BATCH_NUMBER = 60

# Shape of a layered embedding, and the layer that is scored, counted from the end
N_LAYERS = 4
LAYER_DIM = 1024
SCORED_LAYER_FROM_END = 2

# Names and ranges of features and scores
FEATURE_SUFFIX = "me"
SCORE_LOW = 0.0
SCORE_HIGH = 5.0
SCORE_FEATURES = {"DEP_SCORE": "scaled_dep_score", "ANX_SCORE": "scaled_anx_score"}
DEFAULT_USER_WEIGHT = 1.0
