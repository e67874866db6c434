"""Schemas of the raw NDJSON records and the canonical tables, plus the fixed
values whose content must equal the source application's for equal results."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw (NDJSON) record schemas. Every scalar is read as a string so that a
# number, a string or a nested value in the same field never fails the parse;
# numeric coercion happens afterwards with try_cast (lenient int).
# ---------------------------------------------------------------------------
#: Text fields of the records that are read as integers.
INT_TEXT_FIELDS = ("watch_count", "bytes")

CORRUPT_COL = "_corrupt"

RAW_COMMIT = T.StructType(
    [
        T.StructField("commit", T.StringType()),
        T.StructField("repo_name", T.StringType()),
        T.StructField(
            "author",
            T.StructType(
                [T.StructField("name", T.StringType()), T.StructField("email", T.StringType())]
            ),
        ),
        T.StructField("committer", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField(
            "difference",
            T.ArrayType(T.StructType([T.StructField("new_path", T.StringType())])),
        ),
        T.StructField("subject", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("tree", T.StringType()),
    ]
)

RAW_REPO = T.StructType(
    [T.StructField("repo_name", T.StringType()), T.StructField("watch_count", T.StringType())]
)

RAW_LICENSE = T.StructType(
    [T.StructField("repo_name", T.StringType()), T.StructField("license", T.StringType())]
)

RAW_LANGUAGE = T.StructType(
    [
        T.StructField("repo_name", T.StringType()),
        T.StructField(
            "language",
            T.ArrayType(
                T.StructType(
                    [T.StructField("name", T.StringType()), T.StructField("bytes", T.StringType())]
                )
            ),
        ),
    ]
)


def with_corrupt(schema: T.StructType) -> T.StructType:
    """The raw schema plus the corrupt-record column used by PERMISSIVE parsing."""
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COL, T.StringType())])


# ---------------------------------------------------------------------------
# Canonical tables.
# ---------------------------------------------------------------------------
COMMITS = T.StructType(
    [
        T.StructField("commit_hash", T.StringType()),
        T.StructField("repo_name", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("author_email", T.StringType()),
        T.StructField("committer_name", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("tree", T.StringType()),
        T.StructField("files_changed", T.ArrayType(T.StringType())),
        T.StructField("num_files_changed", T.LongType()),
    ]
)
COMMIT_COLUMNS = [f.name for f in COMMITS.fields]

REPOS = T.StructType(
    [
        T.StructField("repo_name", T.StringType()),
        T.StructField("watch_count", T.LongType()),
        T.StructField("name_length", T.LongType()),
    ]
)

LICENSES = T.StructType(
    [T.StructField("repo_name", T.StringType()), T.StructField("license", T.StringType())]
)

LANGUAGES = T.StructType(
    [
        T.StructField("repo_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("bytes", T.LongType()),
    ]
)

# A batch of record changes (create / update / delete), applied in seq order.
CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("commit_hash", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("repo_name", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source application's values for the
# results to match; they are listed plainly and in their original order.
# ---------------------------------------------------------------------------

# Words dropped by the common-words report (47 entries, "" included).
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "at",
    "is", "it", "be", "as", "by", "with", "from", "that", "this", "was",
    "are", "not", "but", "if", "when", "we", "i", "you", "so", "into",
    "up", "out", "no", "do", "can", "has", "have", "had", "will", "-",
    "*", "+", "=", "|", "&", "",
]

# Minimum word length of the common-words report.
MIN_WORD_LENGTH = 3

# Dense watch tiers: (low, high inclusive or None for open-ended, label).
WATCH_TIERS = [
    (0, 0, "0 watchers"),
    (1, 9, "1 to 9"),
    (10, 99, "10 to 99"),
    (100, 999, "100 to 999"),
    (1000, 9999, "1,000 to 9,999"),
    (10000, None, "10,000+"),
]
TIER_ORDER = [label for _, _, label in WATCH_TIERS]
# Label a count gets when no tier matches (negative counts).
TIER_FALLBACK = "0 watchers"

# Sparse watch buckets: boundaries [b0, b1), ..., [b5, b6); all else "other".
BUCKET_BOUNDARIES = [0, 1, 10, 100, 1000, 10000, 1000000]
BUCKET_LABELS = {
    0: "0 watchers",
    1: "1 to 9",
    10: "10 to 99",
    100: "100 to 999",
    1000: "1,000 to 9,999",
    10000: "10,000+",
}
BUCKET_DEFAULT = "other"

# Fields an update may change.
UPDATABLE_FIELDS = [
    "repo_name", "author_name", "author_email", "committer_name",
    "subject", "message", "tree", "num_files_changed",
]
# Of those, the fields that must hold an integer.
INTEGER_FIELDS = ["num_files_changed"]

# Defaults for absent fields of a commit record.
DEFAULT_NAME = "unknown"
DEFAULT_TEXT = ""

# Bar widths of the text reports.
BAR_WIDTH_CONTRIBUTORS = 40
BAR_WIDTH_HISTOGRAM = 35
BAR_WIDTH_WORDS = 35
BAR_WIDTH_LICENSES = 30

# Default report sizes.
TOP_CONTRIBUTORS = 10
TOP_LICENSES = 10
TOP_LANGUAGES = 10
TOP_WORDS = 15
TOP_WATCHED = 10
TOP_NAMES = 5
LIST_LIMIT = 10
