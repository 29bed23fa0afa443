"""Small frames with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box with five dozen liquor jugs near old town".split()
CLEAN = " ".join(f"{WORDS[(7 * i + i // 3) % len(WORDS)]}{i}" for i in range(120))
LONG = " ".join(f"w{i * 7919 % 49999}" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = "row fp who uid cell size hash key spans base cands target times n_words kept failed_bits k u h host content template html sequence_id start length bytes".split()


def documents(spark):
    rows = [
        (1, CLEAN, "en", "a", len(CLEAN)), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, CLEAN, "en", None, len(CLEAN)),
        (None, CLEAN + " extra", "en", "b", 5), (5, " \t\n ", "en", "b", 4), (6, LONG, "en", "c", len(LONG)), (7, "one", "en", "c", 3),
        (8, "café \U0001F600 naïve x ſecret " + CLEAN, "fr", "c", 1), (9, "same row", "en", "d", 8), (9, "same row", "en", "d", 8),
        (9, "same row", "en", "d", 8), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """With extra columns named like the operators' own."""
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASHES if c not in df.columns})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
