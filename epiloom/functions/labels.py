"""Rules on captions: each a predicate, together an ordered list of codes for every caption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiloom.functions.text import issues, word_count

#: The fields a caption must have, the values they may take, and the words the rules look for. Fixed values.
FIELDS = ("start_ts", "end_ts", "text", "verb", "noun", "hand", "visibility")
HANDS = ("LEFT", "RIGHT", "BOTH", "NEITHER")
VISIBILITY = ("FULL", "PARTIAL", "OCCLUDED", "OUT_OF_FRAME")
VERBS = ("align", "close", "fold", "grasp", "hold", "insert", "lift", "open", "place", "pour", "press", "pull", "push", "remove", "rotate", "shake", "slide", "stack", "tap", "tilt", "turn", "twist", "wipe")
BANNED = r"\b(maybe|probably|appears to|seems to|begins to|attempts to)\b"


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\S+)", 1)


def verb_count(text: Column) -> Column:
    """How many words of the text are verbs of the vocabulary."""
    return F.size(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(*VERBS)))


def lint(low: float = 1.3, high: float = 4.0) -> Column:
    """The codes of the broken rules, in order. If a field is missing, just those that are."""
    missing = issues(*[(F.col(f).isNull(), f"A0_{f}") for f in FIELDS])
    length = F.col("end_ts") - F.col("start_ts")
    text, words, lower = F.col("text"), word_count(F.col("text")), F.lower("text")
    rules = issues(
        (length <= 0, "A1_empty"),
        ((length > 0) & (length < low), "A1_short"),
        (length > high, "A1_long"),
        ((words < 6) & ~F.coalesce("uncertain", F.lit(False)), "A2_few_words"),
        (words > 15, "A2_many_words"),
        (verb_count(text) == 0, "A3_no_verb"),
        (verb_count(text) > 1, "A3_many_verbs"),
        (~F.contains(lower, F.lower(F.trim("verb"))), "A4_verb_not_in_text"),
        (~F.contains(lower, F.lower(F.trim("noun"))), "A4_noun_not_in_text"),
        (~F.col("hand").isin(*HANDS), "A5_hand"),
        (~F.col("visibility").isin(*VISIBILITY), "A5_visibility"),
        (lower.rlike(BANNED), "A6_phrasing"),
        (~first_word(text).rlike("^[A-Z][a-z]+$"), "A7_first_word"),
        (first_word(lower).rlike("^[a-z]+ing$"), "A7_gerund"),
        ((F.col("rotation") == "clockwise") & F.contains(lower, F.lit("counter-clockwise")), "A9_rotation"),
    )
    return F.when(F.size(missing) > 0, missing).otherwise(rules)
