"""Records that are the same but for formatting: white space, letter case, punctuation and the order of fields.

Byte-identical rows collapse first, with their counts; only the distinct survivors are brought to canonical form, all
by built-in expressions; they are then grouped on the full canonical text, and the counts summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiloom.session import stored

#: White space, control and format characters, punctuation of all kinds, and the ASCII signs used as punctuation.
MARK = r"[\s\p{Z}\p{Cf}\u0000\u0002-\u001f\u007f-\u009f\p{P}$+<=>^`|~]"
#: One word as a label: a word, then a colon or an equals sign, with marks or spaces between.
LABEL = r"(?<![\p{L}\p{N}\p{M}])\p{L}[\p{L}\p{M}]*[\s\p{Z}\"'”’»*_\])>]*[:=：]"
#: Rows per thousand of a table that make a raw row hot.
HOT_SHARE = 1000
HOT_LEAST = 10_000


def canonical(text: Column) -> Column:
    """``text`` in one case, without white space and punctuation; what separates two digits is kept.

    A mark inside a number (2.5) stays; white space, or several marks, between two digits stay as one separator, since
    two numbers aren't one. NULL stays NULL.
    """
    one_case = F.lower(F.upper(text))
    parted = F.regexp_replace(one_case, rf"(?<=\p{{Nd}})(?:{MARK}{{2,}}|[\s\p{{Z}}])(?=\p{{Nd}})", "\u0001")
    numbers = F.regexp_replace(parted, rf"(?<!\p{{Nd}}){MARK}|{MARK}(?!\p{{Nd}})", "")
    # Most texts have no number, and need no look at what is beside a mark.
    return F.when(text.rlike(r"\p{Nd}"), numbers).otherwise(F.regexp_replace(one_case, f"{MARK}+", ""))


def canonical_fields(text: Column) -> Column:
    """:func:`canonical`, and where the text consists of labelled parts (two labels or more, one at its start), the parts in sorted order.

    A part runs from its label to the next one, whatever separates them.
    """
    tidy = F.translate(text, "_", " ")
    parts = F.split(tidy, rf"(?={LABEL})")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^[\s\p{P}\p{S}]*\p{P}?(?=\p{L})", ""))
    labelled = F.filter(F.transform(parts, lambda p: canonical(p)), lambda p: p != "")
    signs = F.length(text) - F.length(F.translate(text, ":=：", ""))
    is_fields = (signs >= 2) & (F.regexp_count(tidy, F.lit(LABEL)) >= 2) & tidy.rlike(rf"^[\s\p{{Z}}\p{{P}}\p{{S}}]*{LABEL}")
    # Between label and value, too, any mark will do.
    return F.when(is_fields, F.concat(F.lit("\u0002"), F.array_join(F.array_sort(labelled), "\u0001"))).otherwise(canonical(text))


def _has_content(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def _raw_groups(df: DataFrame, id_: str, text: str, swapped: tuple[str, str]) -> DataFrame:
    """The byte-identical groups with their canonical key: (t, a, b, n, first_raw, key, content)."""
    a, b = swapped
    raw = df.select(F.col(id_).alias("id"), F.col(text).alias("t"), F.col(a).alias("a"), F.col(b).alias("b"))
    raw = raw.groupBy("t", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_raw"))
    ca, cb = canonical(F.col("a")), canonical(F.col("b"))
    pair = F.array_sort(F.array(F.struct(ca.isNull().alias("x"), F.coalesce(ca, F.lit("")).alias("y")), F.struct(cb.isNull().alias("x"), F.coalesce(cb, F.lit("")).alias("y"))))
    key = F.struct(F.col("t").isNull().alias("no_text"), F.coalesce(canonical_fields(F.col("t")), F.lit("")).alias("text"), pair.alias("pair"))
    return raw.withColumn("content", _has_content(F.col("t"))).withColumn("key", key)


def collapsed(df: DataFrame, id_: str, text: str, swapped: tuple[str, str]) -> DataFrame:
    """One row for each set of records equal but for formatting: (first_id, copies, variants, text, and the two fields).

    ``text`` and the two fields ``swapped``, which may stand in each other's place, are compared in canonical form
    (:func:`canonical_fields`); a NULL field equals only NULL. first_id is the least id, copies counts the records, variants
    their byte-different forms; the text and fields are those of the first. A text that is NULL or without any letter or digit
    has no content to compare: only its byte-identical copies are one row. Repeated rows count each. Empty tables give no row.
    """
    groups = _raw_groups(df, id_, text, swapped)
    whole = groups.groupBy("content", "key", F.when(~F.col("content"), F.struct("t", "a", "b")).alias("as_is"))
    out = whole.agg(F.min("first_raw").alias("first_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("variants"), F.min_by(F.struct("t", "a", "b"), "first_raw").alias("x"))
    return out.select("first_id", "copies", "variants", F.col("x.t").alias(text), F.col("x.a").alias(swapped[0]), F.col("x.b").alias(swapped[1]))


def _digest(t: str, a: str, b: str) -> Column:
    """SHA-256 of the raw fields, each with its length so that they can't run into one another."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part(t), part(a), part(b)), 256))


def copies(df: DataFrame, id_: str, text: str, swapped: tuple[str, str]) -> DataFrame:
    """(first_id, copy_id): for each set of :func:`collapsed` the least id with each other id of the set.

    Records whose text is NULL or has no letter or digit are in no set; a NULL field equals only NULL. A NULL id is no
    record's id and gives no row; an id that repeats is one record.

    The counts are summed as in :func:`collapsed`. To name the records, each is joined to its raw group by the SHA-256 of
    its raw fields; the groups that hold at least a thousandth of the rows, at most a thousand, go to every executor, so
    that no task holds all copies of one text.
    """
    rows = df.where(F.col(id_).isNotNull())
    groups = _raw_groups(rows, id_, text, swapped).where("content")
    # Written once: the canonical forms are needed twice, and cost more than the reading.
    groups = stored(groups.select("key", _digest("t", "a", "b").alias("raw"), "n", "first_raw"))
    firsts = groups.groupBy("key").agg(F.min("first_raw").alias("first_id"), F.sum("n").alias("all"))
    # Only sets of several records matter below.
    firsts = firsts.where("all > 1").select("key", "first_id")
    members = groups.select("key", "raw", "n").join(firsts, "key").select("raw", "n", "first_id")
    hot_from = max(HOT_LEAST, df.count() // HOT_SHARE)
    records = rows.select(F.col(id_).alias("copy_id"), F.col(text).alias("t"), F.col(swapped[0]).alias("a"), F.col(swapped[1]).alias("b")).where(_has_content(F.col("t")))
    records = records.select("copy_id", _digest("t", "a", "b").alias("raw"))
    hot = members.where(F.col("n") >= hot_from).select("raw", F.col("first_id").alias("hot_id"))
    records = records.join(F.broadcast(hot), "raw", "left")
    rest = records.where("hot_id IS NULL").drop("hot_id").join(members.where(F.col("n") < hot_from).select("raw", "first_id"), "raw")
    out = records.where("hot_id IS NOT NULL").select(F.col("hot_id").alias("first_id"), "copy_id").unionAll(rest.select("first_id", "copy_id"))
    return out.where("first_id <> copy_id")
