"""Detection of texts that were cut off before their end.

First every text's length is taken under several encodings (characters, UTF-8 bytes, UTF-16 units, entity escaping, JSON
escaping, line ends of one and of two characters). Grouped by source and measure over distinct texts, a length that occurs
many times as often as its neighbours is a hidden storage limit. Then the endings are inspected: structured texts (JSON,
tables, records of key=value) must close what they opened; sentences must be ended. What is left open is judged by where
the text stands: at a limit of its source it is cut unless its ending is one that the source is used to; elsewhere it is
cut only if its last word speaks against an end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiloom.session import checkpointed

#: The encodings a length is taken under.
MEASURES = ("chars", "utf8", "utf16", "entities", "entities_utf8", "json", "json_utf8", "crlf", "lf")
#: A limit's length occurs at least so often, and so many times as often as the lengths within REACH of it on average.
SPIKE_LEAST, SPIKE_TIMES, REACH, SHORTEST = 8, 4.0, 16, 48
#: Distinct texts of a source from which an unpunctuated closing phrase may be its habit (a sign-off).
HABIT_LEAST = 5
#: Share of a source's punctuated endings from which an unpunctuated one is out of place.
PROSE_SHARE = 0.5
#: Share of a word's occurrences that end a unit, from which it can end one; the same where unpunctuated endings are out
#: of place; share of a source's endings that make one dominant.
FINAL_SHARE, PROSE_FINAL_SHARE, DOMINANT_SHARE = 0.02, 0.5, 0.05
#: Abbreviations that don't end a sentence.
ABBREVIATIONS = ("approx", "i.e", "e.g", "cf", "vs", "ca", "fig", "no", "z.b", "bzw", "p.ex", "p.ej", "ref", "dr", "mr", "mrs")
#: The beginnings of those with an inner point, too.
_UNENDED = {*ABBREVIATIONS, *(a.partition(".")[0] for a in ABBREVIATIONS)}
_DOTTED = {a for a in ABBREVIATIONS if "." in a}
#: Parts that joins by source split each source into.
SALTS = 16
#: Bytes of text that are counted at once; characters of a phrase or word that are compared.
AT_ONCE, PHRASE, WORD = 4_000_000, 48, 48

_END_PATTERN = r"[.!?。！？](?:[\"'”’»)\]*_]|\s*👍)*$"
_END = re.compile(_END_PATTERN)
_BREAK_PATTERN = r"(?:[.!?…][\"'”’»)\]]*\s+|[。！？][」』\"'”’»)\]]*\s*|\n+)"
_BREAK = re.compile(_BREAK_PATTERN)
_MARKER_PATTERN = r"(?:…|\.{3,}|\[\.\.\.\]|\[(?i:truncated)\])$"
_MARKER = re.compile(_MARKER_PATTERN)
_BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)]|\[.?\])\s+\S")
_JSON_PATTERN = r"^\s*(?:```\w*\s*)?[{\[]\s*(?:[\"{\[\]}]|-?\d|$)"
_JSON = re.compile(_JSON_PATTERN)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_BRACKET = re.compile(r"[{}\[\]]")
_PAIR = re.compile(r"^[A-Za-z_][\w.]*=\S*$")
_BARE_NUMBER = re.compile(r"(?:^|[\s=(≤≥±<>~])\d+\.[\"')]*$")
_DIGITS = re.compile(r"[0-9]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_BLANKS = " \t\r\n\f\v    　​‌‍⁠﻿  \x00"
_MARKS = "\"'“”‘’«»()[]{}*_`.,;:!?。、！？…|「」『』"
#: Marks after which a sentence goes on.
_OPEN = ",;:–—-=&/+、"


def measures(text: pa.StringArray) -> np.ndarray:
    """The lengths of each text (none NULL) under the encodings of MEASURES, in columns, from one pass over the bytes."""
    text = text.cast(pa.large_string())
    data, offsets = text.buffers()[2], np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(text) else np.empty(0, np.uint8)
    at = offsets - offsets[0]

    def many(byte_is: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(byte_is), at))

    utf8 = np.diff(at)
    rest, high, wide = many((raw & 0xC0) == 0x80), many(raw >= 0x80), many(raw >= 0xF0)
    chars = utf8 - rest
    line = raw == 0x0A
    lines, pairs = many(line), many(line & np.append(False, raw[:-1] == 0x0D)[: len(raw)])
    quotes = many(raw == 0x22)
    entities = many(raw == 0x26) * 4 + many((raw == 0x3C) | (raw == 0x3E)) * 3 + quotes * 5
    escaped = quotes + lines + many((raw == 0x5C) | (raw == 0x0D) | (raw == 0x09))
    out = (chars, utf8, chars + wide, chars + entities, utf8 + entities, chars + escaped + (high - rest) * 5 + wide * 6, utf8 + escaped, chars + lines - pairs, chars - pairs)
    return np.stack(out, axis=1)


def storage_limits(lengths: DataFrame) -> DataFrame:
    """The hidden limits of (source, measure, length, n): lengths far more frequent than those around them."""
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-REACH, REACH)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * REACH)
    counts = lengths.groupBy("source", "measure", "length").agg(F.sum("n").alias("n")).withColumn("around", around)
    return counts.where((F.col("length") >= SHORTEST) & (F.col("n") >= SPIKE_LEAST) & (F.col("n") >= F.col("around") * SPIKE_TIMES))


def _json_closed(text: str) -> bool:
    body, fenced = text.strip(), False
    if body.startswith("```"):
        fenced, body = True, re.sub(r"^```\w*\s*", "", body)
    try:
        end = json.JSONDecoder().raw_decode(body)[1]
    except (ValueError, RecursionError):
        # Not JSON to the letter: the brackets outside of strings decide. An open string swallows none of them.
        bare = _STRING.sub(lambda m: " " * len(m[0]), body)
        opened = bare.find('"')
        depth, end = 0, -1
        for m in _BRACKET.finditer(bare, 0, opened if opened >= 0 else len(bare)):
            depth += 1 if m[0] in "{[" else -1
            if depth <= 0:
                end = m.end()
                break
        if end < 0:
            return False
    return "```" in body[end:] if fenced else True


def _shape(line: str) -> str:
    """The form of a record's line: names of its pairs, and other words with letters and digits made alike."""
    out = []
    for token in line.split():
        name, eq, _ = token.partition("=")
        out.append(name + "=" if eq else re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", token)))
    return " ".join(out)


def _is_record(line: str) -> bool:
    if line.count("=") < 3:
        return False
    tokens = line.split()
    pairs = sum(bool(_PAIR.match(t)) for t in tokens)
    return pairs >= 3 and pairs * 2 >= len(tokens)


def _last_value(line: str) -> int:
    return len(line.rpartition("=")[2]) if "=" in line.split()[-1] else -1


def norm(text: str) -> str:
    """Lower case, every number as 9, white space single."""
    return " ".join(_DIGITS.sub("9", text.lower()).split())


def word(token: str) -> str:
    """A normalised token without marks around it; of scripts without spaces, its last characters."""
    bare = token.strip(_MARKS)
    if _CJK.search(bare):
        return "§" + bare[-3:]
    return (bare or token)[-WORD:]


def phrase(first: str, second: str | None) -> str:
    """The beginning of a unit: two words, or some characters where there are no spaces."""
    a = first.strip(_MARKS) or first
    if _CJK.search(a):
        return a[:8]
    if second is None:
        return a[:PHRASE]
    return f"{a} {second.strip(_MARKS) or second}"[:PHRASE]


def _phrase(first: Column, second: Column) -> Column:
    """:func:`phrase` as a column expression."""
    bare = lambda x: F.coalesce(F.nullif(F.btrim(x, F.lit(_MARKS)), F.lit("")), x)
    a = bare(first)
    return F.when(a.rlike(_CJK.pattern), F.substring(a, 1, 8)).otherwise(F.substring(F.concat_ws(" ", a, bare(second)), 1, PHRASE))


def _lines(body: str) -> list[str]:
    return [x for x in body.splitlines() if x.strip(_BLANKS)]


def _last_break(body: str) -> int:
    """Where the last unit begins; the last part of the text is looked at first."""
    for start in (max(0, len(body) - 600), 0):
        at = 0
        for m in _BREAK.finditer(body, start):
            at = m.end()
        if at or not start:
            return at
    return 0


def ending(text: str) -> tuple[str, str, str]:
    """How a text ends: (verdict, tail, last word).

    The verdict is 'none' (blank), 'whole', 'cut', 'record' (one line of a record, whose tail is its shape and the length
    of its last value), 'marked' (an ellipsis), 'tail' (a sentence not ended) or 'line' (the last item of a list). The
    tail is what follows the last ended unit, normalised, or empty if that is no short phrase; a last word keeps a mark
    after which a sentence goes on.
    """
    body = text.strip(_BLANKS)
    if not body:
        return "none", "", ""
    if body[0] in "{[`" and _JSON.match(body):
        return ("whole" if _json_closed(body) else "cut"), "", ""
    if body[0] == "|":
        lines = _lines(body)
        bars, last = lines[0].strip(_BLANKS), lines[-1].strip(_BLANKS)
        full = bars.endswith("|") and len(lines) > 1
        return ("whole" if last.endswith("|") and (not full or last.count("|") == bars.count("|")) else "cut"), "", ""
    if _is_record(body.partition("\n")[0]):
        lines = _lines(body)
        last = lines[-1].strip(_BLANKS)
        if len(lines) == 1:
            return "record", f"{_shape(last)}\t{_last_value(last)}", ""
        before = [x.strip(_BLANKS) for x in lines[:-1]]
        lengths = {_last_value(x) for x in before}
        same = _shape(last).split()[1:] == _shape(before[0]).split()[1:] and len(last.split()[0]) >= min(len(x.split()[0]) for x in before)
        return ("whole" if same and (len(lengths) > 1 or _last_value(last) in lengths) else "cut"), "", ""
    marker = _MARKER.search(body, max(0, len(body) - 64))
    if marker:
        start = marker.start()
        while marker[0][0] == "." and start and body[start - 1] == ".":
            start -= 1
        body = body[:start].rstrip(_BLANKS)
        if not body:
            return "none", "", ""
    if _END.search(body, max(0, len(body) - 64)):
        token = re.sub(r"^[\W_]+", "", body.rsplit(None, 1)[-1].lower()).rstrip("\"'”’»)]*_").rstrip(".")
        if body.rstrip("\"'”’»)]*_").endswith(".") and (token in _UNENDED or _BARE_NUMBER.search(body, max(0, len(body) - 64))):
            return "cut", "", ""
        return "whole", "", ""
    tail = norm(body[_last_break(body) :] or body)
    last = tail.rpartition(" ")[2]
    tail = tail if len(tail) <= PHRASE else ""
    if last.lstrip(_MARKS) in _DOTTED:
        return "cut", "", ""
    token = last[-WORD:] if last[-1] in _OPEN and len(last) > 1 else word(last)
    if marker:
        return "marked", tail, token
    if _BULLET.match(body[body.rfind("\n") + 1 :]) and sum(bool(_BULLET.match(x)) for x in body.splitlines()) > 1:
        return "line", tail, token
    return "tail", tail, token


def _inspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "source", "digest", "verdict", "tail", "last", "lengths"]
    for batch in batches:
        text = batch.column("text")
        texts = text.to_pylist()
        verdict, tail, last = zip(*(ending(t) for t in texts)) if texts else ((), (), ())
        digest = pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
        lengths = measures(text).astype(np.int32)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), digest, *(pa.array(x, pa.string()) for x in (verdict, tail, last)), pa.ListArray.from_arrays(offsets, pa.array(lengths.ravel()))], names)


def units(text: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, normalised, and whether each is known to be ended: all but a text's last one without punctuation or with an ellipsis."""
    text = pc.utf8_trim(text, characters=_BLANKS)
    text = pc.replace_substring_regex(pc.utf8_lower(text), "[0-9]+", "9")
    pieces = pc.split_pattern(pc.replace_substring_regex(text, _BREAK_PATTERN.replace(r"\s", r"[\s\pZ]"), "\\0\x1e"), "\x1e")
    flat = pc.utf8_trim_whitespace(pieces.flatten())
    final = np.asarray(pieces.offsets)[1:] - 1 - pieces.offsets[0].as_py()
    final = final[np.diff(np.asarray(pieces.offsets)) > 0]
    ended = np.ones(len(flat), dtype=bool)
    ends = flat.take(pa.array(final))
    stops = pc.and_not(pc.match_substring_regex(ends, _END_PATTERN), pc.match_substring_regex(ends, _MARKER_PATTERN))
    ended[final] = stops.to_numpy(zero_copy_only=False)
    there = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(there), ended[there.to_numpy(zero_copy_only=False)]


def _sum_by_name(names: list[str], counts: list[int]) -> Counter:
    out: Counter = Counter()
    for name, n in zip(names, counts):
        out[name] += n
    return out


def _counts(text: pa.StringArray) -> dict[str, Counter]:
    """Of some texts: the words inside and at the end of units, and the phrases that begin units."""
    unit, ended = units(text.filter(pc.invert(pc.match_substring_regex(text, _JSON_PATTERN))))
    if not len(unit):
        return {}
    tokens = pc.utf8_split_whitespace(unit)
    first = np.asarray(tokens.offsets)
    first, stop = first[:-1] - first[0], first[1:] - first[0]
    coded = tokens.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    is_last = np.zeros(len(code), dtype=bool)
    is_last[stop - 1] = True
    inside = np.bincount(code[~is_last], minlength=len(names))
    final = np.bincount(code[stop[ended] - 1], minlength=len(names))
    second = np.where(stop - first > 1, code[np.minimum(first + 1, len(code) - 1)], -1)
    pair, n = np.unique(code[first] << 32 | (second + 1), return_counts=True)
    phrases = [phrase(names[p >> 32], names[(p & 0xFFFFFFFF) - 1] if p & 0xFFFFFFFF else None) for p in pair.tolist()]
    words = [word(x) for x in names]
    return {"inside": _sum_by_name(words, inside.tolist()), "final": _sum_by_name(words, final.tolist()), "phrase": _sum_by_name(phrases, n.tolist())}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {"inside": Counter(), "final": Counter(), "phrase": Counter()}

    def emitted() -> Iterator[pa.RecordBatch]:
        for kind, counts in held.items():
            counts = {w: n for w, n in counts.items() if n}
            if counts:
                yield pa.RecordBatch.from_pydict({"kind": [kind] * len(counts), "w": list(counts), "n": pa.array(counts.values(), pa.int64())})
            held[kind] = Counter()

    for batch in batches:
        text = batch.column("text").cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(text).to_numpy())
        cut = np.flatnonzero(np.diff(size // AT_ONCE)) + 1
        for a, z in zip(np.append(0, cut), np.append(cut, len(text))):
            for kind, counts in _counts(text.slice(a, z - a)).items():
                held[kind].update(counts)
        if sum(map(len, held.values())) > 300_000:
            yield from emitted()
    yield from emitted()


def _salted(df: DataFrame) -> DataFrame:
    """``df``, of few rows for each source, once for each part that the rows of a source are dealt to."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def truncation_evidence(df: DataFrame, id_: str, text: str, source: str, at_limits: bool = True) -> DataFrame:
    """For every record with a text: (id, source, verdict, at_limit, cut).

    ``verdict`` is that of :func:`ending`, ``at_limit`` the measure and length of the storage limit it sits at or NULL,
    ``cut`` whether it was cut off. NULL texts give no row; blank ones are never cut; a NULL source is a source of its own;
    repeated rows are records each. An empty table gives no row. Other columns aren't read.

    A text whose ending is open is judged by its source: a closing phrase of at least HABIT_LEAST distinct texts, whose
    beginning doesn't begin other units more often than it closes texts, is a habit and ends a text anywhere. Else a text
    at a limit is cut, unless it ends in one of the source's dominant last words. A text elsewhere is cut if it bears
    an ellipsis, if its last word never ends units, or, in a source of punctuated texts, if that word ends less than half
    of those it is in. ``at_limits=False`` judges as if there were no limit.

    Lengths, phrases and words are counted over distinct texts (of each source), so that copies of a cut text don't make
    its ending a habit, and are summed up before they are shuffled. The driver receives nothing.
    """
    kind = df.select(id_).schema[0].dataType.simpleString()
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = df.select(F.col(id_).alias("id"), named.alias("source"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    ends = checkpointed(rows.mapInArrow(_inspected, f"id {kind}, source STRING, digest BINARY, verdict STRING, tail STRING, last STRING, lengths ARRAY<INT>"))
    each = checkpointed(ends.drop("id").distinct())
    words = checkpointed(rows.select("text").distinct().mapInArrow(_word_counts, "kind STRING, w STRING, n BIGINT").groupBy("kind", "w").agg(F.sum("n").alias("n")))

    # The limits of each source, as a map from measure and length; a cut by bytes may fall short of its limit by 3.
    lengths = each.select("source", F.posexplode("lengths").alias("measure", "length")).groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    limits = storage_limits(lengths).where(F.lit(at_limits))
    name = F.element_at(F.array(*[F.lit(m) for m in MEASURES]), F.col("measure") + 1)
    reach = F.when(name.endswith("utf8"), 3).otherwise(0)
    near = limits.withColumn("found", F.explode(F.sequence(F.col("length") - reach, F.col("length"))))
    near = near.groupBy("source", "measure", "found").agg(F.concat_ws(" ", name, F.max("length")).alias("label"))
    near = near.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("measure", "found"), "label"))).alias("limits"))
    records = each.where("verdict = 'record'").groupBy("source", "tail").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max_by("tail", F.struct("n", "tail")).alias("form"))
    facts = each.where("verdict <> 'none'").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("verdict") == "whole").alias("whole"))
    facts = checkpointed(facts.join(records, "source", "left").join(near, "source", "left").withColumn("prose", F.col("whole") >= F.col("docs") * PROSE_SHARE))

    salt = F.pmod(F.xxhash64("id", "digest"), F.lit(SALTS)).cast("int")
    hits = F.filter(F.transform("lengths", lambda x, i: F.element_at("limits", F.struct(i.alias("measure"), x.alias("found")))), lambda x: x.isNotNull())
    judged = ends.withColumn("salt", salt).join(_salted(facts.select("source", "form", "limits")), ["source", "salt"], "left").withColumn("at_limit", F.get(hits, F.lit(0)))
    open_ = F.col("verdict").isin("tail", "line", "marked")
    judged = judged.withColumn("key", F.when(open_, F.xxhash64("source", "verdict", "tail", "last", F.col("at_limit").isNotNull())))
    judged = checkpointed(judged.select("id", "source", "salt", "verdict", "tail", "last", "at_limit", "key", "form"))

    # The endings that are open, once each.
    keys = judged.where("key IS NOT NULL").groupBy("key").agg(*[F.first(c).alias(c) for c in ("source", "verdict", "tail", "last")], F.first(F.col("at_limit").isNotNull()).alias("limited"))
    openings = each.where(open_)
    closers = openings.where("tail <> ''").groupBy("digest", "tail").agg(F.lit(1)).groupBy("tail").agg(F.count(F.lit(1)).alias("closes"))
    pair = F.split("tail", " ", 3)
    closers = closers.withColumn("begins", _phrase(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))
    closers = closers.withColumn("all_closes", F.sum("closes").over(Window.partitionBy("begins"))).where(F.col("closes") >= HABIT_LEAST)
    phrases = words.where("kind = 'phrase'").withColumn("begins", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring("w", F.lit(1), i))))
    begun = phrases.join(closers.select("begins").distinct(), "begins", "left_semi").groupBy("begins").agg(F.sum("n").alias("begun"))
    habits = closers.join(begun, "begins", "left").where(F.coalesce("begun", F.lit(0)) <= F.col("all_closes") * 2).select("tail", F.lit(True).alias("habit"))
    last_words = words.where("kind <> 'phrase'").groupBy(F.col("w").alias("last")).agg(F.sum(F.when(F.col("kind") == "final", F.col("n")).otherwise(0)).alias("final"), F.sum("n").alias("seen"))
    dominant = openings.where("verdict <> 'marked'").groupBy("source", "last").agg(F.count(F.lit(1)).alias("times"))
    keys = keys.join(facts.select("source", "docs", "prose"), "source", "left").join(habits, "tail", "left").join(last_words, "last", "left").join(dominant, ["source", "last"], "left")
    is_dominant = F.coalesce(F.col("times"), F.lit(0)) >= F.greatest(F.lit(2), F.col("docs") * DOMINANT_SHARE)
    ends_units = lambda share: (F.coalesce("final", F.lit(0)) >= 2) & (F.col("final") >= F.col("seen") * share)
    unknown = F.col("seen").isNull()
    ended = (
        F.when(F.col("habit"), True)
        .when(F.col("limited"), is_dominant & (unknown | ends_units(FINAL_SHARE)))
        .when(F.col("verdict") == "marked", False)
        .when(F.col("prose"), ends_units(PROSE_FINAL_SHARE))
        .otherwise(ends_units(FINAL_SHARE) | (is_dominant & unknown))
    )
    verdicts = keys.select("key", F.coalesce(ended, F.lit(False)).alias("ended"))
    out = judged.join(_salted(verdicts), ["key", "salt"], "left")
    cut = F.when(F.col("key").isNotNull(), ~F.col("ended")).when(F.col("verdict") == "record", F.coalesce(F.col("tail") != F.col("form"), F.lit(False))).otherwise(F.col("verdict") == "cut")
    back = F.when(F.col("source") != "", F.expr("substring(source, 2)"))
    return out.select(F.col("id").alias(id_), back.alias(source), "verdict", "at_limit", cut.alias("cut"))
