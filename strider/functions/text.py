"""Text rules as column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words of an instruction.
TASK = "Task: "
INSTRUCTION = ". Instruction: "
FALLBACK = "A person performing "
FOCUS = " Based on the current body position in these frames, predict the precise movements for the next {} seconds."
#: The format of action descriptions, and the widest line of a summary.
SEGMENTS = "array<struct<frames: array<bigint>, description: string, confidence: double>>"
WIDTH = 70


def caption_body(caption: Column) -> Column:
    """What follows the first line that starts with "description"; else the last line; "" for neither.

    Lines are stripped; empty lines, lone "assistant" lines and further lines that start
    with "description" are left out; the rest is joined by spaces.
    """
    lines = F.transform(F.split(F.trim(F.btrim(caption, F.lit(" \n\t\r"))), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    marks = F.transform(lines, lambda x: F.startswith(F.lower(x), F.lit("description")))
    first = F.array_position(marks, True).cast("int")
    wanted = lambda x: (x != "") & (F.lower(x) != "assistant")
    body = F.filter(F.slice(lines, first + 1, F.size(lines)), lambda x: wanted(x) & ~F.startswith(F.lower(x), F.lit("description")))
    rest = F.filter(lines, lambda x: wanted(x))
    last = F.coalesce(F.try_element_at(rest, F.lit(-1)), F.lit(""))
    return F.when((first > 0) & (F.size(body) > 0), F.array_join(body, " ")).otherwise(last)


def swap_sides(text: Column) -> Column:
    """Left for right and back, whole words in three spellings, at once."""
    pairs = [("left", "right"), ("Left", "Right"), ("LEFT", "RIGHT")]
    out = text
    for k, (a, b) in enumerate(pairs):
        out = F.regexp_replace(F.regexp_replace(out, rf"\b{a}\b", chr(1 + 2 * k)), rf"\b{b}\b", chr(2 + 2 * k))
    for k, (a, b) in enumerate(pairs):
        out = F.replace(F.replace(out, F.lit(chr(1 + 2 * k)), F.lit(b)), F.lit(chr(2 + 2 * k)), F.lit(a))
    return out


def hash_share(key: Column) -> Column:
    """The first eight hex digits of the MD5 over 0xFFFFFFFF: a number from 0 to 1."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def clip_id_parts(clip_id: Column) -> Column:
    """id, start, end split from the right; the whole text and two empty ones if there are not three parts."""
    good = clip_id.rlike("^.*_[^_]*_[^_]*$")
    part = lambda k: F.regexp_extract(clip_id, "^(.*)_([^_]*)_([^_]*)$", k)
    return F.struct(F.when(good, part(1)).otherwise(clip_id).alias("id"), F.when(good, part(2)).otherwise("").alias("start"), F.when(good, part(3)).otherwise("").alias("end"))


def after_last(text: Column, mark: str) -> Column:
    """What follows the last occurrence of a mark, trimmed; the whole text without one."""
    return F.trim(F.substring_index(text, mark, -1))


def unquoted(text: Column) -> Column:
    quoted = (F.length(text) >= 2) & F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))
    return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def frame_rate(text: Column) -> Column:
    """num/den as a number; 30 for a zero or missing denominator."""
    n, d = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.coalesce(n / F.nullif(d, F.lit(0.0)), F.lit(30.0))


def instruction(action_class: Column, body: Column, start: Column, frames: Column, rate: float = 10, horizon: int = 16, flipped: Column | None = None) -> Column:
    """Task and caption (a fallback for a null caption; sides swapped where `flipped`), progress in seconds and percent, and the horizon; half percents go to the even one."""
    base = F.when(body.isNull(), F.concat(F.lit(FALLBACK), action_class)).otherwise(F.concat(F.lit(TASK), action_class, F.lit(INSTRUCTION), body))
    if flipped is not None:
        base = F.when(flipped, swap_sides(base)).otherwise(base)
    percent = F.bround(start / frames.cast("double") * 100, 0).cast("long")
    progress = F.format_string(" Progress: %.1fs/%.1fs (%d%%)", start / F.lit(float(rate)), frames / F.lit(float(rate)), percent)
    return F.concat(base, progress, F.lit(FOCUS.format(f"{horizon / rate:.1f}")))


def segments(df: DataFrame, column: str) -> DataFrame:
    """One row for each action description in JSON, numbered from 1: first and last frame, description, confidence, and whether it keeps the rules (two frames, a confidence from 0 to 1). What is no JSON has none."""
    rows = df.select("*", F.posexplode(F.from_json(column, SEGMENTS)).alias("k", "s")).where("s IS NOT NULL")
    valid = (F.size("s.frames") == 2) & F.col("s.confidence").between(0, 1)
    frame = lambda k: F.try_element_at("s.frames", F.lit(k))
    return rows.select(*df.columns, (F.col("k") + 1).alias("seg"), frame(1).alias("first"), frame(-1).alias("last"), "s.description", "s.confidence", valid.alias("valid")).where("description IS NOT NULL")


def wrapped(text: Column, width: int = WIDTH, indent: str = "    ") -> Column:
    """Words in lines of at most `width` characters behind an indent, filled one after the other; a longer word has a line of its own, and a run of white space counts as one space."""
    words = F.filter(F.split(F.regexp_replace(text, r"\s", " "), " "), lambda w: w != "")
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def put(acc: Column, w: Column) -> Column:
        fits = (acc["used"] > 0) & (acc["used"] + 1 + F.length(w) <= width)
        new = F.concat(acc["text"], F.when(acc["used"] > 0, "\n").otherwise(""), F.lit(indent), w)
        return F.struct(F.when(fits, F.concat(acc["text"], F.lit(" "), w)).otherwise(new).alias("text"), F.when(fits, acc["used"] + 1 + F.length(w)).otherwise(len(indent) + F.length(w)).alias("used"))

    return F.aggregate(words, empty, put, lambda acc: acc["text"])


def segment_text() -> Column:
    """The text of one row of segments() in a summary."""
    frames = F.concat(F.lit("  Frames: "), F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string"), F.lit("\n"))
    confidence = F.format_string("\n  Confidence: %.2f\n", F.col("confidence"))
    return F.concat(F.format_string("Segment %d:\n", F.col("seg")), F.coalesce(frames, F.lit("")), F.lit("\n  Action:\n"), wrapped(unquoted(F.col("description"))), F.lit("\n"), F.coalesce(confidence, F.lit("")))


def probe_meta(json: Column) -> Column:
    """width, height, fps, frames of a probed stream; a zero denominator or missing rate counts as 30, a missing frame count is the duration times the rate."""
    p = F.from_json(json, "width bigint, height bigint, r_frame_rate string, nb_frames string, duration string")
    plain = F.when(~F.contains(p["r_frame_rate"], F.lit("/")), p["r_frame_rate"].try_cast("double"))
    fps = F.coalesce(plain, frame_rate(p["r_frame_rate"]))
    frames = F.coalesce(p["nb_frames"].try_cast("bigint"), (F.coalesce(p["duration"].try_cast("double"), F.lit(0.0)) * fps).cast("bigint"))
    return F.struct(p["width"].alias("width"), p["height"].alias("height"), fps.alias("fps"), frames.alias("frames"))
