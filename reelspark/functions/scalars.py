"""Scalar expressions of reports and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PROGRESS


def format_timestamp(seconds: Column) -> Column:
    """MM:SS, rounded down; minutes go on beyond 59."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def format_size(size: Column) -> Column:
    kb, mb = 1024.0, 1024.0 * 1024.0
    return F.when(size < mb, F.format_string("%.1f KB", size / kb)).otherwise(F.format_string("%.1f MB", size / mb))


def suffix(path: Column) -> Column:
    """The lower-case extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def keyframe_name(index: Column, extension: str = "jpg") -> Column:
    """At least three digits; an index from 1000 on has as many as it needs."""
    return F.format_string(f"keyframe_%03d.{extension}", index.cast("bigint"))


def safe_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_int_bytes(value: Column, default: int = 0, most: int | None = None) -> Column:
    """Bytes as a little-endian unsigned integer, of the first ``most`` if given; the default below four bytes.

    What a long can't hold, more than eight bytes or 2^63 and above, is the default too.
    """
    used = value if most is None else F.substring(value, 1, most)
    backwards = F.reverse(F.transform(F.sequence(F.lit(1), F.length(used)), lambda i: F.hex(F.substring(used, i, F.lit(1)))))
    number = F.conv(F.array_join(backwards, ""), 16, 10).try_cast("bigint")
    return F.coalesce(F.when((F.length(value) >= 4) & (F.length(used) <= 8), number), F.lit(default).cast("bigint"))


def fourcc(code: Column) -> Column:
    """Four characters packed little-endian in an integer."""
    return F.concat(*[F.chr(F.shiftright(code, 8 * i).bitwiseAND(F.lit(255))) for i in range(4)])


def pick(key: Column, table: dict[str, float], default: float = 0.0) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def progress(status: Column) -> Column:
    return pick(status, {k: float(v) for k, v in PROGRESS.items()})


def compression_ratio(duration: Column, n: Column) -> Column:
    """Seconds of video for each two seconds of summary; 1 for an empty summary."""
    return F.when(n > 0, duration / (n * 2.0)).otherwise(F.lit(1.0))


def percent_compression(n: Column, frames: Column) -> Column:
    return F.when(frames > 0, (1 - n / frames) * 100).otherwise(F.lit(0.0))


def redundancy_removed(n: Column, filtered: Column) -> Column:
    return F.when(filtered > 0, 1 - n / filtered).otherwise(F.lit(0.0))


def pacing_by_density(n: Column, duration: Column) -> Column:
    density = F.when(duration > 0, n / duration).otherwise(F.lit(0.0))
    return F.when(density > 0.4, "Fast").when(density < 0.1, "Slow").otherwise("Moderate")


def summary_confidence(stable: Column, ratio: Column) -> Column:
    return F.when(stable & (ratio > 0.9), "HIGH").when(ratio > 0.7, "MEDIUM").otherwise("LOW")


# The parts of the sentence on a summary, and the labels of a captioned frame's environment and attributes.
REASON_KINDS, REASON_PARTS = ("High motion", "Stable", "Balanced"), (" content summarized into ", " key moments (~", " keyframes/sec).")
CAPTIONED = ("Captured Reality", "Generative Precision")


def reason(n: Column, duration: Column) -> Column:
    """One sentence on how dense the summary is; the density is shown with two decimals at most."""
    density = F.when(duration > 0, n / duration).otherwise(F.lit(0.0))
    fast, slow, other = REASON_KINDS
    middle, about, end = map(F.lit, REASON_PARTS)
    kind = F.when(density > 0.4, fast).when(density < 0.1, slow).otherwise(other)
    return F.concat(kind, middle, n.cast("string"), about, F.round(density, 2).cast("string"), end)


# The phrase of a factor above 0.7.
CONTEXT_PHRASES = {
    "representativeness": "Main representative moment.", "dominance": "Dominant visual state.", "visual_richness": "Visually detailed highlight.",
    "temporal_coverage": "Critical temporal anchor.", "visual_novelty": "Introduces significant visual novelty.", "motion_context": "Peak action highlight.",
}


def context_phrase(factor: Column, value: Column) -> Column:
    """A sentence for a strong factor, a general one otherwise."""
    phrases = F.create_map(*[F.lit(x) for kv in CONTEXT_PHRASES.items() for x in kv])
    return F.coalesce(F.when(value > 0.7, F.try_element_at(phrases, factor)), F.lit("Significant highlight."))


def status_label(status: Column) -> Column:
    """What a list of jobs shows for a state."""
    return F.when(status == "completed", "Completed").when(status == "failed", "Failed").when(status.isin("pending", "uploaded"), "Queued").otherwise("Processing")


# The colours of a confidence in a gallery.
CONFIDENCE_COLOURS = {"HIGH": "#22c55e", "MEDIUM": "#eab308", "LOW": "#ef4444"}


def confidence_colour(confidence: Column) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE_COLOURS.items() for x in kv]), confidence)
    return F.coalesce(found, F.lit("#6366f1"))


# The record that stands for a missing analysis of a frame, and the label for a missing classification.
NO_ANALYSIS = {"caption": "Visual observation of the scene.", "objects": "Visual object", "actions": "Activity", "environment": "Scene", "attributes": "Standard"}
NO_LABEL = ("Visual Scene", 0.5)


def deep_analysis(caption: Column) -> Column:
    """The record of a caption: tags of its words and constants; the fallback record where there is no caption."""
    entry = lambda label, score: F.struct(label.alias("label"), F.lit(score).alias("score"))
    sure = F.struct(
        capitalize(caption).alias("caption"), F.transform(caption_tags(caption), lambda w: entry(w, 0.9)).alias("objects"), F.array(entry(capitalize(caption), 1.0)).alias("actions"),
        *(F.array(entry(F.lit(v), 1.0)).alias(k) for k, v in zip(("environment", "attributes"), CAPTIONED, strict=True)),
    )
    none = F.struct(F.lit(NO_ANALYSIS["caption"]).alias("caption"), *[F.array(entry(F.lit(v), 0.8)).alias(k) for k, v in NO_ANALYSIS.items() if k != "caption"])
    return F.when(caption.isNull(), none).otherwise(sure)


def caption_tags(caption: Column) -> Column:
    """The first four words of more than three characters, capitalised."""
    words = F.filter(F.split(F.lower(F.trim(caption)), r"[ \t\n\r]+"), lambda w: F.length(w) > 3)
    return F.transform(F.slice(words, 1, 4), capitalize)


def capitalize(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def grid(index: Column, columns: int, thumb_width: Column, thumb_height: Column, padding: int = 10) -> tuple[Column, Column]:
    """Left and top of the 1-based cell of a storyboard."""
    x = F.lit(padding) + ((index - 1) % columns) * (thumb_width + padding)
    y = F.lit(padding) + F.floor((index - 1) / columns) * (thumb_height + padding)
    return x.cast("bigint"), y.cast("bigint")


def timeline_segments(duration: Column, parts: int = 3) -> Column:
    """The equal parts of a duration as structs (start, end), each without its end."""
    length = duration / parts
    return F.array(*[F.struct((i * length).alias("start"), ((i + 1) * length).alias("end")) for i in range(parts)])


def segment_index(ts: Column, duration: Column, parts: int = 3) -> Column:
    """Which of equal parts of the duration; the last is closed above, a zero duration has one."""
    return F.coalesce(F.least(F.lit(parts - 1), F.floor(F.try_divide(ts, duration / parts)).cast("int")), F.lit(0))


def first_match(*rules: tuple[Column, str]) -> Column:
    """CASE over (condition, label); null where none holds."""
    (c, v), *more = rules
    return reduce(lambda acc, r: acc.when(r[0], r[1]), more, F.when(c, v))
