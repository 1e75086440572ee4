"""Text operations: captions, titles, refusals, durations, paths, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
OPENING_MEDIUM = r"(?i)^((?:A|The|This|In\s+this)\s+)(?:photograph|image|photo|picture)\b"
FIRST_MEDIUM = r"(?is)^(.*?)\b(?:photograph|image|photo(?!graphy)|picture)\b"
CAPTION_OPENING = r"(?i)^(A|This|The) (photograph|image|picture|photo)\b"
NOISE = ("watermark", "compression artifact", "resolution")
REFUSALS = (
    r"(?i)can'?t\s+creat[a-z]+\s+explicit\s+content",
    r"(?i)cannot\s+creat[a-z]+\s+explicit\s+content",
    r"(?i)can'?t\s+(assist|help|provide|produce|generate|fulfill|write)\b",
    r"(?i)cannot\s+(assist|help|provide|produce|generate|fulfill|write)\b",
    r"(?i)(unable|not able)\s+to\s+(assist|help|provide|produce|generate|create|fulfill|write)\b",
    r"(?i)anything else i can help",
    r"(?i)(against|violat[a-z]+)\s+(my|the)\s+guidelines",
    r"(?i)\bas an ai\b",
    r"(?i)explicit\s+(content|material)\b.*\bnot\b",
)
TITLE_PREFACE = r"(?i)^\s*(?:title|here(?:'s| is)(?: the)?(?: title)?|sure[,.!]?)\s*[:\-–—]\s*"
TITLE_QUOTES = r"""(?s)^\s*["'“‘]\s*(.*?)\s*["'”’]\s*$"""
VIDEO_SUFFIX = r"(?i)\.(mp4|avi|mov|mkv|webm|flv|m4v)$"
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|gif|bmp|webp|tiff|tif)$"


def fix_caption(caption: Column, frame_index: Column) -> Column:
    """A caption that opens with (or else first mentions) a picture speaks of a video frame; the frame's number goes first."""
    text = F.coalesce(caption, F.lit(""))
    opened = F.regexp_replace(text, OPENING_MEDIUM, "$1video frame")
    anywhere = F.regexp_replace(text, FIRST_MEDIUM, "$1video frame")
    return F.concat(F.lit("Frame "), frame_index.cast("string"), F.lit(": "), F.when(text.rlike(OPENING_MEDIUM), opened).otherwise(anywhere))


def clean_caption(caption: Column) -> Column:
    """Without sentences on watermarks, compression artifacts or resolution; white space runs become one space."""
    text = F.regexp_replace(caption, CAPTION_OPENING, "The frame")
    parts = F.split(text, r"\.")  # what follows the last full stop is no sentence and stays
    noisy = lambda s: F.lower(s).contains(NOISE[0]) | F.lower(s).contains(NOISE[1]) | F.lower(s).contains(NOISE[2])
    whole = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda s: ~noisy(s))
    kept = F.array_join(F.concat(whole, F.slice(parts, -1, 1)), ".")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def is_refusal(text: Column, min_length: int | None = None) -> Column:
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    found = bare == ""
    for pattern in REFUSALS:
        found = found | text.rlike(pattern)
    return F.coalesce(found | (F.length(bare) < min_length) if min_length is not None else found, F.lit(True))


def clean_title(raw: Column) -> Column:
    """First line with text, without preface and one pair of quotes."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r\n|[\n\r]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    line = F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), TITLE_PREFACE, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), TITLE_QUOTES, "$1"), r"^\s+|\s+$", "")


def source_type(source: Column, given: Column | None = None) -> Column:
    by_name = F.when(source.rlike(VIDEO_SUFFIX), "video").otherwise("image")
    return F.when(source.startswith("http://") | source.startswith("https://"), "url").otherwise(F.coalesce(F.nullif(given, F.lit("")), by_name) if given is not None else by_name)


def is_url(source: Column) -> Column:
    """Has a scheme and a host."""
    return source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


def is_image(source: Column) -> Column:
    return source.rlike(IMAGE_SUFFIX)


def scene_title(title: Column, source: Column, source_id: Column) -> Column:
    last = F.element_at(F.split(source, "/"), -1)
    name = F.regexp_replace(F.when(last == "", source).otherwise(last), r"\.[^.]+$", "")
    return F.coalesce(F.nullif(title, F.lit("")), F.when(source != "", name), F.when(source_id != "", F.concat(F.lit("Scene "), source_id)), F.lit("Unknown Scene"))


def truncate_path(path: Column, most: int = 40) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(F.length(path) <= most, path).when(F.length(last) >= most - 3, F.concat(F.lit("..."), F.right(last, F.lit(most - 3)))).otherwise(F.concat(F.lit(".../"), last))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def duration_words(seconds: Column) -> Column:
    """``2m 5s``, ``5s``; Unknown if null or 0."""
    m, s = F.floor(seconds / 60), F.floor(F.pmod(seconds, F.lit(60.0)))
    return F.when(seconds.isNull() | (seconds == 0), "Unknown").when(m > 0, F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def duration_short(seconds: Column) -> Column:
    """``12.3s``, ``4m 5s``, ``1h 2m``; - if null. Seconds are rounded half up, as minutes' rest may read 60s."""
    m = F.floor(seconds / 60)
    rest = F.floor(F.pmod(seconds, F.lit(60.0)) + 0.5)
    return F.when(seconds.isNull(), "-").when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s"))).when(m < 60, F.concat(m.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m")))


def duration_clock(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``; a dash if null or 0."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60), F.floor(F.pmod(seconds, F.lit(60.0)))
    return F.when(seconds.isNull() | (seconds == 0), "—").when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(s))).otherwise(F.concat_ws(":", m.cast("string"), _two(s)))


def stamp(seconds: Column) -> Column:
    """``[mm:ss]``"""
    return F.concat(F.lit("["), _two(F.floor(seconds / 60)), F.lit(":"), _two(F.floor(F.pmod(seconds, F.lit(60.0)))), F.lit("]"))


def participants(count: Column, genders: Column) -> Column:
    named = F.when(F.size(genders) > 0, F.array_join(genders, ", ")).otherwise("genders unknown")
    return F.when(count == 0, "No identified participants").otherwise(F.concat(count.cast("string"), F.lit(" participant(s): "), F.coalesce(named, F.lit("genders unknown"))))


def resolution(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise("Unknown")


def tag_text(name: Column, description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(name, F.lit(": "), description)).otherwise(name)


def title_case(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "-", " "))


def percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def megabytes(mb: Column) -> Column:
    return F.when(mb >= 1024, F.concat(F.format_string("%.1f", mb / 1024), F.lit(" GB"))).otherwise(F.concat(F.floor(mb + 0.5).cast("long").cast("string"), F.lit(" MB")))


def canonical_json(pairs: dict[str, Column]) -> Column:
    """JSON of scalars with sorted keys and a space after comma and colon; each Column is already JSON text."""
    parts = [F.concat(F.lit(f'"{k}": '), pairs[k]) for k in sorted(pairs)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def cache_key(path: Column, mtime: Column, module: str, params: Column) -> Column:
    """SHA-256 of path, modification time, module and canonical parameters."""
    return F.sha2(F.concat_ws(":", path, mtime.cast("string"), F.lit(module), params), 256)


def source_index(source: Column) -> Column:
    return F.substring(F.md5(source), 1, 16)


def parse_time(text: Column) -> Column:
    """Epoch seconds of an ISO-8601 text or of a number; null if it is neither."""
    as_time = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.coalesce(text.try_cast("double"), F.unix_micros(as_time) / 1_000_000)
