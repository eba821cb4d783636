"""Label and text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that decompose to an ASCII letter, and that letter; others above ASCII vanish.
FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyy"[: len(FOLD_FROM)]
# Keywords of each class, in order of precedence: walls, doors, windows, stairs.
WALL_WORDS = ("wall", "wand")
DOOR_WORDS = ("door", "doorway", "doorframe", "glassdoor", "tuer", "tur")
WINDOW_WORDS = ("window", "windowframe", "fenster", "fenst")
WINDOW_NAMES = ("win", "wnd")
STAIR_WORDS = ("stair",)
# Keywords of each room category, in order of precedence.
ROOM_WORDS = (
    ("OFFICE", ("office", "büro")),
    ("BEDROOM", ("bedroom", "schlafzimmer")),
    ("KITCHEN", ("kitchen", "küche")),
    ("BATHROOM", ("bathroom", "badezimmer", "wc")),
    ("LIVING_ROOM", ("living", "wohnzimmer")),
)
DEFAULT_DPI = 400


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def normalize_label(label: Column) -> Column:
    """B1: fold to ASCII, lower, drop blanks, hyphens and underscores."""
    ascii_ = F.regexp_replace(F.translate(label, FOLD_FROM, FOLD_TO), "[^\\x00-\\x7f]", "")
    return F.regexp_replace(F.lower(ascii_), "[\\s_-]", "")


def classify(label: Column) -> Column:
    """B2: WALL, DOOR, WINDOW, STAIR or the raw label, trimmed and in lower case."""
    n = normalize_label(label)
    return (
        F.when(has_any(n, WALL_WORDS), "WALL")
        .when(has_any(n, DOOR_WORDS), "DOOR")
        .when(has_any(n, WINDOW_WORDS) | n.isin(*WINDOW_NAMES), "WINDOW")
        .when(has_any(n, STAIR_WORDS), "STAIR")
        .otherwise(F.lower(F.trim(label)))
    )


def is_external(label: Column) -> Column:
    """True, false or unknown (null); only walls have it."""
    n = normalize_label(label)
    return F.when(classify(label) == "WALL", F.when(n.contains("extern"), True).when(n.contains("intern"), False))


def clean_name(name: Column, default: str = "Unnamed") -> Column:
    """Letters, digits, blanks, hyphens and underscores only, single blanks, at most 100 characters."""
    kept = F.regexp_replace(F.coalesce(name, F.lit("")), "(?U)[^a-zA-Z0-9\\s_-]", "")
    kept = F.trim(F.regexp_replace(kept, "(?U)\\s+", " "))
    return F.when(kept == "", default).otherwise(F.substring(kept, 1, 100))


def room_category(name: Column) -> Column:
    """B32."""
    n, out = F.lower(name), None
    for category, words in ROOM_WORDS:
        out = F.when(has_any(n, words), category) if out is None else out.when(has_any(n, words), category)
    return out.otherwise("UNKNOWN")


def scale_from_text(text: Column, dpi: int = DEFAULT_DPI) -> Column:
    """struct(px_per_mm, confidence) from the first 1:n of the text, else (1.0, 0.1)."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), "1:([0-9]{2,4})", 1)
    found = (n != "") & (n.cast("double") > 0)
    return F.struct(
        F.when(found, F.lit(dpi / 25.4) / n.cast("double")).otherwise(1.0).alias("px_per_mm"),
        F.when(found, 0.6).otherwise(0.1).alias("confidence"),
    )


def is_number(value: Column) -> Column:
    """Parses as a number that is not NaN."""
    n = value.try_cast("double")
    return n.isNotNull() & ~F.isnan(n)


def is_guid_like(value: Column) -> Column:
    """At least 22 letters, digits, _ or -."""
    return F.coalesce(value.rlike("^[A-Za-z0-9_-]{22,}$"), F.lit(False))
