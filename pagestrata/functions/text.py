"""Text functions as Column expressions; the regular expressions run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points drawn at double width, without width, and in scripts without spaces.
FULL_WIDTH = r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{4DBF}\x{4E00}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{20000}-\x{2FA1F}"
ZERO_WIDTH = r"\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{20D0}-\x{20FF}"
UNSPACED = FULL_WIDTH + r"\x{0E00}-\x{0EFF}\x{1780}-\x{17FF}\x{1000}-\x{109F}"
# Pixel widths of character classes in result titles (20 px) and descriptions (14 px).
WIDTHS = {
    "title": {"[MWmw]": 17, "[A-LN-VX-Z]": 13, "[a-eghknop-su-vx-z]": 11, r"[iltfj1!.,:;|'\"]": 6, "[02-9]": 11, " ": 5, "other": 11},
    "description": {"[MWmw]": 12, "[A-LN-VX-Z]": 9, "[a-eghknop-su-vx-z]": 8, r"[iltfj1!.,:;|'\"]": 4, "[02-9]": 8, " ": 4, "other": 8},
}
LOWER = {"title": 11, "description": 8}
# Wording of error pages that answer 200.
SOFT_404_PHRASES = ["page not found", "page doesn't exist", "no longer available", "we can't find", "does not exist"]
SOFT_404_WORDS = 100


def collapsed(text: Column) -> Column:
    """Runs of white space (Unicode) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(body: Column) -> Column:
    return F.sha2(collapsed(body), 256)


def rendered_length(text: Column) -> Column:
    """Characters a reader sees: zero-width code points do not count."""
    return F.char_length(F.regexp_replace(text, f"[{ZERO_WIDTH}]", ""))


def pixel_width(text: Column, profile: str) -> Column:
    """Estimated width in a search result: characters by class, full-width ones at twice the width of a small letter."""
    widths = WIDTHS[profile]
    total = F.regexp_count(text, F.lit(f"[{FULL_WIDTH}]")) * (2 * LOWER[profile])
    for characters, width in widths.items():
        if characters != "other":
            total = total + F.regexp_count(text, F.lit(characters)) * width
    listed = f"[{FULL_WIDTH}{ZERO_WIDTH}A-Za-z0-9!.,:;|'\" ]"
    return (total + F.char_length(F.regexp_replace(text, listed, "")) * widths["other"]).cast("int")


def is_full_width_text(text: Column) -> Column:
    """Half or more of the visible characters are of full width."""
    visible = F.char_length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.coalesce((visible > 0) & (F.regexp_count(text, F.lit(f"[{FULL_WIDTH}]")) * 2 >= visible), F.lit(False))


def word_count(text: Column) -> Column:
    """Characters of scripts without spaces, plus white-space separated tokens that hold none of them."""
    return (F.regexp_count(text, F.lit(f"[{UNSPACED}]")) + F.regexp_count(text, F.lit(rf"(?U)(?<!\S)[^\s{UNSPACED}]+(?!\S)"))).cast("int")


def is_soft_404(body: Column, title: Column) -> Column:
    """Thin and worded like an error, in title or body."""
    said = F.lit(False)
    for phrase in SOFT_404_PHRASES:
        said = said | F.coalesce(F.lower(title).contains(phrase), F.lit(False)) | F.coalesce(F.lower(body).contains(phrase), F.lit(False))
    return said & (F.coalesce(word_count(body), F.lit(0)) < SOFT_404_WORDS)


def reading_ease(text: Column) -> Column:
    """Flesch reading ease, 0..100; null without words, with under ten letters or half of them non-Latin, or over forty words a sentence."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    count = F.size(words)

    def syllables(word: Column) -> Column:
        letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
        runs = F.regexp_count(letters, F.lit("[aeiouy]+")) - F.when(letters.endswith("e"), 1).otherwise(0)
        return F.when(letters == "", 0).when(F.length(letters) <= 3, 1).otherwise(F.greatest(runs, F.lit(1)))

    spoken = F.aggregate(words, F.lit(0), lambda s, w: s + syllables(w))
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    letters = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}"))
    latin = F.regexp_count(text, F.lit(r"[A-Za-z]|[\x{00C0}-\x{024F}&&[\p{IsAlphabetic}]]"))
    ease = F.lit(206.835) - F.lit(1.015) * (count / sentences) - F.lit(84.6) * (spoken / count)
    held = F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease))
    return F.when((count > 0) & (letters >= 10) & (latin * 2 >= letters) & (F.floor(count / sentences) <= 40), held)


def hop_path(hops: Column) -> Column:
    """A walk as a -> b -> c within the same budget of bytes, and how many hops were left out."""
    return detail_sample(hops, most_items=1 << 30, separator=" -> ", more=" -> (+")


def detail_sample(items: Column, of: Column | None = None, most_items: int = 10, most_bytes: int = 300, separator: str = ", ", more: str = " (+") -> Column:
    """The first items joined within a budget of bytes, and how many of all (`of`, else the list's size) were left out."""
    of = F.size(items) if of is None else of

    def add(state: Column, item: Column) -> Column:
        cut = F.when(F.octet_length(item) > most_bytes, F.concat(F.substring(item, 1, most_bytes), F.lit("…"))).otherwise(item)
        first = state["shown"] == 0
        room = first | (F.octet_length(state["text"]) + F.octet_length(item) + len(separator) <= most_bytes)
        taken = F.struct(F.concat(state["text"], F.when(first, "").otherwise(separator), cut).alias("text"), (state["shown"] + 1).alias("shown"), F.lit(True).alias("open"))
        closed = F.struct(state["text"].alias("text"), state["shown"].alias("shown"), F.lit(False).alias("open"))
        return F.when(state["open"] & room, taken).otherwise(closed)

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("shown"), F.lit(True).alias("open"))
    finish = lambda s: F.concat(s["text"], F.when(of > s["shown"], F.concat(F.lit(more), (of - s["shown"]).cast("string"), F.lit(" more)"))).otherwise(""))
    return F.aggregate(F.slice(items, 1, most_items), start, add, finish)


# Area codes of UN M.49 that may target a language version.
AREAS = "001 002 005 009 011 013 014 015 017 018 019 021 029 030 034 035 039 053 054 057 061 142 143 145 150 151 154 155 202 419".split()


def iso_codes(spark) -> tuple[list[str], list[str]]:
    """ISO 639-1 languages and ISO 3166-1 countries, as the Java runtime lists them."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return sorted({str(x).lower() for x in locale.getISOLanguages()}), sorted({str(x).upper() for x in locale.getISOCountries()})


def is_language_tag(code: Column, languages: list[str], countries: list[str]) -> Column:
    """x-default, or language[-Script][-REGION] with known codes and nothing more."""
    shape = r"(?i)^([a-z]{2,3})(?:-[a-z]{4})?(?:-([a-z]{2}|\d{3}))?$"
    language, region = F.lower(F.regexp_extract(code, shape, 1)), F.upper(F.regexp_extract(code, shape, 2))
    known = (F.length(language) == 3) | F.array_contains(F.lit(languages), language)
    placed = (region == "") | F.array_contains(F.lit(countries + AREAS), region)
    return F.coalesce((F.lower(code) == "x-default") | (code.rlike(shape) & known & placed), F.lit(False))
