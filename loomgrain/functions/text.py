"""Scalar text functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}]"  # white space of any script

# Prefixes that a language model puts before a search query.
QUERY_PREFIXES = (
    r"^search\s+for\s*:\s*['\"]?", r"^search\s*:\s*['\"]?", r"^find\s+images?\s+of\s+",
    r"^images?\s+of\s+", r"^bing\s+search\s*:\s*", r"^query\s*:\s*",
)

# Code point ranges and the market they stand for, in order of precedence.
MARKETS = (
    (r"[\x{3040}-\x{30FF}]", "ja-JP"), (r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]", "ko-KR"), (r"[\x{0400}-\x{04FF}]", "ru-RU"),
    (r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]", "ar-SA"), (r"[\x{0900}-\x{097F}]", "hi-IN"), (r"[\x{0E00}-\x{0E7F}]", "th-TH"),
    (r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", "zh-CN"),
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def clean_query(c: Column) -> Column:
    """Without the first matching prefix and quotes; six words if over 80 characters; never empty unless the input is."""
    s = strip(c)
    q = s
    for p in reversed(QUERY_PREFIXES):
        cut = strip(F.regexp_replace(s, f"(?i){p}", ""))
        q = F.when(cut != s, cut).otherwise(q)
    q = strip(F.regexp_replace(q, r"^['\"]+|['\"]+\z", ""))
    short = F.array_join(F.slice(F.split(q, rf"{WS}+"), 1, 6), " ")
    return F.coalesce(F.nullif(F.when(F.length(q) > 80, short).otherwise(q), F.lit("")), s)


def market(c: Column) -> Column:
    """Market code by the first script found; en-US for null and blank."""
    out = F.lit("en-US")
    for pattern, code in reversed(MARKETS):
        out = F.when(c.rlike(pattern), code).otherwise(out)
    return out


def folder_name(c: Column) -> Column:
    """A subtopic as a folder name; ``default`` if nothing is left."""
    return F.coalesce(F.nullif(F.translate(c, "/\\:", "___"), F.lit("")), F.lit("default"))


def caption_text(c: Column) -> Column:
    """One line; empty for null."""
    return F.coalesce(squeeze(c), F.lit(""))


def to_sentence(c: Column, limit: int) -> Column:
    """The longest prefix of whole sentences, or of one up to its closing mark, within ``limit`` characters."""
    whole = F.left(F.regexp_replace(F.left(c, F.lit(limit + 1)), r"[^.!?]*\z", ""), F.lit(limit))
    return strip(F.when(F.length(c) <= limit, c).otherwise(whole))


def template_caption(topic: Column, subtopic: Column) -> Column:
    """X10. The wording is a fixed value."""
    word = lambda c: F.translate(F.coalesce(c, F.lit("")), "_", " ")
    core = strip(F.concat(word(topic), F.lit(" "), word(subtopic)))
    core = F.coalesce(F.nullif(core, F.lit("")), F.lit("text-centric poster"))
    return F.concat(F.lit("A concise description of a "), core, F.lit(" focusing on layout and typography."))


def script_counts(c: Column) -> Column:
    """Latin letters, Han characters and digits."""
    n = lambda p: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(p)).cast("bigint")
    return F.struct(n("[A-Za-z]").alias("latin"), n(r"[\x{4E00}-\x{9FFF}]").alias("han"), n("[0-9]").alias("digits"))


def layout_caption(topic: Column, subtopic: Column, texts: Column, quality: dict[str, Column]) -> Column:
    """X11: sentences about language, layout and style; a null metric adds no sentence."""
    t, s = F.coalesce(topic, F.lit("")), F.coalesce(subtopic, F.lit(""))
    n = script_counts(F.array_join(F.filter(texts, lambda x: x.isNotNull()), " "))
    whole = lambda c: F.coalesce(quality[c], F.lit(0)).cast("bigint").cast("string")
    low_t, low_s = F.lower(t), F.lower(s)
    # The sentences, their limits and key words.
    return F.concat_ws(
        " ",
        F.concat(F.lit("Text-dominant "), F.translate(t, "_", " "), F.lit(" / "), F.translate(s, "_", " "), F.lit(".")),
        F.when(n["han"] > n["latin"], "Primary language: Chinese; secondary English.").when(n["latin"] > n["han"], "Primary language: English; secondary Chinese.").otherwise("Bilingual layout."),
        F.concat(whole("line_count"), F.lit(" lines, avg glyph height ~"), whole("char_h_mean"), F.lit("px, density ~"), whole("text_density"), F.lit(" words/MP.")),
        F.when(quality["contrast"] >= 0.16, "High contrast between text and background."),
        F.when(quality["centrality"] >= 0.6, "Text blocks centered within the canvas."),
        F.when(quality["line_angle_std"] <= 4.5, "Lines are horizontally aligned."),
        F.when(quality["char_h_cv"] <= 0.45, "Consistent glyph sizes across lines."),
        F.when(low_t.contains("sign") | low_s.contains("sign"), "Legible signage style with bold typography."),
        F.when(low_t.contains("menu") | s.contains("菜单"), "Multi-column menu layout with clear sections."),
        F.when(low_s.contains("blackboard") | low_t.contains("poster"), "Dense text blocks suitable for chalkboard/poster rendering."),
    )


def joined_texts(texts: Column, limit: int = 4000) -> Column:
    """Non-blank lines, each on one line, joined by spaces."""
    lines = F.filter(F.transform(texts, squeeze), lambda x: x != "")
    return F.left(F.array_join(lines, " "), F.lit(limit))


def prompt_match(prompt: Column, text: Column) -> Column:
    """1 - Levenshtein distance / longer length, without case; the text counts with 2000 characters. Both empty: 1."""
    a, b = F.lower(F.coalesce(prompt, F.lit(""))), F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(2000)))
    return F.lit(1.0) - F.coalesce(F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0))


def quality_prompt(subtopic: Column) -> Column:
    """X15. The wording is a fixed value."""
    return F.concat(
        F.lit("A high-resolution, text-dominant image of '"), subtopic,
        F.lit("', with clean grid layout, strong contrast, large readable glyphs, and consistent line orientation. No watermark or brand logos."),
    )


def similarity_prompts(topic: Column, subtopic: Column) -> Column:
    """Three prompts of the topic, three of the subtopic, two of both. The wordings are fixed values."""
    one = lambda c: [F.concat(F.lit(p), c) for p in ("An image about ", "A photo related to ", "A picture showing ")]
    return F.array(*one(topic), *one(subtopic), F.concat(F.lit("A picture of "), subtopic, F.lit(" in "), topic), F.concat(F.lit("A "), topic, F.lit(" image about "), subtopic))


def without_fence(c: Column) -> Column:
    """The text inside a Markdown code fence, or the text itself."""
    s = strip(c)
    return F.when(s.startswith("```"), strip(F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z0-9]*\s*", ""), r"\s*```\z", ""))).otherwise(s)


def without_trailing_commas(c: Column) -> Column:
    """X24."""
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


def json_object(c: Column) -> Column:
    """A JSON object as text: the whole, or the slice from the first to the last brace; null if neither parses."""
    s = without_fence(c)
    part = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.when(F.json_object_keys(x).isNotNull(), x)
    return F.coalesce(ok(s), ok(F.nullif(part, F.lit(""))))


def advantage_text(rate: Column, before: Column, ocr: Column, clip: Column, text: Column) -> Column:
    """The text that stands in for a critic's advice. The wording is a fixed value."""
    trend = F.when(
        rate.isNotNull() & before.isNotNull(),
        F.concat(F.lit("Pass rate "), F.when(rate >= before, "up ").otherwise("down "), F.format_string("%.3f", F.abs(rate - before)), F.lit("; ")),
    ).otherwise("")
    show = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(trend, F.lit("OCR avg="), show(ocr), F.lit("; CLIP="), show(clip), F.lit("; Text consistency="), show(text), F.lit(". Suggestion: raise clarity thresholds, emphasise high resolution, topic keywords, and readable text."))
