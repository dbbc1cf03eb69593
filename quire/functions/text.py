"""String, JSON, date and state expressions: STR1-STR8, DT1, DT2, ML1, P6, P7, P16, H1, B1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block types, and the role that each gets.
TYPES = ["text", "formula", "figure", "table", "problem_number", "page_number"]
ROLES = {"text": "paragraph", "figure": "figure", "formula": "equation", "table": "table", "problem_number": "label", "page_number": "page_number"}
# Kinds of user state; the rule's limits.
KINDS = ["marks", "favorites", "bookmarks", "recent", "answerSplits", "lastPage"]
WIDE_NUMBER, SURE = 0.08, 0.6


#: What a classifier is asked.
PROMPT = f"What is on this cut-out of a textbook page? Answer with JSON alone: {{\"type\": one of {', '.join(TYPES)}, \"confidence\": a number from 0 to 1}}."


def parse_reply(raw: Column) -> Column:
    """STR1: struct(type, confidence, needs_review) of a classifier's reply.

    The widest {...} is read as JSON; a missing or unknown type or a confidence that is no number resets
    all three to (text, 0, true). A boolean confidence counts as 1 or 0.
    """
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    kind = F.get_json_object(body, "$.type")
    text = F.trim(F.get_json_object(body, "$.confidence"))
    number = F.when(F.lower(text) == "true", F.lit(1.0)).when(F.lower(text) == "false", F.lit(0.0)).otherwise(text.try_cast("double"))
    fine = F.coalesce(kind.isin(TYPES) & number.isNotNull(), F.lit(False))
    return F.struct(
        F.when(fine, kind).otherwise(F.lit("text")).alias("type"),
        F.when(fine, number).otherwise(F.lit(0.0)).alias("confidence"),
        (~fine | (number < SURE)).alias("needs_review"),
    )


def override_type(kind: Column, width: Column, number_coloured: Column, wide=WIDE_NUMBER) -> Column:
    """A wide problem number is text; else what is coloured like a number is one. Judged on the type as it came."""
    return F.when((kind == "problem_number") & (width > wide), "text").when((kind != "problem_number") & number_coloured, "problem_number").otherwise(kind)


def role_of(kind: Column) -> Column:
    """P6."""
    pairs = [F.lit(v) for kv in ROLES.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("paragraph"))


def trailing_number(text: Column) -> Column:
    """STR2: the digits at the end as a number, null without any."""
    return F.regexp_extract(text, r"(\d+)$", 1).try_cast("long")


# Limits of a span of pages.
SPAN_LOW, SPAN_HIGH, SPAN_MOST = 10, 295, 15


def page_span(text: Column, low: int = SPAN_LOW, high: int = SPAN_HIGH, most: int = SPAN_MOST) -> Column:
    """STR3: struct(a, b) of the first "a ~ b" or "a - b", null unless low <= a <= high, a <= b and b - a <= most."""
    pattern = r"(\d{1,3})\s*[~-]\s*(\d{1,3})"
    a, b = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
    return F.when((a <= b) & (b - a <= most) & a.between(low, high), F.struct(a.alias("a"), b.alias("b")))


def inclusive_range(text: Column) -> Column:
    """STR4, G1: all whole numbers of "a-b"."""
    ends = F.split(text, "-")
    return F.sequence(F.get(ends, 0).cast("int"), F.get(ends, 1).cast("int"))


def block_id(page: Column, number: Column, mark: str = "b") -> Column:
    """STR5."""
    return F.format_string(f"p%d_{mark}%02d", page, number)


def page_file(page: Column, ending: str = "webp") -> Column:
    """STR5."""
    return F.format_string(f"%04d.{ending}", page)


def image_url(book: Column, page: Column, kind: str = "page") -> Column:
    """STR8."""
    return F.concat(F.lit("/book/"), book, F.lit(f"/{kind}/"), page.cast("string"))


def short_title(title: Column) -> Column:
    """STR6: what stands before the first full stop."""
    return F.substring_index(title, ".", 1)


def mark_key(page: Column, number: Column) -> Column:
    """STR7."""
    return F.concat_ws(":", page.cast("string"), number.cast("string"))


def duration_text(seconds: Column) -> Column:
    """DT2: minutes and seconds in Korean, minutes only where there are any."""
    whole = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    return F.when(minutes > 0, F.format_string("%d분 %d초", minutes, F.pmod(whole, F.lit(60)))).otherwise(F.format_string("%d초", whole))


def iso_utc(ts: Column) -> Column:
    """DT1: ISO 8601 with Z; the session's zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def next_mark(mark: Column) -> Column:
    """ML1: none, done, important, none."""
    return F.when(mark.isNull(), "done").when(mark == "done", "important")


def safe_book_id(book: Column) -> Column:
    """P16."""
    return F.coalesce(book.rlike(r"^[A-Za-z0-9_-]+\z"), F.lit(False))


def content_hash(data: Column) -> Column:
    """H1."""
    return F.sha2(data.cast("binary"), 256)
