"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that strip() removes: white space in the wide sense, no-break space included.
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
PAGE_SEPARATOR = "[PAGE_SEP]"
RULE = "-" * 40


def strip(text: Column) -> Column:
    """Text without white space (Unicode's too) at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def words(text: Column) -> Column:
    """The non-empty pieces between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def html_to_text(html: Column) -> Column:
    """Visible text of an HTML page: scripts and styles go whole, tags become spaces, common entities are decoded.

    Scripts go first: they can hold tags inside strings.
    """
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(text, r"\s+", " "))


def with_page_marker(text: Column, page: Column) -> Column:
    return F.concat(strip(text), F.lit("\n[PAGE_"), page.cast("string"), F.lit("]\n"))


def marker_normalise(markdown: Column) -> Column:
    """What follows the first page separator, with ``{n}`` separators as page markers and spaced line breaks."""
    separator = F.lit(PAGE_SEPARATOR)
    rest = F.substr(markdown, F.locate(PAGE_SEPARATOR, markdown) + F.lit(len(PAGE_SEPARATOR)))
    rest = F.regexp_replace(rest, r"\{(\d+)\}\[PAGE_SEP\]", r"[PAGE_$1]")
    rest = F.replace(rest, F.lit("<br>"), F.lit(" <br> "))
    return F.when(F.contains(markdown, separator), strip(rest))


def caption_block(caption: Column) -> Column:
    """An image's caption in the text; a missing caption leaves the block empty."""
    return F.concat(F.lit("\n<image_description>\n"), F.coalesce(caption, F.lit("")), F.lit("\n</image_description>\n"))


def human_size(size: Column) -> Column:
    """Bytes as ``2.40 MB``."""
    value = size.cast("double")
    out = F.concat(F.format_string("%.2f", value / 1024.0**5), F.lit(" PB"))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(value < 1024.0 ** (power + 1), F.concat(F.format_string("%.2f", value / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def extension(name: Column) -> Column:
    """The lower-case part after the last dot, empty without one."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def valid_format(name: Column, accepted: list[str]) -> Column:
    return extension(name).isin(accepted)


def valid_file_id(file_id: Column) -> Column:
    """No slash, not blank, not null."""
    return F.coalesce(~F.contains(file_id, F.lit("/")) & (strip(file_id) != ""), F.lit(False))


def parse_metadata(json_text: Column) -> Column:
    """A JSON object as a string map: empty text is an empty map, bad JSON is null."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(F.coalesce(strip(json_text), F.lit("")) == "", empty).otherwise(F.from_json(json_text, "map<string,string>"))


def encode_path(text: Column) -> Column:
    """Percent-encode, keeping ``:`` and ``/``."""
    out = F.url_encode(text)
    for had, back in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(had), F.lit(back))
    return out


def partition_of_model(model: Column, prefix: str) -> Column:
    """``prefix-name`` -> name; null for other names."""
    found = F.regexp_extract(model, f"^{prefix}-(.+)$", 1)
    return F.when(found != "", found)


#: What parts keyword tokens of lower-case text.
NO_TOKEN = "[^a-z0-9à-ÿ]+"


def tokens(text: Column) -> Column:
    """Lower-case keyword tokens."""
    return F.filter(F.split(F.lower(text), NO_TOKEN), lambda t: t != "")


def source_label(filename: Column, page: Column) -> Column:
    """A file's name, with the page for paged formats (suffixes in lower case)."""
    paged = F.rlike(filename, F.lit(r"\.(pdf|pptx|docx|doc)$"))
    return F.when(paged, F.concat(filename, F.lit(" (page: "), page.cast("string"), F.lit(")"))).otherwise(filename)


def hash_order(*parts: str | Column) -> Column:
    """A seeded random order that other engines can make too: md5 of the parts, joined by bars."""
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]).cast("binary"))


def hash_number(*parts: str | Column) -> Column:
    """The first 32 bits of ``hash_order``'s hash as a long."""
    return F.conv(F.substring(hash_order(*parts), 1, 8), 16, 10).cast("long")
