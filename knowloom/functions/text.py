"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of one chunk.
CHUNK_CHARS = 1000

# Query words that carry no subject.
STOPWORDS = (
    "the", "and", "for", "with", "from", "last", "latest", "conversation", "email", "message", "talk", "about", "tell", "show", "give",
    "what", "which", "who", "whom", "where", "when", "how", "details", "status", "update", "recent",
)

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalise_space(text: Column) -> Column:
    """Runs of white space, Unicode kinds included, as single blanks; none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), _SPACE), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _SPACE), lambda t: t != ""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Slices of ``size`` characters of the normalised text; empty array for no text."""

    def cut(n: Column) -> Column:
        count = F.ceil(F.length(n) / F.lit(size)).cast("int")
        slices = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(n, i * size + 1, F.lit(size)))
        return F.when(F.length(n) > 0, slices).otherwise(F.array().cast("array<string>"))

    return let(normalise_space(text), cut)


def sha256(value: Column) -> Column:
    """Hex digest; null for null."""
    return F.sha2(value, 256)


def query_tokens(query: Column) -> Column:
    """Search words of a query: letters, digits, ``_``, ``@`` and dots, longer than two, repeats kept."""
    raw = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)[\w@\.]+"), F.lit(0))
    bare = F.transform(raw, lambda t: F.regexp_replace(t, r"^[._]+|[._]+$", ""))
    return F.filter(bare, lambda t: F.length(t) > 2)


def strong_tokens(words: Column) -> Column:
    """The words that are not stopwords, repeats kept."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(words, lambda t: ~F.array_contains(stop, t))


def hits(words: Column, haystack: Column) -> Column:
    """How many of the words occur in the text, each repeat counted."""
    return F.size(F.filter(words, lambda t: F.contains(haystack, t)))


def participants(metadata: Column) -> Column:
    """Lower-case sender and recipients of a chunk's metadata, own fields before those of its content."""
    paths = ("$.sender", "$.recipients", "$.content_metadata.sender", "$.content_metadata.recipients")
    return F.lower(F.concat_ws(" ", *(F.get_json_object(metadata, p) for p in paths)))


def message_id_of(metadata: Column) -> Column:
    first = F.get_json_object(metadata, "$.message_id")
    return F.coalesce(F.nullif(first, F.lit("")), F.get_json_object(metadata, "$.content_metadata.message_id"))


def flat_values(metadata: Column) -> Column:
    """Lower-case leaf values of a JSON text, one blank between them; keys are left out."""
    no_keys = F.regexp_replace(metadata, r'"(?:[^"\\]|\\.)*"\s*:', " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(no_keys, r'[\[\]{}",]+|\bnull\b', " ")), r"\s+", " "))


def split_recipients(recipients: Column) -> Column:
    """Entries between commas, trimmed, empty ones dropped; null for null."""
    return F.filter(F.transform(F.split(recipients, ","), lambda r: F.trim(r)), lambda r: r != "")


def last_word(text: Column) -> Column:
    """Last of at least two words, null otherwise (the unit behind a value)."""
    w = F.split(normalise_space(text), " ")
    return F.when(F.size(w) >= 2, F.element_at(w, -1))


def graph_name(text: Column, default: str) -> Column:
    """A label or type that graph stores accept: word characters only, not led by a digit."""
    clean = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9_]", "_")
    bare = F.regexp_replace(clean, "^_+|_+$", "")
    named = F.when(bare == "", default).otherwise(bare)
    return F.when(named.rlike("^[0-9]"), F.concat(F.lit("_"), named)).otherwise(named)


def span_of(text: Column, needle: Column, start: Column, end: Column) -> Column:
    """Span of a mention: the given one if it is in range and holds the needle in any case, else its first place, else null."""
    given = F.substring(text, start + 1, end - start)
    in_range = (start >= 0) & (end > start) & (end <= F.length(text))
    at = F.position(F.lower(needle), F.lower(text)) - 1
    n = F.length(needle)
    return F.when(in_range & F.contains(F.lower(given), F.lower(needle)), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).when(
        (at >= 0) & (n > 0), F.struct(at.cast("int").alias("start"), (at + n).cast("int").alias("end"))
    )


def strip_fences(text: Column) -> Column:
    """Text without the code fence around it, if it begins with one."""
    t = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(t.startswith("```"), F.trim(inner)).otherwise(t)


def shorten(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def filename_of(attachment: Column, metadata: Column) -> Column:
    """Attachment name, else that of the metadata, else the last part of its path."""
    own, named = F.nullif(attachment, F.lit("")), F.nullif(F.get_json_object(metadata, "$.filename"), F.lit(""))
    return F.coalesce(own, named, basename(F.get_json_object(metadata, "$.path")))
