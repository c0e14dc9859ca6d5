"""Column functions on model output: cleaning, extraction, JSON parsing, domain checks, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and the separators 1C to 1F, at both ends.
SPACE_ENDS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"


def strip_space(s: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(s, SPACE_ENDS, "")


def strip_think(s: Column) -> Column:
    """Removes every closed think block in any case, then strips white space."""
    return strip_space(F.regexp_replace(s, r"(?is)<think>.*?</think>", ""))


def get_final(s: Column) -> Column:
    """Takes the text after the first final marker (as it is spelt), then from the brace after the first JSON marker (in any case, white space between); each only if present."""
    cut = lambda x, p: F.when(x.rlike(p), strip_space(F.regexp_extract(x, p, 1))).otherwise(x)
    return cut(cut(s, r"(?s)assistantfinal\s*(.*)"), r"(?is)json\s*(\{.*)")


def parse_field(s: Column, name: str) -> Column:
    """A string field of a JSON object; null if the text is no object or lacks it."""
    return F.get_json_object(s, f"$.{name}")


def in_domain(value: Column, domain: Sequence[str]) -> Column:
    """The value if it is in the domain, else null."""
    return F.when(value.isin(*domain), value)


def structured(s: Column, name: str, domain: Sequence[str]) -> Column:
    """The chain for structured answers: clean, take the final part, parse, check."""
    return in_domain(parse_field(get_final(strip_think(s)), name), domain)


def render_messages(messages: Column) -> Column:
    """'type: content' lines of array<struct<type, content>>."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["type"], F.lit(": "), m["content"])), "\n")


def render_context(docs: Column) -> Column:
    """Blocks of file name and content, parted by blank lines, of array<struct<filename, content>>."""
    return F.array_join(F.transform(docs, lambda d: F.concat(F.lit("Filename: "), d["filename"], F.lit("\nContent: "), d["content"])), "\n\n")


def render_facts(docs: Column) -> Column:
    return F.array_join(F.transform(docs, lambda d: d["content"]), "\n\n")


def source_list(docs: Column) -> Column:
    """Distinct (filename, chunk_id) in their order, a missing part as 'unknown'."""
    named = F.transform(docs, lambda d: F.struct(F.coalesce(d["filename"], F.lit("unknown")).alias("filename"), F.coalesce(d["chunk_id"], F.lit("unknown")).alias("chunk_id")))
    return F.array_distinct(named)


def tail(messages: Column, n: int) -> Column:
    """The last n entries; none for n = 0."""
    return F.slice(messages, F.greatest(F.size(messages) - n + 1, F.lit(1)), n) if n else F.slice(messages, 1, 0)


#: Stop words of the stand-in language detector; fixed values.
STOP_WORDS = {
    "de": ("der", "die", "und", "das", "ein"),
    "en": ("the", "of", "and", "to", "is"),
    "es": ("los", "el", "que", "por", "con"),
    "fr": ("le", "les", "et", "des", "dans"),
}


def detect_language(s: Column, default: str = "en") -> Column:
    """Stand-in for the model: the language with most stop words; ties to the first name, none to the default."""
    words = F.split(F.lower(s), r"[^\p{L}]+")
    count = lambda names: F.size(F.filter(words, lambda w: w.isin(*names)))
    hits = {k: count(v) for k, v in STOP_WORDS.items()}
    best = F.greatest(*hits.values())
    out = F.when(best == 0, F.lit(default))
    for k, n in hits.items():
        out = out.when(n == best, F.lit(k))
    return F.coalesce(out, F.lit(default))
