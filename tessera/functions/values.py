"""Column functions on plain values: times, ids, commands, feedback words, languages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip_space

#: Words that count as feedback, commands of the chat loop, and the first message of a session by language; fixed values.
POSITIVE, NEGATIVE = ("positive", "pos", "good", "yes"), ("negative", "neg", "bad", "no")
COMMANDS = ("/help", "/new", "/logout", "/feedback", "/sessions", "/status")
WELCOME = {
    "italian": "Ciao, per favore presentati e descrivi il tuo ruolo e funzionalità.",
    "english": "Hello, please introduce yourself and describe your role and functionalities.",
}


def naive_utc(at: Column) -> Column:
    """An instant as a timestamp without zone, in UTC."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))


def now_utc() -> Column:
    return naive_utc(F.current_timestamp())


def normalize_uuid(s: Column) -> Column:
    """The id in its canonical form (32 hex digits, lower case, hyphens at 8, 12, 16, 20), or null if it is none.

    Hyphens anywhere, braces around it and the prefixes urn: and uuid: are taken off first.
    """
    digits = F.lower(F.replace(F.regexp_replace(F.replace(F.replace(s, F.lit("urn:")), F.lit("uuid:")), r"^[{}]+|[{}]+$", ""), F.lit("-")))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike(r"^[0-9a-f]{32}\z"), F.concat_ws("-", *parts))


def seconds_between(start: Column, end: Column) -> Column:
    """Wall-clock seconds from start to end, rounded to 2 digits."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 2)


def feedback_value(word: Column) -> Column:
    """1 for a positive word, 0 for a negative one, null for any other; white space around it and case don't matter."""
    w = F.lower(strip_space(word))
    return F.when(w.isin(*POSITIVE), 1).when(w.isin(*NEGATIVE), 0)


def parse_command(line: Column) -> Column:
    """(kind, words): kind is a command, 'message' for other text (an unknown /word, too) or 'empty'; words: at most three, the last one the rest."""
    text = strip_space(line)
    lowered = F.lower(text)
    words = F.split(F.lower(text), r"\s+", 3)
    head = F.get(words, F.lit(0))
    kind = F.when(F.coalesce(lowered, F.lit("")) == "", "empty").when(head.isin(*COMMANDS), head).otherwise("message")
    return F.struct(kind.alias("kind"), words.alias("words"))


def pick_ordinal(choice: Column, items: Column) -> Column:
    """The item at a 1-based ordinal given as text of digits; null for other text or beyond the list."""
    digits = F.when(choice.rlike(r"^[0-9]{1,9}\z"), choice.cast("int"))
    return F.when(digits > 0, F.get(items, digits - 1))


def language_or(language: Column, default: str) -> Column:
    """language, or the default where it is null or empty."""
    return F.coalesce(F.nullif(language, F.lit("")), F.lit(default))


def welcome(language: Column, texts: Mapping[str, str] = WELCOME, default: str = "english") -> Column:
    """The first message of a session in a language, or in the default one."""
    found = F.lit(texts[default])
    out = None
    for name, text in texts.items():
        out = F.when(language == name, F.lit(text)) if out is None else out.when(language == name, F.lit(text))
    return out.otherwise(found) if out is not None else found


def is_one_of(value: Column, domain: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*domain), F.lit(False))
