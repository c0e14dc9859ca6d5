"""From raw pages to chunks: HTML to text, normalisation, header sections, overlapping chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, OVERLAP = 1000, 200
#: Entities that are decoded, and their characters; fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_to_text(html: Column) -> Column:
    """Drops scripts, styles, comments and tags, decodes entities and closes up white space."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " "))


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def compose(text: Column) -> Column:
    """Unicode normalisation form C; plain ASCII doesn't go through Python's function."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _composed(text)).otherwise(text)


def normalize(text: Column) -> Column:
    """Joins words hyphenated over a line end, closes up spaces and blank lines."""
    s = F.regexp_replace(text, r"(\p{L})-\n(\p{L})", "$1$2")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    return F.regexp_replace(s, r"\n{3,}", "\n\n")


def split_headers(docs: DataFrame) -> DataFrame:
    """(doc_id, part, header, body): sections that start at headers of up to four levels; part 0 stands before the first."""
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=#{1,4} )")
    sections = docs.select("doc_id", F.posexplode(parts).alias("part", "section"))
    header = F.regexp_extract("section", r"^(#{1,4} [^\n]*)", 1)
    return sections.select("doc_id", "part", header.alias("header"), F.when(header != "", F.expr("substring(section, length(regexp_extract(section, '^(#{1,4} [^\\n]*)', 1)) + 2)")).otherwise(F.expr("substring(section, 2)")).alias("body"))


def with_header_path(sections: DataFrame) -> DataFrame:
    """split_headers() with path: the headers that a section stands under, from the first level down, joined by ' > '.

    A header ends all earlier ones of its level and below.
    """
    level = F.length(F.regexp_extract("header", r"^(#{1,4}) ", 1))
    w = Window.partitionBy("doc_id").orderBy("part")
    out, path = sections.withColumn("_level", level), []
    for k in range(1, 5):
        # the last header of level k, unless one of a higher level came after it
        out = out.withColumn(f"_at{k}", F.max(F.when(F.col("_level") == k, F.col("part"))).over(w)).withColumn(f"_h{k}", F.last(F.when(F.col("_level") == k, F.col("header")), ignorenulls=True).over(w))
        over = F.greatest(*[F.coalesce(f"_at{j}", F.lit(-1)) for j in range(1, k)], F.lit(-1)) if k > 1 else F.lit(-1)
        path.append(F.when(F.col(f"_at{k}") > over, F.regexp_replace(f"_h{k}", r"^#{1,4} ", "")))
    return out.withColumn("path", F.array_join(F.array(*path), " > ")).select(*sections.columns, "path")


#: Separators of the recursive split, coarse ones first; where none is left, characters are cut.
SEPARATORS = ("\n\n", "\n", " ")


def split_recursive(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that makes parts small enough; neighbours share up to overlap characters."""

    def small(part: str, seps: Sequence[str]) -> list[str]:
        if len(part) <= size:
            return [part] if part else []
        if not seps:
            return [part[i : i + size] for i in range(0, len(part), size)]
        first, *rest = part.split(seps[0])
        return [x for piece in [first, *(seps[0] + p for p in rest)] for x in small(piece, seps[1:])]

    chunks: list[str] = []
    held: list[str] = []
    for part in small(text, separators):
        if held and sum(map(len, held)) + len(part) > size:
            chunks.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    if held:
        chunks.append("".join(held))
    return [c for c in chunks if c.strip()]


def chunk_recursive(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, content) of docs (doc_id, text), cut at separators; a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, c) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, c in enumerate(split_recursive(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "content"])

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk int, content string")


def chunk_tokenizer(docs: DataFrame, encode: Callable[[], Callable[[str], list[tuple[int, int]]]], size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, n_tokens, content): windows of size tokens of a tokenizer, each overlapping the one before.

    encode makes, on each worker, a function from a text to its tokens' places as (start, end) in characters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = encode()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                spans = places(text)
                for i, at in enumerate(range(0, len(spans), size - overlap)):
                    part = spans[at : at + size]
                    rows.append((doc, i, len(part), text[part[0][0] : part[-1][1]]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "n_tokens", "content"])

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk int, n_tokens int, content string")


def chunk_characters(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, content): windows of size characters, each overlapping the one before; an empty text has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size - overlap))
    return docs.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("chunk", "at")).select("doc_id", "chunk", F.substring("text", F.col("at") + 1, F.lit(size)).alias("content"))


def chunk_words(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """The same over words."""
    words = docs.select("doc_id", F.array_remove(F.split("text", r"[ \t\n\r]+"), "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(size - overlap))
    return words.select("doc_id", "words", F.posexplode(starts).alias("chunk", "at")).select("doc_id", "chunk", F.array_join(F.slice("words", F.col("at") + 1, size), " ").alias("content"))
