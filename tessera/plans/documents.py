"""Document ETL queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ingest

WORDS, WORD_OVERLAP = 200, 40


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def html_to_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ingest.html_to_text(F.col("html")).alias("text"))


def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ingest.normalize(ingest.compose(F.concat("text", F.lit("e\u0301")))).alias("text"))


def split_headers(spark, sf_dir):
    """Every other line of a document becomes a header."""
    marked = F.regexp_replace("text", r"\n([^\n]*)\n", "\n## $1\n")
    return ingest.split_headers(_docs(spark, sf_dir).select("doc_id", marked.alias("text"))).select("doc_id", "part", "header", F.length("body").alias("n"))


def header_paths(spark, sf_dir):
    """Every third line becomes a header, of a level that follows its length."""
    marked = F.regexp_replace(F.regexp_replace("text", r"\n([^\n]{60,})\n", "\n# $1\n"), r"\n([^\n#][^\n]{20,59})\n", "\n### $1\n")
    sections = ingest.split_headers(_docs(spark, sf_dir).select("doc_id", marked.alias("text")))
    return ingest.with_header_path(sections).select("doc_id", "part", "header", "path")


def chunk_recursive(spark, sf_dir):
    return ingest.chunk_recursive(_docs(spark, sf_dir))


def _tokenizer():
    """Places of a public tokenizer's tokens; its file is part of the installation."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: library.encode(text, add_special_tokens=False).offsets


def chunk_tokenizer(spark, sf_dir):
    return ingest.chunk_tokenizer(_docs(spark, sf_dir), _tokenizer)


def chunk_fixed(spark, sf_dir):
    return ingest.chunk_characters(_docs(spark, sf_dir))


def chunk_tokens(spark, sf_dir):
    return ingest.chunk_words(_docs(spark, sf_dir), WORDS, WORD_OVERLAP)


_DECODED = "s"
for _entity, _char in ingest.ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"

QUERIES = {f.__name__: f for f in (html_to_text, normalize_text, split_headers, header_paths, chunk_fixed, chunk_recursive, chunk_tokens, chunk_tokenizer)}
ORACLES = {
    "html_to_text": f"""SELECT page_id, trim(regexp_replace({_DECODED}, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM (SELECT page_id,
      regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS s FROM pages)""",
    "normalize_text": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text || 'e' || chr(769)), '(\p{L})-\n(\p{L})', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents""",
    "split_headers": r"""WITH marked AS (SELECT doc_id, regexp_replace(text, '\n([^\n]*)\n', chr(10) || '## \1' || chr(10), 'g') AS text FROM documents),
      parts AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS part, unnest(p) AS s FROM (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\n(#{1,4} )', chr(1) || '\1', 'g'), chr(1)) AS p FROM marked)),
      named AS (SELECT *, regexp_extract(s, '^(#{1,4} [^\n]*)', 1) AS header FROM parts)
      SELECT doc_id, part::INTEGER AS part, header, length(CASE WHEN header <> '' THEN s[length(header) + 2:] ELSE s[2:] END)::INTEGER AS n FROM named""",
    "chunk_fixed": f"SELECT doc_id, (at // {ingest.CHUNK - ingest.OVERLAP})::INTEGER AS chunk, substr(text, at + 1, {ingest.CHUNK}) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), {ingest.CHUNK - ingest.OVERLAP})) AS at FROM documents)",
    "chunk_tokens": rf"""SELECT doc_id, (pos // {WORDS - WORD_OVERLAP})::INTEGER AS chunk, array_to_string(w[pos + 1:pos + {WORDS}], ' ') AS content
      FROM (SELECT doc_id, w, unnest(range(0, len(w), {WORDS - WORD_OVERLAP})) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents))""",
}
ORACLES["chunk_fixed"] = ORACLES["chunk_fixed"].replace("(at //", "(pos //").replace("at + 1", "pos + 1").replace("AS at", "AS pos")
