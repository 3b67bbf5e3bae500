"""Readers: files to documents, question files to queries and passages."""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import checksum, document_id
from millrace.functions.text import fields, normalise, strip

# Which suffixes are read as what.
MARKDOWN = ("md", "markdown", "mdown")
PLAIN = ("txt", "log", "json", "yaml", "yml", "py", "ts", "tsx", "js")
CORPUS_GLOB = "*.{txt,md,json}"


class UnsupportedFormat(ValueError):
    """A file whose suffix no parser reads."""


def kind_of(path: Column) -> Column:
    """markdown, pdf, text, or null for a path by its suffix in lower case."""
    suffix = F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))
    return F.when(suffix.isin(*MARKDOWN), "markdown").when(suffix == "pdf", "pdf").when(suffix.isin(*PLAIN), "text")


def _decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            return bytes(data).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(data).decode("latin-1")

    for blobs in batches:
        yield blobs.map(one)


def decode(data: Column) -> Column:
    """UTF-8, or Latin-1 where that fails."""
    return F.pandas_udf(_decode, "string")(data)


_CONTROL = "".join(chr(c) for c in (*range(9), 11, 12, *range(14, 32), 127))


def plain_text(text: Column) -> Column:
    """content (controls dropped, stripped), with line, character and word counts from before stripping."""
    clean = F.translate(text, _CONTROL, "")
    ends = F.regexp_count(clean, F.lit("\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\x{2028}\\x{2029}]"))
    open_line = (~clean.rlike("[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\x{2028}\\x{2029}]\\z") & (F.length(clean) > 0)).cast("int")
    return F.struct(
        strip(clean).alias("content"),
        (ends + open_line).alias("line_count"),
        F.length(clean).alias("char_count"),
        F.size(fields(clean)).alias("word_count"),
    )


_FRONT = re.compile(r"\A---[^\S\n]*\n(.*?)\n---[^\S\n]*(?:\n|\Z)", re.S)
_HEADER = re.compile(r"^(#{1,6})[^\S\n]+(.+?)[^\S\n]*$", re.M)
_FENCE = re.compile(r"^```.*?^```", re.M | re.S)


def parse_markdown(text: str) -> tuple[str, dict[str, str], list[tuple[int, str, int]], int]:
    """Body, front matter, headers (level, title, offset in the unstripped body), and fenced blocks."""
    meta: dict[str, str] = {}
    found = _FRONT.match(text)
    if found:
        try:
            import yaml

            loaded = yaml.safe_load(found[1])
            meta = {str(k): str(v) for k, v in loaded.items()} if isinstance(loaded, dict) else {}
        except Exception:  # a block that isn't YAML is no metadata
            meta = {}
        text = text[found.end() :]
    headers = [(len(m[1]), m[2].strip(), m.start()) for m in _HEADER.finditer(text)]
    return text.strip(), meta, headers, len(_FENCE.findall(text))


_MARKDOWN = "struct<content:string,metadata:map<string,string>,headers:array<struct<level:int,title:string,char_offset:int>>,code_blocks:int>"


def _markdown(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [parse_markdown(t or "") for t in texts]
        yield pd.DataFrame(
            {
                "content": [r[0] for r in rows],
                "metadata": [r[1] for r in rows],
                "headers": [[dict(level=a, title=b, char_offset=c) for a, b, c in r[2]] for r in rows],
                "code_blocks": [r[3] for r in rows],
            }
        )


def markdown(text: Column) -> Column:
    return F.pandas_udf(_markdown, _MARKDOWN)(text)


def pdf_pages(data: bytes) -> list[str]:
    """The stripped text of every page (optional package pypdf); encrypted files are tried with an empty password."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        reader.decrypt("")
    return [unicodedata.normalize("NFKC", page.extract_text() or "").strip() for page in reader.pages]


def _pdf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for blobs in batches:
        yield pd.Series([pdf_pages(bytes(b)) if b is not None else None for b in blobs], dtype=object)


def pdf(data: Column) -> Column:
    """Page texts; pages without text stay in the list."""
    return F.pandas_udf(_pdf, "array<string>")(data)


def folder(spark: SparkSession, path: str, glob: str = CORPUS_GLOB) -> DataFrame:
    """Files of one folder, not of its subfolders: filename and bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("content").alias("data"))


#: From a table of files (filename, file_type, data, text) of one kind to filename, file_type, content, metadata.
Parser = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, Parser] = {}
_SUFFIXES: dict[str, str] = {}


def register_parser(kind: str, *suffixes: str):
    """Add the parser of a kind of file, and the suffixes that name it."""

    def add(parser: Parser) -> Parser:
        _PARSERS[kind] = parser
        _SUFFIXES.update(dict.fromkeys(suffixes, kind))
        return parser

    return add


@register_parser("text")
def _parse_plain(files: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return files.select("filename", "file_type", plain_text(F.col("text"))["content"].alias("content"), F.map_from_arrays(none, none).alias("metadata"))


@register_parser("markdown")
def _parse_markdown(files: DataFrame) -> DataFrame:
    return files.withColumn("m", markdown(F.col("text"))).select("filename", "file_type", "m.content", "m.metadata")


@register_parser("pdf")
def _parse_pdf(files: DataFrame) -> DataFrame:
    pages = files.withColumn("pages", pdf(F.col("data")))
    body = F.array_join(F.filter("pages", lambda p: p != ""), "\n\n")
    return pages.select("filename", "file_type", body.alias("content"), F.create_map(F.lit("page_count"), F.size("pages").cast("string")).alias("metadata"))


def documents(spark: SparkSession, path: str, glob: str = CORPUS_GLOB, domain: str = "general") -> DataFrame:
    """doc_id, filename, place, content, metadata, domain, file_type, checksum, created_at of every readable file.

    ``place`` numbers the files by name, as a folder lists them.  A file of an unknown suffix is an error when the row
    is read.
    """
    files = folder(spark, path, glob)
    kind = kind_of(F.col("filename"))
    for suffix, name in _SUFFIXES.items():
        kind = F.when(F.lower("filename").endswith(f".{suffix}"), name).otherwise(kind)
    files = files.withColumn("kind", kind)
    known = F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("unsupported format: "), "filename")))
    files = files.withColumn("file_type", F.coalesce(known.cast("string"), "kind")).drop("kind").withColumn("text", normalise(decode(F.col("data"))))
    parts = [parse(files.where(F.col("file_type") == name)) for name, parse in _PARSERS.items() if name != "pdf" or "pdf" in glob]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # a folder of files is a curated corpus: its names fit one task
    place = F.row_number().over(Window.orderBy("filename")) - 1
    out = out.withColumn("checksum", checksum(F.col("content"))).withColumn("place", place)
    columns = ["filename", "place", "content", "metadata", F.lit(domain).alias("domain"), "file_type", "checksum", F.current_timestamp().alias("created_at")]
    return out.select(document_id(F.col("checksum")).alias("doc_id"), *columns)


_PASSAGE = "struct<doc_id:string,passage_id:string,text_snippet:string,start_char:int,end_char:int>"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a JSON-lines file, under any of their field names, with ``ground_truth_passages`` as an array.

    An absent or empty name falls to the next; an id that is missing everywhere is ``q_`` and the line's number,
    blank lines counted.  A passage that is a bare string is a snippet without a document.
    """
    raw = spark.read.text(path, wholetext=True).select("_metadata.file_path", F.posexplode(F.split("value", "\\r?\\n")).alias("line", "json"))
    raw = raw.where(F.trim("json") != "")
    get = lambda name: F.nullif(F.get_json_object("json", f"$.{name}"), F.lit(""))
    first = lambda *names: F.coalesce(*map(get, names))
    listed = F.from_json(first("ground_truth_passages", "passages"), "array<string>")
    passage = F.transform(
        F.coalesce(listed, F.array().cast("array<string>")),
        lambda p: F.when(
            p.startswith("{"),
            F.from_json(p, _PASSAGE),
        ).otherwise(F.struct(F.lit("").alias("doc_id"), F.lit(None).cast("string").alias("passage_id"), p.alias("text_snippet"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"))),
    )
    return raw.select(
        F.coalesce(first("query_id", "id"), F.concat(F.lit("q_"), F.col("line") + 1)).alias("query_id"),
        first("query", "query_text", "question").alias("query"),
        first("ground_truth_answer", "answer", "reference_answer").alias("answer"),
        passage.alias("ground_truth_passages"),
        F.coalesce(get("domain"), F.lit("general")).alias("domain"),
        F.coalesce(get("language"), F.lit("en")).alias("language"),
        F.coalesce(get("difficulty"), F.lit("medium")).alias("difficulty"),
        *(get(n).alias(n) for n in ("information_unit_id", "translation_pair_id", "modality", "query_language", "document_language")),
    )


def passages(queries: DataFrame) -> DataFrame:
    """One row per gold passage: passage (its key), query_id, doc_id, snippet, start_char, end_char."""
    rows = queries.select("query_id", F.posexplode("ground_truth_passages").alias("n", "p"))
    key = F.concat_ws("#", "query_id", "n")
    return rows.select(key.alias("passage"), "query_id", "p.doc_id", F.col("p.text_snippet").alias("snippet"), "p.start_char", "p.end_char")


def legacy_questions(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a JSON file that holds a list."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("query_id", "id", "query", "question", "answer", "expected_answer")])
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    return rows.select(F.coalesce("query_id", "id").alias("query_id"), F.coalesce("query", "question").alias("query"), F.coalesce("answer", "expected_answer").alias("answer"))
