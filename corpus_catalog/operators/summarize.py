"""Gate every file, then summarise the ones that pass.

One narrow pass over the contents: nothing is shuffled, and the result carries
no content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog import config as C
from corpus_catalog.functions import python_source, text as X
from corpus_catalog.schemas import ENTRYPOINTS, SUMMARY, SUMMARY_FIELDS

BINARY = "binary_file"
TOO_LARGE = "file_too_large"
PRIVATE_KEY = "private_key_block"
NOT_FOUND = "file_not_found"
READ_ERROR = "read_error"

JS_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx"]
CONFIG_EXTENSIONS = [".yaml", ".yml", ".json"]
# Extensions with a summary of their own; others get a line count.
SUMMARIZED_EXTENSIONS = [".py", ".md", *JS_EXTENSIONS, *CONFIG_EXTENSIONS]


def exclusion_reason(content: Column, read_error: Column, unheld: Column, strict_keys: bool = False) -> Column:
    """Cheap tests first; the first hit wins; null means included."""
    return (
        F.when(read_error.isNotNull(), READ_ERROR)
        .when(content.isNull() & unheld.isNull(), NOT_FOUND)
        .when(X.is_binary(content) | unheld["binary"], BINARY)
        .when(unheld.isNotNull() | (F.octet_length(content) > C.MAX_FILE_BYTES), TOO_LARGE)
        .when(X.has_private_key(content, strict_keys), PRIVATE_KEY)
    )


def gate(files: DataFrame, strict_keys: bool = False) -> DataFrame:
    """Add source_hash, exclusion_reason, excluded, is_binary, text, decode_lossy.

    ``text`` is null for files whose text is not looked at.  ``unheld`` (binary, lines) stands for
    the content of files too large to be held; such a file must carry its hash.
    """
    if "unheld" not in files.columns:
        files = files.withColumn("unheld", F.lit(None).cast("struct<binary: boolean, lines: bigint>"))
    if "read_error" not in files.columns:
        files = files.withColumn("read_error", F.lit(None).cast("string"))
    if "source_hash" not in files.columns:
        files = files.withColumn("source_hash", X.source_hash(F.col("content")))
    content, reason = F.col("content"), F.col("exclusion_reason")
    readable = reason.isNull() | (reason == TOO_LARGE)
    lossy = F.when(reason.isNull(), X.is_lossy(content)).otherwise(
        F.coalesce(reason == TOO_LARGE, F.lit(False))
    )
    return (
        files.withColumn(
            "exclusion_reason", exclusion_reason(content, F.col("read_error"), F.col("unheld"), strict_keys)
        )
        .withColumn("excluded", reason.isNotNull())
        .withColumn("is_binary", F.coalesce(reason == BINARY, F.lit(False)))
        .withColumn("decode_lossy", lossy)
        .withColumn("text", F.when(readable, X.decode(content)))
    )


def _strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def _python_text(parsed: Column, name: Column) -> Column:
    doc, symbols, imports = parsed["docstring"], parsed["symbols"], parsed["imports"]
    listed = F.concat_ws(
        ". ",
        F.when(
            F.size(symbols) > 0,
            F.concat(F.lit("Defines: "), X.head_list(symbols, C.SUMMARY_LIST_ITEMS)),
        ),
        F.when(
            F.size(imports) > 0,
            F.concat(F.lit("Imports: "), X.head_list(imports, C.SUMMARY_LIST_ITEMS)),
        ),
    )
    return (
        F.when(doc != "", doc)
        .when(listed != "", listed)
        .otherwise(F.concat(F.lit("Python file: "), name))
    )


def summarize(files: DataFrame, strict_keys: bool = False) -> DataFrame:
    """``(repo, path, content[, read_error])`` to one summary row per file."""
    path, text, reason = F.col("path"), F.col("text"), F.col("exclusion_reason")
    name, ext = F.col("name"), F.col("ext")
    exports = F.col("exports")
    is_js = ext.isin(JS_EXTENSIONS)
    unheld_text = (reason == TOO_LARGE) & text.isNull()

    read = (
        gate(files, strict_keys)
        .withColumn("name", X.file_name(path))
        .withColumn("ext", X.extension(path))
    )
    # Everything that needs the text.  The parser is called one step later, so
    # that rows queue up for Python without their texts.
    features = read.select(
        "repo",
        "path",
        "source_hash",
        "excluded",
        "exclusion_reason",
        "is_binary",
        "decode_lossy",
        "read_error",
        "name",
        "ext",
        F.when(text.isNull() & ~unheld_text, "unknown").otherwise(X.role(path, F.coalesce(text, F.lit("")))).alias("role"),
        F.when(reason.isNull(), X.redaction_count(text)).otherwise(0).alias("redaction_count"),
        F.when(is_js, X.js_exports(text)).alias("exports"),
        F.when(is_js, X.js_imports(text)).alias("js_imports"),
        F.when(ext == ".md", X.markdown_title(text)).alias("title"),
        F.when(unheld_text, F.col("unheld.lines")).when(~ext.isin(SUMMARIZED_EXTENSIONS), X.line_count(text)).alias("lines"),
        text.isNotNull().alias("has_text"),
        F.when(ext == ".py", text).alias("python_text"),
    )
    parsed = python_source.parsed_python(F.col("python_text"))

    found = (
        F.when(ext == ".py", _python_text(parsed, name))
        .when(is_js & F.col("has_text"), F.format_string("JavaScript/TypeScript file with %d exports", F.size(exports)))
        .when(ext.isin(CONFIG_EXTENSIONS), F.concat(F.lit("Configuration file: "), name))
        .when(
            ext == ".md",
            F.coalesce(
                F.concat(F.lit("Documentation: "), "title"),
                F.concat(F.lit("Markdown documentation: "), name),
            ),
        )
        .otherwise(F.concat(name, F.lit(": "), F.col("lines").cast("string"), F.lit(" lines")))
    )
    summary = (
        F.when(F.col("has_text") | (reason == TOO_LARGE), X.clip(found))
        .when(reason == BINARY, F.concat(F.lit("Binary file: "), name))
        .when(reason == PRIVATE_KEY, "File excluded: contains private key")
        .when(reason == READ_ERROR, F.concat(F.lit("Could not read file: "), "read_error"))
        .otherwise(F.concat(F.lit("File not found: "), path))
    )
    symbols = F.coalesce(parsed["symbols"], F.slice(exports, 1, C.JS_SYMBOL_ITEMS), _strings())
    imports = F.coalesce(parsed["imports"], "js_imports", _strings())
    guards = F.transform(
        parsed["guard_lines"],
        lambda lineno: F.struct(
            path.alias("path"),
            lineno.alias("lineno"),
            F.lit(C.ENTRYPOINT_EVIDENCE).alias("evidence"),
            F.lit(C.ENTRYPOINT_CONFIDENCE).alias("confidence"),
        ),
    )
    entrypoints = F.coalesce(F.when(reason.isNull(), guards), F.array().cast(ENTRYPOINTS))
    return features.select(
        "repo",
        "path",
        "source_hash",
        summary.alias("summary"),
        "role",
        symbols.alias("public_symbols"),
        imports.alias("import_deps"),
        entrypoints.alias("entrypoints"),
        "excluded",
        "exclusion_reason",
        "redaction_count",
        "is_binary",
        "decode_lossy",
        parsed["error"].alias("parse_error"),
    ).select(
        "repo",
        "path",
        "source_hash",
        "summary",
        "role",
        "public_symbols",
        F.size("public_symbols").alias("public_symbols_count"),
        "import_deps",
        _strings().alias("provides"),
        _strings().alias("consumes"),
        "entrypoints",
        F.size("entrypoints").alias("entrypoints_count"),
        "excluded",
        "exclusion_reason",
        "redaction_count",
        "is_binary",
        "decode_lossy",
        "parse_error",
    )


def packed(summaries: DataFrame) -> DataFrame:
    """``(repo, path, source_hash, summary struct)``, the shape of the cache."""
    return summaries.select(
        "repo", "path", "source_hash", F.struct(*SUMMARY_FIELDS).cast(SUMMARY).alias("summary")
    )


def unpacked(packed_rows: DataFrame) -> DataFrame:
    """Reverse of ``packed``; further columns are kept."""
    others = [c for c in packed_rows.columns if c != "summary"]
    return packed_rows.select(*others, "summary.*")


def missing_defaults(summaries: DataFrame) -> DataFrame:
    """Fill fields that an older or partial summary lacks."""
    filled = {
        "source_hash": F.lit(""),
        "summary": F.lit(""),
        "role": F.lit("unknown"),
        "public_symbols": _strings(),
        "import_deps": _strings(),
        "entrypoints": F.array().cast(ENTRYPOINTS),
    }
    return summaries.withColumns(
        {
            name: F.coalesce(F.col(name), default) if name in summaries.columns else default
            for name, default in filled.items()
        }
    )


def symbols(summaries: DataFrame) -> DataFrame:
    """One row per public symbol, in file order."""
    return summaries.select(
        "repo", "path", F.posexplode("public_symbols").alias("position", "symbol")
    )


def redacted_text(files: DataFrame) -> DataFrame:
    """Text with secret-like literals replaced, and the number of changed lines."""
    text = F.col("text")
    return files.withColumn("text", X.decode(F.col("content"))).select(
        "repo",
        "path",
        X.redact(text).alias("redacted"),
        X.redaction_count(text).alias("redaction_count"),
    )
