"""Table schemas."""

from pyspark.sql import types as T

ENTRYPOINTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("lineno", T.IntegerType()),
            T.StructField("evidence", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
)

# What the source parser returns for one file.
PARSED = T.StructType(
    [
        T.StructField("symbols", T.ArrayType(T.StringType())),
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("docstring", T.StringType()),
        T.StructField("guard_lines", T.ArrayType(T.IntegerType())),
        T.StructField("error", T.StringType()),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("public_symbols", T.ArrayType(T.StringType())),
        T.StructField("public_symbols_count", T.IntegerType()),
        T.StructField("import_deps", T.ArrayType(T.StringType())),
        T.StructField("provides", T.ArrayType(T.StringType())),
        T.StructField("consumes", T.ArrayType(T.StringType())),
        T.StructField("entrypoints", ENTRYPOINTS),
        T.StructField("entrypoints_count", T.IntegerType()),
        T.StructField("excluded", T.BooleanType()),
        T.StructField("exclusion_reason", T.StringType()),
        T.StructField("redaction_count", T.IntegerType()),
        T.StructField("is_binary", T.BooleanType()),
        T.StructField("decode_lossy", T.BooleanType()),
    ]
)
SUMMARY_FIELDS = [f.name for f in SUMMARY.fields]

CACHE = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("source_hash", T.StringType()),
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("backend_id", T.StringType()),
        T.StructField("tool_version", T.StringType()),
        T.StructField("summary", SUMMARY),
        T.StructField("ts", T.TimestampType()),
        T.StructField("approx_tokens", T.LongType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("size", T.LongType()),
        T.StructField("read_error", T.StringType()),
        T.StructField("source_hash", T.StringType()),
        # Set for a file too large to be held, which has no content.
        T.StructField(
            "unheld", T.StructType([T.StructField("binary", T.BooleanType()), T.StructField("lines", T.LongType())])
        ),
    ]
)

FILE_VERSIONS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# Settings of repos as they change: the kinds are named in streaming.watch.
SETTING_VERSIONS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
