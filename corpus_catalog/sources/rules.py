"""Ignore-rule and submodule files held in tables."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from corpus_catalog import config as C
from corpus_catalog.functions import globs, text as X

cloudpickle.register_pickle_by_value(globs)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RULE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("negated", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("regex", T.StringType()),
    ]
)
_RULES = T.ArrayType(_RULE)
_RULES_ARROW = to_arrow_type(_RULES)
_DECISION = T.StructType(
    [
        T.StructField("ignoring", T.StringType()),
        T.StructField("keeping", T.StringType()),
        T.StructField(
            "rules",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("negated", T.BooleanType()),
                        T.StructField("regex", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
_DECISION_ARROW = to_arrow_type(_DECISION)


# A rule file is one row; compiling its globs is the only work done in Python.


def ignore_rules(rule_files: DataFrame, defaults: list[str] = C.DEFAULT_IGNORE_RULES) -> DataFrame:
    """``(repo, content)`` to ordered rules, defaults first.

    One row per rule: repo, ord, negated, kind, pattern, regex; a malformed
    rule has no regex and never matches.
    """

    def parse(contents: pa.Array) -> pa.Array:
        parsed = (globs.parse_rules(c or "", defaults) for c in contents.to_pylist())
        fields = _RULE.fieldNames()
        rows = [[{f: getattr(r, f) for f in fields} for r in rules] for rules in parsed]
        return pa.array(rows, type=_RULES_ARROW)

    rules = arrow_udf(parse, _RULES)(F.col("content").cast("string"))
    return rule_files.select("repo", rules.alias("rules")).select("repo", F.inline("rules"))


def rule_warnings(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("regex").isNull()).select(
        "repo", F.concat(F.lit("malformed ignore rule: "), "pattern").alias("warning")
    )


def rules_by_repo(
    rule_files: DataFrame, defaults: list[str] = C.DEFAULT_IGNORE_RULES
) -> DataFrame:
    """The rules of each repo in the form that paths are tested with.

    ``ignoring`` and ``keeping`` are one regex each of all rules that ignore or
    keep; ``rules`` are the rules as runs of one sign, last run first.
    """

    def decide(contents: pa.Array) -> pa.Array:
        rows = []
        for content in contents.to_pylist():
            rules = globs.parse_rules(content or "", defaults)
            runs = [{"negated": n, "regex": r} for n, r in globs.decision_runs(rules)]
            ignoring, keeping = (globs.one_regex(rules, sign) for sign in (False, True))
            rows.append({"ignoring": ignoring, "keeping": keeping, "rules": runs})
        return pa.array(rows, type=_DECISION_ARROW)

    decision = arrow_udf(decide, _DECISION)(F.col("content").cast("string"))
    return rule_files.select("repo", decision.alias("decision")).select("repo", "decision.*")


def submodule_names(definitions: DataFrame) -> DataFrame:
    """``path = X`` values of submodule definition files ``(repo, content)``."""
    setting = rf"(?d)path{X.SPACE}*={X.SPACE}*(.+)"
    values = F.regexp_extract_all(F.col("content").cast("string"), F.lit(setting), F.lit(1))
    return definitions.select(
        "repo", F.explode(F.transform(values, X.strip)).alias("path")
    ).distinct()


def submodule_markers(files: DataFrame) -> DataFrame:
    """Directories holding a ``.git`` file that points elsewhere."""
    is_marker = (F.col("path") == ".git") | F.col("path").endswith("/.git")
    pointer = X.strip(F.col("content").cast("string")).startswith("gitdir:")
    return files.filter(is_marker & pointer).select(
        "repo", X.parent_dir(F.col("path")).alias("path")
    )
