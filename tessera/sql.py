"""Operators for SQL: ``register`` gives a session the functions that have no built-in expression.

    select d.* from versions v, lateral line_diff(v.old, v.new) d
    select d.* from files f, lateral declarations(f.content) d
    select apply_hunks(old, hunks) from versions        -- hunks: array of structs as of ``diff.hunks``
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators import diff
from tessera.sources import facts


class LineDiff:
    def eval(self, old: str, new: str) -> Iterator[tuple]:
        for seq, op in enumerate(diff.diff_ops(old or "", new or "")):
            yield (seq, *op)


class Declarations:
    def eval(self, content: str) -> Iterator[tuple]:
        for n, line in enumerate((content or "").split("\n"), 1):
            m = re.match(facts.DECLARATION, line)
            if m:
                yield m[3], facts.KINDS.get(m[2], m[2]), n, bool(m[1]) or (m[2] == "func" and m[3][0].isupper())


def register(spark: SparkSession) -> None:
    """Registers ``line_diff``, ``declarations`` (table functions) and ``apply_hunks``."""
    spark.udtf.register("line_diff", F.udtf(LineDiff, returnType="seq int, op string, old_line int, new_line int, line string"))
    spark.udtf.register("declarations", F.udtf(Declarations, returnType="name string, kind string, start_line int, exported boolean"))
    spark.udf.register("apply_hunks", lambda text, hunks: diff.apply_hunks(text or "", [h.asDict() for h in hunks or []]), StringType())
