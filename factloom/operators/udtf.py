"""Table functions in SQL: fl_lens(code, language, path, commit)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..lang import COLUMNS, file_facts, own_languages
from .extract import FACTS

_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACTS if f.name in COLUMNS)


def register(spark: SparkSession) -> None:
    """Again after a language has been added, which the function takes along."""
    own = own_languages()

    class Lens:
        """The facts of one file, a row each."""

        def eval(self, code: str, language: str, path: str, commit_sha: str):
            if code is not None:
                for row in file_facts(code, language, path, own):
                    yield tuple(row.get(c) for c in COLUMNS)

    spark.udtf.register("fl_lens", udtf(Lens, returnType=_SCHEMA))
