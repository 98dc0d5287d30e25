"""The library's functions for SQL users, as SQL functions of the session: no Python runs when they are called."""

from __future__ import annotations

from pyspark.sql import SparkSession

from emenda.operators import language as L
from emenda.operators import relational as A
from emenda.plans import sql as S

#: name: arguments, type of the result, body in the portable dialect.
FUNCTIONS = {
    "emenda_plural": ("w STRING", "STRING", L._PLURAL),
    "emenda_singular": ("w STRING", "STRING", L._SINGULAR),
    "emenda_past": ("w STRING", "STRING", L._PAST),
    "emenda_gerund": ("w STRING", "STRING", L._GERUND),
    "emenda_sound": ("w STRING", "STRING", f"concat(substr(w, 1, 1), {L._FOLD})"),
    "emenda_private": ("text STRING", "BOOLEAN", A.PRIVATE),
}


def register(spark: SparkSession) -> None:
    """Define them; again is no error."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {S.for_spark(body)}")


def body(name: str, of: str) -> str:
    """A function's body over an expression, for DuckDB."""
    import re

    argument = FUNCTIONS[name][0].split()[0]
    return re.sub(rf"\b{argument}\b(?!')", f"({of})", S.for_duckdb(FUNCTIONS[name][2]))
