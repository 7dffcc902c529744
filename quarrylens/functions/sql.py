"""The library's column functions as temporary functions of SQL, and its extraction as a table function.

A function's body is the SQL text of its own column expression, so both are one definition: Catalyst inlines the body and
optimizes it with the query. ``register(spark)`` makes all of them known to a session:

    SELECT line, i.type, i.value FROM logs, LATERAL extract_iocs(line) AS i WHERE i.type = 'domain'
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import decoders, indicators, network, protocols

_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|`[^`]*`|(?<![^\s(,])(<=>|<=|>=|!=|<|>|=|\+|-|\*|/|%|&|\||\^|and|or)\(|(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])", re.S)

#: Name, arguments and expression; names that Spark has already keep a prefix.
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "refang": ("t STRING", indicators.refang),
    "defang": ("t STRING", indicators.defang),
    "url_host": ("t STRING", indicators.url_host),
    "is_ipv6": ("t STRING", indicators.is_ipv6),
    "detect_type": ("t STRING", indicators.detect_type),
    "iocs_of": ("t STRING", indicators.iocs_of),
    "decode_base64": ("t STRING", decoders.base64),
    "decode_hex": ("t STRING", decoders.hex_text),
    "decode_url": ("t STRING", decoders.url_text),
    "rot13": ("t STRING", decoders.rot13),
    "second_level_label": ("t STRING", network.second_level_label),
    "text_entropy": ("t STRING", network.entropy),
    "consonant_run": ("t STRING", network.consonant_run),
    "looks_generated": ("t STRING", network.looks_generated),
    "classify_ipv4": ("t STRING", network.classify_ipv4),
    "classify_ipv6": ("t STRING", network.classify_ipv6),
    "bad_agent": ("t STRING", protocols.bad_agent),
    "known_ja3": ("t STRING", protocols.known_ja3),
    "file_format": ("t BINARY", protocols.file_format),
}


#: A function's value cannot be exploded at once; the array of positions can.
_EXTRACT = "SELECT i AS pos, found[i].type, found[i].value FROM (SELECT iocs_of(t) AS found), LATERAL explode(sequence(0, size(found))) AS p(i) WHERE i < size(found)"


def sql_text(column: Column) -> str:
    """A column as SQL. Operators are called by their quoted names, as the column's own text has them in front of their
    arguments; numbers with a point are doubles, as in the column, and not decimals."""
    return _TOKEN.sub(lambda m: f"`{m[1]}`(" if m[1] else f"{m[2]}D" if m[2] else m[0], column._jc.node().sql())


def register(spark: SparkSession) -> None:
    """Make all functions, and the table function ``extract_iocs(text)``, known to the session's SQL."""
    for name, (arguments, function) in FUNCTIONS.items():
        names = [a.split()[0] for a in arguments.split(", ")]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {sql_text(function(*map(F.col, names)))}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extract_iocs(t STRING) RETURNS TABLE(pos INT, type STRING, value STRING) RETURN " + _EXTRACT)
