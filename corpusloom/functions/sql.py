"""The scalar operators as SQL functions.

Each is a SQL expression over its arguments, which the optimizer puts in place of
the call: ``SELECT mlm_labels(...)`` plans like the DataFrame operator. Arguments
that an operator takes from a configuration are ordinary arguments here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from corpusloom.config import IGNORE_LABEL
from corpusloom.functions.draws import MASK
from corpusloom.registry import Registry


@dataclass(frozen=True)
class SqlFunction:
    arguments: str
    returns: str
    body: str


FUNCTIONS = Registry("SQL function")


def define(name: str, arguments: str, returns: str, body: str) -> None:
    FUNCTIONS.register(name)(SqlFunction(arguments, returns, body))


define("epoch_offset", "epoch BIGINT, length BIGINT, phases BIGINT", "BIGINT", "pmod(epoch, phases) * length div phases")
define("round_up", "n BIGINT, multiple BIGINT", "BIGINT", "(n + multiple - 1) div multiple * multiple")
define("num_sequences", "total BIGINT, start BIGINT, length BIGINT", "BIGINT", "greatest(total - start, 0L) div length")
define("perplexity", "loss DOUBLE", "DOUBLE", "exp(least(loss, 100D))")
define("shard_split", "shard_index BIGINT, val_shards BIGINT", "STRING", "CASE WHEN shard_index < val_shards THEN 'val' ELSE 'train' END")
define("attention_mask", "ids ARRAY<INT>, pad INT", "ARRAY<INT>", "transform(ids, x -> CAST(x <> pad AS INT))")
define(
    "special_mask", "ids ARRAY<INT>, pad INT, cls INT, sep INT", "ARRAY<BOOLEAN>", "transform(ids, x -> x IN (pad, cls, sep))"
)
define("valid_labels", "labels ARRAY<INT>", "ARRAY<INT>", f"filter(labels, x -> x <> {IGNORE_LABEL})")
# Same draw as functions.draws, of the key (use, seed, epoch, window, place).
_DRAW = (
    "shiftrightunsigned(shiftrightunsigned(xxhash64({use}L, seed, epoch, seq_idx, CAST({at} AS BIGINT)), 4), 28)"
)
_DRAW_MD5 = (
    "shiftrightunsigned(CAST(conv(substr(md5(concat_ws(':', '{use}', CAST(seed AS STRING), CAST(epoch AS STRING),"
    " CAST(seq_idx AS STRING), CAST({at} AS STRING))), 1, 15), 16, 10) AS BIGINT), 28)"
)
define("draw_at", "seed BIGINT, epoch BIGINT, seq_idx BIGINT, place INT", "BIGINT", _DRAW.format(use=MASK, at="place"))
for _suffix, _draw in (("", _DRAW), ("_md5", _DRAW_MD5)):
    define(
        f"mask_choice{_suffix}",
        "ids ARRAY<INT>, pad INT, cls INT, sep INT, probability DOUBLE, seed BIGINT, epoch BIGINT, seq_idx BIGINT",
        "ARRAY<BOOLEAN>",
        f"transform(ids, (x, i) -> NOT (x IN (pad, cls, sep)) AND {_draw.format(use=MASK, at='i')}"
        " < CAST(floor(probability * 4294967296D) AS BIGINT))",
    )
define(
    "hide", "ids ARRAY<INT>, chosen ARRAY<BOOLEAN>, mask INT", "ARRAY<INT>", "zip_with(ids, chosen, (x, c) -> CASE WHEN c THEN mask ELSE x END)"
)
define(
    "labels_of", "ids ARRAY<INT>, chosen ARRAY<BOOLEAN>", "ARRAY<INT>",
    f"zip_with(ids, chosen, (x, c) -> CASE WHEN c THEN x ELSE {IGNORE_LABEL} END)",
)


def create_functions(spark: SparkSession, *names: str, prefix: str = "") -> list[str]:
    """Makes temporary SQL functions of these names, or of all; a function that the session has already is an error."""
    made = []
    for name in names or tuple(FUNCTIONS):
        function = FUNCTIONS[name]
        spark.sql(
            f"CREATE TEMPORARY FUNCTION {prefix}{name}({function.arguments}) RETURNS {function.returns} RETURN {function.body}"
        )
        made.append(f"{prefix}{name}")
    return made


def drop_functions(spark: SparkSession, *names: str, prefix: str = "") -> None:
    for name in names or tuple(FUNCTIONS):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {prefix}{name}")
