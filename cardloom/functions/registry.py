"""The library's functions for SQL: register(spark) makes them known to a session by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cardloom.functions import embed
from cardloom.functions import scalars as S
from cardloom.functions import text as X
from cardloom.sources import io

#: name: (parameters, type, expression); pure SQL, so that calls are inlined and optimised with the query.
SCALARS = {
    "card_cosine": ("a array<float>, b array<float>", "double", S.cosine("a", "b")),
    "card_dot": ("a array<float>, b array<float>", "double", S.dot("a", "b")),
    "card_retention": ("ts double, now double, stability double", "double", S.retention("ts", "now", "stability", 24.0)),
    "card_vitality": ("last_access double, ts double, accesses bigint, now double", "double", S.vitality("last_access", "ts", "accesses", "now")),
    "card_tokens": ("said string", "bigint", f"cast({S.tokens('said')} as bigint)"),
    "card_jaccard": ("a array<string>, b array<string>", "double", S.jaccard("a", "b")),
    "card_fingerprint": ("fact string, tags array<string>", "string", S.fingerprint("fact", "tags")),
    "card_tags_of": ("said string", "array<string>", X.tags("said")),
    "card_fact_of": ("said string", "string", X.fact("said")),
}
#: Python functions over Arrow batches.
VECTORISED = {
    "llm_facts": embed.parse_facts,
    "llm_action": embed.parse_action,
    "unpack_float32": io.unpack_float32,
    "pack_float32": io.pack_float32,
}


@F.udtf(returnType="subject string, predicate string, object string", useArrow=True)
class Triplets:
    """Rows of a reply's triplets, for LATERAL: select t.* from replies, lateral llm_triplets(reply) t. (Functions of whole Arrow tables can't stand after LATERAL.)"""

    def eval(self, reply: str):
        yield from map(tuple, embed.triplets_of(reply))


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; gives their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    for name, f in VECTORISED.items():
        spark.udf.register(name, f)
    spark.udtf.register("llm_triplets", Triplets)
    return [*SCALARS, *VECTORISED, "llm_triplets"]
