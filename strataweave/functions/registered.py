"""The store's functions under names that SQL can call: expressions where SQL can say it, Arrow UDFs where it cannot."""

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataweave.functions import secrets, text

_B = text.BLANKS.replace("\\", "\\\\")
_EDGE = text.EDGE.replace('"', '\\"')
_TRIMMED = f"""regexp_replace(x, "^{_B}+|{_B}+$", "")"""

EXPRESSIONS = {
    "normalize_text(x STRING) RETURNS STRING": f"""regexp_replace(lower(regexp_replace({_TRIMMED}, "{_B}+", " ")), "^[{_EDGE}]+|[{_EDGE}]+$", "")""",
    "est_tokens(x STRING) RETURNS INT": f"""coalesce(greatest(cast(floor(char_length(x) / 4) AS INT), size(filter(split(x, "{_B}+"), w -> w != ""))), 0)""",
    "cosine_q(a ARRAY<TINYINT>, b ARRAY<TINYINT>) RETURNS DOUBLE": "aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (p, q) -> cast(p AS INT) * cast(q AS INT)), 0, (s, v) -> s + v) / 16129D",
    "quantize(v ARRAY<DOUBLE>) RETURNS ARRAY<TINYINT>": "transform(v, e -> cast(if(e = 0, 0D, greatest(-127D, least(127D, round(e / sqrt(aggregate(v, 0D, (s, p) -> s + p * p)) * 127)))) AS TINYINT))",
}


def register(spark: SparkSession) -> list[str]:
    """Makes normalize_text, est_tokens, cosine_q, quantize, salience, redact and extract_entities callable from SQL in this session; their names."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    cases = " ".join(f"WHEN lower({_TRIMMED}) RLIKE '(?:^|[^\\\\p{{L}}\\\\p{{N}}])(?:{p.replace(chr(39), chr(92) + chr(39))})(?:$|[^\\\\p{{L}}\\\\p{{N}}])' THEN '{kind}'" for kind, p in text.SALIENT.items())
    asks = ", ".join(f"'{w}'" for w in text.QUESTION_WORDS)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION salience(x STRING) RETURNS STRING RETURN CASE WHEN octet_length({_TRIMMED}) < 20 OR {_TRIMMED} LIKE '%?' "
        f"""OR split(lower({_TRIMMED}), "{_B}")[0] IN ({asks}) THEN NULL {cases} END"""
    )

    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else secrets.mask_secrets(t)[0])

    def candidates(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else secrets.entity_candidates(t, secrets.plain_normalize))

    udfs = {"redact": F.pandas_udf(redact, "string"), "extract_entities": F.pandas_udf(candidates, "array<string>")}
    for name, udf in udfs.items():
        spark.udf.register(name, udf)
    return [h.split("(")[0] for h in EXPRESSIONS] + ["salience", *udfs]
