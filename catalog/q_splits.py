"""Splits that keep together what shares a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import table
from catalog.registry import query
from prefmill.operators.groups import side, with_components


@query(
    "split_by_keys",
    """
WITH RECURSIVE pairs AS (
  SELECT DISTINCT 'conv_id=' || a.conv_id AS a, 'conv_id=' || b.conv_id AS b FROM conversations a JOIN conversations b ON a.text = b.text
), reach AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), named AS (
  SELECT a, min(b) AS component FROM (SELECT a, b FROM reach UNION SELECT 'conv_id=' || conv_id, 'conv_id=' || conv_id FROM conversations) GROUP BY a
)
SELECT conv_id, turn, component, ('0x' || substr(md5('0:' || component), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < 0.8::DOUBLE AS is_first
FROM conversations JOIN named ON a = 'conv_id=' || conv_id""",
)
def split_by_keys(spark, sf_dir):
    """Turns that share their conversation or their text, directly or through others, on one side."""
    marked = with_components(table(spark, sf_dir, "conversations"), ["conv_id", "text"])
    first = side(F.col("component"), F.col("conv_id").cast("string"), 0.8)
    return marked.select("conv_id", "turn", "component", first.alias("is_first"))
