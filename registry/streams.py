"""Operators for streams, here over the whole table of events as a batch; tests feed them the same rows as a stream."""

from pyspark.sql import functions as F

from glasswork.models import LinearModel
from glasswork.operators.score import score
from glasswork.streaming.drift import drift, reference_shares
from registry.common import Registry, rounded, table

REG = Registry()
query = REG.query

EVENT_LINE = LinearModel("event_line", "binary", "y", ("value",), (-1.0,), ((0.02,),), (0, 1))


def scored_events(spark, sf):
    rows = table(spark, sf, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return score(rows, EVENT_LINE)


@query("score_drift", """
WITH s AS (SELECT date_trunc('day', ts) AS day, 1 / (1 + EXP(-(0.02 * value - 1))) AS p, (event_type = 'purchase')::INTEGER AS y FROM events),
b AS (SELECT *, LEAST(FLOOR(p * 10), 9)::INTEGER AS bin FROM s),
q AS (SELECT bins.i, GREATEST(COUNT(b.bin) / (SELECT COUNT(*) FROM b), 1e-4) AS q FROM (SELECT UNNEST(range(0, 10)) AS i) AS bins LEFT JOIN b ON b.bin = i GROUP BY 1),
d AS (SELECT day, COUNT(*) AS n, AVG(p) AS m, AVG(y) AS pos FROM b GROUP BY 1)
SELECT d.day AS start, d.n, ROUND(d.m, 6) AS mean_score, ROUND(d.pos, 6) AS positive_share,
  ROUND(SUM((GREATEST(k.k / d.n, 1e-4) - q.q) * LN(GREATEST(k.k / d.n, 1e-4) / q.q)), 6)::DOUBLE AS psi
FROM d JOIN (SELECT day, i, COUNT(*) FILTER (WHERE bin = i) AS k FROM b CROSS JOIN (SELECT UNNEST(range(0, 10)) AS i) GROUP BY 1, 2) AS k USING (day)
JOIN q USING (i) GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    """Daily drift of an event score against all days together."""
    rows = scored_events(spark, sf)
    out = drift(rows, "ts", reference_shares(rows), every="1 day", y="y")
    return rounded(out.select("start", "n", "mean_score", "positive_share", "psi"), "mean_score", "positive_share", "psi")
