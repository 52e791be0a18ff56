"""Queries of monitors that follow a bank of healthy sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..catalog import register
from ..operators.windows import local_query
from ..streaming import folds
from ..streaming import matching as X
from .common import RANGE, r6, s6, table

#: A vector as a route: a front and a back layer, four flow steps, the state and an action, four experts.
SHAPE = X.Shape(2, 4, 2, 4)
#: Labels whose first episode is a healthy sequence; steps of the bank at most.
HEALTHY, MOST_STEPS = (0, 1, 2), 10_000
THRESHOLD = 1.0


def flat_routes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / RANGE)).cast("long").alias("ep"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("route"))
    return local_query(e, "ep", "vec_id").select("ep", "q", "route")


def bank_of(routes, episodes: list[int]) -> list[np.ndarray]:
    """Sequences of the episodes, in the order given; a bank beyond its bound raises."""
    rows = routes.where(F.col("ep").isin(episodes)).orderBy("ep", "q").limit(MOST_STEPS + 1).collect()
    if len(rows) > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS} steps in the bank")
    return [np.array([r["route"] for r in rows if r["ep"] == ep]) for ep in episodes]


EPISODES = [h * 1_000_000 for h in HEALTHY]

#: Normalised routes as one row for each place in them; local distances of every step to every step of the bank; costs step by step.
MATCH = f"""r0 AS (SELECT vec_id, (label * 1000000 + vec_id // {RANGE})::BIGINT AS ep, [abs(x::DOUBLE) FOR x IN embedding] AS a FROM embeddings),
r1 AS (SELECT *, (row_number() OVER (PARTITION BY ep ORDER BY vec_id) - 1)::INTEGER AS q FROM r0),
r2 AS (SELECT ep, q, j // 32 AS l, (j // 8) % 4 AS f, (j // 4) % 2 AS u, j % 4 AS e, a[j + 1] AS x FROM r1, range(64) t(j)),
r3 AS MATERIALIZED (SELECT ep, q, l, f, u, e, x / greatest(sum(x) OVER (PARTITION BY ep, q, l, f, u), 1e-12) AS p FROM r2),
bk AS MATERIALIZED (SELECT * FROM r3 WHERE ep IN ({', '.join(map(str, EPISODES))})),
af AS (SELECT a.ep, a.q, b.ep AS ref, b.q AS pos, a.f, sum(sqrt(a.p * b.p)) AS c FROM r3 a JOIN bk b ON a.l = 0 AND b.l = 0 AND a.u = 1 AND b.u = 1 AND a.f = b.f AND a.e = b.e GROUP BY ALL),
ad AS MATERIALIZED (SELECT ep, q, ref, pos, avg(sqrt(least(greatest(1 - c, 0), 1))) AS d FROM af GROUP BY ALL),
lo AS (SELECT a.ep, a.q, a.ref, a.pos, 0.5 * (a.d + b.d) AS x FROM ad a JOIN ad b ON a.ep = b.ep AND a.ref = b.ref AND b.q = a.q - 1 AND b.pos = a.pos - 1),
ll AS MATERIALIZED (SELECT ep, q, ref, list(x ORDER BY pos) AS x FROM lo GROUP BY ALL),
co AS (SELECT ep, q, ref, [CASE WHEN i = 1 THEN x[1] ELSE 'inf'::DOUBLE END FOR i IN range(1, len(x) + 1)] AS c FROM ll WHERE q = 1
  UNION ALL SELECT ll.ep, ll.q, ll.ref, [ll.x[i] + least(co.c[i], CASE WHEN i > 1 THEN co.c[i - 1] ELSE 'inf'::DOUBLE END, CASE WHEN i > 2 THEN co.c[i - 2] ELSE 'inf'::DOUBLE END) FOR i IN range(1, len(ll.x) + 1)] FROM co JOIN ll ON ll.ep = co.ep AND ll.ref = co.ref AND ll.q = co.q + 1),
mt AS MATERIALIZED (SELECT co.ep, co.q, co.ref, list_position(c, list_min(c))::INTEGER AS pos, x[list_position(c, list_min(c))] AS here FROM co JOIN ll USING (ep, q, ref))"""


def alarms_sql(rejected: str, source: str, columns: list[str]) -> str:
    """Runs of rejected steps and the first alarm, over every step."""
    return f"""aa AS (SELECT r1.ep, r1.q, s.* EXCLUDE (ep, q), coalesce({rejected}, false) AS rejected FROM r1 LEFT JOIN {source} s USING (ep, q)),
    ab AS (SELECT *, (q - coalesce(max(CASE WHEN NOT rejected THEN q END) OVER o, -1))::INTEGER AS run FROM aa WINDOW o AS (PARTITION BY ep ORDER BY q ROWS UNBOUNDED PRECEDING))
    SELECT ep, q, {', '.join(s6(c, c) for c in columns)}, rejected, run, run >= 2 AS alarm, coalesce(min(CASE WHEN run >= 2 THEN q END) OVER (PARTITION BY ep ORDER BY q ROWS UNBOUNDED PRECEDING), -1) AS first_alarm FROM ab"""


ACC = "sqrt(sum(power(sqrt(c.p) - 2 * sqrt(b.p) + sqrt(a.p), 2)) / 2)"
EXCESS = f"""WITH RECURSIVE {MATCH},
ac AS (SELECT a.ep, a.q, a.l, a.f, {ACC} AS m FROM r3 a JOIN r3 b ON a.ep = b.ep AND a.q = b.q AND a.l = b.l AND a.u = b.u AND a.e = b.e AND b.f = a.f + 1 JOIN r3 c ON a.ep = c.ep AND a.q = c.q AND a.l = c.l AND a.u = c.u AND a.e = c.e AND c.f = a.f + 2 WHERE a.u = 1 GROUP BY ALL),
ax AS MATERIALIZED (SELECT ep, q, avg(m) FILTER (l = 0) AS fa, avg(m) FILTER (l = 1) AS ba FROM ac GROUP BY ep, q),
hr AS (SELECT mt.ep, mt.q, avg(here) AS match_distance, max(h.ba / greatest(h.fa, 1e-12)) AS healthy_ratio FROM mt JOIN ax h ON h.ep = mt.ref AND h.q = mt.pos GROUP BY mt.ep, mt.q),
sc AS (SELECT ep, q, match_distance, fa AS front_acceleration, ba AS back_acceleration, ba / greatest(fa, 1e-12) AS ratio, healthy_ratio, ba / greatest(fa, 1e-12) / greatest(healthy_ratio, 1e-12) AS excess FROM hr JOIN ax USING (ep, q)),
{alarms_sql(f'excess > {THRESHOLD}', 'sc', ['match_distance', 'front_acceleration', 'back_acceleration', 'ratio', 'healthy_ratio', 'excess'])}"""


def _shown(rows, columns):
    return rows.select("ep", "q", *[r6(c, c) for c in ("match_distance", *columns)], "rejected", "run", "alarm", "first_alarm")


@register("acceleration_excess_alarm", EXCESS)
def acceleration_excess_alarm(spark, d):
    """Alarms where the back layers accelerate more, against the front, than in any healthy route at the matched place."""
    routes = flat_routes(spark, d)
    rule = X.AccelerationExcess(bank_of(routes, EPISODES), SHAPE, THRESHOLD)
    return _shown(folds.batch(routes, rule), rule.columns)


STALE = f"""WITH RECURSIVE {MATCH},
gp AS (SELECT a.ep, a.q, a.f, sqrt(0.5 * sum(power(sqrt(a.p) - sqrt(b.p), 2))) AS m FROM r3 a JOIN r3 b ON a.ep = b.ep AND a.q = b.q AND a.f = b.f AND a.e = b.e AND a.l = 0 AND b.l = 0 AND a.u = 0 AND b.u = 1 GROUP BY ALL),
ga AS MATERIALIZED (SELECT ep, q, avg(m) AS gap FROM gp GROUP BY ALL),
jp AS (SELECT a.ep, a.q, a.f, sqrt(0.5 * sum(power(sqrt(a.p) - sqrt(b.p), 2))) AS m FROM r3 a JOIN r3 b ON a.ep = b.ep AND b.q = a.q - 1 AND a.l = 1 AND b.l = 1 AND a.u = 1 AND b.u = 1 AND a.f = b.f AND a.e = b.e GROUP BY ALL),
ju AS MATERIALIZED (SELECT ep, q, avg(m) AS jump FROM jp GROUP BY ALL),
th AS MATERIALIZED (SELECT mt.ep, mt.q, mt.ref, bk.f, bk.e, bk.p, (sum(bk.p) OVER w - bk.p) / (count(*) OVER w - 1) AS others, avg(bk.p) OVER w AS mean FROM mt JOIN bk ON bk.ep = mt.ref AND bk.q = mt.pos AND bk.l = 0 AND bk.u = 1 WINDOW w AS (PARTITION BY mt.ep, mt.q, bk.f, bk.e)),
lf AS (SELECT ep, q, ref, f, sqrt(0.5 * sum(power(sqrt(p) - sqrt(others), 2))) AS m FROM th GROUP BY ALL),
lb AS (SELECT ep, q, max(m) AS bound FROM (SELECT ep, q, ref, avg(m) AS m FROM lf GROUP BY ALL) GROUP BY ALL),
of AS (SELECT a.ep, a.q, a.f, sqrt(0.5 * sum(power(sqrt(a.p) - sqrt(t.mean), 2))) AS m FROM r3 a JOIN (SELECT DISTINCT ep, q, f, e, mean FROM th) t ON a.ep = t.ep AND a.q = t.q AND a.f = t.f AND a.e = t.e AND a.l = 0 AND a.u = 1 GROUP BY ALL),
oa AS (SELECT ep, q, avg(m) AS action_distance FROM of GROUP BY ALL),
bo AS (SELECT mt.ep, mt.q, avg(here) AS match_distance, max(g.gap) AS gb, max(j.jump) AS jb FROM mt JOIN ga g ON g.ep = mt.ref AND g.q = mt.pos JOIN ju j ON j.ep = mt.ref AND j.q = mt.pos GROUP BY mt.ep, mt.q),
sc AS (SELECT ep, q, match_distance, gap, jump, action_distance, gap / greatest(gb, 1e-12) AS gap_ratio, jump / greatest(jb, 1e-12) AS jump_ratio, action_distance / greatest(bound, 1e-12) AS action_ratio FROM bo JOIN ga USING (ep, q) JOIN ju USING (ep, q) JOIN oa USING (ep, q) JOIN lb USING (ep, q)),
{alarms_sql('gap_ratio > 1 AND jump_ratio > 1 AND action_ratio <= 1', 'sc', ['match_distance', 'gap', 'jump', 'action_distance', 'gap_ratio', 'jump_ratio', 'action_ratio'])}"""


@register("stale_belief_monitor", STALE)
def stale_belief_monitor(spark, d):
    """Rejects steps whose state and back layers have changed while the front actions are still the healthy ones."""
    routes = flat_routes(spark, d)
    rule = X.StaleBelief(bank_of(routes, EPISODES), SHAPE, layer=0)
    return _shown(folds.batch(routes, rule), rule.columns)
