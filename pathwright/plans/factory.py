"""Queries of the generator and of the exact optima."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import instances as I
from ..operators import optima as O
from ..registry import query
from ..sources import instance_source
from ..sources.fixtures import table, view

# ---- the generator, in SQL by ranking rows where the operator sorts arrays

_TEMPLATES = list(I.POOLS)
_SEEDS = "SELECT c_custkey AS seed, {t}[1 + CAST({d} AS INT)] AS template_name FROM customer".format(t=str(_TEMPLATES), d=I.draw_sql("c_custkey", str(I.TEMPLATE), 0, len(_TEMPLATES) - 1))
_CASE = lambda values: "CASE template_name " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in values.items()) + " END"
_SIZED = f"SELECT *, CASE template_name {' '.join(f'''WHEN '{t}' THEN {I.draw_sql('seed', str(I.SIZE), *b)}''' for t, b in I.SIZES.items())} END AS n, {I.draw_sql('seed', str(I.RESOURCE_COUNT), 2, 3)} AS m FROM ({_SEEDS})"
_PLACES = f"SELECT seed, template_name, n, m, unnest(range(n)) AS i FROM ({_SIZED})"
_FACTS = " UNION ALL ".join(f"SELECT seed, template_name, '{f}' AS field, i, 0 AS j, {I.draw_sql('seed', f'{I.FACT + 8 * k} + i', *b)} AS value FROM ({_PLACES}) WHERE template_name = '{t}'" for t, per in I.FACTS.items() for k, (f, b) in enumerate(per.items()))
_GRID = f"SELECT seed, template_name, n, m, i AS j, unnest(range(CASE WHEN template_name = 'resource_allocation' THEN m ELSE n END)) AS i FROM ({_PLACES}) WHERE template_name IN ('resource_allocation', 'assignment', 'tsp')"
_CELLS = f"""SELECT seed, template_name, 'cell' AS field, i, j, CASE template_name WHEN 'resource_allocation' THEN {I.draw_sql('seed', f'{I.CELL} + i * 8 + j', *I.CELLS['resource_allocation'])} WHEN 'assignment' THEN {I.draw_sql('seed', f'{I.CELL} + i * 8 + j', *I.CELLS['assignment'])}
  ELSE CASE WHEN i = j THEN 0 ELSE {I.draw_sql('seed', f'{I.CELL} + least(i, j) * 8 + greatest(i, j)', *I.CELLS['tsp'])} END END AS value FROM ({_GRID})"""
_SUMS = f"""SELECT seed, template_name, i, sum(value) AS total FROM ({_CELLS}) WHERE template_name = 'resource_allocation' GROUP BY ALL UNION ALL SELECT seed, template_name, 0, sum(value) FROM ({_FACTS}) WHERE field = 'weight' GROUP BY ALL
  UNION ALL SELECT a.seed, a.template_name, 0, sum(a.value * b.value) FROM ({_FACTS}) AS a JOIN ({_FACTS}) AS b ON a.seed = b.seed AND a.i = b.i AND a.field = 'max_units' AND b.field = 'labor_hours' GROUP BY ALL"""
_LIMITS = f"SELECT seed, template_name, 'limit' AS field, i, 0 AS j, CAST(floor(total * CASE template_name {' '.join(f'''WHEN '{t}' THEN {I.draw_sql('seed', f'{I.LIMIT} + i', *b)}''' for t, b in I.LIMITS.items())} END / 1000) AS BIGINT) AS value FROM ({_SUMS})"
INSTANCES = f"SELECT seed, template_name, field, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(value AS BIGINT) AS value FROM ({_FACTS} UNION ALL {_CELLS} UNION ALL {_LIMITS})"
_POOL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {k}, '{x}')" for t, pool in I.POOLS.items() for k, x in enumerate(pool)) + ") AS p(template_name, k, name)"
NAMES = f"""SELECT seed, template_name, string_agg(name, '|' ORDER BY d, k) AS names FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY d, k) AS place FROM
  (SELECT seed, template_name, n, k, name, {I.draw_sql('seed', f'{I.NAME} + k', 0, 524287)} AS d FROM ({_SIZED}) JOIN ({_POOL}) USING (template_name))) WHERE place <= n GROUP BY seed, template_name"""


def _made(s, d):
    return I.instances(table(s, d, "customer").select(F.col("c_custkey").alias("seed")))


@query(INSTANCES)
def gen_instances(s, d):
    return I.long(_made(s, d)).select("seed", "template_name", "field", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "value")


@query(INSTANCES)
def source_instances(s, d):
    """The same rows from the source that plans its own partitions, for the seeds between the customers' least and greatest key."""
    instance_source.register(s)
    seeds = table(s, d, "customer").select(F.col("c_custkey").alias("seed")).where("seed IS NOT NULL")
    low, high = seeds.agg(F.min("seed"), F.max("seed")).first()
    made = s.read.format(instance_source.NAME).options(start=low or 0, end=-1 if high is None else high + 1, partitions=s.sparkContext.defaultParallelism).load()
    return made.join(seeds, "seed", "left_semi").select("seed", "template_name", "field", "i", "j", "value")


@query(NAMES)
def gen_names(s, d):
    return _made(s, d).select("seed", "template_name", F.array_join("names", "|").alias("names"))


# ---- questions, in SQL by aggregating rows where the operator zips arrays

_NAMED = f"""SELECT seed, template_name, row_number() OVER (PARTITION BY seed ORDER BY d, k) - 1 AS i, name FROM (SELECT seed, template_name, k, name, {I.draw_sql('seed', f'{I.NAME} + k', 0, 524287)} AS d FROM ({_SIZED}) JOIN ({_POOL}) USING (template_name))"""
_LIST = lambda names: "(VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(names)) + ") AS p(k, name)"
_OTHERS = f"""SELECT seed, k AS i, name FROM ({_SEEDS}), {_LIST(I.RESOURCES)} WHERE template_name = 'resource_allocation'
  UNION ALL SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY d, k) - 1, name FROM (SELECT seed, k, name, {I.draw_sql('seed', f'{I.TASK} + k', 0, 524287)} AS d FROM ({_SEEDS}), {_LIST(I.TASKS)} WHERE template_name = 'assignment')"""
_FACT = lambda f: f"max(CASE WHEN field = '{f}' THEN value END)"
_SCENARIO = "CASE template_name " + " ".join(f"WHEN '{t}' THEN {names}[1 + CAST({I.draw_sql('seed', str(I.SCENARIO), 0, len(names) - 1)} AS INT)]" for t, names in I.SCENARIOS.items()) + " END"
QUESTIONS = f"""WITH made AS ({INSTANCES}), nm AS ({_NAMED}), ot AS ({_OTHERS}), lim AS (SELECT seed, i, value FROM made WHERE field = 'limit'),
  facts AS (SELECT seed, nm.template_name, i, name, {", ".join(f"{_FACT(f)} AS {f}" for per in I.FACTS.values() for f in per)} FROM nm JOIN made USING (seed, i) WHERE field NOT IN ('cell', 'limit') GROUP BY ALL),
  fact_lines AS (SELECT seed, string_agg(CASE template_name WHEN 'resource_allocation' THEN concat('- ', name, ': profit ', profit) WHEN 'production_planning' THEN concat('- ', name, ': margin ', margin, ', setup ', setup_cost, ', hours ', labor_hours, ', at most ', max_units) ELSE concat('- ', name, ': value ', value, ', weight ', weight) END, '\n' ORDER BY i) AS t FROM facts GROUP BY seed),
  cell AS (SELECT made.seed, made.i, string_agg(concat(coalesce(o.name, n.name), ' ', value), ', ' ORDER BY j) AS t FROM made LEFT JOIN ot AS o ON made.template_name = 'assignment' AND o.seed = made.seed AND o.i = j LEFT JOIN nm AS n ON made.template_name <> 'assignment' AND n.seed = made.seed AND n.i = j WHERE field = 'cell' GROUP BY ALL),
  cell_lines AS (SELECT cell.seed, string_agg(concat('- ', coalesce(o.name, n.name), CASE WHEN lim.value IS NULL THEN ': ' ELSE concat(': ', lim.value, ' in all; one unit takes ') END, cell.t), '\n' ORDER BY cell.i) AS t FROM cell JOIN ({_SEEDS}) AS sd ON sd.seed = cell.seed LEFT JOIN ot AS o ON sd.template_name = 'resource_allocation' AND o.seed = cell.seed AND o.i = cell.i LEFT JOIN nm AS n ON sd.template_name <> 'resource_allocation' AND n.seed = cell.seed AND n.i = cell.i LEFT JOIN lim ON lim.seed = cell.seed AND lim.i = cell.i GROUP BY ALL)
  SELECT seed, template_name, concat('Setting: ', {_SCENARIO}, '\n', CASE template_name WHEN 'resource_allocation' THEN concat('How much of each product gives the largest profit?\n', f.t, '\n', c.t) WHEN 'production_planning' THEN concat('Which products should be made, and how many units, for the largest net profit within ', lim.value, ' hours?\n', f.t)
    WHEN 'assignment' THEN concat('Give each worker one task and each task one worker at the least cost.\n', c.t) WHEN 'knapsack' THEN concat('Which items give the most value within a weight of ', lim.value, '?\n', f.t) ELSE concat('What is the shortest round trip through all cities?\n', c.t) END) AS question
  FROM ({_SEEDS}) LEFT JOIN fact_lines AS f USING (seed) LEFT JOIN cell_lines AS c USING (seed) LEFT JOIN (SELECT seed, value FROM lim WHERE i = 0) AS lim USING (seed)"""


@query(QUESTIONS)
def render_question(s, d):
    """The question of every generated instance."""
    return I.questions(_made(s, d)).select("seed", "template_name", "question")


@query()
def gen_solved(s, d):
    """The exact optimum of every generated instance; compared with brute force in the tests."""
    return O.solve(_made(s, d))


# ---- optima


@query("""WITH w AS (SELECT problem_id, max(total_hours) AS h, {}
  FROM prod_params GROUP BY problem_id)
  SELECT problem_id, CAST(max(m0 * a + m1 * b + m2 * c - CASE WHEN a > 0 THEN s0 ELSE 0 END - CASE WHEN b > 0 THEN s1 ELSE 0 END - CASE WHEN c > 0 THEN s2 ELSE 0 END + greatest(0, m3 * least(x3, (h - l0 * a - l1 * b - l2 * c) // l3) - s3)) AS BIGINT) AS optimum
  FROM w, (SELECT unnest(range(21)) AS a), (SELECT unnest(range(21)) AS b), (SELECT unnest(range(21)) AS c) WHERE a <= x0 AND b <= x1 AND c <= x2 AND l0 * a + l1 * b + l2 * c <= h GROUP BY problem_id""".format(", ".join(f"coalesce(max(CASE WHEN pos = {p} THEN {f} END), {e}) AS {n}{p}" for p in range(4) for n, f, e in (("m", "margin", 0), ("s", "setup", 0), ("x", "max_units", 0), ("l", "labor", 1)))), "prod_params")
def opt_production(s, d):
    return O.production(view(s, d, "prod_params")).select("problem_id", "optimum")


_DET = lambda x, y, z: f"({x[0]} * ({y[1]} * {z[2]} - {z[1]} * {y[2]}) - {y[0]} * ({x[1]} * {z[2]} - {z[1]} * {x[2]}) + {z[0]} * ({x[1]} * {y[2]} - {y[1]} * {x[2]}))"
_X, _Y, _Z, _R = (tuple(f"{t}.{f}" for f in "abc") for t in ("x", "y", "z", "r"))


@query(f"""WITH r AS (SELECT problem_id, max(cap0) AS a, max(cap1) AS b, max(cap2) AS c FROM lp_params GROUP BY problem_id),
  cols AS (SELECT problem_id, pos AS j, u0 AS a, u1 AS b, u2 AS c, profit AS p FROM lp_params UNION ALL SELECT problem_id, 100 + k, CAST(k = 0 AS BIGINT), CAST(k = 1 AS BIGINT), CAST(k = 2 AS BIGINT), 0 FROM r, (SELECT unnest([0, 1, 2]) AS k)),
  tried AS (SELECT x.problem_id, x.p AS p0, y.p AS p1, z.p AS p2, {_DET(_X, _Y, _Z)} AS d, {_DET(_R, _Y, _Z)} AS dx, {_DET(_X, _R, _Z)} AS dy, {_DET(_X, _Y, _R)} AS dz FROM cols AS x JOIN cols AS y ON x.problem_id = y.problem_id AND x.j < y.j JOIN cols AS z ON y.problem_id = z.problem_id AND y.j < z.j JOIN r ON x.problem_id = r.problem_id)
  SELECT problem_id, max(CAST(dx * p0 + dy * p1 + dz * p2 AS DOUBLE) / CAST(d AS DOUBLE)) AS optimum FROM tried WHERE d <> 0 AND dx * d >= 0 AND dy * d >= 0 AND dz * d >= 0 GROUP BY problem_id""", "lp_params")
def opt_lp(s, d):
    lp = view(s, d, "lp_params").withColumns({"uses": F.array("u0", "u1", "u2"), "caps": F.array("cap0", "cap1", "cap2")})
    return O.linear(lp).select("problem_id", "optimum")


# ---- larger shapes

#: Two products under three to five limits, with uses and limits below zero too, so that some problems have no plan and some no end.
LP_GENERAL = "SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS problem_id, CAST(p_partkey % 2 AS INT) AS pos, CAST((p_size * 3 + p_partkey) % 31 - 5 AS BIGINT) AS profit, {} FROM part".format(
    ", ".join(f"CAST(CASE WHEN floor(p_partkey / 2) % 3 + 3 > {k} THEN (p_partkey * {7 + 4 * k} + p_size * {k + 1}) % 9 - 2 END AS BIGINT) AS u{k}, CAST((floor(p_partkey / 2) * {11 + 6 * k} + {k}) % 61 - 6 AS BIGINT) AS c{k}" for k in range(5))
)


@query(f"""WITH part2 AS ({LP_GENERAL}), wide AS (SELECT problem_id, max(CASE WHEN pos = 0 THEN profit END) AS p, max(CASE WHEN pos = 1 THEN profit END) AS q,
    {", ".join(f"max(CASE WHEN pos = 0 THEN u{k} END) AS a{k}, max(CASE WHEN pos = 1 THEN u{k} END) AS b{k}, max(c{k}) AS c{k}" for k in range(5))} FROM part2 GROUP BY problem_id HAVING count(*) = 2),
  line AS (SELECT problem_id, -1 AS a, 0 AS b, 0 AS c, -2 AS k FROM wide UNION ALL SELECT problem_id, 0, -1, 0, -1 FROM wide {" ".join(f"UNION ALL SELECT problem_id, a{k}, b{k}, c{k}, {k} FROM wide WHERE a{k} IS NOT NULL" for k in range(5))}),
  corner AS (SELECT x.problem_id, (x.a * y.b - y.a * x.b) AS d, (x.c * y.b - y.c * x.b) AS dx, (x.a * y.c - y.a * x.c) AS dy FROM line AS x JOIN line AS y ON x.problem_id = y.problem_id AND x.k < y.k WHERE x.a * y.b <> y.a * x.b),
  good AS (SELECT corner.problem_id, d, dx, dy FROM corner JOIN line USING (problem_id) GROUP BY ALL HAVING bool_and((a * dx + b * dy - c * d) * sign(d) <= 0)),
  ray AS (SELECT problem_id, s * b AS dx, -s * a AS dy FROM line, (SELECT unnest([1, -1]) AS s)),
  away AS (SELECT DISTINCT r.problem_id FROM (SELECT ray.problem_id, dx, dy FROM ray JOIN line USING (problem_id) GROUP BY ALL HAVING bool_and(a * dx + b * dy <= 0)) AS r JOIN wide USING (problem_id) WHERE p * dx + q * dy > 0),
  top AS (SELECT wide.problem_id, max(CAST(p * dx + q * dy AS DOUBLE) / CAST(d AS DOUBLE)) AS optimum FROM good JOIN wide USING (problem_id) GROUP BY wide.problem_id)
  SELECT wide.problem_id, CASE WHEN top.problem_id IS NULL THEN 'INFEASIBLE' WHEN away.problem_id IS NULL THEN 'OPTIMAL' ELSE 'UNBOUNDED' END AS status, CASE WHEN away.problem_id IS NULL THEN optimum + 0.0 END AS optimum
  FROM wide LEFT JOIN top USING (problem_id) LEFT JOIN away ON away.problem_id = wide.problem_id""")
def opt_lp_general(s, d):
    """Limits of either sign: plans, no plan, and no end."""
    rows = s.sql(LP_GENERAL.replace("FROM part", "FROM {part}"), part=table(s, d, "part"))
    own = rows.select("problem_id", "pos", "profit", F.array_compact(F.array(*[f"u{k}" for k in range(5)])).alias("uses"), F.array(*[f"c{k}" for k in range(5)]).alias("caps"))
    whole = own.withColumn("caps", F.slice("caps", F.lit(1), F.size("uses")))
    pairs = whole.groupBy("problem_id").agg(F.count("*").alias("n")).where("n = 2").select("problem_id")
    return O.linear(whole.join(pairs, "problem_id")).select("problem_id", "status", "optimum")


GRID = "8 + (p_partkey * 7 + w * 13 + t * 17 + w * t * 5 + w * w * t * 3) % 41"


@query(f"""WITH RECURSIVE c AS (SELECT p_partkey AS problem_id, 2 + p_partkey % 5 AS n, w, t, {GRID} AS cost FROM part, (SELECT unnest(range(6)) AS w), (SELECT unnest(range(6)) AS t) WHERE w < 2 + p_partkey % 5 AND t < 2 + p_partkey % 5),
  best AS (SELECT problem_id, t, 1 AS k, CAST(1 << CAST(t AS INT) AS BIGINT) AS seen, cost FROM c WHERE w = 0
    UNION ALL SELECT problem_id, NULL, k + 1, seen | (1 << CAST(c.t AS INT)), min(best.cost + c.cost) FROM best JOIN c USING (problem_id) WHERE c.w = best.k AND seen & (1 << CAST(c.t AS INT)) = 0 GROUP BY problem_id, k + 1, seen | (1 << CAST(c.t AS INT)))
  SELECT problem_id, CAST(min(cost) AS BIGINT) AS optimum FROM best WHERE k = 2 + problem_id % 5 GROUP BY problem_id""")
def opt_matching(s, d):
    """Two to six workers."""
    part = table(s, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("bigint"), 1 + F.col("p_partkey") % 5)).alias("w"))
    grid = part.select("p_partkey", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), 1 + F.col("p_partkey") % 5)).alias("t"))
    return O.assignment(grid.select(F.col("p_partkey").alias("problem_id"), "w", "t", F.expr(GRID).alias("cost"))).select("problem_id", "optimum")


_CITIES = "SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS problem_id, p_partkey % 10 AS c, p_size FROM {part} WHERE p_partkey % 10 < 5 + floor(p_partkey / 10) % 6"
_ARCS = "SELECT a.problem_id, a.c AS i, b.c AS j, 12 + (least(a.c, b.c) * 31 + greatest(a.c, b.c) * 17 + a.p_size * b.p_size) % 49 AS dist FROM city AS a JOIN city AS b ON a.problem_id = b.problem_id AND a.c <> b.c"


@query(f"""WITH RECURSIVE city AS ({_CITIES.format(part="part")}), size AS (SELECT problem_id, count(*) AS n FROM city GROUP BY problem_id HAVING min(c) = 0 AND max(c) = count(*) - 1), arc AS ({_ARCS}),
  path AS (SELECT problem_id, 1 AS k, j AS at, 1 << CAST(j AS INT) AS seen, dist FROM arc WHERE i = 0
    UNION ALL SELECT problem_id, k + 1, arc.j, seen | (1 << CAST(arc.j AS INT)), min(path.dist + arc.dist) FROM path JOIN arc USING (problem_id) WHERE arc.i = path.at AND arc.j > 0 AND seen & (1 << CAST(arc.j AS INT)) = 0 GROUP BY problem_id, k + 1, arc.j, seen | (1 << CAST(arc.j AS INT)))
  SELECT problem_id, CAST(min(path.dist + arc.dist) AS BIGINT) AS optimum FROM path JOIN size USING (problem_id) JOIN arc USING (problem_id) WHERE k = n - 1 AND arc.i = path.at AND arc.j = 0 GROUP BY problem_id""")
def opt_tour(s, d):
    """Five to ten cities; a problem whose cities are not all there is left out."""
    city = s.sql(_CITIES, part=table(s, d, "part"))
    whole = city.groupBy("problem_id").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n")).where("a = 0 AND b = n - 1 AND n > 1").select("problem_id")
    own = city.join(whole, "problem_id")
    return O.tour(s.sql(_ARCS.replace("city AS", "{city} AS"), city=own)).select("problem_id", "optimum")


_TWELVE = "SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS problem_id, p_partkey % 12 AS pos, CAST(18 + p_size % 19 AS BIGINT) AS margin, CAST(45 + (p_partkey * 7) % 66 AS BIGINT) AS setup, CAST(3 + p_size % 7 AS BIGINT) AS max_units, CAST(2 + p_partkey % 5 AS BIGINT) AS labor, CAST(60 + floor(p_partkey / 12) % 41 AS BIGINT) AS total_hours FROM {part}"


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY pos) AS k FROM ({_TWELVE.format(part="part")})), units AS (SELECT unnest(range(10)) AS q),
  state AS (SELECT problem_id, CAST(0 AS BIGINT) AS k, max(total_hours) AS room, CAST(0 AS HUGEINT) AS v FROM p GROUP BY problem_id
    UNION ALL SELECT state.problem_id, state.k + 1, room - q * labor, max(v + q * margin - CASE WHEN q > 0 THEN setup ELSE 0 END) FROM state JOIN p ON p.problem_id = state.problem_id AND p.k = state.k + 1 JOIN units ON q <= max_units AND q * labor <= room GROUP BY state.problem_id, state.k + 1, room - q * labor)
  SELECT problem_id, CAST(max(v) AS BIGINT) AS optimum FROM state GROUP BY problem_id""")
def opt_plan(s, d):
    """Twelve products a problem, each with a setup."""
    return O.production(s.sql(_TWELVE, part=table(s, d, "part"))).select("problem_id", "optimum")
