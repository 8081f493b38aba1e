"""DuckDB SQL of the registered searches: naive Bayes on the embeddings, from sums, and each round of the seeds' state.

The rounds of a search depend on each other's outcome, so each is a group of common table expressions that reads the
state before it. Rows with vec_id divisible by 3 test, all others train.
"""

from __future__ import annotations

from siftlake import schemas as S


def _draw(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || '-' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 7) AS INTEGER)"


def _drop(values: str, place: str) -> str:
    """Without the place from 0."""
    return f"list_concat({values}[1:{place}], {values}[{place} + 2:])"


#: Density of each test row's feature under each class, and the prior of each class.
BAYES = """
long AS (SELECT vec_id, 'c' || CAST(label AS VARCHAR) AS class, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS f FROM embeddings),
kinds AS (SELECT class, row_number() OVER (ORDER BY class <> 'c0', class) - 1 AS y FROM (SELECT DISTINCT class FROM long)),
learned AS (SELECT y, f, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM long JOIN kinds USING (class) WHERE vec_id % 3 <> 0 GROUP BY y, f),
floor AS (SELECT 1e-9 * greatest(max(s), 1e-9) + 1e-12 AS e FROM (SELECT var_pop(v) AS s FROM long WHERE vec_id % 3 <> 0 GROUP BY f)),
priors AS (SELECT y, ln(n / sum(n) OVER ()) AS p FROM learned WHERE f = 1),
dens AS (SELECT vec_id, t.f, y, -0.5 * (ln(2 * pi() * (s + e)) + (v - m) ** 2 / (s + e)) AS l FROM long t JOIN learned USING (f), floor WHERE vec_id % 3 = 0)"""


def _evaluated(name: str, candidates: str) -> str:
    """Common table expressions that end in name: the candidates with tp, tn, fp, fn and f1."""
    return f"""
{name}_sets AS (SELECT DISTINCT list_sort(list_distinct(features)) AS own FROM {candidates}),
{name}_sums AS (SELECT own, vec_id, d.y, sum(l) + any_value(p) AS t FROM (SELECT own, unnest(own) AS f FROM {name}_sets) JOIN dens d USING (f) JOIN priors USING (y) GROUP BY own, vec_id, d.y),
{name}_best AS (SELECT own, vec_id, first(y ORDER BY t DESC, y) AS guess FROM {name}_sums GROUP BY own, vec_id),
{name}_counts AS (
  SELECT own, count(*) FILTER (guess = y AND guess <> 0) AS tp, count(*) FILTER (guess = y AND guess = 0) AS tn, count(*) FILTER (guess <> y AND guess <> 0) AS fp, count(*) FILTER (guess <> y AND guess = 0) AS fn
  FROM {name}_best JOIN (SELECT DISTINCT vec_id, y FROM long JOIN kinds USING (class)) USING (vec_id) GROUP BY own),
{name} AS (SELECT c.*, tp, tn, fp, fn, CASE WHEN tp > 0 THEN 200.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM {candidates} c JOIN {name}_counts ON own = list_sort(list_distinct(features)))"""


def _candidates(k: int, before: str, search: str, steps: int) -> tuple[str, str]:
    """(Common table expressions, a SELECT of seed_id, step and features) of a search in round k."""
    if search == "BIT_FLIP":
        take, give = f"({_draw(repr('in'), 'seed_id', str(k), 'step + 1')} % len(r))", f"({_draw(repr('out'), 'seed_id', str(k), 'step + 1')} % len(f))"
        walk = f"""
walk{k} AS (
  SELECT seed_id, 0 AS step, features AS f, rcl AS r FROM {before} UNION ALL
  SELECT seed_id, step + 1, list_append({_drop('f', give)}, r[{take} + 1]), list_append({_drop('r', take)}, f[{give} + 1]) FROM walk{k} WHERE step < {steps} AND len(r) > 0)"""
        return walk, f"SELECT seed_id, step, f AS features FROM walk{k} WHERE step > 0"
    grown = f"""
{search.lower()}{k} AS (SELECT seed_id, j, list_concat(features, rcl[1:j]) AS g FROM (SELECT *, unnest(range(1, least({steps}, len(rcl)) + 1)) AS j FROM {before}))"""
    if search == "IWSS":
        return grown, f"SELECT seed_id, CAST(j AS INTEGER) AS step, g AS features FROM iwss{k}"
    drops = f"SELECT seed_id, j, 0 AS d, g AS features FROM iwssr{k} UNION ALL SELECT seed_id, j, d, {_drop('g', '(d - 1)')} FROM (SELECT *, unnest(range(1, len(g) + 1)) AS d FROM iwssr{k} WHERE len(g) > 1)"
    return grown, f"SELECT seed_id, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY j, d) AS INTEGER) AS step, features FROM ({drops})"


def search_sql(width: int, generations: int, sample: int, seed: int, searches: list[str], strategy: str, steps: dict[str, int]) -> str:
    """All evaluated steps of a search with naive Bayes in one cycle, as the registered queries return them."""
    start = f"""
drawn AS (SELECT 'seed-{seed}-' || CAST(g AS VARCHAR) AS seed_id, f FROM (SELECT unnest(range({generations})) AS g), (SELECT unnest(range(1, {width + 1})) AS f)),
placed AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY {_draw(repr('sample'), 'seed_id', 'f')}, f) AS k FROM drawn),
starts AS (SELECT seed_id, list(f ORDER BY k) FILTER (k <= {sample}) AS features, list(f ORDER BY f) FILTER (k > {sample}) AS rcl FROM placed GROUP BY seed_id)"""
    parts = [BAYES, start, _evaluated("s0", "starts")]
    shown = ["SELECT seed_id, 0 AS iteration, '" + S.INITIAL + "' AS topic, '' AS local_search, 0 AS step, features, tp, tn, fp, fn, f1, f1 AS best_f1 FROM s0"]
    rounds = len(searches) if strategy == "VND" else 1
    for k in range(1, rounds + 1):
        before, ways = f"s{k - 1}", searches
        if strategy == "VND":
            ways = [searches[k - 1]]
            parts.append(f"\nb{k} AS (SELECT *, '{ways[0]}' AS search FROM {before})")
        else:
            parts.append(f"\nb{k} AS (SELECT *, {searches!r}[{_draw(repr('next'), repr(str(seed)), 'seed_id', str(k))} % {len(searches)} + 1] AS search FROM {before})")
        own = []
        for search in ways:
            parts.append(f"\nb{k}_{search} AS (SELECT * FROM b{k} WHERE search = '{search}')")
            made, chosen = _candidates(k, f"b{k}_{search}", search, steps[search])
            parts.append(made)
            own.append(f"SELECT *, '{search}' AS search FROM ({chosen})")
        parts.append(f"\nc{k} AS ({' UNION ALL '.join(own)})")
        parts.append(_evaluated(f"e{k}", f"c{k}"))
        parts.append(f"""
o{k} AS (SELECT seed_id, first(struct_pack(features := features, f1 := f1, tp := tp, tn := tn, fp := fp, fn := fn) ORDER BY f1 DESC, step) AS b FROM e{k} GROUP BY seed_id),
a{k} AS (SELECT p.*, coalesce(b.f1, p.f1) AS found_f1, coalesce(b.features, p.features) AS found, b FROM b{k} p LEFT JOIN o{k} USING (seed_id)),
s{k} AS (
  SELECT seed_id, CASE WHEN found_f1 > f1 THEN found ELSE features END AS features, CASE WHEN found_f1 > f1 THEN list_filter(range(1, {width + 1}), lambda x: NOT list_contains(found, x)) ELSE rcl END AS rcl, greatest(f1, found_f1) AS f1 FROM a{k})""")
        shown.append(f"SELECT e.seed_id, {k}, '{S.PROGRESS}', e.search, e.step, e.features, e.tp, e.tn, e.fp, e.fn, e.f1, p.f1 FROM e{k} e JOIN b{k} p USING (seed_id)")
        shown.append(f"SELECT seed_id, {k}, '{S.SOLUTIONS}', search, 0, found, b.tp, b.tn, b.fp, b.fn, found_f1, greatest(f1, found_f1) FROM a{k}")
    return (
        "WITH RECURSIVE " + ",".join(parts) + " SELECT seed_id, iteration, topic, local_search, step, array_to_string(features, ',') AS features, tp, tn, fp, fn, round(f1, 6) AS f1, round(best_f1, 6) AS best_f1 FROM ("
        + " UNION ALL ".join(shown) + ")"
    )
