"""SQL fragments that say the same as ``frames``; they are joined with commas after WITH."""

from __future__ import annotations

ONE = "CAST(1 AS DOUBLE)"


def r6(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + CAST(0 AS DOUBLE))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


CELLS = f"""cells AS (
  SELECT vec_id AS point_id, label AS class, CAST(i - 1 AS INTEGER) AS dim,
         CAST(embedding[i] AS DOUBLE) AS x,
         least({ONE}, 5 * abs(CAST(embedding[i] AS DOUBLE))) AS w
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"""

NOISE = """noise AS (
  SELECT dim, coalesce(avg(CASE WHEN w <> 1 THEN x END), 0) AS nu,
         coalesce(var_pop(CASE WHEN w <> 1 THEN x END), 0) AS sigma2,
         count(CASE WHEN w <> 1 THEN 1 END) AS n_masked
  FROM cells GROUP BY dim)"""

EXPECTED = """expected AS (
  SELECT point_id, class, dim, w, y, z - y * y AS corr FROM (
    SELECT c.point_id, c.class, c.dim, c.w, w * x + (1 - w) * nu AS y,
           w * x * x + (1 - w) * (nu * nu + sigma2) AS z
    FROM cells c JOIN noise n ON c.dim = n.dim) s)"""

PREPARED = (CELLS, NOISE, EXPECTED)

MASKS = """masks AS (
  SELECT point_id, class, string_agg(CASE WHEN w = 1 THEN '1' ELSE '0' END, '' ORDER BY dim) AS mask
  FROM cells GROUP BY point_id, class)"""

DIMS = "dims AS (SELECT point_id, class, sum(w) AS q FROM cells GROUP BY point_id, class)"

# One M-step on the given classes with diagonal covariances.
WEIGHTS = """weights AS (
  SELECT class, n, ln((n + 1) / (total + 1 + (alive - 1))) AS log_weight FROM (
    SELECT label AS class, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY label) a,
    (SELECT CAST(count(*) AS DOUBLE) AS total,
            count(DISTINCT CASE WHEN label <> 0 THEN label END) + 1 AS alive FROM embeddings) b)"""

DIAGONAL = """diagonal AS (
  SELECT e.class, e.dim, avg(y) AS mean, (sum(corr) + max(sigma2)) / count(*) AS variance
  FROM expected e JOIN noise n ON e.dim = n.dim GROUP BY e.class, e.dim)"""

SCORES = """scores AS (
  SELECT e.point_id, e.class AS old_class, d.class AS cluster_id,
         sum((y - mean) * (y - mean) / variance) AS mahalanobis, sum(corr / variance) AS variance_term,
         (sum((y - mean) * (y - mean) / variance) + sum(corr / variance)) / 2 + sum(ln(variance)) / 2
           - max(log_weight) + count(*) * ln(2 * pi()) / 2 AS nlp
  FROM expected e JOIN diagonal d ON e.dim = d.dim JOIN weights g ON g.class = d.class
  WHERE d.class <> 0 GROUP BY e.point_id, e.class, d.class
  UNION ALL
  SELECT vec_id, label, 0, 0, 0, -log_weight FROM embeddings, weights WHERE weights.class = 0)"""

ASSIGNED = """assigned AS (
  SELECT s.point_id, s.old_class, max(CASE WHEN place = 1 THEN cluster_id END) AS class,
         max(CASE WHEN place = 2 THEN cluster_id END) AS class2,
         max(CASE WHEN place = 1 THEN nlp END) AS nlp, max(CASE WHEN place = 2 THEN nlp END) AS nlp2,
         max(q) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY nlp, cluster_id) AS place FROM scores) s
  JOIN dims ON dims.point_id = s.point_id
  WHERE place <= 2 GROUP BY s.point_id, s.old_class)"""

SUMMARY = """summary AS (
  SELECT class, count(*) AS n, avg(q * (q + 1) / 2 + q + 1) AS params, sum(nlp) AS nlp,
         sum(nlp2 - nlp) AS loss, count(CASE WHEN old_class <> class THEN 1 END) AS changed
  FROM assigned GROUP BY class)"""

POINTS = "total AS (SELECT CAST(count(*) AS DOUBLE) AS n_points FROM embeddings)"

CANDIDATE = """candidate AS (
  SELECT class, delta FROM (
    SELECT class, loss - params * ln(n_points) / 2 AS delta FROM summary, total WHERE class <> 0) c
  ORDER BY delta, class LIMIT 1)"""

AFTER = """after AS (
  SELECT point_id, old_class, q,
         CASE WHEN a.class = c.gone THEN class2 ELSE a.class END AS class,
         CASE WHEN a.class = c.gone THEN nlp2 ELSE nlp END AS nlp
  FROM assigned a, (SELECT max(CASE WHEN delta < 0 THEN class ELSE -1 END) AS gone FROM candidate) c)"""

STEP = PREPARED + (DIMS, WEIGHTS, DIAGONAL, SCORES, ASSIGNED)
DELETION = STEP + (SUMMARY, POINTS, CANDIDATE, AFTER)


def lineitem(features: list[str]) -> tuple[str, ...]:
    """Prepared lines and the full covariance model of each class, written out per feature."""
    d = range(len(features))
    pairs = [(i, j) for i in d for j in d if i <= j]
    scaled = ", ".join(
        f"({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ()) AS x{i}" for i, f in enumerate(features)
    )
    masks = ", ".join(f"least({ONE}, 2 * abs(x{i})) AS w{i}" for i in d)
    stats = ", ".join(
        f"coalesce(avg(CASE WHEN w{i} <> 1 THEN x{i} END), 0) AS nu{i}, "
        f"coalesce(var_pop(CASE WHEN w{i} <> 1 THEN x{i} END), 0) AS s{i}" for i in d
    )
    y = ", ".join(f"w{i} * x{i} + (1 - w{i}) * nu{i} AS y{i}" for i in d)
    c = ", ".join(
        f"w{i} * x{i} * x{i} + (1 - w{i}) * (nu{i} * nu{i} + s{i}) "
        f"- (w{i} * x{i} + (1 - w{i}) * nu{i}) * (w{i} * x{i} + (1 - w{i}) * nu{i}) AS c{i}" for i in d
    )
    means = ", ".join(f"avg(y{i}) AS m{i}, sum(c{i}) AS sc{i}" for i in d)
    cov = ", ".join(
        f"(sum((y{i} - m{i}) * (y{j} - m{j}))" + (f" + max(sc{i}) + max(s{i})" if i == j else "") + f") / count(*) AS k{i}{j}"
        for i, j in pairs
    )
    parts = [
        f"scaled AS (SELECT l_linenumber - 1 AS class, {scaled} FROM lineitem)",
        f"masked AS (SELECT *, {masks} FROM scaled)",
        f"lnoise AS (SELECT {stats} FROM masked)",
        "points AS (SELECT class, " + ", ".join(f"w{i}" for i in d) + f", {y}, {c}, " + " + ".join(f"w{i}" for i in d)
        + " AS q FROM masked, lnoise)",
        f"means AS (SELECT class, CAST(count(*) AS DOUBLE) AS n, {means} FROM points GROUP BY class)",
        "cov AS (SELECT p.class, max(n) AS n, " + ", ".join(f"max(m{i}) AS m{i}" for i in d)
        + f", {cov} FROM points p JOIN means ON p.class = means.class, lnoise GROUP BY p.class)",
    ]
    # Cholesky factor, one column at a time; later columns need earlier ones.
    source = "cov"
    for j in d:
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        parts.append(f"pivot{j} AS (SELECT *, sqrt(k{j}{j}{inner}) AS l{j}{j} FROM {source})")
        below = ", ".join(
            f"(k{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} AS l{i}{j}"
            for i in d if i > j
        )
        source = f"pivot{j}"
        if below:
            parts.append(f"column{j} AS (SELECT *, {below} FROM {source})")
            source = f"column{j}"
    # Inverse of the factor, row by row.
    for i in d:
        row = ", ".join(
            f"{ONE} / l{i}{i} AS v{i}{j}" if i == j
            else "-(" + " + ".join(f"l{i}{k} * v{k}{j}" for k in range(j, i)) + f") / l{i}{i} AS v{i}{j}"
            for j in range(i + 1)
        )
        parts.append(f"inverse{i} AS (SELECT *, {row} FROM {source})")
        source = f"inverse{i}"
    inv = ", ".join(" + ".join(f"v{k}{i} * v{k}{i}" for k in d if k >= i) + f" AS p{i}" for i in d)
    logdet = " + ".join(f"ln(l{i}{i})" for i in d)
    parts.append(
        f"model AS (SELECT *, {inv}, {logdet} AS log_root_det, "
        f"(n + 1) / ((SELECT sum(n) FROM means) + 1 + (SELECT count(*) FROM means WHERE class <> 0)) AS weight FROM {source})"
    )
    root = ["(" + " + ".join(f"v{i}{j} * (y{j} - m{j})" for j in range(i + 1)) + ")" for i in d]
    mahal = " + ".join(f"{r} * {r}" for r in root)
    extra = " + ".join(f"c{i} * p{i}" for i in d)
    parts.append("numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS line FROM points)")
    parts.append(
        f"""lscores AS (
  SELECT line, p.class AS old_class, q, model.class AS cluster_id, {mahal} AS mahalanobis, {extra} AS variance_term,
         (({mahal}) + ({extra})) / 2 + log_root_det - ln(weight) + {len(features)} * ln(2 * pi()) / 2 AS nlp
  FROM numbered p, model WHERE model.class <> 0
  UNION ALL
  SELECT line, p.class, q, 0, 0, 0, -ln(weight)
  FROM numbered p, model WHERE model.class = 0)"""
    )
    parts.append(
        """lassigned AS (
  SELECT line, old_class, q, min(nlp) AS nlp, arg_min(cluster_id, nlp) AS class FROM lscores GROUP BY line, old_class, q)"""
    )
    return tuple(parts)


# Iterations written out; labels at the fixed point stay as they are, so more than needed do no harm.
LOOP_STEPS = 12


def loop_log(steps: int) -> str:
    """Metrics of the iterations of ``diagonal_loop``, up to the full step that changes nothing."""
    one = lambda t: f"""SELECT {t} AS iteration, g.gone AS gone,
    (SELECT count(DISTINCT class) FROM labels{t} WHERE class <> 0) + 1 - CASE WHEN g.gone >= 0 THEN 1 ELSE 0 END AS alive,
    (SELECT count(*) FROM best{t} WHERE class = g.gone) AS deleted_points,
    (SELECT count(*) FROM labels{t} a JOIN labels{t + 1} b ON a.point_id = b.point_id WHERE a.class <> b.class) AS changed,
    (SELECT sum(CASE WHEN class = g.gone THEN nlp2 ELSE nlp END) FROM best{t}) AS raw,
    (SELECT sum(params) FROM (SELECT avg(q * (q + 1) / 2 + q + 1) AS params FROM best{t} b JOIN labels{t + 1} l
       ON l.point_id = b.point_id GROUP BY l.class) c) * (SELECT ln(max(n_points)) / 2 FROM total) AS penalty FROM gone{t} g"""  # noqa: E731
    rows = "\n  UNION ALL ".join(one(t) for t in range(steps))
    return f"""log AS MATERIALIZED ({rows}),
  before AS (SELECT *, raw + penalty AS score, lag(changed) OVER w AS changed1, lag(raw + penalty) OVER w AS score1,
    coalesce(lag(raw + penalty, 2) OVER w, 0) AS score2 FROM log WINDOW w AS (ORDER BY iteration)),
  stepped AS (SELECT *, iteration = 0 OR changed1 > 0.05 * (SELECT max(n_points) FROM total) OR changed1 = 0
    OR iteration % 20 = 0 OR score1 > score2 AS full_step FROM before),
  metrics AS (SELECT * FROM stepped WHERE iteration <= (SELECT min(iteration) FROM stepped WHERE changed = 0 AND full_step))"""


def diagonal_loop(steps: int) -> tuple[str, ...]:
    """``steps`` whole iterations from the labels with diagonal covariances; classes end in ``labels{steps}``."""
    parts = [*PREPARED, DIMS, POINTS, "labels0 AS (SELECT vec_id AS point_id, label AS class FROM embeddings)"]
    for t in range(steps):
        parts += [
            f"""points{t} AS MATERIALIZED (
  SELECT l.point_id, l.class, e.dim, y, corr, sigma2 FROM expected e JOIN labels{t} l ON l.point_id = e.point_id
  JOIN noise n ON n.dim = e.dim)""",
            f"""sizes{t} AS (
  SELECT class, CAST(count(*) AS DOUBLE) AS n FROM labels{t} GROUP BY class
  UNION ALL SELECT 0, 0 WHERE NOT EXISTS (SELECT 1 FROM labels{t} WHERE class = 0))""",
            f"""weights{t} AS (
  SELECT class, ln((n + 1) / (n_points + 1 + (SELECT count(*) - 1 FROM sizes{t}))) AS log_weight FROM sizes{t}, total)""",
            f"""diagonal{t} AS (
  SELECT class, dim, avg(y) AS mean, (sum(corr) + max(sigma2)) / count(*) AS variance FROM points{t} GROUP BY class, dim)""",
            f"""scores{t} AS MATERIALIZED (
  SELECT p.point_id, d.class AS cluster_id,
         sum(((y - mean) * (y - mean) + corr) / variance + ln(variance) + ln(2 * pi())) / 2 - max(log_weight) AS nlp
  FROM points{t} p JOIN diagonal{t} d ON d.dim = p.dim JOIN weights{t} g ON g.class = d.class
  WHERE d.class <> 0 GROUP BY p.point_id, d.class
  UNION ALL SELECT point_id, 0, -log_weight FROM labels{t}, weights{t} w WHERE w.class = 0)""",
            f"""best{t} AS MATERIALIZED (
  SELECT s.point_id, max(CASE WHEN place = 1 THEN cluster_id END) AS class, max(CASE WHEN place = 2 THEN cluster_id END) AS class2,
         max(CASE WHEN place = 1 THEN nlp END) AS nlp, max(CASE WHEN place = 2 THEN nlp END) AS nlp2, max(q) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY nlp, cluster_id) AS place FROM scores{t}) s
  JOIN dims ON dims.point_id = s.point_id WHERE place <= 2 GROUP BY s.point_id)""",
            f"""deltas{t} AS (
  SELECT class, sum(nlp2 - nlp) - avg(q * (q + 1) / 2 + q + 1) * ln(max(n_points)) / 2 AS delta
  FROM best{t}, total WHERE class <> 0 GROUP BY class)""",
            f"""gone{t} AS (
  SELECT coalesce(max(class), -1) AS gone FROM (SELECT * FROM deltas{t} ORDER BY delta, class LIMIT 1) c WHERE delta < 0)""",
            f"""labels{t + 1} AS MATERIALIZED (
  SELECT point_id, CASE WHEN class = gone THEN class2 ELSE class END AS class FROM best{t}, gone{t})""",
        ]
    return tuple(parts)
