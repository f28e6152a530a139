"""DuckDB SQL for the registered queries, over whole tables."""

from __future__ import annotations

from labeltext.fixed_values import (
    ANSWER_TOPICS,
    LINE_WHITESPACE,
    NEWS_CLASSES,
    STOP_WORDS,
    TERM_PATTERN,
    WORD_STEPS,
)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_of(text: str, spaced: str | None = None) -> str:
    """Cased words of a text, as a list; ``spaced`` is the text after the first step."""
    spaced = spaced_of(text) if spaced is None else spaced
    for _, pattern, replacement in WORD_STEPS[1:]:
        spaced = (
            f"regexp_replace({spaced}, {literal(pattern)}, "
            f"{literal(replacement.replace('$', chr(92)))}, 'g')"
        )
    split = f"list_filter(regexp_split_to_array({spaced}, ' +'), lambda w: w <> '')"
    return f"flatten(list_transform({split}, lambda w: string_split(w, '\\')))"


def spaced_of(text: str) -> str:
    _, pattern, replacement = WORD_STEPS[0]
    return f"regexp_replace((' ' || {text} || ' '), {literal(pattern)}, {literal(replacement)}, 'g')"


def lower_of(words: str) -> str:
    return f"list_transform({words}, lambda w: lower(w))"


def line_of(text: str) -> str:
    spaces = " || ".join(f"chr({ord(c)})" for c in LINE_WHITESPACE)
    return f"replace(trim({text}, {spaces}), chr(10), ' ')"


NEWS = """news AS (
  SELECT doc_id, text, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS label,
         CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM documents)"""

WORDS = f"""{NEWS},
cased AS MATERIALIZED (SELECT doc_id, label, split, {words_of('text')} AS cased FROM news),
words AS MATERIALIZED (
  SELECT doc_id, label, split, cased, {lower_of('cased[1:30]')} AS words FROM cased),
positions AS (
  SELECT doc_id, label, split, unnest(words) AS word, generate_subscripts(words, 1) AS nth FROM words)"""


def lift_ctes(scope: str = "", ids: bool = False) -> str:
    """Class lift; ``scope`` is '' or 'split, '. With ids, words count by vocabulary id."""
    key = "token_id" if ids else "word"
    over = "PARTITION BY split" if scope else ""
    lookup = "LEFT JOIN vocab ON token = word" if ids else ""
    chosen = "coalesce(token_id, 1)" if ids else "word"
    return f"""firsts AS (
  SELECT doc_id, label, split, word, min(nth) AS nth, any_value({chosen}) AS key
  FROM positions {lookup} GROUP BY doc_id, label, split, word),
held AS (SELECT DISTINCT {scope}doc_id, label, key FROM firsts),
sizes AS (
  SELECT {scope}label, count(*) AS n_c, sum(count(*)) OVER ({over}) AS n
  FROM words GROUP BY {scope}label),
counts AS (
  SELECT {scope}label, key, count(*) AS n_wc,
         sum(count(*)) OVER (PARTITION BY {scope}key) AS n_w
  FROM held GROUP BY {scope}label, key),
lift AS (
  SELECT {scope}label, key, n_w, n_wc::DOUBLE / n_c::DOUBLE AS tf, n::DOUBLE / n_w::DOUBLE AS idf,
         (n_wc::DOUBLE / n_c::DOUBLE) * (n::DOUBLE / n_w::DOUBLE) AS score
  FROM counts JOIN sizes USING ({scope}label)),
ranked AS (
  SELECT doc_id, label, split, word, score,
         row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nth) AS rank
  FROM firsts JOIN lift USING ({scope}label, key)),
picked AS (
  SELECT doc_id,
         list(word ORDER BY rank) FILTER (score > 1.000009 OR rank = 1) AS keywords,
         list(word ORDER BY rank) FILTER (score > 1.000009) AS above
  FROM ranked GROUP BY doc_id)"""


def with_lift(scope: str = "") -> str:
    return f"WITH {WORDS}, {lift_ctes(scope)}"


EDGES = "'^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$'"
HAS_STOP = "regexp_matches({}, '[\\p{{L}}\\p{{N}}]\\.([^\\p{{L}}\\p{{N}}.][^\\p{{L}}\\p{{N}}]*)?$')"
# Words of all texts with what stands before and after them; abbreviations and openers
# after Kiss and Strunk (2006).
SENTENCES = f"""pieces AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex({spaced_of('text')}, ' +'), lambda p: p <> '') AS p FROM documents),
places AS MATERIALIZED (
  SELECT doc_id, i, piece, core, lower(core) AS type, {HAS_STOP.format('piece')} AS stop,
         lag(piece) OVER w AS before, lag(core) OVER w AS core_before, lead(core) OVER w AS core_after,
         regexp_matches(core, '^\\p{{Lu}}') AS capital
  FROM (SELECT doc_id, i, piece, regexp_replace(piece, {EDGES}, '', 'g') AS core
        FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM pieces))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
stops AS (
  SELECT type, count(*) FILTER (stop) AS n_stop, count(*) FILTER (NOT stop) AS n_plain
  FROM places WHERE type <> '' GROUP BY type),
stop_share AS (SELECT sum(n_stop)::DOUBLE / sum(n_stop + n_plain)::DOUBLE AS p FROM stops),
scored AS (
  SELECT type, n_stop, n_plain, length(replace(type, '.', ''))::DOUBLE AS letters, length(type) - letters + 1 AS inner_stops,
         -2 * (n_stop * ln(p) + CASE WHEN n_plain > 0 THEN n_plain * ln(1 - p) ELSE 0 END
               - n_stop * ln(0.99::DOUBLE) - n_plain * ln(1 - 0.99::DOUBLE))
           * exp(-letters) * inner_stops * pow(letters, -n_plain) AS score
  FROM stops, stop_share WHERE n_stop > 0 AND regexp_matches(type, '^\\p{{L}}+(\\.\\p{{L}}+)*$')),
short AS MATERIALIZED (SELECT type, n_stop, n_plain, score FROM scored WHERE score >= 0.3),
short_list AS (SELECT coalesce(list(type), []) AS l FROM short),
told AS MATERIALIZED (
  SELECT places.*, stop AND list_contains(l, type) AS is_short,
         coalesce({HAS_STOP.format('before')}, false) AS stop_before,
         stop_before AND coalesce(list_contains(l, lower(core_before)), false) AS after_short,
         NOT after_short AND (before IS NULL OR stop_before
           OR regexp_matches(before, '([!?]|\\.\\.|…)[^\\p{{L}}\\p{{N}}]*$')) AS start
  FROM places, short_list),
follow AS (
  SELECT type, count(*)::DOUBLE AS n, count(*) FILTER (start)::DOUBLE AS s,
         count(*) FILTER (regexp_matches(core, '^\\p{{Ll}}')) AS n_lower,
         count(*) FILTER (capital AND NOT start AND NOT after_short) AS n_inside,
         count(*) FILTER (capital AND after_short) AS n_after_short
  FROM told WHERE type <> '' GROUP BY type),
all_words AS (SELECT sum(n) AS t, sum(s) AS b FROM follow),
starters AS (
  SELECT type, n_after_short, n_lower, n_inside, n / t AS p, s / nullif(b, 0) AS p1, (n - s) / nullif(t - b, 0) AS p2,
         coalesce(2 * (
           CASE WHEN s > 0 THEN s * ln(p1 / p) ELSE 0 END
           + CASE WHEN b > s THEN (b - s) * ln((1 - p1) / (1 - p)) ELSE 0 END
           + CASE WHEN n > s THEN (n - s) * ln(p2 / p) ELSE 0 END
           + CASE WHEN t - b > n - s THEN (t - b - n + s) * ln((1 - p2) / (1 - p)) ELSE 0 END), 0) AS starter
  FROM follow, all_words WHERE n_after_short > 0),
openers AS MATERIALIZED (
  SELECT type, n_after_short, starter FROM starters
  WHERE (n_lower > 0 AND n_inside = 0) OR (starter >= 30 AND coalesce(p1 > p, false))),
marked AS (
  SELECT doc_id, ' ' || string_agg(CASE
      WHEN is_short AND core_after IS NOT NULL
        AND NOT (regexp_matches(core_after, '^\\p{{Lu}}') AND lower(core_after) IN (SELECT type FROM openers))
      THEN regexp_replace(piece, '\\.([^\\p{{L}}\\p{{N}}.]*)$', chr(31) || '\\1') ELSE piece END, '  ' ORDER BY i) || ' ' AS spaced
  FROM told GROUP BY doc_id)"""

VOCAB = f"""listed AS (
  SELECT DISTINCT unnest({lower_of(words_of('text'))}) AS token FROM benchmark),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY token) + 2 AS INT) AS token_id FROM listed
  UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('<mask>', 2)))"""

KEYWORDS = "coalesce(array_to_string(keywords, ' | '), '<mask>')"

MASKED = """coalesce(nullif(array_to_string(list_transform(
    list_filter(cased, lambda w: w IN (',', '.') OR list_contains(coalesce(keywords, []), lower(w))),
    lambda w, i: CASE WHEN i > 1 AND w IN (',', '.') THEN '<mask>' || w ELSE '<mask> ' || w END
  ), ' '), ''), '<mask>')"""

CLASS_NAME = "[" + ", ".join(literal(c) for c in NEWS_CLASSES) + "][label + 1]"

PAIRS = """pairs AS (
  SELECT u.conv_id * 1000000 + u.turn AS id, u.text AS sentence1, a.text AS sentence2,
         CAST(u.conv_id % 2 AS INT) AS label,
         CASE u.conv_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

NEAREST = """points AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings),
dims AS (
  SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) AS d FROM points),
centers AS (SELECT label AS cluster, d, avg(x) AS c FROM dims GROUP BY label, d),
nearest AS (
  SELECT id, label, features, cluster FROM (
    SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS r
    FROM (SELECT id, cluster, sum((x - c) * (x - c)) AS dist
          FROM dims JOIN centers USING (d) GROUP BY id, cluster))
  JOIN points USING (id) WHERE r = 1)"""

LABELINGS = """labelings AS (
  SELECT n.doc_id, n.label AS a, CAST(quality * 2 + toxic AS INT) AS b
  FROM news n JOIN labels USING (doc_id))"""

SCORED = """scored AS (
  SELECT doc_id AS id, source, p, y,
         CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS hit,
         -(y * greatest(CASE WHEN p > 0 THEN ln(p) ELSE -100 END, -100)
           + (1 - y) * greatest(CASE WHEN p < 1 THEN ln(1 - p) ELSE -100 END, -100)) AS loss
  FROM (SELECT doc_id, source, 1.0 / (1.0 + exp(-(n_chars - 1000) / 1000.0)) AS p,
               quality::DOUBLE AS y
        FROM documents JOIN labels USING (doc_id)))"""

_STOPS = ", ".join(literal(w) for w in STOP_WORDS)
WEIGHTS = f"""{NEWS},
terms AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), {literal(TERM_PATTERN)})) AS term FROM news),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term NOT IN ({_STOPS}) GROUP BY ALL),
df AS (
  SELECT term, count(*) AS df, (SELECT count(*) FROM news) AS n FROM tf GROUP BY term
  HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM news)),
raw AS (
  SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term)),
weights AS (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def _pair_corr(i: int, j: int) -> str:
    x, y = f"(a = {i})::INT::DOUBLE", f"(b = {j})::INT::DOUBLE"
    return (
        f"SELECT 'a_{i}' AS key1, 'b_{j}' AS key2, "
        f"round((avg({x} * {y}) - avg({x}) * avg({y})) / "
        f"nullif(stddev_pop({x}) * stddev_pop({y}), 0), 9) AS corr FROM labelings"
    )


def _prompted(source: str, target: str, table: str, split: bool = True) -> str:
    columns = "id, split" if split else "id"
    return f"SELECT {columns}, {line_of(source)} AS source, {line_of(target)} AS target FROM {table}"


ENTROPIES = """n AS (SELECT sum(n) AS t FROM cells),
rows_ AS (SELECT label, sum(n) AS m FROM cells GROUP BY label),
cols AS (SELECT cluster, sum(n) AS m FROM cells GROUP BY cluster),
h AS (
  SELECT (SELECT -sum(m / t * ln(m / t)) FROM rows_, n) AS h_label,
         (SELECT -sum(m / t * ln(m / t)) FROM cols, n) AS h_cluster,
         (SELECT sum(c.n / t * ln(c.n * t / (r.m * k.m)))
          FROM cells c JOIN rows_ r USING (label) JOIN cols k USING (cluster), n) AS mi,
         (SELECT sum(n * (n - 1) / 2) FROM cells) AS p_cells,
         (SELECT sum(m * (m - 1) / 2) FROM rows_) AS p_rows,
         (SELECT sum(m * (m - 1) / 2) FROM cols) AS p_cols,
         (SELECT t * (t - 1) / 2 FROM n) AS p_all),
hc AS (
  SELECT *, CASE WHEN h_label = 0 THEN 1.0 ELSE mi / h_label END AS hom,
         CASE WHEN h_cluster = 0 THEN 1.0 ELSE mi / h_cluster END AS com FROM h)"""

def _lloyd(rounds: int) -> str:
    """Assignments after so many Lloyd steps from the labels' means."""
    steps = ["""points AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings),
dims AS (SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) AS d FROM points),
centers0 AS (SELECT label AS cluster, d, avg(x) AS c FROM dims GROUP BY label, d)"""]
    for i in range(rounds):
        steps.append(f"""near{i} AS (
  SELECT id, cluster FROM (
    SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS r
    FROM (SELECT id, cluster, sum((x - c) * (x - c)) AS dist FROM dims JOIN centers{i} USING (d) GROUP BY id, cluster))
  WHERE r = 1),
centers{i + 1} AS (SELECT cluster, d, avg(x) AS c FROM dims JOIN near{i} USING (id) GROUP BY cluster, d)""")
    last = f"nearest AS (SELECT id, label, cluster FROM points JOIN near{rounds - 1} USING (id))"
    return ",\n".join([*steps, last])


def _five_runs(passes: int = 4) -> str:
    """Five runs of so many Lloyd passes, and the clusters they end in; a cluster without
    rows keeps its center."""
    steps = ["""points AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings),
dims AS (SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) AS d FROM points),
centers0 AS (SELECT CAST(id % 5 AS INT) AS run, label AS cluster, d, avg(x) AS c FROM dims GROUP BY ALL)"""]
    for i in range(passes + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT run, id, arg_min(cluster, (dist, cluster)) AS cluster
  FROM (SELECT run, id, cluster, sum((x - c) * (x - c)) AS dist FROM dims JOIN centers{i} USING (d) GROUP BY ALL)
  GROUP BY run, id)""")
        steps.append(f"""centers{i + 1} AS MATERIALIZED (
  SELECT run, cluster, d, coalesce(m.c, o.c) AS c FROM centers{i} o LEFT JOIN (
    SELECT run, cluster, d, avg(x) AS c FROM near{i} JOIN dims USING (id) GROUP BY ALL) m USING (run, cluster, d))""")
    return ",\n".join(steps[:-1])


PART_SUPPLIER = """cells AS (SELECT l_partkey AS i, l_suppkey AS j, count(*)::DOUBLE AS xy FROM lineitem GROUP BY ALL),
lefts AS (SELECT i, sum(xy) AS x FROM cells GROUP BY i),
rights AS (SELECT j, sum(xy) AS y FROM cells GROUP BY j),
t AS (SELECT sum(xy) AS t FROM cells)"""
SPLIT3 = "CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"
# The given network: 64 inputs, 5 rectified units, 1 sigmoid.
NETWORK = """points AS (SELECT vec_id AS id, (label % 2)::DOUBLE AS y, CAST(embedding AS DOUBLE[]) AS f FROM embeddings),
hidden AS (SELECT u::INT AS u, 0.1::DOUBLE * (u - 2) AS b, ((u % 3) - 1) / 2.0::DOUBLE AS v FROM range(5) r(u)),
inputs AS (SELECT id, y, unnest(f) AS x, (generate_subscripts(f, 1) - 1)::INT AS i FROM points),
sums AS (
  SELECT id, y, u, v, b + sum(x * ((7 * u + 3 * i) % 11 - 5) / 20.0::DOUBLE) AS z FROM inputs, hidden GROUP BY id, y, u, v, b),
units AS (SELECT id, y, u, v, greatest(z, 0) AS a FROM sums),
scores AS (SELECT id, y, 1 / (1 + exp(-(0.05::DOUBLE + sum(v * a)))) AS p FROM units GROUP BY id, y)"""
CLASS_MEANS = """sizes AS (SELECT label, count(*) AS n FROM news GROUP BY label),
centroids AS (
  SELECT label AS cluster, term, round(sum(weight) / any_value(n), 9) AS weight
  FROM weights JOIN news USING (doc_id) JOIN sizes USING (label) GROUP BY label, term)"""

ORACLES: dict[str, str] = {
    "lsa_vectors": f"""WITH {WEIGHTS}
        SELECT doc_id, CAST(doc_id IN (SELECT doc_id FROM weights) AS INT)::DOUBLE AS square FROM news""",
    "lsa_components": f"""WITH {WEIGHTS}, t AS (SELECT count(DISTINCT term) AS n FROM weights)
        SELECT CAST(i AS INT) AS i, 1.0::DOUBLE AS square, true AS within
        FROM t, range(100) r(i) WHERE i < greatest(1, least(100, n - 1))""",
    "normal_products": f"""WITH {WEIGHTS},
        v AS (SELECT DISTINCT term, length(term)::DOUBLE AS a, ascii(term) / 128.0::DOUBLE AS b FROM weights),
        image AS (SELECT doc_id, sum(weight * a) AS y0, sum(weight * b) AS y1, sum(weight) AS y2
                  FROM weights JOIN v USING (term) GROUP BY doc_id)
        SELECT term, round(sum(weight * y0), 9) AS p0, round(sum(weight * y1), 9) AS p1, round(sum(weight * y2), 9) AS p2
        FROM weights JOIN image USING (doc_id) GROUP BY term""",
    "lsa_cross_products": f"""WITH {WEIGHTS},
        squares AS (SELECT term, sum(weight * weight) AS s FROM weights GROUP BY term),
        dims AS (SELECT greatest(1, least(100, count(*) - 1)) AS n FROM squares),
        single AS (SELECT round(sum(s), 6) AS s FROM (
          SELECT s, row_number() OVER (ORDER BY s DESC) AS r FROM squares), dims WHERE r <= n)
        SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS product,
               s AS single_terms, true AS holds
        FROM range(100) a(i), range(100) b(j), dims, single WHERE i < n AND j <= i""",
    "kmeans_clusters": "SELECT doc_id, true AS known_cluster FROM documents",
    "lloyd_clusters": f"WITH {_lloyd(3)} SELECT id, label, cluster FROM nearest",
    "lloyd_scores": f"""WITH {_lloyd(3)},
        cells AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM nearest GROUP BY ALL), {ENTROPIES}
        SELECT round(hom, 9) AS homogeneity, round(com, 9) AS completeness,
               round(CASE WHEN hom + com = 0 THEN 0.0 ELSE 2 * hom * com / (hom + com) END, 9) AS v_measure,
               round((p_cells - p_rows * p_cols / p_all)
                     / ((p_rows + p_cols) / 2 - p_rows * p_cols / p_all), 9) AS adjusted_rand
        FROM hc""",
    "lloyd_runs": f"WITH {_five_runs()} SELECT run, id, cluster FROM near4",
    "lloyd_run_centers": f"WITH {_five_runs()} SELECT run, cluster, CAST(d - 1 AS INT) AS dim, round(c, 9) AS value FROM centers4",
    "lloyd_run_scores": f"""WITH {_five_runs()},
        cells AS (SELECT run, label, cluster, count(*)::DOUBLE AS n FROM near4 JOIN points USING (id) GROUP BY ALL),
        t AS (SELECT run, sum(n) AS t FROM cells GROUP BY run),
        r AS (SELECT run, label, sum(n) AS m FROM cells GROUP BY ALL),
        k AS (SELECT run, cluster, sum(n) AS m FROM cells GROUP BY ALL),
        h AS (
          SELECT run, (SELECT -sum(m / t.t * ln(m / t.t)) FROM r WHERE r.run = t.run) AS hl,
                 (SELECT -sum(m / t.t * ln(m / t.t)) FROM k WHERE k.run = t.run) AS hc,
                 (SELECT sum(c.n / t.t * ln(c.n * t.t / (r.m * k.m))) FROM cells c JOIN r USING (run, label)
                  JOIN k USING (run, cluster) WHERE c.run = t.run) AS mi,
                 (SELECT sum(n * (n - 1) / 2) FROM cells c WHERE c.run = t.run) AS pc,
                 (SELECT sum(m * (m - 1) / 2) FROM r WHERE r.run = t.run) AS pr,
                 (SELECT sum(m * (m - 1) / 2) FROM k WHERE k.run = t.run) AS pk, t.t * (t.t - 1) / 2 AS pa
          FROM t),
        s AS (SELECT id, features FROM points ORDER BY md5(id || '-0'), id LIMIT 2000),
        apart AS (
          SELECT p.id AS p, q.id AS q, sqrt(list_sum(list_transform(list_zip(p.features, q.features),
                   lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM s p CROSS JOIN s q),
        sums AS (
          SELECT a.run, p, a.cluster AS own, b.cluster AS other, count(*) AS n, sum(dist) AS total
          FROM apart JOIN near4 a ON a.id = p JOIN near4 b ON b.id = q AND b.run = a.run GROUP BY ALL),
        ab AS (
          SELECT run, p, any_value(CASE WHEN own = other THEN n END) AS n_own,
                 any_value(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
                 min(CASE WHEN own <> other THEN total / n END) AS b
          FROM sums GROUP BY ALL)
        SELECT run, unnest(['homogeneity', 'completeness', 'v_measure', 'adjusted_rand']) AS metric,
               round(unnest([mi / hl, mi / hc, 2 * (mi / hl) * (mi / hc) / (mi / hl + mi / hc),
                             (pc - pr * pk / pa) / ((pr + pk) / 2 - pr * pk / pa)]), 9) AS value FROM h
        UNION ALL
        SELECT run, 'silhouette', round(avg(CASE WHEN n_own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 9)
        FROM ab GROUP BY run""",
    "kmeans_runs": """SELECT unnest(['homogeneity', 'completeness', 'v_measure', 'adjusted_rand', 'silhouette']) AS metric,
        true AS sound""",
    "cluster_terms": """SELECT CAST(c AS INT) AS cluster, CAST(r AS INT) AS rank
        FROM range(4) a(c), range(1, 11) b(r)""",
    "centroid_terms": f"""WITH {WEIGHTS}, {CLASS_MEANS},
        coordinates(cluster, component, x) AS (VALUES (0, 0, 1.0), (0, 2, 0.5), (1, 0, 0.25), (1, 1, 0.75)),
        back AS (
          SELECT o.cluster, term, round(sum(weight * x::DOUBLE), 9) AS weight
          FROM centroids c JOIN coordinates o ON o.component = c.cluster GROUP BY o.cluster, term)
        SELECT cluster, CAST(rank AS INT) AS rank, term, weight FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank
          FROM back) WHERE rank <= 10""",
    "classifier_scores": f"""SELECT doc_id, {SPLIT3} AS split, quality::DOUBLE AS y, true AS sound
        FROM documents JOIN labels USING (doc_id)""",
    "classifier_best": f"""SELECT {SPLIT3} AS split, count(*) AS n_rows, true AS sound
        FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "forward_scores": f"WITH {NETWORK} SELECT id, round(p, 9) AS p, y, (p > 0.5)::INT::DOUBLE AS predicted FROM scores",
    "network_gradients": f"""WITH {NETWORK},
        errors AS (SELECT id, u, a, p - s.y AS e, CASE WHEN a > 0 THEN (p - s.y) * v ELSE 0 END AS back
                   FROM scores s JOIN units USING (id))
        SELECT 0 AS layer, u AS unit, i AS input, round(avg(back * x), 9) AS gradient
        FROM errors JOIN inputs USING (id) GROUP BY u, i
        UNION ALL SELECT 0, u, -1, round(avg(back), 9) FROM errors GROUP BY u
        UNION ALL SELECT 1, 0, u, round(avg(e * a), 9) FROM errors GROUP BY u
        UNION ALL SELECT 1, 0, -1, round(avg(p - y), 9) FROM scores""",
    "best_epoch": """WITH l AS (
          SELECT CAST(floor(o_orderkey / 500) AS INT) AS epoch, round(avg(o_totalprice::DOUBLE), 2) AS val_loss
          FROM orders GROUP BY 1),
        m AS (SELECT *, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM l),
        n AS (SELECT *, max(CASE WHEN least IS NULL OR val_loss < least THEN epoch END) OVER (ORDER BY epoch) AS lowered FROM m)
        SELECT epoch, val_loss, epoch - lowered >= 3 AS stop,
               epoch = (SELECT arg_min(epoch, (val_loss, epoch)) FROM l) AS best FROM n""",
    "network_floor": "SELECT vec_id % 5 AS fifth, count(*) AS n_rows, true AS better FROM embeddings GROUP BY 1",
    "vocab_listing": f"WITH {VOCAB} SELECT row_number() OVER (ORDER BY token_id) - 1 AS place, token FROM vocab",
    "required_values": "SELECT doc_id, source FROM documents",
    "inverted_names": """SELECT n_regionkey AS relation, arg_max(n_name, n_nationkey) AS name
        FROM nation GROUP BY n_regionkey""",
    "all_valid_lines": """WITH lines AS (
          SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM documents)
        SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line_number, unnest(l) AS line FROM lines""",
    "fanned_splits": f"""WITH {NEWS} SELECT doc_id, label, unnest(CASE split WHEN 'test' THEN ['val', 'test'] ELSE [split] END)
        AS split FROM news""",
    "class_keywords": f"""{with_lift()}
        SELECT doc_id, label, coalesce(array_to_string(keywords, ' | '), '') AS keywords
        FROM words LEFT JOIN picked USING (doc_id)""",
    "text_label": f"WITH {NEWS} SELECT doc_id, text, label FROM news",
    "split_choice": f"""WITH {NEWS}
        SELECT split, label, count(*) AS n_docs FROM news GROUP BY split, label
        UNION ALL SELECT 'all', label, count(*) FROM news GROUP BY label""",
    "label_counts": f"""WITH {NEWS}
        SELECT label, count(*) AS n_docs FROM news GROUP BY GROUPING SETS ((label), ())""",
    "token_set": f"WITH {WORDS} SELECT DISTINCT word FROM positions",
    "token_doc_freq": f"""WITH {WORDS}
        SELECT word, label, count(DISTINCT doc_id) AS n_docs
        FROM positions GROUP BY GROUPING SETS ((word, label), (word))""",
    "class_doc_freq": f"{with_lift()} SELECT label, key AS word, tf FROM lift",
    "inverse_doc_ratio": f"""{with_lift()}
        SELECT DISTINCT key AS word, CAST(n_w AS BIGINT) AS n_total, idf FROM lift""",
    "class_lift": f"{with_lift()} SELECT label, key AS word, score FROM lift",
    "ranked_words": f"{with_lift()} SELECT doc_id, label, CAST(rank AS INT) AS rank, word, score FROM ranked",
    "word_records": f"""{with_lift()},
        short AS (
          SELECT label, count(*) AS n_c, count(*) FILTER (len(words) < 30) AS n_pc,
                 sum(count(*)) OVER () AS n, sum(count(*) FILTER (len(words) < 30)) OVER () AS n_p
          FROM words GROUP BY label),
        sorted AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY rank) AS sorted_words FROM ranked GROUP BY doc_id),
        raw AS (
          SELECT doc_id, label, CAST(nth - 1 AS INT) AS pos, score AS raw_score
          FROM positions p JOIN lift USING (label) WHERE lift.key = p.word
          UNION ALL
          SELECT doc_id, label, CAST(unnest(range(len(words), 30)) AS INT),
                 (n_pc::DOUBLE / n_c::DOUBLE) * (n::DOUBLE / n_p::DOUBLE)
          FROM words JOIN short USING (label))
        SELECT doc_id, label, coalesce(sorted_words, '') AS sorted_words, pos, raw_score
        FROM raw LEFT JOIN sorted USING (doc_id)""",
    "keyword_line": f"""{with_lift()}
        SELECT doc_id, label, {KEYWORDS} AS line FROM words LEFT JOIN picked USING (doc_id)""",
    "mask_line": f"""{with_lift()}
        SELECT doc_id, label, {MASKED} AS line FROM words LEFT JOIN picked USING (doc_id)""",
    "complement_text": f"""{with_lift()}
        SELECT doc_id, label, coalesce(array_to_string(list_filter(cased,
                 lambda w: NOT list_contains(coalesce(above, []), lower(w))), ' '), '') AS line
        FROM words LEFT JOIN picked USING (doc_id)""",
    "style_rows": f"""{with_lift('split, ')}
        SELECT w.doc_id AS id, {CLASS_NAME.replace('label', 'w.label')} AS label_name, out AS split,
               {MASKED} AS source, n.text AS target
        FROM words w LEFT JOIN picked USING (doc_id) JOIN news n USING (doc_id)
        JOIN (VALUES ('train', 'train'), ('test', 'val'), ('test', 'test')) f(name, out)
          ON f.name = w.split""",
    "pair_lines": f"""{with_lift('split, ')}
        SELECT w.doc_id AS id, {CLASS_NAME.replace('label', 'w.label')} AS label_name, out AS split,
               {line_of(KEYWORDS)} || ' @separator@ ' || {line_of('n.text')} AS line
        FROM words w LEFT JOIN picked USING (doc_id) JOIN news n USING (doc_id)
        JOIN (VALUES ('train', 'train'), ('test', 'val'), ('test', 'test')) f(name, out)
          ON f.name = w.split""",
    "tokens_cased": f"""SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, array_to_string(w, ' ') AS tokens
        FROM (SELECT doc_id, {words_of('text')} AS w FROM documents)""",
    "abbreviations": f"WITH {SENTENCES} SELECT type, n_stop, n_plain, round(score, 9) AS score FROM short",
    "sentence_openers": f"WITH {SENTENCES} SELECT type, n_after_short, round(starter, 9) AS starter FROM openers",
    "sentence_tokens": f"""WITH {SENTENCES}
        SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, replace(array_to_string(w, ' '), chr(31), '.') AS tokens
        FROM (SELECT doc_id, {words_of('', "coalesce(spaced, '  ')")} AS w FROM documents LEFT JOIN marked USING (doc_id))""",
    "tokens_lower": f"""SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, array_to_string(w, ' ') AS tokens
        FROM (SELECT doc_id, {lower_of(words_of('text'))} AS w FROM documents)""",
    "clean_lines": f"SELECT doc_id, {line_of('text')} AS line FROM documents",
    "vocab_table": f"WITH {VOCAB} SELECT token, token_id FROM vocab",
    "encode_padded": f"""WITH {WORDS}, {VOCAB},
        ids AS (
          SELECT doc_id, list(coalesce(token_id, 1) ORDER BY nth) AS ids
          FROM positions LEFT JOIN vocab ON token = word GROUP BY doc_id)
        SELECT doc_id, 30 AS n_ids, array_to_string(
                 (coalesce(ids, []) || list_transform(range(30), lambda i: 0))[1:30], ' ') AS ids
        FROM words LEFT JOIN ids USING (doc_id)""",
    "max_token_len": f"SELECT CAST(max(len({words_of('text')})) AS INT) AS max_len FROM documents",
    "vocab_class_lift": f"""WITH {WORDS}, {VOCAB}, {lift_ctes(ids=True)},
        short AS (
          SELECT label, count(*) AS n_c, count(*) FILTER (len(words) < 30) AS n_pc,
                 sum(count(*)) OVER () AS n, sum(count(*) FILTER (len(words) < 30)) OVER () AS n_p
          FROM words GROUP BY label)
        SELECT label, CAST(key AS INT) AS token_id, score FROM lift
        UNION ALL
        SELECT label, 0, (n_pc::DOUBLE / n_c::DOUBLE) * (n::DOUBLE / n_p::DOUBLE)
        FROM short WHERE n_pc > 0""",
    "vocab_keywords": f"""WITH {WORDS}, {VOCAB}, {lift_ctes(ids=True)}
        SELECT doc_id, label, {KEYWORDS} AS line FROM words LEFT JOIN picked USING (doc_id)""",
    "nli_pairs_0": f"WITH {PAIRS} "
    + _prompted("sentence1 || ' Is it true that ' || sentence2 || ' ?'", "label::VARCHAR", "pairs"),
    "nli_pairs_1": f"WITH {PAIRS} "
    + _prompted("sentence1 || ' @separater@ ' || sentence2", "label::VARCHAR", "pairs"),
    "classification_pairs": f"""WITH {NEWS},
        rated AS (SELECT doc_id AS id, split, text, quality FROM news JOIN labels USING (doc_id)) """
    + _prompted("text", "quality::VARCHAR", "rated"),
    "summary_pairs": f"WITH {NEWS}, s AS (SELECT doc_id AS id, split, text FROM news) "
    + _prompted("text", "split_part(text, chr(10), 1)", "s"),
    "relation_pairs": f"""WITH r AS (
          SELECT c_custkey AS id, c_name, n_name,
                 CASE WHEN n_regionkey < 3 THEN 'buyer' ELSE 'customer' END AS name
          FROM customer JOIN nation ON c_nationkey = n_nationkey) """
    + _prompted(
        "c_name || ' of ' || n_name || ' <mask> is <mask> of <mask>'",
        "c_name || ' is ' || name || ' of ' || n_name",
        "r",
        split=False,
    ),
    "topic_lines": f"""WITH {NEWS}
        SELECT doc_id AS id, split,
               [{", ".join(literal(t) for t in ANSWER_TOPICS)}][doc_id % 10 + 1] AS topic_name,
               {line_of('text')} AS line FROM news""",
    "split_renamed": f"""WITH {PAIRS}
        SELECT id, label, CASE split WHEN 'validation' THEN 'val' ELSE split END AS split FROM pairs""",
    "one_hot": f"""WITH {NEWS} SELECT doc_id, """
    + ", ".join(f"CASE WHEN label = {k} THEN 1 ELSE 0 END AS label_{k}" for k in range(4))
    + " FROM news",
    "label_correlation": f"WITH {NEWS}, {LABELINGS} "
    + " UNION ALL ".join(_pair_corr(i, j) for i in range(4) for j in range(4)),
    "sparse_one_hot": """WITH n AS (
          SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS index, count(*) OVER () AS size
          FROM (SELECT DISTINCT l_partkey FROM lineitem))
        SELECT l_orderkey, l_linenumber, index, size FROM lineitem JOIN n USING (l_partkey)""",
    "sparse_correlation": f"""WITH {PART_SUPPLIER}
        SELECT i, j, round((t * xy - x * y) / sqrt((t * x - x * x) * (t * y - y * y)), 9) AS corr
        FROM cells JOIN lefts USING (i) JOIN rights USING (j), t""",
    "asked_correlation": f"""WITH {PART_SUPPLIER},
        pairs AS (SELECT p_partkey AS i, p_partkey % 12 AS j FROM part)
        SELECT i, j, round((t * coalesce(xy, 0) - x * y) / sqrt((t * x - x * x) * (t * y - y * y)), 9) AS corr
        FROM pairs LEFT JOIN lefts USING (i) LEFT JOIN rights USING (j) LEFT JOIN cells USING (i, j), t""",
    "relabel": "SELECT doc_id, text, toxic AS label FROM documents JOIN labels USING (doc_id)",
    "nearest_centroid": f"WITH {NEAREST} SELECT id, label, cluster FROM nearest",
    "contingency": f"WITH {NEAREST} SELECT label, cluster, count(*) AS n FROM nearest GROUP BY ALL",
    "cluster_scores": f"""WITH {NEAREST},
        cells AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM nearest GROUP BY ALL), {ENTROPIES}
        SELECT round(hom, 9) AS homogeneity, round(com, 9) AS completeness,
               round(CASE WHEN hom + com = 0 THEN 0.0 ELSE 2 * hom * com / (hom + com) END, 9) AS v_measure,
               round((p_cells - p_rows * p_cols / p_all)
                     / ((p_rows + p_cols) / 2 - p_rows * p_cols / p_all), 9) AS adjusted_rand
        FROM hc""",
    "silhouette": f"""WITH {NEAREST},
        s AS (SELECT id, cluster, features FROM nearest ORDER BY md5(id || '-0'), id LIMIT 2000),
        d AS (
          SELECT p.id, p.cluster AS own, q.cluster AS other, count(*) AS n,
                 sum(sqrt(list_sum(list_transform(list_zip(p.features, q.features),
                   lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS total
          FROM s p CROSS JOIN s q GROUP BY ALL),
        ab AS (
          SELECT id, any_value(CASE WHEN own = other THEN n END) AS n_own,
                 any_value(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
                 min(CASE WHEN own <> other THEN total / n END) AS b
          FROM d GROUP BY id)
        SELECT round(avg(CASE WHEN n_own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette
        FROM ab""",
    "metric_mean_std": f"""WITH {SCORED},
        runs AS (SELECT source, avg(loss) AS bce, avg(hit) AS accuracy FROM scored GROUP BY source)
        SELECT 'bce' AS metric, round(avg(bce), 9) AS mean_value, round(stddev_pop(bce), 9) AS std_value
        FROM runs
        UNION ALL
        SELECT 'accuracy', round(avg(accuracy), 9), round(stddev_pop(accuracy), 9) FROM runs""",
    "tfidf_weights": f"WITH {WEIGHTS} SELECT doc_id, term, round(weight, 9) AS weight FROM weights",
    "cluster_top_terms": f"""WITH {WEIGHTS},
        sizes AS (SELECT label, count(*) AS n FROM news GROUP BY label),
        centroids AS (
          SELECT label AS cluster, term, round(sum(weight) / any_value(n), 9) AS weight
          FROM weights JOIN news USING (doc_id) JOIN sizes USING (label) GROUP BY label, term)
        SELECT cluster, CAST(rank AS INT) AS rank, term, weight FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank
          FROM centroids) WHERE rank <= 10""",
    "bce_accuracy": f"""WITH {SCORED}
        SELECT count(*) AS n_rows, round(avg(loss), 9) AS bce, round(avg(hit), 9) AS accuracy FROM scored""",
    "batch_mean_loss": f"""WITH {SCORED},
        batches AS (
          SELECT batch, avg(loss) AS loss
          FROM (SELECT loss, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM scored)
          GROUP BY batch)
        SELECT count(*) AS n_batches, round(avg(loss), 9) AS epoch_loss FROM batches""",
}

ORACLES["complement_corpus"] = ORACLES["complement_text"]
ORACLES["complement_bucketed"] = ORACLES["complement_text"]
ORACLES["style_rows_bucketed"] = ORACLES["style_rows"]
