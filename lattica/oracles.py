"""DuckDB SQL for the graph queries. Iterations are unrolled: rounds past convergence change nothing."""

from __future__ import annotations

from .functions.pids import MIXING_PRIME
from .queries import BLOCK, LOG_NORMAL, PARTS, TRACED
from .sources.fixtures import WHOLE
from .sources.generate import EXTRA, MU, SIGMA

EDGES = {
    "li": "SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS w FROM lineitem",
    "rev": "SELECT l_suppkey AS src, l_partkey AS dst, l_quantity AS w FROM lineitem",
    "ord": "SELECT o_orderkey AS src, o_custkey AS dst, 1.0::DOUBLE AS w FROM orders",
    "sparse": "SELECT o_orderkey AS src, o_custkey AS dst, 1.0::DOUBLE AS w FROM orders WHERE o_orderkey % 5 = 0",
    "ev": "SELECT src, dst, w FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, value AS w FROM events) WHERE dst IS NOT NULL",
}


def _with(name: str, *ctes: str) -> str:
    base = [
        f"e AS MATERIALIZED ({EDGES[name]})",
        "v AS MATERIALIZED (SELECT range AS id FROM range(0, (SELECT max(greatest(src, dst)) + 1 FROM e)))",
        "q AS (SELECT count(*) // 4 AS q FROM v)",
        "marks AS MATERIALIZED (SELECT 1 + k * q AS landmark, k FROM q, range(0, 4) r(k))",
    ]
    return "WITH RECURSIVE " + ",\n".join([*base, *ctes]) + "\n"


def _whole(sql: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, * FROM ({_with(n)}{sql})" for n in WHOLE)


def _sssp(name: str) -> str:
    rec = """d(id, landmark, dist) USING KEY (id, landmark) AS (
      SELECT v.id, m.landmark, 0.0::DOUBLE FROM v JOIN marks m ON v.id = m.landmark
      UNION
      SELECT x.id, x.landmark, x.dist FROM (
        SELECT e.dst AS id, d.landmark, min(d.dist + e.w) AS dist FROM d JOIN e ON e.src = d.id GROUP BY ALL) x
      LEFT JOIN recurring.d o ON o.id = x.id AND o.landmark = x.landmark
      WHERE o.dist IS NULL OR x.dist < o.dist)"""
    return _with(name, rec)


def _cap(name: str, rounds: int) -> str:
    und = "u AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"
    steps = ["c0 AS MATERIALIZED (SELECT id, id AS label FROM v)"]
    for i in range(rounds):
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.id, least(c.label, m.label) AS label FROM c{i} c LEFT JOIN (SELECT u.dst AS id, min(c.label) AS label FROM u JOIN c{i} c ON c.id = u.src GROUP BY 1) m ON m.id = c.id)")
    return _with(name, und, *steps)


#: Rounds of label doubling that reach a fixed point on every chain below 2^20.
DOUBLINGS = 40


def _cc(name: str) -> str:
    """Min label of the neighbourhood, then the label's label: unrolled far past convergence."""
    und = "u AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"
    steps = ["c0 AS MATERIALIZED (SELECT id, id AS label FROM v)"]
    for i in range(DOUBLINGS):
        steps.append(f"h{i} AS MATERIALIZED (SELECT c.id, least(c.label, m.label) AS label FROM c{i} c LEFT JOIN (SELECT u.dst AS id, min(c.label) AS label FROM u JOIN c{i} c ON c.id = u.src GROUP BY 1) m ON m.id = c.id)")
        steps.append(f"g{i} AS MATERIALIZED (SELECT c.label AS id, min(h.label) AS label FROM c{i} c JOIN h{i} h ON h.id = c.id GROUP BY 1)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT h.id, least(h.label, l.label, g.label) AS label FROM h{i} h JOIN h{i} l ON l.id = h.label LEFT JOIN g{i} g ON g.id = h.id)")
    return _with(name, und, *steps)


def _lpa_round(i: int, src: str) -> str:
    return f"""s{i} AS MATERIALIZED (
      SELECT p.id, coalesce(m.label, p.label) AS label, coalesce(m.votes, p.votes) AS votes, m.id IS NOT NULL AS active, m.heard
      FROM {src} p LEFT JOIN (
        SELECT id, arg_min(lab, (-c, lab)) AS label, max(c) AS votes, count(*) AS heard FROM (
          SELECT e.dst AS id, p.label AS lab, count(*) AS c FROM e JOIN {src} p ON p.id = e.src WHERE p.active GROUP BY ALL) GROUP BY id) m
      ON m.id = p.id)"""


def _lpa(name: str, rounds: int = 15) -> str:
    return _with(name, *_lpa_ctes(rounds))


def _lpa_ctes(rounds: int) -> list[str]:
    first = "s0 AS MATERIALIZED (SELECT id, id AS label, 0::BIGINT AS votes, true AS active, 0::BIGINT AS heard FROM v)"
    return [first, *[_lpa_round(i + 1, f"s{i}") for i in range(rounds)]]


def _resume() -> str:
    again = "r0 AS MATERIALIZED (SELECT id, label, votes, true AS active, 0::BIGINT AS heard FROM s3)"
    return _with("li", *_lpa_ctes(3), again, _lpa_round(101, "r0"), _lpa_round(102, "s101")) + "SELECT id, label, votes::BIGINT AS votes FROM s102"


def _history() -> str:
    heard = " UNION ALL ".join(f"SELECT id, {i} AS r, heard FROM s{i} WHERE active" for i in range(1, 16))
    log = f"log AS (SELECT id, (1 + row_number() OVER (PARTITION BY id ORDER BY r))::INTEGER AS step, heard::BIGINT AS n_labels FROM ({heard}))"
    h = "h AS (SELECT id, 0 AS step, 0::BIGINT AS n_labels FROM v UNION ALL SELECT id, 1, 0 FROM v UNION ALL SELECT id, step, n_labels FROM log)"
    return _with("ev", *_lpa_ctes(15), log, h)


def _history_resume() -> str:
    again = "r0 AS MATERIALIZED (SELECT id, label, votes, true AS active, 0::BIGINT AS heard FROM s3)"
    heard = " UNION ALL ".join(f"SELECT id, {i} AS r, heard FROM s{i} WHERE active" for i in (101, 102))
    log = f"log AS (SELECT id, (1 + row_number() OVER (PARTITION BY id ORDER BY r))::INTEGER AS step, heard::BIGINT AS n_labels FROM ({heard}))"
    return _with("ev", *_lpa_ctes(3), again, _lpa_round(101, "r0"), _lpa_round(102, "s101"), log) + "SELECT id, 0 AS step, 0::BIGINT AS n_labels FROM v UNION ALL SELECT id, 1, 0 FROM v UNION ALL SELECT id, step, n_labels FROM log"


#: Which edges a superstep scans, given that ids divisible by seven are active.
HEARD = {"out": "e.src % 7 = 0", "either": "e.src % 7 = 0 OR e.dst % 7 = 0", "all": "true"}


def _log_normal(n: int = LOG_NORMAL, seed: int = 42) -> str:
    def uniform(tag: str, *ids: str) -> str:
        parts = " || ".join(f"'/' || {i}" for i in ids)
        return f"((('0x' || substr(md5('{seed}/{tag}' || {parts}), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r})"

    normal = f"sqrt(-2.0 * ln({uniform('r', 'src')})) * cos(2.0 * pi() * {uniform('t', 'src')})"
    return f"""WITH s AS (SELECT range AS src FROM range(0, {n})),
d AS (SELECT src, least(floor(exp({MU!r} + {SIGMA!r} * {normal})), {n - 1})::INTEGER AS deg, 1.0 + {EXTRA!r} * {uniform('w', 'src')} AS w FROM s),
k AS (SELECT src, w, unnest(range(1, deg + 1)) AS k FROM d WHERE deg > 0)
SELECT src, floor({uniform('d', 'src', 'k')} * {n})::BIGINT AS dst, round(w, 6) AS w FROM k"""


#: Rounds past the convergence of delta PageRank at tolerance 0.001.
PR_ROUNDS = 90


def _pr(name: str, source: int | None = None) -> str:
    start = "0.15::DOUBLE" if source is None else f"CASE WHEN id = {source} THEN 1.0 ELSE 0.0 END::DOUBLE"
    w = "w1 AS MATERIALIZED (SELECT e.src, e.dst, sum(1.0::DOUBLE / o.n) AS w FROM e JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = e.src GROUP BY ALL)"
    steps = [w, f"p0 AS MATERIALIZED (SELECT id, {start} AS rank, {start} AS delta, true AS active FROM v)"]
    for i in range(PR_ROUNDS):
        steps.append(f"""p{i + 1} AS MATERIALIZED (SELECT p.id, p.rank + coalesce(0.85::DOUBLE * m.s, 0) AS rank, coalesce(0.85::DOUBLE * m.s, p.delta) AS delta, m.id IS NOT NULL AS active
          FROM p{i} p LEFT JOIN (SELECT w1.dst AS id, sum(p.delta * w1.w) AS s FROM w1 JOIN p{i} p ON p.id = w1.src WHERE p.active AND p.delta > 0.001 GROUP BY 1) m ON m.id = p.id)""")
    return _with(name, *steps)


def _wrap(x: str) -> str:
    """abs(x * prime) % n with 64-bit wrap-around."""
    m = f"(({x})::HUGEINT * {MIXING_PRIME} % 18446744073709551616::HUGEINT)"
    return f"(abs(CASE WHEN {m} >= 9223372036854775808::HUGEINT THEN {m} - 18446744073709551616::HUGEINT ELSE {m} END) % {PARTS})::INTEGER"


def _placed(rule: str) -> str:
    return _with("li", f"p AS MATERIALIZED (SELECT src, dst, w, {rule} AS pid FROM e)", *_COST)


_COST = [
    "ends AS (SELECT DISTINCT pid, id FROM (SELECT pid, src AS id FROM p UNION ALL SELECT pid, dst FROM p))",
    "loc AS (SELECT pid, id, sum(o) AS n FROM (SELECT pid, src AS id, 1 AS o FROM p UNION ALL SELECT pid, dst, 0 FROM p) GROUP BY ALL)",
    "tot AS (SELECT src AS id, count(*) AS n FROM p GROUP BY 1)",
    "filt AS (SELECT loc.pid, loc.id FROM loc LEFT JOIN tot ON tot.id = loc.id WHERE loc.n = coalesce(tot.n, 0))",
    "own AS (SELECT id, min(pid) AS owner FROM filt GROUP BY 1)",
    "sizes AS (SELECT a.pid, a.n_vertices, b.n_edges FROM (SELECT pid, count(*) AS n_vertices FROM ends GROUP BY 1) a JOIN (SELECT pid, count(*) AS n_edges FROM p GROUP BY 1) b ON a.pid = b.pid)",
    "uncut AS (SELECT p.pid, count(*) FILTER (WHERE own.owner = p.pid) AS n_uncut FROM p LEFT JOIN own ON own.id = p.dst GROUP BY 1)",
]
REVERSE, BLOCKS = _wrap("dst"), _wrap(f"src // {BLOCK}")
CUT = f"((((src * 31 + dst) % 2147483648) * 1000003) % {PARTS})::INTEGER"

KHOP = [
    "u AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e))",
    "k0 AS MATERIALIZED (SELECT v.id, m.landmark, 2 AS budget FROM v JOIN marks m ON v.id = m.landmark)",
    *[f"k{i} AS MATERIALIZED (SELECT id, landmark, max(budget) AS budget FROM (SELECT * FROM k{i - 1} UNION ALL SELECT u.dst, k.landmark, k.budget - 1 FROM k{i - 1} k JOIN u ON u.src = k.id WHERE k.budget = {3 - i}) GROUP BY ALL)" for i in (1, 2)],
]


def _presearch() -> str:
    ctes = [
        *KHOP,
        "meet AS MATERIALIZED (SELECT DISTINCT a.landmark AS a, b.landmark AS b FROM k2 a JOIN k2 b ON a.id = b.id)",
        "c0 AS (SELECT landmark, landmark AS root FROM marks)",
        *[f"c{i} AS MATERIALIZED (SELECT c.landmark, least(c.root, min(o.root)) AS root FROM c{i - 1} c LEFT JOIN meet ON meet.a = c.landmark LEFT JOIN c{i - 1} o ON o.landmark = meet.b GROUP BY c.landmark, c.root)" for i in (1, 2, 3, 4)],
        f"grp AS (SELECT landmark, ((dense_rank() OVER (ORDER BY root) - 1) % {PARTS})::INTEGER AS pid FROM c4)",
        "near AS (SELECT id, list(DISTINCT landmark) AS ls FROM k2 GROUP BY 1)",
        """m AS (SELECT e.src, e.dst, e.w, coalesce(ms.landmark, md.landmark, list_min(list_intersect(a.ls, b.ls)), least(list_min(a.ls), list_min(b.ls))) AS mark
          FROM e LEFT JOIN near a ON a.id = e.src LEFT JOIN near b ON b.id = e.dst LEFT JOIN marks ms ON ms.landmark = e.src LEFT JOIN marks md ON md.landmark = e.dst)""",
    ]
    return _with("ord", *ctes) + f"SELECT src, dst, w, coalesce(grp.pid, {_wrap('dst')}) AS pid FROM m LEFT JOIN grp ON grp.landmark = m.mark"


REPORT = "SELECT s.pid, n_vertices, n_edges, coalesce(f.n, 0) AS n_filtered, n_uncut FROM sizes s JOIN uncut USING (pid) LEFT JOIN (SELECT pid, count(*) AS n FROM filt GROUP BY 1) f ON f.pid = s.pid"


def oracles() -> dict[str, str]:
    norm = f"SELECT id, round(rank * (SELECT count(*) FROM v) / (SELECT sum(rank) FROM p{PR_ROUNDS}), 6) AS rank FROM p{PR_ROUNDS}"
    cc = f"SELECT id, label AS component FROM c{DOUBLINGS}"
    dist = "SELECT id, landmark, round(dist, 6) AS dist FROM d"
    deg = "(SELECT src AS id, count(*) AS degree FROM e GROUP BY 1)"
    return {
        "edge_scan": _with("li") + "SELECT src, dst, w FROM e",
        "default_weight": _with("ord") + "SELECT src, dst, w FROM e",
        "edge_text_parse": "SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_quantity > 25 THEN l_quantity ELSE 1.0 END::DOUBLE AS w FROM lineitem",
        "edge_list_file": _with("li") + "SELECT src, dst, w FROM e",
        "edges_repartitioned": _with("li") + "SELECT src, count(*) AS n_edges, 1::BIGINT AS n_partitions FROM e GROUP BY 1",
        "persisted_cardinalities": _with("ord") + "SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges",
        "cli_components": _cap("ord", 20) + "SELECT id, label AS component FROM c20",
        "cli_paths": _sssp("li") + dist,
        "cli_cost": _placed(CUT) + REPORT,
        "vertex_universe": _with("sparse") + "SELECT id, id AS attr, id NOT IN (SELECT src FROM e UNION SELECT dst FROM e) AS isolated FROM v",
        "max_id_all": " UNION ALL ".join(f"SELECT '{n}' AS name, max(greatest(src, dst)) AS max_id FROM ({sql})" for n, sql in sorted(EDGES.items())),
        "cardinalities": _with("sparse") + "SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges",
        "vertex_universe_whole": _whole("SELECT id, id AS attr, id NOT IN (SELECT src FROM e UNION SELECT dst FROM e) AS isolated FROM v"),
        "cardinalities_whole": _whole("SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges"),
        "out_degree": _with("li") + "SELECT src AS id, count(*) AS degree FROM e GROUP BY 1",
        "in_degree": _with("li") + "SELECT dst AS id, count(*) AS degree FROM e GROUP BY 1",
        "zero_fill_degree": _with("li") + f"SELECT v.id, coalesce(degree, 0) AS degree FROM v LEFT JOIN {deg} o ON o.id = v.id",
        "triplets": _with("li") + "SELECT src, dst, w, src * 2 AS src_attr, dst * 2 AS dst_attr FROM e",
        "map_vertices": _with("li") + "SELECT id, id * 2 + 1 AS attr FROM v",
        "map_edges": _with("li") + "SELECT src, dst, w + 0.5 AS w FROM e",
        "join_vertices": _with("li") + f"SELECT v.id, v.id + coalesce(degree, 0) AS attr FROM v LEFT JOIN {deg} o ON o.id = v.id",
        "pr_edge_weight": _with("li") + f"SELECT src, dst, round(1.0::DOUBLE / degree, 9) AS w FROM e JOIN {deg} o ON o.id = e.src",
        "edge_wash": _with("li") + "SELECT src, dst, min(w) AS w FROM e GROUP BY ALL",
        "reverse_edges": _with("rev") + "SELECT src, dst, w FROM e",
        "vertex_filter": _with("li") + f"SELECT id, degree FROM {deg}",
        "active_scan": _with("li") + "SELECT 'out' AS direction, src, dst, w FROM e WHERE src % 7 = 0 UNION ALL SELECT 'either', src, dst, w FROM e WHERE src % 7 = 0 OR dst % 7 = 0",
        **{f"superstep_{k}": _with("li") + f"SELECT id, coalesce(min(e.src), -1) AS least, count(e.src) AS heard FROM v LEFT JOIN e ON e.dst = v.id AND ({rule}) GROUP BY 1" for k, rule in HEARD.items()},
        "superstep_trace": _cap("ord", TRACED) + " UNION ALL ".join(f"SELECT {i} AS step, id, label FROM c{i}" for i in range(1, TRACED + 1)),
        "superstep_kernel": _with("li") + "SELECT id, round(coalesce(sum(2 * w), 0), 6) AS total FROM v LEFT JOIN e ON e.dst = v.id GROUP BY 1",
        "cc_skipping": _cc("li") + cc,
        "lognormal_graph": _log_normal(),
        "lpa_history_resume": _history_resume(),
        "sssp": _sssp("li") + dist,
        "sssp_skipping": _sssp("li") + dist,
        "sssp_skipping_blocks": _sssp("li") + dist,
        "sssp_orders": _sssp("ord") + dist,
        "sssp_events": _sssp("ev") + dist,
        "sssp_map_packed": _sssp("li") + "SELECT id, " + ", ".join(f"min(dist) FILTER (WHERE k = {k}) AS d{k + 1}" for k in range(4)) + " FROM d JOIN marks USING (landmark) GROUP BY 1",
        "cc_cap20": _cap("ord", 20) + "SELECT id, label AS component FROM c20",
        "cc_full": _cc("ord") + cc,
        "cc_sparse": _cc("sparse") + cc,
        "cc_sizes": _cc("ord") + f"SELECT label AS component, count(*) AS size FROM c{DOUBLINGS} GROUP BY 1",
        "lpa_15": _lpa("li") + "SELECT id, label, votes::BIGINT AS votes FROM s15",
        "lpa_events": _lpa("ev") + "SELECT id, label, votes::BIGINT AS votes FROM s15",
        "lpa_resume": _resume(),
        "lpa_history": _history() + "SELECT id, step, n_labels FROM h",
        "lpa_history_rollup": _history() + "SELECT step, sum(n_labels)::BIGINT AS n_labels FROM h WHERE step < 15 GROUP BY 1",
        "lpa_label_sizes": _lpa("li") + "SELECT label, count(*) AS size FROM s15 GROUP BY 1",
        "pagerank": _pr("li") + norm,
        "pagerank_events": _pr("ev") + norm,
        "pagerank_sinks": _pr("rev") + norm,
        "pagerank_raw": _pr("li") + f"SELECT id, round(rank, 6) AS rank, round(delta, 6) AS delta FROM p{PR_ROUNDS}",
        "pagerank_personalized": _pr("li", 1) + f"SELECT id, round(rank / (SELECT sum(rank) FROM p{PR_ROUNDS}), 6) AS rank FROM p{PR_ROUNDS}",
        "rank_sum": _pr("li") + f"SELECT round(sum(rank), 4) AS rank_sum, count(*) AS n_vertices FROM p{PR_ROUNDS}",
        "khop_2": _with("li", *KHOP) + "SELECT id, landmark, budget FROM k2",
        "part_1d_reverse": _placed(REVERSE) + "SELECT src, dst, w, pid FROM p",
        "part_block": _placed(BLOCKS) + "SELECT src, dst, w, pid FROM p",
        "part_random_cut": _placed(CUT) + "SELECT src, dst, w, pid FROM p",
        "part_presearch": _presearch(),
        "edges_at_pid": _placed(BLOCKS) + "SELECT src, dst, w, pid, pid AS found FROM p",
        "per_partition_procedure": _placed(REVERSE) + "SELECT pid, count(*) AS n_edges, count(DISTINCT src) AS n_sources, max(w) AS top_weight FROM p GROUP BY 1",
        "partition_sizes": _placed(REVERSE) + "SELECT pid, n_vertices, n_edges FROM sizes",
        "partition_filtered": _placed(BLOCKS) + "SELECT pid, id FROM filt",
        "partition_uncut": _placed(REVERSE) + "SELECT pid, n_uncut FROM uncut",
        "partition_report": _placed(BLOCKS) + REPORT,
    }
