"""The graph queries, each with the SQL that it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dense as D
from .functions import vectors as V
from .operators import batches, communities, graph, message, order
from .operators.durable import StageStore, sized
from .plans import dataflow, forwards, models, trace, typed
from .plans import layers as L
from .sources import graph_files, tables
from .sql import SHIFT, WIDTH, Sql
from .streaming import degrees

#: The tables whose sizes say how many tasks a query's shuffles have.
_GROWING = ("customer", "supplier", "part", "orders", "lineitem", "embeddings", "events")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(s, d):
            return f(sized(s, *(f"{d}/{t}.parquet" for t in _GROWING)), d)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _long(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each entry of x, rounded: engines add in different orders. The shift keeps exact ties from hanging on the last bit."""
    keys = keys or ("id",)
    return df.select(*keys, F.posexplode("x").alias("i", "v")).select(*keys, "i", (F.round(F.col("v") + SHIFT, 6) + 0.0).alias("v"))


def _sql(build: Callable[[Sql], str], width: int = WIDTH) -> str:
    s = Sql(width)
    return build(s)


def _bi(s: SparkSession, d: str) -> DataFrame:
    return graph.bidirected(tables.edges(s, d))


# Sources and graph transforms


@query(_sql(lambda q: q.text("SELECT src, dst FROM edges")))
def edge_dedupe(s, d):
    return graph.simple(tables.raw_edges(s, d))


@query(_sql(lambda q: q.text("SELECT src, dst FROM bi")))
def edge_symmetrize(s, d):
    return graph.bidirected(tables.raw_edges(s, d))


@query(_sql(lambda q: q.text("SELECT src, dst FROM edges UNION ALL SELECT id, id FROM ids")))
def add_self_loop(s, d):
    return graph.add_self_loops(tables.edges(s, d), tables.node_ids(s, d))


_IN_DEGREE = "SELECT ids.id, count(e.dst) AS degree FROM ids LEFT JOIN edges e ON e.dst = ids.id GROUP BY ids.id"


@query(_sql(lambda q: q.text(_IN_DEGREE)))
def in_degree(s, d):
    return graph.in_degrees(tables.edges(s, d), tables.node_ids(s, d))


@query(_sql(lambda q: q.text("SELECT (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM ids) AS avg_degree")))
def avg_in_degree(s, d):
    return graph.average_in_degree(tables.edges(s, d), tables.node_ids(s, d))


@query("""WITH lines AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS line, 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem),
seen AS (SELECT raw, min(place) AS place FROM (SELECT src AS raw, line * 2 AS place FROM lines UNION ALL SELECT dst AS raw, line * 2 + 1 AS place FROM lines) GROUP BY raw)
SELECT raw, row_number() OVER (ORDER BY place) - 1 AS id FROM seen""")
def id_densify(s, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = order.with_position(tables.table(s, d, "lineitem").select(*keys), keys, "line")
    named = lines.select("line", F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return graph_files.densify(named)[1]


@query(_sql(lambda q: q.text("SELECT src, dst FROM edges WHERE dst IN (SELECT p_partkey FROM part WHERE p_size <= 10)")))
def one_hop_block(s, d):
    return graph.restrict(tables.edges(s, d), tables.table(s, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id")))


@query(_sql(lambda q: (q.add("s0", "SELECT s_suppkey + (SELECT n FROM np) AS id FROM supplier WHERE s_nationkey = 7"), q.add("s1", "SELECT id FROM s0 UNION SELECT src FROM bi WHERE dst IN (SELECT id FROM s0)"), q.text("SELECT id FROM s1 UNION SELECT src FROM bi WHERE dst IN (SELECT id FROM s1)"))[-1]))
def two_hop_frontier(s, d):
    seeds = tables.table(s, d, "supplier").where("s_nationkey = 7").select((F.col("s_suppkey") + tables.n_parts(s, d)).alias("id"))
    return graph.hops(_bi(s, d), seeds, 2)[0]


@query(_sql(lambda q: q.text("SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY md5('0:' || src || ':' || dst), src) AS k FROM edges) WHERE k <= 10")))
def fanout_topk(s, d):
    return graph.fan_out(tables.edges(s, d), 10)


_BY_DEGREE = f"SELECT id, degree, row_number() OVER (ORDER BY degree, id) - 1 AS pos FROM ({_IN_DEGREE})"


@query(_sql(lambda q: q.text(_BY_DEGREE)))
def degree_order(s, d):
    return order.by_in_degree(in_degree(s, d))


@query(_sql(lambda q: q.text("SELECT id, row_number() OVER (ORDER BY md5('0:' || id), id) - 1 AS pos FROM ids")))
def hash_order(s, d):
    return order.by_hash(tables.node_ids(s, d))


@query(_sql(lambda q: q.text("SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM ids")))
def identity_order(s, d):
    return order.by_id(tables.node_ids(s, d))


@query()
def cuthill_mckee_order(s, d):
    return order.cuthill_mckee(tables.edges(s, d), tables.node_ids(s, d))


@query()
def balanced_parts(s, d):
    """Five parts of the undirected graph, none above a tenth more than its share."""
    return order.balanced_parts(_bi(s, d), tables.node_ids(s, d), 5)


@query()
def community_order(s, d):
    """Communities by modularity gains, and the depth-first order of their merges."""
    return communities.community_order(tables.edges(s, d), tables.node_ids(s, d))


@query(_sql(lambda q: (q.add("ends", "SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst"), q.text("SELECT round(sum(inside) / sum(k) - sum(k::DOUBLE * k) / (sum(k)::DOUBLE * sum(k)), 9) AS modularity FROM (SELECT a % 5 AS c, count(*) AS k, count(*) FILTER (b % 5 = a % 5) AS inside FROM ends GROUP BY ALL)"))[-1]))
def parts_modularity(s, d):
    """The modularity of the parts by id modulo 5."""
    parts = tables.node_ids(s, d).select("id", F.pmod("id", F.lit(5)).alias("community"))
    return communities.modularity(tables.edges(s, d), parts).select(F.round("modularity", 9).alias("modularity"))


@query(_sql(lambda q: q.text(f"SELECT id, degree, (sum(degree) OVER (ORDER BY id))::BIGINT AS running FROM ({_IN_DEGREE})")))
def degree_prefix_sum(s, d):
    return order.with_running_sum(in_degree(s, d), "degree", ["id"], "running")


@query(_sql(lambda q: q.text(f"SELECT id, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS first, degree FROM ({_IN_DEGREE})")))
def csc_index(s, d):
    return graph.csc(tables.edges(s, d), tables.node_ids(s, d))[0]


@query(_sql(lambda q: q.text("SELECT dst, row_number() OVER (ORDER BY dst, src) - 1 AS pos, src FROM edges")))
def csc_adjacency(s, d):
    return graph.csc(tables.edges(s, d), tables.node_ids(s, d))[1]


@query(_sql(lambda q: (q.add("o", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM ids"), q.add("t", "SELECT id FROM o WHERE pos < floor((SELECT count(*) FROM ids) * 0.05)"), q.text("SELECT id FROM t UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM t) AND (SELECT count(*) FROM t) * (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM ids) <= 0.8 * (SELECT count(*) FROM ids) UNION SELECT id FROM ids WHERE (SELECT count(*) FROM t) * (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM ids) > 0.8 * (SELECT count(*) FROM ids)"))[-1]))
def ratio_targets(s, d):
    ids = tables.node_ids(s, d)
    return graph.ratio_layers(tables.edges(s, d), ids, graph.targets_by_ratio(order.by_id(ids), 0.05), 2)[0]


@query(_sql(lambda q: q.text("SELECT id, CASE WHEN id % 10 <= 5 THEN 'train' WHEN id % 10 <= 7 THEN 'val' ELSE 'test' END AS split FROM ids")))
def split_masks(s, d):
    return graph.split_masks(tables.node_ids(s, d))


@query(_sql(lambda q: q.text("SELECT src, dst FROM edges WHERE src % 10 <= 5 AND dst % 10 <= 5")))
def induced_subgraph(s, d):
    return graph.induced(tables.edges(s, d), graph.split_masks(tables.node_ids(s, d)).where("split = 'train'"))


@query(_sql(lambda q: (q.typed(), q.text("SELECT * FROM tedges UNION ALL SELECT dst_type, 'rev-' || etype, src_type, dst, src FROM tedges"))[-1]))
def reverse_etypes(s, d):
    return graph.with_reverse_relations(tables.typed_edges(s, d))


@query(_sql(lambda q: (q.typed(), q.text("SELECT src_type, etype, dst_type, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM tedges GROUP BY ALL"))[-1]))
def relation_counts(s, d):
    return graph.relation_counts(tables.typed_edges(s, d))


@query(_sql(lambda q: (q.typed(), q.text("SELECT src, dst FROM tedges WHERE etype = 'places'"))[-1]))
def relation_subgraph(s, d):
    return graph.relation(tables.typed_edges(s, d), "customer", "places", "order").select("src", "dst")


# Batches


@query(_sql(lambda q: q.text("SELECT id, pos, pos // 300 AS batch FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM ids)")))
def fixed_batches(s, d):
    return batches.by_count(order.by_id(tables.node_ids(s, d)), 300)


@query(_sql(lambda q: (
    q.add("o", f"SELECT id, pos, degree FROM ({_BY_DEGREE})"),
    q.add("w", """SELECT id, pos, degree, 0 AS batch, 1 AS n, degree AS e FROM o WHERE pos = 0 UNION ALL
        SELECT o.id, o.pos, o.degree, w.batch + (w.n >= 200 OR w.e + o.degree >= 2000)::INTEGER, CASE WHEN w.n >= 200 OR w.e + o.degree >= 2000 THEN 1 ELSE w.n + 1 END,
        CASE WHEN w.n >= 200 OR w.e + o.degree >= 2000 THEN o.degree ELSE w.e + o.degree END FROM w JOIN o ON o.pos = w.pos + 1"""),
    q.text("SELECT id, pos, degree, batch::BIGINT AS batch FROM w"))[-1]))
def edge_budget_batches(s, d):
    return batches.by_budget(degree_order(s, d), 200, 2000)


@query(_sql(lambda q: q.text(f"SELECT id, pos, degree, ((sum(degree) OVER (ORDER BY pos) - degree) // 2000)::BIGINT AS batch FROM ({_BY_DEGREE})")))
def edge_budget_bins(s, d):
    return batches.by_budget_bins(degree_order(s, d), 2000)


@query(_sql(lambda q: (q.typed(), q.text("SELECT ntype, id, (row_number() OVER (PARTITION BY ntype ORDER BY id) - 1) // 200 AS batch FROM tids"))[-1]))
def typed_batches(s, d):
    return batches.by_type(tables.typed_nodes(s, d).select("ntype", "id"), 200)


@query(_sql(lambda q: (q.add("o", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 300 AS batch FROM ids"), q.add("j", "SELECT batch, src FROM edges JOIN o ON o.id = dst"),
    q.text("""SELECT b.batch, i.n_in, b.n_out, coalesce(e.n_edges, 0) AS n_edges FROM (SELECT batch, count(*) AS n_out FROM o GROUP BY 1) b LEFT JOIN (SELECT batch, count(*) AS n_edges FROM j GROUP BY 1) e USING (batch)
        JOIN (SELECT batch, count(DISTINCT id) AS n_in FROM (SELECT batch, src AS id FROM j UNION ALL SELECT batch, id FROM o) GROUP BY 1) i USING (batch)"""))[-1]))
def batch_statistics(s, d):
    return batches.statistics(tables.edges(s, d), fixed_batches(s, d).select("id", "batch"))


# Joins, messages and reductions


@query(_sql(lambda q: q.text("SELECT src, dst, i, v FROM edges JOIN x ON x.id = src")))
def gather_join(s, d):
    joined = message.gathered(tables.edges(s, d), tables.nodes(s, d, WIDTH), "u")
    return joined.select("src", "dst", F.posexplode("u").alias("i", "v"))


@query(_sql(lambda q: q.long(q.reduce("x", "sum", "edges"))))
def fill_missing_zeros(s, d):
    n = tables.coded_nodes(s, d, WIDTH)
    return _long(message.fill_missing(message.update_all(tables.edges(s, d), n, "copy_u", "sum", WIDTH), n, WIDTH))


def _embedding_sql(q: Sql) -> str:
    q.typed()
    parts = q.linear("(SELECT * FROM tx WHERE ntype = 'part')", 7, 16)
    t = q.new(f"SELECT 'part' AS ntype, id, i, v FROM {parts} UNION ALL SELECT ntype, id, i::INTEGER, ((5 * i + 3 * (id % 7)) % 7 - 3) / 16.0::DOUBLE FROM tids, range(16) r(i) WHERE ntype <> 'part'")
    return q.long(t, "ntype, id")


@query(_sql(_embedding_sql))
def embedding_lookup(s, d):
    """Parts have features, projected to 16 entries; other types take a learned row, here a formula of the id."""
    n = tables.typed_nodes(s, d)
    learned = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((5 * i + 3 * F.pmod("id", F.lit(7))) % 7 - 3) / 16.0)
    found = typed.embedded(n, n.where("ntype = 'part'"), n.select("ntype", "id", learned.alias("x")), {"part": D.weights(7, WIDTH, 16)})
    return _long(found, "ntype", "id")


_UNIT = "('0x' || substr(md5('20:' || id || ':' || {i}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(_sql(lambda q: q.text(f"SELECT id, floor({_UNIT.format(i='-1')} * 10)::INTEGER AS label, i::INTEGER AS i, {_UNIT.format(i='i')} AS v FROM ids, range(16) r(i)")))
def hashed_features(s, d):
    n = tables.hashed_nodes(tables.node_ids(s, d), 16, 10)
    return n.select("id", "label", F.posexplode("x").alias("i", "v"))


@query(_sql(lambda q: q.text("SELECT p_partkey AS id, p_size <= 10 AS train, p_size > 40 AS test FROM part")))
def index_masks(s, d):
    """Split masks from index tables."""
    parts = tables.table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return graph.masks_by_index(parts, train=parts.where("p_size <= 10"), test=parts.where("p_size > 40"))


def _copy(how: str, sql_how: str):
    def run(s, d):
        return _long(message.update_all(tables.edges(s, d), tables.coded_nodes(s, d, WIDTH), "copy_u", how, WIDTH))

    run.__name__ = f"copy_u_{how}"
    query(_sql(lambda q: q.long(q.reduce("x", sql_how, "edges", fill=False))))(run)


for _how, _sql_how in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min")):
    _copy(_how, _sql_how)


def _pair(op: str, expr: str, width: int = WIDTH):
    def run(s, d):
        n = tables.coded_nodes(s, d, width).mapped(lambda x: V.mapped(x, lambda v: v + 2))
        return _long(message.update_all(tables.edges(s, d), n, f"u_{op}_v", "sum", width))

    run.__name__ = f"u_{op}_v"
    total = "0 AS i, sum(" if op == "dot" else "u.i, sum("
    group = "dst" if op == "dot" else "dst, u.i"
    query(_sql(lambda q: (q.add("y", "SELECT id, i, v + 2 AS v FROM x"), q.add("r", f"SELECT dst AS id, {total}{expr}) AS v FROM edges JOIN y u ON u.id = src JOIN y w ON w.id = dst AND w.i = u.i GROUP BY {group}"), q.long("r"))[-1], width))(run)


for _op, _expr in (("add", "u.v + w.v"), ("sub", "u.v - w.v"), ("mul", "u.v * w.v"), ("div", "u.v / w.v"), ("dot", "u.v * w.v")):
    _pair(_op, _expr)


@query(_sql(lambda q: (q.add("r", "SELECT dst AS id, i, sum(v * (((src + dst) % 9) / 8.0::DOUBLE)) AS v FROM edges JOIN x ON x.id = src GROUP BY dst, i"), q.long("r"))[-1]))
def u_mul_e(s, d):
    e = F.array_repeat(((F.col("src") + F.col("dst")) % 9) / 8.0, WIDTH)
    return _long(message.update_all(tables.edges(s, d), tables.coded_nodes(s, d, WIDTH), "u_mul_e", "sum", WIDTH, e))


def _edge_form(op: str, expr: str):
    def run(s, d):
        e = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: ((F.col("src") + F.col("dst") + i) % 9 + 1) / 8.0)
        return _long(message.update_all(tables.edges(s, d), tables.coded_nodes(s, d, WIDTH), op, "sum", WIDTH, e))

    run.__name__ = op
    query(_sql(lambda q: (
        q.add("w", f"SELECT src, dst, i::INTEGER AS i, ((src + dst + i) % 9 + 1) / 8.0::DOUBLE AS e FROM edges, range({WIDTH}) r(i)"),
        q.add("r", f"SELECT w.dst AS id, w.i, sum({expr}) AS v FROM w JOIN x u ON u.id = w.src AND u.i = w.i JOIN x v ON v.id = w.dst AND v.i = w.i GROUP BY w.dst, w.i"),
        q.long("r"))[-1]))(run)


for _op, _expr in (("copy_e", "w.e"), ("e_sub_u", "w.e - u.v"), ("v_div_e", "v.v / w.e"), ("v_add_e", "v.v + w.e")):
    _edge_form(_op, _expr)


_SCORES = "SELECT src, dst, ((src * 7 + dst * 3) % 17 - 8) / 4.0::DOUBLE AS s FROM edges"


@query(_sql(lambda q: (q.add("sc", _SCORES), q.add("m", "SELECT *, exp(s - max(s) OVER (PARTITION BY dst)) AS e FROM sc"), q.text("SELECT src, dst, round(e / sum(e) OVER (PARTITION BY dst), 6) + 0.0 AS a FROM m"))[-1]))
def edge_softmax(s, d):
    scores = tables.edges(s, d).withColumn("s", F.array(((F.col("src") * 7 + F.col("dst") * 3) % 17 - 8) / 4.0))
    return message.edge_softmax(scores).select("src", "dst", (F.round(F.col("a")[0], 6) + 0.0).alias("a"))


def _norm(norm: str):
    def run(s, d):
        return _long(message.graph_conv(_bi(s, d), tables.coded_nodes(s, d, WIDTH), WIDTH, norm))

    run.__name__ = f"gcn_norm_{norm}"
    query(_sql(lambda q: q.long(q.conv("x", "bi", norm))))(run)


for _n in ("both", "right", "none"):
    _norm(_n)


def _multi(how: str, sql_how: str):
    def run(s, d):
        e = tables.typed_edges(s, d)
        parts, own = [], tables.coded_type(s, d, "part")
        for src, etype in (("order", "contains"), ("supplier", "supplies")):
            of = graph.relation(e, src, etype, "part")
            parts.append(message.fill_missing(message.update_all(of, tables.coded_type(s, d, src), "copy_u", "mean", WIDTH), own, WIDTH))
        return _long(message.cross_reduced(parts, how, WIDTH))

    run.__name__ = f"multi_relation_{how}"

    def build(q: Sql) -> str:
        q.typed()
        parts = []
        for src, etype in (("order", "contains"), ("supplier", "supplies")):
            r = q.new(f"SELECT dst AS id, i, avg(v) AS v FROM tedges JOIN tx ON tx.id = src AND ntype = '{src}' WHERE etype = '{etype}' GROUP BY dst, i")
            parts.append(f"SELECT t.id, k.i, coalesce(r.v, 0.0) AS v FROM tids t CROSS JOIN (SELECT DISTINCT i FROM tx) k LEFT JOIN {r} r ON r.id = t.id AND r.i = k.i WHERE t.ntype = 'part'")
        q.add("z", f"SELECT id, i, {sql_how}(v) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY id, i")
        return q.long("z")

    query(_sql(build))(run)


for _how, _sql_how in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min")):
    _multi(_how, _sql_how)


@query(_sql(lambda q: q.text(f"SELECT i, round(avg(v) + {SHIFT}, 6) + 0.0 AS v FROM x GROUP BY i")))
def global_mean(s, d):
    n = tables.nodes(s, d, WIDTH)
    mean = n.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(WIDTH)]).alias("x"))
    return mean.select(F.posexplode("x").alias("i", "v")).select("i", (F.round(F.col("v") + SHIFT, 6) + 0.0).alias("v"))


# Dense row operators


def _dense(name: str, column: Callable[[], object], build: Callable[[Sql], str] | None, width: int = WIDTH):
    def run(s, d):
        return _long(tables.nodes(s, d, width).select("id", column().alias("x")))

    run.__name__ = name
    query(_sql(lambda q: q.long(build(q)), width) if build else None)(run)


_dense("linear", lambda: D.linear("x", D.weights(1, WIDTH, 8), D.bias(1, 8)), lambda q: q.linear("x", 1, 8, bias=1))
_dense("relu", lambda: V.relu("x"), lambda q: q.relu("x"))
_dense("leaky_relu", lambda: V.leaky_relu("x", 0.2), lambda q: q.map("x", "CASE WHEN v >= 0 THEN v ELSE v * 0.2::DOUBLE END"))
_dense("gelu", lambda: D.gelu("x"), None)
_dense("sigmoid_gate", lambda: V.mapped("x", lambda v: V.sigmoid(v)), lambda q: q.map("x", "1 / (1 + exp(-v))"))
_dense("layer_norm", lambda: V.layer_norm("x"), lambda q: q.new("SELECT id, i, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) AS v FROM x WINDOW w AS (PARTITION BY id)"))
_dense("heads_mean", lambda: V.heads_mean("x", 4, 16), lambda q: q.new("SELECT id, i % 16 AS i, avg(v) AS v FROM x GROUP BY id, i % 16"))
_dense("head_bilinear", lambda: D.head_bilinear("x", D.weights(2, 16, 16)[None].repeat(4, 0)), lambda q: q.new("SELECT id, (i // 16 * 16 + j)::INTEGER AS i, sum(v * (((31 * (i % 16) + 17 * j + 14) % 13 - 6) / 16.0::DOUBLE)) AS v FROM x, range(16) r(j) GROUP BY id, i // 16 * 16 + j"))
_dense("concat_jk", lambda: F.concat(F.col("x"), V.relu("x")), lambda q: q.new(f"SELECT id, i, v FROM x UNION ALL SELECT id, i + {WIDTH}, greatest(v, 0.0) FROM x"))
_dense("add_scaled", lambda: V.add("x", V.scaled("x", 0.5)), lambda q: q.map("x", "v + v * 0.5::DOUBLE"))
_dense("log_softmax", lambda: V.log_softmax("x"), lambda q: q.new("SELECT id, i, v - m - ln(sum(exp(v - m)) OVER (PARTITION BY id)) AS v FROM (SELECT *, max(v) OVER (PARTITION BY id) AS m FROM x)"))


@query(_sql(lambda q: (q.add("w", f"SELECT i, j, sum((((31 * 1 + 17 * b + 9 * 7) % 13 - 6) / 16.0::DOUBLE) * (((31 * i + 17 * j + 7 * (5 + b)) % 13 - 6) / 16.0::DOUBLE)) AS w FROM range({WIDTH}) a(i), range(8) c(j), range(2) e(b) GROUP BY i, j"), q.add("z", "SELECT id, j::INTEGER AS i, sum(v * w.w) AS v FROM x JOIN w ON w.i = x.i GROUP BY id, j"), q.long("z"))[-1]))
def basis_linear(s, d):
    """Relation 1 of three, from two bases."""
    import numpy as np

    w = D.basis_weights(D.weights(9, 3, 2), np.stack([D.weights(5 + b, WIDTH, 8) for b in range(2)]))
    return _long(tables.nodes(s, d, WIDTH).select("id", D.linear("x", w[1]).alias("x")))


@query(_sql(lambda q: (q.linear("x", 3, 10), q.text("SELECT id, (arg_min(i, (-v, i)))::INTEGER AS predicted FROM t1 GROUP BY id"))[-1]))
def argmax_predict(s, d):
    return models.predictions(tables.nodes(s, d, WIDTH).select("id", D.linear("x", D.weights(3, WIDTH, 10)).alias("x")))


_LABELS = "SELECT ids.id, label FROM ids JOIN embeddings ON vec_id = id % (SELECT n FROM ne)"


@query(_sql(lambda q: (q.linear("x", 3, 10), q.add("p", "SELECT id, arg_min(i, (-v, i)) AS predicted FROM t1 GROUP BY id"), q.add("l", _LABELS), q.text("SELECT round(avg((predicted = label)::INTEGER::DOUBLE), 6) AS accuracy FROM p JOIN l USING (id)"))[-1]))
def accuracy(s, d):
    n = tables.nodes(s, d, WIDTH)
    return models.accuracy(n.select("id", D.linear("x", D.weights(3, WIDTH, 10)).alias("x")), n.select("id", "label")).select(F.round("accuracy", 6).alias("accuracy"))


@query(_sql(lambda q: (q.linear("x", 3, 10), q.add("sm", "SELECT id, i, v - m - ln(sum(exp(v - m)) OVER (PARTITION BY id)) AS v FROM (SELECT *, max(v) OVER (PARTITION BY id) AS m FROM t1)"), q.add("l", _LABELS), q.text("SELECT round(avg(-v), 6) AS loss FROM sm JOIN l ON l.id = sm.id AND l.label = sm.i"))[-1]))
def cross_entropy(s, d):
    n = tables.nodes(s, d, WIDTH)
    return models.cross_entropy(n.select("id", D.linear("x", D.weights(3, WIDTH, 10)).alias("x")), n.select("id", "label")).select(F.round("loss", 6).alias("loss"))


# Models


def _run(s: SparkSession, d: str, made: tuple[L.Plan, L.Step], width: int = WIDTH, loops: bool = False, in_cells: bool = False) -> DataFrame:
    plan, start = made
    nodes = tables.nodes(s, d, width).select("id", "x")
    edges = _bi(s, d)
    if loops:
        edges = graph.add_self_loops(edges, nodes)
    if not in_cells:
        edges = L.durable(edges)  # read by every layer, and within one by degrees and messages
    if plan.layers > 1:
        nodes = L.durable(nodes)
    return _long(plan.run(L.Graph(edges, nodes.select("id")), {start: nodes}, keep=L.durable if plan.layers > 1 else None)[0])


def _flow(s: SparkSession, d: str, traced: trace.Traced, loops: bool = False, targets: DataFrame | None = None, store: StageStore | None = None) -> list[DataFrame]:
    """The outputs of a traced function over the bucketed graph."""
    store = store or StageStore(s)
    x = store.put(tables.nodes(s, d).select("id", "x").repartition(store.buckets, "id"), "features")
    edges = graph.add_self_loops(_bi(s, d), x) if loops else _bi(s, d)
    g = dataflow.stored_graph({None: edges}, {None: x}, store)
    return traced.flow.run(g, {traced.sources[0]: x}, store, None if targets is None else {None: targets})


def _typed_flow(s: SparkSession, d: str, forward, targets: DataFrame | None = None, width: int | None = None, store: StageStore | None = None) -> DataFrame:
    """(ntype, id, x) of a traced function over the typed graph, each relation and type in tables of its own; with targets, of parts only. width projects the features first."""
    store = store or StageStore(s)
    e, n = tables.typed_edges(s, d), tables.typed_nodes(s, d, of=(lambda x: D.linear(x, D.weights(50, WIDTH, width) / 16)) if width else None)
    types = sorted(tables.NODE_TABLES)
    traced = trace.trace_typed(forward, _RELATIONS, width or WIDTH, "part" if targets is not None else None)
    own = lambda t: n.where(F.col("ntype") == t).select("id", "x")
    x = dict(zip(types, store.put_all([(own(t).repartition(store.buckets, "id"), f"features {t}", "id") for t in types]), strict=True))
    g = dataflow.stored_graph({r: graph.relation(e, *r) for r in _RELATIONS}, x, store)
    read = {traced.sources[t]: x[t] for t in types if traced.sources[t] in traced.flow.level}
    found = traced.flow.run(g, read, store, None if targets is None else {"part": targets})
    out = None
    for t, table in zip(["part"] if targets is not None else types, found, strict=True):
        one = table.select(F.lit(t).alias("ntype"), "id", "x")
        out = one if out is None else out.unionByName(one)
    return out


def _loops(q: Sql) -> str:
    return q.add("loops", "SELECT src, dst FROM bi UNION ALL SELECT id, id FROM ids")


@query(_sql(lambda q: (e := _loops(q), q.long(q.relu(q.linear(q.conv("x", e), 0, 16, bias=0))))[-1]))
def gcn_1layer(s, d):
    return _run(s, d, models.gcn([WIDTH, 16]), loops=True)


@query(_sql(lambda q: (e := _loops(q), a := q.relu(q.linear(q.conv("x", e), 0, 16, bias=0)), q.long(q.relu(q.linear(q.conv(a, e), 1, 8, bias=1))))[-1]))
def gcn_2layer(s, d):
    return _run(s, d, models.gcn([WIDTH, 16, 8]), loops=True)


def _sage_sql(q: Sql) -> str:
    a = q.relu(q.plus(q.linear("x", 0, 16, bias=0), q.reduce(q.linear("x", 1, 16), "avg", "bi")))
    return q.long(q.plus(q.linear(a, 2, 8, bias=1), q.reduce(q.linear(a, 3, 8), "avg", "bi")))


@query(_sql(_sage_sql))
def sage_2layer(s, d):
    return _long(_flow(s, d, trace.trace(forwards.sage([WIDTH, 16, 8]), WIDTH))[0])


def _gat_sql(q: Sql) -> str:
    t, heads, w = "x", 2, 4
    for k in range(2):
        h = q.linear(t, k, heads * w)
        score = [q.new(f"SELECT id, i // {w} AS h, sum(v * (((31 * (i // {w}) + 17 * (i % {w}) + {7 * (base + k)}) % 13 - 6) / 64.0::DOUBLE)) AS s FROM {h} GROUP BY id, i // {w}") for base in (10, 20)]
        e = q.new(f"SELECT src, dst, l.h, CASE WHEN l.s + r.s >= 0 THEN l.s + r.s ELSE (l.s + r.s) * 0.2::DOUBLE END AS s FROM loops JOIN {score[0]} l ON l.id = src JOIN {score[1]} r ON r.id = dst AND r.h = l.h")
        x = q.new(f"SELECT *, exp(s - max(s) OVER (PARTITION BY dst, h)) AS e FROM {e}")
        a = q.new(f"SELECT src, dst, h, e / sum(e) OVER (PARTITION BY dst, h) AS a FROM {x}")
        o = q.new(f"SELECT dst AS id, i, sum(v * a) AS v FROM {a} JOIN {h} f ON f.id = src AND f.i // {w} = h GROUP BY dst, i")
        if k:
            o = q.plus(o, q.linear(t, 30 + k, heads * w))
            return q.long(q.new(f"SELECT id, i % {w} AS i, avg(v) AS v FROM {o} GROUP BY id, i % {w}"))
        t = q.map(o, "CASE WHEN v >= 0 THEN v ELSE v * 0.01::DOUBLE END")
    raise AssertionError


@query(_sql(lambda q: (_loops(q), _gat_sql(q))[-1]))
def gat_2layer(s, d):
    return _run(s, d, models.gat(WIDTH, 4, 2), loops=True, in_cells=True)


@query(_sql(lambda q: (_loops(q), _gat_sql(q))[-1]))
def traced_gat(s, d):
    """The same model, from a plain forward function with edge frames."""
    return _long(_flow(s, d, trace.trace(forwards.gat(2, 4), WIDTH), loops=True)[0])


def _attention_sql(q: Sql) -> str:
    l, r = (q.linear("x", k, 2) for k in (11, 12))
    s = q.new(f"SELECT src, dst, l.i, (CASE WHEN l.v + r.v >= 0 THEN l.v + r.v ELSE (l.v + r.v) * 0.2::DOUBLE END) / 16.0 AS s FROM bi JOIN {l} l ON l.id = src JOIN {r} r ON r.id = dst AND r.i = l.i")
    x = q.new(f"SELECT *, exp(s - max(s) OVER (PARTITION BY dst, i)) AS e FROM {s}")
    return q.new(f"SELECT src, dst, i, e / sum(e) OVER (PARTITION BY dst, i) AS v FROM {x}")


def _attention(g: trace.GraphProxy, x: trace.Value) -> trace.Value:
    """Two heads of scores for each edge: apply_edges, a function of the edge's value, softmax."""
    g.srcdata["l"], g.dstdata["r"] = trace.linear(x, D.weights(11, WIDTH, 2)), trace.linear(x, D.weights(12, WIDTH, 2))
    g.apply_edges(trace.u_add_v("l", "r", "e"))
    return trace.edge_softmax(g, trace.leaky_relu(g.edata.pop("e"), 0.2) / 16.0)


@query(_sql(lambda q: q.long(_attention_sql(q), "src, dst")))
def edge_attention(s, d):
    """An output that is a value of edges."""
    return _long(_flow(s, d, trace.trace(_attention, WIDTH))[0], "src", "dst")


def _smoothed_sql(q: Sql) -> str:
    a, t = _attention_sql(q), q.linear("x", 13, 4)
    for _ in range(2):
        t = q.new(f"SELECT dst AS id, t.i, sum(t.v * a.v) AS v FROM {a} a JOIN {t} t ON t.id = src AND t.i // 2 = a.i GROUP BY dst, t.i")
        t = q.fill(t, "(SELECT i FROM range(4) r(i))")
    return q.long(t)


@query(_sql(_smoothed_sql))
def edge_state_two_rounds(s, d):
    """Edge values made once and read by two stages."""

    def forward(g, x):
        a = _attention(g, x).view(trace.ROWS, 2, 1)
        h = trace.linear(x, D.weights(13, WIDTH, 4)).view(trace.ROWS, 2, 2)
        for _ in range(2):
            g.srcdata["h"], g.edata["a"] = h, a
            g.update_all(trace.u_mul_e("h", "a", "m"), trace.sum_("m", "h"))
            h = g.dstdata["h"]
        return h

    return _long(_flow(s, d, trace.trace(forward, WIDTH))[0])


def _jk_sql(q: Sql) -> str:
    a = q.relu(q.linear(q.conv("x", "bi"), 0, 8, bias=0))
    b = q.relu(q.linear(q.conv(a, "bi"), 1, 8, bias=1))
    j = q.new(f"SELECT id, i, v FROM {a} UNION ALL SELECT id, i + 8, v FROM {b}")
    return q.long(q.linear(q.reduce(j, "sum", "bi"), 9, 6, bias=9))


def _jk_max_sql(q: Sql) -> str:
    a = q.relu(q.linear(q.conv("x", "bi"), 0, 8, bias=0))
    b = q.relu(q.linear(q.conv(a, "bi"), 1, 8, bias=1))
    j = q.new(f"SELECT id, i, max(v) AS v FROM (SELECT * FROM {a} UNION ALL SELECT * FROM {b}) GROUP BY id, i")
    return q.long(q.linear(q.reduce(j, "sum", "bi"), 9, 6, bias=9))


@query(_sql(_jk_sql))
def jknet(s, d):
    return _run(s, d, models.jknet(WIDTH, 8, 6))


@query(_sql(lambda q: _jk_max_sql(q)))
def jknet_max(s, d):
    return _long(_flow(s, d, trace.trace(forwards.jknet(8, 6, mode="max"), WIDTH))[0])


def _sum_net_sql(q: Sql) -> str:
    a = q.relu(q.linear(q.conv("x", "bi"), 0, 8))
    b = q.relu(q.linear(q.conv(a, "bi"), 1, 8))
    return q.long(q.plus(a, b, q.relu(q.linear(q.conv(b, "bi"), 2, 8))))


@query(_sql(_sum_net_sql))
def sum_net(s, d):
    return _run(s, d, models.sum_net([WIDTH, 8, 8, 8]))


@query(_sql(_sum_net_sql))
def traced_sum_net(s, d):
    """The same net, from a function over blocks with slices of the destinations' rows."""
    return _long(_flow(s, d, trace.trace(forwards.sum_net([WIDTH, 8, 8, 8]), WIDTH))[0])


def _branching_sql(q: Sql) -> str:
    conv = lambda k, t: q.linear(q.conv(t, "bi"), k, 8, by=64.0)
    x1 = conv(1, q.linear("x", 0, 8, by=256.0))
    x2, x3 = conv(2, x1), conv(3, x1)
    m = q.new(f"SELECT id, t.i, v + m.m AS v FROM {x2} t JOIN (SELECT i, avg(v) AS m FROM {x3} GROUP BY i) m ON m.i = t.i")
    x4, x5 = conv(4, m), conv(5, x2)
    x6 = conv(6, q.plus(x4, x5))
    x7 = conv(7, q.plus(x3, x6))
    return q.long(q.plus(conv(8, x7), x5))


@query(_sql(_branching_sql))
def branching_net(s, d):
    return _run(s, d, models.branching_net(WIDTH, 8))


@query(_sql(_branching_sql))
def traced_branching_net(s, d):
    return _long(_flow(s, d, trace.trace(forwards.branching_net(8), WIDTH))[0])


_RELATIONS = [("customer", "places", "order"), ("order", "contains", "part"), ("supplier", "supplies", "part")]


def _rgcn_sql(q: Sql, layers: int) -> str:
    q.typed()
    t, width = "tx", 8
    for layer in range(layers):
        parts = []
        for k, (s, e, d) in enumerate(_RELATIONS):
            w = q.linear(f"(SELECT * FROM {t} WHERE ntype = '{s}')", layer * 10 + k, width, bias=layer * 10 + k)
            r = q.new(f"SELECT dst AS id, i, avg(v) AS v FROM tedges JOIN {w} w ON w.id = src WHERE etype = '{e}' GROUP BY dst, i")
            parts.append(f"SELECT '{d}' AS ntype, id, i, v FROM {r}")
        z = q.new(f"SELECT ntype, id, i, sum(v) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL")
        t = q.new(f"SELECT n.ntype, n.id, k.i::INTEGER AS i, coalesce(CASE WHEN v >= 0 OR {int(layer == layers - 1)} = 1 THEN v ELSE v * 0.01::DOUBLE END, 0.0) AS v FROM tids n CROSS JOIN range({width}) k(i) LEFT JOIN {z} z ON z.ntype = n.ntype AND z.id = n.id AND z.i = k.i")
    return q.long(t, "ntype, id")


@query(_sql(lambda q: _rgcn_sql(q, 2)))
def rgcn_2layer(s, d):
    return _long(_typed_flow(s, d, forwards.rgcn([WIDTH, 8, 8])), "ntype", "id")


@query(_sql(lambda q: _rgcn_sql(q, 2)))
def rgcn_typed_layers(s, d):
    """The same model as a list of layers over one edge table and one node table."""
    return _long(typed.run(models.rgcn(_RELATIONS, [WIDTH, 8, 8]), tables.typed_edges(s, d), tables.typed_nodes(s, d)), "ntype", "id")


@query(_sql(lambda q: _rgcn_sql(q, 2) + " WHERE ntype = 'part' AND id IN (SELECT p_partkey FROM part WHERE p_size = 1)"))
def rgcn_targets(s, d):
    """The two-layer model for stated parts only: each layer runs over the nodes that the later ones need."""
    targets = tables.table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return _long(_typed_flow(s, d, forwards.rgcn([WIDTH, 8, 8]), targets), "ntype", "id")


def _rgcn_basis_sql(q: Sql) -> str:
    q.typed()
    q.add("w", f"SELECT r, i, j, sum((((31 * r + 17 * b + 21) % 13 - 6) / 16.0::DOUBLE) * (((31 * i + 17 * j + 7 * (4 + b)) % 13 - 6) / 16.0::DOUBLE)) AS w FROM range(3) q(r), range({WIDTH}) a(i), range(8) c(j), range(2) e(b) GROUP BY r, i, j")
    loop = q.linear("tx", 2, 8, bias=2, keys="ntype, id")
    parts = [f"SELECT ntype, id, i, v FROM {loop}"]
    for k, (s, e, d) in enumerate(_RELATIONS):
        m = q.new(f"SELECT id, j::INTEGER AS i, sum(v * w.w) AS v FROM tx JOIN w ON w.i = tx.i AND w.r = {k} WHERE ntype = '{s}' GROUP BY id, j")
        parts.append(f"SELECT '{d}' AS ntype, dst AS id, i, avg(v) AS v FROM tedges JOIN {m} m ON m.id = src WHERE etype = '{e}' GROUP BY dst, i")
    z = q.new(f"SELECT ntype, id, i, greatest(sum(v), 0.0) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL")
    return q.long(z, "ntype, id")


@query(_sql(_rgcn_basis_sql))
def rgcn_basis_layer(s, d):
    return _long(_typed_flow(s, d, forwards.rgcn_basis(8, 2)), "ntype", "id")


def _hgt_sql(q: Sql, layers: int = 1) -> str:
    q.typed()
    hidden = q.linear("tx", 50, 8, by=256.0, keys="ntype, id")
    for layer in range(layers):
        hidden = _hgt_layer_sql(q, hidden, 100 * layer)
    return q.long(hidden, "ntype, id")


def _hgt_layer_sql(q: Sql, hidden: str, at: int) -> str:
    types, hd = ["customer", "order", "part", "supplier"], 4
    kqv = {}
    for t, ntype in enumerate(types):
        own = q.new(f"SELECT id, i, v FROM {hidden} WHERE ntype = '{ntype}'")
        kqv[ntype] = (own, *(q.linear(own, at + 3 * t + i, 8, by=64.0) for i in range(3)))
    done = []
    for t, ntype in enumerate(types):
        own, into = kqv[ntype][0], [(r, s, e) for r, (s, e, d) in enumerate(_RELATIONS) if d == ntype]
        if not into:
            done.append(f"SELECT '{ntype}' AS ntype, id, i, v FROM {own}")
            continue
        parts = []
        for r, s, e in into:
            maps = [q.new(f"SELECT id, (i // {hd} * {hd} + j)::INTEGER AS i, sum(v * (((31 * (i % {hd}) + 17 * j + 7 * ({at + 40 + 2 * r + n} + 7 * (i // {hd}))) % 13 - 6) / 16.0::DOUBLE)) AS v FROM {kqv[s][c]}, range({hd}) x(j) GROUP BY id, i // {hd} * {hd} + j") for n, c in ((0, 1), (1, 3))]
            dots = q.new(f"SELECT k.id AS src, q.id AS dst, k.i // {hd} AS h, sum(k.v * q.v) / 2.0 AS s FROM (SELECT DISTINCT src, dst FROM tedges WHERE etype = '{e}') e JOIN {maps[0]} k ON k.id = e.src JOIN {kqv[ntype][2]} q ON q.id = e.dst AND q.i = k.i GROUP BY k.id, q.id, k.i // {hd}")
            full = q.new(f"SELECT e.src, e.dst, h, s FROM (SELECT src, dst FROM tedges WHERE etype = '{e}') e JOIN {dots} s ON s.src = e.src AND s.dst = e.dst")
            x = q.new(f"SELECT *, exp(s - max(s) OVER (PARTITION BY dst, h)) AS e FROM {full}")
            a = q.new(f"SELECT src, dst, h, e / sum(e) OVER (PARTITION BY dst, h) AS a FROM {x}")
            o = q.new(f"SELECT dst AS id, i, sum(v * a) AS v FROM {a} JOIN {maps[1]} u ON u.id = src AND u.i // {hd} = h GROUP BY dst, i")
            parts.append(f"SELECT n.id, n.i, coalesce(o.v, 0.0) AS v FROM {own} n LEFT JOIN {o} o ON o.id = n.id AND o.i = n.i")
        agg = q.new(f"SELECT id, i, avg(v) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY id, i")
        y = q.linear(agg, at + 30 + t, 8, by=64.0)
        alpha = "(1 / (1 + exp(-0.5::DOUBLE)))"
        mixed = q.new(f"SELECT y.id, y.i, y.v * {alpha} + x.v * (1 - {alpha}) AS v FROM {y} y JOIN {own} x ON x.id = y.id AND x.i = y.i")
        done.append(f"SELECT '{ntype}' AS ntype, id, i, (v - avg(v) OVER (PARTITION BY id)) / sqrt(var_pop(v) OVER (PARTITION BY id) + 1e-5) AS v FROM {mixed}")
    return q.new(" UNION ALL ".join(done))


def _hgt(s: SparkSession, d: str, layers: int, **options) -> DataFrame:
    """The features are projected to the hidden width first."""
    return _long(_typed_flow(s, d, forwards.hgt(8, 2, layers, **options), width=8), "ntype", "id")


@query(_sql(_hgt_sql))
def hgt_layer(s, d):
    return _hgt(s, d, 1)


@query(_sql(lambda q: _hgt_sql(q, 2)))
def hgt_2layer(s, d):
    return _hgt(s, d, 2)


@query(_sql(lambda q: (a := q.relu(q.plus(q.linear("x", 0, 16, bias=0), q.reduce(q.linear("x", 1, 16), "avg", "bi"))), b := q.plus(q.linear(a, 2, 8, bias=1), q.reduce(q.linear(a, 3, 8), "avg", "bi")), q.text(f"SELECT id, i::INTEGER AS i, round(v + {SHIFT}, 6) + 0.0 AS v FROM {b} WHERE id IN (SELECT p_partkey FROM part WHERE p_size = 1)"))[-1]))
def sage_targets(s, d):
    """The two-layer model for stated target nodes only: each layer runs over the nodes that the later ones need."""
    targets = tables.table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return _long(_flow(s, d, trace.trace(forwards.sage([WIDTH, 16, 8]), WIDTH), targets=targets)[0])


@query(_sql(lambda q: (q.add("f", "SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY md5('0:' || src || ':' || dst), src) AS k FROM bi) WHERE k <= 10"), q.long(q.plus(q.linear("x", 0, 8, bias=0), q.reduce(q.linear("x", 1, 8), "avg", "f"))))[-1]))
def sage_fanout(s, d):
    plan, start = models.sage([WIDTH, 8])
    nodes = tables.nodes(s, d, WIDTH).select("id", "x")
    return _long(plan.run(L.Graph(graph.fan_out(_bi(s, d), 10), nodes.select("id")), {start: nodes}, keep=None)[0])


@query(_sql(lambda q: (q.typed(), q.text("""SELECT 'edges ' || etype AS name, count(*) AS rows FROM tedges GROUP BY etype UNION ALL SELECT 'features ' || ntype, count(*) FROM tids GROUP BY ntype
    UNION ALL SELECT 'order h', count(*) * 2 FROM tids WHERE ntype = 'order' UNION ALL SELECT 'edges weighed', sum(src % 7)::BIGINT FROM tedges WHERE etype = 'supplies'"""))[-1]))
def stage_measures(s, d):
    """What the stages of the typed model wrote, as observed while they ran: rows by table, and a counter of its own."""
    supplies = ("supplier", "supplies", "part")
    store = StageStore(s, counters={f"edges {supplies} by src": {"weighed": F.sum(F.col("src") % 7)}})
    _typed_flow(s, d, forwards.rgcn([WIDTH, 8, 8]), store=store)
    found = []
    for m in store.measures:
        if m["name"].startswith("edges"):
            found.append((f"edges {m['name'].split(', ')[1][1:-1]}" if "'" in m["name"] else m["name"], m["rows"]))
        elif m["name"].startswith("features"):
            found.append((m["name"], m["rows"]))
    orders = next(m["rows"] for m in store.measures if m["name"] == "features order")
    layers = [m["rows"] for m in store.measures if m["rows"] == orders and not m["name"].startswith(("features", "edges", "placed", "cells"))]
    found += [("order h", sum(layers)), ("edges weighed", next(m["weighed"] for m in store.measures if "weighed" in m))]
    return s.createDataFrame(found, "name string, rows long")


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, event_type AS dst, count(user_id) AS degree, round(sum(value), 4) AS weight FROM events GROUP BY ALL")
def windowed_degree(s, d):
    return degrees.windowed_degrees(tables.table(s, d, "events")).withColumn("weight", F.round("weight", 4))


@query(_sql(lambda q: q.text(f"SELECT id, predicted FROM (SELECT id, (arg_min(i, (-v, i)))::INTEGER AS predicted FROM (SELECT id, i, round(v + {SHIFT}, 6) + 0.0 AS v FROM " + q.relu(q.plus(q.linear("x", 0, 10, bias=0), q.reduce(q.linear("x", 1, 10), "avg", "bi"))) + ") GROUP BY id)")))
def node_classes(s, d):
    """The flagship: one layer over the whole graph, then the class of each node."""
    plan, start = models.sage([WIDTH, 10])
    nodes = tables.nodes(s, d, WIDTH).select("id", "x")
    out = plan.run(L.Graph(_bi(s, d), nodes.select("id")), {start: nodes}, keep=None)[0]
    return models.predictions(out.select("id", V.mapped(V.relu("x"), lambda v: F.round(v + SHIFT, 6) + 0.0).alias("x")))
