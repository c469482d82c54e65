"""Building blocks of the DuckDB statements that the graph queries are held against. Vectors are in long form (id, i, v)."""

from __future__ import annotations

#: All features of a node.
WIDTH = 64
#: Added before rounding to six places, on both sides.
SHIFT = 1.3e-8


class Sql:
    """Named subqueries in order; text() ends them with a last SELECT."""

    def __init__(self, width: int = WIDTH) -> None:
        self.parts: list[tuple[str, str]] = []
        self.add("np", "SELECT count(*) AS n FROM part")
        self.add("ne", "SELECT count(*) AS n FROM embeddings")
        self.add("raw", "SELECT l_suppkey + (SELECT n FROM np) AS src, l_partkey AS dst FROM lineitem")
        self.add("edges", "SELECT DISTINCT src, dst FROM raw")
        self.add("bi", "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
        self.add("ids", "SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + (SELECT n FROM np) FROM supplier")
        self.add("feat", f"SELECT vec_id, (j - 1)::INTEGER AS i, round(embedding[j]::DOUBLE * 1024) / 1024 AS v FROM embeddings, range(1, {width + 1}) r(j)")
        self.add("x", "SELECT ids.id, i, v FROM ids JOIN feat ON vec_id = id % (SELECT n FROM ne)")
        self.n = 0

    def add(self, name: str, sql: str) -> str:
        self.parts.append((name, sql))
        return name

    def new(self, sql: str) -> str:
        self.n += 1
        return self.add(f"t{self.n}", sql)

    def text(self, last: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in self.parts) + "\n" + last

    def long(self, t: str, ids: str = "id") -> str:
        return self.text(f"SELECT {ids}, i::INTEGER AS i, round(v + {SHIFT}, 6) + 0.0 AS v FROM {t}")

    def linear(self, t: str, layer: int, cols: int, bias: int | None = None, by: float = 16.0, keys: str = "id") -> str:
        plus = f" + ((5 * j + {3 * bias}) % 7 - 3) / 16.0::DOUBLE" if bias is not None else ""
        return self.new(f"SELECT {keys}, j::INTEGER AS i, sum(v * (((31 * i + 17 * j + {7 * layer}) % 13 - 6) / {by}::DOUBLE)){plus} AS v FROM {t}, range({cols}) r(j) GROUP BY {keys}, j")

    def map(self, t: str, expr: str, keys: str = "id") -> str:
        return self.new(f"SELECT {keys}, i, {expr} AS v FROM {t}")

    def relu(self, t: str) -> str:
        return self.map(t, "greatest(v, 0.0)")

    def plus(self, *ts: str) -> str:
        return self.new(f"SELECT id, i, sum(v) AS v FROM ({' UNION ALL '.join(f'SELECT id, i, v FROM {t}' for t in ts)}) GROUP BY id, i")

    def reduce(self, t: str, how: str, edges: str, fill: bool = True) -> str:
        r = self.new(f"SELECT dst AS id, i, {how}(v) AS v FROM {edges} JOIN {t} ON src = {t}.id GROUP BY dst, i")
        return self.fill(r, t) if fill else r

    def fill(self, r: str, like: str) -> str:
        return self.new(f"SELECT ids.id, k.i, coalesce(r.v, 0.0) AS v FROM ids CROSS JOIN (SELECT DISTINCT i FROM {like}) k LEFT JOIN {r} r ON r.id = ids.id AND r.i = k.i")

    def conv(self, t: str, edges: str, norm: str = "both") -> str:
        dout = self.new(f"SELECT src AS id, count(*) AS c FROM {edges} GROUP BY src")
        din = self.new(f"SELECT dst AS id, count(*) AS c FROM {edges} GROUP BY dst")
        if norm == "both":
            t = self.new(f"SELECT t.id, i, v / sqrt(coalesce(c, 1)) AS v FROM {t} t LEFT JOIN {dout} d ON d.id = t.id")
        s = self.reduce(t, "sum", edges)
        by = {"both": "sqrt(coalesce(c, 1))", "right": "coalesce(c, 1)", "none": "1"}[norm]
        return self.new(f"SELECT t.id, i, v / {by} AS v FROM {s} t LEFT JOIN {din} d ON d.id = t.id")

    def typed(self, width: int = WIDTH) -> None:
        """tedges(src_type, etype, dst_type, src, dst), tids(ntype, id) and tx(ntype, id, i, v)."""
        self.add("tedges", """SELECT 'customer' AS src_type, 'places' AS etype, 'order' AS dst_type, o_custkey AS src, o_orderkey AS dst FROM orders
            UNION ALL SELECT 'order', 'contains', 'part', l_orderkey, l_partkey FROM lineitem UNION ALL SELECT 'supplier', 'supplies', 'part', l_suppkey, l_partkey FROM lineitem""")
        self.add("tids", """SELECT 'customer' AS ntype, c_custkey::BIGINT AS id FROM customer UNION ALL SELECT 'order', o_orderkey FROM orders
            UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier""")
        self.add("tx", f"SELECT ntype, id, i, v FROM tids JOIN feat ON vec_id = id % (SELECT n FROM ne) WHERE i < {width}")
