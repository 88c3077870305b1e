"""The plan of many random pyramids at once, against a plan made step by step for each."""

import random

WINDOWED = "session_id string, head long, tail long"


class Pyramid:
    def __init__(self, draw):
        n, self.k = draw.randint(1, 13), draw.choice([2, 3])
        self.raw = [draw.randint(5, 60) for _ in range(n)]
        self.salience = [draw.choice([0.2, 0.5, 0.5, 1.0]) for _ in range(n)]
        self.cap = [draw.choice([0, 1, 2, 3]) for _ in range(n)]
        have, self.nodes, self.up = draw.randint(0, n), {}, {}
        level = 1
        while have:
            for i in range(have):
                self.nodes[level, i] = draw.randint(1, 40)
                for j in [i] if level == 1 else range(i * self.k, i * self.k + self.k):
                    self.up[level - 1, j] = (level, i)
            level, have = level + 1, max(0, have // self.k - draw.choice([0, 0, 1]))
        self.top = level - 1
        self.head, self.tail = draw.choice([(0, 0), (10, 20), (-30, 15), (5, -60)])
        self.window = draw.choice([30, 80, 150, 300])
        self.target = round(self.window * draw.choice([0.7, 0.9, 1.0]))
        self.reach = draw.choice([0, 20, 60, 1000])
        self.carried = [draw.choice([0, 0, 1, 2, 3]) for _ in range(n)]

    def at(self, chunk, level):
        node = (0, chunk)
        while node and node[0] < level:
            node = self.up.get(node)
        return node if level else None

    def under(self, node):
        return [c for c in range(len(self.raw)) if self.at(c, node[0]) == node]

    def units(self, cut):
        out = {}
        for c, level in enumerate(cut):
            node = self.at(c, level)
            out.setdefault(node or ("raw", c), self.nodes[node] if node else self.raw[c])
        return list(out.items())

    def shown(self, cut):
        return [("head", self.head)] * (self.head > 0) + self.units(cut) + [("tail", self.tail)] * (self.tail > 0)

    def size(self, cut):
        return sum(t for _, t in self.shown(cut))

    def total(self, cut):
        return self.head + self.tail + sum(t for _, t in self.units(cut))

    def ideal(self):
        cut, before = [0] * len(self.raw), None
        order = sorted(range(len(cut)), key=lambda c: (self.salience[c], c))
        for _ in range(3):
            for beyond in (False, True):
                if beyond and self.total(cut) <= self.window:
                    continue
                for level in range(1, self.top + 1):
                    for c in order:
                        node = self.at(c, level)
                        if self.total(cut) > self.target and cut[c] < level and node and (beyond or min(self.cap[x] for x in self.under(node)) >= level):
                            for x in self.under(node):
                                cut[x] = level
            for level in range(self.top, 0, -1):
                for node in dict.fromkeys(self.at(c, level) for c in reversed(range(len(cut))) if cut[c] == level):
                    now = self.total(cut)
                    trial = [level - 1 if self.at(x, level) == node else was for x, was in enumerate(cut)]
                    then = self.total(trial)
                    if now < self.target and then <= self.window and abs(then - self.target) < abs(now - self.target):
                        cut = trial
            now = self.size(cut)
            if now <= self.window or (before is not None and now >= before):
                break
            before = now
        return cut

    def project(self, cut):
        cut = list(cut)
        while True:
            before = list(cut)
            for c in sorted(range(len(cut)), key=lambda c: -before[c]):
                if cut[c] and not ((node := self.at(c, cut[c])) and all(cut[x] == cut[c] for x in self.under(node))):
                    cut[c] -= 1
            if cut == before:
                return cut

    def cost(self, before, after):
        a, b = self.shown(before), self.shown(after)
        same = 0
        while same < min(len(a), len(b)) and a[same][0] == b[same][0]:
            same += 1
        return sum(t for _, t in b[same:])

    def loss(self, cut):
        return sum(s * max(0, level - cap) for s, level, cap in zip(self.salience, cut, self.cap, strict=True))

    def plan(self, gap):
        ideal, now = self.ideal(), self.project(self.carried)
        near = lambda cut: self.loss(cut) - self.loss(ideal) <= gap * max(1, self.loss(ideal)) + 1e-9
        bare = sum((1, c) not in self.nodes for c in range(len(self.raw)))
        over = self.size(ideal) > self.window
        told = lambda name, cut, cost, escalated: (cut, (name, self.size(cut), cost, round(self.loss(cut), 6), escalated, bare if escalated else 0))
        if self.target <= self.size(now) <= self.window and near(now):
            return told("hold", now, 0, False)
        if (cost := self.cost(now, ideal)) <= self.reach:
            return told("ideal", ideal, cost, over)
        places = [c for c in range(len(now)) if now[c] != ideal[c]]
        low, high = 0, len(places)
        part = lambda i: self.project([ideal[c] if i < len(places) and c >= places[i] else now[c] for c in range(len(now))])
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cost(now, part(middle)) <= self.reach else (middle + 1, high)
        tried = part(low)
        if self.size(tried) <= self.window and near(tried):
            return told("suffix", tried, self.cost(now, tried), False)
        return told("infeasible" if self.size(tried) > self.window else "quality-gap", ideal, cost, over)


def test_plans(spark):
    from convlake import planning

    draw = random.Random(11)
    some = {f"s{i}": Pyramid(draw) for i in range(400)}
    rows = lambda f: [(s, *r) for s, p in some.items() for r in f(p)]
    chunks = spark.createDataFrame(rows(lambda p: list(zip(range(len(p.raw)), p.raw, p.salience, p.cap, strict=True))), "session_id string, chunk_id long, raw long, salience double, cap int")
    memories = spark.createDataFrame(rows(lambda p: [(level, i, i, i, "", t) for (level, i), t in p.nodes.items()]), "session_id string, level int, id long, first long, last long, text string, tokens long")
    edges = spark.createDataFrame(rows(lambda p: [(up[0], up[1], below[1]) for below, up in p.up.items()]), "session_id string, level int, id long, member long")
    carried = spark.createDataFrame(rows(lambda p: list(enumerate(p.carried))), "session_id string, chunk_id long, level int")
    budgets = spark.createDataFrame(rows(lambda p: [(p.window, p.target, p.reach)]), "session_id string, window long, target long, reach long")
    windows = spark.createDataFrame(rows(lambda p: [(p.head, p.tail)]), WINDOWED)
    want = {s: p.plan(0.35) for s, p in some.items()}
    ideal = planning.ideal_cut(chunks, memories, edges, budgets, windows)
    cuts = {}
    for r in ideal.collect():
        cuts.setdefault(r.session_id, {})[r.chunk_id] = r.level
    for s, p in some.items():
        assert [cuts[s][c] for c in range(len(p.raw))] == p.ideal(), s
    cut, told = planning.plan(chunks, memories, edges, carried, budgets, 0.35, windows)
    got = {s: [0] * len(p.raw) for s, p in some.items()}
    for r in cut.collect():
        got[r.session_id][r.chunk_id] = r.level
    how = {r.session_id: (r.branch, r.tokens, r.cost, round(r.loss, 6), r.escalated, r.demanded) for r in told.collect()}
    assert {h[0] for h in how.values()} == {"hold", "ideal", "suffix", "infeasible", "quality-gap"}
    assert how == {s: w[1] for s, w in want.items()}
    assert got == {s: w[0] for s, w in want.items()}


def test_adoption_searches_as_its_sql_does(spark, tmp_path):
    """what a switch re-reads doesn't fall with every boundary, so a binary search and the least of all boundaries differ."""
    import duckdb

    from convlake.queries import ORACLES, QUERIES

    db, source = duckdb.connect(), "/root/testdata/sf0.01/conversations.parquet"
    # pairs of conversations as one, of seven chunks and three levels at most
    paired = f"SELECT conv_id // 2 AS conv_id, (row_number() OVER (PARTITION BY conv_id // 2 ORDER BY conv_id, turn) - 1)::BIGINT AS turn, role, text FROM '{source}'"
    db.sql(f"CREATE TABLE conversations AS SELECT * FROM ({paired}) WHERE turn < 14")
    db.sql(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    want = sorted((r[0], int(r[1]), int(r[2])) for r in db.sql(f"SELECT session_id, chunk_id, level FROM ({ORACLES['k11_suffix_adopt']})").fetchall())
    got = sorted((r.session_id, r.chunk_id, r.level) for r in QUERIES["k11_suffix_adopt"](spark, str(tmp_path)).collect())
    assert got == want


def test_meeting_looks_ahead_in_one_pass(spark):
    """a frame that ends with its session is summed anew for each of its rows, so a long session was quadratic in one task."""
    from convlake.plans import meeting

    chunks = spark.range(300).selectExpr("'s' AS session_id", "id AS chunk_id", "id * 4 AS first", "id * 4 + 3 AS last")
    ranges = spark.range(90).selectExpr("'s' AS session_id", "id * 9 AS at", "id * 9 + id % 3 - 1 AS end")
    found = meeting(chunks, ranges)
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    spans = [(i * 9, i * 9 + i % 3 - 1) for i in range(90) if i % 3]
    assert sorted(r.chunk_id for r in found.collect()) == [c for c in range(300) if any(a <= c * 4 + 3 and b >= c * 4 for a, b in spans)]
