"""Queries that once covered part of their tables, over whole ones, against brute force."""

import math
import os
import statistics
from collections import Counter, defaultdict

import pytest

from boreal.operators import fleet, graph, grid, site
from boreal.plans.queries import QUERIES, travel
from boreal.sources.fixtures import source

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def greedy(tasks, shifts, minutes):
    """The planner of fleet.schedule pair by pair. tasks: task_id -> (node, release, due, duration, prio, ms); shifts: (day, op, home, start, end, ms)."""
    place, way, owner, open_, out = {o: h for _, o, h, *_ in sorted(shifts, reverse=True)}, {}, {}, set(tasks), []
    days = defaultdict(list)
    for day, o, _, start, end, ms in sorted(shifts):
        days[day].append((o, start, end, ms))
    for day, ops in sorted(days.items()):
        left, clock, has, busy = {o: float(e - s) for o, s, e, _ in ops}, {o: float(s) for o, s, *_ in ops}, {o: m for o, *_, m in ops}, set()
        value = {k: t[4] * (1 + 3 / (1 + t[2] - day) if t[2] >= day else 4 + 0.5 * min(day - t[2], 10)) for k, t in tasks.items()}

        def travel_on(o):
            task, rest = way.pop(o)
            go = min(rest, left[o])
            left[o] -= go
            clock[o] += go
            if rest - go <= 1e-6:
                place[o] = tasks[task][0]
            else:
                way[o], left[o] = (task, rest - go), 0

        for o in [o for o, *_ in ops if o in way]:
            travel_on(o)
        active = [o for o, *_ in ops if o not in way and left[o] > 0]
        while active:
            seen = [k for k in sorted(open_) if tasks[k][1] <= day]
            waiting, best = any(tasks[k][5] for k in seen), None
            for o in active:
                for k in seen:
                    node, _, _, duration, _, ms = tasks[k]
                    need = minutes[place[o], node] + duration
                    if need <= left[o] and (has[o] or not ms) and owner.get(k, o) == o:
                        score = value[k] * 100 / (need + 30) * (0.6 if has[o] and not ms and waiting else 1) * (3 if owner.get(k) == o else 1)
                        if best is None or score > best[0]:
                            best = (score, o, k, need)
            if best is None:
                break
            _, o, k, need = best
            out.append((day, o, k, clock[o] + need - tasks[k][3], need - tasks[k][3], tasks[k][3]))
            left[o] -= need
            clock[o] += need
            place[o] = tasks[k][0]
            owner.pop(k, None)
            open_.discard(k)
            busy.add(o)
            active = [o for o in active if left[o] > fleet.RETIRE_MIN]
        for o, *_ in ops:
            if o in busy or o in way or left[o] <= 0:
                continue
            free = [k for k in sorted(open_) if k not in owner and tasks[k][1] <= day + 2 and (has[o] or not tasks[k][5])]
            if free:
                k = max(free, key=lambda k: (value[k] / (minutes[place[o], tasks[k][0]] + tasks[k][3] + 60), -k))
                owner[k], way[o] = o, (k, minutes[place[o], tasks[k][0]])
                travel_on(o)
    return out


@pytest.mark.parametrize("seed,far", [(0, 1), (1, 8), (2, 30)])
def test_schedule_is_the_greedy_plan(spark, seed, far):
    """far: travel long enough for reservations and days under way."""
    import random

    rng = random.Random(seed)
    tasks = {k: (rng.randrange(6), rng.randrange(5), rng.randrange(9), float(rng.randrange(20, 200)), float(rng.choice([1, 2, 3])), rng.random() < 0.3) for k in range(90)}
    shifts = [(d, o, o, 480, 960, o % 2 == 0) for d in range(7) for o in range(4)]
    minutes = {(a, b): float(0 if a == b else far * rng.randrange(10, 60)) for a in range(6) for b in range(6)}
    t = spark.createDataFrame([("s", k, *v) for k, v in tasks.items()], "scenario string, task_id long, node_id long, release int, due int, duration double, prio double, needs_ms boolean")
    s = spark.createDataFrame([("s", *x) for x in shifts], "scenario string, day int, op_id long, home long, start int, end int, has_ms boolean")
    m = spark.createDataFrame([("s", a, b, x) for (a, b), x in minutes.items()], "scenario string, from long, to long, minutes double")
    got = [tuple(r)[1:] for r in fleet.schedule(t, s, m).collect()]
    want = greedy(tasks, shifts, minutes)
    assert want and [x[:3] for x in got] == [x[:3] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


def test_fleet_plan_takes_every_task_and_operator(spark, tmp_path):
    """120 orders, few of them with an id that 50 divides; 25 operators."""
    for name in ("nation", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").orderBy("n_nationkey" if name == "nation" else "o_orderkey").limit(120).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    links = {(r.f, r.t): r.minutes for r in QUERIES["travel_matrix"](spark, str(tmp_path)).collect()}
    known = {(r["from"], r["to"]): r.minutes for r in travel(spark, str(tmp_path)).collect()}
    minutes = {k: known.get(k, x) for k, x in links.items()}
    rows = source(spark, str(tmp_path), "v_tasks").selectExpr("*", "datediff(release_d, DATE '1995-01-01') % 20 AS late").collect()
    shifts = [(d, o, o, 480, 960, o % 3 == 0) for d in range(30) for o in range(25)]
    got = {r.scenario: r for r in QUERIES["fleet_plan"](spark, str(tmp_path)).collect()}
    assert set(got) == {"none", "emergency", "uniform"}
    for scenario, r in got.items():
        prio = lambda x: 12.0 if scenario == "emergency" and x.task_id % 300 == 0 else 3.0 if scenario == "uniform" else x.prio  # noqa: B023, E731
        tasks = {x.task_id: (x.node_id, x.late, x.late + 3 + x.task_id % 7, float(x.setup_min + x.flight_min), prio(x), x.needs_ms) for x in rows}
        plan = greedy(tasks, shifts, minutes)
        assert r.n_tasks == len(rows) == 120 and r.n_done == len(plan)
        assert r.on_time == pytest.approx(sum(p[0] <= tasks[p[2]][2] for p in plan) / len(plan))
        assert r.mean_late == pytest.approx(sum(max(0, p[0] - tasks[p[2]][2]) for p in plan) / len(plan))
        assert r.travel_share == pytest.approx(sum(p[4] for p in plan) / sum(p[4] + p[5] for p in plan), abs=1e-6)


def wired(points, segments, near=2.5):
    ground = statistics.median(p.z for p in points if p.cls == 2)

    def d(p, s):
        dx, dy = s.bx - s.ax, s.by_ - s.ay
        t = max(0, min(1, ((p.x - s.ax) * dx + (p.y - s.ay) * dy) / max(dx * dx + dy * dy, 1e-9)))
        return math.hypot(p.x - s.ax - t * dx, p.y - s.ay - t * dy)

    hit = lambda p: p.cls not in (2, 9) and 4 < p.z - ground < 40 and any(d(p, s) <= near for s in segments)
    return Counter(14 if hit(p) else p.cls for p in points)


def test_wire_labels_of_all_points(spark):
    points = source(spark, SF, "v_points").select("x", "y", "z", "cls").collect()
    got = {r.cls: r.n for r in QUERIES["wire_labels"](spark, SF).collect()}
    assert got == wired(points, source(spark, SF, "v_segments").collect())
    assert sum(got.values()) == len(points)


def test_water_and_ground_stay_where_a_wire_point_lies_too(spark):
    p = spark.createDataFrame([(5.0, 0.0, 100.0, 2), (5.0, 1.0, 110.0, 5), (5.0, 1.0, 110.0, 9), (5.0, 1.0, 110.0, 2), (5.0, 9.0, 110.0, 5), (6.0, 0.0, 100.0, 2)], "x double, y double, z double, cls int")
    s = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0)], "seg_id int, ax double, ay double, bx double, by_ double")
    assert Counter(r.cls for r in site.label_wires(p, s).collect()) == {2: 3, 9: 1, 14: 1, 5: 1}


def test_bands_of_all_lines(spark):
    def row(r):
        v, q = r.l_extendedprice / 10, r.l_quantity
        level = lambda x, medium, high: "high" if x >= high else "medium" if x >= medium else "low"
        danger = ("low", "moderate", "high", "very high", "extreme")[sum(q >= b for b in (5, 10, 20, 30))]
        return r.l_orderkey, r.l_linenumber, sum(v >= b for b in (10, 500, 2000, 4000, 10000)), danger, level(q, 25, 50), level(q / 50, 0.35, 0.55)

    want = Counter(map(row, source(spark, SF, "lineitem").collect()))
    got = {(r.k, r.n, r.intensity, r.danger, r.route, r.structure): r.c for r in QUERIES["bands"](spark, SF).collect()}
    assert got == want


def test_cell_lookup_of_all_points(spark):
    top = {(r.iy, r.ix): r.z_max for r in source(spark, SF, "v_cells").collect()}
    count, below = Counter(), Counter()
    for p in source(spark, SF, "v_points").collect():
        count[p.src_key, p.ret_no] += 1
        below[p.src_key, p.ret_no] += p.z - top[max(0, min(40, int(p.y / 5))), max(0, min(40, int(p.x / 5)))]
    got = {(r.src_key, r.ret_no): (r.c, r.below) for r in QUERIES["cell_lookup"](spark, SF).collect()}
    assert got == {k: (n, below[k]) for k, n in count.items()}


def labelled(cells, nx=64):
    """(iy, ix) -> the least id of its 4-connected region, by flood fill."""
    rest, out = set(cells), {}
    while rest:
        todo = [rest.pop()]
        region = set(todo)
        while todo:
            y, x = todo.pop()
            near = {(y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)} & rest
            rest -= near
            region |= near
            todo += near
        out |= dict.fromkeys(region, min(y * nx + x for y, x in region))
    return out


def test_regions_of_all_cells(spark):
    mask = {(r.iy, r.ix) for r in source(spark, SF, "v_cells").collect() if r.z_max > 118}
    assert any(y >= 20 or x >= 20 for y, x in mask)
    assert {(r.iy, r.ix): r.label for r in QUERIES["regions"](spark, SF).collect()} == labelled(mask)


def test_label_cells_of_scattered_regions(spark):
    import random

    rng = random.Random(4)
    mask = {(y, x) for y in range(25) for x in range(30) if rng.random() < 0.55}
    got = graph.label_cells(spark.createDataFrame(sorted(mask), "iy int, ix int"), 64).collect()
    want = labelled(mask)
    assert len(set(want.values())) > 10 and {(r.iy, r.ix): r.label for r in got} == want


def nearest(cells, mask, res):
    return {(y, x): res * math.sqrt(min((y - b) ** 2 + (x - a) ** 2 for b, a in mask)) for y, x in cells}


def test_distance_map_of_all_cells(spark):
    cells = source(spark, SF, "v_cells").collect()
    veg = sorted(r.n_veg for r in cells)
    at = 0.9 * (len(veg) - 1)
    cut = veg[int(at)] + (at - int(at)) * (veg[math.ceil(at)] - veg[int(at)])
    want = nearest([(r.iy, r.ix) for r in cells], [(r.iy, r.ix) for r in cells if r.n_veg >= cut], 5.0)
    got = {(r.iy, r.ix): r.distance for r in QUERIES["distance_map"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("share,holes", [(0.002, 0.0), (0.02, 0.4), (0.5, 0.2)])
def test_distance_far_from_a_sparse_mask(spark, share, holes):
    """Cells may be missing; negative ids occur."""
    import random

    rng = random.Random(5)
    cells = [(y - 20, x - 7) for y in range(45) for x in range(60) if rng.random() >= holes]
    mask = {c for c in cells if rng.random() < share} | {cells[3]}
    t = spark.createDataFrame([(*c, c in mask) for c in cells], "iy int, ix int, m boolean")
    got = {(r.iy, r.ix): r.distance for r in grid.distance_to(t, "m", 2.0).collect()}
    assert got == pytest.approx(nearest(cells, mask, 2.0))


def test_distance_without_a_mask(spark):
    t = spark.createDataFrame([(0, 0, False), (0, 1, None)], "iy int, ix int, m boolean")
    assert [r.distance for r in grid.distance_to(t, "m", 2.0).collect()] == [1000.0, 1000.0]


def rows_to_plans(monkeypatch):
    """A list that gets the number of rows of tasks each time that plans are made."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    sent, run = [], PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda ops, *x: sent.append(ops._gd1._df.count()) or run(ops, *x))
    return sent


@pytest.mark.parametrize("depth", [1, 3, 64])
def test_schedule_of_many_tasks_of_few_kinds(spark, monkeypatch, depth):
    """The plan's task gets the first tasks of each kind, and more of them when it has used those up; tasks whose prio is not above 0 stay as they are."""
    import random

    rng = random.Random(8)
    tasks = {k: (rng.randrange(3), rng.randrange(2), 3 + rng.randrange(2), float(rng.randrange(40, 90)), float(rng.choice([1, 3, 3, 0])), rng.random() < 0.2) for k in range(900)}
    shifts = [(d, o, o, 480, 960, o == 0) for d in range(5) for o in range(3)]
    minutes = {(a, b): float(0 if a == b else rng.randrange(100, 700)) for a in range(3) for b in range(3)}
    t = spark.createDataFrame([("s", k, *v) for k, v in tasks.items()], "scenario string, task_id long, node_id long, release int, due int, duration double, prio double, needs_ms boolean")
    s = spark.createDataFrame([("s", *x) for x in shifts], "scenario string, day int, op_id long, home long, start int, end int, has_ms boolean")
    m = spark.createDataFrame([("s", a, b, x) for (a, b), x in minutes.items()], "scenario string, from long, to long, minutes double")
    monkeypatch.setattr(fleet, "DEPTH", depth, raising=False)
    sent = rows_to_plans(monkeypatch)
    got = [tuple(r)[1:] for r in fleet.schedule(t, s, m).collect()]
    assert got == greedy(tasks, shifts, minutes)
    odd = sum(x[4] == 0 for x in tasks.values())
    assert max(sent) - odd <= 3 * 2 * 2 * 2 * 2 and (len(sent) > 1) == (depth < 64)


def test_storm_response_of_many_tasks_of_few_kinds(spark, monkeypatch):
    """The plans before and after the storm get kinds, not tasks; with a second pass in each, the result is the same."""
    tasks = spark.createDataFrame([(1, k, k % 2, k % 3, 6, 60.0 + k % 40, 1.0 + k % 2, k % 5 == 0) for k in range(600)], "region int, task_id long, node_id long, release int, due int, duration double, prio double, needs_ms boolean")
    shifts = spark.createDataFrame([(1, d, o, o, 480, 960, o == 0) for d in range(9) for o in range(2)], "region int, day int, op_id long, home long, start int, end int, has_ms boolean")
    travel = spark.createDataFrame([(1, 0, 1, 50.0), (1, 1, 0, 50.0)], "region int, from long, to long, minutes double")
    storm = spark.createDataFrame([(1, 1000 + k, k % 2, 40.0, 2.0) for k in range(300)], "region int, task_id long, node_id long, duration double, exposure double")
    sent, found = rows_to_plans(monkeypatch), []
    for depth in (64, 2):
        monkeypatch.setattr(fleet, "DEPTH", depth, raising=False)
        plan, figures = fleet.storm_response(tasks, shifts, travel, storm, 4, 4)
        found.append((sorted(map(tuple, plan.collect())), sorted(map(tuple, figures.collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 50
    assert max(sent) <= 3 * 25 and len(sent) > 4
