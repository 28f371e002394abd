"""Sample matching target category proportions.

Entities are counted in the cells of the listed categories (cross-classified if a plan names
several attributes; everything unlisted is one rest category, so the number of cells follows from
the plan and not from the data). On those counts a min-cost flow is solved for each plan: from a
source through the categories of each attribute in turn to a sink, with arcs for the margins
(the targets), floors (the required minima, which earn more than any other arc) and availability
(the cells). Slack arcs carry what no entity can fill and so expose each shortfall. The integer
cell quotas of the flow are then drawn at random by a seeded hash.

The draw is exact and free of hot groups: hash values fall into ``SLICES`` equal slices, whose
counts for each cell are summed before the shuffle and run up in Spark; whole slices are taken up to the quota and
only the slice that the quota ends in is ranked. To the driver come the counts of cells alone.

Defined results: categories compare without regard to letter case and extra white space; null and
blank mean unknown, which is never a listed category; rows without an id are left out; an entity
with several rows counts once (with the smallest known value of each attribute); no entities or no
targets give an empty sample, the report then showing full shortfalls.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .split import SPACE

#: Slices of the hash range in which a quota's end is looked for.
SLICES = 4096
#: What a plan may list; beyond it the counts would no longer be small enough for the driver.
MAX_TARGETS = 10_000
MAX_CELLS = 100_000
#: The key of all categories that a plan does not list; no key has outer blanks.
REST = " rest "


def category_key(value: Column) -> Column:
    """The form in which categories are compared; null for unknown."""
    tidied = F.lower(F.trim(F.regexp_replace(value, SPACE, " ")))
    return F.when(tidied != "", tidied)


def distinct_entities(demographics: DataFrame, attributes: list[str]) -> DataFrame:
    """(qid, one column per attribute): one row for each entity."""
    keyed = demographics.filter("qid is not null").select("qid", *[category_key(F.col(a)).alias(a) for a in attributes])
    return keyed.groupBy("qid").agg(*[F.min(a).alias(a) for a in attributes])


def required(share: float, minimum: int | None, size: int) -> int:
    """The larger of the minimum and the share of the sample, rounded up."""
    return max(minimum or 0, math.ceil(round((share or 0.0) * (size or 0), 6)))


class MinCostFlow:
    """Successive shortest paths with potentials on a small integer network."""

    def __init__(self) -> None:
        self.arcs: list[list[float]] = []  # to, capacity left, cost
        self.out: dict[object, list[int]] = defaultdict(list)
        self.potential: dict[object, float] = defaultdict(float)

    def arc(self, a: object, b: object, capacity: int, cost: float) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def flow(self, k: int) -> int:
        return int(self.arcs[k + 1][1])

    def solve(self, source: object, sink: object, amount: int) -> int:
        """Send up to ``amount`` more; costs are not negative."""
        potential, sent = self.potential, 0
        while sent < amount:
            distance, via, heap, tick = {source: 0.0}, {}, [(0.0, 0, source)], 0
            while heap:
                d, _, node = heappop(heap)
                if d > distance[node]:
                    continue
                for k in self.out[node]:
                    to, left, cost = self.arcs[k]
                    if left > 0 and (e := d + cost + potential[node] - potential[to]) < distance.get(to, math.inf):
                        distance[to], via[to], tick = e, k, tick + 1
                        heappush(heap, (e, tick, to))
            if sink not in distance:
                break
            for node, d in distance.items():
                potential[node] += d
            step, node = amount - sent, sink
            while node != source:
                step = min(step, self.arcs[via[node]][1])
                node = self.arcs[via[node] ^ 1][0]
            node = sink
            while node != source:
                self.arcs[via[node]][1] -= step
                self.arcs[via[node] ^ 1][1] += step
                node = self.arcs[via[node] ^ 1][0]
            sent += int(step)
        return sent


@dataclass
class Solved:
    """Quotas by cell; for each target its requirement, the entities on hand, what it got, and
    what its slack arc carries."""

    quotas: dict[tuple, int]
    report: list[tuple[str, str, str, int, int, int, int]]


#: Costs: a margin's own arc, its slack arc, what is drawn in place of others. What replaces a
#: shortfall is spread by STEPS arcs of rising cost in proportion to the margins.
FLOOR, SLACK, OVER, STEPS = 0.0, 1e3, 1e6, 16


def solve_plan(plan_id: str, targets: list[dict], cells: dict[tuple, int]) -> Solved:
    """The flow of one plan. ``targets``: attribute, category, key, target_share, min_count,
    sample_size. ``cells``: number of entities for each tuple of category keys, one key for each
    attribute in sorted order, REST where the plan does not list it.

    Layers: source -> categories of the first attribute -> cells -> categories of the second
    -> sink (with one attribute the cells lead to the sink). A category is entered through the arc
    of its margin; a slack arc leads past the cells for each category. First the margins are sent,
    so that what no entity can fill shows on the slack arcs; then as much again is drawn from
    other categories through overflow arcs, as far as entities are left.
    """
    attributes = sorted({t["attribute"] for t in targets})
    if len(attributes) > 2:
        raise ValueError("a plan may name one or two attributes; cross them into one beforehand")
    size = max(int(t["sample_size"] or 0) for t in targets)
    need = {(t["attribute"], t["key"]): required(t["target_share"], t["min_count"], size) for t in targets}
    # the margin of what a plan does not list is what its shares leave
    rest = {a: max(0, size - sum(n for (b, _), n in need.items() if b == a)) for a in attributes}
    amount = max(sum(n for (b, _), n in need.items() if b == a) + rest[a] for a in attributes)
    net = MinCostFlow()
    slack: dict[tuple[str, str], int] = {}
    through: dict[tuple, int] = {}
    keys = {a: sorted({k for (b, k) in need if b == a}) + [REST] for a in attributes}

    def margin(a: str, key: str, node: tuple, at_source: bool) -> None:
        ends = ("source", node) if at_source else (node, "sink")
        wanted = need.get((a, key), rest[a] if key == REST else 0)
        net.arc(*ends, wanted, FLOOR)
        for k in range(STEPS):
            net.arc(*ends, amount if k == STEPS - 1 else math.ceil(wanted / STEPS), OVER + k)

    first = attributes[0]
    for key in keys[first]:
        margin(first, key, (first, key), True)
        slack[first, key] = net.arc((first, key), "sink" if len(attributes) == 1 else "spare", amount, SLACK)
    for cell, available in sorted(cells.items()):
        to = "sink" if len(attributes) == 1 else (attributes[1], cell[1])
        through[cell] = net.arc((first, cell[0]), to, available, 0.0)
    for second in attributes[1:]:
        for key in keys[second]:
            slack[second, key] = net.arc("spare", (second, key), amount, 0.0)
            margin(second, key, (second, key), False)
    net.solve("source", "sink", amount)
    short = {k: net.flow(arc) for k, arc in slack.items()}
    drawn_now = sum(net.flow(k) for k in through.values())
    net.solve("source", "sink", min(max(0, size - drawn_now), sum(cells.values()) - drawn_now))
    quotas = {cell: net.flow(k) for cell, k in through.items()}
    report = []
    for t in targets:
        a, key = t["attribute"], t["key"]
        at = attributes.index(a)
        available = sum(n for cell, n in cells.items() if cell[at] == key)
        drawn = sum(n for cell, n in quotas.items() if cell[at] == key)
        report.append((plan_id, a, t["category"], need[a, key], available, drawn, short[a, key]))
    return Solved(quotas, report)


def _plans(targets: DataFrame) -> dict[str, list[dict]]:
    """The targets by plan: a small helper table, whose size is checked."""
    keyed = targets.filter("plan_id is not null and category is not null and attribute is not null").select(
        "plan_id", "attribute", "category", category_key(F.col("category")).alias("key"), "target_share", "min_count", "sample_size"
    )
    rows = keyed.dropDuplicates(["plan_id", "attribute", "key"]).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    plans: dict[str, list[dict]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["plan_id"], r["attribute"], r["category"])):
        plans[r["plan_id"]].append(r.asDict())
    return plans


def _celled(entities: DataFrame, plan: list[dict], attributes: list[str]) -> DataFrame:
    """Entities with the cell of a plan in c0 and c1."""
    out = entities
    for k, a in enumerate(attributes):
        listed = sorted(t["key"] for t in plan if t["attribute"] == a)
        out = out.withColumn(f"c{k}", F.when(F.col(a).isin(listed), F.col(a)).otherwise(F.lit(REST)))
    return out


def solve_all(entities: DataFrame, plans: dict[str, list[dict]]) -> dict[str, Solved]:
    """Solve every plan on its cell counts, which are summed in Spark; only counts come back, at
    most one for each combination of listed categories."""
    solved = {}
    for plan_id, plan in plans.items():
        attributes = sorted({t["attribute"] for t in plan})
        most = math.prod(1 + sum(t["attribute"] == a for t in plan) for a in attributes)
        if most > MAX_CELLS:
            raise ValueError(f"plan {plan_id} has {most} cells; the limit is {MAX_CELLS}")
        names = [f"c{k}" for k in range(len(attributes))]
        counts = _celled(entities, plan, attributes).groupBy(*names).count().collect()
        solved[plan_id] = solve_plan(plan_id, plan, {tuple(r[n] for n in names): r["count"] for r in counts})
    return solved


_REPORT = "plan_id string, attribute string, category string, required long, available long, drawn long, shortfall long"


def _entities(demographics: DataFrame, plans: dict[str, list[dict]]) -> DataFrame:
    """Distinct entities with the attributes of the plans, written once for all of them."""
    return written(distinct_entities(demographics, sorted({t["attribute"] for p in plans.values() for t in p})))


def quota_report(demographics: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target what it requires, what there is, what the sample gets and what is short."""
    plans = _plans(targets)
    rows = [r for s in (solve_all(_entities(demographics, plans), plans) if plans else {}).values() for r in s.report]
    return demographics.sparkSession.createDataFrame(rows, _REPORT)


def quota_sample(demographics: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(plan_id, qid, cell): the drawn sample of every plan. A cell of two categories is named as a JSON list, so that
    no two cells share a name."""
    spark = demographics.sparkSession
    plans = _plans(targets)
    out = spark.createDataFrame([], "plan_id string, qid string, cell string")
    if not plans:
        return out
    entities = _entities(demographics, plans)
    solved = solve_all(entities, plans)
    for plan_id, plan in plans.items():
        attributes = sorted({t["attribute"] for t in plan})
        names = [f"c{k}" for k in range(len(attributes))]
        cell = F.col("c0") if len(names) == 1 else F.to_json(F.array(*names))
        u = F.xxhash64(F.lit(seed), F.lit(plan_id), F.col("qid"))
        sliced = _celled(entities, plan, attributes).select(
            *names, "qid", cell.alias("cell"), u.alias("u"), F.shiftrightunsigned(u, 64 - SLICES.bit_length() + 1).alias("slice")
        )
        quotas = [(*c, n) for c, n in solved[plan_id].quotas.items() if n]  # as many as cells, which are checked
        if not quotas:
            continue
        asked = F.broadcast(spark.createDataFrame(quotas, ", ".join(f"{n} string" for n in names) + ", quota long"))
        before = F.coalesce(F.sum("count").over(Window.partitionBy("cell").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = sliced.groupBy(*names, "cell", "slice").count().join(asked, names).withColumn("before", before)
        # the slice in which a quota ends and what is left of it there
        ended = counts.filter("before < quota and before + count >= quota").select("cell", F.col("slice").alias("last"), (F.col("quota") - F.col("before")).alias("remaining"))
        near = sliced.join(F.broadcast(ended), "cell").filter("slice <= last")
        whole = near.filter("slice < last").select("qid", "cell")
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("u", "qid"))
        partly = near.filter("slice = last").withColumn("rank", rank).filter("rank <= remaining").select("qid", "cell")
        out = out.unionByName(whole.unionByName(partly).select(F.lit(plan_id).alias("plan_id"), "qid", "cell"))
    return out


def impossible_targets(demographics: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, category): targets whose slack arc carries something because too few distinct
    entities exist; crossed targets that are short only together are in the report."""
    return quota_report(demographics, targets).filter("shortfall > 0 and available < required").select("plan_id", "category").distinct()
