"""Optimal assignment: groups that fit in a task by shortest augmenting paths, larger ones by auction, agents bidding for items in rounds over tables of
costs and prices. Agents and items that are alike are assigned as kinds, by amounts, so that no table of all pairs is made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hustings.operators.ranges import numbered
from hustings.workers import importable, temporary, written

#: Agents, or kinds of them, of a group that one task assigns: its matrix of costs takes 128 MB.
MOST_IN_TASK = 4000
#: Agents in a row of one kind that are listed at once.
BLOCK = 4096
MOST_ROUNDS = 2000
#: By how much the step of prices shrinks from phase to phase.
SHRINK = 16


def paths(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item of each agent, u, v) of a square matrix of whole costs: the least total, and prices u + v <= costs that are equal where agents have items."""
    n = len(costs)
    v = costs.min(axis=0)
    u = (costs - v).min(axis=1)
    agent, item = np.full(n, -1), np.full(n, -1)
    for i in range(n):
        free = np.flatnonzero((costs[i] - v == u[i]) & (agent < 0))
        if len(free):
            agent[free[0]], item[i] = i, free[0]
    far = np.iinfo(np.int64).max
    for i in np.flatnonzero(item < 0):
        # distances to items from i over reduced costs; `open_` ones may still get nearer
        distance, via, open_ = np.full(n, far), np.full(n, -1), np.ones(n, bool)
        done: list[int] = []
        k, at = i, 0
        while True:
            through = costs[k] - v + (at - u[k])
            nearer = open_ & (through < distance)
            distance[nearer], via[nearer] = through[nearer], k
            j = int(np.where(open_, distance, far).argmin())
            open_[j], at = False, distance[j]
            if agent[j] < 0:
                break
            done.append(j)
            k = agent[j]
        u[i] += at
        if done:
            less = at - distance[done]
            u[agent[done]] += less
            v[done] -= less
        while j >= 0:
            k = via[j]
            agent[j], item[k], j = k, j, item[k]
            if k == i:
                break
    return item, u, v


def flows(costs: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> tuple[list[dict[int, int]], np.ndarray, np.ndarray]:
    """(amounts by row for each column, u, v) at the least total of whole costs, supply and demand adding to the same: `paths` with rows and columns that
    stand for several, an augmenting path carrying as much as it can. Prices u + v <= costs are equal where there is an amount."""
    v = costs.min(axis=0)
    u = (costs - v).min(axis=1)
    left, room = supply.copy(), demand.copy()
    sent: list[dict[int, int]] = [{} for _ in demand]
    for i in range(len(costs)):
        for j in np.flatnonzero((costs[i] - v == u[i]) & (room > 0)):
            if not left[i]:
                break
            sent[j][i] = f = int(min(left[i], room[j]))
            left[i] -= f
            room[j] -= f
    far = np.iinfo(np.int64).max
    for i in map(int, np.flatnonzero(left)):
        while left[i]:
            # as in `paths`, but all rows that send to a column are reached by it; back: that column, reached: their distances
            distance, via, open_ = np.full(len(v), far), np.full(len(v), -1), np.ones(len(v), bool)
            back, reached, rows, done, at = {i: -1}, {i: 0}, [i], [], 0
            while True:
                for k in rows:
                    through = costs[k] - v + (at - u[k])
                    nearer = open_ & (through < distance)
                    distance[nearer], via[nearer] = through[nearer], k
                j = int(np.where(open_, distance, far).argmin())
                open_[j], at = False, int(distance[j])
                if room[j]:
                    break
                done.append(j)
                rows = [k for k in sent[j] if k not in back]
                back.update(dict.fromkeys(rows, j))
                reached.update(dict.fromkeys(rows, at))
            for k, d in reached.items():
                u[k] += at - d
            v[done] -= at - distance[done]
            path = [(int(via[j]), j)]
            while path[-1][0] != i:
                k = back[path[-1][0]]
                path.append((int(via[k]), k))
            # a row on the way sends less to the column it was reached by
            f = int(min(left[i], room[j], *[sent[back[k]][k] for k, _ in path[:-1]]))
            for k, to in path:
                sent[to][k] = sent[to].get(k, 0) + f
                if k != i:
                    sent[back[k]][k] -= f
                    if not sent[back[k]][k]:
                        del sent[back[k]][k]
            left[i] -= f
            room[j] -= f
    return sent, u, v


def _in_tasks(c: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """(group, i, j, c, price) of groups that fit in a task; the prices of a group add to the least total there can be."""
    importable(c.sparkSession)
    known = F.broadcast(sizes.filter(F.col("n") <= MOST_IN_TASK).select(*group, "least"))
    lists = c.join(known, group).groupBy(*group, "i").agg(F.sort_array(F.collect_list(F.struct("j", "c"))).alias("l"), F.first("least").alias("least"))
    lists = lists.select(*group, "i", F.col("l.c").alias("costs"), F.when(F.col("i") == F.col("least"), F.col("l.j")).alias("items"))  # items are the same for all
    schema = T.StructType([*c.select(*group).schema, *[T.StructField(x, T.LongType()) for x in ("i", "j", "c", "price")]])

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        n = t.num_rows
        costs = t.column("costs").combine_chunks().flatten().to_numpy().reshape(n, n)
        items = t.column("items").combine_chunks().flatten().to_numpy()
        item, u, v = paths(costs)
        out = [items[item], costs[np.arange(n), item], u + v[item]]
        return pa.table([*[t.column(g) for g in group], t.column("i"), *map(pa.array, out)], names=schema.names)

    return lists.groupBy(*group).applyInArrow(solve, schema)


def assigned(costs: DataFrame, group: list[str], agent: str, item: str, cost: str) -> tuple[DataFrame, DataFrame]:
    """Of costs (group, agent, item, whole cost), each pair of a group once: (group, agent, item) of least total cost, and (group, total, bound, gap).

    Groups of at most MOST_IN_TASK agents are assigned by a task each, by shortest augmenting paths; their bound is the total. Larger ones by auction: in
    a round, each agent without an item finds the item that is worth most to it at present prices and bids what it is worth more than the second best,
    and a step; an item goes to the highest bid (the least agent of equal ones) and its price rises to it. Costs are multiplied by one more than
    the agents of a group, and steps end at 1, so that the total is the least possible; larger steps first keep prices from creeping. Prices carry
    over from one phase to the next, items don't. bound is what the final prices prove no assignment can beat, gap (total - bound) is below 1.

    Groups need as many items as agents and every pair; ValueError says which don't have them, RuntimeError that MOST_ROUNDS didn't do. Null costs
    are no pairs. Agents and items are numbers.
    """
    with temporary(costs.sparkSession) as keep:
        c = costs.select(*group, F.col(agent).cast("long").alias("i"), F.col(item).cast("long").alias("j"), F.col(cost).cast("long").alias("c")).filter("c IS NOT NULL")
        c = written(c, "costs")
        of_agents = c.groupBy(*group, "i").agg(F.count("*").alias("k"), F.max(F.abs("c")).alias("most")).groupBy(*group)
        of_agents = of_agents.agg(F.count("*").alias("n"), F.min("i").alias("least"), F.min("k").alias("fewest"), F.sum("k").alias("pairs"), F.max("most").alias("most"))
        of_items = c.groupBy(*group, "j").agg(F.count("*").alias("k")).groupBy(*group).agg(F.count("*").alias("m"))
        sizes = written(of_agents.join(of_items, group), "sizes")
        if odd := sizes.filter("n <> m OR fewest <> n OR pairs <> n * m").select(*group, "n", "m", "pairs", "most").limit(5).collect():
            raise ValueError(f"not square: {[tuple(r) for r in odd]}")
        small = written(_in_tasks(c, sizes, group), "paths")
        chosen = small.select(*group, F.col("i").alias(agent), F.col("j").alias(item))
        report = small.groupBy(*group).agg(F.sum("c").alias("total"), F.sum("price").cast("double").alias("bound")).withColumn("gap", F.col("total") - F.col("bound"))
        large = sizes.filter(F.col("n") > MOST_IN_TASK)
        if not large.isEmpty():
            more, of_more = _auction(c.join(F.broadcast(large.select(*group)), group), large, group)
            chosen = chosen.unionByName(more.select(*group, F.col("i").alias(agent), F.col("j").alias(item)))
            report = report.unionByName(of_more)
        return keep(written(chosen, "assigned")), keep(written(report, "totals"))


def assigned_by_kind(agents: DataFrame, items: DataFrame, group: list[str], agent: str, item: str, cost: Column) -> tuple[DataFrame, DataFrame]:
    """What `assigned` gives for all pairs of agents (group, agent, columns that cost depends on) and items (group, item, columns) of a group, without a
    table of the pairs.

    Agents whose columns are equal are a kind, and so are items; only pairs of kinds have a cost. A task assigns a group's kinds by amounts; members of a
    kind have places in a row, so an amount from kind to kind is a run of places on both sides. Groups of more than MOST_IN_TASK kinds of agents or
    items go through `assigned`, pair by pair. ValueError where a group has more agents than items or fewer, an agent or item twice, or a null cost.
    Rows without a group have no part.
    """
    with temporary(agents.sparkSession) as keep:
        a_rows, a_kinds = _kinds(agents, group, agent, "i", "n")
        b_rows, b_kinds = _kinds(items, group, item, "j", "m")
        of_a = a_kinds.groupBy(*group).agg(F.count("*").alias("a_kinds"), F.sum("n").alias("agents"), F.min("i").alias("least"))
        of_b = b_kinds.groupBy(*group).agg(F.count("*").alias("b_kinds"), F.sum("m").alias("items"))
        sizes = written(of_a.join(of_b, group, "full"), "sizes")
        if odd := sizes.filter("NOT agents <=> items").select(*group, "agents", "items").limit(5).collect():
            raise ValueError(f"not square: {[tuple(r) for r in odd]}")
        fits = F.greatest("a_kinds", "b_kinds") <= MOST_IN_TASK
        known = F.broadcast(sizes.filter(fits).select(*group, "least"))
        c = written(a_kinds.join(known, group).join(b_kinds, group).select(*group, "least", "i", "n", "j", "m", cost.cast("long").alias("c")), "costs")
        if odd := c.filter("c IS NULL").select(*group).distinct().limit(5).collect():
            raise ValueError(f"null costs: {[tuple(r) for r in odd]}")
        amounts = written(_amounts(c, group), "amounts")
        report = amounts.groupBy(*group).agg(F.sum(F.col("f") * F.col("c")).alias("total"), F.sum(F.col("f") * F.col("price")).cast("double").alias("bound"))
        report = report.withColumn("gap", F.col("total") - F.col("bound"))
        blocks = amounts.select("a", "b", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("f") - 1, F.lit(BLOCK).cast("long"))).alias("k"))
        each = blocks.select("a", "b", F.explode(F.sequence("k", F.least(F.col("k") + BLOCK, "f") - 1)).alias("k")).select((F.col("a") + F.col("k")).alias("__i"), (F.col("b") + F.col("k")).alias("__j"))
        chosen = each.join(a_rows.select("__i", *group, F.col(agent).cast("long").alias(agent)), "__i").join(b_rows.select("__j", F.col(item).cast("long").alias(item)), "__j").select(*group, agent, item)
        large = sizes.filter(~fits)
        if not large.isEmpty():
            pairs = agents.join(F.broadcast(large.select(*group)), group).join(items, group)
            more, of_more = assigned(pairs.withColumn("__cost", cost), group, agent, item, "__cost")
            chosen, report = chosen.unionByName(more), report.unionByName(of_more)
        return keep(written(chosen, "assigned")), keep(written(report, "totals"))


def _kinds(df: DataFrame, group: list[str], name: str, start: str, size: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their places (__start) in the order of groups and kinds, and kinds with their first place and how many they are."""
    own = [x for x in df.columns if x not in (*group, name)]
    known = df.dropna(subset=group)
    if odd := known.groupBy(*group, name).count().filter("count > 1").limit(5).collect():
        raise ValueError(f"more than once: {[tuple(r) for r in odd]}")
    at = f"__{start}"
    rows = written(numbered(known, [*map(F.col, [*group, *own, name])], at), "places")
    return rows, written(rows.groupBy(*group, *own).agg(F.min(at).alias(start), F.count("*").alias(size)), "kinds")


def _amounts(c: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b, f, c, price): f agents from place a on get the items from place b on, at c each; f times the prices add to the least total there can be."""
    importable(c.sparkSession)
    lists = c.groupBy(*group, "i").agg(F.sort_array(F.collect_list(F.struct("j", "c", "m"))).alias("l"), F.first("n").alias("n"), F.first("least").alias("least"))
    of_items = lambda x: F.when(F.col("i") == F.col("least"), F.col(f"l.{x}")).alias(x)  # noqa: E731  the same for all agents
    lists = lists.select(*group, "i", "n", F.col("l.c").alias("costs"), of_items("j"), of_items("m"))
    schema = T.StructType([*c.select(*group).schema, *[T.StructField(x, T.LongType()) for x in ("a", "b", "f", "c", "price")]])

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        costs = t.column("costs").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        i, n = (t.column(x).to_numpy() for x in ("i", "n"))
        j, m = (t.column(x).combine_chunks().flatten().to_numpy() for x in ("j", "m"))
        sent, u, v = flows(costs, n, m)
        out, used = [], [0] * len(i)
        for y, amounts in enumerate(sent):
            to = int(j[y])
            for x, f in sorted(amounts.items()):
                out.append((int(i[x]) + used[x], to, f, int(costs[x, y]), int(u[x] + v[y])))
                used[x] += f
                to += f
        own = [pa.array([t.column(g)[0].as_py()] * len(out), t.column(g).type) for g in group]
        return pa.table([*own, *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]], names=schema.names)

    return lists.groupBy(*group).applyInArrow(solve, schema)


def _auction(c: DataFrame, sizes: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(group, i, j) and (group, total, bound, gap) of groups of any size, in rounds."""
    with temporary(c.sparkSession) as keep:
        value = written(c.join(sizes.select(*group, (F.col("n") + 1).alias("by")), group).select(*group, "i", "j", (-F.col("c") * F.col("by")).alias("v")), "values")
        agents = written(value.select(*group, "i").distinct(), "agents")
        prices = value.select(*group, "j").distinct().withColumns({"price": F.lit(0).cast("long"), "owner": F.lit(None).cast("long")})
        step = sizes.agg(F.max(F.col("most") * (F.col("n") + 1))).first()[0] or 0
        rounds, last = 0, False
        while not last:
            step = max(1, step // SHRINK)
            last = step == 1
            prices = written(prices.withColumn("owner", F.lit(None).cast("long")), "prices")
            while True:
                free = agents.join(prices.filter("owner IS NOT NULL").select(*group, F.col("owner").alias("i")), [*group, "i"], "left_anti")
                worth = value.join(free, [*group, "i"]).join(prices.select(*group, "j", "price"), [*group, "j"])
                # the two best of an agent's items
                order = Window.partitionBy(*group, "i").orderBy(F.desc("w"), "j")
                two = worth.withColumn("w", F.col("v") - F.col("price")).withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
                best = two.groupBy(*group, "i").agg(*[F.max(F.when(F.col("rank") == 1, F.col(x))).alias(x) for x in ("j", "price", "w")], F.max(F.when(F.col("rank") == 2, F.col("w"))).alias("next"))
                bids = best.select(*group, "i", "j", (F.col("price") + F.col("w") - F.coalesce("next", "w") + step).alias("bid"))
                won = bids.groupBy(*group, "j").agg(F.max(F.struct("bid", (-F.col("i")).alias("k"))).alias("b"))
                won = written(won.select(*group, "j", F.col("b.bid").alias("bid"), (-F.col("b.k")).alias("winner")), "bids")
                if not won.take(1):
                    break
                rounds += 1
                if rounds > MOST_ROUNDS:
                    raise RuntimeError(f"no assignment after {MOST_ROUNDS} rounds")
                prices = prices.join(won, [*group, "j"], "left").select(*group, "j", F.coalesce("bid", "price").alias("price"), F.coalesce("winner", "owner").alias("owner"))
                prices = written(prices, "prices")
        out = prices.select(*group, F.col("owner").alias("i"), "j")
        total = c.join(out, [*group, "i", "j"]).groupBy(*group).agg(F.sum("c").alias("total"))
        # no assignment is worth more than all prices and the best that each agent could have at them
        most = value.join(prices.select(*group, "j", "price"), [*group, "j"]).groupBy(*group, "i").agg(F.max(F.col("v") - F.col("price")).alias("w")).groupBy(*group).agg(F.sum("w").alias("w"))
        dual = prices.groupBy(*group).agg(F.sum("price").alias("p")).join(most, group).join(sizes.select(*group, "n"), group)
        bound = dual.select(*group, (-(F.col("p") + F.col("w")) / (F.col("n") + 1)).alias("bound"))
        report = total.join(bound, group).withColumn("gap", F.col("total") - F.col("bound"))
        return keep(written(out, "auction")), keep(written(report, "totals"))
