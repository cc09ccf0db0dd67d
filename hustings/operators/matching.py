"""Pairs of neighbouring cells of a hexagonal grid, as many as there can be.

Three hexagons meet in every corner, so their neighbourhoods have triangles and no two-colouring: layers of augmenting paths alone don't do, odd cycles
have to be shrunk. Groups fall into connected components first, over edge tables; each component, a region of a map, is then matched by itself.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.operators.layout import grid_components, neighbours
from hustings.workers import importable, temporary, written

MOST_CELLS = 20_000


def matched(near: list[list[int]]) -> list[int]:
    """Each node's partner in a largest matching, or -1; near lists the neighbours of each node."""
    n = len(near)
    mate = [-1] * n
    for v in range(n):
        if mate[v] < 0:
            u = next((u for u in near[v] if mate[u] < 0), None)
            if u is not None:
                mate[v], mate[u] = u, v
    for root in range(n):
        if mate[root] < 0:
            end, parent = _augmenting(root, near, mate)
            while end >= 0:
                before = parent[end]
                then = mate[before]
                mate[end], mate[before] = before, end
                end = then
    return mate


def _augmenting(root: int, near: list[list[int]], mate: list[int]) -> tuple[int, dict[int, int]]:
    """The free end of a path from root on which every second edge is matched, and where each node on it was reached from; -1 if there is none."""
    base, parent, outer = list(range(len(near))), {}, {root}
    queue = deque([root])
    while queue:
        v = queue.popleft()
        for u in near[v]:
            if base[v] == base[u] or mate[v] == u:
                continue
            if u == root or (mate[u] >= 0 and mate[u] in parent):  # an odd cycle: it shrinks into its nearest common base
                seen, a = set(), v
                while True:
                    a = base[a]
                    seen.add(a)
                    if mate[a] < 0:
                        break
                    a = parent[mate[a]]
                common = base[u]
                while common not in seen:
                    common = base[parent[mate[common]]]
                inside = set()
                for start, child in ((v, u), (u, v)):
                    a = start
                    while base[a] != common:
                        inside |= {base[a], base[mate[a]]}
                        parent[a] = child
                        child = mate[a]
                        a = parent[child]
                for k in range(len(near)):
                    if base[k] in inside:
                        base[k] = common
                        if k not in outer:
                            outer.add(k)
                            queue.append(k)
            elif u not in parent:
                parent[u] = v
                if mate[u] < 0:
                    return u, parent
                outer.add(mate[u])
                queue.append(mate[u])
    return -1, parent


def paired(cells: DataFrame, group: str, c: str = "c", r: str = "r", most: int = MOST_CELLS) -> DataFrame:
    """(group, component, c, r, c2, r2) of all cells: as many as possible have a neighbour of their group as partner, one each; the rest null.

    A component without a null partner is paired perfectly; one with some cannot be. Repeated cells are one, cells without a place are left
    out. Components are named as in `grid_components`; one of more than `most` cells is an error, for a component is matched by one task.
    """
    importable(cells.sparkSession)
    with temporary(cells.sparkSession) as keep:
        own = written(grid_components(cells.filter(F.col(c).isNotNull() & F.col(r).isNotNull()).select(group, c, r).distinct(), group, c, r), "components")
        if large := own.groupBy(group, "component").count().filter(F.col("count") > most).limit(3).collect():
            raise ValueError(f"components of more than {most} cells: {[tuple(x) for x in large]}")
        schema = f"{group} {cells.schema[group].dataType.simpleString()}, component long, {c} long, {r} long, c2 long, r2 long"

        def match(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([r, c])
            place = {p: i for i, p in enumerate(zip(pdf[c].tolist(), pdf[r].tolist(), strict=True))}
            spots = list(place)
            near = [[place[q] for q in sorted(beside) if q in place] for beside in pdf["beside"].map(lambda x: {(s["nc"], s["nr"]) for s in x})]
            mate = matched(near)
            two = [spots[m] if m >= 0 else (None, None) for m in mate]
            return pdf.drop(columns="beside").assign(c2=pd.array([x for x, _ in two], "Int64"), r2=pd.array([x for _, x in two], "Int64"))

        beside = neighbours(own, c, r).groupBy(group, "component", c, r).agg(F.collect_set(F.struct("nc", "nr")).alias("beside"))
        typed = beside.select(group, "component", F.col(c).cast("long").alias(c), F.col(r).cast("long").alias(r), "beside")
        return keep(written(typed.groupBy(group, "component").applyInPandas(match, schema), "pairs"))
