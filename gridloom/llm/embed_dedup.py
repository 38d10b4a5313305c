"""Near-duplicate vectors by dual traversal of cover trees.

Vectors are scaled to length 1, where a cosine is a distance. Equal vectors of a label are merged
first, with their number. The top of a label's tree is shared out: centres are a sample of its vectors,
about two per ``BLOCK`` (at most about ``CENTRES``), every vector belongs to the cell of its nearest
centre, and a cell has a covering radius. Another cell's vector visits a cell only if it can be within
the threshold of a member: by the cell's covering radius plus the threshold, and by its distance from
the plane halfway between the two centres, beyond which all members lie. Of two cells only the one of
the larger number visits. Nothing else is compared, and cells that nothing can reach make no work.

Below, a group holds at most about ``BLOCK`` members of a cell and as many visitors of its own part. It
builds their cover trees (levels of halving radii, each centre covering what is within its level's
radius, centres nested; only centres are compared with members) and walks both together from pair of
nodes to pair of nodes. A pair is dropped if the distance of the centres exceeds the threshold and both
covering radii, and taken whole if that distance and the radii are within the threshold; pairs of
single vectors are decided by their cosine in double precision.

A group returns the number of links of each of its vectors and a spanning set of links, not the pairs.
Where vectors have no near ones and lie in all directions, as in a high-dimensional random cloud, no
bound can rule pairs out, and the work is that of comparing a label's distinct vectors pairwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.simhash import spanning
from gridloom.plans.components import connected_components
from gridloom.plans.lineage import cut, keep, scratch, ship

#: Vectors of a group's side, at most about.
BLOCK = 2048
#: Centres of a label, at most about; larger labels have larger cells, which are split into several groups.
CENTRES = 512
_SLACK = 1e-7  # what rounding may add to a distance of nearly equal vectors
_PAIRS = 500_000


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


class CoverTree:
    """levels[k] has the nodes at radius 2 / 2^k: start and end in ``order`` (children keep their parents' order), centre, covering radius, and first child.

    compared counts the cosines that were worked out.
    """

    def __init__(self, vectors: np.ndarray, least: float):
        n = len(vectors)
        self.vectors, self.compared, self.levels = vectors, n, []
        groups = [(0, np.arange(n), _distance(vectors @ vectors[0]).max() if n > 1 else 0.0)]  # the first centre covers everything
        radius = 2.0
        while True:
            bounds = np.cumsum([0, *(len(g) for _, g, _ in groups)])
            self.levels.append({"start": bounds[:-1], "end": bounds[1:], "centre": np.array([c for c, _, _ in groups]), "radius": np.array([r for _, _, r in groups])})
            if len(groups) == n:
                break
            radius /= 2
            near = 1 - radius * radius / 2 if radius >= least else 2.0  # below the least radius: single vectors
            after, first = [], []
            for c, members, _ in groups:
                first.append(len(after))
                after += [(c, members, 0.0)] if len(members) == 1 else self._children(c, members, near)
            self.levels[-1]["first"] = np.append(first, len(after))
            groups = after
        self.order = np.concatenate([g for _, g, _ in groups])
        self.levels[-1]["first"] = np.arange(len(groups) + 1)

    def _children(self, centre: int, members: np.ndarray, near: float) -> list[tuple[int, np.ndarray, float]]:
        """(centre, members, covering radius) of a node's children; its centre stays one."""
        left, out = np.concatenate(([centre], members[members != centre])), []
        if near > 1:
            return [(int(m), np.array([m]), 0.0) for m in left]
        while len(left):
            some = left[: 1 if not out else 64]  # what the centre covers goes before others are tried
            cos = self.vectors[some] @ self.vectors[some].T
            chosen = []
            for i in range(len(some)):
                if not chosen or cos[i, chosen].max() < near:
                    chosen.append(i)
            cos = self.vectors[left] @ self.vectors[some[chosen]].T
            cos[chosen, :] = np.where(np.eye(len(chosen), dtype=bool), np.inf, -np.inf)  # a centre is its own
            self.compared += cos.size
            best = cos.argmax(1)
            most = cos[np.arange(len(left)), best]
            inside = most >= near
            for k in range(len(chosen)):
                own = np.nonzero(inside & (best == k))[0]
                out.append((int(some[chosen[k]]), left[own], float(_distance(most[own].min())) if len(own) > 1 else 0.0))
            left = left[~inside]
        return out

    def level(self, k: int) -> dict[str, np.ndarray]:
        return self.levels[k]

    def children(self, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in nodes, child) of all children of nodes of level k."""
        first = self.levels[k]["first"]
        many = first[nodes + 1] - first[nodes]
        at = np.repeat(np.arange(len(nodes)), many)
        return at, np.repeat(first[nodes] - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _cosines(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of every a[x[i]] and b[y[i]]."""
    ux, ix = np.unique(x, return_inverse=True)
    uy, iy = np.unique(y, return_inverse=True)
    if len(ux) * len(uy) <= 4 * len(x):
        return (a[ux] @ b[uy].T)[ix, iy]
    return np.concatenate([np.einsum("ij,ij->i", a[x[k : k + 8192]], b[y[k : k + 8192]]) for k in range(0, len(x), 8192)])


def links(a: np.ndarray, b: np.ndarray | None, weight_a: np.ndarray, weight_b: np.ndarray | None, cosine: float, seen: list[int] | None = None):
    """Unit vectors a against b (None: against themselves): link weights of a's and b's vectors, and spanning links (index, index), b's after a's.

    The number of cosines worked out is added to ``seen``.
    """
    apart = math.sqrt(2 - 2 * cosine)
    tree_a = CoverTree(a, apart / 8)
    own = b is None
    tree_b = tree_a if own else CoverTree(b, apart / 8)
    vb, wb = (a, weight_a) if own else (b, weight_b)
    order_a, order_b = tree_a.order, tree_b.order
    in_a, in_b = (np.concatenate(([0], np.cumsum(w[o]))) for w, o in ((weight_a, order_a), (wb, order_b)))
    got_a, got_b = np.zeros(len(a) + 1, np.int64), np.zeros(len(vb) + 1, np.int64)
    base, found, held = (0 if own else len(a)), [], 0
    compared = tree_a.compared + (0 if own else tree_b.compared)
    open_pairs = [(np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0)]
    while open_pairs:
        x, y, i, j = open_pairs.pop()
        la, lb = tree_a.level(i), tree_b.level(j)
        cos = _cosines(a, la["centre"][x], vb, lb["centre"][y])
        compared += len(x)
        distance = _distance(cos)
        reach = la["radius"][x] + lb["radius"][y]
        single = (la["end"][x] - la["start"][x] == 1) & (lb["end"][y] - lb["start"][y] == 1)
        whole = np.where(single, cos >= cosine, distance + reach <= apart - _SLACK)
        if own:
            whole |= single & (la["centre"][x] == lb["centre"][y])
        if whole.any():
            sa, ea, sb, eb = la["start"][x[whole]], la["end"][x[whole]], lb["start"][y[whole]], lb["end"][y[whole]]
            np.add.at(got_a, sa, in_b[eb] - in_b[sb]), np.subtract.at(got_a, ea, in_b[eb] - in_b[sb])
            if not own:
                np.add.at(got_b, sb, in_a[ea] - in_a[sa]), np.subtract.at(got_b, eb, in_a[ea] - in_a[sa])
            for start, end, at, order, shift, shift_at in ((sa, ea, order_b[sb], order_a, 0, base), (sb, eb, order_a[sa], order_b, base, 0)):
                many = end - start
                member = order[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                found.append((member + shift, np.repeat(at, many) + shift_at))
                held += len(member)
            if held > 1_000_000:
                found = [spanning(*(np.concatenate(c) for c in zip(*found)))]
                held = len(found[0][0])
        more = ~whole & ~single & (distance <= apart + reach + _SLACK)
        x, y = x[more], y[more]
        ends = i + 1 == len(tree_a.levels), j + 1 == len(tree_b.levels)
        if not len(x) or all(ends):
            continue
        on_a = ends[1] or not ends[0] and la["radius"].max() >= lb["radius"].max()  # the wider level is opened
        at, child = tree_a.children(i, x) if on_a else tree_b.children(j, y)
        x, y = (child, y[at]) if on_a else (x[at], child)
        for k in range(0, len(x), _PAIRS):
            open_pairs.append((x[k : k + _PAIRS], y[k : k + _PAIRS], i + on_a, j + (not on_a)))
    if seen is not None:
        seen.append(compared)
    weight_of_a, weight_of_b = np.zeros(len(a), np.int64), np.zeros(len(vb), np.int64)
    weight_of_a[order_a] = np.cumsum(got_a[:-1])
    weight_of_b[order_b] = np.cumsum(got_b[:-1])
    if own:
        weight_of_a -= weight_a
    edges = spanning(*(np.concatenate(c) for c in zip(*found))) if found else (np.zeros(0, np.int64),) * 2
    return weight_of_a, weight_of_b, edges


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    values = values / np.abs(values).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _home(table: pa.Table, centres: pa.Table) -> pa.Table:
    """The nearest centre of every vector, and the distance from it."""
    if not len(table):
        return pa.table({"node": pa.array([], pa.int64()), "home": pa.array([], pa.int64()), "away": pa.array([], pa.float64())})
    centres = centres.sort_by("node")
    cos = _unit(table["emb"]) @ _unit(centres["emb"]).T
    best = cos.argmax(1)
    return pa.table({"node": table["node"], "home": centres["node"].to_numpy()[best], "away": _distance(cos[np.arange(len(best)), best])})


def _visits(apart: float):
    def run(table: pa.Table, centres: pa.Table) -> pa.Table:
        """Every vector with the cells of smaller numbers that hold something within its reach, if anything does."""
        if not len(table):
            return pa.table({"node": pa.array([], pa.int64()), "cell": pa.array([], pa.int64())})
        centres = centres.sort_by("node")
        c, names, radius = _unit(centres["emb"]), centres["node"].to_numpy(), centres["radius"].to_numpy()
        home, away = np.searchsorted(names, table["home"].to_numpy()), table["away"].to_numpy()
        far, between = _distance(_unit(table["emb"]) @ c.T), _distance(c @ c.T)[home]
        beyond = np.where(between > 1e-6, (far**2 - away[:, None] ** 2) / (2 * np.maximum(between, 1e-6)), 0)  # from the plane between the centres
        goes = (far <= radius + apart + _SLACK) & (beyond <= apart + 1e-5) & (names[None] < names[home][:, None])
        x, cell = np.nonzero(goes)
        return pa.table({"node": table["node"].to_numpy()[x], "cell": names[cell]})

    return run


def near_duplicates(df: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", *, cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(vec, n_links, component_id, kept) for every row: links join vectors of one label at least ``cosine`` alike.

    Vectors that are null, empty, zero, or hold null, NaN or infinite components, and rows without a
    label, link with nothing; vectors of different lengths don't either. n_links counts other rows, so
    repeated rows link with one another. component_id is the smallest vec that isn't null; a row with
    a null id is never kept. An empty table gives no rows; other columns are left out. A vector of any
    length is one value.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{vec}`").alias("vec"), F.col(f"`{embedding}`").alias("emb"), F.col(f"`{label}`").alias("lab"))
    sound = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("emb", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(F.col("lab").isNotNull() & sound, F.lit(False)))
    apart = math.sqrt(2 - 2 * cosine)

    def meet(table: pa.Table) -> pa.Table:
        second = table["second"].to_numpy()
        sides = [table.filter(pa.array(s)) for s in (~second, second)]
        nodes = [s["node"].to_numpy() for s in sides]
        src, dst, n = [], [], []

        def add(names: np.ndarray, got: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> None:
            linked = got > 0
            for to, some in ((src, (names[linked], names[edges[0]])), (dst, (names[linked], names[edges[1]])), (n, (got[linked], np.zeros(len(edges[0]), np.int64)))):
                to.extend(some)

        if len(nodes[0]):
            units, weights = [_unit(s["emb"]) if len(s) else None for s in sides], [s["many"].to_numpy() for s in sides]
            if table["part"][0].as_py() == 0:
                got, _, edges = links(units[0], None, weights[0], None, cosine)
                add(nodes[0], got, edges)
            if len(nodes[1]):
                got_a, got_b, edges = links(units[0], units[1], weights[0], weights[1], cosine)
                add(np.concatenate(nodes), np.concatenate((got_a, got_b)), edges)
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in (("src", src), ("dst", dst), ("n", n))})

    with scratch():
        one = rows.where("sound").groupBy("lab", "emb").agg(F.min("vec").alias("least"), F.count("*").alias("many"))
        one = cut(one.withColumns({"dim": F.size("emb"), "node": F.monotonically_increasing_id()}), "embed-distinct")
        parts = F.ceil(F.col("n") / block).cast("int")
        share = F.least(F.lit(1.0), F.least(2 * F.col("n") / block, F.lit(CENTRES)) / F.col("n"))
        sizes = one.groupBy("lab", "dim").agg(F.count("*").alias("n"), F.min("node").alias("always"))
        sizes = cut(sizes.select("lab", "dim", "always", parts.alias("salts"), F.when(F.col("n") <= block, 0.0).otherwise(share).alias("share")), "embed-sizes")
        sized = one.select("lab", "dim", "node", "many", "emb").join(sizes, ["lab", "dim"])
        centres = sized.where((F.col("node") == F.col("always")) | (F.xxhash64("node") / F.lit(2.0**64) + 0.5 < F.col("share")))
        centres = cut(centres.select("lab", "dim", "node", "emb", "salts"), "embed-centres")
        by = ["lab", "dim", "salt"]
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).cast("int")).select(*by, "node", "emb", "salts")
        every = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        home = cut(salted.groupBy(*by).cogroup(every.groupBy(*by)).applyInArrow(_home, "node long, home long, away double"), "embed-home")
        cells = cut(home.groupBy(F.col("home").alias("cell")).agg(F.max("away").alias("radius"), parts_of(block).alias("parts")), "embed-cells")
        reached = every.join(cells, F.col("node") == F.col("cell")).select(*by, "node", "emb", "radius")
        visits = cut(salted.join(home, "node").groupBy(*by).cogroup(reached.groupBy(*by)).applyInArrow(_visits(apart), "node long, cell long"), "embed-visits")

        # groups: a part of a cell's members, with a part of what visits; members of later parts visit, too
        member = home.join(cells, F.col("home") == F.col("cell")).select("node", "cell", "parts", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int").alias("own"))
        guests = visits.join(cells.select("cell", "parts"), "cell").select("node", "cell", "parts", F.col("parts").alias("own")).union(member.where("own > 0"))
        seats = cut(guests.groupBy("cell").agg(F.count("*").alias("n")).select("cell", parts.alias("guest_parts")), "embed-seats")
        sequence = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        hosts = member.join(seats, "cell", "left").select("node", "cell", F.col("own").alias("at"), sequence(F.coalesce("guest_parts", F.lit(1))).alias("part"), F.lit(False).alias("second"))
        guests = guests.join(seats, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("guest_parts")).cast("int")).select("node", "cell", sequence(F.col("own")).alias("at"), "part", F.lit(True).alias("second"))
        dealt = hosts.union(guests).join(one.select("node", "many", "emb"), "node").select("cell", "at", "part", "second", "node", "many", "emb")
        met = cut(dealt.groupBy("cell", "at", "part").applyInArrow(meet, "src long, dst long, n long"), "embed-links")

        counts = met.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("links"))
        roots = connected_components(met.where("src <> dst"))
        full = one.join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        full = cut(full.select("lab", "emb", "least", "many", "root", F.coalesce("links", F.lit(0)).alias("links")), "embed-nodes")
        least = full.groupBy("root").agg(F.min("least").alias("component"))
        full = full.join(least, "root").select("lab", "emb", (F.col("links") + F.col("many") - 1).alias("n_links"), "component")
        full = keep(cut(full, "embed-result"))
    linked = rows.where("sound").join(full, ["lab", "emb"]).select("vec", "n_links", "component")
    alone = rows.where("not sound").select("vec", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(rows.schema["vec"].dataType).alias("component"))
    component = F.coalesce("component", "vec")
    return linked.union(alone).select(F.col("vec").alias(vec), F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec") == component, F.lit(False)).alias("kept"))


def parts_of(block: int):
    """How many parts of a block's size the rows of a group make."""
    return F.ceil(F.count("*") / block).cast("int")
