"""Parent-child links to full hierarchies: roots, depths, paths, ancestors and cycles.

Records are cut into blocks of neighbouring arrival order. Inside a block every walk up is contracted to
where it leaves the block (a fragment exit) or ends (a root). The records that exits point to, with their
contracted rows, are the smaller quotient forest; it is solved the same way over blocks sixteen times as
wide until it fits one task, and its answers are joined back to the exits. Records on a cycle are not
contracted before the last level, nor are walks past a record that has an exit and another end, which may lie
on a cycle across blocks; so a cycle is seen whole even if it crosses blocks, and each contracted row
remembers the least key on its way.

Where the last quotient is larger than one task should take, its finished layers are resolved by joins
first, until the rest fits.

Defined cases: links to keys that are no record do not count; null and empty keys refer to nothing; repeated
records and repeated links count once; a record may have several parents (each distinct (root, depth) is a
row); a walk that reaches a cycle ends there with depth -1 and the least key on the cycle as root (of all
records that reach each other, where cycles share records); records without parents give no row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomill.common import cut, norm_key

BLOCK_ROWS = 16_384
WIDEN = 16
TASK_ROWS = 2_000_000
EXIT, ROOT, CYCLE = 0, 1, 2
_ROW = "link string, node string, nb bigint, anc string, ab bigint, dist bigint, kind int, least string, path array<string>, via array<string>"


def _components(n: int, up: list[list[int]]) -> list[list[int]]:
    """Strongly connected components, each after all that it leads to."""
    index, low, on = [-1] * n, [0] * n, [False] * n
    out, stack, count = [], [], 0
    for s in range(n):
        if index[s] >= 0:
            continue
        work = [(s, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            for j in range(i, len(up[v])):
                w = up[v][j]
                if index[w] < 0:
                    work += [(v, j + 1), (w, 0)]
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    group = []
                    while not group or group[-1] != v:
                        group.append(stack.pop())
                        on[group[-1]] = False
                    out.append(group)
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return out


def _contract(key: tuple, t: pa.Table, last: bool, paths: bool, ways: bool) -> pa.Table:
    """Contract the walks of one block. Input: the columns of _ROW and ``here`` (the ancestor is in this block)."""
    link = key[0].as_py()
    node, anc, least = (t[c].to_pylist() for c in ("node", "anc", "least"))
    dist, kind, here, nbs, abs_ = (t[c].to_pylist() for c in ("dist", "kind", "here", "nb", "ab"))
    path, via = t["path"].to_pylist() if paths else None, t["via"].to_pylist() if ways else None
    own = {x: i for i, x in enumerate(dict.fromkeys(node))}
    names, block = list(own), {}
    rows: list[list[int]] = [[] for _ in own]
    up: list[list[int]] = [[] for _ in own]
    for r, x in enumerate(node):
        i = own[x]
        rows[i].append(r)
        block[x] = nbs[r]
        if kind[r] == EXIT:
            block[anc[r]] = abs_[r]
            if here[r] and anc[r] in own:
                up[i].append(own[anc[r]])

    # Per record: (ancestor, distance, kind) -> (least key on the way, path, all records on the ways).
    result: list[dict] = [{} for _ in own]

    def put(res: dict, k: tuple, low: str, way: tuple, all_: frozenset) -> None:
        old = res.get(k)
        res[k] = (low, way, all_) if old is None else (min(old[0], low), min(old[1], way), old[2] | all_)

    looped, parted = [False] * len(names), [False] * len(names)
    for group in _components(len(names), up):
        if len(group) > 1 or group[0] in up[group[0]]:
            for v in group:
                looped[v] = True
            if last:
                inside = {names[v] for v in group}
                low = min([*inside, *(least[r] for v in group for r in rows[v] if kind[r] == EXIT and anc[r] in inside)])
                # Contracted ways between members are on the cycle too, and what is above one member is above all.
                near = set(inside) if ways else set()
                for r in (r for v in group for r in rows[v] if ways):
                    near.update(via[r], [anc[r]])
                    if anc[r] in own and anc[r] not in inside:
                        for (a, _, k), (_, _, all2) in result[own[anc[r]]].items():
                            near.update(all2, [a] if k == ROOT else [])
                for v in group:
                    put(result[v], (low, -1, CYCLE), low, (names[v],), frozenset(near))
            else:
                for v in group:
                    for r in rows[v]:
                        put(result[v], (anc[r], dist[r], kind[r]), least[r], tuple(path[r]) if paths else (), frozenset(via[r]) if ways else frozenset())
            continue
        v = group[0]
        for r in rows[v]:
            way, all_ = tuple(path[r]) if paths else (), frozenset(via[r]) if ways else frozenset()
            if kind[r] != EXIT or not here[r]:
                put(result[v], (anc[r], dist[r], kind[r]), least[r], way, all_)
            elif anc[r] not in own:
                put(result[v], (anc[r], dist[r], ROOT), least[r], way, all_)
            elif not last and (looped[own[anc[r]]] or parted[own[anc[r]]]):
                put(result[v], (anc[r], dist[r], EXIT), least[r], way, all_)
            else:
                step = frozenset([anc[r]]) if ways else all_
                for (a, d, k), (low, way2, all2) in result[own[anc[r]]].items():
                    put(result[v], (a, -1 if k == CYCLE else d + dist[r], k), min(low, least[r]), way + way2, all_ | step | all2)
        # A record that leaves the block and has another end as well: on a cycle across blocks, the other end does not count.
        ends = {(a, k) for a, _, k in result[v]}
        parted[v] = len(ends) > 1 and any(k == EXIT for _, k in ends)
    out = [
        (link, names[v], block[names[v]], a, block[a] if k == EXIT else None, d, k, low, list(way), sorted(all_ - {names[v]}))
        for v in range(len(names))
        for (a, d, k), (low, way, all_) in result[v].items()
    ]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    cols = list(zip(*out, strict=True)) if out else [[]] * 10
    return pa.table([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names=[f.split()[0] for f in _ROW.split(", ")])


def _contracted(rows: DataFrame, width: int, last: bool, paths: bool, ways: bool) -> DataFrame:
    wide = lambda c: F.floor(F.col(c) / width).cast("bigint")
    here = F.lit(True) if last else F.coalesce(wide("nb") == wide("ab"), F.lit(False))
    block = F.lit(0).cast("bigint") if last else wide("nb")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        return _contract(key, t, last, paths, ways)

    return (
        rows.withColumn("here", here)
        .withColumn("_block", block)
        .groupBy("link", "_block")
        .applyInArrow(run, _ROW)
    )


def _joined(rows: DataFrame, solved: DataFrame, ways: bool) -> DataFrame:
    """Exit rows continued by the solved rows of the record they point to; without such rows it is a root."""
    q = solved.select(
        "link", F.col("node").alias("anc"), *[F.col(c).alias(f"_{c}") for c in ("anc", "ab", "dist", "kind", "least", "path", "via")]
    )
    some, no = F.col("_anc").isNotNull(), F.array().cast("array<string>")
    return rows.join(q, ["link", "anc"], "left").select(
        "link",
        "node",
        "nb",
        F.coalesce("_anc", "anc").alias("anc"),
        F.col("_ab").alias("ab"),
        F.when(F.col("_kind") == CYCLE, -1).when(some, F.col("dist") + F.col("_dist")).otherwise(F.col("dist")).cast("bigint").alias("dist"),
        F.coalesce("_kind", F.lit(ROOT)).alias("kind"),
        F.least("least", "_least").alias("least"),
        F.concat("path", F.coalesce("_path", no)).alias("path"),
        F.when(some, F.array_except(F.array_union("via", F.array_union(F.array("anc"), "_via")), F.array("node"))).otherwise(F.col("via")).alias("via") if ways else "via",
    )


def _unique(rows: DataFrame, paths: bool) -> DataFrame:
    if not paths:
        return rows.dropDuplicates(["link", "node", "anc", "dist", "kind"])
    keys = ["link", "node", "nb", "anc", "ab", "dist", "kind"]
    merged = rows.groupBy(*keys).agg(
        F.min("least").alias("least"), F.min("path").alias("path"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("via")))).alias("via")
    )
    return merged.select(*[f.split()[0] for f in _ROW.split(", ")])


def _peel(rows: DataFrame, task_rows: int, paths: bool, ways: bool) -> DataFrame:
    """Resolve finished layers by joins until the unfinished rows fit one task (or all of them lie on cycles)."""
    left = rows.where(F.col("kind") == EXIT).count()
    while left > task_rows:
        exits = F.col("kind") == EXIT
        open_nodes = rows.where(exits).select("link", F.col("node").alias("anc")).distinct()
        stuck = rows.where(exits).join(open_nodes, ["link", "anc"], "left_semi")
        free = rows.where(exits).join(open_nodes, ["link", "anc"], "left_anti")
        done = rows.where(~exits)
        rows = cut(_unique(done.unionByName(stuck).unionByName(_joined(free, done, ways)), paths))
        before, left = left, rows.where(F.col("kind") == EXIT).count()
        if left >= before:
            break
    return rows


def _resolve(rows: DataFrame, width: int, n_blocks: int, task_rows: int, paths: bool, ways: bool) -> DataFrame:
    exits = rows.where(F.col("kind") == EXIT)
    targets = exits.select("link", F.col("anc").alias("node")).distinct()
    quotient = cut(rows.join(targets, ["link", "node"], "left_semi").select(*rows.columns))
    n = quotient.count()
    solved = quotient
    if n:
        width, n_blocks = width * WIDEN, -(-n_blocks // WIDEN)
        if n > task_rows and n_blocks == 1:
            quotient = _peel(quotient, task_rows, paths, ways)
        if n <= task_rows or n_blocks == 1:
            solved = _contracted(quotient, width, True, paths, ways)
        else:
            solved = _resolve(cut(_contracted(quotient, width, False, paths, ways)), width, n_blocks, task_rows, paths, ways)
    # What the quotient answers about its own records holds; a record on a cycle has no other ends.
    rest = rows.join(targets, ["link", "node"], "left_anti").select(*rows.columns) if n else rows
    done, exits = rest.where(F.col("kind") != EXIT), rest.where(F.col("kind") == EXIT)
    ends = done.unionByName(_joined(exits, solved, ways))
    return _unique(ends.unionByName(solved) if n else ends, paths)


def walks(
    df: DataFrame,
    node: str,
    sequence: str,
    links: dict[str, str],
    paths: bool = False,
    block_rows: int = BLOCK_ROWS,
    task_rows: int = TASK_ROWS,
    ways: bool | None = None,
) -> DataFrame:
    """(link, node, anc, dist, kind, path, via): each distinct end that a record with a parent reaches.

    ``links`` maps a link's name to the column with the parent key or keys. kind is 1 for a root, 2 for a
    cycle. With ``paths``, path runs from the record up to the one below the end (the least such path), and
    via has all records on any of the ways, unless ``ways`` is off; for a walk into a cycle also all others on the
    cycle and above it.
    """
    ways = paths if ways is None else ways
    keys = {
        k: F.array_distinct(F.transform(c, norm_key)) if df.schema[c].dataType.typeName() == "array" else F.array(norm_key(c))
        for k, c in links.items()
    }
    one = (
        df.where(F.col(node) != "")
        .groupBy(F.col(node).alias("node"))
        .agg(F.min(sequence).alias("_seq"), F.min_by(F.struct(*[v.alias(k) for k, v in keys.items()]), sequence).alias("_to"))
    )
    # Blocks are spans of the arrival sequence, where a parent is mostly near its child.
    one = cut(one.withColumn("nb", F.coalesce(F.floor(F.col("_seq") / block_rows), F.lit(0)).cast("bigint")))
    n_blocks = (one.agg(F.max("nb") - F.min("nb")).first()[0] or 0) + 1
    pairs = F.array(*[F.struct(F.lit(k).alias("link"), F.col(f"_to.{k}").alias("keys")) for k in links])
    edges = (
        one.select("node", "nb", F.explode(pairs).alias("p"))
        .select("node", "nb", "p.link", F.explode("p.keys").alias("anc"))
        .where("anc is not null")
        .join(one.select(F.col("node").alias("anc"), F.col("nb").alias("ab")), "anc")
        .select(
            "link", "node", "nb", "anc", "ab",
            F.lit(1).cast("bigint").alias("dist"),
            F.lit(EXIT).alias("kind"),
            F.col("node").alias("least"),
            (F.array("node") if paths else F.array().cast("array<string>")).alias("path"),
            F.array().cast("array<string>").alias("via"),
        )
    )
    rows = cut(_contracted(edges, 1, False, paths, ways))
    return _resolve(rows, 1, n_blocks, task_rows, paths, ways)
