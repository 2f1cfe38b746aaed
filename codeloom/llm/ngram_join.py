"""Exact n-gram Jaccard self-join by grouped prefixes.

Each document is the set of its 5-word shingles, as 64-bit hashes in one global order: shingles that many
documents share come last, the others go by hash. Two sets with a Jaccard of 0.8 or more share a shingle among
the first ``n - ceil(0.8 n) + 1`` of each, and their sizes differ by a fifth at most.

* Documents with the same set are one node. Nodes with the same prefix and size are one group, and a shingle
  list holds groups, not documents.
* Lists are searched for links in rounds: every group of a list is compared with the list's hub, every node of a
  group with the group's hub. What is linked becomes one component, and only lists with several components go on.
* Then all pairs of groups of different components that still share a list are formed, pass a filter on their sizes and on
  the number of common shingles of their prefixes, are expanded to nodes, and are verified. That number has a lower
  bound, so the prefixes are filtered by prefix once more: only shingles in the shortest lists bring groups together.
  So every link is either verified or lies inside a component that verified links made:
  components are exact, and a group of copies costs a number of pairs in proportion to its members.

The order hint (which shingles are common) comes from counts over all documents. It is bounded by ``MAX_COMMON``
values and decides only the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm import words as W
from codeloom.llm.components import components
from codeloom.settings import materialize, release_shuffles

SHINGLE = 5
#: Jaccard threshold, in hundredths.
PERCENT = 80
#: Most values of the order hint that are sent to the tasks (8 bytes each).
MAX_COMMON = 500_000
#: The remaining pairs are expanded once they are no more than so many for each row of the open lists, or a round of hubs has not halved them.
EXPANSION = 8
#: So many ids may be sent to all tasks at once.
MAX_SENT_IDS = 1_000_000


def row_sets(piece: W.Slice, n: int = SHINGLE) -> tuple[list[np.ndarray], W.Words]:
    """The sorted distinct shingle hashes of each row; a row of fewer words has its whole sequence as the one shingle."""
    found = W.words(piece, W.GRAPHIC)
    grams = W.run_hashes(found.hashes, n)
    sets = []
    for low, high in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if high - low >= n:
            sets.append(np.unique(grams[low : high - n + 1]))
        elif high > low:
            sets.append(W.run_hashes(found.hashes[low:high], high - low) ^ np.uint64(high - low))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets, found


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _local_counts(text_col: str, n: int):
    """Shingles that two or more documents of a batch share, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for piece in W.slices(W.text_column(batch, text_col)) for s in row_sets(piece, n)[0]]
            if not sets:
                continue
            values = np.sort(np.concatenate(sets))
            new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(values)))
            often = counts > 1
            yield pa.RecordBatch.from_arrays([W.signed(values[new[often]]), pa.array(counts[often].astype(np.int64))], names=["token", "n"])

    return run


def common_shingles(docs: DataFrame, text_col: str, n: int = SHINGLE, most: int = MAX_COMMON) -> np.ndarray:
    """The shingles with the highest counts, commonest last, as many as ``most`` allows at a power of two of the count.

    Counts are sums over batches of what two or more documents of a batch share. They depend on how rows are dealt to
    batches, which is why they serve as an order hint only.
    """
    counted = docs.select(text_col).mapInArrow(_local_counts(text_col, n), "token bigint, n bigint")
    totals = materialize(counted.groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 8"), "common-shingles")
    sizes = totals.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()
    level, room = 64, most
    for row in sorted(sizes, key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            break
        level = row["level"]
    rows = totals.filter(F.floor(F.log2("n")) >= level).orderBy("n", "token").toPandas()
    return rows["token"].to_numpy(np.int64, copy=True).view(np.uint64)


def _ordered_prefixes(text_col: str, n: int, percent: int, common: np.ndarray, with_prefix: bool):
    by_value = np.argsort(common)
    values, ranks = common[by_value], by_value + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = W.text_column(batch, text_col)
            for piece in W.slices(column):
                sets, _ = row_sets(piece, n)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                rank = np.zeros(len(flat), np.int64)
                if len(values) and len(flat):
                    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                    rank = np.where(values[at] == flat, ranks[at], 0)
                prefixes, groups, contents = [], [], []
                low = 0
                for s in sets:
                    own = rank[low : low + len(s)]
                    ordered = s[np.argsort(own, kind="stable")] if own.any() else s
                    prefix = ordered[: prefix_size(len(s), percent)] if len(s) else s
                    low += len(s)
                    if with_prefix:
                        prefixes.append(prefix)
                        continue
                    groups.append(np.bitwise_xor.reduce(W.mix(prefix + np.uint64(len(s)))) if len(s) else np.uint64(0))
                    contents.append((np.add.reduce(s), np.add.reduce(W.mix(s))))
                out = {"doc_id": batch.column("doc_id").slice(piece.first, len(sets)), "n": pa.array(sizes)}
                if with_prefix:
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                    out["tokens"] = pa.ListArray.from_arrays(pa.array(ends), W.signed(np.concatenate(prefixes)))
                else:
                    out["grp"] = W.signed(np.array(groups, np.uint64))
                    out["set_a"] = W.signed(np.array([a for a, _ in contents], np.uint64))
                    out["set_b"] = W.signed(np.array([b for _, b in contents], np.uint64))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.slices(W.text_column(batch, "text")):
                sets, _ = row_sets(piece, n)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(piece.first, len(sets)), pa.ListArray.from_arrays(pa.array(ends), W.signed(np.concatenate(sets)))],
                    names=["node", "tokens"],
                )

    return run


def _verified(pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough; sets are made anew, for nodes in pairs only."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    kind = rows.schema["doc_id"].dataType.simpleString()
    # Texts stay where they are while few are wanted; beyond the bound both sides are shuffled.
    sent = F.broadcast(wanted) if wanted.count() <= MAX_SENT_IDS else wanted
    source = rows.join(sent, rows["doc_id"] == wanted["node"]).select("node", "text")
    sets = materialize(source.mapInArrow(_set_rows(n), f"node {kind}, tokens array<bigint>"), "join-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb")).cast("bigint")
    return both.filter(100 * shared >= percent * (F.size("ta") + F.size("tb") - shared)).select("a", "b")


def _size_filter(x: str, y: str, percent: int) -> str:
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def _only_open(work: DataFrame) -> DataFrame:
    """The lists in which several components are left."""
    several = work.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
    return work.join(several, "token")


def _ranked(outer: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(token, grp, rank): the place of each listed shingle in its group's prefix when shingles in short lists come first.

    Shingles of the prefix that no other group has are in no list; they take the first places.
    """
    sizes = outer.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    by_group = Window.partitionBy("grp")
    placed = outer.join(sizes, "token").withColumns({
        "nth": F.row_number().over(by_group.orderBy("size", "token")), "listed": F.count("*").over(by_group)
    })
    groups = nodes.select("grp", "n").distinct()
    return placed.join(groups, "grp").select("token", "grp", F.expr(f"n - ceil({percent} * n / 100.0D) + nth - listed").alias("rank"))


def _collapsed(lists: DataFrame, named: DataFrame, label: str) -> DataFrame:
    """Open lists with one node for each group and component."""
    grouped = lists.join(named, "grp").groupBy("token", "grp", "rank", "n", "component").agg(F.min("node").alias("node"))
    return materialize(_only_open(grouped), label)


def _votes_needed(x: str, y: str, percent: int) -> str:
    """How many shingles the prefixes of sets of ``x`` and ``y`` shingles must have in common.

    Of the prefix that ends first in the global order, a shingle that is not common to the prefixes is not in the other
    set at all. So the overlap is at most the common ones plus what lies behind that prefix.
    """
    behind = f"ceil({percent} * greatest({x}, {y}) / 100.0D) - 1"
    return f"greatest(1, ceil({percent} * ({x} + {y}) / (100.0D + {percent}) - 1e-9) - ({behind}))"


def _early(rank: str, n: str, needed: str, percent: int) -> str:
    """Whether a shingle is among the first of its prefix that two prefixes with ``needed`` common ones must share one of."""
    return f"{rank} < {n} - ceil({percent} * {n} / 100.0D) + 2 - {needed}"


def _hub_pairs(work: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each node of the open lists the one hub, of another component, with which it shares most lists."""
    order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    hub = F.struct(order.alias("by"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("component").alias("hub_component"))
    hubs = work.groupBy("token").agg(F.min(hub).alias("h")).select("token", "h.hub", "h.hub_n", "h.hub_component")
    near = work.join(hubs, "token").filter("component <> hub_component").filter(_size_filter("n", "hub_n", percent))
    votes = near.groupBy("node", "n", "hub", "hub_n").agg(F.count("*").alias("votes"), F.max(F.col("token") == F.col("grp")).alias("same_prefix"))
    votes = votes.filter(F.col("same_prefix") | F.expr(f"votes >= {_votes_needed('n', 'hub_n', percent)}"))
    return votes.groupBy("node").agg(F.max_by("hub", F.struct("votes", "hub")).alias("b")).select(F.col("node").alias("a"), "b")


def _n_remaining(work: DataFrame, percent: int) -> tuple[int, int]:
    """About how many rows the expansion of the open lists would make (as for equal sizes), and how many they have."""
    early = F.expr(_early("rank", "n", _votes_needed("n", "n", percent), percent))
    by_component = work.groupBy("token", "component").agg(F.count_if(early).cast("double").alias("m"), F.count("*").alias("all"))
    totals = by_component.groupBy("token").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"), F.sum("all").alias("all"))
    row = totals.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs"), F.sum("all").alias("rows")).first()
    return int(row["pairs"] or 0), int(row["rows"] or 0)


def _remaining_pairs(work: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different components that can be similar by their sizes and prefixes.

    Pairs of groups come first: they meet in the early part of both prefixes, and the whole prefixes must have enough shingles
    in common. Pairs that are left are expanded to nodes.
    """
    left = work.select("token", F.col("rank").alias("ra"), F.col("grp").alias("ga"), F.col("n").alias("na"), F.col("component").alias("ca"))
    right = work.select("token", F.col("rank").alias("rb"), F.col("grp").alias("gb"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    needed = _votes_needed("na", "nb", percent)
    both_early = f"{_early('ra', 'na', needed, percent)} AND {_early('rb', 'nb', needed, percent)}"
    pairs = left.join(right, "token").filter("ca < cb").filter(_size_filter("na", "nb", percent)).filter(both_early)
    pairs = pairs.select("ga", "na", "ca", "gb", "nb", "cb").distinct()
    # What is gathered here is part of one document's prefix.
    prefixes = work.select("grp", "token").distinct().groupBy("grp").agg(F.collect_list("token").alias("tokens"))
    pairs = pairs.join(prefixes.select(F.col("grp").alias("ga"), F.col("tokens").alias("ta")), "ga").join(prefixes.select(F.col("grp").alias("gb"), F.col("tokens").alias("tb")), "gb")
    pairs = pairs.filter(f"ga = gb OR size(array_intersect(ta, tb)) >= {needed}")
    a = named.select(F.col("grp").alias("ga"), F.col("component").alias("ca"), F.col("node").alias("a"))
    b = named.select(F.col("grp").alias("gb"), F.col("component").alias("cb"), F.col("node").alias("b"))
    return pairs.select("ga", "ca", "gb", "cb").join(a, ["ga", "ca"]).join(b, ["gb", "cb"]).select("a", "b").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs without white space. Two documents link when 100 * |intersection| >= percent * |union|;
    component_id is the smallest doc_id that links reach. Null and empty texts have no shingles and no links. Rows that
    repeat an id are one document with the links of all their texts. A row with a null id has no links and a null component.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    common = common_shingles(rows, "text", n)
    members = materialize(
        rows.mapInArrow(_ordered_prefixes("text", n, percent, common, False), f"doc_id {kind}, n bigint, grp bigint, set_a bigint, set_b bigint"),
        "join-members",
    )
    # A node is a set; it goes by the smallest id that has it.
    real = members.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = materialize(real.groupBy("set_a", "set_b", "n", "grp").agg(F.min("doc_id").alias("node")), "join-nodes")

    postings = rows.filter("doc_id IS NOT NULL").mapInArrow(_ordered_prefixes("text", n, percent, common, True), f"doc_id {kind}, n bigint, tokens array<bigint>")
    postings = postings.select("doc_id", F.explode("tokens").alias("token"))
    shared = postings.groupBy("token").count().filter("count > 1").select("token")
    by_node = nodes.select(F.col("node").alias("doc_id"), "grp")
    outer = postings.join(shared, "token").join(by_node, "doc_id").select("token", "grp").distinct()
    outer = materialize(outer, "join-lists")
    release_shuffles(docs.sparkSession)
    # Nodes with one prefix are a list too, under the group's own key, which comes before every shingle.
    inner = nodes.groupBy("grp").count().filter("count > 1").select(F.col("grp").alias("token"), "grp", F.lit(-(1 << 40)).alias("rank"))
    lists = materialize(_ranked(outer, nodes, percent).union(inner), "join-open-lists")

    links = None
    named = nodes.select("node", "grp", "n", F.col("node").alias("component"))
    turn, last, before = 0, False, 0
    while not last:
        work = _collapsed(lists, named, f"join-work-{turn}")
        pairs_left, rows_left = _n_remaining(work, percent)
        if not rows_left:
            break
        # Hubs first; then everything: once it costs no more than a few rows for each row of the lists, or a hub round hardly helped.
        last = turn > 0 and (pairs_left <= EXPANSION * rows_left or 2 * pairs_left > before)
        before = pairs_left
        pairs = _remaining_pairs(work, named, percent) if last else _hub_pairs(work, turn, percent)
        found = materialize(_verified(materialize(pairs, f"join-pairs-{turn}"), rows, n, percent), f"join-links-{turn}")
        links = found if links is None else links.union(found)
        label = materialize(components(links), f"join-labels-{turn}")
        named = nodes.join(label, "node", "left").select("node", "grp", "n", F.coalesce("component", "node").alias("component"))
        lists = work.select("token", "grp", "rank").distinct()
        release_shuffles(docs.sparkSession)
        turn += 1
    by_set = nodes.select("set_a", "set_b", "n", "node").join(named.select("node", "component").distinct(), "node")
    done = members.join(by_set, ["set_a", "set_b", "n"], "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, and those without an id, with their own columns."""
    found = similar_documents(docs, id_col, text_col, n, percent)
    dropped = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["__id"], "left_anti")
