"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of shingles of five words. Two documents are linked if the Jaccard
similarity of their sets is at least 0.8.

1. Every whole text gives its set's digest and, for each of ``TREES`` trees, a label of
   ``DEPTH`` MinHash values. Texts stay where they are.
2. Documents with the same set are one from here on (a copy is linked to its copies and to
   whatever they are linked to), so thousands of copies cost as much as one.
3. Each tree is a prefix trie: labels are dealt by a prefix and sorted, so that documents
   with longer common prefixes stand closer together (``_climb``). The longest prefixes are
   matched first; a document that is very like another one there is led by it, and only the
   leaders go on to the next shorter prefix. Sketches (128 MinHash values of 8 bits) tell
   which documents may be similar, and only edges leave the task.
4. The prefix is first shortened to where a pair right at the threshold meets in some tree
   with the target probability (``prefix_depth``). Then the recall on these data is
   estimated from how many documents met a surely similar one (``MET``) in one and in two
   trees only (``unseen``), and while it is below the target, prefixes of the documents that met in no
   or one tree are shortened further.
5. Components of the edges are families: whatever may be linked is in one. Only the texts of
   families are shuffled. Families are cut into blocks of about ``BLOCK``, every two blocks
   are a task of their own, and every pair in them is verified on the whole sets. What leaves
   is a count of links per document and a spanning forest of the links; its components are
   the classes.

Defined results: null text is empty; a document without words is linked to nothing, not
even to another one; with fewer than five words the one shingle is all of them; rows that
repeat an id and text are copies; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import runs as R
from framelens.llm.common import joined, stored
from framelens.llm.components import components
from framelens.llm.superkmers import Codes, words_of

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
TARGET = 0.9999
#: Share of the documents with a partner that must have met one, by the estimate on the data.
RECALL = 0.999
SKETCH = 128
#: An estimate by a sketch is off by more than this many deviations once in 100,000 times.
MARGIN = 4.3
#: Estimated similarity from which a document is led by another one.
LED = 0.9
#: Estimate from which a document counts as met: two deviations above the threshold. Pairs below the
#: threshold meet in few trees by right, and would look like missed ones if the noise let them count.
MET = THRESHOLD + 2 * float(np.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH))
#: Documents of a prefix that are looked at together, and of a family that are verified together.
BLOCK = 512
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, longest: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with probability target."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingles(text: str | None, codes: Codes) -> np.ndarray:
    """Sorted distinct 64-bit digests of a whole text's shingles."""
    own = np.fromiter(map(codes.__getitem__, words_of(text or "")), np.uint64)
    if not len(own):
        return own
    size = min(SHINGLE, len(own))
    starts = np.arange(len(own) - size + 1)
    return np.unique(R.Digests(own).of(starts, starts + size))


def signature(found: np.ndarray, count: int) -> np.ndarray:
    """count MinHash values of a set of digests."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 1024):
        part = short[start : start + 1024, None]
        np.minimum(least, (part * _FACTORS[:count] + _SHIFTS[:count]).min(0), out=least)
    return least


def unseen(met: list[tuple[int, int]]) -> float:
    """Estimate (Chao's) of how many documents with a partner met none, from (trees in which one was met, documents)."""
    once, twice = (next((n for t, n in met if t == k), 0) for k in (1, 2))
    return once * (once - 1) / (2 * (twice + 1))


_SIGNED = "doc_id long, _tid long, n int, s1 long, s2 long, labels binary, sketch binary"


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes = Codes()
    with np.errstate(over="ignore"):
        for batch in batches:
            rows = []
            for doc_id, tid, text in zip(batch["doc_id"], batch["_tid"], batch["text"], strict=True):
                found = shingles(text, codes)
                if not len(found):
                    rows.append((doc_id, tid, 0, 0, 0, None, None))
                    continue
                # The least of many numbers has few high bits: they are spread before they are cut.
                values = signature(found, TREES * DEPTH) * np.uint32(0x9E3779B1)
                one, two = int(R.mixed(found).sum().view(np.int64)), int(np.bitwise_xor.reduce(R.mixed(found * np.uint64(3))).view(np.int64))
                rows.append((doc_id, tid, len(found), one, two, (values >> np.uint32(16)).astype(">u2").tobytes(), (values[:SKETCH] >> np.uint32(24)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "_tid", "n", "s1", "s2", "labels", "sketch"])


#: What a set is known by: one of its documents.
IDS = ["doc_id", "_tid"]


def _blocks(rows: DataFrame, key: str, size: str) -> DataFrame:
    """rows once for every pair of blocks (x <= y) of their group that they belong to; side: their block's."""
    count = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(key, *IDS), count).cast("int")
    other = F.explode(F.sequence(F.lit(0), count - 1))
    out = rows.withColumn("_own", own).withColumn("_other", other)
    return out.withColumn("x", F.least("_own", "_other")).withColumn("y", F.greatest("_own", "_other")).withColumn("side", (F.col("_own") == F.col("y")).cast("int")).drop("_own", "_other")


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by columns, group by group."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        keys = rows[columns].to_numpy()
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip(np.append(0, edges[:-1]), edges, strict=False):
            yield rows.iloc[a:b]
        rest = rows.iloc[edges[-1] :] if len(edges) else rows
    if rest is not None and len(rest):
        yield rest


def spanning(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (places) of a spanning forest of the graph with this (symmetric) adjacency, as stars round the least member."""
    left, out = np.ones(len(ids), bool), []
    for k in np.lexsort((ids[:, 1], ids[:, 0])):
        if left[k]:
            member = np.zeros(len(ids), bool)
            front = [k]
            member[k] = True
            while len(front):
                reached = linked[front].any(0) & ~member
                member |= reached
                front = np.flatnonzero(reached)
            left &= ~member
            out += [(int(k), int(r)) for r in np.flatnonzero(member) if r != k]
    return out


def _pairs(rows: pd.DataFrame) -> np.ndarray:
    """Which pairs of the group's rows are its own: all within a block, else those from side to side."""
    side = rows["side"].to_numpy()
    if rows["x"].iloc[0] == rows["y"].iloc[0]:
        return ~np.eye(len(rows), dtype=bool)
    return side[:, None] != side[None, :]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of sketches a to each of b."""
    same = np.zeros((len(a), len(b)), np.int16)
    for start in range(0, SKETCH, 16):
        same += (a[:, None, start : start + 16] == b[None, :, start : start + 16]).sum(2, dtype=np.int16)
    # Different values agree in 8 bits once in 256 times.
    return np.maximum(0.0, (same / SKETCH - 1 / 256) / (255 / 256))


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimate from which leaders with these radii are linked, so that no pair at the threshold is lost between those that they lead."""
    least = np.clip(THRESHOLD - a[:, None] - b[None, :], 0.05, 1.0)
    return least - MARGIN * np.sqrt(least * (1 - least) / SKETCH)


_EDGES = "a1 long, a2 long, b1 long, b2 long, tree int, node long, radius double, sketch binary"


def _climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges; documents that met a similar one (tree, no b); leaders of prefixes that are dealt to several blocks (sketch)."""
    out: list[tuple] = []
    for rows in _groups(batches, ["node", "block"]):
        ids, rest = rows[IDS].to_numpy(), rows["rest"].tolist()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), SKETCH)
        tree, node = int(rows["tree"].iloc[0]), int(rows["node"].iloc[0])
        radius, met, leaders = np.zeros(len(rows)), np.zeros(len(rows), bool), np.arange(len(rows))
        for size in range(len(rest[0]), -1, -2):  # the longest common prefixes first
            going: list[int] = []
            edges = np.flatnonzero([rest[a][:size] != rest[b][:size] for a, b in zip(leaders[:-1], leaders[1:], strict=True)]) + 1
            for own in np.split(leaders, edges):
                while len(own) > 1:
                    near = alike(sketch[own[:1]], sketch[own[1:]])[0]
                    led = own[1:][near >= LED]
                    out += [(*ids[own[0]].tolist(), *ids[k].tolist(), tree, None, None, None) for k in led]
                    if len(led):
                        met[own[0]] = met[led] = True
                        # Those that a led document leads are as far as both ways together.
                        radius[own[0]] = max(radius[own[0]], float((1 - near[near >= LED] + 0.1 + radius[led]).max()))
                    going.append(int(own[0]))
                    own = own[1:][near < LED]
                going += own.tolist()
            leaders = np.array(sorted(going))
        near = alike(sketch[leaders], sketch)
        near[np.arange(len(leaders)), leaders] = 0.0
        # Who is led counts as well: a leader has met those that others lead.
        met[leaders[(near >= MET).any(1)]] = True
        near = near[:, leaders]
        links = near >= needed(radius[leaders], radius[leaders])
        out += [(*ids[leaders[a]].tolist(), *ids[leaders[b]].tolist(), tree, None, None, None) for a, b in spanning(ids[leaders], links & (near > 0))]
        out += [(*ids[k].tolist(), None, None, tree, None, None, None) for k in np.flatnonzero(met)]
        if rows["size"].iloc[0] > BLOCK:
            out += [(*ids[k].tolist(), None, None, tree, node, float(radius[k]), sketch[k].tobytes()) for k in leaders]
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _edges(out: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in _EDGES.split(", ")]
    columns = list(zip(*out, strict=True)) or [[]] * len(names)
    kinds = ["Int64"] * 4 + ["Int32", "Int64", "Float64", object]
    return pd.DataFrame({n: pd.array(c, k) if k is not object else pd.Series(list(c), dtype=object) for n, c, k in zip(names, columns, kinds, strict=True)})


def _leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges between the leaders of different blocks of a prefix."""
    out: list[tuple] = []
    for rows in _groups(batches, ["node", "x", "y"]):
        ids, radius = rows[IDS].to_numpy(), rows["radius"].to_numpy()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), SKETCH)
        links = (alike(sketch, sketch) >= needed(radius, radius)) & _pairs(rows)
        out += [(*ids[a].tolist(), *ids[b].tolist(), None, None, None, None) for a, b in spanning(ids, links)]
    yield _edges(out)


def _candidates(reps: DataFrame, depth: int, count: int, only: DataFrame | None) -> DataFrame:
    """Edges (as _climb and _leaders give them) between sets that share a prefix of depth values in some tree; only: of prefixes that hold one of these."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = reps.select(*IDS, "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    start = f"tree * {2 * DEPTH} + 1"
    entries = entries.select(*IDS, "tree", F.expr(f"xxhash64(tree, substring(labels, {start}, {2 * depth}))").alias("node"), F.expr(f"substring(labels, {start} + {2 * depth}, {2 * (DEPTH - depth)})").alias("rest"))
    shared = entries.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    if only is not None:
        shared = shared.join(entries.join(only, IDS, "left_semi").select("node").distinct(), "node", "left_semi")
    shared = stored(shared.withColumn("_times", F.col("size")))
    met = joined(entries, shared, ["node"], "_times", count * TREES)
    met = met.withColumn("block", F.pmod(F.xxhash64("node", *IDS), F.ceil(F.col("size") / F.lit(BLOCK))).cast("int")).join(reps.select(*IDS, "sketch"), IDS)
    dealt = met.repartition(parts, "node", "block").sortWithinPartitions("node", "block", "rest", *IDS)
    edges = stored(dealt.mapInPandas(_climb, _EDGES))
    # Large prefixes: what the leaders of their blocks lead is compared through them.
    leaders = edges.where("sketch is not null").select(F.col("a1").alias("doc_id"), F.col("a2").alias("_tid"), "node", "radius", "sketch")
    sizes = stored(leaders.groupBy("node").agg(F.count(F.lit(1)).alias("size")).withColumn("_times", F.col("size")))
    across = _blocks(joined(leaders, sizes, ["node"], "_times", count * TREES), "node", "size")
    across = across.repartition(parts, "node", "x", "y").sortWithinPartitions("node", "x", "y", *IDS)
    return edges.where("sketch is null").unionByName(stored(across.mapInPandas(_leaders, _EDGES)))


def candidates(reps: DataFrame) -> DataFrame:
    """a, b (structs of IDS): edges that join all sets that may be similar, with the prefixes shortened until the target recall."""
    count = reps.count()
    depth, only, found = prefix_depth(), None, None
    while True:
        edges = _candidates(reps, depth, count, only)
        found = edges if found is None else found.unionByName(edges)
        per = stored(found.where("b1 is null").select(F.col("a1").alias("doc_id"), F.col("a2").alias("_tid"), "tree").distinct().groupBy(*IDS).agg(F.count(F.lit(1)).alias("met")))
        met = [tuple(r) for r in per.groupBy("met").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most TREES rows
        seen = sum(n for _, n in met)
        if depth == 1 or seen >= RECALL * (seen + unseen(met)):
            break
        depth, only = depth - 1, reps.select(*IDS).join(per.where("met > 1"), IDS, "left_anti")
    node = lambda side: F.struct(F.col(f"{side}1").alias("doc_id"), F.col(f"{side}2").alias("_tid")).alias(side)
    return stored(found.where("b1 is not null").select(node("a"), node("b")).distinct())


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Exact similarities of all pairs of sets."""
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    both = np.zeros((len(sets), len(sets)))
    width = 4096
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [start, start + width])
        table = np.zeros((len(sets), width), np.float32)
        table[member[a:b], at[a:b] - start] = 1
        both += table @ table.T
    return both / (sizes[:, None] + sizes[None, :] - both)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for rows in _groups(batches, ["r1", "r2", "x", "y"]):
        ids, copies = rows[IDS].to_numpy(), rows["copies"].to_numpy()
        similarity = jaccard([np.frombuffer(s, np.uint64) for s in rows["set"]])
        linked = (similarity >= THRESHOLD - 1e-12) & _pairs(rows)
        counts = linked @ copies
        out += [(*ids[k].tolist(), None, None, int(counts[k])) for k in np.flatnonzero(counts)]
        out += [(*ids[a].tolist(), *ids[b].tolist(), 0) for a, b in spanning(ids, linked)]
        if len(out) > 50_000:
            yield _links(out)
            out = []
    yield _links(out)


def _links(out: list[tuple]) -> pd.DataFrame:
    names = ["a1", "a2", "b1", "b2", "links"]
    columns = list(zip(*out, strict=True)) or [[]] * len(names)
    return pd.DataFrame({n: pd.array(c, "Int64") for n, c in zip(names, columns, strict=True)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes = Codes()
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "_tid": batch["_tid"], "set": [shingles(t, codes).tobytes() for t in batch["text"]]})


def _verification(own: DataFrame, families: DataFrame) -> DataFrame:
    """a1, a2, b1, b2, links: the links of every set within its family (no b), and a spanning forest of the links."""
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spelt = stored(own.join(families.select(*IDS), IDS, "left_semi").dropDuplicates(IDS).mapInPandas(_sets, "doc_id long, _tid long, set binary"))
    sizes = stored(families.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("size")).withColumn("_times", F.col("size")))
    dealt = joined(families, sizes, ["r1", "r2"], "_times", families.count()).withColumn("root", F.struct("r1", "r2"))
    dealt = _blocks(dealt, "root", "size").join(spelt, IDS).select("r1", "r2", "x", "y", "side", *IDS, "copies", "set")
    dealt = dealt.repartition(parts, "r1", "r2", "x", "y").sortWithinPartitions("r1", "r2", "x", "y", *IDS)
    return stored(dealt.mapInPandas(_verified, "a1 long, a2 long, b1 long, b2 long, links long"))


def _classes(own: DataFrame) -> DataFrame:
    """doc_id, _tid, c1, c2 (ids of the document that stands for the class, the least), n_links; own: from R.identified."""
    signed = stored(own.mapInPandas(_signed, _SIGNED))
    worded = signed.where("n > 0")
    sets = worded.groupBy("s1", "s2").agg(F.min(F.struct(*IDS, "labels", "sketch")).alias("least"), F.count(F.lit(1)).alias("copies"))
    sets = stored(sets.select("s1", "s2", "least.*", "copies"))
    edges = candidates(sets)
    families = components(edges).select("node.*", F.col("root.doc_id").alias("r1"), F.col("root._tid").alias("r2"))
    families = stored(families.join(sets.select(*IDS, "copies"), IDS))
    links = _verification(own, families)
    counts = links.where("b1 is null").groupBy(F.col("a1").alias("doc_id"), F.col("a2").alias("_tid")).agg(F.sum("links").alias("others"))
    node = lambda side: F.struct(F.col(f"{side}1").alias("doc_id"), F.col(f"{side}2").alias("_tid")).alias(side)
    # The least document of a class is the root of its component.
    roots = components(links.where("b1 is not null").select(node("a"), node("b"))).select("node.*", F.col("root.doc_id").alias("c1"), F.col("root._tid").alias("c2"))
    made = sets.select("s1", "s2", *IDS, "copies").join(counts, IDS, "left").join(roots, IDS, "left")
    made = stored(
        made.select(
            "s1", "s2", F.coalesce("c1", "doc_id").alias("c1"), F.coalesce("c2", "_tid").alias("c2"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.col("copies").alias("_times"),
        )
    )
    found = joined(worded.select(*IDS, "s1", "s2"), made, ["s1", "s2"], "_times", signed.count()).select(*IDS, "c1", "c2", "n_links")
    alone = signed.where("n = 0").select(*IDS, F.col("doc_id").alias("c1"), F.col("_tid").alias("c2"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links for every row of docs; null ids stay null."""
    out = _classes(R.identified(docs)).withColumnRenamed("c1", "class_id")
    return out.select(R.given(docs), R.given(docs, "class_id"), "n_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each class, that of the least id; documents without words all stay."""
    own = R.identified(docs)
    # Rows that repeat an id and a text are one document: one of them stays.
    stay = stored(_classes(own).where("doc_id = c1 and _tid = c2").groupBy(*IDS).agg(F.count(F.lit(1)).alias("times")))
    row, text = "_row", F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias(row), F.coalesce(F.col("doc_id").cast("long"), F.lit(R.NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("_tid"), text.rlike("[^\\x20\\x09-\\x0D]").alias("worded"))
    kept = keyed.join(stay, IDS)
    once = kept.where("worded and times > 1").dropDuplicates(IDS)
    return kept.where("not worded or times = 1").unionByName(once).select(f"{row}.*")
