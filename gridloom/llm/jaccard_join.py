"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Every text becomes its set of hashed runs of five words (all words of a
   shorter text).  Texts with equal sets are copies: one stands for all.
2. A signature is a path of ``depth`` minima in each of ``trees`` prefix tries.
   Texts that share a prefix are below one node.  Nodes are visited from the
   full depth upwards: after each level, how often pairs of each similarity
   met tells how many there are (a pair of similarity s meets in
   trees * s**length nodes on average) and so what share of them has been
   found; prefixes are shortened by one until that share reaches the target,
   or until even pairs at the threshold alone would reach it.  One unseen pair
   at the threshold is always supposed, so small tables are searched down to
   that end.  A node with one child has no new pair and is not visited again.
   Texts that share a node share all above it, so only the nodes of the
   shortest prefix are counted for all texts; the others for those that share
   one.
3. Below a node, the smallest text that no other covers is compared with all
   others by whole signatures.  It covers what is at least COVER similar, and
   is joined to all that can link to what it covers: as Jaccard distance is a
   metric, that is no further away than the furthest covered text and the
   threshold together.  So two texts within the threshold meet in a group, and
   a node of near copies costs a pass for each cover, not all pairs.
4. The components of these joins are the groups in which all pairs are
   verified exactly, by intersection counts from matrix products over the
   common n-grams; a large group is cut into cells of bounded size (pairs of
   chunks, bounded in texts and in n-grams).  A link is counted once; what
   leaves a cell is a row for each text: how many links it has there and the
   smallest text it hangs together with, never the pairs.

Texts have numbers of their own, so rows that share an id do not mix.  Defined
cases: null and empty texts and those of white space have no n-gram, are
copies of each other and link to nothing else; rows that repeat a doc_id are
rows of their own; a class whose rows all have null ids has a null class_id;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialize, table, tidy
from .subwords import slices
from .vectorwords import mix, shingle_hashes, word_hashes

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 20, 6, 0.9999
#: Estimated similarity from which a text covers another, and the room left for errors
#: of two estimates (120 values: a standard error of 0.046 at most each).
COVER, SLACK = 0.7, 0.12
#: Texts below a node that are compared with its covers in one task, each split from there on.
NODE_CHUNK = 256
#: Texts of a group, and n-grams, that are compared with each other in one cell.
CHUNK, CHUNK_GRAMS = 1024, 4 << 20
#: Parts over which the rows of a text that comes more than once are dealt.
SALTS = 32
#: Bits of a filter for each key that it holds, and at most.
BITS_A_KEY, MOST_BITS = 16, 1 << 26
#: An n-gram in fewer texts of a cell is counted pair by pair, others by matrix products.
DENSE = 16


def chance(similarity, trees: int, length: int):
    """The chance that a pair meets in some trie below a node of this depth."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(trees: int, depth: int, threshold: float, target: float) -> int:
    """The length at which pairs at the threshold alone would reach the target: no prefix need be shorter."""
    return next((n for n in range(depth, 1, -1) if chance(threshold, trees, n) >= target), 1)


def estimated_recall(met: dict[int, np.ndarray], trees: int, length: int, threshold: float) -> float:
    """The share of pairs found with prefixes of ``length`` or more, from how often pairs of each similarity met at each length.

    ``met[n][k]``: meetings at length n of pairs whose signatures agree in k of len(met[n]) - 1 places.
    """
    pairs = np.zeros(1)
    for n, times in met.items():
        similarity = np.maximum(np.arange(len(times)) / (len(times) - 1), threshold)
        pairs = np.maximum(pairs, times / (trees * similarity**n))
    return float(((pairs * chance(similarity, trees, length)).sum() + chance(threshold, trees, length)) / (pairs.sum() + 1))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct n-grams of each text in ascending order, and where each text's begin."""
    grams, first = shingle_hashes(*word_hashes(texts), width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[keep], np.searchsorted(doc[keep], np.arange(len(first)))


def _signatures(width: int, trees: int, depth: int):
    """Rows (row, doc_id, d1, d2, n, signature): the digest of a text's n-grams, their number, and its paths in all tries."""
    rng = np.random.default_rng(7)
    masks, factors = rng.integers(0, 1 << 63, (2, trees * depth), dtype=np.uint64)
    factors |= np.uint64(1)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                grams, first = shingle_sets(part.column("text"), width)
                n = np.diff(first)
                has = np.flatnonzero(n)
                at = first[:-1][has]
                digest = np.zeros((2, len(n)), np.uint64)
                signature = np.zeros((len(has), trees * depth), ">u2")
                if len(has):
                    for k, salt in enumerate((0x51ED270B0B0B0B0B, 0x7A3D1C9E5F8B2467)):
                        digest[k, has] = np.add.reduceat(mix(grams ^ np.uint64(salt)), at)
                    for j in range(trees * depth):
                        signature[:, j] = mix(np.minimum.reduceat((grams ^ masks[j]) * factors[j], at)) & np.uint64(0xFFFF)
                bits = np.full(len(n), None, object)
                bits[has] = [s.tobytes() for s in signature]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(n), pa.array(bits, pa.binary())],
                    ["row", "doc_id", "d1", "d2", "n", "signature"],
                )

    return run


def _paths(firsts: DataFrame, trees: int, depth: int, last: int) -> DataFrame:
    """(doc, at<last>, ..., at<depth>): the nodes of a text in a trie, by depth, where its node of depth ``last`` may hold another text."""

    def node(length):
        return f"xxhash64(t, substring(signature, t * {2 * depth} + 1, {2 * length}))"

    tries = f"transform(sequence(0, {trees - 1}), t -> "
    roots = firsts.select(F.explode(F.expr(f"{tries}{node(last)})")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    roots = materialize(roots.select(F.col("at").alias(f"at{last}")), "roots")
    nodes = ", ".join(f"{node(n)} AS at{n}" for n in range(last, depth + 1))
    paths = firsts.select("doc", F.explode(F.expr(f"{tries}struct({nodes}))")).alias("path")).select("doc", "path.*")
    return materialize(may_match(paths, roots, f"at{last}"), "paths")


def _whole_groups(batches, key: list[str]):
    """Record batches of sorted rows, cut so that no group of equal keys is spread over two."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in key]
        last = np.ones(batch.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        cut = batch.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
        elif held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in key):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.array([np.frombuffer(b, dtype) for b in column.to_pylist()])


def cover_edges(group: np.ndarray, docs: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, covers, limits, met) for rows sorted by group and doc: edges from covers to texts near them, the places of the covers, how similar near is for each, and how many pairs of each similarity (places that agree) met."""
    place = np.arange(len(docs))
    is_open = np.ones(len(docs), bool)
    us, vs, covers, limits = [], [], [], []
    places = signatures.shape[1] if len(signatures) else 1
    met = np.zeros(places + 1, np.int64)
    least = (threshold - SLACK / 2) * places
    while len(place):
        change = np.r_[True, group[place][1:] != group[place][:-1]]
        starts, of = np.flatnonzero(change), np.cumsum(change) - 1
        first = np.minimum.reduceat(np.where(is_open[place], place, len(docs)), starts)
        lead = first[of]  # the first open row of each group; groups without one have left
        covers.append(first)
        same = (signatures[lead] == signatures[place]).mean(1)
        limit = np.minimum.reduceat(np.where(same >= COVER, same, 1.0), starts) - (1 - threshold) - SLACK
        limits.append(limit)
        near = (same >= limit[of]) & (docs[lead] != docs[place])
        agree = np.rint(same[docs[lead] != docs[place]] * places).astype(int)
        met += np.bincount(agree[agree >= least], minlength=places + 1)
        us.append(docs[lead[near]])
        vs.append(docs[place[near]])
        is_open[place[same >= COVER]] = False
        is_open[first] = False
        place = place[np.logical_or.reduceat(is_open[place], starts)[of]]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(us or empty), np.concatenate(vs or empty), np.concatenate(covers or empty), np.concatenate(limits or empty), met


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node): for every node but the smallest of its component, an edge to that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[label[far]], nodes[far]


def verify_cell(side: np.ndarray, sets: list[np.ndarray], threshold: float, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each text of a cell: all pairs of side 0 with each other, or (two) those between sides 0 and 1.

    ``links`` counts partners of similarity ``threshold`` or more, ``root`` is
    the place of the smallest text that it hangs together with in this cell.
    """
    n = len(side)
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(n), sizes)
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = (df >= DENSE) if n > 64 else (df >= 2)
    column = np.full(len(values), -1)
    column[dense] = np.arange(dense.sum())
    width = int(dense.sum())
    col = column[inverse]
    d_rows, d_cols = of[col >= 0], col[col >= 0]
    # Pairs that share a rarer n-gram, one entry for each.
    rare = (df >= 2) & ~dense
    pair_i = pair_j = pair_n = np.zeros(0, np.int64)
    if rare.any():
        pick = rare[inverse]
        order = np.argsort(inverse[pick], kind="stable")
        r_rows, r_key = of[pick][order], inverse[pick][order]
        code = []
        for gap in range(1, DENSE):
            same = r_key[gap:] == r_key[:-gap]
            if not same.any():
                break
            code.append(r_rows[:-gap][same] * n + r_rows[gap:][same])
        code, pair_n = np.unique(np.concatenate(code), return_counts=True)
        pair_i, pair_j = code // n, code % n
        pair_i, pair_j, pair_n = np.r_[pair_i, pair_j], np.r_[pair_j, pair_i], np.r_[pair_n, pair_n]
        order = np.argsort(pair_i, kind="stable")
        pair_i, pair_j, pair_n = pair_i[order], pair_j[order], pair_n[order]
    links, root = np.zeros(n, np.int64), np.arange(n)
    left = np.flatnonzero(side == 0)
    factor = threshold / (1 + threshold)
    steps = max(1, min(1024, (32 << 20) // max(1, n)))
    blocks = max(1, (48 << 20) // max(1, n))  # columns of a matrix product at a time
    order = np.argsort(d_cols, kind="stable")
    d_rows, d_cols = d_rows[order], d_cols[order]
    cuts = [(c, min(c + blocks, width)) for c in range(0, width, blocks)]
    parts = [(np.searchsorted(d_cols, a), np.searchsorted(d_cols, b), a, b) for a, b in cuts]
    whole = None
    for at in range(0, len(left), steps):
        rows = left[at : at + steps]
        shared = np.zeros((len(rows), n), np.float32)
        for lo, hi, a, b in parts:
            if whole is None or len(parts) > 1:
                whole = np.zeros((n, b - a), np.float32)
                whole[d_rows[lo:hi], d_cols[lo:hi] - a] = 1
            shared += whole[rows] @ whole.T
        lo, hi = np.searchsorted(pair_i, [rows[0], rows[-1] + 1])
        place = np.searchsorted(rows, pair_i[lo:hi])
        inside = rows[np.minimum(place, len(rows) - 1)] == pair_i[lo:hi]
        shared[place[inside], pair_j[lo:hi][inside]] += pair_n[lo:hi][inside]
        linked = shared + 1e-4 >= factor * (sizes[rows][:, None] + sizes[None, :])
        linked[np.arange(len(rows)), rows] = False
        if two:
            linked &= side[None, :] == 1
            links += linked.sum(0)
        links[rows] += linked.sum(1)
        for k, i in enumerate(rows):
            if links[i]:
                hang = root[linked[k]]
                if len(hang) and (hang.min() != root[i] or hang.max() != root[i]):
                    old = np.unique(np.r_[hang, root[i]])
                    root[np.isin(root, old)] = old[0]
    return links, root


EDGE, LEAD, MET = 0, 1, 2  # kinds of rows: an edge (u, v); a node's cover u with its limit; v pairs agreed in u places
_EDGES = "kind int, key long, u long, v long, near double"


def _edge_batch(kind, key, u, v, near=None) -> pa.RecordBatch:
    near = np.zeros(len(u)) if near is None else near
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind), pa.int32()), *(pa.array(c, pa.int64()) for c in (key, u, v)), pa.array(near, pa.float64())], ["kind", "key", "u", "v", "near"])


def _covers(threshold: float):
    """Edges that hang together what is near, no more than there are texts; below nodes of several chunks also the covers; how often pairs met."""

    def run(batches):
        for batch in _whole_groups(batches, ["key", "chunk"]):
            key, chunk, chunks, docs = (batch.column(c).to_numpy() for c in ("key", "chunk", "chunks", "doc"))
            u, v, covers, limits, met = cover_edges(key.view(np.uint64) + chunk.astype(np.uint64), docs, _matrix(batch.column("signature"), np.uint16), threshold)
            u, v = spanning(u, v)
            yield _edge_batch(EDGE, np.zeros(len(u)), u, v)
            many = chunks[covers] > 1
            yield _edge_batch(LEAD, key[covers[many]], docs[covers[many]], docs[covers[many]], limits[many])
            agree = np.flatnonzero(met)
            yield _edge_batch(MET, np.zeros(len(agree)), agree, met[agree])

    return run


def _across(batches):
    """Edges between the covers of a bucket (lead = 1) and the rows of one of its chunks."""
    for batch in _whole_groups(batches, ["key", "chunk"]):
        key, chunk, lead, docs, limit = (batch.column(c).to_numpy() for c in ("key", "chunk", "lead", "doc", "near"))
        signatures = _matrix(batch.column("signature"), np.uint16)
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
        for a, b in zip(new, np.r_[new[1:], len(docs)]):
            rows = np.arange(a, b)[lead[a:b] == 0]
            found = []
            for k in np.arange(a, b)[lead[a:b] == 1]:
                near = rows[((signatures[rows] == signatures[k]).mean(1) >= limit[k]) & (docs[rows] != docs[k])]
                found.append((np.full(len(near), docs[k]), docs[near]))
            if found:
                u, v = spanning(*(np.concatenate(c) for c in zip(*found)))
                yield _edge_batch(EDGE, np.zeros(len(u)), u, v)


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                grams, first = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "label", "chunks")), pa.array([grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["doc", "label", "chunks", "grams"])

    return run


def _verify(threshold: float):
    def run(batches):
        for batch in _whole_groups(batches, ["label", "c1", "c2"]):
            label, c1, c2, docs, side = (batch.column(c).to_numpy() for c in ("label", "c1", "c2", "doc", "side"))
            grams = batch.column("grams").to_pylist()
            new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
            out = [[], [], [], []]
            for a, b in zip(new, np.r_[new[1:], len(docs)]):
                own = docs[a:b]  # in ascending order
                links, root = verify_cell(side[a:b], [np.frombuffer(g, np.uint64) for g in grams[a:b]], threshold, bool(c1[a] != c2[a]))
                for c, v in zip(out, (label[a:b], own, own[root], links)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["label", "doc", "root", "links"])

    return run


def _chunked(table: DataFrame) -> DataFrame:
    """With the chunk of each row (doc, chunks)."""
    return table.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))


def flagged(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows, with whether their ``column`` may be among that of ``keys`` (may): true for every one that is there, and for few others.

    A filter over hashes of the keys, of bounded size, is broadcast, so that the exchange of the exact join that follows
    moves few rows.  The more keys there are beyond the bits, the more rows are marked, up to all.  A key has three bits of one word.
    """
    n = keys.agg(F.approx_count_distinct(column)).first()[0]
    if n > 2 * MOST_BITS:
        return rows.withColumn("may", F.lit(True))
    words = min(MOST_BITS, 1 << max(10, (BITS_A_KEY * n).bit_length())) >> 6

    def placed(table):
        table = table.withColumn("hash", F.xxhash64(column))
        mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(hash, {6 * k}) & 63 as int))" for k in range(3)))
        return table.withColumn("word", F.pmod(F.shiftright("hash", 18), F.lit(words))).withColumn("mask", mask)

    held = placed(keys.select(column)).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    marked = placed(rows).join(F.broadcast(held), "word", "left")
    return marked.select(*rows.columns, F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)).alias("may"))


def may_match(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be among that of ``keys``."""
    return flagged(rows, keys, column).where("may").drop("may")


def _near(firsts: DataFrame, paths: DataFrame, trees: int, depth: int, length: int, threshold: float) -> tuple[DataFrame, np.ndarray]:
    """Edges between texts that are near below nodes of one depth, and how many pairs of each similarity met there."""
    nodes = paths.select(F.col(f"at{length}").alias("key"), F.col(f"at{min(length + 1, depth)}").alias("child"), "doc")
    shared = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("child").alias("least"), F.max("child").alias("most")).where("size > 1")
    if length < depth:  # a node with one child has been seen below
        shared = shared.where("least <> most")
    shared = materialize(shared.select("key", F.expr(f"cast((size + {NODE_CHUNK - 1}) div {NODE_CHUNK} as int)").alias("chunks")), "shared")
    below = _chunked(may_match(nodes.select("key", "doc"), shared, "key").join(shared, "key")).select("key", "chunk", "chunks", "doc")
    below = materialize(below, "below")
    signatures = may_match(firsts.select("doc", "signature"), below, "doc")
    ordered = below.join(signatures, "doc").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "doc")
    found = materialize(ordered.mapInArrow(tidy(_covers(threshold)), _EDGES), "near")
    met = np.zeros(trees * depth + 1)
    for r in found.where(F.col("kind") == MET).groupBy("u").agg(F.sum("v").alias("v")).collect():  # a row for each number of places
        met[r.u] = r.v
    edges = found.where(F.col("kind") == EDGE).select("u", "v")
    if not shared.where("chunks > 1").isEmpty():
        large = shared.where("chunks > 1").select("key", "chunks")
        leads = found.where(F.col("kind") == LEAD).join(large, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("u").alias("doc"), F.lit(1).alias("lead"), "near")
        others = below.where("chunks > 1").select("key", "chunk", "doc", F.lit(0).alias("lead"), F.lit(0.0).alias("near"))
        signatures = may_match(firsts.select("doc", "signature"), others, "doc")
        both = leads.unionByName(others).join(signatures, "doc").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "lead", "doc")
        edges = edges.unionByName(both.mapInArrow(tidy(_across), _EDGES).select("u", "v"))
    return edges, met


def candidate_edges(firsts: DataFrame, trees: int, depth: int, threshold: float, target: float) -> tuple[DataFrame, int]:
    """Edges from the forest's nodes, and the length to which prefixes were shortened, for different texts (doc, signature)."""
    last = shortest_prefix(trees, depth, threshold, target)
    paths = _paths(firsts, trees, depth, last)
    edges, met = None, {}
    for length in range(depth, 0, -1):
        level, met[length] = _near(firsts, paths, trees, depth, length, threshold)
        edges = level if edges is None else edges.unionByName(level)
        if length <= last or estimated_recall(met, trees, length, threshold) >= target:
            return edges, length


def _classes(rows: DataFrame, threshold, width, trees, depth, target) -> DataFrame:
    """For written rows (row, doc_id, text), whose numbers are their own: row, doc_id, class (a text's number), class_id, n_links, copy_id, n_copies."""
    kinds = "row long, doc_id long, d1 long, d2 long, n long, signature binary"
    signed = materialize(rows.mapInArrow(tidy(_signatures(width, trees, depth)), kinds), "signatures")
    copies = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.min("row").alias("doc"))
    copies = materialize(copies, "copies")
    # One row for each different text; those that certainly come once stay where they are.
    marked = flagged(signed.where("n > 0").select("row", "d1", "n", "signature"), copies.where("n_copies > 1"), "d1")
    often = marked.where("may").join(copies.select(F.col("doc").alias("row")), "row", "left_semi")
    firsts = marked.where("not may").unionByName(often).select(F.col("row").alias("doc"), "n", "signature")
    firsts = materialize(firsts, "firsts")
    edges, _ = candidate_edges(firsts, trees, depth, threshold, target)
    groups = components(edges).select(F.col("node").alias("doc"), "label")
    sizes = groups.join(firsts.select("doc", "n"), "doc").groupBy("label").agg(F.expr(f"cast(greatest((count(1) + {CHUNK - 1}) div {CHUNK}, (sum(n) + {CHUNK_GRAMS - 1}) div {CHUNK_GRAMS}) as int)").alias("chunks"))
    # Always a sort-merge join: group members grow with the input, and so must not be broadcast at any size.
    members = may_match(rows.select(F.col("row").alias("doc"), "text"), groups, "doc").join(groups.join(sizes, "label").hint("merge"), "doc").select("doc", "label", "chunks", "text")
    members = members.mapInArrow(tidy(_sets(width)), "doc long, label long, chunks int, grams binary")
    cells = _chunked(members).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("label", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "doc", "grams")
    checked = cells.repartition("label", "c1", "c2").sortWithinPartitions("label", "c1", "c2", "doc").mapInArrow(tidy(_verify(threshold)), "label long, doc long, root long, links long")
    checked = materialize(checked, "checked")
    links = checked.groupBy("doc").agg(F.sum("links").alias("n_links"))
    classes = components(checked.select(F.col("root").alias("u"), F.col("doc").alias("v"))).select(F.col("node").alias("doc"), F.col("label").alias("class"))
    by_copy = copies.join(links, "doc", "left").join(classes, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    least = by_copy.groupBy("class").agg(F.min("copy_id").alias("class_id"))
    by_copy = by_copy.join(least, "class").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    # A text that comes once is needed in its row's part alone, others in all parts, over which their rows are dealt.
    parts = F.when(F.col("n_copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")))
    by_copy = by_copy.withColumn("part", F.explode(parts)).drop("doc")
    keyed = signed.select("row", "doc_id", "d1", "d2", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("part"))
    return keyed.join(by_copy, ["d1", "d2", "part"]).select("row", "doc_id", "class", "class_id", "n_links", "copy_id", "n_copies")


def jaccard_classes(docs: DataFrame, threshold=THRESHOLD, width=WIDTH, trees=TREES, depth=DEPTH, target=TARGET_RECALL, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, copy_id, n_copies.

    copy_id is the smallest doc_id with the same n-grams and n_copies how many
    rows have them; class_id is the smallest doc_id that links lead to and
    n_links the number of different texts linked.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _classes(materialize(rows, "rows"), threshold, width, trees, depth, target).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


def one_of_each_class(docs: DataFrame, threshold=THRESHOLD, width=WIDTH, trees=TREES, depth=DEPTH, target=TARGET_RECALL, id_col="doc_id", text_col="text") -> DataFrame:
    """Of each class the row with the smallest id (null ids last, then any one), with all its columns."""
    held = materialize(docs.select(F.struct("*").alias("held"), F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row")), "held")
    classes = _classes(held.select("row", "doc_id", F.col("held")[text_col].alias("text")), threshold, width, trees, depth, target)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    stays = classes.groupBy("class").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    # A sort-merge join at every size, as for the members.
    return held.join(stays.hint("merge"), "row", "left_semi").select("held.*")


def jaccard_query(spark, sf_dir) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
