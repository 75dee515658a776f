"""Near-duplicate groups of five-word shingles, from SimHash nodes and exact checks.

SimHash finds fingerprints a few bits apart. At a shingle similarity (Jaccard) of
0.8, 64-bit fingerprints of five-word shingles differ by 5 to 17 bits, and no cut
into segments that differ by at most one bit is both short enough to be found and
long enough to be selective (README has figures). So this mode of the operator

1. takes texts with equal shingle sets as one node;
2. links nodes by SimHash within ``MAX_BITS`` bits (deletion variants, ``simhash``),
   and as candidates also nodes that share one of ``BANDS`` bands of ``BAND`` minima
   of shingle hashes; at a similarity of 0.8, all but 1 in 38,000 pairs share one;
3. keeps the candidates whose exact similarity reaches the threshold.

Hot bands: a band value with many nodes is dealt into blocks. First each block is
looked at by itself, in ``ROUNDS`` ways to deal them: similarities are estimated from
the minima, and the edges of a spanning forest, most similar first, are checked
exactly, which takes work in proportion to the nodes and joins nearly all of a family
of copies. What then still has different groups in one band value, whatever the
estimate, is gathered into clusters, whose nodes are compared exactly, all of
different groups and fitting sizes, in pairs of blocks: so no link is lost to the
forest or to an estimate, no group's pairs are ever listed, and nodes of one group
are not compared with each other.

Defined results: null and empty texts are one group; a text shorter than a
shingle is one shingle; null keys are grouped by their text and name no group
while another key does; near_duplicates keeps repeated rows, keep_one one of
them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, simhash
from .components import components

WORDS, SIMILARITY, MAX_BITS = 5, 0.8, 3
BANDS, BAND, MINIMA = 20, 4, 80
#: Estimates from the minima are within this of the truth but for 1 in 1,000 pairs at the threshold; clusters hold those too.
SLACK = 0.15
BLOCK, ROUNDS = 400, 3
#: Shingles of one unit of weight of a block.
UNIT = 512
_RNG = np.random.default_rng(20240229)
FACTORS = (_RNG.integers(1, 1 << 62, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of MINIMA hashes (of the shingle hashes), 32 bits."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        out = np.minimum(out, (hashes[None, at : at + 2048] * FACTORS[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(m: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(m[i * BAND : (i + 1) * BAND].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, words))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("t"))


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """doc_id, th (a hash of the text), node (a digest of the shingle set), size (of that), fp, sig (a byte of each minimum), bands."""

    def run(batches):
        for b in batches:
            rows = shared.rows_buffer(["doc_id", "th", "node", "size", "fp", "sig", "bands"])
            for k, th, t in zip(b["k"], b["th"], b["t"]):
                h = simhash.shingle_hashes(t, words)
                own = np.unique(h)
                m = minima(own)
                node = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                rows.add(k, th, node, len(own), simhash.fingerprint(h), m.astype(np.uint8).tobytes(), bands(m) if len(own) else [])
            yield rows.take()

    return shared.map_columns(_keyed(docs, key, text), run, "doc_id long, th long, node long, size int, fp long, sig binary, bands array<long>")


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of the edges (a, b), most valued first, those that join two labels."""
    label, kept, most = label.copy(), [], len(np.unique(label)) - 1
    for e in np.argsort(-value, kind="stable").tolist():
        x, y = label[a[e]], label[b[e]]
        if x != y:
            label[label == max(x, y)] = min(x, y)
            kept.append(e)
            if len(kept) == most:
                break
    return np.array(kept, np.int64)


def _block_pairs(members: DataFrame, by: str, limit: int, columns: list[str], salts: int = 0) -> DataFrame:
    """x, y: arrays of structs of ``columns``, for every block of about ``limit`` units of ``weight`` of the members
    of a group with more than one label (y is NULL), and for every two blocks of a group that can hold members of different
    labels and of sizes within a quarter. With ``salts``, blocks come by themselves only, larger groups dealt in so many ways."""
    own = shared.staged(members.groupBy(by, "label").agg(F.sum("weight").alias("own")), "shingle-labels")
    big = F.col("own") > limit
    rest = F.sum(F.when(big, 0).otherwise(F.col("own")))
    group = own.groupBy(by).agg(F.sum("own").alias("all"), rest.alias("rest"), F.count("*").alias("labels")).filter("labels > 1")
    group = shared.staged(group.select(by, "all", "rest", F.col("all").alias("n")), "shingle-sizes")
    placed = shared.looked_up(members, group, by, "n").filter(F.col("all").isNotNull())
    few, many = placed.filter(F.col("all") <= limit), placed.filter(F.col("all") > limit)
    few = few.select(by, F.lit(None).cast("long").alias("tag"), F.lit(0).alias("kind"), F.lit(0).alias("block"), *columns)
    if salts:
        deal = F.pmod(F.xxhash64("node", "kind"), F.ceil(F.col("all") / limit)).cast("int")
        many = many.withColumn("kind", F.explode(F.sequence(F.lit(1), F.lit(salts)))).select(by, F.lit(None).cast("long").alias("tag"), "kind", deal.alias("block"), *columns)
    else:
        many = many.join(own.filter(big), [by, "label"], "left")
        kind = F.floor(F.log(F.col("size") + 1) / F.log(F.lit(1.25))).cast("int")
        deal = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("own", "rest") / limit)).cast("int")
        many = many.select(by, F.when(F.col("own").isNotNull(), F.col("label")).alias("tag"), kind.alias("kind"), deal.alias("block"), *columns)
    m = F.collect_list(F.struct(*columns)).alias("m")
    blocks = few.withColumn("many", F.lit(False)).unionByName(many.withColumn("many", F.lit(True))).groupBy(by, "tag", "kind", "block", "many").agg(m)
    blocks = shared.staged(blocks.withColumn("id", F.monotonically_increasing_id()), "shingle-blocks")
    alone = blocks.filter("tag IS NULL").select(F.col("m").alias("x"), F.lit(None).cast(blocks.schema["m"].dataType).alias("y"))
    if salts:
        return alone
    ids = blocks.filter("many").select(by, "tag", "kind", "id")
    pairs = ids.join(ids.select(by, F.col("tag").alias("tag2"), F.col("kind").alias("kind2"), F.col("id").alias("id2")), by)
    pairs = pairs.filter("id < id2 AND abs(kind - kind2) <= 1 AND (tag IS NULL OR tag2 IS NULL OR tag <> tag2)").select("id", "id2")
    return alone.unionByName(pairs.join(blocks.select("id", F.col("m").alias("x")), "id").join(blocks.select(F.col("id").alias("id2"), F.col("m").alias("y")), "id2").select("x", "y"))


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of the bands that several nodes have."""
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    several = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    found = shared.looked_up(entries, shared.staged(several.withColumn("several", F.lit(True)), "shingle-buckets"), "bucket", "n")
    return shared.staged(found.filter("several").select("bucket", "node"), "shingle-bands")


def candidates(entries: DataFrame, nodes: DataFrame, least: int, salts: int = 0) -> DataFrame:
    """Pairs (a, b) of nodes with different ``label`` that share a band and at least ``least`` minima: of each block or pair of blocks the most similar ones that join its labels (a spanning forest)."""
    placed = entries.join(nodes.select("node", "label", "size", "sig"), "node").withColumn("weight", F.lit(1))
    differ = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    placed = placed if salts else placed.join(differ, "bucket", "left_semi")
    placed = shared.staged(placed, "shingle-placed")

    def run(batches):
        for b in batches:
            ea, eb = [], []
            for x, y in zip(b["x"], b["y"]):
                m = x + (y or [])
                node = np.array([v["node"] for v in m], np.int64)
                label = np.array([v["label"] for v in m], np.int64)
                sig = np.frombuffer(b"".join([v["sig"] for v in m]), np.uint8).reshape(-1, MINIMA)
                aa, bb, vv = [], [], []
                for i in range(len(m) - 1 if y is None else len(x)):
                    first = i + 1 if y is None else len(x)
                    value = (sig[first:] == sig[i]).sum(axis=1)
                    j = np.flatnonzero((value >= least) & (label[first:] != label[i]))
                    aa.append(np.full(len(j), i))
                    bb.append(j + first)
                    vv.append(value[j])
                if aa:
                    aa, bb = np.concatenate(aa), np.concatenate(bb)
                    keep = _forest(label, aa, bb, np.concatenate(vv))
                    ea += node[aa[keep]].tolist()
                    eb += node[bb[keep]].tolist()
            yield {"a": ea, "b": eb}

    found = shared.map_columns(_block_pairs(placed, "bucket", BLOCK, ["node", "label", "sig"], salts), run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def exact_links(x: list[dict], y: list[dict] | None, similarity: float) -> list[tuple[int, int]]:
    """Links (node, node) between x and y, or within x, that join labels: a spanning forest of those
    whose sets have the similarity."""
    m = x + (y or [])
    label = np.unique([v["label"] for v in m], return_inverse=True)[1]
    sets = [np.frombuffer(v["s"], np.uint64) for v in m]
    size = np.array([len(v) for v in sets])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)])
    mark, out = np.zeros(int(at.max(initial=0)) + 1, np.int32), []
    for i in range(len(m) - 1 if y is None else len(x)):
        first = i + 1 if y is None else len(x)
        if (label[first:] == label[i]).all():
            continue
        own = at[starts[i] : starts[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[at[starts[first] :]], starts[first:-1] - starts[first])
        mark[own] = 0
        alike = np.flatnonzero((common >= similarity * (size[i] + size[first:] - common)) & (label[first:] != label[i])) + first
        for other in np.unique(label[alike]).tolist():
            out.append((m[i]["node"], m[int(alike[label[alike] == other][0])]["node"]))
            label[label == other] = label[i]
    return out


def cluster_links(labelled: DataFrame, edges: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Links between the labels that ``edges`` join, directly or through others."""
    of = labelled.select("node", "label", "size")
    joined = edges.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    clusters = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")), "shingle-clusters")
    members = shared.staged(of.join(clusters.select(F.col("node").alias("label"), F.col("root").alias("cluster")), "label"), "shingle-members")
    placed = members.withColumn("weight", F.greatest(F.lit(1), (F.col("size") / UNIT).cast("int"))).join(sets_of(members.select("node")), "node")
    placed = shared.staged(placed, "shingle-placed")

    def run(batches):
        for b in batches:
            found = [e for x, y in zip(b["x"], b["y"]) for e in exact_links(x, y, similarity)]
            yield {"a": [e[0] for e in found], "b": [e[1] for e in found]}

    return shared.map_columns(_block_pairs(placed, "cluster", BLOCK, ["node", "label", "s"]), run, "a long, b long")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, s): the sorted shingle hashes of each text."""

    def run(batches):
        for b in batches:
            yield {"node": b["node"], "s": [shingle_set(t, words).tobytes() for t in b["text"]]}

    return shared.staged(shared.map_columns(texts, run, "node long, s binary"), "shingle-sets")


def verified(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets (node, s) have at least the similarity."""
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared_ = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(shared_ >= similarity * (len(x) + len(y) - shared_))
            yield {"a": [a for a, k in zip(b["a"], ok) if k], "b": [p for p, k in zip(b["b"], ok) if k]}

    return shared.map_columns(both.select("a", "b", "x", "y"), run, "a long, b long")


def grouped(docs: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """A row a document: doc_id, th, root (its group)."""
    rows = shared.staged(signatures(docs, key, text, words), "shingle-signatures")
    # one text stands for a node: that of the least key (null last), known by key and hash
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th"))
    first = [F.first(c).alias(c) for c in ("size", "sig", "bands")]
    nodes = rows.groupBy("node").agg(least.alias("least"), F.count("*").alias("n"), F.min("fp").alias("fp"), *first)
    nodes = shared.staged(nodes.withColumn("label", F.col("node")), "shingle-nodes")
    texts = _keyed(docs, key, text)

    def sets_of(needed: DataFrame) -> DataFrame:
        chosen = nodes.join(needed.distinct(), "node", "left_semi").select("node", "least.doc_id", F.col("least.th").alias("of"))
        found = texts.join(chosen, texts.k.eqNullSafe(chosen.doc_id) & (texts.th == chosen.of)).select("node", F.col("t").alias("text"))
        return shingle_sets(found.dropDuplicates(["node"]), words)

    near = simhash.links(nodes.select("fp").distinct(), MAX_BITS)
    same = nodes.groupBy("fp").agg(F.min("node").alias("other"))
    by_bits = near.join(same.select(F.col("fp").alias("a"), F.col("other").alias("na")), "a").join(same.select(F.col("fp").alias("b"), F.col("other").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    by_bits = by_bits.unionByName(nodes.join(same, "fp").select(F.col("node").alias("a"), F.col("other").alias("b")).filter("a <> b"))
    by_bits = by_bits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    entries = shared_bands(nodes)
    pairs = by_bits.unionByName(candidates(entries, nodes, int(np.ceil((similarity - SLACK) * MINIMA)), ROUNDS))
    pairs = shared.staged(pairs.distinct(), "shingle-pairs")
    links = shared.staged(verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), similarity), "shingle-links")
    found = components(links, "shingle-components")
    labelled = nodes.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    labelled = shared.staged(labelled, "shingle-labelled")
    # a refuted pair needs no second look if it is a whole cluster: both in no group and with no other candidate;
    # any other stands for pairs that the forest left out
    rest = shared.staged(candidates(entries, labelled, 0), "shingle-rest")
    more = rest.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    joined = shared.staged(found.select("node").unionByName(more).distinct(), "shingle-joined")
    alone = pairs.join(joined.withColumnRenamed("node", "a"), "a", "left_anti").join(joined.withColumnRenamed("node", "b"), "b", "left_anti")
    rest = rest.join(alone, ["a", "b"], "left_anti")
    links = links.unionByName(shared.staged(cluster_links(labelled, rest, sets_of, similarity), "shingle-more"))
    found = components(links, "shingle-components")
    roots = shared.staged(nodes.select("node", "n").join(found, "node", "left"), "shingle-roots")
    return shared.looked_up(rows.select("doc_id", "th", "node"), roots, "node", "n").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """A row a document: doc_id, component_id, the least doc_id of its group."""
    rows = shared.staged(grouped(docs, key, text, words, similarity), "shingle-groups")
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group: that with its least key (null last); of rows that repeat key and text, one."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th"))
    kept = grouped(docs, key, text, words, similarity).groupBy("root").agg(least.alias("l"))
    mine, hash_ = (shared.free_name(docs.columns, n) for n in ("_key", "_hash"))
    kept = shared.staged(kept.select(F.col("l.doc_id").alias("doc_id"), F.col("l.th").alias("th")), "shingle-kept")
    own = docs.withColumn(mine, F.col(key).cast("long")).withColumn(hash_, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    own = own.join(kept, F.col(mine).eqNullSafe(kept.doc_id) & (F.col(hash_) == kept.th), "left_semi")
    return own.dropDuplicates([mine, hash_]).select(*[F.col(f"`{c}`") for c in docs.columns])
