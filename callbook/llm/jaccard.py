"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Each text becomes its set of 5-word shingles (a shorter text: one shingle of all its
   words). Texts with equal sets are one class, counted before anything is compared.
2. A signature per class is cut into bands; numbers of bands and rows are chosen for the
   target recall at the threshold. Classes are shuffled on band hashes; the members of a
   bucket are tied to its smallest, which gives candidate groups (connected components).
3. Inside a candidate group all classes are compared on their full sets, in blocks: a
   task gets two blocks of bounded size, works the pairs out as a matrix product, and
   returns the number of links of each class and the edges of a spanning forest, so that
   neither a group nor its pairs are ever held or written as a whole.
4. Groups of several blocks are joined by components of the verified edges.

Words are runs of other than ASCII white space, taken as they are. Texts without words
link with nothing; short ones with equal words link. A row that repeats, id and all, counts as one
more copy. A class is known by its set; the text that stands for it is fetched by id and text
hash together, so null ids are rows like others and an id may stand for many texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_batches, settle, spare_name, texts
from callbook.llm.graph import components

SHINGLE, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.998, 288
#: Classes and characters of a block; columns of a matrix product at a time.
BLOCK_ROWS, BLOCK_CHARS, COLUMNS = 1024, 16 << 20, 4096
#: Up to this many rows (ids and 16-byte keys) the candidates' keys are broadcast; beyond, joined by shuffle.
BROADCAST_ROWS = 500_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: as many rows a band as reach the recall at the threshold within the hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(width, n)
    mix = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        mix = (mix ^ h[i:n - k + 1 + i]) * _MIX
        mix ^= mix >> np.uint64(32)
    return np.unique(mix)


def digest(found: np.ndarray) -> bytes | None:
    """Stands for the set: equal for equal sets."""
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


class Signer:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def __call__(self, sets: list[np.ndarray]) -> list[list[int]]:
        """Band hashes of each non-empty set."""
        out, lo = [], 0
        while lo < len(sets):
            hi, held = lo, 0
            while hi < len(sets) and (hi == lo or held + len(sets[hi]) <= 32768):
                held += len(sets[hi])
                hi += 1
            some = sets[lo:hi]
            every = np.concatenate(some)
            starts = np.cumsum([0, *(len(s) for s in some[:-1])])
            least = np.empty((len(self.factors), len(some)), np.uint64)
            for i, f in enumerate(self.factors):
                least[i] = np.minimum.reduceat(every * f, starts)
            mix = np.zeros((self.bands, len(some)), np.uint64)
            mix += np.arange(1, self.bands + 1, dtype=np.uint64)[:, None]
            for r in range(self.rows):
                mix = (mix ^ least[r::self.rows]) * _MIX
                mix ^= mix >> np.uint64(29)
            out += mix.view(np.int64).T.tolist()
            lo = hi
        return out


def signed(docs: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """id, mark (hash of the text), node (stands for the set; null without words), bands, chars."""
    def make():
        sign = Signer(bands, rows)

        def step(batch: pa.RecordBatch):
            given = texts(batch)
            sets = [shingles(t) for t in given]
            marks = iter(sign([s for s in sets if len(s)]))
            return {"id": batch.column("id"), "mark": batch.column("mark"), "node": [digest(s) for s in sets],
                    "bands": [next(marks) if len(s) else None for s in sets], "chars": [len(t) for t in given]}
        return step

    narrow = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return map_batches(narrow, f"id {kind}, mark long, node binary, bands array<bigint>, chars long", "text", make)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """node, component of the classes that share a bucket with another. classes: node, bands."""
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = rows.join(buckets, "bucket").where(F.col("node") != F.col("low")) \
        .select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    return components(edges)


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the left sets and the right sets reach the threshold, as a boolean matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(every)) > 1      # sets are distinct inside, so: in two sets
    place = np.cumsum(shared) - 1
    fit = shared[column]
    owner, column = owner[fit], place[column[fit]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float64)
    in_left, in_right = np.full(len(sets), -1), np.full(len(sets), -1)
    in_left[left], in_right[right] = np.arange(len(left)), np.arange(len(right))
    width = int(shared.sum())
    for lo in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        o, c = owner[a:b], column[a:b] - lo
        n = min(COLUMNS, width - lo)
        x, y = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        ok = in_left[o] >= 0
        x[in_left[o[ok]], c[ok]] = 1
        ok = in_right[o] >= 0
        y[in_right[o[ok]], c[ok]] = 1
        common += x @ y.T
    sizes = np.array([len(s) for s in sets], float)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common / union >= threshold


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the bipartite (or, for left = right, plain) adjacency."""
    whole = np.zeros((n, n), bool)
    whole[np.ix_(left, right)] = near
    whole |= whole.T
    free, edges = np.ones(n, bool), []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        work = [start]
        while work:
            u = work.pop()
            new = np.flatnonzero(whole[u] & free)
            free[new] = False
            edges += [(u, int(v)) for v in new]
            work += new.tolist()
    return edges


#: kind 0: a has n links; kind 1: a and b are linked; kind 2: a belongs to b for good.
FOUND = "kind int, a binary, b binary, n long"


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """Links inside candidate groups. members: component, node, copies, text, blocks, block, other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(FOUND))

    def pairs(rows: dict[bytes, tuple]) -> Iterator[tuple]:
        """rows: node -> (block, copies, set, blocks, lower block, upper block)."""
        nodes = list(rows)
        if len(nodes) < 2:
            return
        first = rows[nodes[0]]
        blocks, lower, upper = first[3], first[4], first[5]
        of = np.array([rows[x][0] for x in nodes])
        copies = np.array([rows[x][1] for x in nodes], np.int64)
        left, right = np.flatnonzero(of == lower), np.flatnonzero(of == upper)
        if not len(left) or not len(right):
            return
        near = links([rows[x][2] for x in nodes], left, right, threshold)
        if lower == upper:
            np.fill_diagonal(near, False)
        counts = np.zeros(len(nodes), np.int64)
        counts[left] += near @ copies[right]
        if lower != upper:
            counts[right] += near.T @ copies[left]
        for i in np.flatnonzero(counts):
            yield 0, nodes[i], None, int(counts[i])
        edges = forest(near, left, right, len(nodes))
        if blocks > 1:
            for u, v in edges:
                yield 1, nodes[u], nodes[v], None
            return
        root = list(range(len(nodes)))
        for u, v in edges:      # parents come before their children
            root[v] = root[u]
        for v, r in enumerate(root):
            if counts[v]:
                yield 2, nodes[v], nodes[r], None

    def run(batches: Iterator[pa.RecordBatch]):
        now, held, out = None, {}, []

        def flush():
            rows = out[:]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)],
                                              schema=arrow)
        for batch in batches:
            for comp, lower, upper, node, copies, blocks, block, text in zip(*(
                    batch.column(c).to_pylist() for c in
                    ("component", "lower", "upper", "node", "copies", "blocks", "block", "text")), strict=True):
                if (comp, lower, upper) != now:
                    out.extend(pairs(held))
                    now, held = (comp, lower, upper), {}
                    if len(out) > 10_000:
                        yield flush()
                if node not in held:
                    found = shingles(text)
                    if digest(found) == node:       # else another text under the same id
                        held[node] = block, copies, found, blocks, lower, upper
        out.extend(pairs(held))
        if out:
            yield flush()

    keyed = members.select("component", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"),
                           "node", "copies", "blocks", "block", "text")
    return keyed.repartition("component", "lower", "upper").sortWithinPartitions("component", "lower", "upper") \
        .mapInArrow(run, FOUND)


def once(named: DataFrame) -> DataFrame:
    """named with a text of a node once a task, so that rows that repeat, id and all, are not all sent on."""
    def run(batches: Iterator[pa.RecordBatch]):
        seen = set()
        for batch in batches:
            marks = [(node, hash(text)) for node, text in zip(*(batch.column(c).to_pylist() for c in ("node", "text")), strict=True)]
            fresh = [m not in seen and not seen.add(m) for m in marks]
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return named.mapInArrow(run, named.schema)


def linked_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                   recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows, classes). rows: id and node of every row. classes, of those with copies or links: node, group,
    class_id (smallest id of the group), copy_id (smallest id of the class), n_links (of each of its rows)."""
    bands, per_band = bands_for(threshold, recall)
    rows = settle(signed(docs, key, text, bands, per_band))
    classes = settle(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"),
        F.max("chars").alias("chars"), F.any_value("id").alias("from_id"), F.any_value("mark").alias("mark")))
    groups = settle(candidate_groups(classes.select("node", "bands")).join(classes.drop("bands"), "node"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("chars") / BLOCK_CHARS), F.lit(1)).cast("int")
    groups = groups.drop("chars").join(sizes.select("component", blocks.alias("blocks")), "component") \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    small = groups.count() <= BROADCAST_ROWS
    # from_id and mark come from one row of the class.
    given = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_mark"), F.col(text).alias("text"))
    named = once(given.join(F.broadcast(groups) if small else groups, F.col("_id").eqNullSafe(F.col("from_id"))
                            & (F.col("_mark") == F.col("mark"))).select(
        "component", "node", "copies", "blocks", "block", "text"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    found = settle(verify(named.withColumn("other", other), threshold))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = found.where("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("group")) \
        .union(components(found.where("kind = 1").select("a", "b")))
    every = classes.select("node", "copy_id", "copies").join(counts, "node", "left").join(roots, "node", "left") \
        .where("copies > 1 OR others > 0").withColumn("group", F.coalesce("group", "node"))
    every = settle(every)
    lowest = every.groupBy("group").agg(F.min("copy_id").alias("class_id"))
    return rows.select("id", "node"), settle(every.join(lowest, "group").select(
        "node", "group", "class_id", "copy_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
         recall: float = RECALL) -> DataFrame:
    """One row per row of docs: key, class_id (smallest id of its linked group), copy_id (smallest id with the
    same set), n_links (other rows linked directly)."""
    rows, classes = linked_classes(docs, key, text, threshold, recall)
    return rows.join(classes.drop("group"), "node", "left").select(
        F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without links, and one row of each linked group (smallest id), with the same columns."""
    rows, classes = linked_classes(docs, key, text)
    node, named = spare_name(docs, "_node"), spare_name(docs, "_linked")

    @F.pandas_udf("binary")
    def node_of(text: pd.Series) -> pd.Series:
        return pd.Series([digest(shingles(t or "")) for t in text], dtype=object)

    # Groups whose smallest id stands in several rows; these are rare, and one row is kept of them.
    again = settle(rows.join(classes, "node").where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("group").agg(
        F.count("*").alias("n")).where("n > 1").select("group", F.lit(True).alias("again")))
    marks = classes.join(again, "group", "left").select(
        F.col("node").alias(node), F.struct("group", "class_id", "again").alias(named))
    marked = docs.withColumn(node, node_of.asNondeterministic()(F.col(text))).join(marks, node, "left")
    chosen = marked.where(F.col(named).isNull() | F.col(key).eqNullSafe(F.col(f"{named}.class_id")))
    if not again.limit(1).count():
        return chosen.select(*docs.columns)
    repeated = F.col(named).isNotNull() & F.col(f"{named}.again").isNotNull()
    group = spare_name(docs, "_group")
    one = chosen.where(repeated).withColumn(group, F.col(f"{named}.group")).dropDuplicates([group])
    return chosen.where(~repeated).select(*docs.columns).union(one.select(*docs.columns))
