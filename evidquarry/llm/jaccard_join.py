"""Self-join on n-gram Jaccard similarity through a token-group matrix.

Method
------
1. Every text becomes its set of distinct four-word shingles (tokens, as 64-bit hashes); texts
   with equal sets (128-bit fingerprint) are one node.
2. Tokens get one order for all sets: by how far their counter, in a table of ``SLOTS`` document
   counts summed over the whole corpus, stands out from chance (in powers of two of ``CHANCE``
   standard deviations), then by hash. So tokens of widely shared passages come last; what
   goes unnoticed grows only with the root of the corpus. Two sets
   with the asked similarity overlap in at least ``need`` tokens of either, so the first
   n - need + LEAST tokens of both share at least ``LEAST``. Nodes that share so many of these
   with no other node are linked to nothing and go no further.
3. Partition: the other nodes are put into groups of similar ones by the leading token they share
   with most others, which the copies of one text have in common whatever else was changed;
   a crowded group is cut into parts of at most ``PART`` nodes. A part is
   joined exactly in one task, together with ``PIVOTS`` nodes of the whole group that tie its
   parts together.
4. Matrix: for every part the union of its nodes' leading tokens is stored, as rows (token,
   part, smallest and largest set). Tokens all of whose nodes hang together already are left
   out. A node's leading tokens meet these rows; parts that share fewer than ``LEAST`` with it,
   or that cannot match in size, are never opened for it.
5. An opened part's full token union bounds the overlap with the query set once more; queries
   that reach ``need`` are compared exactly with the part's nodes (overlaps from the inverted lists
   of the union), on full sets.
6. Links come as pairs of what hangs together so far, so no node collects the links of a large
   group; components over these give every document the smallest id it reaches.

A row is known by its number in the scan. Texts are fetched a second time for steps 3 and 5 and
must give the fingerprints of the first scan, or the job fails.

Defined results: null or word-free texts have an empty set and are linked with nothing; a text
of fewer words than the width has one token; rows that repeat an id are documents of their own;
a row without an id links others and has the smallest id reachable, or none; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidquarry.llm.base import components, groups_of, joined_labels, stored, table, text_portions
from evidquarry.llm.shingles import mixed, shingle_set

WIDTH = 4
SLOTS, CHANCE = 1 << 19, 4.0
LEAST = 4
GROUP, PART, PART_TOKENS, PIVOTS = 64, 256, 400_000, 16
QUERIES_A_TASK = 512
TEXT = 4 << 20
_PRINT = np.uint64(0x5851F42D4C957F2D)


def fewest(per_cent: int) -> int:
    """The smallest set that can reach the similarity with a different one."""
    return -(-per_cent // (100 - per_cent)) if per_cent < 100 else 1 << 62


def least_shared(per_cent: int) -> int:
    return max(1, min(LEAST, -(-per_cent * fewest(per_cent) // 100)))


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    if not len(own):
        return 0, 0
    with np.errstate(over="ignore"):
        one = mixed(own).sum(dtype=np.uint64)
    two = np.bitwise_xor.reduce(mixed(own ^ _PRINT))
    return int(one.view(np.int64)), int(two.view(np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, texts in text_portions(batch.column(0), TEXT):
            for text in texts:
                np.add.at(sums, _slots(shingle_set(text, WIDTH)), 1)
    slot = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sums[slot])], names=["slot", "n"])


def _slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - int(math.log2(SLOTS)))).astype(np.int64)


def crowded(sums: np.ndarray) -> np.ndarray:
    """0 for counters within chance of the mean, then one more for each doubling of the excess."""
    mean = max(1.0, sums.mean())
    excess = (sums - mean) / (CHANCE * math.sqrt(mean))
    return np.where(excess >= 1, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


def leading(own: np.ndarray, crowding: np.ndarray, per_cent: int) -> np.ndarray:
    """The first n - need + LEAST tokens of a sorted set in the order of all sets."""
    count = len(own) - -(-per_cent * len(own) // 100) + least_shared(per_cent)
    return own[np.argsort(crowding[_slots(own)], kind="stable")[:count]]


def _sketched(sent, per_cent: int):
    few = fewest(per_cent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowding = sent.value
        for batch in batches:
            for start, texts in text_portions(batch.column(2), TEXT):
                sets = [shingle_set(t, WIDTH) for t in texts]
                prints = [fingerprint(s) for s in sets]
                lead = [leading(s, crowding, per_cent).view(np.int64) if len(s) >= few else np.empty(0, np.int64) for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lead]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lead) if lead else np.empty(0, np.int64))),
                ], names=["id", "node", "n", "fp_a", "fp_b", "lead"])

    return run


class TokenUnion:
    """The token union of some sets, each token with the list of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets)
        order = np.argsort(token, kind="stable")
        self.holder = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, self.start = np.unique(token[order], return_index=True)
        self.stop = np.append(self.start[1:], len(token))

    def bounded(self, own: np.ndarray) -> np.ndarray:
        """Places of the tokens of *own* that are in the union; their number bounds every overlap."""
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        return at[self.tokens[at] == own]

    def overlaps(self, at: np.ndarray) -> np.ndarray:
        """Tokens at these places held by each set."""
        size = self.stop[at] - self.start[at]
        ahead = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(self.start[at] - ahead, size)
        return np.bincount(self.holder[place], minlength=len(self.sizes))

    def linked(self, own: np.ndarray, per_cent: int) -> np.ndarray:
        """Places of the sets that reach the similarity with *own*."""
        at = self.bounded(own)
        if 100 * len(at) < per_cent * len(own) or not len(own):
            return at[:0]
        both = self.overlaps(at)
        return np.flatnonzero((both > 0) & (100 * both >= per_cent * (len(own) + self.sizes - both)))


def _sets(rows: pa.Table) -> list[np.ndarray]:
    sets = []
    for text, one, two in zip(rows.column("text"), rows.column("fp_a"), rows.column("fp_b"), strict=True):
        sets.append(shingle_set(text.as_py(), WIDTH))
        if fingerprint(sets[-1]) != (one.as_py(), two.as_py()):
            raise ValueError("a text read again is not that of the first scan")
    return sets


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for every key group."""
    for rows in groups_of(batches, keys):
        own = np.stack([rows.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1
        for start, end in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
            yield rows.slice(start, end - start)


def _joined_parts(per_cent: int):
    """Links inside a part: node to leader, and (pivot true) pivot to leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["part", "chunk"]):
            node, role = rows.column("node").to_numpy(), rows.column("role").to_numpy()
            sets = _sets(rows)
            union = TokenUnion(sets)
            found = [union.linked(own, per_cent) for own in sets]
            left = np.repeat(np.arange(len(node)), [len(f) for f in found])
            label = joined_labels(len(node), left, np.concatenate(found))  # nodes of the part come before pivots
            other = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[other]), pa.array(node[label[other]]), pa.array(role[other] == 1)], names=["node", "leader", "pivot"])

    return run


def _opened_parts(per_cent: int):
    """Pairs (a, b) of what hangs together, one for each exact link that is news."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["part", "chunk"]):
            tie, role = rows.column("tie").to_numpy(), rows.column("role").to_numpy()
            sets = _sets(rows)
            inside = np.flatnonzero(role == 0)
            if len(inside) == len(sets):
                continue
            union = TokenUnion([sets[i] for i in inside])
            pairs = set()
            for i in np.flatnonzero(role == 1):
                own = int(tie[i])
                pairs |= {(min(own, other), max(own, other)) for other in tie[inside[union.linked(sets[i], per_cent)]].tolist() if other != own}
            a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _gathered(texts: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """The texts of the wanted rows (node, fp_a, fp_b, part, role, ...), a part's together.

    Rows of role 1 are spread over chunks of about *most*, rows of role 0 go to each chunk.
    """
    guests = wanted.where("role = 1").groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    spread = wanted.join(guests, "part", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = spread.withColumn("chunk", F.explode(F.when(F.col("role") == 1, own).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))).drop("chunks")
    return texts.join(dealt, "node").repartition("part", "chunk").sortWithinPartitions("part", "chunk", "role", "node")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 85) -> DataFrame:
    """One row (id, n_shingles, component_id) per input row; linked rows share a component."""
    spark = docs.sparkSession
    numbered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("node", F.monotonically_increasing_id())
    texts = numbered.select("node", "text")
    least = least_shared(per_cent)

    sums = np.zeros(SLOTS, np.int64)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sums[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()  # SLOTS rows at most, whatever the corpus
    sent = spark.sparkContext.broadcast(crowded(sums))
    sketches = stored(
        numbered.select("id", "node", "text").mapInArrow(_sketched(sent, per_cent), "id long, node long, n long, fp_a long, fp_b long, lead array<long>"), "sketches")
    rep = F.min(F.struct("node", "lead")).alias("rep")
    classes = stored(
        sketches.where("n > 0").groupBy("n", "fp_a", "fp_b").agg(rep, F.min("id").alias("least"), F.count("*").alias("copies"))
        .select("n", "fp_a", "fp_b", "least", "copies", "rep.node", "rep.lead"), "classes")

    tokens = classes.select("node", F.explode("lead").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("holders")).where("lo < hi").select("token", "holders")
    near = stored(tokens.join(shared, "token"), "tokens")
    widest = F.max(F.struct("holders", "token"))["token"].alias("widest")
    live = near.groupBy("node").agg(F.count("*").alias("hits"), widest).where(F.col("hits") >= least).select("node", "widest")

    known = stored(classes.drop("lead", "least", "copies").join(live, "node"), "live")
    groups = max(1, -(-known.count() // GROUP))
    grouped = known.withColumn("grp", F.pmod(F.xxhash64("widest"), F.lit(groups)))
    sizes = grouped.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / PART_TOKENS)).alias("parts"))
    most = sizes.agg(F.max("parts")).first()[0] or 1
    nodes = stored(
        grouped.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
        .withColumn("part", F.col("grp") * most + F.col("own")).drop("widest"), "parts")

    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    pivots = nodes.where("parts > 1").withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
    visits = (
        pivots.withColumn("to", F.explode(F.expr("sequence(0L, parts - 1)"))).where("to <> own")
        .select("node", "fp_a", "fp_b", (F.col("grp") * most + F.col("to")).alias("part"), F.lit(1).alias("role")))
    wanted = nodes.select("node", "fp_a", "fp_b", "part", F.lit(0).alias("role")).unionByName(visits)
    found = stored(_gathered(texts, wanted, QUERIES_A_TASK).mapInArrow(_joined_parts(per_cent), "node long, leader long, pivot boolean"), "part-links")
    leaders = nodes.join(found.where("not pivot").drop("pivot"), "node", "left").withColumn("leader", F.coalesce("leader", "node"))
    bridges = found.where("pivot").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    own = leaders.join(pivots.select("node"), "node", "left_semi").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    tied = components(bridges.unionByName(own)).select(F.col("id").alias("leader"), "component")
    ties = stored(leaders.join(tied, "leader", "left").select("node", "n", "fp_a", "fp_b", "part", F.coalesce("component", "leader").alias("tie")), "ties")

    held = near.drop("holders").join(ties.select("node", "n", "part", "tie"), "node")
    apart = held.groupBy("token").agg(F.min("tie").alias("lo"), F.max("tie").alias("hi")).where("lo < hi").select("token")
    asking = stored(held.join(apart, "token"), "asking")
    matrix = asking.groupBy("token", "part").agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("tie").alias("tie_lo"), F.max("tie").alias("tie_hi")).withColumnRenamed("part", "to")
    fits = (
        (F.col("part") < F.col("to")) & (100 * F.col("n_hi") >= per_cent * F.col("n")) & (100 * F.col("n") >= per_cent * F.col("n_lo"))
        & ~((F.col("tie_lo") == F.col("tie")) & (F.col("tie_hi") == F.col("tie"))))
    open_for = stored(
        asking.join(matrix, "token").where(fits).groupBy("node", "to").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
        .select("node", F.col("to").alias("part")), "opened")
    guests = open_for.join(ties.drop("part"), "node").select("node", "fp_a", "fp_b", "part", F.lit(1).alias("role"), "tie")
    hosts = ties.join(open_for.select("part").distinct(), "part", "left_semi").select("node", "fp_a", "fp_b", "part", F.lit(0).alias("role"), "tie")
    links = _gathered(texts, hosts.unionByName(guests), QUERIES_A_TASK).mapInArrow(_opened_parts(per_cent), "a long, b long")
    last = components(links).select(F.col("id").alias("tie"), "component")
    ended = ties.join(last, "tie", "left").select("node", F.coalesce("component", "tie").alias("tie"))
    answers = (
        classes.drop("lead").join(ended, "node", "left").where("copies > 1 or tie is not null")
        .withColumn("tie", F.coalesce("tie", "node")))
    ends = answers.groupBy("tie").agg(F.min("least").alias("component_id"))
    named = answers.join(ends, "tie").select("n", "fp_a", "fp_b", "component_id", F.lit(True).alias("linked"))
    return sketches.select("id", "n", "fp_a", "fp_b").join(named, ["n", "fp_a", "fp_b"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op11_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_group_join": op11_token_group_join}
ORACLES = {
    "op11_token_group_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.doc_id""",
}
