"""Near-duplicate documents by MinHash and a multi-index Hamming join.

Texts with the same shingle set are folded first.  Each remaining set has a MinHash
signature of ``SLOTS`` values of 16 bits.  Two sets as alike as the threshold asks differ
in more than ``distance`` slots with a probability below one in a hundred thousand.
Signatures are split into ``chunks`` chunks: of two signatures at most ``distance`` apart,
some chunk differs in at most one slot (pigeonhole), so each signature is listed under every
chunk with every single slot left out, and every pair under the distance meets in a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textorbit.llm import words
from textorbit.llm.arrow import bounds, matrix, raw_texts, whole_runs
from textorbit.llm.components import components
from textorbit.session import cut

WORDS = 5
SLOTS = 64
#: Highest chance that a pair at the threshold differs in more slots than the distance.
MISSED = 1e-5


@dataclass(frozen=True)
class Links:
    """Link where 100 * shared shingles >= ``percent`` * all shingles, and how pairs are found for it."""

    percent: int

    def __post_init__(self):
        if self.percent > 100 or self.chunks > SLOTS // 3:
            raise ValueError(f"signatures of {SLOTS} slots don't find pairs of {self.percent} per cent")

    @cached_property
    def distance(self) -> int:
        """Least number of slots that all but ``MISSED`` of the pairs at the threshold differ in at most."""
        p, missed, slots = 1 - self.percent / 100, 1.0, -1
        while missed >= MISSED:
            slots += 1
            missed -= comb(SLOTS, slots) * p**slots * (1 - p) ** (SLOTS - slots)
        return slots

    @property
    def chunks(self) -> int:
        """So many that some chunk differs in one slot at most."""
        return self.distance // 2 + 1

    @cached_property
    def starts(self) -> np.ndarray:
        return np.linspace(0, SLOTS, self.chunks + 1).astype(np.int64)[:-1]

    @cached_property
    def chunk_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunks), np.diff([*self.starts, SLOTS]))


#: The threshold unless a caller says otherwise.
PERCENT = 85
LINKS = Links(PERCENT)
DISTANCE = LINKS.distance
CHUNKS = LINKS.chunks

#: A list longer than this is united as it stands, which only makes candidate groups larger.
LIST_ROWS = 32_768
#: Candidate groups up to this size are compared in one task; larger ones in tiles.
GROUP_DOCS = 8_192
GROUP_SHINGLES = 4_000_000
#: Rounds of random tiles that shrink a large group before all its tiles meet.
TILE_ROUNDS = 3

_HASHES = words.odd_constants(SLOTS)
_SLOT = words.odd_constants(SLOTS)
_SALT = words.odd_constants(SLOTS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the mixed least hash, for each of ``SLOTS`` hash functions."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _HASHES).min(axis=0))
    return (words.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, marks = [], [], []
        for data in raw_texts(batch.column(1)):
            shingles = words.shingle_set(data, WORDS)
            counts.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            marks.append(signature(shingles).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())],
            ["doc_id", "n_shingles", "digest", "mark"],
        )


def _lists(batches: Iterator[pa.RecordBatch], links: Links = LINKS) -> Iterator[pa.RecordBatch]:
    """A row for each signature and left-out slot: the hash of the rest of its chunk."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            parts = matrix(batch.column(1), SLOTS, np.uint16).astype(np.uint64) * _SLOT
            rest = np.add.reduceat(parts, links.starts, axis=1)[:, links.chunk_of] - parts
            keys = words.mix(rest + _SALT).view(np.int64)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, SLOTS))], ["key", "id"])


def _alike(a: np.ndarray, b: np.ndarray, links: Links) -> np.ndarray:
    """Whether two set sizes allow the similarity at all."""
    return 100 * np.minimum(a, b) >= links.percent * np.maximum(a, b)


def _forest(ids: np.ndarray, sizes: np.ndarray, marks: np.ndarray, links: Links) -> list[tuple[int, int]]:
    """Edges that join all members that signatures at most the distance apart connect."""
    edges, left = [], np.arange(len(ids))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = ((marks[left] != marks[i]).sum(axis=1) <= links.distance) & _alike(sizes[left], sizes[i], links)
            edges += [(ids[i], ids[j]) for j in left[near]]
            front += list(left[near])
            left = left[~near]
    return edges


def _candidates(batches: Iterator[pa.RecordBatch], links: Links) -> Iterator[pa.RecordBatch]:
    """Edges within each list of a stream sorted by list; a list has at most ``LIST_ROWS`` rows."""
    for table in whole_runs(batches, 0):
        table = table.combine_chunks()
        keys, ids, sizes = (table.column(c).to_numpy() for c in range(3))
        marks = matrix(table.column(3), SLOTS, np.uint16)
        at = bounds(keys)
        starts, counts = at[:-1], np.diff(at)
        two = starts[counts == 2]
        near = ((marks[two] != marks[two + 1]).sum(axis=1) <= links.distance) & _alike(sizes[two], sizes[two + 1], links)
        left, right = [ids[two[near]]], [ids[two[near] + 1]]
        for start, count in zip(starts[counts > 2], counts[counts > 2], strict=True):
            part = slice(start, start + count)
            edges = _forest(ids[part], sizes[part], marks[part], links)
            if edges:
                a, b = np.array(edges, np.int64).T
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["a", "b"])


def _link(labels: np.ndarray, sets: list[np.ndarray], marks: np.ndarray, links: Links) -> np.ndarray:
    """The least label of each set's component, by exact similarity of whole sets.

    Sets that share a label already are not compared.
    """
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = codes.astype(np.int32)
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    here = np.zeros(int(codes.max()) + 1, bool)
    labels = labels.copy()
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
        j = j[_alike(sizes[j], sizes[i], links)]
        j = j[(marks[j] != marks[i]).sum(axis=1) <= links.distance]
        if not len(j):
            continue
        here[codes[at[i] : at[i + 1]]] = True
        turns = np.cumsum(sizes[j]) // 2_000_000
        for turn in np.unique(turns):
            some = j[turns == turn]
            ends = np.cumsum(sizes[some])
            place = np.repeat(at[some] - ends + sizes[some], sizes[some]) + np.arange(ends[-1])
            shared = np.add.reduceat(here[codes[place]].astype(np.int64), ends - sizes[some])
            linked = some[100 * shared >= links.percent * (sizes[i] + sizes[some] - shared)]
            if len(linked):
                joined = np.unique(np.append(labels[linked], labels[i]))
                labels[np.isin(labels, joined)] = joined[0]
        here[codes[at[i] : at[i + 1]]] = False
    return labels


def _confirm(batches: Iterator[pa.RecordBatch], links: Links) -> Iterator[pa.RecordBatch]:
    """Old and new label of documents in a stream sorted by group."""
    for table in whole_runs(batches, 0):
        groups = table.column(0).to_numpy()
        at = bounds(groups)
        old, new = [], []
        for start, end in zip(at[:-1], at[1:], strict=True):
            part = table.slice(start, end - start)
            wanted = part.column(2).to_pylist()
            labels, sets, marks, seen = [], [], [], set()
            for k, data in enumerate(raw_texts(part.column(4).combine_chunks())):
                label, mark = part.column(1)[k].as_py(), part.column(3)[k].as_py()
                shingles = words.shingle_set(data, WORDS)
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                if digest == wanted[k] and digest not in seen:  # an id may stand on other texts too
                    seen.add(digest)
                    labels.append(label)
                    sets.append(shingles)
                    marks.append(np.frombuffer(mark, np.uint16))
            if len(sets) > 1:
                labels = np.array(labels, np.int64)
                found = _link(labels, sets, np.array(marks), links)
                moved = found != labels
                old.append(labels[moved])
                new.append(found[moved])
        if old:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (old, new)], ["a", "b"])


def _confirmed(members: DataFrame, docs: DataFrame, links: Links) -> DataFrame:
    """Label merges found in the groups of ``members`` (group, id, label, digest, mark)."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = members.join(texts, "id").select("group", "label", "digest", "mark", "text")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(partial(_confirm, links=links), "a long, b long")


def _tiled(members: DataFrame, docs: DataFrame, links: Links) -> DataFrame:
    """Merges of groups too large for one task: ``(a, b)`` with b the component of a.

    First random tiles of a group are compared, which joins the bulk of any dense group;
    then all tiles whose documents don't all have one label meet pairwise.  Tiles are
    made by label, so that a component's own tiles don't meet one another.
    """
    size = members.groupBy("group").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total"))
    tiles = F.ceil(F.greatest(2 * F.col("docs") / GROUP_DOCS, 2 * F.col("total") / GROUP_SHINGLES)).cast("long")
    members = cut(members.join(size.select("group", tiles.alias("tiles")), "group"))
    merges = None
    labelled = members.withColumn("label", F.col("id"))
    for r in range(TILE_ROUNDS):
        tile = F.xxhash64("group", F.pmod(F.xxhash64("id", F.lit(r)), "tiles"))
        found = _confirmed(labelled.withColumn("group", tile), docs, links)
        merges = cut(found if merges is None else found.unionByName(merges))
        labelled = _relabel(members, merges)
    labelled = cut(labelled)
    sizes = labelled.groupBy("group", "label").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total"))
    parts = F.ceil(F.greatest(2 * F.col("docs") / GROUP_DOCS, 2 * F.col("total") / GROUP_SHINGLES)).cast("long")
    placed = labelled.join(sizes.select("group", "label", parts.alias("parts")), ["group", "label"])
    own = F.xxhash64("label", F.pmod(F.xxhash64("id"), "parts"))
    shared = F.xxhash64("group", F.pmod(F.xxhash64("label"), "tiles"))
    placed = cut(placed.withColumn("tile", F.when(F.col("parts") > 1, own).otherwise(shared)))
    kinds = placed.groupBy("group", "tile").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    x, y = kinds.alias("x"), kinds.alias("y")
    mixed = F.least("x.low", "y.low") != F.greatest("x.high", "y.high")
    pairs = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.tile") <= F.col("y.tile")) & mixed)
    pairs = pairs.select("x.group", F.col("x.tile").alias("s"), F.col("y.tile").alias("t"))
    pairs = pairs.select("group", F.xxhash64("s", "t").alias("pair"), F.explode(F.array_distinct(F.array("s", "t"))).alias("tile"))
    met = placed.join(pairs, ["group", "tile"]).withColumn("group", F.col("pair"))
    return components(_confirmed(met, docs, links).unionByName(merges), "a", "b").toDF("a", "b")


def _relabel(members: DataFrame, merges: DataFrame) -> DataFrame:
    found = components(merges, "a", "b").withColumnRenamed("node", "id")
    return members.join(found, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Component of every document under near-duplicate links.

    A-Z is lower-cased and words are runs of other than ASCII white space.  A document's
    set are its distinct shingles of ``WORDS`` words, or its whole sequence if shorter.
    Documents whose sets are at least ``percent`` per cent alike are linked.

    Returns a row for each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``
    (smallest id that links reach, its own included) and ``kept`` (it is that one).
    A null or empty text, or one without words, has no shingles and no links.  A row
    without an id has no links, a null component and is kept.  Repeated rows share a
    component; rows that repeat an id with another text are each judged by their text.
    Other columns don't matter.  An empty table gives an empty result.
    """
    links = Links(percent)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profiles = cut(docs.mapInArrow(_profiles, "doc_id long, n_shingles long, digest binary, mark binary"))
    linkable = profiles.where("n_shingles > 0 and doc_id is not null")
    folded = linkable.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("mark").alias("mark")
    )
    folded = cut(folded)
    # a smallest id that stands for two sets (rows that repeat an id) keeps the lists correct by itself
    lists = folded.select("id", "mark").mapInArrow(partial(_lists, links=links), "key long, id long")
    # Counts combine before the shuffle, and a list that a third of all signatures share is
    # joined with its one row of counts, which Spark may split; no task gets such a list whole.
    shared = lists.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("head")).where("members > 1")
    lists = cut(lists.join(shared, "key"))
    long = lists.where((F.col("members") > LIST_ROWS) & (F.col("id") != F.col("head")))
    short = lists.where(F.col("members") <= LIST_ROWS).select("key", "id")
    listed = short.join(folded.select("id", "n_shingles", "mark"), "id").select("key", "id", "n_shingles", "mark")
    edges = listed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_candidates, links=links), "a long, b long")
    edges = edges.unionByName(long.select(F.col("head").alias("a"), F.col("id").alias("b")))
    groups = components(edges, "a", "b")
    members = groups.withColumnRenamed("component", "group").withColumnRenamed("node", "id").join(folded, "id")
    members = cut(members.withColumn("label", F.col("id")))
    size = members.groupBy("group").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total"))
    large = cut(size.where((F.col("docs") > GROUP_DOCS) | (F.col("total") > GROUP_SHINGLES)).select("group"))
    if large.isEmpty():
        labels = _confirmed(members, docs, links)
    else:
        labels = _confirmed(members.join(large, "group", "left_anti"), docs, links).unionByName(
            _tiled(members.join(large, "group", "left_semi"), docs, links)
        )
    labels = labels.groupBy("a").agg(F.min("b").alias("b"))
    classes = folded.join(labels, folded.id == labels.a, "left").select("digest", F.coalesce("b", "id").alias("found"))
    rows = profiles.join(classes, "digest", "left")
    own = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(own, F.col("doc_id")).otherwise(F.col("found"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
