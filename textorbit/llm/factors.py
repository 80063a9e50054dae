"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Each text gives seeds: of any ``WINDOW`` consecutive words, a run of ``SEED`` words with the
least hash.  A seed's owner is the smallest document that has it; the owner's words around it
lie in a reference block.  The index of seeds names the blocks that a text shares anything
with, and the text's words around those seeds are factored greedily against each: a factor is
the longest match of what follows with any place of the block.  A window of the text that
occurs in the block lies within one factor, or crosses the end of one, so factors of
``WINDOW`` words are duplicates, and windows over the ends are looked up in the block.

What crosses an end and isn't in the owner's block may still stand in another document that
shares only a part with the owner.  Every document that holds such a window leaves it
over in the same way, so these few meet by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textorbit.llm import words
from textorbit.llm.arrow import raw_texts
from textorbit.session import cut

WINDOW = 50
SEED = 20
#: Words by which a window may begin before a seed that it holds.
BEFORE = WINDOW - SEED
#: Seeds of a block start in so many words of the owner.
BLOCK = 1_024

_BASES = words.odd_constants(3)
_NOTHING = hashlib.sha256(b"").hexdigest()


_INVERSES: dict[int, int] = {}


def rolling(hashes: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words that depends on the words alone, not on their place."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    b = int(_BASES[base])
    back = _INVERSES.setdefault(b, pow(b, -1, 1 << 64))
    powers = np.cumprod(np.full(n, b, np.uint64))
    unpowers = np.cumprod(np.full(n - size + 1, back, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
    return words.mix((sums[size:] - sums[:-size]) * unpowers)


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the least seeds: at least one, the least, in each window of words."""
    values = rolling(hashes, SEED)
    span = BEFORE + 1
    if len(values) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least, width = np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        a, b = least[:-step], least[step:]
        least = np.where(values[a] <= values[b], a, b)
        width += step
    places = least[np.concatenate([[True], least[1:] != least[:-1]])]
    values = values[places]
    # Of equal seeds in a row, the first and last of each half window stay: whatever window
    # holds one that goes has one that stays.
    first = np.concatenate([[True], values[1:] != values[:-1]])
    begin = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
    turn = (places - begin) // (span // 2)
    first[1:] |= turn[1:] != turn[:-1]
    keep = first | np.concatenate([first[1:], [True]])
    return values[keep], places[keep]


class Reference:
    """A block's words with their suffixes in order, and its seeds and windows."""

    def __init__(self, hashes: np.ndarray):
        self.x = hashes
        n = len(hashes)
        rank = np.unique(hashes, return_inverse=True)[1].reshape(-1).astype(np.int64)
        width = 1
        while width < n and len(rank) and rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].reshape(-1)
            width *= 2
        self.suffixes = np.argsort(rank)
        self.seeds = np.unique(rolling(hashes, SEED))
        self.windows = np.unique(rolling(hashes, WINDOW))

    def _common(self, h: np.ndarray, i: int, place: int) -> int:
        n = min(len(h) - i, len(self.x) - place)
        differs = np.flatnonzero(h[i : i + n] != self.x[place : place + n])
        return int(differs[0]) if len(differs) else n

    def longest(self, h: np.ndarray, i: int) -> int:
        """Words from i on that also follow one another somewhere in the block, as many as there are."""
        low, high, best = 0, len(self.suffixes), 0
        while low < high:
            mid = (low + high) // 2
            place = int(self.suffixes[mid])
            n = self._common(h, i, place)
            best = max(best, n)
            if i + n == len(h):
                break
            if place + n < len(self.x) and self.x[place + n] > h[i + n]:
                high = mid
            else:
                low = mid + 1
        return best

    def factors(self, h: np.ndarray) -> list[tuple[int, int]]:
        """Greedy factors (start, length); stretches without a seed of the block are passed over."""
        starts = np.flatnonzero(_among(rolling(h, SEED), self.seeds))
        out, at = [], 0
        while (k := int(np.searchsorted(starts, at))) < len(starts):
            i = int(starts[k])
            length = self.longest(h, i)
            out.append((i, length))
            at = i + length
        return out

    def known(self, h: np.ndarray) -> np.ndarray:
        """Whether each window of ``h`` occurs in the block."""
        count = len(h) - WINDOW + 1
        out, over = np.zeros(max(count, 0), bool), np.zeros(max(count, 0), bool)
        for start, length in self.factors(h):
            end = start + length
            out[start : max(start, end - WINDOW + 1)] = True
            over[max(start, end - WINDOW + 1) : end] = True
        over = np.flatnonzero(over & ~out)
        if len(over):
            out[over] = _among(rolling(h, WINDOW)[over], self.windows)
        return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words, in order."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _split(data: bytes) -> list[bytes]:
    return [w for piece in words.pieces(data) for w in piece.split()]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])


_PROFILE = "doc_id long, digest binary, n_words long, whole string, seeds binary, places binary"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        ids, digests = (batch.column(c).to_pylist() for c in (0, 1))
        for doc_id, digest, data in zip(ids, digests, raw_texts(batch.column(2)), strict=True):
            hashes = words.word_hashes(data)
            values, places = seeds(hashes) if doc_id is not None else seeds(hashes[:0])
            whole, gap = hashlib.sha256(), b""
            for piece in words.pieces(data):
                if parts := piece.split():
                    whole.update(gap + b" ".join(parts))
                    gap = b" "
            cells = values.tobytes(), places.astype(np.int32).tobytes()
            rows.append((doc_id, digest, len(hashes), whole.hexdigest(), *cells))
        if rows:
            yield _batch(rows, _PROFILE)


_SEEDS = "seed long, doc_id long, row long, place int"


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each seed of (doc_id, row, seeds, places)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            values, places = (b"".join(batch.column(c).to_pylist()) for c in (2, 3))
            counts = np.array([len(c) // 8 for c in batch.column(2).to_pylist()], np.int64)
            ids, rows = (np.repeat(batch.column(c).to_numpy(), counts) for c in (0, 1))
            columns = [np.frombuffer(values, np.int64), ids, rows, np.frombuffer(places, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["seed", "doc_id", "row", "place"])


_PARTS = "owner long, block int, row long, doc_id long, owner_id long, start int, places binary, words binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted words of each text (row, doc_id, orders, text): blocks of an owner, and stretches around seeds."""
    for batch in batches:
        rows, held = [], 0
        for k, data in enumerate(raw_texts(batch.column(3))):
            row, doc_id, orders = (batch.column(c)[k].as_py() for c in range(3))
            parts = _split(data)
            for order in orders:
                owner, block, owner_id, places = (order[c] for c in ("owner", "block", "owner_id", "places"))
                if places is None:
                    start = max(0, block * BLOCK - BEFORE)
                    cell = b" ".join(parts[start : (block + 1) * BLOCK + WINDOW])
                    rows.append((owner, block, row, None, None, start, None, cell))
                    held += len(cell)
                    continue
                places = np.sort(np.array(places, np.int64))
                for s, e in spans(np.maximum(places - BEFORE, 0), places + WINDOW):
                    own = places[(places >= s) & (places < e)] - s
                    cell = b" ".join(parts[s:e])
                    rows.append((owner, block, row, doc_id, owner_id, s, own.astype(np.int32).tobytes(), cell))
                    held += len(cell)
            if held > 8 << 20:
                yield _batch(rows, _PARTS)
                rows, held = [], 0
        if rows:
            yield _batch(rows, _PARTS)


_FOUND = "row long, doc_id long, start int, end int, hash_a long, hash_b long"


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Duplicate spans, and windows left over with two hashes, of stretches (as in ``_PARTS``) beside their blocks."""
    now, reference = None, None
    for whole in batches:
        for turn in range(0, whole.num_rows, 512):
            batch = whole.slice(turn, 512)
            owners, blocks, rows, ids, owner_ids, starts, places, cells, known = (c.to_pylist() for c in batch.columns)
            out = []
            for k, cell in enumerate(cells):
                if (owners[k], blocks[k]) != now:
                    now, reference = (owners[k], blocks[k]), Reference(words.word_hashes(known[k]))
                h = words.word_hashes(cell)
                found = reference.known(h)
                at = np.flatnonzero(found)
                if len(at) and owner_ids[k] < ids[k]:
                    cuts = np.flatnonzero(np.diff(at) > WINDOW)
                    s, e = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)] + WINDOW
                    none = np.zeros(len(s), np.int64)
                    out.append((rows[k], ids[k], starts[k] + s, starts[k] + e, none, none, none == 0))
                # windows that hold one of the seeds and aren't in the block
                marks = np.zeros(len(found) + 1, np.int64)
                own = np.frombuffer(places[k], np.int32)
                np.add.at(marks, np.clip(own - BEFORE, 0, len(found)), 1)
                np.add.at(marks, np.clip(own + 1, 0, len(found)), -1)
                left = np.flatnonzero((np.cumsum(marks[:-1]) > 0) & ~found)
                if len(left):
                    a, b = (rolling(h, WINDOW, base)[left].view(np.int64) for base in (1, 2))
                    s = starts[k] + left
                    out.append((rows[k], ids[k], s, s + WINDOW, a, b, np.zeros(len(s), bool)))
            if out:
                counts = [len(x[2]) for x in out]
                ids = [np.repeat(np.array([x[c] for x in out], np.int64), counts) for c in (0, 1)]
                at = [np.concatenate([x[c] for x in out]).astype(np.int32) for c in (2, 3)]
                mask = np.concatenate([x[6] for x in out])
                hashes = [pa.array(np.concatenate([x[c] for x in out]), mask=mask) for c in (4, 5)]
                columns = [*map(pa.array, ids + at), *hashes]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "start", "end", "hash_a", "hash_b"])


_CLEANED = "row long, n_removed long, kept_sha256 string"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (row, spans, text) without their spans."""
    for batch in batches:
        out = []
        for k, data in enumerate(raw_texts(batch.column(2))):
            row = batch.column(0)[k].as_py()
            parts = _split(data)
            keep = np.ones(len(parts), bool)
            for span in batch.column(1)[k].as_py():
                keep[span["start"] : span["end"]] = False
            digest = hashlib.sha256(b" ".join(compress(parts, keep.tolist()))).hexdigest()
            out.append((row, int((~keep).sum()), digest))
        if out:
            yield _batch(out, _CLEANED)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text without the passages that a document with a smaller id has as well.

    Words are runs of other than ASCII white space.  Each word goes that is covered by a
    window of ``WINDOW`` consecutive words whose sequence also starts in a document with a
    smaller id; windows are judged on the input.

    Returns a row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the
    kept words, joined by one space).

    A null, empty or blank text has no words.  A row without an id loses nothing and takes
    nothing from others.  Rows that share an id don't take from one another; each row has the
    result of its own text.  Texts of any length are looked at whole, the words of one text in one
    task.  Other columns don't matter; an empty table gives an empty one.

    Equal texts are folded first: of a repeated text of ``WINDOW`` words or more, nothing stays
    but in the rows with its smallest id.
    """
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    # Rows equal in both combine before the shuffle, and the join on both needs no other one.
    texts = docs.where("doc_id is not null").dropDuplicates(["doc_id", "digest"])
    profiles = docs.mapInArrow(_profiles, _PROFILE).withColumn("row", F.monotonically_increasing_id())
    profiles = cut(profiles)
    long = profiles.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    heads = cut(long.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("head")).select("digest", "head.*"))
    singles = profiles.join(heads.select("row"), "row", "left_semi").select("doc_id", "row", "seeds", "places")
    anchors = cut(singles.mapInArrow(_seeds, _SEEDS))

    owners = anchors.groupBy("seed").agg(F.min(F.struct("doc_id", "row", "place")).alias("o"), F.max("doc_id").alias("last"))
    owners = owners.where("last > o.doc_id").select(
        "seed", F.col("o.doc_id").alias("owner_id"), F.col("o.row").alias("owner"), F.col("o.place").alias("owner_place")
    )
    owners = cut(owners)  # so that Spark may split the rows of a seed that very many texts have
    links = anchors.join(owners, "seed").where("row != owner or place != owner_place")
    links = links.withColumn("block", F.expr(f"int(owner_place div {BLOCK})"))
    stretches = links.groupBy("row", "owner", "block", "owner_id").agg(F.collect_list("place").alias("places"))
    stretches = cut(stretches)
    order = F.struct("owner", "block", "owner_id", "places").alias("order")
    wanted = stretches.select("owner", "block").distinct()
    wanted = wanted.select(
        F.col("owner").alias("row"),
        F.struct(
            "owner", "block", F.lit(None).cast("long").alias("owner_id"), F.lit(None).cast("array<int>").alias("places")
        ).alias("order"),
    )
    orders = stretches.select("row", order).unionByName(wanted).groupBy("row").agg(F.collect_list("order").alias("orders"))
    parts = orders.join(heads, "row").join(texts, ["doc_id", "digest"]).select("row", "doc_id", "orders", "text")
    parts = cut(parts.mapInArrow(_parts, _PARTS))

    blocks = parts.where("doc_id is null").select("owner", "block", F.col("words").alias("known"))
    met = parts.where("doc_id is not null").join(blocks, ["owner", "block"])
    found = cut(met.mapInArrow(_factored, _FOUND))

    left = found.where("hash_a is not null")
    least = left.groupBy("hash_a", "hash_b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = left.join(least.where("least < most"), ["hash_a", "hash_b"]).where("doc_id > least")
    dropped = found.where("hash_a is null").select("row", "start", "end").unionByName(shared.select("row", "start", "end"))
    dropped = dropped.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cleaned = dropped.join(heads, "row").join(texts, ["doc_id", "digest"]).select("row", "spans", "text")
    cleaned = cleaned.mapInArrow(_cleaned, _CLEANED)

    heads = heads.join(cleaned, "row", "left").withColumnRenamed("doc_id", "head_id").drop("row")
    rows = profiles.select("doc_id", "digest", "n_words", "whole").join(heads, "digest", "left")
    copy = F.col("doc_id") > F.col("head_id")
    own = F.col("doc_id").eqNullSafe(F.col("head_id"))
    removed = F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0)
    kept = F.when(copy, F.lit(_NOTHING)).when(own, F.coalesce("kept_sha256", "whole")).otherwise(F.col("whole"))
    return rows.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
