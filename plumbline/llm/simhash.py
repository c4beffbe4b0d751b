"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance 2r lie both within distance r of some third
value.  So each distinct fingerprint emits every value within r of it (half
the radius), the values are shuffled, and fingerprints that meet at a value
are linked.  Distinct fingerprints are taken first: thousands of copies emit
one ball.  At most as many fingerprints meet at a value as its own ball holds
(65 for r = 1), so no group can grow; each is linked to its group's least one
and the pair is verified.  Connected components give the groups.

Texts with a similarity of 0.8 differ by ten bits or more, which no ball of a
workable radius reaches.  For a similarity of shingles the balls are therefore
put around the fingerprint's single bytes, among the texts that share a sampled
shingle; colliding pairs are verified on all their shingles.  The similarity is
Jaccard's or the cosine of the two sets, which is what bits of fingerprints
estimate: a bit differs with the probability of their angle in half turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bytes_of, mix64, pick_columns, small_batches, split_by_ids, stash
from .components import connected_components
from .suffix import numbered_rows

SEED = 42
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
PLACE = (np.arange(8) * 256).astype(np.int64)
BLOCK = 1 << 16
PIECES = 8  # bytes of a fingerprint
ORDERS = mix64(np.arange(1, PIECES + 1, dtype=np.uint64))
#: Rows at one value whose pairs are all listed; rows of larger ones are paired by their rare shingles.
CROWD = 16
COUNTERS = 1 << 18
#: Longs of a sketch, and of one folded for rows that stand at many values.
SKETCH, FOLDED = 16, 4


def shingle_digests(text: bytes | None, size: int) -> Iterator[bytes]:
    """The XXH64 of each shingle, eight bytes each, a block of shingles at a time.

    A-Z are lowered; words are joined with single spaces; repeated shingles
    count each time.  Fewer words than a shingle has: the whole sequence is
    the one shingle.  No words (or null): nothing.
    """
    words = text.lower().split() if text else []
    if not words:
        return
    size = min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    n, digest = len(words) - size + 1, xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        yield b"".join([digest(joined[b:e], SEED) for b, e in zip(begins[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist())])


def _majority(counts: np.ndarray, n: int) -> bytes:
    ones = np.einsum("pv,pvb->pb", counts.reshape(8, 256), np.broadcast_to(BITS, (8, 256, 8)))
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(text: bytes | None, size: int = 3) -> bytes:
    """Eight bytes, most significant first: a bit is one if over half the shingles' XXH64 have it; zero without words."""
    n, counts = 0, np.zeros(2048, np.int64)
    for found in shingle_digests(text, size):
        counts += np.bincount((np.frombuffer(found, np.uint8).reshape(-1, 8) + PLACE).ravel(), minlength=2048)
        n += len(found) // 8
    return _majority(counts, n) if n else bytes(8)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *[np.unique(np.frombuffer(x, ">u8").astype(np.uint64)) for x in shingle_digests(text, size)]]))


def sketch(shingles: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Whether the number of shingles that fall on a bit is odd, for each bit of so many signed longs.

    Two sets' sketches differ in no more bits than shingles are in only one of
    them, however large the sets are.  The exclusive or of a sketch's parts is
    the sketch of as many longs as a part has.
    """
    odd = np.bincount((mix64(shingles) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signature(text: bytes | None, size: int = 5) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """The fingerprint of the distinct shingles and, for each of its bytes, the shingle that is least under an order of the byte's own (all ones without words); their sketch and number."""
    counts, least, found = np.zeros(2048, np.int64), np.full(PIECES, 2**64 - 1, np.uint64), shingle_set(text, size)
    for at in range(0, len(found), BLOCK):
        hashes = found[at : at + BLOCK]
        counts += np.bincount((hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + PLACE).ravel(), minlength=2048)
        for i in range(PIECES):
            least[i] = min(least[i], mix64(hashes ^ ORDERS[i]).min())
    return (_majority(counts, len(found)) if len(found) else bytes(8)), least, sketch(found), len(found)


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint's 64 bits as a signed long; a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = b"".join([fingerprint(t, size) for t in bytes_of(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">u8").astype(np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return pick_columns(docs, id_column, text_column).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_column]}, fp long")


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` ones, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """``(u, v)``: links between the distinct fingerprints of column ``fp`` that connect all pairs within ``distance``.

    Of fingerprints that meet at a value each is linked to the least, which
    connects what all their pairs would.
    """
    reach = (distance + 1) // 2
    masks = F.array(*[F.lit(m) for m in ball(reach)])
    variants = distinct.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))
    met = variants.withColumn("u", F.min("fp").over(Window.partitionBy("variant"))).filter("u <> fp")
    if distance % 2 == 0:
        pairs = met.select("u", F.col("fp").alias("v")).distinct()
        return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    # An odd distance: meeting at a value no longer implies a link, so the few fingerprints at one value are compared.
    groups = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    pairs = groups.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v")).filter("u < v").distinct()
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    ``fingerprint`` has 16 lower-case hexadecimal digits; ``component_id`` is
    the least id of the documents that links reach.  Documents without words
    have fingerprint zero, linked like any other.  Null ids take part, but no
    component is named by one unless all its ids are null.  An empty table
    gives no rows.
    """
    prints = stash(fingerprints(docs, size, id_column, text_column), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(nodes.select("fp"), distance))
    linked = nodes.join(parts.withColumnRenamed("node", "fp"), "fp")
    # Written first, so that both sides of the joins are dealt anew and the rows of a large group can be split.
    linked = stash(linked.select("fp", "root", "least"), "simhash-linked")
    named = stash(linked.groupBy("root").agg(F.min("least").alias("named")), "simhash-named")
    grouped = linked.select("fp", "root").join(named, "root").select("fp", "named")
    ids = stash(nodes.join(grouped, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id")), "simhash-ids")
    found = prints.join(ids, "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, size: int = 3, distance: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least id, and of rows with that same id one.

    Rows whose id is null stay, as no id stands for them.
    """
    found = stash(near_duplicates(docs, size, distance, id_column, text_column), "simhash-groups")
    dropped = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(dropped.select(F.col("doc_id").alias(id_column)), id_column, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = found.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select(F.col("doc_id").alias(id_column))
    if again.isEmpty():
        return kept
    several = stash(kept.join(again, id_column, "left_semi").withColumn("__plumbline_uid", F.monotonically_increasing_id()), "simhash-several")
    best = several.groupBy(id_column).agg(F.min("__plumbline_uid").alias("__plumbline_uid"))
    one = several.join(best.select("__plumbline_uid"), "__plumbline_uid", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.join(again, id_column, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)


def signatures(numbered: DataFrame, size: int = 5) -> DataFrame:
    """``(doc, fp, mins, s, n)`` of ``(doc, text)``: the fingerprint as a signed long, a sampled shingle for each of its bytes, and the sketch and number of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = [signature(t, size) for t in bytes_of(batch.column(1))]
            fp = np.frombuffer(b"".join(x[0] for x in found), ">u8").astype(np.uint64).view(np.int64)
            mins, sketches = ([x[i].view(np.int64) for x in found] for i in (1, 2))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array(mins, longs), pa.array(sketches, longs), pa.array([x[3] for x in found], pa.int64())], names=["doc", "fp", "mins", "s", "n"])

    return numbered.select("doc", "text").mapInArrow(run, "doc long, fp long, mins array<long>, s array<long>, n long")


def meetings(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where rows of ``(doc, fp, mins, n)`` meet: ``(variant, doc, n, u, m)`` at values, ``(variant, u, v)`` at whole signatures.

    Every byte emits its ball of radius one together with its sampled shingle,
    72 values in all; two texts meet where they share the shingle and their
    bytes differ in two bits at most.  At a Jaccard similarity of 0.8 a byte
    brings a pair together with a probability of about 0.7, so all eight miss
    one in ten thousands; at a cosine of 0.8 with one half, and they miss one in
    three hundred.  Rows of one signature emit one set of values, under the least
    doc ``u``.  At a value ``u`` is the least doc, found by partial
    aggregation, so rows per value may grow; its number of shingles ``m`` goes
    along, so sizes can rule out pairs before anything is joined to them.
    """
    first = F.min(F.struct("doc", "n")).alias("least")
    same = signed.groupBy("fp", "mins").agg(first, F.count("*").alias("copies"))
    same = stash(same.select("fp", "mins", F.col("least.doc").alias("u"), F.col("least.n").alias("n"), "copies"), "similar-signatures")
    masks = [0, *[1 << b for b in range(8)]]
    values = [F.xxhash64(F.lit(i), F.get("mins", F.lit(i)), F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(F.lit(255)).bitwiseXOR(F.lit(m))) for i in range(PIECES) for m in masks]
    emitted = same.select(F.col("u").alias("doc"), "n", F.explode(F.array(*values)).alias("variant"))
    least = emitted.groupBy("variant").agg(first, F.count("*").alias("docs")).filter("docs > 1")
    # Written first, so that the join deals both sides anew and a value with many rows can be split.
    least = stash(least.select("variant", F.col("least.doc").alias("u"), F.col("least.n").alias("m")), "similar-least")
    met = emitted.join(least, "variant").select("variant", "doc", "n", "u", "m")
    equal = signed.join(same.filter("copies > 1").select("fp", "mins", "u"), ["fp", "mins"]).filter("u < doc")
    return stash(met, "similar-met"), stash(equal.select(F.xxhash64(F.lit(PIECES), "fp", "mins").alias("variant"), "u", F.col("doc").alias("v")), "similar-equal")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``(u, v)`` that lie in different components."""
    left = roots.select(F.col("node").alias("u"), F.col("root").alias("p"))
    right = roots.select(F.col("node").alias("v"), F.col("root").alias("q"))
    return pairs.join(left, "u", "left").join(right, "v", "left").filter(F.coalesce("p", "u") != F.coalesce("q", "v")).select("u", "v")


@dataclass(frozen=True)
class Bar:
    """The least similarity of two sets of ``n`` and ``m`` shingles, as what they must have in common; all arguments may be numbers, arrays or columns."""

    similarity: float = 0.8
    cosine: bool = False

    def needed(self, n, m, root=np.sqrt):
        """The least common shingles of two sets that are alike."""
        return self.similarity * root(n * m) if self.cosine else self.similarity / (1 + self.similarity) * (n + m)

    def least(self, n):
        """The least common shingles of a set with any set like it."""
        return (self.similarity**2 if self.cosine else self.similarity) * n


    def possible(self, a, n, b, m, longs):
        """Of columns with two sets' sketches (of so many longs, none for sizes alone) and sizes: whether the sets can be alike, by how many shingles at least are in only one of them."""
        apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(longs)), F.lit(0))
        return F.greatest(apart, F.abs(n - m)) <= n + m - 2 * self.needed(n, m, F.sqrt) + 1e-6


def folded(s):
    """A column with the sketch of fewer longs."""
    parts = [[F.get(s, F.lit(i)) for i in range(k, SKETCH, FOLDED)] for k in range(FOLDED)]
    return F.array(*[reduce(lambda x, y: x.bitwiseXOR(y), p) for p in parts])


def perhaps_alike(pairs: DataFrame, signed: DataFrame, bar: Bar) -> DataFrame:
    """``(u, v)`` without the pairs that their sketches show to be unlike."""
    left = signed.select(F.col("doc").alias("u"), F.col("s").alias("a"), "n")
    right = signed.select(F.col("doc").alias("w"), F.col("s").alias("b"), F.col("n").alias("m"))
    possible = bar.possible(F.col("a"), F.col("n"), F.col("b"), F.col("m"), SKETCH)
    return pairs.join(left, "u").join(right, (F.col("v") == F.col("w")) & possible).select("u", "v")


def overlaps(rooted: DataFrame, size: int, bar: Bar) -> DataFrame:
    """``(u, v)`` with ``u < v`` of ``(doc, root, text)``: all pairs of different roots that can be similar enough, and few others.

    Prefix filtering (Chaudhuri et al. 2006) with positions (Xiao et al. 2008):
    under any one order of shingles, two similar sets share one of their first,
    as many as leave too few behind them for what a similar set has in common,
    early enough in both to leave room for the overlap they need.  Shingles of rare buckets come first, so what many texts
    share is hardly among them.  Of those pairs only the ones that folded sketches leave possible are made.  No pair is
    missed, whatever the counts are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in small_batches(batches, 2):
            for text in bytes_of(batch.column(2)):
                seen += np.bincount((shingle_set(text, size) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["bucket", "c"])

    rooted = rooted.select("doc", "root", "text")
    table = rooted.mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toPandas()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int64)
    counts[table["bucket"].to_numpy(np.int64)] = table["c"].to_numpy(np.int64)
    shared = rooted.sparkSession.sparkContext.broadcast(counts)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 1 << 20):
            shingles, owner, place, total, sketches = [], [], [], [], []
            for i, text in enumerate(bytes_of(batch.column(2))):
                found = shingle_set(text, size)
                n = len(found)
                if n:
                    order = np.lexsort((found, shared.value[(found % np.uint64(COUNTERS)).astype(np.int64)]))[: n - int(np.ceil(bar.least(n) - 1e-6)) + 1]
                    shingles.append(found[order].view(np.int64))
                    owner.append(np.full(len(order), i))
                    place.append(np.arange(len(order)))
                    total.append(np.full(len(order), n))
                sketches.append(sketch(found, FOLDED))
            if shingles:
                at = pa.array(np.concatenate(owner))
                arrays = [pa.array(np.concatenate(shingles)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(place)), pa.array(np.concatenate(total)), pa.array(sketches, pa.list_(pa.int64())).take(at)]
                yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "u", "p", "i", "n", "a"])

    # Written, so that the join deals both sides anew and a shingle with many rows can be split.
    left = stash(rooted.mapInArrow(begin, "shingle long, u long, p long, i long, n long, a array<long>"), "similar-prefixes")
    right = left.select("shingle", F.col("u").alias("v"), F.col("p").alias("q"), F.col("i").alias("j"), F.col("n").alias("m"), F.col("a").alias("b"))
    room = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= bar.needed(F.col("n"), F.col("m"), F.sqrt) - 1e-6
    possible = bar.possible(F.col("a"), F.col("n"), F.col("b"), F.col("m"), FOLDED)
    return left.join(right, "shingle").filter((F.col("u") < F.col("v")) & (F.col("p") != F.col("q")) & room & possible).select("u", "v").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, bar: Bar) -> DataFrame:
    """Those of ``(u, v)`` whose sets of shingles have that similarity or more; two texts without words are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, left = None, np.empty(0, np.uint64)
        for batch in small_batches(batches, 2):
            alike = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(2)):
                if u != known:
                    known, left = u, shingle_set((a.as_py() or "").encode(), size)
                right = shingle_set((b.as_py() or "").encode(), size)
                both = len(np.intersect1d(left, right, assume_unique=True))
                alike.append(both >= bar.needed(len(left), len(right)) - 1e-9 and (both > 0 or not len(left) + len(right)))
            at = np.flatnonzero(alike)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["u", "v"])

    left = texts.select(F.col("doc").alias("u"), F.col("text").alias("left"))
    right = texts.select(F.col("doc").alias("v"), F.col("text").alias("right"))
    whole = pairs.join(right, "v").join(left, "u").select("u", "v", "right", "left")
    return whole.mapInArrow(run, "u long, v long")


def similar_links(numbered: DataFrame, size: int = 5, bar: Bar = Bar()) -> DataFrame:
    """``(u, v)``: links between rows of ``(doc, text)`` that are similar enough; their components are the groups.

    First each row is compared with the least at each of its values.  Where
    rows at a value are still in different components after that, all of those
    are compared: the pairs of a value with few rows as they are, and rows of
    crowded values by their rare shingles.  Sketches rule out what is unlike
    beyond doubt, and only the rest takes texts along.  So every pair that
    meets is linked, connected by others or known to be unlike.
    """
    signed = stash(signatures(numbered, size), "similar-prints")
    met, equal = meetings(signed)
    close = met.filter((F.col("u") < F.col("doc")) & bar.possible(None, F.col("n"), None, F.col("m"), 0))
    pairs = stash(close.select("u", F.col("doc").alias("v")).unionByName(equal.select("u", "v")).distinct(), "similar-pairs")

    def compared(some: DataFrame, name: str) -> DataFrame:
        involved = some.select(F.col("u").alias("doc")).unionByName(some.select(F.col("v").alias("doc"))).distinct()
        involved = stash(involved, f"{name}-involved")
        perhaps, _ = split_by_ids(numbered.select("doc", "text"), "doc", involved)
        texts = stash(perhaps.join(involved, "doc", "left_semi"), f"{name}-texts")
        return stash(verified(some, texts, size, bar), name)

    first = compared(stash(perhaps_alike(pairs, signed, bar), "similar-possible"), "similar-first")
    roots = stash(connected_components(first), "similar-roots")
    # A row unlike the one that stands for its signature meets whatever that one meets.
    alone = stash(apart(equal.select("u", "v"), roots).join(equal, ["u", "v"]).select("variant", "u", "v"), "similar-alone")
    rows = met.select("variant", "doc").unionByName(alone.select("variant", F.col("v").alias("doc"))).unionByName(alone.select("variant", F.col("u").alias("doc")).distinct())
    rows = rows.unionByName(met.join(alone.select(F.col("u").alias("doc"), "v"), "doc").select("variant", F.col("v").alias("doc")))
    rows = stash(rows.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select("variant", "doc", F.coalesce("root", "doc").alias("root")), "similar-rows")
    mixed = stash(rows.groupBy("variant").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("n")).filter("p < q").select("variant", "n"), "similar-mixed")
    rows = stash(rows.join(mixed, "variant"), "similar-unsettled")
    few = rows.filter(F.col("n") <= CROWD).select("variant", "doc", "root").join(signed.select("doc", folded(F.col("s")).alias("a"), F.col("n")), "doc")
    few = stash(few, "similar-few")
    possible = bar.possible(F.col("a"), F.col("n"), F.col("b"), F.col("m"), FOLDED)
    few = few.join(few.select("variant", F.col("doc").alias("v"), F.col("root").alias("q"), F.col("a").alias("b"), F.col("n").alias("m")), "variant").filter((F.col("doc") < F.col("v")) & (F.col("root") != F.col("q")) & possible).select(F.col("doc").alias("u"), "v").distinct()
    crowd = stash(rows.filter(F.col("n") > CROWD).select("doc", "root").distinct(), "similar-crowd")
    perhaps, _ = split_by_ids(numbered.select("doc", "text"), "doc", crowd)
    crowded = stash(perhaps.join(crowd, "doc").select("doc", "root", "text"), "similar-crowded")
    rest = stash(few.unionByName(overlaps(crowded, size, bar)).distinct().join(pairs, ["u", "v"], "left_anti"), "similar-rest")
    return first.unionByName(compared(stash(perhaps_alike(rest, signed, bar), "similar-others"), "similar-second"))


def deduplicate_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text", cosine: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group that links of similar shingle sets connect.

    Similarity is Jaccard's, or the cosine of the two sets.  At a cosine of 0.8
    sets of one size have a Jaccard similarity of two thirds.

    It is the row with the least id, or the first row where an id is null or
    repeated.  Null texts are empty; texts without words are alike.  An empty
    table gives no rows.
    """
    numbered, rows = numbered_rows(docs, id_column, text_column)
    groups = connected_components(similar_links(numbered, size, Bar(similarity, cosine)))
    gone = groups.filter("node <> root").select(F.col("node").alias("__plumbline_doc"))
    return rows.join(gone, "__plumbline_doc", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
