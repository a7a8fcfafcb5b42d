"""Near-duplicate documents: BagMinHash signatures over word shingles, bands, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from munim.llm.support import components, cut, fresh, light, number_rows, ship, word_count
from munim.operators.ordered import running_total

ship(__name__)

#: Words of a shingle, least weighted Jaccard similarity of a link.
WORDS, LEAST = 5, 0.8
#: A pair at similarity s meets in some band with probability 1 - (1 - s ** ROWS) ** BANDS:
#: 0.999997 at 0.8, and more above.
BANDS, ROWS = 32, 5
#: Arrivals of a Poisson process drawn at once, and elements whose arrivals are drawn at once.
DRAWS, SLICE = 8, 16_384
#: Cached word hashes per worker.
CACHE_WORDS = 100_000
#: Shingles of verified texts that a worker keeps.
CACHE_SHINGLES = 500_000
#: Members of a tile that are compared in one task, and shingles at a time.
TILE, COLUMNS = 1_024, 4_096
#: Characters of text that are signed at once.
CHUNK_CHARS = 1_000_000

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Hashes of the word shingles of a text; words are runs outside ASCII white space."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "surrogatepass").split()
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out = []
        for t in tokens:
            h = cache.get(t)
            if h is None:
                h = cache[t] = xxhash.xxh3_64_intdigest(t)
            out.append(h)
        return np.array(out, dtype=U)

    def shingles(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, sorted, with their counts; a shorter text is one shingle."""
        w = self.words(text)
        if not len(w):
            return w, np.zeros(0, dtype=np.int64)
        n = min(WORDS, len(w))
        h = np.zeros(len(w) - n + 1, dtype=U)
        for k in range(n):
            h = mixed(h * U(3) + w[k:len(w) - n + 1 + k] + U(n))
        return np.unique(h, return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """BagMinHash values (docs x BANDS * ROWS) of weighted elements, ``doc`` in ascending order.

    Over the axis of weights every element has a Poisson process of points in time, each with a
    signature slot; an element of weight w owns the points on [0, w), and a slot's value is the
    first point that any of a document's elements owns.  Two documents agree in a slot with the
    probability of their weighted Jaccard similarity.  Weights are whole numbers, so the axis is
    cut into [0, 1), [1, 2), [2, 4), [4, 8) ...; a point finds its place within such an interval
    by the bits of a hash, and an element that ends inside one drops the points beyond its
    weight.  Points are drawn in order of time, until all slots of a document must be filled.
    """
    m = BANDS * ROWS
    total = np.bincount(doc, weights, docs)
    best_t = np.full(docs * m, np.inf)
    best_v = np.zeros(docs * m, dtype=U)
    until = np.where(total > 0, (np.log(m) + 3.0) / np.maximum(total, 1), 0.0)
    todo = np.flatnonzero(total > 0)
    # One row per element and interval.
    level = np.zeros(len(weights), dtype=np.int64)
    parts = [(np.arange(len(weights)), level)]
    j = 1
    while (owner := np.flatnonzero(weights > 2 ** (j - 1))).size:
        parts.append((owner, np.full(len(owner), j)))
        j += 1
    owner = np.concatenate([p[0] for p in parts])
    level = np.concatenate([p[1] for p in parts])
    start = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    length = np.where(level == 0, 1.0, start)
    limit = weights[owner]
    seed = mixed(elements[owner] + mixed(level.astype(U) + U(1)))
    home = doc[owner]
    while todo.size:
        open_ = np.zeros(docs, dtype=bool)
        open_[todo] = True
        rows = np.flatnonzero(open_[home])
        for low in range(0, len(rows), SLICE):
            row = rows[low:low + SLICE]
            clock = np.zeros(len(row))
            drawn = 0
            while row.size:
                n = np.arange(drawn + 1, drawn + DRAWS + 1, dtype=U)
                h = mixed(seed[row][:, None] + n[None] * U(0x9E3779B97F4A7C15))
                gap = -np.log(((h >> U(11)).astype(np.float64) + 0.5) / 2.0 ** 53)
                t = clock[:, None] + np.cumsum(gap, axis=1) / (length[row] * m)[:, None]
                at = mixed(h ^ U(0xD6E8FEB86659FD93))
                place = (at >> U(11)).astype(np.float64) / 2.0 ** 53 * length[row][:, None]
                place += start[row][:, None]
                r, c = np.nonzero((t <= until[home[row]][:, None]) & (place < limit[row][:, None]))
                slot = home[row[r]] * m + (mixed(at[r, c]) % U(m)).astype(np.int64)
                order = np.lexsort((t[r, c], slot))
                first = np.flatnonzero(np.diff(slot[order], prepend=-1))  # earliest of each slot
                pick = order[first]
                slot, time, value = slot[pick], t[r[pick], c[pick]], h[r[pick], c[pick]]
                better = time < best_t[slot]
                best_t[slot[better]], best_v[slot[better]] = time[better], value[better]
                clock = t[:, -1]
                on = clock <= until[home[row]]
                row, clock = row[on], clock[on]
                drawn += DRAWS
        empty = np.isinf(best_t.reshape(docs, m)).any(axis=1)
        todo = todo[empty[todo]]
        until[todo] *= 1.5  # a slot is still empty: draw again, further
    return best_v.reshape(docs, m)


def bands(values: np.ndarray) -> np.ndarray:
    """One hash per band of signature values."""
    v = values.reshape(len(values), BANDS, ROWS)
    h = np.zeros(v.shape[:2], dtype=U)
    for k in range(ROWS):
        h = mixed(h * U(3) + v[:, :, k])
    return h.view(np.int64)


def sign(texts: DataFrame) -> DataFrame:
    """Rows (_id, _h1, _h2, weight, bands) of rows (_id, _h1, _h2, text); weight counts shingles."""
    kind = dict(texts.dtypes)["_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            size = batch["text"].str.len().fillna(0).to_numpy().cumsum()
            for _, rows in batch.groupby((size // CHUNK_CHARS).astype(int)):
                found = [shingler.shingles(t) for t in rows["text"]]
                doc = np.repeat(np.arange(len(found)), [len(e) for e, _ in found])
                elements = np.concatenate([e for e, _ in found]).astype(U)
                weights = np.concatenate([w for _, w in found]).astype(np.float64)
                values = signatures(elements, weights, doc, len(found))
                yield pd.DataFrame({
                    "_id": rows["_id"].array, "_h1": rows["_h1"].array, "_h2": rows["_h2"].array,
                    "weight": np.bincount(doc, weights, len(found)).astype(np.int64),
                    "bands": list(bands(values))})

    return texts.mapInPandas(run, f"_id {kind}, _h1 long, _h2 long, weight long, bands array<long>")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' shingle multisets overlap enough: sum of min / sum of max."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        bags: dict[int, tuple] = {}
        held = 0
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                for v, text in ((a, ta), (b, tb)):
                    if v not in bags:
                        if held > CACHE_SHINGLES:
                            bags, held = {}, 0
                        bags[v] = shingler.shingles(text)
                        held += len(bags[v][0])
                # The first of the pair may have gone with a full cache.
                (ea, wa), (eb, wb) = bags.get(a) or shingler.shingles(ta), bags[b]
                _, i, j = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
                common = np.minimum(wa[i], wb[j]).sum()
                keep.append(common >= LEAST * (wa.sum() + wb.sum() - common))
            yield batch.loc[keep, ["a", "b"]]

    of = lambda k: texts.select(F.col("v").alias(k), F.col("text").alias(f"t{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInPandas(
        run, "a long, b long")


def bags_of(texts: DataFrame) -> DataFrame:
    """(v, bag): the shingle multiset of each text as a set of hashes, one per occurrence."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            bags = []
            for text in batch["text"]:
                h, n = shingler.shingles(text)
                turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # 0 for the first of its kind
                bags.append((np.repeat(h, n) + mixed(turn.astype(U))).view(np.int64))
            yield pd.DataFrame({"v": batch["v"], "bag": bags})

    return texts.select("v", "text").mapInPandas(run, "v long, bag array<long>")


def joined(common: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Which pairs of a matrix of common elements are similar enough."""
    return common >= LEAST * (wa[:, None] + wb[None] - common)


def common_elements(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``, by products of 0/1 blocks."""
    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

    (ha, ia), (hb, ib) = flat(a), flat(b)
    both = np.intersect1d(ha, hb)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    if not len(both):
        return out

    def places(h: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, h), len(both) - 1)
        ok = both[at] == h
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], i[ok][order]

    (ca, ia), (cb, ib) = places(ha, ia), places(hb, ib)
    for low in range(0, len(both), COLUMNS):
        blocks = []
        for c, i, n in ((ca, ia, len(a)), (cb, ib, len(b))):
            part = slice(*np.searchsorted(c, (low, low + COLUMNS)))
            block = np.zeros((n, min(COLUMNS, len(both) - low)), dtype=np.float32)
            block[i[part], c[part] - low] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def links_in_tiles(now: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b) that join what is similar enough among the members (key, v, c) of unsettled buckets.

    Members that buckets connect form a group, and a group is cut into tiles of at most ``TILE``
    members, fewer if their bags are large.  Two tiles meet if they share a bucket; a bag is sent
    once per pair of tiles, and all its pairs are compared in one task.  What leaves the task is
    each member with the least member that its links reach there.
    """
    low = now.groupBy("key").agg(F.min("v").alias("lo"))
    groups = components(now.join(low, "key").select(F.col("v").alias("a"), F.col("lo").alias("b")))
    sized = cut(groups.withColumnRenamed("component", "g").join(bags.select("v", "weight"), "v"))
    tiles = cut(running_total(
        sized, ["g"], ["v"], [F.floor(F.col("v") / 10_000)], {"at": 1 + F.col("weight") / 1_000},
    ).select("g", "v", F.floor(F.col("at") / TILE).alias("tile")))
    met = now.join(tiles, "v").select("key", "g", "tile").distinct()
    pairs = cut(met.select("key", "g", F.col("tile").alias("t")).join(
        met.select("key", F.col("tile").alias("u")), "key").where("t <= u").select("g", "t", "u").distinct())
    rows = tiles.join(bags, "v")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first = (group["tile"] == group["t"]).to_numpy()
        a = group[first]
        b = a if first.all() else group[~first]
        bags_a, bags_b = a["bag"].to_list(), b["bag"].to_list()
        wa, wb = a["weight"].to_numpy(), b["weight"].to_numpy()
        links = joined(common_elements(bags_a, bags_b), wa, wb)
        # The least row that links reach, among the rows of both tiles.
        va, vb = a["v"].to_numpy(), b["v"].to_numpy()
        la, lb = va.copy(), vb.copy()
        top = np.iinfo(np.int64).max
        while True:
            to_a = np.minimum(la, np.where(links, lb[None], top).min(axis=1, initial=top))
            to_b = np.minimum(lb, np.where(links, to_a[:, None], top).min(axis=0, initial=top))
            if (to_a == la).all() and (to_b == lb).all():
                break
            la, lb = to_a, to_b
        v, least = np.concatenate([va, vb]), np.concatenate([la, lb])
        return pd.DataFrame({"a": least, "b": v})[v != least]

    each = pairs.select("g", F.col("t").alias("tile"), "t", "u").unionByName(
        pairs.where("t < u").select("g", F.col("u").alias("tile"), "t", "u"))
    sides = rows.join(each, ["g", "tile"])
    return sides.select("g", "t", "u", "tile", "v", "weight", "bag").groupBy("g", "t", "u").applyInPandas(
        compare, "a long, b long").distinct()


def near_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col``, class_id, kept.

    Documents are linked if the weighted Jaccard similarity of their multisets of five-word
    shingles is at least 0.8; a text of fewer words is one shingle.  class_id is the least id
    reachable by links, and kept tells whether that is the row's own id.  Null, empty and blank
    texts link with nothing.  A null id takes part but is never least; a class of null ids alone
    has a null class_id, and its rows are kept.  Repeated rows have the same result.  Other
    columns are ignored.  An empty table gives an empty result.

    Equal texts are one vertex.  Bands bring candidates together.  Each band bucket first
    proposes links of all its members to its least vertex.  Buckets that verified links have
    joined completely are done.  The others propose links to the member that meets most others
    over all its buckets, the likely origin of a group of edited copies.  The
    members of buckets that are still not one component are compared tile by tile, and only what
    links join leaves a task.  So no candidate is left out, while groups of copies propose
    about as many pairs as members.
    """
    rows = _hashed(docs, id_col, text_col)
    of = _grouped(rows)
    tops = of.groupBy("component").agg(F.min("_least").alias("_top"))
    done = of.join(tops, "component").select("_h1", "_h2", "_top", F.lit(True).alias("_in"))
    top = F.when(F.col("_in"), F.col("_top")).otherwise(F.col("_id"))
    return rows.drop("text").join(done, ["_h1", "_h2"], "left").select(
        F.col("_id").alias(id_col), top.alias("class_id"),
        F.col("_id").eqNullSafe(top).alias("kept"))


def one_per_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each class of ``near_documents``, all columns as they were.

    A class keeps a row of its least id (null last) and, where several of its texts have that id,
    the text of least hash; of repeated rows with that id and text, one.  Unlike ids, classes tell
    apart different texts under one id and hold rows with null ids.  Rows whose text is null or
    has no words all stay.  An empty table gives an empty result.
    """
    of = _grouped(_hashed(docs, id_col, text_col))
    first = of.groupBy("component").agg(F.min(F.struct(
        F.col("_least").isNull(), F.col("_least"), F.col("_h1"), F.col("_h2"))).alias("_f")).select(
        "_f._least", "_f._h1", "_f._h2")
    least, h1, h2 = fresh(docs, "_least", "_h1", "_h2")
    first = first.withColumnsRenamed({"_least": least, "_h1": h1, "_h2": h2})
    words = word_count(F.col(text_col)) > 0
    named = docs.where(words).withColumns({
        h1: F.xxhash64(text_col), h2: F.xxhash64(F.lit(1), text_col)}).join(first, [h1, h2]).where(
        F.col(id_col).eqNullSafe(F.col(least))).dropDuplicates([h1, h2])
    return named.select(*docs.columns).unionByName(docs.where(~words))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h1"),
                       F.xxhash64(F.lit(1), text_col).alias("_h2"), F.col(text_col).alias("text"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Each different text with words: hashes, least id and component."""
    classes = cut(sign(rows.where(F.col("text").isNotNull())).where("weight > 0").groupBy(
        "_h1", "_h2").agg(F.min("_id").alias("_least"), F.first("weight").alias("weight"),
                          F.first("bands").alias("bands")))
    flat = cut(number_rows(classes.withColumn("_all", F.lit(1)), "_all", ["_h1", "_h2"], "v",
                           classes.count()).drop("_all"))
    weights = cut(flat.select("v", "weight"))
    sizes = light(weights)
    banded = flat.select("v", F.posexplode("bands").alias("i", "h")).select(
        "v", F.xxhash64("i", "h").alias("key"))
    ends = banded.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi")
    members = cut(banded.join(ends.drop("hi"), "key"))
    wanted = cut(flat.join(members.select("v").distinct(), "v").select("v", "_h1", "_h2", "_least"))
    texts = cut(rows.join(light(wanted), ["_h1", "_h2"]).where(F.col("_id").eqNullSafe(F.col("_least")))
                .groupBy("v").agg(F.first("text").alias("text")))
    fit = F.least("wa", "wb") >= LEAST * F.greatest("wa", "wb")

    def to_centre(found: DataFrame, centre: str) -> DataFrame:
        """Distinct pairs of members and their bucket's centre whose sizes are close enough."""
        pairs = found.where(F.col("v") != F.col(centre)).select(
            F.least("v", centre).alias("a"), F.greatest("v", centre).alias("b")).distinct()
        for k in "ab":
            pairs = pairs.join(sizes.select(F.col("v").alias(k), F.col("weight").alias(f"w{k}")), k)
        return pairs.where(fit).select("a", "b")

    def unsettled(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components so far, and the members of buckets with several of them."""
        found = components(linked)
        labelled = members.join(found, "v", "left").select("key", "v", F.coalesce("component", "v").alias("c"))
        mixed_ = labelled.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y")
        return found, cut(labelled.join(mixed_.select("key"), "key", "left_semi"))

    tried = cut(to_centre(members, "lo"))
    linked = cut(similar(tried, texts))
    found, now = unsettled(linked)
    if not now.isEmpty():
        full = now.groupBy("key").agg(F.count("*").alias("_n"))
        met = now.join(full, "key").groupBy("v").agg(F.sum("_n").alias("_met"))
        centres = now.join(met, "v").groupBy("key").agg(F.max_by("v", F.struct("_met", "v")).alias("centre"))
        pairs = cut(to_centre(now.join(centres, "key"), "centre").join(tried, ["a", "b"], "left_anti"))
        linked = cut(linked.unionByName(similar(pairs, texts)))
        found, now = unsettled(linked)
    if not now.isEmpty():
        bags = cut(bags_of(texts.join(now.select("v").distinct(), "v")).withColumn("weight", F.size("bag")))
        new = cut(links_in_tiles(now, bags))
        found = components(linked.unionByName(new))
    return flat.select("v", "_h1", "_h2", "_least").join(found, "v", "left").withColumn(
        "component", F.coalesce("component", "v"))
