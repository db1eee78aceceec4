"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set is its distinct word shingles. Its sketch fills ``COORDS``
bins in rounds: in each of the first ``COORDS`` rounds every shingle falls into
one hashed bin, and in each later round all shingles compete for one fixed
bin, so that no bin can stay empty. A bin keeps its smallest (round, hash), and
a document takes part only until its bins are full, which takes one or two
rounds for all but short texts. Two sets agree in a coordinate with the
probability of their Jaccard similarity.

Equal sets are one class, found by a digest, so copies never meet each other.
Classes with an equal band are candidates; ``band_shape`` sets the bands by the
threshold. Inside a bucket nobody is compared
with everybody: the member with the most bucket mates is the pivot of the
first round, which joins nearly all of a group of near copies, since they
surround their original. Later rounds take up to ``PIVOTS`` members per bucket
of those that are still apart from that pivot's component, until none is left
that was not compared with every member of another component. A member with so
many shingles of its own that no other set can be similar needs no comparison.
The work of a round is linear in the size of a bucket, and no link that two
components need is missed. Candidates are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparksync.llm.decontaminate import free_name
from sparksync.llm.graph import components
from sparksync.llm.text import WHITE, Hasher, Words, mix, seeds, signed, slices
from sparksync.session import checkpointed, drop_superseded

COORDS = 256
MAX_LOSS = 1e-4  # chance that a pair at the threshold shares no band
PIVOTS = 256
PACK = 128


def shingle_sets(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (row, hash), in order of row and hash.

    A row with fewer words than ``width`` has one shingle, of all its words.
    """
    factors = seeds(width, 99) | np.uint64(1)
    n = len(hashes)
    sums = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        sums[: n - k] += hashes[k:] * factors[k]
    left = words.first[1:][words.doc] - np.arange(n)  # words from here to the end of the row
    whole = left >= width
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    for r in short:
        at, end = words.first[r], words.first[r + 1]
        sums[at] = (hashes[at:end] * factors[: end - at]).sum() + np.uint64(end - at)
        whole[at] = True
    doc, x = words.doc[whole], mix(sums[whole])
    order = np.argsort(x)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    doc, x = doc[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], x[new]


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, coordinates of each): the longest bands that lose a pair at ``percent`` with at most MAX_LOSS."""
    fits = [r for r in range(1, COORDS + 1) if (1 - (percent / 100) ** r) ** (COORDS // r) <= MAX_LOSS]
    length = max(fits, default=1)
    return COORDS // length, length


def sketches(doc: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Sketch of each row's set; rows without elements keep the largest value."""
    empty = np.uint64(2**64 - 1)
    out = np.full(rows * COORDS, empty, np.uint64)
    salt = seeds(2 * COORDS, 7)
    for i in range(2 * COORDS):
        if not len(x):
            break
        r = mix(x ^ salt[i])
        bins = (r >> np.uint64(56)).astype(np.int64) if i < COORDS else i - COORDS
        np.minimum.at(out, doc * COORDS + bins, (r & np.uint64(2**54 - 1)) | (np.uint64(i) << np.uint64(54)))
        full = (out.reshape(rows, COORDS) != empty).all(1)
        open_rows = ~full[doc]
        doc, x = doc[open_rows], x[open_rows]
    return out.reshape(rows, COORDS)


def _class_keys(doc: np.ndarray, x: np.ndarray, rows: int) -> list[bytes | None]:
    """A 128-bit digest of each row's set, None for an empty one."""
    bounds = np.searchsorted(doc, np.arange(rows + 1))
    sums = np.zeros((2, len(x) + 1), np.uint64)
    np.cumsum(mix(x ^ np.uint64(0x5851F42D4C957F2D)), out=sums[0, 1:])
    np.cumsum(mix(x ^ np.uint64(0x14057B7EF767814F)), out=sums[1, 1:])
    keys = np.ascontiguousarray(mix(sums[:, bounds[1:]] - sums[:, bounds[:-1]]).T)
    raw = keys.tobytes()
    return [raw[16 * i : 16 * i + 16] if bounds[i] < bounds[i + 1] else None for i in range(rows)]


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_shingles, cls, bands) and the columns ``carry`` of every row; cls and bands are null for an empty set."""
    kind = docs.schema[id_col].dataType
    count, length = band_shape(percent)
    schema = f"{id_col} {kind.simpleString()}, n_shingles long, cls binary, bands array<long>"
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        salt = seeds(COORDS, 21) | np.uint64(1)
        for s in slices(batches, text_col):
            words = Words(s.data, s.offsets, WHITE)
            doc, x = shingle_sets(words, hasher.words(s.data, words), width)
            sizes = np.bincount(doc, minlength=s.n)
            terms = (mix(sketches(doc, x, s.n)) * salt)[:, : count * length]
            bands = signed(mix(terms.reshape(s.n, count, length).sum(2)))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (s.n + 1) * count, count, dtype=np.int32)), pa.array(bands.ravel()), mask=pa.array(sizes == 0)
            )
            keys = pa.array(_class_keys(doc, x, s.n), pa.binary())
            columns = [s.column(id_col), pa.array(sizes), keys, lists, *map(s.column, carry)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_shingles", "cls", "bands", *carry])

    return docs.select(id_col, text_col, *carry).mapInArrow(run, schema)


def sets_of(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(cls, shingles): the sorted set of every row as packed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for s in slices(batches, text_col):
            words = Words(s.data, s.offsets, WHITE)
            doc, x = shingle_sets(words, hasher.words(s.data, words), width)
            bounds = np.searchsorted(doc, np.arange(s.n + 1))
            sets = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            keys = _class_keys(doc, x, s.n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["cls", "shingles"])

    return docs.select(text_col).mapInArrow(run, "cls binary, shingles binary").filter("cls is not null")


def compared(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, distance) of pairs with both sets (sa, sb).

    linked is 100 * intersection >= percent * union, distance is the Jaccard distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, distance = [], []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
                distance.append(1 - common / (len(both) - common))
            columns = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked", "distance"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, linked boolean, distance double")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(cls, own): how many shingles of each class are in no other class of ``sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                keys = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(x), np.int64)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(x)], ["cls", "x"])

    spots = sets.select("cls", "shingles").mapInArrow(run, "cls binary, x long")
    single = spots.groupBy("x").agg(F.count("*").alias("n"), F.min("cls").alias("cls")).filter("n = 1")
    return single.groupBy("cls").agg(F.count("*").alias("own"))


def _enough_shared(shared, sizes, percent: int):
    """100 * shared >= percent * union, for sets of that total size; columns or arrays."""
    return shared * (100 + percent) >= sizes * percent


def _packs(rows: DataFrame, keys: list[str], sets: DataFrame, bands: DataFrame, name: str) -> DataFrame:
    """Rows of a group side by side with their sets and bands, in ``name``."""
    full = rows.join(bands, "cls").join(sets, "cls")
    return full.groupBy(*keys).agg(F.collect_list(F.struct("cls", "comp", "n", "own", "far", "bands", "shingles")).alias(name))


def _links_in_packs(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the links between members and pivots of a bucket that are in different components.

    Sizes, shingles that no other set has, and the distances to the bucket's
    first pivot rule most pairs out: Jaccard distance keeps the triangle
    inequality, so linked sets are about as far from a third. A pair is
    compared in the first band that it shares, and only links leave the task.
    """

    def fields(packed: pa.Scalar) -> dict:
        rows = packed.values
        out = {k: np.asarray(rows.field(k)) for k in ("n", "own")}
        out["far"] = np.asarray(rows.field("far").cast(pa.float64()).fill_null(float("nan")))
        out["bands"] = np.asarray(rows.field("bands").flatten()).reshape(len(rows), -1)
        out["cls"], out["comp"] = rows.field("cls").to_pylist(), rows.field("comp").to_pylist()
        out["sets"] = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("shingles")]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, group, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                m, q = fields(group), fields(asked)
                number: dict[bytes, int] = {}
                comps = [np.array([number.setdefault(c, len(number)) for c in x["comp"]]) for x in (m, q)]
                may = comps[0][:, None] != comps[1]
                shared = np.minimum((m["n"] - m["own"])[:, None], q["n"] - q["own"])
                may &= _enough_shared(shared, m["n"][:, None] + q["n"], percent)
                may &= ~(np.abs(m["far"][:, None] - q["far"]) > 1 - percent / 100 + 1e-9)
                linked = []
                for i, j in np.argwhere(may):
                    if int(np.argmax(m["bands"][i] == q["bands"][j])) != band:
                        continue
                    both = np.concatenate([m["sets"][i], q["sets"][j]])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common):
                        linked.append((m["cls"][i], q["cls"][j]))
                columns = [pa.array([x[k] for x in linked], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    joined = members.join(pivots, ["band", "key"])
    return joined.select("band", "members", "pivots").mapInArrow(run, "a binary, b binary")


def _members(classes: DataFrame) -> DataFrame:
    """(band, key, cls, n, degree) of all classes that share a bucket; degree counts the bucket mates."""
    rows = classes.select("cls", "n", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("mates")).filter("mates > 1")
    members = checkpointed(rows.join(shared, ["band", "key"]))
    degree = members.groupBy("cls").agg(F.sum("mates").alias("degree"))
    return checkpointed(members.drop("mates").join(degree, "cls"))


def _first_round(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(band, key, first) and the comparisons of every member with its bucket's first pivot."""
    chief = members.groupBy("band", "key").agg(F.max(F.struct("degree", "cls", "n")).alias("p"))
    firsts = checkpointed(chief.select("band", "key", F.col("p.cls").alias("first"), F.col("p.n").alias("n_first")))
    similar_size = F.least("n", "n_first") * 100 >= F.greatest("n", "n_first") * percent
    pairs = members.join(firsts, ["band", "key"]).filter((F.col("cls") != F.col("first")) & similar_size)
    pairs = pairs.select(F.least("cls", "first").alias("a"), F.greatest("cls", "first").alias("b")).distinct()
    full = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return firsts, checkpointed(compared(full, percent))


def _in_components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets with several components, with their own, the bucket's main one and its smallest set."""
    live = members.join(roots, members.cls == roots.node, "left").withColumn("comp", F.coalesce("root", "cls")).drop("node", "root")
    buckets = live.groupBy("band", "key").agg(
        F.max(F.struct("degree", "cls", "comp")).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least_n"), F.count("*").alias("size")
    )
    mixed = buckets.filter("lo != hi").select("band", "key", F.col("p.comp").alias("main"), "least_n", "size")
    return live.join(mixed, ["band", "key"])


def class_links(classes: DataFrame, fetch_sets, percent: int) -> DataFrame:
    """(cls, root) of the classes that are linked with another one.

    ``classes`` has cls, n and bands; ``fetch_sets`` gives (cls, shingles) for
    a table of wanted cls.
    """
    members = _members(classes)
    sets = checkpointed(fetch_sets(members.select("cls").distinct()))
    firsts, compares = _first_round(members, sets, percent)
    links = compares.filter("linked").select("a", "b")
    roots = checkpointed(components(links, "a", "b"))

    drop_superseded(classes.sparkSession)
    # What later rounds rule pairs out by: shingles of one's own, distance to the first pivot.
    members = checkpointed(_in_components(members, roots).select("band", "key", "cls", "n", "degree"))
    own = _own_shingles(sets.join(members.select("cls").distinct(), "cls", "left_semi"))
    to_first = compares.select(F.col("a").alias("cls"), F.col("b").alias("first"), F.col("distance").alias("far"))
    to_first = to_first.union(compares.select("b", "a", "distance"))
    members = members.join(own, "cls", "left").fillna(0, ["own"]).join(firsts.drop("n_first"), ["band", "key"])
    members = members.join(to_first, ["cls", "first"], "left")
    members = checkpointed(members.withColumn("far", F.when(F.col("cls") == F.col("first"), 0.0).otherwise(F.col("far"))).drop("first"))
    bands = classes.select("cls", "bands")
    to_first = own = compares = None
    done = members.select("band", "key", "cls").limit(0)
    while True:
        drop_superseded(classes.sparkSession)
        live = checkpointed(_in_components(members, roots))
        strays = live.filter("comp != main").filter(_enough_shared(F.col("n") - F.col("own"), F.col("n") + F.col("least_n"), percent))
        slot = F.pmod(F.xxhash64("cls"), F.lit(PIVOTS)).alias("slot")
        chosen = strays.join(done, ["band", "key", "cls"], "left_anti").groupBy("band", "key", slot)
        chosen = chosen.agg(F.max(F.struct("cls", "comp", "n", "own", "far")).alias("p")).select("band", "key", "p.*")
        chosen = checkpointed(chosen)
        if chosen.isEmpty():
            break
        done = checkpointed(done.union(chosen.select("band", "key", "cls")))
        pivots = _packs(chosen, ["band", "key"], sets, bands, "pivots")
        # Only members that some pivot of the bucket could be linked with fetch their sets.
        limits = chosen.groupBy("band", "key").agg(
            F.min(F.coalesce("far", F.lit(-9.0))).alias("near_p"),
            F.max(F.coalesce("far", F.lit(9.0))).alias("far_p"),
            F.max(F.col("n") - F.col("own")).alias("shared_p"),
            F.min("n").alias("n_p"),
        )
        slack = 1 - percent / 100 + 1e-9
        asked = live.join(limits, ["band", "key"]).filter(
            _enough_shared(F.least(F.col("n") - F.col("own"), F.col("shared_p")), F.col("n") + F.col("n_p"), percent)
            & F.coalesce(F.col("far").between(F.col("near_p") - slack, F.col("far_p") + slack), F.lit(True))
        )
        asked = asked.withColumn("slot", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / PACK)))
        packs = _packs(asked, ["band", "key", "slot"], sets, bands, "members")
        found = checkpointed(_links_in_packs(packs, pivots, percent))
        if not found.isEmpty():
            links = links.union(found)
            roots = checkpointed(components(links, "a", "b"))
    return roots.select(F.col("node").alias("cls"), "root")


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, cls) with ``carry`` of every row, and (cls, rep, root) of every class: smallest id, component."""
    rows = checkpointed(sketch_documents(docs, id_col, text_col, width, percent, carry))
    classes = checkpointed(
        rows.filter("cls is not null")
        .groupBy("cls")
        .agg(F.min(id_col).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    wanted_docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def fetch(wanted: DataFrame) -> DataFrame:
        reps = classes.join(wanted, "cls", "left_semi").select(F.col("rep").alias("_id")).distinct()
        null_rep = classes.filter("rep is null").limit(1)
        texts = wanted_docs.join(reps, "_id", "left_semi")
        if not null_rep.isEmpty():
            texts = texts.union(wanted_docs.filter("_id is null"))
        return sets_of(texts, "_text", width).join(wanted, "cls", "left_semi").dropDuplicates(["cls"])

    roots = class_links(classes.drop("rep"), fetch, percent)
    named = classes.select("cls", "rep").join(roots, "cls", "left")
    return rows.drop("bands"), named.withColumn("root", F.coalesce("root", "cls"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    component_id is the smallest id among the rows reached through links.
    A null or empty text, or one without words, has no shingles, links with
    nothing and is its own component. Repeated rows are copies of each other;
    rows with one id and different texts are documents of their own that share
    the id. A row without an id is never a component's name: it gets the
    component of its class if that has any id, else null, and is kept only in
    the latter case. Other columns are not read. An empty table gives no rows.
    """
    rows, named = _grouped(docs, id_col, text_col, width, percent)
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "root").select("cls", "component_id")
    out = rows.join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(
        id_col, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id_col).eqNullSafe(component), F.lit(False)).alias("kept")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of several the one with the smallest digest.

    Rows are told apart by id and text, not by the id alone, so a text of its
    own stays whatever other rows share its id. Of rows with equal id and text
    any one stays. Rows without an id come after all others, so a component of
    such rows only keeps one of them. Rows without words stay, all of them.
    """
    key = free_name(docs, "key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.coalesce(F.sha2(F.col(id_col).cast("string").cast("binary"), 256), F.lit("-"))
    keyed = docs.withColumn(key, F.sha2(F.concat(named, text).cast("binary"), 256))
    plain = keyed.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(key).alias("_key"))
    rows, classes = _grouped(plain, "_id", "_text", width, percent, ("_key",))
    own = rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_key")).alias("best"))
    best = own.join(classes.select("cls", "root"), "cls").groupBy("root").agg(F.min("best").alias("best"))
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    stays = keyed.filter(has_words).join(best.select(F.col("best._key").alias(key)), key, "left_semi").dropDuplicates([key])
    return stays.union(keyed.filter(~has_words).select(stays.columns)).select(docs.columns)
