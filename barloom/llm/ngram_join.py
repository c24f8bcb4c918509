"""Near-duplicate texts by word shingles: an exact Jaccard join through prefix trees.

Shingle sets are put in one global order, rarest shingle first. The order needs document counts, which
come from the key exchange of ``chunks`` as orders of magnitude, so that of two shingles that thousands of
documents share the rarer still stands first; shingles of one document only never match, so they are
counted but not kept, and a document that shares too few is out at once. Two sets above the threshold
share a shingle of both prefixes. Candidates of a shingle meet in prefix trees:

1. Equal sets are one class, named after its smallest document.
2. The smallest class of each prefix shingle is a pivot. Its set walks the tree of the sets that meet
   it. One pair per class and pivot links most groups of copies without expanding them.
3. A shingle whose classes are all connected by now can add nothing. Where several components meet,
   every set is compared with those of the other components, in blocks and once for all shingles that
   a block's sets share, so that no link is lost.

Large groups are cut into blocks of bounded size; none is collected whole and no pairs are emitted but
links. Hashes have 64 bits; for two sets to be judged wrongly, shingles of these two must collide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import blob_to_table, chunked, magnitudes, range_bits, release, shared_keys, shared_of, short
from .components import components
from .scanning import batches_by_size, encoded, scan_words, sequence_hashes, word_bytes

SHINGLE = 5
PERCENT = 75
BLOCK = 512
PAIRS_PER_TASK = 2048
#: Sets that share a token from which on they are found by a product of matrices.
WIDE = 64
#: The bytes that part words, space and tab to carriage return.
SEPARATORS = (0x20, *range(0x09, 0x0E))
_SETS = "doc_id long, n_shingles long, set_id binary, tokens binary"
_EDGES = "a long, b long"


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a shorter text, that of all its words."""
    sets: list[np.ndarray] = []
    is_word = word_bytes(SEPARATORS)
    for i, j in batches_by_size(texts):
        words = scan_words(texts[i:j], is_word)
        whole = sequence_hashes(words.hashes, size)
        for n, at in zip(words.counts.tolist(), words.offsets.tolist(), strict=False):
            if n >= size:
                sets.append(np.unique(whole[at : at + n - size + 1]))
            else:
                sets.append(sequence_hashes(words.hashes[at : at + n], n)[: min(n, 1)])
    return sets


def needed(n, percent: int = PERCENT):
    """The least overlap that a set of ``n`` must have with a linked set."""
    return -(-percent * n // 100)


def linked(overlap, n, m, percent: int = PERCENT):
    return 100 * overlap >= percent * (n + m - overlap)


class Tree:
    """Ordered sets as a prefix tree, kept as sorted rows and the depth that each shares with the row before."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.members, self.sets, self.sizes = order, [sets[k] for k in order], [sizes[k] for k in order]
        self.least = min(sizes, default=0)
        self.shared = [0]
        for x, y in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            self.shared.append(int(differ[0]) if len(differ) else n)

    def walk(self, tokens: np.ndarray, size: int, wanted=None, percent: int = PERCENT):
        """Members linked with the set. Overlaps of a shared path are counted once; a subtree ends where
        its overlap and the set's remaining length cannot reach the threshold with the smallest member."""
        least = -(-percent * (self.least + size) // (100 + percent))
        path, pruned = np.zeros(1, np.int64), None
        for k, member in enumerate(self.members):
            depth = self.shared[k]
            if pruned is not None and depth >= pruned:
                continue
            depth = min(depth, len(path) - 1)
            rest = self.sets[k][depth:]
            at = np.searchsorted(tokens, rest)
            hits = tokens[np.minimum(at, len(tokens) - 1)] == rest if len(tokens) else np.zeros(len(rest), bool)
            overlap = path[depth] + np.cumsum(hits)
            path, pruned = np.concatenate((path[: depth + 1], overlap)), None
            short_of = np.flatnonzero(overlap + (len(tokens) - at - hits) < least)
            if len(short_of):
                pruned = depth + int(short_of[0]) + 1
            elif (wanted is None or wanted(member)) and linked(int(path[-1]), size, self.sizes[k], percent):
                yield member


def document_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Checkpointed ``doc_id, n_shingles, set_id, tokens``, one row per document.

    ``set_id`` stands for the set and is null where no link is possible; ``tokens`` are the shared
    shingles in global order, on the smallest document of equal sets of a chunk.
    """
    chunks = chunked(docs, "text")
    bits = range_bits(chunks, 7)

    def keys_of(table: pa.Table):
        sets = shingle_sets(encoded(table.column("text")), size)
        return np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)

    def sets_of(group: pa.Table) -> pa.Table:
        kinds, buckets, blobs = (group.column(k).to_pylist() for k in ("kind", "bucket", "payload"))
        table = blob_to_table(blobs[kinds.index(0)])
        answers = [k for k, kind in enumerate(kinds) if kind]
        shared, counts = shared_of([buckets[k] for k in answers], [blobs[k] for k in answers])
        ids = table.column("doc_id").to_pylist()
        rows, seen = [], {}
        for doc, found in zip(ids, shingle_sets(encoded(table.column("text")), size), strict=True):
            n, set_id, tokens = len(found), None, None
            if n and doc is not None and len(shared):
                keys = short(found, bits)
                at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
                held = shared[at] == keys
                if held.sum() >= needed(n, percent):
                    set_id = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    if set_id not in seen or doc < rows[seen[set_id]][0]:
                        frequency = counts[at[held]].astype(np.uint64) << np.uint64(56)
                        tokens = np.sort(frequency | (found[held] >> np.uint64(8))).tobytes()
                        if set_id in seen:
                            rows[seen[set_id]][3] = None
                        seen[set_id] = len(rows)
            rows.append([doc, n, set_id, tokens])
        doc_ids, sizes, set_ids, tokens = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table(
            [pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(set_ids, pa.binary()), pa.array(tokens, pa.binary())],
            names=["doc_id", "n_shingles", "set_id", "tokens"],
        )

    payloads = chunks.select(F.lit(0).alias("kind"), "chunk", F.lit(-1).alias("bucket"), "payload")
    shared = shared_keys(chunks, keys_of, bits, told=magnitudes).select(F.lit(1).alias("kind"), "chunk", "bucket", "payload")
    return payloads.unionByName(shared).groupBy("chunk").applyInArrow(sets_of, _SETS).checkpoint()


def _rows(table: pa.Table) -> list[dict]:
    rows = table.to_pylist()
    for row in rows:
        row["tokens"] = np.frombuffer(row["tokens"], np.uint64)
    return rows


def _by(rows: list[dict], *names: str) -> dict[tuple, list[dict]]:
    groups: dict[tuple, list[dict]] = {}
    for row in rows:
        groups.setdefault(tuple(row[n] for n in names), []).append(row)
    return groups


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def prefixes(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``token, cls``: the prefix shingles of each class that others share."""

    def emit(batches):
        for batch in batches:
            tokens, classes = [], []
            for row in _rows(pa.Table.from_batches([batch])):
                own = row["n_shingles"] - len(row["tokens"])
                take = row["n_shingles"] - needed(row["n_shingles"], percent) + 1 - own
                tokens.append(row["tokens"][: max(0, take)].view(np.int64))
                classes.append(np.full(len(tokens[-1]), row["cls"], np.int64))
            if tokens:
                yield pa.record_batch([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(classes))], names=["token", "cls"])

    return reps.mapInArrow(emit, "token long, cls long")


def meetings(prefix: DataFrame) -> DataFrame:
    """``token, cls, pivot`` of the shingles that several classes have; the pivot is their smallest class."""
    pivots = prefix.groupBy("token").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last"))
    return prefix.join(pivots.filter("pivot < last").drop("last"), "token")


def pivot_links(reps: DataFrame, met: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links of classes with the smallest class of a prefix shingle that they share."""
    pairs = met.filter("cls <> pivot").select("pivot", "cls").distinct().checkpoint()
    tasks = max(1, pairs.count() // PAIRS_PER_TASK)
    parts = pairs.groupBy("pivot").agg(F.count("*").alias("n")).select("pivot", F.ceil(F.col("n") / BLOCK).alias("parts"))
    member = pairs.join(parts, "pivot").select("pivot", "cls", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"))
    query = parts.select("pivot", F.col("pivot").alias("cls"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    meeting = member.unionByName(query).join(reps, "cls").withColumn("task", F.pmod(F.xxhash64("pivot", "part"), F.lit(tasks)))

    def verify(group: pa.Table) -> pa.Table:
        pairs = []
        for (pivot, _), rows in _by(_rows(group), "pivot", "part").items():
            members = [r for r in rows if r["cls"] != pivot]
            tree = Tree([r["tokens"] for r in members], [r["n_shingles"] for r in members])
            for query in (r for r in rows if r["cls"] == pivot):
                pairs += [(pivot, members[k]["cls"]) for k in tree.walk(query["tokens"], query["n_shingles"], percent=percent)]
        return _edges(pairs)

    return meeting.groupBy("task").applyInArrow(verify, _EDGES)


def links_apart(sets: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, block: np.ndarray, both: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Places of linked sets of different components whose blocks add up to ``both``, as a spanning forest of the components.

    Only sets that share a prefix token and are of sizes that can reach the threshold are compared. A set that is not of the
    commonest component meets all its candidates at once, over their tokens' numbers, so no pairs are walked one by one.
    """
    component, kept = component.copy(), np.fromiter(map(len, sets), np.int64, len(sets))
    own = sizes - kept
    take = np.clip(sizes - needed(sizes, percent) + 1 - own, 0, kept)
    of_token, where = np.unique(np.concatenate([s[:k] for s, k in zip(sets, take, strict=True)]), return_inverse=True)
    order, holder = np.argsort(where, kind="stable"), np.repeat(np.arange(len(sets)), take)
    if not len(order):
        return []
    holder, counts = holder[order], np.bincount(where, minlength=len(of_token))
    starts = np.cumsum(counts) - counts
    apart = np.minimum.reduceat(component[holder], starts) < np.maximum.reduceat(component[holder], starts)
    near = np.zeros((len(sets), len(sets)), bool)
    for i, n in zip(starts[apart & (counts < WIDE)], counts[apart & (counts < WIDE)], strict=True):
        near[np.ix_(holder[i : i + n], holder[i : i + n])] = True
    wide = np.flatnonzero(apart & (counts >= WIDE))
    for k in range(0, len(wide), 1024):
        holds = np.zeros((len(sets), len(wide[k : k + 1024])), np.float32)
        for column, t in enumerate(wide[k : k + 1024]):
            holds[holder[starts[t] : starts[t] + counts[t]], column] = 1
        near |= holds @ holds.T > 0
    # the tokens that nobody else has count against a set whatever its partner
    reach = (100 + percent) * kept - percent * sizes
    near &= (block[:, None] + block == both) & (percent * sizes[:, None] <= reach) & (percent * sizes <= reach[:, None])
    names, size_of = np.unique(component, return_counts=True)
    main = component == names[np.argmax(size_of)]
    near[main] = False
    near &= main | np.triu(np.ones(near.shape, bool), 1)
    vocabulary, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(kept)
    found, mark = [], np.zeros(len(vocabulary), np.int32)
    for x in np.flatnonzero(near.any(axis=1)):
        others = np.flatnonzero(near[x] & (component != component[x]))
        if not len(others):
            continue
        mine = numbers[ends[x] - kept[x] : ends[x]]
        mark[mine] = 1
        if 4 * len(others) < len(sets):
            overlap = np.add.reduceat(mark[np.concatenate([numbers[ends[y] - kept[y] : ends[y]] for y in others])], np.cumsum(kept[others]) - kept[others])
        else:
            overlap = np.add.reduceat(mark[numbers], ends - kept)[others]
        mark[mine] = 0
        met = others[linked(overlap.astype(np.int64), sizes[x], sizes[others], percent)]
        reached, firsts = np.unique(component[met], return_index=True)
        found += [(int(x), int(y)) for y in met[firsts]]
        component[np.isin(component, reached)] = component[x]
    return found


def remaining_links(reps: DataFrame, met: DataFrame, connected: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between the components that still meet in a prefix shingle.

    Shingles with the same classes are taken once. The classes of those where the same components meet are a family, which
    goes to one place, so that a pair of classes is compared there once, however many shingles it shares. A family with a
    shingle beyond ``BLOCK`` classes is dealt out by pairs of blocks of its classes, one of too many classes by its shingles.
    """
    known = met.join(connected, F.col("cls") == F.col("node"), "left").select("token", "cls", F.coalesce("component", "cls").alias("component"))
    groups = known.groupBy("token").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("cls")).alias("who"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("and_who"),
    )
    # blocks by powers of four, so that shingles of about as many classes are of one family
    blocks = F.pow(F.lit(4.0), F.ceil(F.greatest(F.lit(0.0), F.log(4.0, F.col("n") / BLOCK)))).cast("long")
    once = groups.filter("least < most").groupBy("n", "who", "and_who", "least", "most").agg(F.min("token").alias("token"))
    family = ["least", "most", "blocks"]
    once = once.select("token", "least", "most", blocks.alias("blocks")).checkpoint()
    meeting = known.join(once, "token").checkpoint()
    held = 2 / (F.col("blocks") + 1) / PAIRS_PER_TASK
    salts = F.when(F.approx_count_distinct("cls") * held <= 1, 1).otherwise(F.ceil(F.count("*") * held)).alias("salts")
    place = F.pmod(F.xxhash64(*family, F.pmod(F.xxhash64("token"), F.col("salts"))), F.lit(1 << 40)).alias("place")
    # a family's shingles meet here, its classes nowhere before they are dealt out
    places = once.join(meeting.groupBy(*family).agg(salts), family).select("token", place, "blocks")
    classes = meeting.select("token", "cls", "component").join(places, "token").drop("token").distinct()
    own = classes.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("place", "cls", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).checkpoint()
    tasks = max(1, dealt.count() // PAIRS_PER_TASK)
    sent = dealt.withColumn("task", F.pmod(F.xxhash64("place", "i", "j"), F.lit(tasks))).join(reps, "cls")

    def verify(group: pa.Table) -> pa.Table:
        place, i, j, cls, component, own, sizes = (group.column(c).to_numpy() for c in ("place", "i", "j", "cls", "component", "own", "n_shingles"))
        sets = [np.frombuffer(t.as_py(), np.uint64) for t in group.column("tokens")]
        order = np.lexsort((cls, j, i, place))
        new = (np.diff(place[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
        pairs = []
        for at in np.split(order, np.flatnonzero(new) + 1):
            found = links_apart([sets[k] for k in at], sizes[at], component[at], own[at], i[at[0]] + j[at[0]], percent)
            pairs += [(int(cls[at[x]]), int(cls[at[y]])) for x, y in found]
        return _edges(pairs)

    return sent.groupBy("task").applyInArrow(verify, _EDGES)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per document.

    Words are runs of bytes that are no space, tab or line break, A-Z lower-cased. A document's set has its
    distinct five-word shingles; with fewer words, the whole sequence as one; without words or with null
    text it is empty and linked with nothing. Documents link when 100 * intersection >= ``percent`` *
    union. The component is the smallest id that links reach. Rows with one id are one document of
    several sets. A null id links with nothing and has a null component. Only the id and the text of
    ``docs`` are read, so other columns may have any name. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = document_sets(docs, percent=percent)
    release(docs.sparkSession)
    classes = sets.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("cls"))
    held = sets.filter("tokens is not null").join(classes, "set_id").filter("doc_id = cls")
    reps = held.select("cls", "n_shingles", "tokens").checkpoint()
    met = meetings(prefixes(reps, percent)).checkpoint()
    first = pivot_links(reps, met, percent).checkpoint()
    connected = components(first)
    second = remaining_links(reps, met, connected, percent)
    members = sets.filter("set_id is not null").select("doc_id", "n_shingles", "set_id").join(classes, "set_id")
    several = members.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b").select("a", "b")
    final = components(first.unionByName(second).unionByName(several))
    placed = members.join(final, F.col("cls") == F.col("node"), "left")
    alone = sets.filter("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return alone.unionByName(placed.select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents of ``docs`` that name their component, all columns kept; null ids stay."""
    found = jaccard_components(docs, id_col, text_col, percent)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct().checkpoint()
    del found
    release(docs.sparkSession)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
