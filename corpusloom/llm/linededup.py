"""Line dedup: an edit-distance join of lines by segments and substrings.

Two lines are near equal if one edit for each CHARS_PER_EDIT characters of the shorter one, and
at most THRESHOLD edits, make them the same; lines of fewer characters must be equal. A line is
cut into as many segments as edits are allowed, plus one; a line within the threshold must hold
one of them unchanged, near its place. The line probes the segments of all lengths from its own
down to threshold less, at the few places that the multi-match-aware bounds leave. Lines that
meet on a segment are verified by a banded bit-parallel edit distance, many pairs at a time.

Only hashes are aggregated: line counts by two 64-bit hashes, segments by one 64-bit key with
the least and greatest line of each, so a hot line or segment is combined before it is shuffled.
The texts of lines are fetched again for those that met another line. What more than BLOCK lines
share is dealt out in pairs of blocks, and each task reports a spanning forest of its links, so
a hot segment neither meets in one task nor yields all pairs.

Of each class of linked lines the first (by doc_id, then place) stays; others are removed,
whatever a document loses. Callers may have proved near copies of a document that stays passed
whole (`spare`), for a stage that removes documents.

Lines are split at line feeds; blank lines are no lines and stay. Null texts have no lines. Rows
equal in doc_id and text are one document. Empty tables give empty results. Extra columns are
kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.common import SPACE, few, mark, read, slices, written
from corpusloom.llm.components import components
from corpusloom.llm.nearcopies import SIMILAR, jaccard, shingle_set
from corpusloom.llm.simhash import forest

THRESHOLD, CHARS_PER_EDIT = 2, 12
#: Shortest line that is compared by edits.
LEAST = CHARS_PER_EDIT
#: Of documents that lose more than this share, `spare` asks whether they are near copies.
HEAVY = 0.5
BLOCK = 2048
#: Pairs and cells of one verification.
PAIRS, CELLS = 8192, 1 << 21
#: Buckets of the character counts that rule pairs out before verification.
SIGNS = 32
#: Characters whose substrings are hashed together, and line hashes a task keeps so as not to repeat their keys.
CHUNK, SEEN = 1 << 20, 200_000
_BLANK = " \t\n\x0b\x0c\r"


def allowed(length, threshold: int = THRESHOLD):
    """The edits that a pair of lines may be apart, by the length of the shorter one."""
    return np.minimum(threshold, np.asarray(length) // CHARS_PER_EDIT)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of the threshold + 1 segments of a line: as even as can be, longer ones last."""
    n = threshold + 1
    short, longer = length // n, length % n
    sizes = [short] * (n - longer) + [short + 1] * longer
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def places(length: int, threshold: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """What a line of this length files and what it probes: (key seed, start, stop) of its substrings."""
    own = [(length * 64 + i, a, a + n) for i, (a, n) in enumerate(segments(length, int(allowed(length, threshold))))]
    probes = []
    for other in range(max(LEAST, length - threshold), length + 1):
        shift, most = length - other, int(allowed(other, threshold))
        if shift > most:
            continue
        for i, (a, n) in enumerate(segments(other, most)):
            low = max(a - i, a + shift - (most - i), 0)
            high = min(a + i, a + shift + (most - i), length - n)
            probes += [(other * 64 + i, p, p + n) for p in range(low, high + 1) if shift or p != a]
    return own, probes


#: Odd multipliers of the substring hash. Two texts with one hash only cost a comparison.
_BASE, _MIX = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    up, down = (np.full(CHUNK + 1, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    codes *= np.uint64(_MIX)
    return codes ^ (codes >> np.uint64(29))


def _finished(sums: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    out = sums * np.uint64(_MIX) + seeds.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(32)
    out *= np.uint64(_BASE)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def _long_line(line: str, plan: np.ndarray) -> np.ndarray:
    """Keys of a line longer than CHUNK, piece by piece; equal to those of prefix sums."""
    up, _ = _powers()
    sums = np.zeros(len(plan), dtype=np.uint64)
    for i, (_, a, b) in enumerate(plan.tolist()):
        scale = np.ones(1, dtype=np.uint64)
        for at in range(a, b, CHUNK):
            part = _mixed(line[at : min(b, at + CHUNK)])
            sums[i : i + 1] += scale * (part * up[: len(part)]).sum(dtype=np.uint64)
            scale *= up[CHUNK]
    return _finished(sums, plan[:, 0])


class Keys:
    """Keys of the substrings that lines file and probe, by prefix sums over many lines at once."""

    def __init__(self, threshold: int = THRESHOLD):
        self.plan = lru_cache(maxsize=4096)(lambda length: self._plan(length, threshold))

    @staticmethod
    def _plan(length: int, threshold: int) -> tuple[np.ndarray, int]:
        own, probes = places(length, threshold)
        return np.array(own + probes, dtype=np.int64), len(own)

    def __call__(self, lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key, number of the line, whether the line files it) of all substrings of the lines."""
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            stop, size = at + 1, len(lines[order[at]])
            if size > CHUNK:
                plan, n = self.plan(size)
                yield _long_line(lines[order[at]], plan), np.full(len(plan), order[at]), np.arange(len(plan)) < n
                at = stop
                continue
            while stop < len(order) and size + len(lines[order[stop]]) <= CHUNK:
                size += len(lines[order[stop]])
                stop += 1
            yield self._together(lines, np.array(order[at:stop]))
            at = stop

    def _together(self, lines: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, down = _powers()
        text = "".join([lines[i] for i in rows])
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(_mixed(text) * up[: len(text)], out=sums[1:])
        lengths = np.array([len(lines[i]) for i in rows])
        starts = np.cumsum(lengths) - lengths
        keys, owners, filed = [], [], []
        sizes, firsts = np.unique(lengths, return_index=True)
        for length, first, stop in zip(sizes.tolist(), firsts.tolist(), [*firsts.tolist()[1:], len(rows)], strict=True):
            mine = np.arange(first, stop)
            plan, n = self.plan(length)
            a, b = starts[mine][:, None] + plan[None, :, 1], starts[mine][:, None] + plan[None, :, 2]
            keys.append(_finished((sums[b] - sums[a]) * down[a], plan[:, 0]).ravel())
            owners.append(np.repeat(rows[mine], len(plan)))
            filed.append(np.tile(np.arange(len(plan)) < n, len(mine)))
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(filed)


def within(a: list[str], b: list[str], threshold: int) -> np.ndarray:
    """Whether the edit distance of each pair of lines is at most the threshold.

    Bit-parallel over a band of 2 * threshold + 1 diagonals, for all pairs at once. Lines must be
    at least threshold + 1 long and differ in length by at most the threshold.
    """
    out = np.zeros(len(a), dtype=bool)
    m, n = (np.array([len(s) for s in x], dtype=np.int64) for x in (a, b))
    order = np.argsort(np.maximum(m, n), kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * (max(m[order[stop]], n[order[stop]]) + 1) <= CELLS:
            stop += 1
        rows = order[at:stop]
        out[rows] = _band([a[i] for i in rows], [b[i] for i in rows], m[rows], n[rows], threshold)
        at = stop
    return out


def _matrix(texts: list[str], before: int, after: int, fill: int) -> np.ndarray:
    width = max(map(len, texts))
    out = np.full((len(texts), before + width + after), fill, dtype=np.uint32)
    for row, text in enumerate(texts):
        out[row, before : before + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out.T.copy()


def _band(a: list[str], b: list[str], m: np.ndarray, n: np.ndarray, t: int) -> np.ndarray:
    # cells outside a line match nothing
    x, y = _matrix(a, t, 3 * t + 2, 0xFFFFFFFF), _matrix(b, 0, 1, 0xFFFFFFFE)
    one, top = np.uint64(1), np.uint64(63)
    out = np.zeros(len(a), dtype=bool)
    live = np.arange(len(a))
    vp = np.full(len(a), np.uint64((1 << 64) - (1 << (63 - t))), dtype=np.uint64)
    vn = np.zeros(len(a), dtype=np.uint64)
    score = np.full(len(a), t, dtype=np.int64)
    for j in range(int(n.max())):
        match = np.zeros(len(live), dtype=np.uint64)
        column = y[j]
        for d in range(2 * t + 1):
            row = j + 2 * t - d  # line index j + t - d, behind t cells of padding
            if row < len(x):
                match |= (x[row] == column).astype(np.uint64) << np.uint64(63 - d)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        diagonal = j < m - t
        mask = one << np.clip(62 - (j - (m - t)), 0, 63).astype(np.uint64)
        flat = ((hp & mask) != 0).astype(np.int64) - ((hn & mask) != 0)
        score += np.where(diagonal, 1 - (d0 >> top).astype(np.int64), np.where(j < n, flat, 0))
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
        if j % 32 == 31:
            keep = (score <= 2 * t + n - m) & (j < n) | (j >= n - 1) & (score <= t)
            if not keep.all():
                x, y, m, n, vp, vn, score, live = x[:, keep], y[:, keep], m[keep], n[keep], vp[keep], vn[keep], score[keep], live[keep]
                if not len(live):
                    return out
    out[live] = score <= t
    return out


def _sign(text: str) -> np.ndarray:
    """Counts of characters by bucket, at most 255 each: one edit changes two of them by one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.minimum(np.bincount(codes * np.uint32(2654435761) >> np.uint32(27), minlength=SIGNS), 255).astype(np.int16)


class Verifier:
    """Collects candidate pairs over many groups and reports trees of the links found."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        self.numbers: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], None] = {}
        self.texts: dict[int, str] = {}

    def near(self, i: list[str], j: list[str]) -> np.ndarray:
        """Whether each pair of lines is within the edits allowed to the shorter one."""
        most = allowed([min(len(x), len(y)) for x, y in zip(i, j, strict=True)], self.threshold)
        out = np.zeros(len(i), dtype=bool)
        for t in np.unique(most):
            some = np.flatnonzero(most == t)
            out[some] = within([i[k] for k in some], [j[k] for k in some], int(t))
        return out

    def group(self, ids: list[tuple[int, int]], own: list[bool], block: list[int], texts: list[str], blocks: tuple[int, int]) -> Iterator[np.ndarray]:
        """One group of lines, each with its two hashes, that share a segment; of two blocks, only pairs across them."""
        n, t = len(ids), self.threshold
        lengths = np.array([len(s) for s in texts])
        signs = np.stack([_sign(s) for s in texts])
        filed, blocks_of, both = np.array(own), np.array(block), np.array(ids, dtype=np.int64)
        most, number = allowed(lengths, t), np.arange(n)
        left, right = [], []
        step = max(1, (1 << 22) // (n * SIGNS))
        for at in range(0, n, step):
            rows = np.arange(at, min(n, at + step))
            edits = np.minimum(most[rows][:, None], most[None, :])
            near = np.abs(signs[rows][:, None, :] - signs[None, :, :]).sum(axis=2) <= 2 * edits
            near &= np.abs(lengths[rows][:, None] - lengths[None, :]) <= edits
            near &= (filed[rows][:, None] | filed[None, :]) & (number[rows][:, None] < number[None, :])
            if blocks[0] != blocks[1]:
                near &= blocks_of[rows][:, None] != blocks_of[None, :]
            i, j = np.nonzero(near)
            left.append(rows[i])
            right.append(j)
        left, right = np.concatenate(left), np.concatenate(right)
        if len(left) > 4 * n:
            found = []
            for at in range(0, len(left), PAIRS):
                i, j = left[at : at + PAIRS], right[at : at + PAIRS]
                ok = self.near([texts[k] for k in i], [texts[k] for k in j])
                found.append((i[ok], j[ok]))
            yield self._tree(both, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            return
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            x, y = (self.numbers.setdefault(ids[k], len(self.numbers)) for k in (i, j))
            self.pairs[min(x, y), max(x, y)] = None
            self.texts[x], self.texts[y] = texts[i], texts[j]
        if len(self.pairs) >= PAIRS:
            yield self.flush()

    def flush(self) -> np.ndarray:
        if not self.pairs:
            return np.zeros((0, 4), dtype=np.int64)
        pairs = np.array(list(self.pairs), dtype=np.int64)
        ok = self.near([self.texts[i] for i, _ in self.pairs], [self.texts[j] for _, j in self.pairs])
        tree = self._tree(np.array(list(self.numbers), dtype=np.int64), pairs[ok, 0], pairs[ok, 1])
        self.numbers, self.pairs, self.texts = {}, {}, {}
        return tree

    @staticmethod
    def _tree(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Trees of the links between rows of ids, as rows of both ends' hashes."""
        label = forest(a, b, len(ids))
        linked = np.flatnonzero(label != np.arange(len(ids)))
        return np.concatenate([ids[label[linked]], ids[linked]], axis=1)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, document, place, line, id, id2 (two hashes of the line) of every line that is not blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(docs).alias("document"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = rows.filter(F.col("line").rlike(f"[^{SPACE}]"))
    return rows.select("*", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))


def _key(docs: DataFrame) -> Column:
    """16 bytes for a doc_id and its text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), F.coalesce("text", F.lit("")))))


def line_links(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """id, id2, to, to2: links whose trees are the classes of different lines of docs that are near equal."""

    def keys(only=None):
        """The substrings' keys of the lines of docs; of keys in `only` (a broadcast of sorted ones), if given."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from xxhash import xxh64_intdigest

            cut, seen = Keys(threshold), set()
            for batch in slices(batches):
                ids, lines = [], []
                for text in batch.column("text").to_pylist():
                    for line in text.split("\n") if text else ():
                        if len(line) >= LEAST and line.strip(_BLANK):
                            number = xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                            if number not in seen:
                                seen.add(number)
                                ids.append(number)
                                lines.append(line)
                if len(seen) > SEEN:
                    seen = set()
                owners = np.array(ids, dtype=np.uint64).view(np.int64)
                for key, owner, filed in cut(lines):
                    if only is not None:
                        known = only.value
                        some = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), dtype=bool)
                        key, owner, filed = key[some], owner[some], filed[some]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owners[owner]), pa.array(filed)], names=["key", "id", "own"])
            _powers.cache_clear()  # the worker lives on

        return docs.select("text").mapInArrow(run, "key long, id long, own boolean")

    # longs only: hot segments are combined in the tasks that read them
    met = keys().groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.col("own").cast("int")).alias("filed"), F.count("*").alias("n"))
    met = written(met.filter("low <> high and filed = 1").select(F.col("key").alias("met"), "n"), "met_keys")
    if met.count() <= common.BROADCAST_ROWS:
        found = keys(docs.sparkSession.sparkContext.broadcast(np.sort(met.select("met").toPandas()["met"].to_numpy(dtype=np.int64))))
    else:
        found = keys().join(met, F.col("key") == F.col("met"), "left_semi")
    found = written(found.groupBy("key", "id").agg(F.max(F.col("own").cast("int")).alias("own")), "candidates")
    met = few(met)
    # two lines with one first hash both come along: what they are is told by both hashes and the text
    ids = few(written(found.select(F.col("id").alias("sought")).distinct(), "met_ids"))
    texts = _lines(docs).filter(F.length("line") >= LEAST).select("id", "id2", "line")
    texts = texts.join(ids, F.col("id") == F.col("sought"), "left_semi").groupBy("id", "id2").agg(F.any_value("line").alias("line"))
    cuts = F.ceil(F.col("n") / block).cast("int")
    dealt = found.join(met, F.col("key") == F.col("met")).select("key", "id", "own", cuts.alias("cuts"), F.pmod(F.xxhash64("id"), cuts).cast("int").alias("block"))
    dealt = dealt.select("key", "id", "own", "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "id", "own", "block")
    texts = dealt.join(written(texts, "met_lines"), "id").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier, now, rows_ = Verifier(threshold), None, []

        def told(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(4)], names=["id", "id2", "to", "to2"])

        def end() -> Iterator[pa.RecordBatch]:
            if len(rows_) > 1:
                ids, ids2, own, blocks, lines = zip(*rows_, strict=True)
                for found in verifier.group(list(zip(ids, ids2, strict=True)), [x == 1 for x in own], list(blocks), list(lines), now[1:]):
                    yield told(found)

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("key", "b1", "b2", "id", "id2", "own", "block", "line")]
            for key, b1, b2, *row in zip(*columns, strict=True):
                if (key, b1, b2) != now:
                    yield from end()
                    now, rows_ = (key, b1, b2), []
                rows_.append(row)
        yield from end()
        yield told(verifier.flush())

    return texts.select("key", "b1", "b2", "id", "id2", "own", "block", "line").mapInArrow(verify, "id long, id2 long, to long, to2 long")


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """id, id2, root, root2 of each line that is repeated or near another one; the lines of a class have one root."""
    began = mark(docs.sparkSession)
    counts = _lines(docs).groupBy("id", "id2").agg(F.count("*").alias("n"))
    again = written(counts.filter("n > 1").select("id", "id2"), "repeated")
    found = written(line_links(docs, threshold, block), "line_links")
    # components take one long for a node: linked lines are numbered
    nodes = found.select("id", "id2").union(found.select("to", "to2")).distinct()
    nodes = written(nodes.select("*", F.monotonically_increasing_id().alias("node")), "linked_lines")
    ends = nodes.select(F.col("id").alias("to"), F.col("id2").alias("to2"), F.col("node").alias("b"))
    edges = found.join(nodes, ["id", "id2"]).join(ends, ["to", "to2"]).select(F.col("node").alias("a"), "b")
    roots = components(edges)
    named = nodes.select(F.col("id").alias("root"), F.col("id2").alias("root2"), F.col("node").alias("top"))
    linked = nodes.join(roots.withColumnRenamed("root", "top"), "node").join(named, "top").select("id", "id2", "root", "root2")
    alone = again.join(linked, ["id", "id2"], "left_anti").select("id", "id2", F.col("id").alias("root"), F.col("id2").alias("root2"))
    return written(linked.unionByName(alone), "line_classes", began)


def removals(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """document (its key), removed array<int> (places of lines), lost (characters), kept_in array<long> (doc_ids), spots (place, size and keeper's document and place of each line)."""
    began = mark(docs.sparkSession)
    classes = few(line_classes(docs, threshold, block))
    met = _lines(docs).select("doc_id", "document", "place", F.length("line").alias("size"), "id", "id2").join(classes, ["id", "id2"])
    met = written(met.select("doc_id", "document", "place", "size", "root", "root2"), "class_lines")
    # partial minima: a hot class is one row for each task
    keepers = few(written(met.groupBy("root", "root2").agg(F.min(F.struct("doc_id", "document", "place")).alias("keeper")), "keepers"))
    found = met.join(keepers, ["root", "root2"]).filter(~((F.col("document") == F.col("keeper.document")) & (F.col("place") == F.col("keeper.place"))))
    spots = F.struct("place", "size", F.col("keeper.document").alias("keeper"), F.col("keeper.place").alias("keeper_place"))
    each = found.groupBy("document").agg(F.collect_set(spots).alias("spots"), F.array_sort(F.collect_set("keeper.doc_id")).alias("kept_in"))
    each = each.select("document", F.array_sort(F.col("spots.place")).alias("removed"), F.aggregate("spots.size", F.lit(0).cast("long"), lambda a, x: a + x).alias("lost"), "kept_in", "spots")
    return written(each, "removals", began)


def near_copies(docs: DataFrame, gone: DataFrame, heavy_share: float = HEAVY) -> DataFrame:
    """document, repeats (places of lines repeated within it) of near copies of documents that stay.

    Of documents that would lose over heavy_share, each is compared with the document that keeps most
    of what it would lose, both as they leave this stage; the other must lose less itself.
    """
    sizes = F.aggregate(F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    wholes = docs.select(_key(docs).alias("document"), "text", sizes.alias("whole"))
    heavy = wholes.join(gone, "document").filter(F.col("lost") > heavy_share * F.col("whole")).select("document", "text", "spots")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, again, left = [], [], []
            for text, spots in zip(batch.column("text").to_pylist(), batch.column("spots").to_pylist(), strict=True):
                held, seen, repeats = {}, set(), set()
                for spot in sorted(spots, key=lambda p: p["place"]):
                    line_class = spot["keeper"], spot["keeper_place"]
                    held[spot["keeper"]] = held.get(spot["keeper"], 0) + spot["size"]
                    # the first of a class that another document keeps stands here for the document
                    if line_class in seen:
                        repeats.add(spot["place"])
                    seen.add(line_class)
                best.append(min(held, key=lambda k: (-held[k], k)))
                again.append(sorted(repeats))
                left.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in repeats))
            yield pa.RecordBatch.from_arrays([batch.column("document"), pa.array(best, pa.binary()), pa.array(again, pa.list_(pa.int32())), pa.array(left, pa.string())], names=["document", "best", "repeats", "own"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sides = zip(batch.column("own").to_pylist(), batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True)
            good = []
            for own, text, removed in sides:
                out = set(removed or ())
                kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
                good.append(jaccard(shingle_set(own), shingle_set(kept)) >= SIMILAR)
            yield batch.select(["document", "repeats"]).filter(pa.array(good, pa.bool_()))

    judged = heavy.mapInArrow(judge, "document binary, best binary, repeats array<int>, own string").filter("best <> document")
    judged = written(judged.dropDuplicates(["document"]), "heavy")
    others = judged.select(F.col("best").alias("document")).distinct().join(judged.select("document"), "document", "left_anti")
    others = wholes.join(others, "document").join(gone.select("document", "removed"), "document", "left").groupBy("document").agg(F.any_value("text").alias("text"), F.any_value("removed").alias("removed"))
    met = judged.join(written(others, "originals").withColumnRenamed("document", "best"), "best")
    return written(met.select("document", "repeats", "own", "text", "removed").mapInArrow(alike, "document binary, repeats array<int>"), "near_copies")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, told: str = "_lines", spare: bool = False) -> DataFrame:
    """docs with the text cleaned, and a struct (named by told, which replaces a column of that name) of n_lines, duplicates, kept_in and cut (whether lines were removed).

    With spare, proved near copies of a document that stays lose only what is repeated within them.
    """
    began = mark(docs.sparkSession)
    gone = removals(docs, threshold, block)
    if spare:
        copies = near_copies(docs, gone).withColumnRenamed("document", "_copy")
        gone = gone.join(copies, F.col("document") == F.col("_copy"), "left").withColumn("out", F.coalesce("repeats", "removed"))
        gone = written(gone.drop("_copy", "repeats", "spots"), "removals", began)
    else:
        gone = gone.withColumn("out", F.col("removed"))
    # few removed lines, as a rule: the texts stay where they are
    few = (gone.agg(F.sum(F.size("removed"))).first()[0] or 0) <= common.BROADCAST_ROWS
    gone = gone.select(F.col("document").alias("_ld_document"), F.struct("removed", "kept_in", "out").alias("_ld_gone"))
    sizes = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    measured = docs.withColumns({"_ld_document": _key(docs), "_ld_n": F.coalesce(sizes, F.lit(0))})
    joined = measured.join(F.broadcast(gone) if few else gone, "_ld_document", "left")
    cut = F.coalesce(F.size("_ld_gone.out") > 0, F.lit(False))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_ld_gone.out", i)), "\n")
    struct = F.struct(
        F.col("_ld_n").cast("long").alias("n_lines"),
        F.coalesce("_ld_gone.removed", F.array().cast("array<int>")).alias("duplicates"),
        F.coalesce("_ld_gone.kept_in", F.array().cast("array<long>")).alias("kept_in"),
        cut.alias("cut"),
    )
    return joined.select(*(F.when(cut, left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != told), struct.alias(told))


def cleaned(docs: DataFrame, spare: bool = False) -> DataFrame:
    """docs with cleaned texts and nothing else changed but n_chars, where that column holds their lengths."""
    # columns that the operator names itself step aside
    aside = {c: f"_ld_kept{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = dedup_lines(docs.withColumnsRenamed(aside), spare=spare)
    out = []
    for c in docs.columns:
        own = F.col(aside.get(c, c))
        if c == "n_chars":
            own = F.when(F.col("_lines.cut"), F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return found.select(*out)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, which of them are removed as duplicates, and the documents that keep them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select(
        "doc_id",
        F.col("_lines.n_lines").alias("n_lines"),
        F.size("_lines.duplicates").cast("long").alias("n_dup_lines"),
        F.col("_lines.cut").alias("cleaned"),
        F.array_join(F.col("_lines.duplicates").cast("array<string>"), ",").alias("dup_lines"),
        F.array_join(F.col("_lines.kept_in").cast("array<string>"), ",").alias("kept_in"),
    )
