"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. A round visits the queues in order of their names; a visit
adds the queue's quantum (its target share of a window, in 1/65536 tokens) to its deficit, sends
the deficit in whole multiples of VISIT tokens and carries the rest on, over windows and
partitions. Queues start with deficits spread evenly over one VISIT, so that equal ones do not
all send in the same rounds. The rounds' output is one stream, cut into windows of equal length:
every window but the last is full and holds each source's target share to within two VISITs
while the queues are open.

A queue has sent (r * quantum + first deficit) in whole VISITs after r rounds: nothing has to be
run in order. From a token's place in its queue follow its round and its place in the stream, so
tasks carry deficits over windows and partitions by arithmetic alone. Tokenised rows are
written once; a queue's order is (task, place in the task), and only sums for each task and
source are ever added up across tasks.

A source whose target is under a 1/MAX_QUEUES part of all has less than a token for four windows:
such sources follow one another, by name, in one queue that has the sum of their targets.

Null texts count as empty: one end token. A null source is a queue of its own. Rows with the
same doc_id are packed one by one, null doc_ids stay null. Empty tables give no pieces. Columns
beyond doc_id, text and source are ignored; without a source column all rows share one queue.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import few, file_order, give_back, local_rows, read, slices, written

SEQUENCE = 1024
#: Tokens that a visit sends, or a multiple: pieces are not cut finer than that but at ends of documents and windows.
VISIT = 64
#: Quanta are whole numbers of 1/2**QUANTUM_BITS tokens, so that rounds stay within 64 bits up to 10**14 tokens.
QUANTUM_BITS = 16
#: Sources with a lesser part than one of so many have no queue of their own: the vector of queues in every task stays small.
MAX_QUEUES = 4096
#: Cells of [round, queue] that are computed at a time.
CELLS = 1 << 20
END = 0


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


#: The pre-tokenisation that byte-level tokenizers share: a published constant.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts on which a fast coder must agree with the tokenizer before it is used.
PROBES = ("Hello  world, it's 1234!\n\n\tÉté\u00a0naïve 日本語 😀 <|endoftext|> ", " don't\r\nWE'LL ... ## x_y-z\x0b\x1f", "", " ", "\n", "a\nb \n c", "ünïcödé ﬁ ǅ \u0301e")


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _fast_coder(code):
    """A tiktoken coder of the same ids, or None where the tokenizer is not plain byte-level BPE with ids in merge order."""
    import json

    told, signs = json.loads(code.to_str()), _byte_signs()
    merges = told["model"].get("merges", [])
    vocab = told["model"].get("vocab", {})
    if told["model"].get("type") != "BPE" or (told.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or told.get("normalizer"):
        return None
    ranks = {bytes(signs[c] for c in t): i for t, i in vocab.items() if all(c in signs for c in t) and not (t.startswith("<|") and t.endswith("|>"))}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if any(vocab[a] >= vocab[b] for a, b in zip(joined, joined[1:])):
        return None
    import tiktoken

    fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    agree = all(fast.encode_ordinary(p) == code.encode(p, add_special_tokens=False).ids for p in PROBES)
    return fast if agree else None


class Coder:
    """Ids of whole texts as little-endian bytes, those of the tokenizer and then the end token.

    Where the tokenizer is plain byte-level BPE, a faster coder of the same vocabulary codes them.
    """

    def __init__(self, path: str):
        code = _tokenizer(path)
        self.fast = _fast_coder(code)
        self.type = np.dtype("<u2" if code.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = None if self.fast else code  # a worker keeps one of them

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            ids = (x.ids for x in self.code.encode_batch_fast(texts, add_special_tokens=False))
        else:
            ids = map(self.fast.encode_ordinary, texts)
        return [np.array([*x, END], dtype=self.type).tobytes() for x in ids]


@lru_cache(maxsize=1)
def _coder(path: str) -> Coder:
    coder = Coder(path)
    give_back()  # the tokenizer that it was made from
    return coder


def tokenise(docs: DataFrame, tokenizer: str) -> DataFrame:
    """part, queue, doc_id, ids (little-endian, 2 bytes each if the vocabulary allows), n, place.

    part is the task that made the row, place the number of the queue's tokens in that task
    before it. `tokenizer` is a file every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, coder = TaskContext.get().partitionId(), _coder(tokenizer)
        places: dict[str | None, int] = {}
        for batch in slices(batches):
            ids = coder(batch.column("text").to_pylist())
            counts = [len(x) // coder.type.itemsize for x in ids]
            starts = []
            for queue, n in zip(batch.column("queue").to_pylist(), counts, strict=True):
                starts.append(places.get(queue, 0))
                places[queue] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int64()), batch.column("queue"), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(starts, pa.int64())],
                names=["part", "queue", "doc_id", "ids", "n", "place"],
            )

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), source.alias("queue"))
    return rows.mapInArrow(run, "part long, queue string, doc_id long, ids binary, n long, place long")


class Rounds:
    """Where the tokens of each queue go: closed form of deficit round-robin over all rounds."""

    def __init__(self, tokens: list[int], weights: list[float], visit: int = VISIT):
        whole, n = float(sum(weights)) or 1.0, max(len(tokens), 1)
        self.visit = visit
        self.tokens = np.array(tokens, dtype=np.int64)
        self.quanta = np.array([max(1, round(SEQUENCE * w / whole * (1 << QUANTUM_BITS))) for w in weights], dtype=np.int64)
        self.first = (np.arange(len(tokens), dtype=np.int64) * visit << QUANTUM_BITS) // n

    def sent(self, rounds: np.ndarray, queue: int) -> np.ndarray:
        """Tokens that a queue has sent before each of these rounds."""
        due = (rounds * self.quanta[queue] + self.first[queue]) >> QUANTUM_BITS
        return np.minimum(due // self.visit * self.visit, self.tokens[queue])

    def before(self, rounds: np.ndarray, queue: int) -> np.ndarray:
        """Tokens that all queues have sent when a queue is visited in each of these rounds."""
        out = np.empty(len(rounds), dtype=np.int64)
        step = max(1, CELLS // len(self.tokens))
        ahead = (np.arange(len(self.tokens)) < queue).astype(np.int64)  # they have had their visit of the round
        for at in range(0, len(rounds), step):
            due = ((rounds[at : at + step, None] + ahead) * self.quanta + self.first) >> QUANTUM_BITS
            out[at : at + step] = np.minimum(due // self.visit * self.visit, self.tokens).sum(axis=1)
        return out

    def round_of(self, queue: int, token: np.ndarray) -> np.ndarray:
        """The round that sends a token of a queue."""
        due = ((token // self.visit + 1) * self.visit << QUANTUM_BITS) - self.first[queue]
        return (due + self.quanta[queue] - 1) // self.quanta[queue] - 1

    def cut(self, queue: int, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut runs of a queue's tokens where rounds or windows end: (run, first token, length, place in the stream)."""
        # the parts of a run that VISITs cut, then one piece for each round
        visits = (start + length - 1) // self.visit - start // self.visit + 1
        run = np.repeat(np.arange(len(start)), visits)
        step = np.arange(len(run)) - np.repeat(np.cumsum(visits) - visits, visits)
        rounds = self.round_of(queue, (start[run] // self.visit + step) * self.visit)
        new = np.ones(len(run), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (rounds[1:] != rounds[:-1])
        run, rounds = run[new], rounds[new]
        distinct, inverse = np.unique(rounds, return_inverse=True)
        before, after = self.sent(distinct, queue), self.sent(distinct + 1, queue)
        low = np.maximum(before[inverse], start[run])
        high = np.minimum(after[inverse], (start + length)[run])
        place = self.before(distinct, queue)[inverse] + low - before[inverse]
        # a round's tokens may cross into the next window, or several
        windows = (place + high - low - 1) // SEQUENCE - place // SEQUENCE + 1
        again = np.repeat(np.arange(len(run)), windows)
        step = np.arange(len(again)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.maximum(place[again], (place[again] // SEQUENCE + step) * SEQUENCE)
        end = np.minimum((place + high - low)[again], (place[again] // SEQUENCE + step + 1) * SEQUENCE)
        return run[again], low[again] + begin - place[again], end - begin, begin


def queues(rows: DataFrame, targets: dict[str | None, float] | None, most: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """part, queue, number (of the queue that a source is in) and queue_start for each task and source, and each number's (tokens, weight)."""
    spark = rows.sparkSession
    starts = written(file_order("part", ["queue"], rows, "n", "queue_start"), "queue_starts")
    totals = rows.groupBy("queue").agg(F.sum("n").alias("n"))
    if targets is None:
        totals = totals.withColumn("weight", F.col("n").cast("double"))
    else:
        told = local_rows(spark, told=("string", list(targets) or [None]), weight=("double", [float(w) for w in targets.values()] or [1.0]))
        least = min(targets.values(), default=1.0)
        totals = totals.join(told, F.col("queue").eqNullSafe(F.col("told")), "left").select("queue", "n", F.coalesce("weight", F.lit(float(least))).alias("weight"))
    totals = written(totals, "queue_totals")
    whole = totals.agg(F.sum("weight")).first()[0] or 1.0
    own = F.col("weight") * most >= whole
    large = sorted(totals.filter(own).collect(), key=lambda r: (r["queue"] is not None, r["queue"]))  # at most `most` rows
    small = totals.filter(~own)
    rest = small.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    numbers = local_rows(spark, source=("string", [r["queue"] for r in large]), number=("int32", range(len(large))), base=("int64", [0] * len(large)))
    # one row for each small source, not for each document
    ahead = Window.orderBy(F.col("queue").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    numbers = numbers.unionByName(small.select(F.col("queue").alias("source"), F.lit(len(large)).alias("number"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long").alias("base")))
    placed = starts.join(numbers, F.col("queue").eqNullSafe(F.col("source")))
    placed = placed.select("part", "queue", "number", (F.col("queue_start") + F.col("base")).alias("queue_start"))
    placed = few(written(placed, "queues"))
    return placed, [(r["n"], r["weight"]) for r in large] + ([tuple(rest)] if rest[0] else [])


def pack(docs: DataFrame, tokenizer: str, targets: dict[str | None, float] | None = None, with_ids: bool = True, visit: int = VISIT, max_queues: int = MAX_QUEUES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_queue, ids.

    targets: token shares by source, by default each source's share of the corpus; all rows are
    packed in any case, so a queue that runs dry early leaves its share to the others. Sources
    without a target get the smallest one. ids (little-endian, 4 bytes each) only with_ids.
    """
    rows = written(tokenise(docs, tokenizer), "tokens")
    starts, known = queues(rows, targets, max_queues)
    plan = docs.sparkSession.sparkContext.broadcast(Rounds([n for n, _ in known], [w for _, w in known], visit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        _coder.cache_clear()  # all texts are coded: the worker needs none any more
        for batch in slices(batches):
            number, counts, at = (batch.column(c).to_numpy() for c in ("number", "n", "at"))
            ids = batch.column("ids")
            for q in np.unique(number):
                mine = np.flatnonzero(number == q)
                for part in np.array_split(mine, max(1, int(counts[mine].sum()) // 4_000_000)):
                    run_, first, length, place = plan.value.cut(int(q), at[part], counts[part])
                    row = part[run_]
                    start = first - at[row]
                    sums = np.empty(len(row), dtype=np.int64)
                    pieces = []
                    last, wide = -1, b""
                    for i, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                        if r != last:
                            last, raw = r, ids[r].as_py()
                            wide = memoryview(raw if len(raw) == 4 * counts[r] else np.frombuffer(raw, dtype=np.uint16).astype("<u4").tobytes())
                        piece = wide[4 * s : 4 * (s + n)]
                        sums[i] = crc32(piece)
                        pieces.append(bytes(piece) if with_ids else None)
                    # ids of documents by row, never by numpy: one null would turn the others to floats
                    owner = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(owner), pa.array(start), pa.array(length), pa.array(sums), pa.array(counts[row]), pa.array(place // SEQUENCE), pa.array(place % SEQUENCE), batch.column("queue").take(owner), pa.array(pieces, pa.binary())],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue", "ids"],
                    )

    placed = rows.join(starts.withColumnsRenamed({"part": "part_", "queue": "queue_"}), (F.col("part") == F.col("part_")) & F.col("queue").eqNullSafe(F.col("queue_")))
    placed = placed.select("queue", "number", "doc_id", "ids", "n", (F.col("queue_start") + F.col("place")).alias("at"))
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_queue string, ids binary")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), with_ids=False).drop("ids")
