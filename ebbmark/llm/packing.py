"""Mixture-controlled packing of token queues into windows of fixed length.

Each source is a queue: its documents' ids one after another. Windows are filled by deficit round-robin:
every window gives each queue a quantum of its target proportion, and what a queue is owed after whole
tokens (its deficit) carries over to the next window. With free cuts this has a closed form: after g
tokens of the output, queue 1 has given floor(g * share_1), queue 2 that share of the rest, and so on.
These counts never fall, sum to g, and stay within a few tokens of the targets. So any task can start
at any window with the right deficits, and needs only the position of its documents in their queues:
deficits carry over partitions without anything running in sequence.

Targets are the queues' own shares of all tokens, or given weights; in that case, when a queue runs
dry, the others share its part (a new phase), and what has no weight comes after all that has. The last,
incomplete window is cut into sequences whose lengths are powers of two, so no sequence is padded.

The driver holds one total per queue. The largest sources and all that are given a weight have queues of
their own. Any further ones share 64 queues by hash. In these, whole documents take turns: each comes at
the share of its source that lies before it, so that every stretch of the queue holds its sources in
proportion, to within a document each. Which tokens meet in a sequence follows from the order in which
the partitions of the input list the documents of a source.

Nulls and edges: a null or empty text is its end id alone; a null source is the source ''; repeated
rows and repeated doc_ids are packed row by row; an empty table gives no pieces; very long texts are one
row each and are cut like others; further columns are not used.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import table
from ebbmark.llm.batches import bounded, held

OWN_QUEUES, SHARED_QUEUES, SLICES = 192, 64, 1024


class Schedule:
    """Where every token of every queue goes. Exact integers throughout."""

    def __init__(self, totals: list[int], length: int, weights: list[Fraction] | None = None):
        self.length, self.total = length, sum(totals)
        self.phases: list[tuple[int, list[int], list[int]]] = []  # first token of output, amounts, taken before
        left, taken, begin = list(totals), [0] * len(totals), 0
        while any(left):
            active = [q for q in range(len(left)) if left[q] and weights and weights[q] > 0]
            if active:
                rounds = min(Fraction(left[q]) / weights[q] for q in active)
                give = [int(weights[q] * rounds) if q in active else 0 for q in range(len(left))]
            else:
                give = list(left)
            self.phases.append((begin, give, list(taken)))
            for q, n in enumerate(give):
                left[q] -= n
                taken[q] += n
            begin += sum(give)
        self.begins = [p[0] for p in self.phases]
        full, rest = divmod(self.total, length)
        self.full = full
        self.tail = [full * length]  # ends of the last sequences: powers of two, falling
        while rest:
            part = 1 << (rest.bit_length() - 1)
            self.tail.append(self.tail[-1] + part)
            rest -= part
        self.sequences = full + len(self.tail) - 1
        self._seen: dict[int, list[int]] = {}

    def begin(self, k: int) -> int:
        """The first output token of sequence k."""
        return k * self.length if k <= self.full else self.tail[k - self.full]

    def given(self, k: int) -> list[int]:
        """Tokens that each queue has given before sequence k."""
        if k in self._seen:
            return self._seen[k]
        g = self.begin(k)
        at = max(0, bisect.bisect_right(self.begins, g) - 1)
        first, give, taken = self.phases[at]
        x, rest, out = g - first, sum(give), list(taken)
        for q, n in enumerate(give):
            if n:
                share = x * n // rest
                out[q] += share
                x -= share
                rest -= n
        if len(self._seen) > 4096:
            self._seen.clear()
        self._seen[k] = out
        return out

    def sequence_of(self, queue: int, position: int) -> int:
        """The sequence that holds this token of the queue."""
        lo, hi = 0, self.sequences  # given(lo) <= position < given(hi)
        guess = min(self.sequences - 1, self._near(queue, position))
        step = 1
        if self.given(guess)[queue] <= position:
            lo = guess
            while lo + step < hi and self.given(lo + step)[queue] <= position:
                lo, step = lo + step, step * 2
            hi = min(hi, lo + step)
        else:
            hi = guess
            while hi - step > lo and self.given(hi - step)[queue] > position:
                hi, step = hi - step, step * 2
            lo = max(lo, hi - step)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.given(mid)[queue] <= position else (lo, mid)
        return lo

    def _near(self, queue: int, position: int) -> int:
        for first, give, taken in self.phases:
            if position < taken[queue] + give[queue]:
                return (first + (position - taken[queue]) * sum(give) // max(1, give[queue])) // self.length
        return self.sequences - 1

    def pieces(self, queue: int, position: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the n tokens at this position of the queue."""
        done, k = 0, self.sequence_of(queue, position)
        while done < n:
            here, after = self.given(k), self.given(k + 1)
            take = min(position + n, after[queue]) - (position + done)
            if take > 0:
                before = sum(after[:queue]) - sum(here[:queue])
                yield done, take, k, before + position + done - here[queue]
                done += take
            k += 1


class Encoder:
    """Ids of whole texts, with a memory of up to ``limit`` words.

    For tokenizers that lower-case, cut at blanks and between letters, digits and signs, and encode each
    such word by itself (``word_bpe_49k.json`` is one), a batch is cut into words by Arrow, and only words
    not met before are encoded. Texts with other characters than those below (rare letters, marks, control
    characters, special tokens), and all texts for tokenizers of another form, are encoded whole.
    """

    #: The form that allows it: steps of the normalizer, and the pattern of a word.
    STEPS = ("NFC", "Replace", "Lowercase")
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Letters (after lower-casing) and signs of plain texts.
    LETTERS = r"a-z\x{df}-\x{f6}\x{f8}-\x{17f}"
    SIGNS = r"!-/:-@\[-`{-~\x{a1}\x{a7}\x{a9}\x{ab}\x{b0}\x{b7}\x{bb}\x{bf}\x{2010}-\x{2027}\x{20ac}"
    #: Stand for the end of a text, and for texts encoded whole; neither occurs in a plain text.
    END, WHOLE = "\x01", "\x02"

    def __init__(self, path: str, end_id: int, limit: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id, self.limit = Tokenizer.from_file(path), end_id, limit
        form = json.loads(self.tokenizer.to_str())
        steps = tuple(x["type"] for x in (form["normalizer"] or {}).get("normalizers", []))
        cuts = [x.get("pattern", {}).get("Regex") for x in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_words = steps == self.STEPS and cuts == [self.WORD, None] and form["model"]["end_of_word_suffix"] == "</w>"
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0, self.END: 1}
        self.ids = np.array([self.end_id], "<u4")
        self.begins, self.sizes = np.array([0, 0]), np.array([0, 1])  # of each known word in ids

    def _add(self, words: list[str], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.ids = np.concatenate([self.ids, *ids])
        self.begins, self.sizes = np.concatenate([self.begins, begins]), np.concatenate([self.sizes, sizes])

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 1 << 16):
            some = words[i : i + (1 << 16)]
            joined = [" ".join(some[j : j + 500]) for j in range(0, len(some), 500)]
            ids = [np.array(x.ids, "<u4") for x in self.words.encode_batch_fast(joined, add_special_tokens=False)]
            ends = np.flatnonzero(self.ends[np.concatenate(ids)]) + 1  # every word ends in one such token
            self._add(some, ids, np.diff(ends, prepend=0))

    def _cut(self, low: pa.Array) -> pa.Array:
        """Plain lower-case texts with a blank wherever a word ends."""
        out = pc.replace_substring_regex(low, r"([0-9])", r" \1 ")
        out = pc.replace_substring_regex(out, f"([{self.LETTERS}])([{self.SIGNS}])", r"\1 \2")
        out = pc.replace_substring_regex(out, f"([{self.SIGNS}])([{self.LETTERS}])", r"\1 \2")
        short = pc.match_substring_regex(low, f"'[{self.LETTERS}]")  # may be 's, 't and so on
        if pc.any(short).as_py():
            word = f"('s|'t|'re|'ve|'m|'ll|'d|[{self.LETTERS}]+|[0-9]|[{self.SIGNS}]+)"
            out = pc.replace_with_mask(out, short, pc.replace_substring_regex(low.filter(short), word, r"\1 "))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, the end id after each, and the count of each text's ids."""
        if len(self.known) > self.limit:
            self._forget()
        texts = texts.fill_null("")
        low = pc.utf8_lower(texts)
        odd = pc.match_substring_regex(low, f"[^ \\t\\n\\r0-9{self.LETTERS}{self.SIGNS}]|<\\|") if self.by_words else pa.array([True] * len(texts), pa.bool_())
        # capitals whose small form is plain, but by rules that differ between libraries
        odd = pc.or_(odd, pc.match_substring_regex(texts, r"[\x{130}\x{1e9e}\x{212a}\x{212b}]"))
        whole = texts.filter(odd)
        marks = pa.array([f"{self.WHOLE}{i}" for i in range(len(whole))], pa.string())
        cut = pc.replace_with_mask(self._cut(pc.if_else(odd, "", low)), odd, marks)
        cut = pc.ascii_split_whitespace(pc.binary_join_element_wise(cut, self.END, " "))
        kinds = cut.flatten().dictionary_encode()
        words = kinds.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.known and w[0] != self.WHOLE])
        memory = len(self.sizes), len(self.ids)
        if len(whole):
            ids = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(whole.to_pylist(), add_special_tokens=False)]
            self._add(marks.to_pylist(), ids, np.array([len(x) for x in ids]))
        slots = np.array([self.known[w] for w in words], np.int64)[kinds.indices.to_numpy()]
        sizes = self.sizes[slots]
        after = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(after[-1]) + np.repeat(self.begins[slots] - after[:-1], sizes)
        out = self.ids[take], np.diff(after[cut.offsets.to_numpy() - cut.offsets[0].as_py()])
        if len(whole):
            for m in marks.to_pylist():
                del self.known[m]
            self.begins, self.sizes, self.ids = self.begins[: memory[0]], self.sizes[: memory[0]], self.ids[: memory[1]]
        return out


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, doc_id, source, before, n, ids): ids as little-endian unsigned 32-bit integers; before
    counts the tokens of the same source that come earlier in the same partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, doc_id {kind}, source string, before long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), {}
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            ids, sizes = held(Encoder, tokenizer, end_id).encode(col["text"])
            before, sources = [], [s or "" for s in col["source"].to_pylist()]
            for s, n in zip(sources, sizes.tolist()):
                before.append(sums.get(s, 0))
                sums[s] = before[-1] + n
            ends = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            arrays = [pa.array([part] * len(sizes), pa.int32()), col["doc_id"], pa.array(sources, pa.string()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), data]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "source", "before", "n", "ids"])

    return docs.select("doc_id", "text", "source").mapInArrow(run, schema)


def _positions(stored: DataFrame, sums: DataFrame, parts: DataFrame, own: list[str], shared: int) -> DataFrame:
    """stored with the queue of each document and the position of its first token in it."""
    number = F.element_at(F.create_map(*(x for i, s in enumerate(own) for x in (F.lit(s), F.lit(i)))), F.col("source")) if own else F.lit(None).cast("int")
    place = parts.withColumn("at", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).drop("n")
    place = table(place.join(sums, "source").withColumn("queue", number), "places")
    kept = ["doc_id", "source", "part", "before", "n", "ids"]
    mine = stored.join(place.filter("queue is not null"), ["source", "part"]).select(*kept, "queue", (F.col("at") + F.col("before")).alias("position"))
    rest = place.filter("queue is null")
    if rest.isEmpty():
        return mine
    # other sources: the share of its source that comes before a document is its time; a shared queue runs by time
    tail = stored.join(rest.drop("queue"), ["source", "part"])
    jitter = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)
    time = (F.col("at") + F.col("before") + jitter * F.col("n")) / F.col("total")
    queue = (len(own) + F.pmod(F.xxhash64("source"), F.lit(shared))).cast("int")
    timed = tail.select(*kept, queue.alias("queue"), time.alias("time"), F.floor(time * SLICES).alias("slice"))
    timed = table(timed, "timed")
    slices = timed.groupBy("queue", "slice").agg(F.sum("n").alias("size"))
    begins = slices.select("queue", "slice", (F.sum("size").over(Window.partitionBy("queue").orderBy("slice")) - F.col("size")).alias("begin"))
    order = Window.partitionBy("queue", "slice").orderBy("time", "source", "part", "before")
    inside = timed.drop("ids", "doc_id").withColumn("inside", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    spots = inside.join(begins, ["queue", "slice"]).select("source", "part", "before", (F.col("begin") + F.col("inside")).alias("position"))
    return mine.unionByName(timed.drop("time", "slice").join(spots, ["source", "part", "before"]).select(*kept, "queue", "position"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, weights: dict[str, float] | None = None, own_queues: int = OWN_QUEUES) -> DataFrame:
    """Pieces of docs(doc_id, text, source) packed into sequences of ``length`` tokens.

    (doc_id, source, start, length, doc_tokens, sequence_id, offset, sequence_length, ids), ids as
    little-endian unsigned 32-bit integers. A sequence is the ids of its pieces by offset.
    """
    bounded(docs.sparkSession, rows=2000, mb=8)
    stored = table(_tokenized(docs, tokenizer, end_id), "tokens")
    parts = table(stored.groupBy("source", "part").agg(F.sum("n").alias("n")), "parts")
    sums = table(parts.groupBy("source").agg(F.sum("n").alias("total")), "sums")
    largest = [r["source"] for r in sums.orderBy(F.desc("total"), "source").limit(own_queues).collect()]
    own = sorted({*largest, *(weights or {})})
    placed = _positions(stored, sums, parts, own, SHARED_QUEUES)
    totals = {r["queue"]: r["total"] for r in placed.groupBy("queue").agg(F.sum("n").alias("total")).collect()}
    counts = [totals.get(q, 0) for q in range(len(own) + SHARED_QUEUES)]
    shares = None
    if weights is not None:
        shares = [Fraction(weights.get(s, 0)).limit_denominator(10**6) for s in own] + [Fraction(0)] * SHARED_QUEUES
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"]
    schema = f"doc_id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(counts, length, shares)
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            row, rest, ids = [], [], []
            for i, (q, at, x) in enumerate(zip(col["queue"].to_pylist(), col["position"].to_pylist(), col["ids"])):
                data = x.as_py()
                n = len(data) // 4
                for start, size, k, offset in plan.pieces(q, at, n):
                    row.append(i)
                    rest.append((start, size, n, k, offset, plan.begin(k + 1) - plan.begin(k)))
                    ids.append(data[4 * start : 4 * (start + size)])
            take = pa.array(row, pa.int32())
            numbers = np.array(rest, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([col["doc_id"].take(take), col["source"].take(take), *(pa.array(x, pa.int64()) for x in numbers), pa.array(ids, pa.binary())], names)

    return placed.select("doc_id", "source", "queue", "position", "ids").mapInArrow(cut, schema)
