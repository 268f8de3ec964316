"""Language-model scoring with Elias-Fano n-gram tries.

Model: a bigram model with Dirichlet smoothing.  p(w | u) = (c(u w) + MU p1(w)) / (c(u) + MU) with
p1(w) = (c(w) - 1/2) / N for known words; unknown words share V / (2 N).  The text starts after a begin mark and
ends with an end token.

Layout: a trie shard holds a range of predicted words w and, under each, the
words u seen before it (a reversed trie, so that all counts of w and of the
pairs (u, w) meet in one place).  Levels: the sorted words, pointers to their
ranges of predecessors (Elias-Fano), and the predecessors as numbers local to
the shard, written as a monotone sequence by adding each range's base
(Elias-Fano); a pair is looked up by a successor search of base + local
number within the range its word's pointers give.  Probabilities lie beside the levels, quantised:
numerators of pairs in 8 bits, of words in 16.  The levels are files, mapped
into memory; a shard's files live as long as its task.

Scoring: a task cuts its texts into chunks of about ``CHUNK`` tokens and
sends, per shard, the chunk's distinct pairs with the documents they occur in
and how often.  The shard counts the training occurrences, builds its trie,
answers every pair and returns sums by document; a last grouping by chunk adds
them up.  Words and pairs that hold more than a 1/2048th of all tokens are
known by exact counts to all shards: a heavy word's pairs are dealt by both
words, a heavy pair's documents by chunk and document as well.  The number of
shards follows the number of tokens.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit as tk
from tidemark.llm.eliasfano import EliasFano
from tidemark.llm.frames import cut

MU = 16.0
DISCOUNT = 0.5
CHUNK = 800_000
CHUNK_DOCS = 32_000
SHARD_TOKENS = 1_600_000
HEAVY = 2048
SHARD_TASKS = 10_000  # tasks the shards are dealt to, in equal numbers
WAYS = 16  # a heavy pair's documents of one chunk go to at most so many shards
END, BEGIN = np.uint64(0x454E44), np.uint64(0x424547)  # a word's hash is mixed, so these two are nobody's
_PAIR_STEP = 24.0  # 8 bits: log10 of numerators from -2 in steps of 1/24
_WORD_STEP = 4096.0  # 16 bits: log10 from -14 in steps of 1/4096


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(carried columns, tokens, previous tokens, document of every token, train flags, lengths) of runs of documents.

    Batches have columns text, learn, then whatever is carried.
    """
    held: list[tuple] = []
    size = docs = 0
    for b in batches:
        raw, off = tk.buffers(b.column(0))
        for i, j, buf, o in tk.sliced(raw, off):
            for k in range(i, j, CHUNK_DOCS // 2):
                m = min(j, k + CHUNK_DOCS // 2)
                sub = o[k - i:m - i + 1]
                w = tk.Words(buf[sub[0]:sub[-1]], sub - sub[0], tk.SPACED)
                h, n = w.hashes(), w.counts()
                if held and (size + len(h) > CHUNK or docs + m - k > CHUNK_DOCS):
                    yield _merge(held)
                    held, size, docs = [], 0, 0
                held.append((b.slice(k, m - k).select(range(1, b.num_columns)), h, n))
                size, docs = size + len(h), docs + m - k
    if held:
        yield _merge(held)


def _merge(held: list[tuple]):
    rows = pa.Table.from_batches([x[0] for x in held]).combine_chunks()
    h, n = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
    total = n + 1
    ends = np.cumsum(total) - 1
    tokens = np.full(len(h) + len(n), END, np.uint64)
    stay = np.ones(len(tokens), bool)
    stay[ends] = False
    tokens[stay] = h
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = BEGIN
    doc = np.repeat(np.arange(len(n), dtype=np.int32), total)
    learn = rows.column(0).to_numpy(zero_copy_only=False).astype(bool)
    return rows, tokens, before, doc, learn, total


class _Corpus:
    """What every task knows: heavy words and pairs with their exact counts, the sizes of the training set, the shards."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, ways: np.ndarray,
                 tokens: int, docs: int, shards: int):
        """words: ascending; pairs: ascending codes, the word's place * (words + 1) + the previous word's (last: begin)."""
        self.words, self.counts = words, counts
        self.pairs, self.pair_counts, self.ways = pairs, pair_counts, ways
        self.tokens, self.docs, self.shards = tokens, docs, shards

    def heavy(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it heavy, its place) of every word."""
        return _places(self.words, w)

    def heavy_pair(self, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it heavy, its place) of every pair of a word and the one before it."""
        return _places(self.pairs, _pair_codes(self.words, w, u))

    def shard(self, w: np.ndarray, u: np.ndarray, doc: np.ndarray, chunk: int) -> np.ndarray:
        hot, _ = self.heavy(w)
        key = np.where(hot, tk.mix64(w ^ tk.mix64(u)), w)
        if len(self.pairs):
            hot, place = self.heavy_pair(w, u)
            salt = np.uint64(chunk) * np.uint64(WAYS) + (doc[hot] % self.ways[place[hot]]).astype(np.uint64)
            key[hot] ^= tk.mix64(salt)
        return (tk.mix64(key) % np.uint64(self.shards)).astype(np.int64)


def _places(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it there, its place) of every value in an ascending array."""
    if not len(known):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked, at


def _pair_codes(words: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """place of w * (words + 1) + place of u (begin: the last); -1 where either is not among ``words``."""
    (there, i), (before, j) = _places(words, w), _places(words, u)
    begin = u == BEGIN
    return np.where(there & (before | begin), i * (len(words) + 1) + np.where(begin, len(words), j), -1)


def _survey(docs: DataFrame) -> _Corpus:
    """Heavy words and pairs, exactly counted, and the size of the training set; two scans, bounded results.

    A chunk names the words and the pairs that hold more than 1/(2 HEAVY) of its tokens.  One that holds 1/HEAVY of
    all tokens has at least half of them in chunks that name it, so the named counts of at most 2 HEAVY words and as
    many pairs can reach 1/(2 HEAVY): only those come to the driver.  Both words of a named pair are named, too.
    """

    def name(batches):
        for _, tokens, before, doc, learn, _ in _chunks(batches):
            least = len(tokens) / (2 * HEAVY)
            w, c = np.unique(tokens, return_counts=True)
            w, c = w[c > least], c[c > least]
            codes = _pair_codes(w, tokens, before)
            pair, pc = np.unique(codes[codes >= 0], return_counts=True)
            pair, pc = pair[pc > least], pc[pc > least]
            ends = np.append(w, BEGIN).view(np.int64)
            on = learn[doc]
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(np.repeat([0, 1, 2], [1, len(w), len(pair)])),
                "w": pa.array(np.concatenate([[0], ends[:-1], ends[pair // (len(w) + 1)]])),
                "u": pa.array(np.concatenate([np.zeros(1 + len(w), np.int64), ends[pair % (len(w) + 1)]])),
                "n": pa.array(np.concatenate([[len(tokens)], c, pc])),
                "t": pa.array(np.append([on.sum()], np.zeros(len(w) + len(pair), np.int64))),
                "d": pa.array(np.append([learn.sum()], np.zeros(len(w) + len(pair), np.int64)))})

    named = cut(docs.select("text", "learn").mapInArrow(name, "k long, w long, u long, n long, t long, d long")
                .groupBy("k", "w", "u").agg(*[F.sum(c).alias(c) for c in "ntd"]))
    sums = named.where("k = 0").select("n", "t", "d").collect()
    total, n, d = (int(x) for x in sums[0]) if sums else (0, 0, 0)
    rows = named.where((F.col("k") > 0) & (F.col("n") > total / (2 * HEAVY))).select("k", "w", "u", "n").collect()
    words = np.sort(np.array([r["w"] for r in rows if r["k"] == 1], np.int64).view(np.uint64))
    two = [(r["w"], r["u"], r["n"]) for r in rows if r["k"] == 2]
    w, u, c = (np.array([r[i] for r in two], np.int64) for i in range(3))
    pairs = _pair_codes(words, w.view(np.uint64), u.view(np.uint64))
    order = np.argsort(pairs)
    pairs, ways = pairs[order], np.minimum(1 + 64 * c[order] // max(total, 1), WAYS)

    def count(batches):
        one, both = np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)
        for _, tokens, before, doc, learn, _ in _chunks(batches):
            on = learn[doc]
            for out, known, asked in ((one, words, tokens[on]), (both, pairs, _pair_codes(words, tokens[on], before[on]))):
                there, at = _places(known, asked)
                out += np.bincount(at[there], minlength=len(known))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(words) + len(pairs))), "n": pa.array(np.append(one, both))})

    exact = {r["i"]: r["n"] for r in docs.select("text", "learn").mapInArrow(count, "i long, n long").groupBy("i").agg(
        F.sum("n").alias("n")).collect()} if len(words) else {}
    counts = np.array([exact.get(i, 0) for i in range(len(words) + len(pairs))], np.int64)
    return _Corpus(words, counts[:len(words)], pairs, counts[len(words):], ways, n, d, max(1, -(-total // SHARD_TOKENS)))


_SENT = T.StructType([T.StructField("shard", T.LongType()), T.StructField("chunk", T.LongType()),
                      T.StructField("head", T.BooleanType()), *[T.StructField(c, T.BinaryType()) for c in "wpder"]])


def _send(docs: DataFrame, corpus: _Corpus) -> DataFrame:
    """Rows (shard, chunk): the chunk's pairs of the shard, and one head row a chunk with its documents.

    w: the words and how many pairs each has; p: the previous word of every pair, sorted within a word; d: the number
    of documents of every pair; e: these documents, twice the number plus 1 if it is learned from; r: places in e where
    the pair occurs more than once in the document, then how often.
    """

    def run(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        for rows, tokens, before, doc, learn, total in _chunks(batches):
            shard = corpus.shard(tokens, before, doc, base + k)
            order = np.argsort(before, kind="stable")
            order = order[np.argsort(tokens[order], kind="stable")]
            order = order[np.argsort(shard[order].astype(np.uint16 if corpus.shards < 65536 else np.int64), kind="stable")]
            s, t, u = shard[order], tokens[order], before[order]
            flag = (2 * doc + learn[doc])[order].astype(np.uint16)
            first = np.ones(len(s), bool)  # of the pair in the shard; documents ascend within it
            first[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1]) | (s[1:] != s[:-1])
            once = first.copy()
            once[1:] |= flag[1:] != flag[:-1]
            here = np.flatnonzero(once)
            times = np.diff(np.append(here, len(s))).astype(np.uint32)
            at = np.flatnonzero(first[here])
            flag, size = flag[here], np.diff(np.append(at, len(here))).astype(np.uint32)
            pairs_t, pairs_u, pair_s = t[here][at], u[here][at], s[here][at]
            new_word = np.ones(len(at), bool)
            new_word[1:] = (pairs_t[1:] != pairs_t[:-1]) | (pair_s[1:] != pair_s[:-1])
            cuts = np.searchsorted(pair_s, np.arange(corpus.shards + 1))
            out = {c: [] for c in ("shard", "chunk", "head", "w", "p", "d", "e", "r")}

            def put(*values, out=out):
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)

            for i in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[i], cuts[i + 1]
                lo, hi = at[a], at[b] if b < len(at) else len(here)
                more = np.flatnonzero(times[lo:hi] > 1).astype(np.uint32)
                heads = np.flatnonzero(new_word[a:b])
                words = np.concatenate([pairs_t[a:b][heads], np.diff(np.append(heads, b - a)).astype(np.uint64)])
                put(int(i), base + k, False, words.tobytes(), pairs_u[a:b].tobytes(),
                    size[a:b].astype(np.uint8 if size[a:b].max() < 256 else np.uint32).tobytes(), flag[lo:hi].tobytes(),
                    np.concatenate([more, times[lo:hi][more]]).tobytes())
            sink = pa.BufferOutputStream()
            carried = rows.append_column("_n", pa.array(total.astype(np.int64)))
            with pa.ipc.new_stream(sink, carried.schema) as writer:
                writer.write_table(carried)
            home = int(tk.mix64(np.array([base + k], np.uint64))[0] % np.uint64(corpus.shards))
            put(home, base + k, True, sink.getvalue().to_pybytes(), b"", b"", b"", b"")
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW_SENT)
            k += 1

    return docs.mapInArrow(run, _SENT)


_ARROW_SENT = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("head", pa.bool_()),
                         *[(c, pa.binary()) for c in "wpder"]])


class Trie:
    """One shard: words with their predecessors, quantised log10 numerators; levels are memory-mapped files."""

    def __init__(self, words: np.ndarray, word_count: np.ndarray, word: np.ndarray, prev: np.ndarray, count: np.ndarray,
                 total: int, mu: float, folder: str):
        """word: place in ``words`` of every pair, ascending; prev: its predecessor, ascending within a word."""
        self.words, self.mu = words, mu
        self.locals = np.unique(prev)
        local = np.searchsorted(self.locals, prev)
        ptr = np.searchsorted(word, np.arange(len(words) + 1))
        last = np.zeros(len(words), np.int64)
        some = ptr[1:] > ptr[:-1]
        last[some] = local[ptr[1:][some] - 1] + 1
        base = np.cumsum(last) - last
        self.pointers = EliasFano(ptr, folder, "pointers")
        self.level = EliasFano(base[word] + local, folder, "pairs")
        p1 = np.where(word_count > 0, (word_count - DISCOUNT) / max(total, 1), 0)
        self.known = word_count > 0
        with np.errstate(divide="ignore"):
            q1 = np.round((np.log10(p1) + 14) * _WORD_STEP)
        self.q1 = self._file(np.where(self.known, q1, 0).clip(0, 65535).astype(np.uint16), folder, "p1")
        smooth = mu * 10 ** self.word_log10(word)
        q2 = np.round((np.log10(count + smooth) + 2) * _PAIR_STEP).clip(0, 255)
        self.q2 = self._file(q2.astype(np.uint8), folder, "p2")

    @staticmethod
    def _file(a: np.ndarray, folder: str, name: str) -> np.ndarray:
        path = f"{folder}/{name}"
        a.tofile(path)
        return np.memmap(path, a.dtype, "r") if len(a) else a

    def word_log10(self, i: np.ndarray) -> np.ndarray:
        """Quantised log10 p1 of the i-th word; 0 for a word not learned (its share is added by the caller)."""
        return np.where(self.known[i], np.asarray(self.q1[i]) / _WORD_STEP - 14, 0.0)

    def pair_log10(self, i: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """log10 of the smoothed numerator of (prev, i-th word): quantised if the pair was seen, else MU p1."""
        out = np.log10(self.mu) + self.word_log10(i)
        if not self.level.n or not len(i):
            return out
        w, inv = np.unique(i, return_inverse=True)
        b, e = self.pointers.get(w), self.pointers.get(w + 1)
        base = np.zeros(len(w), np.int64)
        base[b > 0] = self.level.get(b[b > 0] - 1) + 1
        at = np.minimum(np.searchsorted(self.locals, prev), len(self.locals) - 1)
        ask = np.flatnonzero((self.locals[at] == prev) & (e > b)[inv])
        x = base[inv[ask]] + at[ask]
        pos = self.level.successor(x)
        ok = pos < e[inv[ask]]
        ask, x, pos = ask[ok], x[ok], pos[ok]
        ok = self.level.get(pos) == x
        out[ask[ok]] = self.q2[pos[ok]] / _PAIR_STEP - 2
        return out


_PART = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("head", T.BooleanType()),
                      T.StructField("vocabulary", T.LongType()), T.StructField("data", T.BinaryType())])
_SUMS = (("doc", "<u2"), ("known", "<u4"), ("base", "<f8"), ("model", "<f4"))


def _pack_sums(columns: dict[str, np.ndarray]) -> bytes:
    """The columns one after the other, compressed; read back by ``_unpack_sums``."""
    raw = b"".join(columns[c].astype(t).tobytes() for c, t in _SUMS)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack_sums(data: bytes) -> dict[str, np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n, at, out = size // sum(np.dtype(t).itemsize for _, t in _SUMS), 0, {}
    for c, t in _SUMS:
        out[c] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def _times(n: int, more: np.ndarray) -> np.ndarray:
    """Occurrences of a pair in each of its ``n`` documents: 1 but where ``more`` (places, then counts) says otherwise."""
    out = np.ones(n, np.int64)
    out[more[:len(more) // 2]] = more[len(more) // 2:]
    return out


def _answer(sent: DataFrame, corpus: _Corpus, mu: float) -> DataFrame:
    """Per shard and chunk, sums by document: known tokens, log10(c + 1/2) of all, log10 p without unknown words' share.

    Shards go to tasks by their number, not by its hash, so every task has as many as the next one.
    """

    def run(batches):
        held, now = [], None
        for b in batches:
            for shard, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "chunk", "head", *"wpder")), strict=True):
                if held and shard != now:
                    yield one(held)
                    held = []
                now = shard
                held.append(row)
        if held:
            yield one(held)

    def one(rows: list) -> pa.RecordBatch:
        out = {"chunk": [], "head": [], "vocabulary": [], "data": []}
        parts = []
        for chunk, head, w, p, d, e, r in rows:
            if head:
                out["chunk"].append(chunk), out["head"].append(True), out["vocabulary"].append(0), out["data"].append(w)
                continue
            half = np.frombuffer(w, np.uint64)
            prev = np.frombuffer(p, np.uint64)
            n = len(half) // 2
            word = np.repeat(half[:n], half[n:].astype(np.int64))
            size = np.frombuffer(d, np.uint8 if len(d) == len(prev) else np.uint32).astype(np.int64)
            flag = np.frombuffer(e, np.uint16)
            parts.append((chunk, word, prev, size, flag, np.frombuffer(r, np.uint32)))
        if parts:
            word, prev = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
            seen = np.concatenate([np.add.reduceat((flag & 1) * _times(len(flag), more), np.cumsum(size) - size)
                                   for _, _, _, size, flag, more in parts])
            words, at = np.unique(word, return_inverse=True)
            hot, place = corpus.heavy(words)
            count = np.bincount(at, seen, len(words)).astype(np.int64)
            if hot.any():
                count[hot] = corpus.counts[place[hot]]
            hot_pair, pair = corpus.heavy_pair(word, prev)  # its other documents are in other shards
            if hot_pair.any():
                hot_pair[hot_pair] = corpus.pair_counts[pair[hot_pair]] > 0
            on = np.flatnonzero((seen > 0) | hot_pair)
            order = np.argsort(prev[on], kind="stable")
            order = on[order[np.argsort(at[on][order], kind="stable")]]
            a, u, c = at[order], prev[order], seen[order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (u[1:] != u[:-1])
            total = np.add.reduceat(c, np.flatnonzero(first)) if len(c) else c
            exact = hot_pair[order][first]
            total[exact] = corpus.pair_counts[pair[order][first][exact]]
            folder = tempfile.mkdtemp(prefix="trie-")
            try:
                trie = Trie(words, count, a[first], u[first], total, corpus.tokens, mu, folder)
                context = np.where(words == END, 0.0, np.log10(count + mu))
                begin = 0
                for chunk, _, pv, size, flag, more in parts:
                    i = at[begin:begin + len(pv)]
                    begin += len(pv)
                    value = trie.pair_log10(i, pv) - context[i]
                    doc = (flag >> 1).astype(np.int64)
                    n = int(doc.max()) + 1
                    i, value, times = np.repeat(i, size), np.repeat(value, size), _times(len(flag), more)
                    known = np.bincount(doc, (count[i] > 0) * times, n)
                    base = np.bincount(doc, np.log10(count[i] + 0.5) * times, n)
                    model = np.bincount(doc, value * times, n)
                    some = np.unique(doc)
                    out["chunk"].append(chunk), out["head"].append(False), out["vocabulary"].append(0)
                    out["data"].append(_pack_sums({"doc": some, "known": known[some], "base": base[some], "model": model[some]}))
                del trie
            finally:
                shutil.rmtree(folder, ignore_errors=True)
            out["chunk"].append(-1), out["head"].append(False), out["data"].append(b"")
            out["vocabulary"].append(int((count[~hot] > 0).sum()))
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("chunk", pa.int64()), ("head", pa.bool_()),
                                                                 ("vocabulary", pa.int64()), ("data", pa.binary())]))

    tasks = min(corpus.shards, SHARD_TASKS)
    dealt = sent.repartitionById(tasks, (F.col("shard") % tasks).cast("int"))
    return dealt.sortWithinPartitions("shard").mapInArrow(run, _PART)


def score_corpus(docs: DataFrame, learn: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 mu: float = MU) -> DataFrame:
    """``keep`` columns, learned, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows where ``learn`` is true.  Null texts are empty (one end token).  Repeated rows are
    learned from and scored each.  A very long text is worked on whole, by one task.  Columns of ``docs`` may have
    any names.  Nothing to learn from: n_known 0, and both scores give every token the
    probability of the one unknown type, 1.  Empty table: no rows.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"),
                       *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    corpus = _survey(rows)
    parts = cut(_answer(_send(rows, corpus), corpus, mu))
    vocabulary = int((parts.where("chunk = -1").agg(F.sum("vocabulary").alias("v")).collect()[0]["v"] or 0)
                     + (corpus.counts > 0).sum())
    n, d = corpus.tokens, corpus.docs
    floor = np.log10(n + 0.5 * (vocabulary + 1))
    unknown = np.log10(DISCOUNT * vocabulary / n) if n else 0.0
    begin = np.log10(d + mu) if n else np.log10(mu)
    kept = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*kept, T.StructField("learn", T.BooleanType()), *[
        T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()),
                                         ("model", T.DoubleType()))]])

    def add(table: pa.Table) -> pa.Table:
        head = table.filter(table.column("head"))
        with pa.ipc.open_stream(head.column("data")[0].as_buffer()) as reader:
            rows = reader.read_all()
        total = rows.column("_n").to_numpy()
        known, base, model = np.zeros(len(total), np.int64), np.zeros(len(total)), np.zeros(len(total))
        for part, is_head in zip(table.column("data"), table.column("head"), strict=True):
            if not is_head.as_py():
                r = _unpack_sums(part.as_py())
                known[r["doc"]] += r["known"]
                base[r["doc"]] += r["base"]
                model[r["doc"]] += r["model"]
        base -= total * floor
        model += (total - known) * unknown - begin
        cols = {f"k{i}": rows.column(f"k{i}") for i in range(len(keep))}
        return pa.table(cols | {"learn": rows.column("learn"), "n_tokens": pa.array(total), "n_known": pa.array(known),
                                "base": pa.array(base), "model": pa.array(np.minimum(model, 0.0))})

    done = parts.where("chunk >= 0").groupBy("chunk").applyInArrow(add, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("learn").alias("learned"), "n_tokens",
                       "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
                       F.col("model").alias("score"))
