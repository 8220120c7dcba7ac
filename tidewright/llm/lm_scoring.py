"""Operator 9, language-model scoring with a log-bilinear model.

The model predicts a token from the two before it: the vectors of these, each times a diagonal
matrix of its place, add up to a predicted vector, whose product with a token's vector and a bias
give the token's score (Mnih and Hinton 2007). It is trained by noise-contrastive estimation
against unigram noise (Mnih and Teh 2012) in numpy. Training rows are dealt by a hash of id and text into
shards, as many as there are SHARD_TOKENS in all, and ROUNDS portions of each: in a round every shard goes on
from the model so far over its next portion, in the order of the hash, and what they have learnt is
averaged, each number weighted by the squared gradients it has had. So nothing depends on how the table is cut. As a score is a sum over the two
places, the normaliser of all contexts is one matrix product, so that every token's log-probability
is exactly normalised.

Words are told apart in two steps, both log-bilinear and normalised. The first has a symbol for each
of the most frequent words, for the end, for bins of the words that follow in order of frequency, and for
all that is rarer. The second tells apart the words of a bin, from the symbol before. Within the rare
ones a word has its smoothed frequency. Frequencies count all training texts: the most frequent words
are at hand in every task, a table of bounded size, and all others are looked up by a join.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import portions, release, split_of, write_table

#: Symbols of the first step, bins among them, and words of all bins together; dimensions of both steps.
SYMBOLS, BINS, MEMBERS, DIMENSION, INNER = 1024, 64, 65_536, 24, 8
#: Noise words of a batch in the first step and of a token in the second; tokens of a batch in both, and the rate.
NOISE, INNER_NOISE, BATCH, INNER_BATCH, RATE = 64, 3, 4096, 32_768, 0.08
#: Most frequent words that tasks have at hand, and their bytes together.
HEAD, HEAD_BYTES = 200_000, 8_000_000
#: Training tokens of a shard, rounds, and bytes of text that are trained on at a time.
SHARD_TOKENS, ROUNDS, TRAIN_BYTES = 8_000_000, 4, 2_000_000
#: Parameters that are averaged in one row.
CHUNK = 1 << 16
RARE, END = 0, 1
ENDS = b""  # how counts name the end of a text: no word is empty


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case. For bytes, lower() and split() know ASCII alone."""
    return text.lower().split()


def count_tokens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary; empty for the end of a text) and c, over all rows of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words(text))
                seen[ENDS] += 1
                if len(seen) > 500_000:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    some = texts.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return some.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, by falling count, then word. A histogram says from which
    count on they are at most so many, with so many bytes; no more than these reach the driver."""
    rows = counts.where(F.octet_length("word") > 0)
    level = F.floor(F.log2("c") * 64).cast("int")  # at most some thousand levels
    found = rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word") + 16).alias("size")).collect()
    n = size = 0
    least = None
    for row in sorted(found, reverse=True):
        n, size = n + row["n"], size + row["size"]
        if n > most or size > most_bytes:
            break
        least = row["level"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in rows.where(level >= least).collect()), key=lambda r: (-r[1], r[0]))


class Lexicon:
    """The words at hand, by rank: their symbol in the first step, and their number among the words of the
    bins, -1 for others. Bins hold neighbours by rank, with about as many tokens each."""

    def __init__(self, head: list[tuple[bytes, int]], ends: int, total: int, kinds: int, symbols: int = SYMBOLS, bins: int = BINS, members: int = MEMBERS) -> None:
        import numpy as np

        self.ends, self.total, self.kinds = ends, total, kinds
        bins = min(bins, max(0, symbols - 3))
        own = min(len(head), symbols - 2 - bins)
        members = min(len(head) - own, members if bins else 0)
        counts = np.array([c for _, c in head], np.int64)
        inner = counts[own : own + members]
        if members:
            edges = np.searchsorted(np.cumsum(inner), np.arange(bins) * (inner.sum() / bins), side="right")
            self.edges = np.append(np.unique(np.minimum(edges, members - 1)), members)
        else:
            self.edges = np.zeros(1, np.int64)
        bin_of = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        self.first_bin = 2 + own
        self.number = {w: i for i, (w, _) in enumerate(head)}
        self.symbol = np.concatenate([2 + np.arange(own), self.first_bin + bin_of, np.full(len(head) - own - members, RARE)]).astype(np.int64)
        self.member = np.concatenate([np.full(own, -1), np.arange(members), np.full(len(head) - own - members, -1)]).astype(np.int64)
        self.bin_of, self.log_count = bin_of, np.log10(counts + 0.5)
        seen = np.append(np.array([0, ends]), counts[:own]).astype(float)
        if members:
            seen = np.append(seen, np.add.reduceat(inner, self.edges[:-1]))
        seen[RARE] = self.rare = total - int(seen[1:].sum())
        self.rare_kinds = kinds - own - members - (ends > 0)
        self.noise = (seen + 1) / (total + len(seen))
        self.inner = inner / np.repeat(np.add.reduceat(inner, self.edges[:-1]), np.diff(self.edges)) if members else np.zeros(0)

    def symbols_of(self, at):  # noqa: ANN001, ANN201
        """Symbols of numbers of words; -1 is a word that is not at hand, -2 an end."""
        import numpy as np

        return np.where(at >= 0, self.symbol[np.maximum(at, 0)] if len(self.symbol) else RARE, np.where(at == -2, END, RARE))

    def members_of(self, at):  # noqa: ANN001, ANN201
        import numpy as np

        return np.where(at >= 0, self.member[np.maximum(at, 0)] if len(self.member) else -1, -1)


class LogBilinear:
    """r: vectors of context words; place: diagonals of the two places; q, b: vectors and biases of
    predicted tokens; noise: unigram probabilities."""

    def __init__(self, noise, dimension: int = DIMENSION, seed: int = 0) -> None:  # noqa: ANN001
        import numpy as np

        rng, k = np.random.default_rng(seed), len(noise)
        self.noise = noise
        self.r, self.q = (rng.normal(0, 0.1, (k, dimension)) for _ in range(2))
        self.place, self.b = np.ones((2, dimension)) * [[1.0], [0.5]], np.log(noise)
        self.grown = [np.full(x.shape, 0.1) for x in self.parts()]

    def parts(self) -> list:
        return [self.r, self.place, self.q, self.b]

    def train(self, ids, seed: int, targets=None, noise_words: int = NOISE, batch: int = BATCH, rate: float = RATE) -> None:  # noqa: ANN001
        """One pass over triples ids[i - 2], ids[i - 1], ids[i], i of targets (all from 2 on), by noise-contrastive
        estimation with AdaGrad. A batch shares its noise words."""
        import numpy as np

        targets = np.arange(2, len(ids)) if targets is None else targets

        rng, (k, d) = np.random.default_rng(seed), self.r.shape
        log_noise = np.log(noise_words * self.noise).astype("f4")
        # The pass is in 4-byte floats; what it has moved is added to the model at its end.
        r, place, q, b = parts = [x.astype("f4") for x in self.parts()]
        grown = [x.astype("f4") for x in self.grown]

        for start in range(0, len(targets), batch):
            at = targets[start : start + batch]
            w, c1, c2 = ids[at], ids[at - 1], ids[at - 2]
            drawn = rng.choice(k, noise_words, p=self.noise)
            r1, r2, qw, qn = r[c1], r[c2], q[w], q[drawn]
            guess = r1 * place[0] + r2 * place[1]
            true = np.einsum("nd,nd->n", guess, qw) + b[w] - log_noise[w]
            up = -1 / (1 + np.exp(np.clip(true, -30, 30)))
            # The batch's tokens by its noise words are most of the work, and done in place.
            down = guess @ -qn.T
            down -= b[drawn] - log_noise[drawn]
            np.exp(np.clip(down, -30, 30, out=down), out=down)
            down += 1
            np.reciprocal(down, out=down)
            back = up[:, None] * qw + down @ qn
            gq = spread(w, up[:, None] * guess, k)
            np.add.at(gq, drawn, down.T @ guess)
            gb = np.bincount(w, up, k) + np.bincount(drawn, down.sum(0), k)
            gr = spread(c1, back * place[0], k) + spread(c2, back * place[1], k)
            gp = np.stack([np.einsum("nd,nd->d", back, x) for x in (r1, r2)])
            step(parts, (gr, gp, gq, gb), grown, len(w), rate)
        for x, y in zip(self.parts() + self.grown, parts + grown, strict=True):
            x[:] = y

    def tables(self):  # noqa: ANN201
        """First and second place's scores [context, token], and the log normaliser [first, second]."""
        import numpy as np

        one, two = ((self.r * p) @ self.q.T for p in self.place)
        m1, m2, top = one.max(1), two.max(1), self.b.max()
        z = (np.exp(one - m1[:, None]) * np.exp(self.b - top)) @ np.exp(two - m2[:, None]).T
        return one + self.b, two, np.log(z) + m1[:, None] + m2 + top


def spread(at, grad, k: int):  # noqa: ANN001, ANN201
    """Sums of the rows of grad by number, of k."""
    import numpy as np

    d = grad.shape[1]
    return np.bincount((at[:, None] * d + np.arange(d)).ravel(), grad.ravel(), k * d).reshape(k, d)


def step(parts, grads, grown, n: int, rate: float) -> None:  # noqa: ANN001
    """A step of AdaGrad, in place."""
    import numpy as np

    for x, grad, seen in zip(parts, grads, grown, strict=True):
        grad /= math.sqrt(n)
        seen += grad * grad
        x -= rate * grad / np.sqrt(seen)


class Within:
    """The second step: u, vectors of the symbols before; v, b, vectors and biases of the bins' words."""

    def __init__(self, lexicon: Lexicon, dimension: int = INNER, seed: int = 1) -> None:
        import numpy as np

        rng, m = np.random.default_rng(seed), len(lexicon.inner)
        self.bin_of, self.edges, self.noise = lexicon.bin_of, lexicon.edges, lexicon.inner
        self.u, self.v = (rng.normal(0, 0.1, (n, dimension)) for n in (len(lexicon.noise), m))
        self.b = np.log(self.noise)
        self.grown = [np.full(x.shape, 0.1) for x in self.parts()]
        self.sums = np.cumsum(self.noise)  # a bin's words add 1

    def parts(self) -> list:
        return [self.u, self.v, self.b]

    def train(self, before, words_, seed: int, noise_words: int = INNER_NOISE, batch: int = INNER_BATCH, rate: float = RATE) -> None:  # noqa: ANN001
        """One pass over words of bins and the symbols before them, against noise from the same bin."""
        import numpy as np

        rng, k, m = np.random.default_rng(seed), len(self.u), len(self.v)
        for start in range(0, len(words_), batch):
            w, c = words_[start : start + batch], before[start : start + batch]
            bins = self.bin_of[w]
            drawn = np.searchsorted(self.sums, bins[:, None] + rng.random((len(w), noise_words)))
            drawn = np.clip(drawn, self.edges[bins][:, None], self.edges[bins + 1][:, None] - 1)
            every = np.concatenate([w[:, None], drawn], 1)
            u, v = self.u[c], self.v[every]
            score = np.einsum("nd,nkd->nk", u, v) + self.b[every] - np.log(noise_words * self.noise[every])
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            error[:, 0] -= 1
            gu = spread(c, np.einsum("nk,nkd->nd", error, v), k)
            gv = spread(every.ravel(), (error[:, :, None] * u[:, None, :]).reshape(-1, u.shape[1]), m)
            step(self.parts(), (gu, gv, np.bincount(every.ravel(), error.ravel(), m)), self.grown, len(w), rate)

    def normalisers(self):  # noqa: ANN201
        """Log normalisers [symbol before, bin]."""
        import numpy as np

        out = np.zeros((len(self.u), len(self.edges) - 1))
        for k, (a, b) in enumerate(zip(self.edges, self.edges[1:])):  # noqa: B905
            for start in range(a, b, 4096):
                end = min(b, start + 4096)
                out[:, k] += np.exp(self.u @ self.v[start:end].T + self.b[start:end]).sum(1)
        return np.log(out)


class Model:
    """Both steps."""

    def __init__(self, lexicon: Lexicon, dimension: int = DIMENSION, inner: int = INNER) -> None:
        self.lexicon, self.outer, self.within = lexicon, LogBilinear(lexicon.noise, dimension), Within(lexicon, inner)

    def parts(self) -> list:
        return self.outer.parts() + self.within.parts()

    def flat(self):  # noqa: ANN201
        import numpy as np

        return np.concatenate([x.ravel() for x in self.parts()])

    def set_flat(self, flat, grown=None) -> Model:  # noqa: ANN001
        for parts, values in ((self.parts(), flat), (self.outer.grown + self.within.grown, grown)):
            at = 0
            for x in parts if values is not None else ():
                x.flat[:], at = values[at : at + x.size], at + x.size
        return self

    def grown(self):  # noqa: ANN201
        """AdaGrad's sums of squared gradients, as long as flat()."""
        import numpy as np

        return np.concatenate([x.ravel() for x in self.outer.grown + self.within.grown])

    def train(self, at, first, last, seed: int) -> None:  # noqa: ANN001
        """On the words and ends of texts (of token_numbers()); the two ends before a text are context alone."""
        import numpy as np

        symbols, members = self.lexicon.symbols_of(at), self.lexicon.members_of(at)
        own = np.arange(len(at)) >= np.repeat(first, np.diff(np.append(0, last)))
        self.outer.train(symbols, seed, np.flatnonzero(own))
        some = np.flatnonzero(members >= 0)
        self.within.train(symbols[some - 1], members[some], seed)

    def prepare(self) -> Model:
        self.tables, self.inner = self.outer.tables(), self.within.normalisers()
        return self

    def logs(self, at):  # noqa: ANN001, ANN201
        """Natural log-probabilities of the tokens from the third on, 0 for the first two; of rare words
        that of being rare."""
        import numpy as np

        symbols, members = self.lexicon.symbols_of(at), self.lexicon.members_of(at)
        one, two, z = self.tables
        c1, c2, w = symbols[1:-1], symbols[:-2], symbols[2:]
        out = np.concatenate([[0, 0], one[c1, w] + two[c2, w] - z[c1, c2]])
        some = np.flatnonzero(members[2:] >= 0)
        m, c = members[2:][some], c1[some]
        out[some + 2] += np.einsum("nd,nd->n", self.within.u[c], self.within.v[m]) + self.within.b[m] - self.inner[c, self.within.bin_of[m]]
        return out


def token_numbers(texts: list[bytes], number: dict[bytes, int]):  # noqa: ANN201
    """Numbers of all tokens (-1 not at hand, -2 an end), each text as two ends, its words and an end: so
    that every text starts from the same context. Also the place of each text's first word, and one past
    its end, and the words that are not at hand with their text's place."""
    import numpy as np

    flat, first, last, get = [], [], [], number.get
    tails: list[list[bytes]] = []
    for text in texts:
        flat += (-2, -2)
        first.append(len(flat))
        own = words(text)
        found = [get(w, -1) for w in own]
        tails.append([w for w, i in zip(own, found, strict=True) if i < 0] if -1 in found else [])
        flat += found
        flat.append(-2)
        last.append(len(flat))
    return np.array(flat, np.int64), np.array(first, np.int64), np.array(last, np.int64), tails


def averaged(rows: DataFrame) -> DataFrame:
    """Sums of rows (shard, chunk, n, x: 4-byte floats) by chunk: they stream through their tasks,
    first over shares of a chunk's rows, then over these, in order. No more than two rows are held."""

    def adding(kind: str):  # noqa: ANN202
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            def out(key: tuple, n: int, x) -> pa.RecordBatch:  # noqa: ANN001
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "share", "n", "x"])

            at, n, x = None, 0, None
            for batch in batches:
                for chunk, share, m, data in zip(*batch.columns, strict=True):
                    own, key = np.frombuffer(data.as_buffer(), kind), (chunk.as_py(), share.as_py() if kind == "f4" else 0)
                    if key != at:
                        if at is not None:
                            yield out(at, n, x)
                        at, n, x = key, 0, np.zeros(len(own))
                    n, x = n + m.as_py(), x + own
            if at is not None:
                yield out(at, n, x)

        return add

    kinds, parts = "chunk int, share int, n long, x binary", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.withColumn("share", F.pmod("shard", F.lit(64)).cast("int")).repartition(parts, "chunk", "share").sortWithinPartitions("chunk", "share", "shard").select("chunk", "share", "n", "x").mapInArrow(adding("f4"), kinds)
    return some.repartition(parts, "chunk").sortWithinPartitions("chunk", "share").mapInArrow(adding("f8"), kinds)


def train_model(texts: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", dimension: int = DIMENSION, inner: int = INNER, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Model:
    """The model after one pass over all rows of texts, whose tokens the lexicon has counted, in rounds. What reaches the driver of
    a round is one model."""
    import numpy as np

    spark = texts.sparkSession
    shards, lexicon_ = max(1, -(-lexicon.total // shard_tokens)), spark.sparkContext.broadcast(lexicon)
    model = Model(lexicon, dimension, inner)
    some = texts.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    dealt = some.select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "t")

    for k in range(rounds):
        start = spark.sparkContext.broadcast((model.flat(), model.grown()))

        def run(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            def learnt(shard: int, model: Model) -> pa.RecordBatch:
                # A number counts by what the shard's gradients know of it: words that a shard lacks are left to others.
                weight = model.grown() - start.value[1]
                flat = np.concatenate([weight * (model.flat() - start.value[0]), weight]).astype("f4")
                chunks = range(0, len(flat), CHUNK)
                return pa.RecordBatch.from_arrays([pa.array([shard] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array([1] * len(chunks), pa.int64()), pa.array([flat[c : c + CHUNK].tobytes() for c in chunks], pa.binary())], names=["shard", "chunk", "n", "x"])

            at, own, seen, held, size = None, None, 0, [], 0

            def train() -> None:
                nonlocal seen, held, size
                numbers, first, last, _ = token_numbers(held, lexicon_.value.number)
                own.train(numbers, first, last, seed=seen + k)
                seen, held, size = seen + int((last - first).sum()), [], 0

            for batch in batches:
                for shard, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if shard != at:
                        if at is not None:
                            train()
                            yield learnt(at, own)
                        at, own, seen = shard, Model(lexicon_.value, dimension, inner).set_flat(*start.value), 0
                    held.append(text.as_py())
                    size += len(held[-1])
                    if size >= TRAIN_BYTES:
                        train()
            if at is not None:
                if held:
                    train()
                yield learnt(at, own)

        portion = dealt.where(F.pmod(F.shiftright("h", 32), F.lit(rounds)) == k).repartition(shards, "shard").sortWithinPartitions("shard", "h").select("shard", "t")
        found = sorted(averaged(portion.mapInArrow(run, "shard long, chunk int, n long, x binary")).collect())
        if found:
            moved, weight = np.split(np.concatenate([np.frombuffer(r["x"], float) for r in found]), 2)
            model.set_flat(model.flat() + moved / np.where(weight > 0, weight, 1), model.grown() + weight / found[0]["n"])
        start.destroy()
        release(spark)
    return model


_models: dict[str, Model] = {}


def score_texts(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, dimension: int = DIMENSION, inner: int = INNER, **sizes: int) -> DataFrame:
    """For each row of df: the columns of df but text_col, n_tokens, n_known, train_tokens,
    base_score and score, learnt from all rows of training.

    A null text is empty: one token, its end. base_score is the smoothed unigram log10 probability
    of the text, score the model's. Rows that repeat are scored alike. If training is empty, the
    model is uniform over its two symbols and counts are 0. sizes are those of Lexicon. An empty df gives
    an empty result.
    """
    spark = df.sparkSession
    counts = write_table(count_tokens(training, text_col), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("word") == F.lit(ENDS)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    lexicon = Lexicon(most_frequent(counts, head, HEAD_BYTES), ends, total, kinds, **sizes)
    model = train_model(training, lexicon, id_col, text_col, dimension, inner)
    shared, name = spark.sparkContext.broadcast((lexicon, model.flat())), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if name not in _models:  # a worker keeps the tables for its next task
            _models.clear()
            _models[name] = Model(shared.value[0], dimension, inner).set_flat(shared.value[1]).prepare()
        model = _models[name]
        lexicon_ = model.lexicon
        for whole in batches:
            room = np.append(0, np.cumsum(np.asarray(pc.binary_length(whole.column(whole.num_columns - 1)))))
            for i, j in portions(room, 1_000_000):
                batch = whole.slice(i, j - i)
                at, first, last, tails = token_numbers(batch.column(batch.num_columns - 1).to_pylist(), lexicon_.number)
                known = at >= 0
                symbols = lexicon_.symbols_of(at)
                log = np.zeros(len(at))
                log[known] = lexicon_.log_count[at[known]]
                rare = symbols == RARE
                sums = lambda x: (lambda s: s[last] - s[first])(np.concatenate([[0], np.cumsum(x)]))  # noqa: E731, B023
                tokens = last - first
                columns = [tokens, sums(known) + (lexicon_.ends > 0), sums(rare), sums(log) + math.log10(lexicon_.ends + 0.5), sums(np.where(rare, log, 0.0)), sums(model.logs(at) / math.log(10))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in columns), pa.array(tails, pa.list_(pa.binary()))], names=[*batch.schema.names[:-1], "n", "known", "others", "base", "within", "lp", "tail"])

    rest = [c for c in df.columns if c != text_col]
    rows = df.select(F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kinds_of = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    parts = write_table(rows.mapInArrow(run, kinds_of + ", n long, known long, others long, base double, within double, lp double, tail array<binary>"), "scored")
    # No word of a tail is among the frequent ones: none is in many rows.
    looked = parts.select("rid", F.explode("tail").alias("word")).groupBy("rid", "word").agg(F.count(F.lit(1)).alias("times")).join(counts, "word", "left")
    tails = looked.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )
    full = parts.drop("tail").join(tails, "rid", "left").na.fill(0, ["tail_log", "tail_known"])
    base = F.col("base") + F.col("tail_log") - F.col("n") * math.log10(total + 0.5 * (kinds + 1))
    score = F.col("lp") + F.col("within") + F.col("tail_log") - F.col("others") * math.log10(lexicon.rare + 0.5 * (lexicon.rare_kinds + 1))
    return full.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("n").alias("n_tokens"), (F.col("known") + F.col("tail_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score")
    )


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, **how) -> DataFrame:
    """score_texts() for all rows of df, learnt from those whose crc32 fold is not `held`."""
    out = F.coalesce(split_of(id_col, folds) == held, F.lit(False))
    return score_texts(df.select(id_col, out.alias("held_out"), text_col), df.where(~out), id_col, text_col, **how)
