"""A hidden Markov language model over words, trained by Baum-Welch on all training texts.

Latent states emit words, or the end, each by its own expected counts:

    P(text) = sum over state paths of  pi * prod A * prod B(word | state),   B = (c(word) * share(state | word) + 0.1) / (N_state + 0.1 * (V + 1))

The first rounds tie the emissions: a state emits one of CLASSES word classes (the low bits of the word's hash), so that a round broadcasts
and gathers STATES * (CLASSES + 1) numbers at any corpus size.  The last round unties them: it counts every word by state, in a table summed
by partial aggregation, which grows with the vocabulary and is never bounded nor gathered.  (Inside a class the tied states don't tell words
apart, so words' own posteriors need nothing but the tied model.)  The texts are read once and packed in blocks of about 4 MB, each
with its own distinct words; each block pulls the counts and shares of its own words back.  A word's shares are kept in LEVELS steps,
all states' in one 64-bit number; the N_state are sums of the very same steps, so B stays a distribution.

Every round sums the expected counts of whole texts by partial aggregation.  Long texts are worked on in pieces of PIECE
words at once; the products of the pieces' transfer matrices carry the forward and backward weights over the cuts, so nothing is
lost there.  Scoring is the exact scaled forward recursion over whole texts, by the same products for long ones.

Defined cases: null text counts as empty; an empty text is the end alone; repeated rows each train and have their own result; a null
doc_id is hashed as the empty text; an empty table gives an empty result; without training rows every count is 0.
Word counts are kept under 64-bit hashes of the words (a clash among 10 million words has chance 3e-6).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_runs, crc_mod, table

STATES, CLASSES = 6, 4096
#: Steps and bits of a word's share of one state; STATES of them fit in 64 bits.
LEVELS, BITS = 1023, 10
#: Texts of more than SHORT words are worked on in pieces of PIECE.
SHORT, PIECE, ROUNDS = 1024, 512, 5
BLOCK_BYTES = 4 << 20
BLOCKS_A_TASK = 4
ALPHA = 0.1
END = CLASSES
LOG10 = np.log(10.0)


@dataclass(frozen=True)
class Model:
    """pi (states), a (states, states), b (classes and end, states)."""

    pi: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @staticmethod
    def first(shares: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """Sticky states around the classes' shares, told apart by seeded noise."""
        rng = np.random.default_rng(seed)
        b = (shares[:, None] + 1e-6) * np.exp(rng.normal(0, 0.7, (len(shares), states)))
        a = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(a, 0.9)
        return Model(np.full(states, 1 / states), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0))

    @staticmethod
    def of(flat: np.ndarray, states: int = STATES) -> Model:
        """From expected counts, smoothed so that nothing is impossible."""
        k = states
        pi, a, b = flat[:k] + 0.1, flat[k : k + k * k].reshape(k, k) + 0.1, flat[k + k * k :].reshape(-1, k) + 0.01
        return Model(pi / pi.sum(), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0))


def transfers(m: Model, parts: list[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the product of a * b[class] over its steps, scaled, and the log of its scale; worked out in the kind of numbers."""
    k = len(m.pi)
    a, b = m.a.astype(kind), m.b.astype(kind)
    out, logs = np.empty((len(parts), k, k)), np.zeros(len(parts))
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    for lo in range(0, len(order), 1024):
        group = order[lo : lo + 1024]
        sizes = np.array([len(parts[i]) for i in group])
        obs = np.zeros((int(sizes[0]), len(group)), np.int64)
        for j, i in enumerate(group):
            obs[: sizes[j], j] = parts[i]
        prod, scale = np.broadcast_to(np.eye(k, dtype=kind), (len(group), k, k)).copy(), np.zeros(len(group))
        for t in range(len(obs)):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # parts longer than t
            new = (prod[:n].reshape(-1, k) @ a).reshape(n, k, k)
            new *= b[obs[t, :n]][:, None, :]
            if t % 2 or t + 1 == len(obs) or n < len(group):
                top = new.reshape(n, -1).max(axis=1)
                scale[:n] += np.log(top)
                new /= top[:, None, None]
            prod[:n] = new
        out[group], logs[group] = prod, scale
    return out, logs


@dataclass
class Pieces:
    """Texts cut for parallel work, with what the cuts would lose: the states' weights before each piece, and behind it."""

    parts: list[np.ndarray]
    first: np.ndarray
    before: np.ndarray
    behind: np.ndarray
    #: By text, the natural log of its probability up to its last piece.
    logs: dict[int, float]


def pieces(m: Model, texts: list[np.ndarray], short: int, piece: int, kind: type = np.float64) -> Pieces:
    """Texts (none empty) of over short classes in pieces; those before and behind a piece reach it through their products."""
    parts, owner, first = [], [], []
    for i, t in enumerate(texts):
        cut = [t] if len(t) <= short else [t[j : j + piece] for j in range(0, len(t), piece)]
        parts += cut
        owner += [i] * len(cut)
        first += [True] + [False] * (len(cut) - 1)
    k, n = len(m.pi), len(parts)
    before, behind, logs = np.zeros((n, k)), np.ones((n, k)), {}
    cut = [p for p in range(n) if not first[p] or p + 1 < n and owner[p + 1] == owner[p]]
    # a text's first piece begins with pi, not with a step from a state before it
    prod, scale = transfers(m, [parts[p][1:] if first[p] else parts[p] for p in cut], kind) if cut else (np.zeros((0, k, k)), np.zeros(0))
    state = None
    for p, t, s in zip(cut, prod, scale, strict=True):
        if first[p]:
            state, logs[owner[p]] = m.pi * m.b[parts[p][0]], 0.0
        else:
            before[p] = state
        state = state @ t
        total = state.sum()
        logs[owner[p]] += np.log(total) + s
        state = state / total
    for at in range(len(cut) - 2, -1, -1):
        p, q = cut[at], cut[at + 1]
        if owner[p] == owner[q]:
            behind[p] = prod[at + 1] @ behind[q]
            behind[p] /= behind[p].max()
    return Pieces(parts, np.array(first, bool), before, behind, logs)


def expected_counts(m: Model, texts: list[np.ndarray], batch: int = 1024, short: int = SHORT, piece: int = PIECE) -> np.ndarray:
    """Baum-Welch expected counts of pi, a and b, flat, over whole texts of classes (none empty)."""
    k = len(m.pi)
    pi_n, a_n, b_n = np.zeros(k), np.zeros((k, k)), np.zeros((len(m.b), k))
    cut = pieces(m, texts, short, piece, np.float32)
    order = np.array(sorted(range(len(cut.parts)), key=lambda i: -len(cut.parts[i])), np.int64)
    a, b = m.a.astype(np.float32), m.b.astype(np.float32)
    for lo in range(0, len(order), batch):
        own = order[lo : lo + batch]
        part = [cut.parts[i] for i in own]
        first, before, behind = cut.first[own], cut.before[own].astype(np.float32), cut.behind[own].astype(np.float32)
        sizes = np.array([len(p) for p in part])
        steps = int(sizes[0])
        obs = np.zeros((steps, len(part)), np.int64)
        for j, p in enumerate(part):
            obs[: len(p), j] = p
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # pieces longer than t
        alpha = np.zeros((steps, len(part), k), np.float32)
        scale = np.ones((steps, len(part), 1), np.float32)
        now = np.where(first[:, None], m.pi.astype(np.float32), before @ a) * b[obs[0]]
        for t in range(steps):
            n = live[t]
            if t:
                now = (alpha[t - 1, :n] @ a) * b[obs[t, :n]]
            s = now[:n].sum(axis=1, keepdims=True)
            scale[t, :n] = s
            alpha[t, :n] = now[:n] / s
        # behind each piece's end, so that weights before and behind multiply to 1
        beta = behind / (alpha[sizes - 1, np.arange(len(part))] * behind).sum(axis=1, keepdims=True)
        xi = np.zeros((k, k), np.float64)
        for t in range(steps - 1, 0, -1):
            n = live[t]
            x = b[obs[t, :n]] * beta[:n] / scale[t, :n]
            xi += alpha[t - 1, :n].T @ x
            alpha[t, :n] *= beta[:n]  # now the posterior
            beta[:n] = x @ a.T
        xi += before.T @ (b[obs[0]] * beta / scale[0])  # the step into a piece; before is 0 at a text's start
        alpha[0] *= beta
        a_n += xi * m.a
        pi_n += alpha[0][first].sum(axis=0)
        mask = np.arange(steps)[:, None] < sizes[None, :]
        seen, gamma = obs[mask], alpha[mask]
        gamma /= gamma.sum(axis=1, keepdims=True)
        for s in range(k):
            b_n[:, s] += np.bincount(seen, gamma[:, s], len(m.b))
    return np.concatenate([pi_n, a_n.ravel(), b_n.ravel()])


def log_likelihood(m: Model, texts: list[np.ndarray], short: int = SHORT, piece: int = PIECE) -> np.ndarray:
    """Natural log of the probability of each sequence of classes (none empty), by the scaled forward recursion."""
    out = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts])
    few = np.flatnonzero(sizes <= short)
    few = few[np.argsort(-sizes[few], kind="stable")]
    if len(few):
        obs = np.zeros((int(sizes[few[0]]), len(few)), np.int64)
        for j, i in enumerate(few):
            obs[: sizes[i], j] = texts[i]
        now, total = m.pi * m.b[obs[0]], np.zeros(len(few))
        for t in range(len(obs)):
            n = int(np.searchsorted(-sizes[few], -t, side="left"))
            if t:
                now = (now[:n] @ m.a) * m.b[obs[t, :n]]
            s = now.sum(axis=1)
            total[:n] += np.log(s)
            now = now / s[:, None]
        out[few] = total
    many = np.flatnonzero(sizes > short)
    if len(many):
        for j, log in pieces(m, [texts[i] for i in many], short, piece).logs.items():
            out[many[j]] = log
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held) to blocks."""
    part = TaskContext.get().partitionId()
    seq = 0
    for batch in batches:
        held = batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi, items in byte_runs(batch.column(1), BLOCK_BYTES):
            number: dict[bytes, int] = {}
            lens, tokens = [], []
            counts = np.zeros(0, np.int64)
            for item in items:
                words = item.lower().split()
                ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint32)
                lens.append(len(ids))
                tokens.append(ids)
            flat = np.concatenate([np.zeros(0, np.uint32), *tokens])
            train = np.repeat(~held[lo:hi].astype(bool), lens)
            counts = np.bincount(flat[train], minlength=len(number)).astype(np.int64)
            vocab = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([(part << 32) | seq], pa.int64()), "doc_ids": whole(batch.column(0).slice(lo, hi - lo)), "held": whole(held[lo:hi].astype(bool)),
                "lens": whole(np.array(lens, np.int32)), "tokens": pa.array([flat.tobytes()], pa.binary()), "vocab": whole(vocab.view(np.int64)), "counts": whole(counts),
            })
            seq += 1


def _texts(numbers: np.ndarray, lens: np.ndarray, end: int) -> list[np.ndarray]:
    """Each text's numbers, then the end."""
    return [np.append(x, end) for x in np.split(numbers, np.cumsum(lens)[:-1])]


def _classes(vocab: np.ndarray) -> np.ndarray:
    return (vocab & (CLASSES - 1)).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            v = batch.column(name)[i]
            row[name] = v.values if isinstance(v, pa.ListScalar) else v.as_py()
            if isinstance(v, pa.ListScalar) and name != "doc_ids":
                row[name] = row[name].to_numpy(zero_copy_only=False) if not pa.types.is_struct(row[name].type) else row[name]
        yield row


def train(blocks: DataFrame, shares: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> tuple[Model, DataFrame]:
    """Baum-Welch rounds over all training texts of the blocks: the tied model before the last round, and the last round's counts.

    Those are rows (slot, word, c, n0, n1, ...): slot -1 has a word's training count and expected counts by state, slot 0 those of
    pi, slots 1 to states the rows of a, and the next one those of the end.
    """
    model = Model.first(shares, states)
    columns = [f"n{i}" for i in range(states)]

    def tied(m: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states + states * states + (CLASSES + 1) * states)
            for batch in batches:
                for row in _rows(batch):
                    texts = _texts(_classes(row["vocab"])[np.frombuffer(row["tokens"], np.uint32)], row["lens"], END)
                    mine = [t for t, h in zip(texts, row["held"], strict=True) if not h]
                    if mine:
                        total += expected_counts(m, mine)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(len(total), dtype=np.int32)), "n": pa.array(total)})

        return run

    def untied(m: Model):
        def rows(slot: np.ndarray, word: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            cols = {"slot": slot.astype(np.int32), "word": word.astype(np.int64), "c": c.astype(np.int64)}
            return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in (cols | {x: n[:, i].copy() for i, x in enumerate(columns)}).items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((states + 2, states))
            for batch in batches:
                for row in _rows(batch):
                    vocab = row["vocab"]
                    texts = _texts(np.frombuffer(row["tokens"], np.uint32).astype(np.int64), row["lens"], len(vocab))
                    mine = [t for t, h in zip(texts, row["held"], strict=True) if not h]
                    if mine:
                        flat = expected_counts(Model(m.pi, m.a, m.b[np.append(_classes(vocab), END)]), mine).reshape(-1, states)
                        total[:-1] += flat[: states + 1]
                        total[-1] += flat[-1]
                        seen = np.flatnonzero(row["counts"] > 0)
                        yield rows(np.full(len(seen), -1), vocab[seen], row["counts"][seen], flat[states + 1 :][seen])
            own = np.arange(states + 2)
            yield rows(own, own, own * 0, total)

        return run

    for _ in range(rounds - 1):
        got = blocks.select("held", "lens", "tokens", "vocab").mapInArrow(tied(model), "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n"))
        flat = np.zeros(states + states * states + (CLASSES + 1) * states)
        for slot, n in got.collect():  # one row for each number of the model, whatever the corpus
            flat[slot] = n
        model = Model.of(flat, states)
    schema = "slot int, word bigint, c bigint, " + ", ".join(f"{x} double" for x in columns)
    last = blocks.select("held", "lens", "tokens", "vocab", "counts").mapInArrow(untied(model), schema)
    return model, last.groupBy("slot", "word").agg(F.sum("c").alias("c"), *[F.sum(x).alias(x) for x in columns])


def _share(n: str, c: str = "c") -> Column:
    return F.least(F.round(F.col(n) * LEVELS / F.col(c)), F.lit(float(LEVELS))).cast("long")


def emissions(c: np.ndarray, shares: np.ndarray, end: np.ndarray, sizes: np.ndarray, distinct: int) -> np.ndarray:
    """B of words by their counts and packed shares (0 where unknown), and of the end, last."""
    k = len(end)
    steps = (shares[:, None] >> (BITS * np.arange(k))) & LEVELS
    return (np.vstack([c[:, None] * steps / LEVELS, end]) + ALPHA) / (sizes + ALPHA * (distinct + 1))


def score(docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) == 0).alias("held"))
    schema = f"block bigint, doc_ids array<{kind}>, held array<boolean>, lens array<int>, tokens binary, vocab array<bigint>, counts array<bigint>"
    blocks = scratch.cut(own.mapInArrow(_pack, schema), "blocks")
    pairs = blocks.select(F.explode(F.arrays_zip("vocab", "counts")).alias("w")).where("w.counts > 0")
    by_class = pairs.groupBy(F.col("w.vocab").bitwiseAND(F.lit(CLASSES - 1)).alias("class")).agg(F.sum("w.counts").alias("n")).collect()
    class_n = np.zeros(CLASSES + 1)
    for k, n in by_class:  # at most CLASSES rows
        class_n[k] = n
    class_n[END] = ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).first()["n"] or 0
    model, counted = train(blocks, class_n / max(class_n.sum(), 1), rounds)
    states = len(model.pi)
    columns = [f"n{i}" for i in range(states)]
    packed = functools.reduce(Column.bitwiseOR, [F.shiftleft(_share(x), BITS * i) for i, x in enumerate(columns)])
    a_word = F.col("slot") < 0
    kept = counted.select("slot", "word", "c", F.when(a_word, packed).alias("shares"), *[F.when(~a_word, F.col(x)).alias(x) for x in columns])
    kept = scratch.cut(kept, "counts")
    counts = kept.where("slot < 0").select("word", "c", "shares")
    sums = [F.sum(F.col("c") * F.shiftright("shares", BITS * i).bitwiseAND(F.lit(LEVELS))) for i in range(states)]
    all_words = counts.agg(F.sum("c"), F.count("*"), *sums).first()
    words_n, words_v, *steps = (x or 0 for x in all_words)
    total, distinct = words_n + ends, words_v + (ends > 0)
    flat = np.zeros((states + 2, states))
    for r in kept.where("slot >= 0").collect():  # states + 2 rows
        flat[r["slot"]] = [r[x] for x in columns]
    final, end = Model.of(np.concatenate([flat[: states + 1].ravel(), np.zeros(states)]), states), flat[-1]
    pi, a, sizes = final.pi, final.a, np.array(steps) / LEVELS + end

    asked = blocks.select("block", F.posexplode("vocab").alias("i", "word")).join(counts, "word")
    pulled = scratch.cut(asked.groupBy("block").agg(F.collect_list(F.struct("i", "c", "shares")).alias("pulled")), "pulled")
    scratch.drop(kept)
    # as many tasks as the blocks need, however many the corpus has
    tasks = max(1, -(-blocks.count() // BLOCKS_A_TASK))
    dealt = lambda df: df.repartition(tasks, "block")
    ready = dealt(blocks.drop("counts")).join(dealt(pulled), "block", "left").drop("block")
    every = np.log10(total + ALPHA * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                tokens, lens = np.frombuffer(row["tokens"], np.uint32).astype(np.int64), row["lens"]
                words = len(row["vocab"])
                c, shares = np.zeros(words, np.int64), np.zeros(words, np.int64)
                if row["pulled"] is not None and len(row["pulled"]):
                    i = row["pulled"].field("i").to_numpy()
                    c[i], shares[i] = row["pulled"].field("c").to_numpy(), row["pulled"].field("shares").to_numpy()
                logs, known = np.log10(c + ALPHA), (c > 0).astype(np.int64)
                owner = np.repeat(np.arange(len(lens)), lens)
                add = lambda v: np.bincount(owner, v[tokens], len(lens))
                n = lens.astype(np.int64) + 1
                base = add(logs) + np.log10(ends + ALPHA) - n * every
                full = log_likelihood(Model(pi, a, emissions(c, shares, end, sizes, distinct)), _texts(tokens, lens, words)) / LOG10
                yield pa.RecordBatch.from_pydict({
                    "doc_id": row["doc_ids"], "held_out": pa.array(row["held"]), "n_tokens": pa.array(n), "n_known": pa.array(add(known).astype(np.int64) + (ends > 0)),
                    "train_tokens": pa.array(np.full(len(n), total)), "base_score": pa.array(base), "score": pa.array(full),
                })

    return ready.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op1"))
