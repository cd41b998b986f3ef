"""Every operator against its plain version, on rows with nulls, empty and long texts, ties, repeats and clashing column names."""

import base64
import hashlib
import itertools
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemoflow.llm import boost, bpe, codes, hmm, minhash, mixing, private, quality, repeats, rollups, stats
from mnemoflow.llm.common import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n int, kept string, spans string, t string, row_key int, rules int, band int"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def sample(seed=1, n=60):
    """(doc_id, text): families of copies and near copies, odd texts, a very long one."""
    rng = random.Random(seed)
    out = []
    for _ in range(n // 6):
        base = words(rng, rng.randrange(30, 120))
        for _ in range(5):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w[: rng.choice([len(w), len(w), len(w) - 4])]))
    shared = " ".join(words(rng, 30))
    out += ["", " \n\t ", "one two", "One TWO", "é è ü ñ " * 40, "a" * 400, "b" * 120 + "c" + "b" * 90, shared + " tail one", "head " + shared, " ".join(words(rng, 30_000))]
    out += ["the same line\nthe same line\nother\nthe same line", "$$$ ### ||| " * 30]
    rng.shuffle(out)
    return list(enumerate([None, *out]))


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 5 else None, 1, "k", "s", "t", 2, 3, 4) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(spark, docs, rows, none):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(docs, Scratch(spark, "t")).collect()}
    assert got == brute.near(rows)
    assert minhash.near_duplicates(none, Scratch(spark, "t")).count() == 0


def test_links_that_miss_the_smallest(spark):
    """A chain in one bucket: neighbours are similar, the ends are not."""
    rng = random.Random(5)
    w = words(rng, 200, 10**6)
    texts = []
    for _ in range(25):
        texts.append(" ".join(w))
        at = rng.randrange(190)
        w[at : at + 3] = words(rng, 3, 10**6)
    rows = list(enumerate(texts)) + [(100 + i, " ".join(words(rng, 40))) for i in range(10)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.near(rows)


def test_ids_with_several_texts_are_one_vertex(spark):
    rng = random.Random(17)
    a, b, c = (words(rng, 80, 10**6) for _ in range(3))
    rows = [(0, b), (1, b), (1, a), (2, [*a[:78], "x", "y"]), (5, c), (6, []), (6, [*c, "z"]), (None, a), (7, ["one"]), (8, ["One"])]
    rows = [(i, " ".join(w)) for i, w in rows] + [(9, None), (0, " ".join(b))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), Scratch(spark, "t")).collect()
    assert Counter(tuple(r) for r in got) == Counter([
        (0, 76, 0, True), (0, 76, 0, True), (1, 76, 0, False), (1, 76, 0, False), (2, 76, 0, False), (5, 76, 5, True), (6, 0, 5, False), (6, 77, 5, False),
        (None, 76, None, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True),
    ])


def test_first_common_band_is_by_whole_keys():
    sig = np.tile(np.random.default_rng(3).integers(0, 2**32, 128, np.uint32), (2, 1))
    sig[1, :4] ^= np.uint32(1 << 16)  # band 0 agrees in the low 16 bits alone, so the pair has no bucket there
    group = pa.table({
        "id": [5, 6], "comp": [5, 6], "block": [0, 0], "lo": [1, 1], "n": [100, 100],
        "sig": pa.array([s.astype("<u2").tobytes() for s in sig], pa.binary()), "bands": [list(map(int, k)) for k in minhash.band_keys(sig)],
    })
    compared = {k: [(int(x), y.tolist()) for x, y in minhash._pairs_of(k, 0, 0, group) if len(y)] for k in (0, 1, 2)}
    assert compared == {0: [], 1: [(0, [1])], 2: []}


def test_keep_first_keeps_columns_nulls_and_one_of_each(spark, docs, rows):
    more = docs.union(docs.where("doc_id = 4")).union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    out = minhash.keep_first(more, Scratch(spark, "t"))
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    want = [i for i, v in brute.near(rows).items() if v[2]]
    assert sorted(i for i in ids if i is not None) == sorted(want)


def test_repeats(spark, docs, rows, none):
    got = repeats.without_repeats(docs, Scratch(spark, "t")).withColumn("h", F.sha2("kept", 256)).drop("kept").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.repeats([(i, t) for i, t in rows if len(t or "") < 50_000] + [(i, t) for i, t in rows if len(t or "") >= 50_000])
    assert repeats.without_repeats(none, Scratch(spark, "t")).count() == 0


def test_repeats_in_random_bytes(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(20, 130))) for _ in range(12)] + ["ab" * 100, "é" * 60]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t")).withColumn("h", F.sha2("kept", 256)).drop("kept").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.repeats(rows)


def test_repeats_of_ids_that_repeat_and_null_ids(spark):
    rng = random.Random(11)
    passage = " ".join(words(rng, 20))
    other = " ".join(words(rng, 20))
    rows = [(7, f"{'x' * (i % 9)}{passage} {i}" + f" {other}" * (i % 2)) for i in range(700)]
    rows += [(3, "say " + passage), (9, other + passage), (9, other + passage), (None, passage * 2), (None, None), (5, None), (1, "ab" * 200), (2, "ab" * 120 + "c" + "ab" * 90)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), Scratch(spark, "t"))
    got = Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert got == Counter(brute.repeats_of_rows(rows))
    named = repeats.without_repeats(spark.createDataFrame([("a", passage), ("b", passage), ("b", "short")], "doc_id string, text string"), Scratch(spark, "t"))
    assert {(r["doc_id"], r["n_removed"]) for r in named.collect()} == {("a", 0), ("b", len(passage)), ("b", 0)}


TRICKY = [
    "a@b.c_d@e.f x.y@z", "mail me: jo.e+x@mail.example.com, or not@here", "1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.001 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111 4111 1111 1111 1111", "+1 (456) 555-2186 +44.20.7946.0958 +12 +123456789012345678", "é@é.com ü+1 23 45 67 89", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0" * 3, "@" * 50 + "9" * 5000, "x" * 5000 + "@", "a@b-.c. 1.1.1.1@x.y",
]


def test_private_spans(spark, rows, none):
    rng = random.Random(9)
    texts = TRICKY + ["".join(rng.choice("ab1230.@+- ()é_%") for _ in range(200)) for _ in range(150)] + [None, "", *[t for _, t in rows[:10]]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = private.find(df, Scratch(spark, "t")).select("doc_id", private._listed("base").alias("base"), "row_key").collect()
    assert {r["doc_id"]: r["base"] for r in out} == {i: ",".join(f"{k}:{s}:{e}" for s, e, k in brute.private(t)) for i, t in enumerate(texts)}
    assert private.find(none, Scratch(spark, "t")).count() == 0


def _chance(n_te, n_t, n_e, n):
    return (n_te + private.PRIOR * n_e / n) / (n_t + private.PRIOR)


def test_disclosing_pairs_are_those_of_the_counts(spark):
    """All pairs by brute force: entities and terms of each document, and the smoothed chance."""
    rng = random.Random(21)
    docs, n = [], 300
    for i in range(n):
        terms = {f"t{rng.randrange(40)}" for _ in range(6)} | ({f"rare{i // 4}"} if i % 3 else set())
        docs.append((i, sorted({f"e{i // 4}", f"@{i % 7}"}) if i % 5 else [], sorted(terms)))
    found = spark.createDataFrame(docs, "row long, entities array<string>, terms array<string>")
    n_e, n_t, n_te = Counter(), Counter(), Counter()
    for _, es, ts in docs:
        n_e.update(es)
        n_t.update(ts)
        n_te.update(itertools.product(es, ts))
    want = set()
    for (e, t), k in n_te.items():
        p = _chance(k, n_t[t], n_e[e], n)
        if p >= 2**-private.RESIDUAL and np.log2(p * n / n_e[e]) >= private.GAIN:
            want.add((e, t, n_e[e], n_t[t], k))
    got = private.disclosing(found, Scratch(spark, "t"))[0]
    assert {tuple(r) for r in got.select("entity", "term", "n_e", "n_t", "n_te").collect()} == want and len(want) >= 20


def test_terms_are_counted_before_they_are_shuffled(spark):
    """Of 60,000 terms at their places, tasks hand out one for each that they have seen, though no join is broadcast."""
    common = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    docs = [(i, ["e"] if i < 4 else [], [*common, "grubnik"] if i < 4 else common) for i in range(400)]
    found = spark.createDataFrame(docs, "row long, entities array<string>, terms array<string>").repartition(4).cache()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("disclosing", "")
    try:
        got = private.disclosing(found, Scratch(spark, "t"))[0].collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in got] == [("e", "grubnik", 4, 4, 4)]
    jsc, tracker = spark.sparkContext._jsc.sc(), spark.sparkContext.statusTracker()
    jsc.listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in tracker.getJobIdsForGroup("disclosing") for s in tracker.getJobInfo(j).stageIds}
    written = sum(jsc.statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 0 < written < 10_000


def test_disclosing_terms_are_generalised_and_plain_documents_left_alone(spark):
    told = [(i, f"common words here Grubnik writes to box{i % 2}@mail.org with common words", "x") for i in range(8)]
    plain = [(100 + i, f"common words here and there number writes with {i}", "x") for i in range(40)]
    df = spark.createDataFrame([*told, *plain, (None, None, None)], "doc_id bigint, text string, spans string")
    out = {r["doc_id"]: r for r in private.redact(df, Scratch(spark, "t")).collect()}
    assert df.columns == ["doc_id", "text", "spans"] and len(out) == 49
    assert all(out[i]["text"] == t for i, t, _ in plain) and out[None]["text"] is None
    # the name tells the domain that both addresses share
    assert all(out[i]["text"] == "common words here [TERM] writes to [EMAIL] with common words" for i, _, _ in told)


def test_disclosing_terms_far_from_the_entity(spark):
    filler = " ".join(["common words here and there"] * 40)
    told = [(i, f"Grubnik writes to me@mail.org. {filler} later GRUBNIK lives in 漢字漢字{'かな' * 70}, {filler} Quorble") for i in range(4)]
    rest = [(100 + i, f"later common words here and there number writes lives with {i}") for i in range(40)]
    alone = [(200, "Zarnok beside other@box.org only once"), (201, None)]
    df = spark.createDataFrame([*told, *told[:1], *rest, *alone], "doc_id bigint, text string")
    got = private.redact(df, Scratch(spark, "t")).collect()
    out = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == 47
    for i, _ in told:
        assert out[i] == f"[TERM] writes to [EMAIL]. {filler} later [TERM] lives in [TERM], {filler} [TERM]"
    assert all(out[i] == t for i, t in rest) and out[200] == "Zarnok beside [EMAIL] only once" and out[201] is None


def test_secrets_many_spans_and_repeated_rows(spark):
    many = " ".join(f"u{i}@h{i % 3}.org" for i in range(3000))
    texts = ['it is password=e3b3ed3cc8548923d6 and token = "0641917ea4e9" but token: nothing at all', many, many, "é" * 1500 + " a@b.cd " + "ü" * 700]
    df = spark.createDataFrame([(i // 2, t, [1], "m") for i, t in enumerate(texts)], "doc_id bigint, text string, base array<int>, terms string")
    found = private.find(df, Scratch(spark, "t")).select(private._listed("spans").alias("s"), F.size("base").alias("n")).collect()
    assert sorted(r["n"] for r in found) == [0, 1, 3000, 3000]
    assert [r["s"] for r in found if r["n"] == 0] == ["secret:6:33,secret:38:60"]
    assert [r["s"] for r in found if r["n"] == 1] == ["email:1501:1507"]
    out = sorted(r["text"] for r in private.redact(df, Scratch(spark, "t")).collect())
    assert out == sorted(["it is [SECRET] and [SECRET] but token: nothing at all", *[" ".join(["[EMAIL]"] * 3000)] * 2, "é" * 1500 + " [EMAIL] " + "ü" * 700])


def test_bpe(spark, docs, rows, none):
    import public_tokenizers
    import tiktoken

    ranks, pattern = bpe.default_ranks()
    own = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    assert pattern == public_tokenizers.PATTERN
    odd = [(1000, "x  y\n\n z " * 30_000), (1001, "<|endoftext|> é\U0001f600‍" * 50), (1002, " " * 300 + "a")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string")).withColumn("token_ids", F.lit(1)).withColumn("decoded", F.lit(1))
    out, ids, decoded = bpe.encode_decode(df, ranks, pattern)
    got = {r["doc_id"]: (r[ids], bytes(r[decoded])) for r in out.collect()}
    assert got == {i: (own.encode_ordinary(t or ""), (t or "").encode()) for i, t in [*rows, *odd]}
    assert bpe.encode_decode(none, ranks, pattern)[0].count() == 0


def test_mixing(spark, docs, rows, none):
    source = {i: (f"s{i % 4}" if i % 5 else None) for i, _ in rows}
    size = {i: len(brute.WORD.findall(t or "")) for i, t in rows}
    total = Counter()
    for i in size:
        total[source[i]] += size[i]
    want = brute.sources_targets(total)
    first = mixing.plan(docs, Scratch(spark, "t")).orderBy("doc_id").collect()
    assert [tuple(r) for r in first] == [tuple(r) for r in mixing.plan(docs.repartition(7), Scratch(spark, "t")).orderBy("doc_id").collect()]
    taken = Counter()
    for r in first:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    biggest = {s: max(size[i] for i in size if source[i] == s) for s in total}
    assert all(abs(taken[s] - want[s]) <= biggest[s] / 2 for s in total)
    out = mixing.mix(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: len(r["times"]) for r in first if r["times"]})
    twice = docs.where("doc_id < 9").union(docs.where("doc_id < 9"))
    plan = mixing.plan(twice, Scratch(spark, "t"))
    assert mixing.mix(twice, Scratch(spark, "t")).count() == plan.select(F.sum(F.size("times"))).first()[0]
    assert mixing.plan(none, Scratch(spark, "t")).count() == mixing.mix(none, Scratch(spark, "t")).count() == 0


def test_targets_of_odd_sources(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 10, "d": 5}, {"a": 0}, {"a": 5, None: 7, "é": 1, "Z": 3}, {str(k): k * k for k in range(20)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        assert {r["source"]: r["target"] for r in mixing.targets(df).collect()} == pytest.approx(brute.sources_targets(sizes))


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(2)
    m = hmm.Model(*(x / x.sum(axis=-1 if k < 2 else 0, keepdims=True) for k, x in enumerate((rng.random(3), rng.random((3, 3)), rng.random((5, 3))))))
    seqs = [rng.integers(0, 5, n) for n in (1, 2, 6)]
    for s, got in zip(seqs, hmm.log_likelihood(m, seqs), strict=True):
        p = sum(m.pi[q[0]] * m.b[s[0], q[0]] * np.prod([m.a[q[t - 1], q[t]] * m.b[s[t], q[t]] for t in range(1, len(s))]) for q in itertools.product(range(3), repeat=len(s)))
        assert got == pytest.approx(np.log(p))
    long = [rng.integers(0, 5, n) for n in (700, 30, 1500)]
    assert hmm.log_likelihood(m, long) == pytest.approx(hmm.log_likelihood(m, long, short=10**6))


def test_expected_counts_by_enumeration():
    rng = np.random.default_rng(4)
    m = hmm.Model(*(x / x.sum(axis=-1 if k < 2 else 0, keepdims=True) for k, x in enumerate((rng.random(2), rng.random((2, 2)), rng.random((4, 2))))))
    seqs, want = [rng.integers(0, 4, n) for n in (5, 1, 3)], np.zeros(2 + 4 + 8)
    for s in seqs:
        paths = list(itertools.product(range(2), repeat=len(s)))
        p = np.array([m.pi[q[0]] * m.b[s[0], q[0]] * np.prod([m.a[q[t - 1], q[t]] * m.b[s[t], q[t]] for t in range(1, len(s))]) for q in paths])
        for q, w in zip(paths, p / p.sum(), strict=True):
            want[q[0]] += w
            for t in range(len(s)):
                want[6 + s[t] * 2 + q[t]] += w
                if t:
                    want[2 + q[t - 1] * 2 + q[t]] += w
    assert hmm.expected_counts(m, seqs) == pytest.approx(want, rel=1e-4)
    assert hmm.expected_counts(m, seqs, short=2, piece=2) == pytest.approx(want, rel=1e-4)  # cuts lose nothing
    long = [rng.integers(0, 4, n) for n in (900, 3, 520, 700)]
    assert hmm.expected_counts(m, long, short=512, piece=100) == pytest.approx(hmm.expected_counts(m, long, short=1000), rel=1e-3)
    for n in (3, 4, 9):
        one = [rng.integers(0, 4, n)]
        assert hmm.log_likelihood(m, one, short=2, piece=2) == pytest.approx(hmm.log_likelihood(m, one))


def test_likelihood_rises_with_every_round():
    rng = np.random.default_rng(5)
    texts = [np.append(rng.permutation(np.repeat([0, 1], 20) if i % 2 else np.repeat([2, 3], 300)), hmm.END) for i in range(60)]
    shares = np.bincount(np.concatenate(texts), minlength=hmm.CLASSES + 1) / sum(map(len, texts))
    m, got = hmm.Model.first(shares), []
    for _ in range(5):
        got.append(hmm.log_likelihood(m, texts).sum())
        m = hmm.Model.of(hmm.expected_counts(m, texts))
    assert all(b > a for a, b in itertools.pairwise(got))


def test_hmm_scores(spark, docs, rows, none):
    got = {r["doc_id"]: r for r in hmm.score(docs, Scratch(spark, "t"), rounds=3).collect()}
    count = Counter()
    for i, t in rows:
        if brute.crc(i, 10):
            count.update([*brute.WORD.findall(brute.lower(t)), None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*brute.WORD.findall(brute.lower(t)), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (brute.crc(i, 10) == 0, len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens))
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert hmm.score(none, Scratch(spark, "t"), rounds=1).count() == 0


def test_hmm_scores_by_brute_force(spark):
    """The whole score on repeated rows and a null id: the same rounds over all training texts in one piece, the last one by words."""
    rng = random.Random(13)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 700), 60))) for i in range(40)] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w3 W4"), (41, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 3)) for r in hmm.score(df, Scratch(spark, "t"), rounds=2).collect())
    hashed = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    texts = [[hashed(w) for w in brute.WORD.findall(brute.lower(t))] for _, t in rows]
    train = [t for (i, _), t in zip(rows, texts, strict=True) if brute.crc(i, 10)]
    count = Counter(w for t in train for w in t)
    size = np.zeros(hmm.CLASSES + 1)
    for w, c in count.items():
        size[w % hmm.CLASSES] += c
    size[hmm.END] = len(train)
    classes = lambda t: np.array([*(w % hmm.CLASSES for w in t), hmm.END])
    m = hmm.Model.first(size / size.sum())
    m = hmm.Model.of(hmm.expected_counts(m, [classes(t) for t in train], short=10**6))
    number = {w: i for i, w in enumerate(count)}
    k, v = hmm.STATES, len(number)
    own = hmm.Model(m.pi, m.a, np.array([m.b[w % hmm.CLASSES] for w in number] + [m.b[hmm.END]]))
    flat = hmm.expected_counts(own, [np.array([*(number[w] for w in t), v]) for t in train], short=10**6)
    last = hmm.Model.of(flat)
    n = flat[k + k * k :].reshape(-1, k)
    c = np.array([count[w] for w in number])[:, None]
    n[:-1] = np.floor(n[:-1] * hmm.LEVELS / c + 0.5) * c / hmm.LEVELS
    b = (np.vstack([n, np.zeros(k)]) + 0.1) / (n.sum(axis=0) + 0.1 * (v + 2))  # words, the end, and any unknown word
    assert b.sum(axis=0) == pytest.approx(np.ones(k))
    full = hmm.Model(last.pi, last.a, b)
    want = Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        s = hmm.log_likelihood(full, [np.array([*(number.get(w, v + 1) for w in t), v])], short=10**6)[0] / np.log(10)
        want[i, len(t) + 1, round(s, 3)] += 1
    near = lambda c: sorted((str(i), n, s) for (i, n, s), k in c.items() for _ in range(k))
    for a, b in zip(near(got), near(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.02)


def test_rules_count_what_the_contract_counts(spark, docs, rows, none):
    out = docs.select("doc_id", quality.rules_udf(None)(F.col("text")).alias("r")).select("doc_id", "r.*").collect()
    for r in out:
        want = brute.rules(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert r["kept"] == (not want[-1])
    assert quality.keep_good(none, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_fitted_verdicts_and_scores_are_the_trees_on_each_text(spark, write):
    """Both queries against the trees asked text by text; repeated ids with other texts, odd and very long texts, no labels, one class."""
    rng = random.Random(31)
    rows = [(i, " ".join(words(rng, rng.randrange(40, 160))) + (" $$ ###" * 30 if i % 3 == 0 else "")) for i in range(150)]
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[3][1]), (200, None), (201, ""), (202, " ".join(words(rng, 40_000)))]
    folder = write("documents", rows, "doc_id bigint, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for labels in ([(i, int(i % 3 != 0)) for i in range(150)] + [(7, 0), (None, 1), (8, None)], [(i, 1) for i in range(150)], []):
        write("labels", labels, "doc_id bigint, quality int")
        own = spark.read.parquet(f"{folder}/labels.parquet")
        rules, trees = quality.fit_rules(docs, own), quality.fit_classifier(docs, own)
        want_rules, want_scores = Counter(), Counter()
        for i, t in rows:
            f = np.array([stats.describe((t or "").encode())[1]], float)
            base = brute.rules(t)
            want_rules[i, base[0], (not base[-1]) and (rules is None or bool(rules.score(f)[0] >= quality.KEEP_AT))] += 1
            s = float(trees.score(f)[0])
            want_scores[i, brute.crc(i, 4) == 2, round(s, 9), int(s >= 0.7)] += 1
        assert Counter((r["doc_id"], r["n_words"], r["kept"]) for r in quality.quality_rules(spark, folder).collect()) == want_rules
        assert Counter((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in quality.quality_classifier(spark, folder).collect()) == want_scores
    assert not any(kept for (i, _, kept) in want_rules if i in (200, 201))


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(float)
    free, bound = boost.fit(x[:2000], y[:2000]), boost.fit(x[:2000], y[:2000], monotone={0: 1, 1: -1})
    for m in (free, bound):
        assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    grid = np.repeat(rng.normal(size=(50, 4)), 40, axis=0)
    for f, s in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (s * np.diff(bound.raw(g).reshape(50, 40), axis=1) >= -1e-9).all()
    assert boost.fit(x[:0], y[:0]).score(x[:3]).tolist() == pytest.approx([0.5] * 3)
    assert (boost.fit(x, np.ones(3000)).score(x) > 0.9).all()


def test_classifier_ranks_held_out_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randrange(20, 200))) + (" *** ###" * 20 if i % 3 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, None), (None, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows] + [(None, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.fit_classifier(docs, labels)
    got = {r[0]: r[1] for r in docs.select("doc_id", quality.classifier_udf(model)(F.col("text"))).collect()}
    held = [i for i, _ in rows if brute.crc(i, 4) == 2]
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95
    assert len(stats.FEATURES) == stats.describe(b"a b")[1].__len__()


def test_rollups_replay_and_compact(spark, tmp_path):
    r = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    change = "kind string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"
    batch = lambda *rows: spark.createDataFrame(list(rows), change)
    first = batch(("insert", "a", "en", "v1", 10, 0), ("insert", "a", "en", "v1", 5, 0), ("insert", None, None, "v1", 7, 0))
    assert r.apply("b1", first) and not r.apply("b1", first)
    assert r.apply("b2", batch(("delete", "a", "en", "v1", 5, 0), ("revise", None, None, "v1", 9, 7), ("insert", "z", "en", "v2", 3, 0)))
    want = {("a", "en", "v1", 1, 10), (None, None, "v1", 1, 9), ("z", "en", "v2", 1, 3)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert not r.apply("b1", first) and {tuple(x) for x in r.totals().collect()} == want
    assert r.apply("b3", batch(("delete", "z", "en", "v2", 3, 0))) and r.apply("none", batch())
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want - {("z", "en", "v2", 1, 3)}
    r.vacuum()
    assert len(list((tmp_path / "r/snapshots").iterdir())) == 1 and not any((tmp_path / "r/deltas").iterdir())
    assert not r.apply("b2", first) and {tuple(x) for x in r.totals().collect()} == want - {("z", "en", "v2", 1, 3)}
    (tmp_path / "r/deltas/b4").mkdir(parents=True)  # a batch that was cut off
    assert r.apply("b4", batch(("insert", "z", "en", "v2", 1, 0)))


def test_totals_hold_every_document_by_ids_of_the_encoder(spark, write):
    texts = ["def f(x):\n    return x ** 2", "漢字かな交じり文" * 20, "$$$ ### ||| " * 9, "plain words", "plain words", "plain words", None, "", "a" * 70_000 + " b" * 40_000]
    rows = [(i, t, None if i == 3 else "en", f"s{i % 2}") for i, t in enumerate(texts)] + [(None, "plain words", "en", None)]
    folder = write("documents", rows, "doc_id bigint, text string, lang string, source string")
    enc, want = bpe.encoding(*bpe.default_ranks()), {}
    for _, t, lang, source in rows:
        for name, n in (("words-1", len(brute.WORD.findall(t or ""))), (rollups.BPE, len(enc.encode_ordinary(t or "")))):
            d, k = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = d + 1, k + n
    got = rollups.token_counts(spark, folder).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)
    write("documents", [], "doc_id bigint, text string, lang string, source string")
    assert rollups.token_counts(spark, folder).count() == 0


def test_nearest_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 16)) * rng.random((700, 1)) * 3
    v[300:340] = v[300]  # ties
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [float("inf")] * 16), (1005, []), (None, [1.0] * 16), rows[20], (1020, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<double>")
    got = {}
    for r in codes.search(df, Scratch(spark, "t")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    found = 0
    for q in range(0, 700, 20):
        s = []
        for e in v:
            total = 0.0  # sum() would compensate for rounding
            for a, b in zip(v[q].tolist(), e.tolist(), strict=True):
                total += a * b
            s.append(total)
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [i for i, _ in got[q]] == want
        assert [x for _, x in got[q]] == [s[i] for i in want]
        found += 1
    assert set(got) == set(range(0, 700, 20)) and found == 35
    assert codes.search(df.where("vec_id = 1000"), Scratch(spark, "t")).count() == 0
