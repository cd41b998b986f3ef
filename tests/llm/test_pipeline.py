"""The pipeline's stages, each on what its predecessor kept."""

import random
from collections import Counter

import brute
import corpus_pipeline
from test_operators import words

from mnemoflow.llm import mixing
from mnemoflow.llm.common import Scratch


def test_stages_take_effect(spark, write):
    rng = random.Random(4)
    good = [" ".join(words(rng, rng.randrange(60, 200))) + f" box{i}@mail.org." for i in range(60)]
    bad = [" ".join(f"{w}***" for w in words(rng, 80)) for _ in range(30)]
    texts = [*good, *bad, good[0], good[1] + " more", None, "", "too short"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    folder = write("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write("labels", [(i, int(i < 60), 0) for i in range(90)], "doc_id bigint, quality int, toxic int")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/out{k}.parquet")
        docs = spark.read.parquet(f"{folder}/out{k}.parquet")
        seen.append(docs.toPandas())
        assert k == 4 or docs.columns == columns, name
    kept = set(seen[0].doc_id)
    assert kept >= set(range(60)) and not kept & set(range(60, 90)) and not kept & {92, 93, 94}
    near = brute.near([(i, texts[i]) for i in kept])
    assert sorted(seen[1].doc_id) == sorted(i for i in kept if near[i][2]) == list(range(60))
    assert not seen[2].text.str.contains("@").any() and seen[2].text.str.contains("[EMAIL]", regex=False).all()
    size = {r.doc_id: len(brute.WORD.findall(r.text)) for r in seen[2].itertuples()}
    source = {r.doc_id: r.source for r in seen[2].itertuples()}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
    for i in seen[3].doc_id:
        taken[source[i]] += size[i]
    want = brute.sources_targets(total)
    assert all(abs(taken[s] - want[s]) <= max(size.values()) / 2 for s in want)
    assert Counter(seen[4].doc_id) == Counter(seen[3].doc_id)
    assert sorted(corpus_pipeline.run(spark, folder).toPandas().doc_id) == sorted(seen[4].doc_id)


def test_positions_are_the_order_of_training(spark, write):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.randrange(5, 60))), "en", f"s{i % 3}") for i in range(90)]
    folder = write("documents", rows, "doc_id bigint, text string, lang string, source string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    dict(corpus_pipeline.STAGES)["mix"](spark, docs, folder).write.option("maxRecordsPerFile", 7).parquet(f"{folder}/mixed")
    out = corpus_pipeline.encode(spark, spark.read.parquet(f"{folder}/mixed"), folder).orderBy("position").collect()
    plan = mixing.plan(docs, Scratch(spark, "t")).collect()
    want = [i for _, _, i in sorted((t, r["row_key"], r["doc_id"]) for r in plan for t in r["times"])]
    assert [r["position"] for r in out] == list(range(len(want))) and [r["doc_id"] for r in out] == want
    assert sorted(set(want)) != want
    every = {r["doc_id"]: r["times"] for r in mixing.mixing_curriculum(spark, folder).collect()}
    assert every == {r["doc_id"]: r["times"] for r in plan} and any(len(t) == 2 for t in every.values())


def test_empty_documents(spark, write):
    folder = write("documents", [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write("labels", [], "doc_id bigint, quality int, toxic int")
    assert corpus_pipeline.run(spark, folder).count() == 0
