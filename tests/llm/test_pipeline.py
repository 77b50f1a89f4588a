"""The pipeline's stages, one by one and in a row, against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from slicetopo.llm import mixing, pieces

from .test_operators import SCHEMA, WORDS, brute_groups, prose

BAD = ("vilest", "foulmen", "rotwig")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: copies, toxic texts, personal data, odd rows."""
    rng = random.Random(77)
    rows = []
    for i in range(200):
        words = prose(rng, rng.randrange(20, 60)).split()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + ".")
        if i % 7 == 0:
            words.insert(3, f"u{i}@m.example.com")
        rows.append((i, " ".join(words), "xx", f"s{i % 3}", i))
    near = rows[1][1].split()
    near[-1] = WORDS[0]
    rows += [(300 + i, rows[1][1], "xx", "s0", 5) for i in range(9)] + [(400, " ".join([*near]), "xx", "s1", 5)]
    # One id with two texts, an id whose row stands twice, odd rows.
    rows += [(500, prose(rng, 40), "xx", "s0", 1), (500, prose(rng, 40), "xx", "s0", 2), (501, prose(rng, 30), "xx", "s1", 1)]
    rows += [rows[-1], (501, rows[-1][1], "xx", "s1", 0), (502, None, None, None, None), (503, "", "xx", "s2", 0), (None, prose(rng, 25), "xx", "s0", 3), (504, "word " * 3000, "xx", "s2", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(0.5), "predicted": F.lit("p"), "n_entities": F.lit(3), "spans": F.array(F.lit(1)), "h": F.lit(1)})
    clash.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(150)] + [(None, 1, 1), (7, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return folder, rows, clash.columns


def test_every_stage(spark, corpus):
    folder, rows, columns = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "", r["n_chars"] or 0)
    held = sorted(docs.collect(), key=key)
    # Toxic documents go, all others stay as they are.
    clean = P.toxic_out(spark, docs, folder)
    assert clean.columns == columns
    got = sorted(clean.collect(), key=key)
    assert got == [r for r in held if not set(re.findall(r"\w+", r["text"] or "")) & set(BAD)]
    # One of each group stays; of an id all texts stay, but equal ones once.
    once = sorted(P.one_of_near(spark, clean, folder).collect(), key=key)
    sets, group = brute_groups([r["text"] for r in got], 5, 80)
    least = {}
    for r, s, g in zip(got, sets, group, strict=True):
        if s and r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    gone = {r["doc_id"] for r, s, g in zip(got, sets, group, strict=True) if s and r["doc_id"] is not None and least[g] != r["doc_id"]}
    assert gone == {*range(300, 309), 400}
    left = [r for r in got if r["doc_id"] not in gone]
    assert Counter((r["doc_id"], r["text"]) for r in once) == Counter({(r["doc_id"], r["text"]): 1 for r in left})
    assert [r["n_chars"] for r in once if r["doc_id"] == 501] == [0]
    # Personal data is replaced, everything else stays.
    after = P.surrogates(spark, spark.createDataFrame(once, docs.schema), folder)
    assert after.columns == columns
    new = sorted(after.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_chars"] or 0))
    old = sorted(once, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_chars"] or 0))
    for a, b in zip(old, new, strict=True):
        mail = re.findall(r"u\d+@m\.example\.com", a["text"] or "")
        assert re.fullmatch(r"\S+@\S+\.example\.com".join(map(re.escape, re.split(r"u\d+@m\.example\.com", a["text"] or ""))), b["text"] or "")
        assert all(m not in (b["text"] or "") for m in mail) and b["n_entities"] == 3
    # Rows stand as often as the mix says.
    docs = spark.createDataFrame(new, docs.schema)
    plan = {(r["doc_id"], r["source"]): 0 for r in new}
    for r in mixing.mix_sources(docs).collect():
        plan[r["doc_id"], r["source"]] += r["copies"]
    mixed = P.mixture(spark, docs, folder)
    assert mixed.columns == columns
    assert Counter((r["doc_id"], r["source"]) for r in mixed.collect()) == Counter(plan) - Counter()
    # Pieces decode to the texts.
    out = pieces.decode_docs(P.encoded(spark, docs, folder))
    assert Counter(map(tuple, out.collect())) == Counter((r["doc_id"], r["text"] or "") for r in new)


def test_all_stages_in_a_row(spark, corpus):
    folder, rows, columns = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    want = Counter((r["doc_id"], r["ids_sha256"]) for r in docs.collect())
    got = P.run(spark, folder)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got.collect()) == want and got.where("not lossless").isEmpty()


def test_empty_tables(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
