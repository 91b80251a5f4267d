from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.llm.packing import first_fit, pack, pack_group, token_sizes

DOCS = "doc_id long, text string, bin long, capacity string"
KINDS = "container_id int, purpose string, capacity_tokens int"


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_against_search(seed):
    r = random.Random(seed)
    cap = r.choice([7, 50, 1000])
    sizes = [r.randint(1, cap) for _ in range(r.choice([0, 1, 2, 300]))]
    free, want = [], []
    for s in sizes:
        at = next((i for i, f in enumerate(free) if f >= s), len(free))
        if at == len(free):
            free.append(cap)
        free[at] -= s
        want.append(at)
    assert first_fit(sizes, cap) == want


def test_group_with_cut_and_empty_documents():
    p = pack_group(np.array([1, 2, 3, 4]), np.array([25, 10, 0, 20]), 10)
    assert p.groupby("doc_id").tokens.sum().to_dict() == {1: 25, 2: 10, 3: 0, 4: 20}
    assert p.groupby("doc_id").pieces.first().to_dict() == {1: 3, 2: 1, 3: 1, 4: 2}
    assert p.groupby("bin").tokens.sum().max() <= 10
    assert p[p.doc_id == 1].sort_values("piece").start_token.tolist() == [0, 10, 20]


def test_whole_tables(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.choice([0, 3, 40, 99, 100, 101, 350]), 1, "c") for i in range(700)]
    rows += rows[:20] + [(None, "x", 1, "c"), (9000, None, 1, "c"), (9001, "ä" * 60, 1, "c")]
    kinds = spark.createDataFrame([(1, "a", 100), (1, "a", 100), (2, None, 300), (3, "c", None), (4, "d", 0)], KINDS)
    got = pack(spark.createDataFrame(rows, DOCS), kinds, group_items=200).toPandas()
    want = {i: len(t.encode()) for i, t, *_ in rows if i is not None and t is not None}
    for kind, cap in ((1, 100), (2, 300)):
        g = got[got.container_id == kind]
        assert g.groupby("doc_id").tokens.sum().to_dict() == want
        assert g.groupby("bin_id").tokens.sum().max() <= cap
        assert set(g[g.pieces > 1].doc_id) == {i for i, n in want.items() if n > cap}
        assert (g.groupby("doc_id").size() == g.groupby("doc_id").pieces.first()).all()
        assert g.tokens.sum() / (g.bin_id.nunique() * cap) > 0.9
    assert set(got.container_id) == {1, 2}


def test_empty(spark):
    kinds = spark.createDataFrame([(1, "a", 100)], KINDS)
    assert pack(spark.createDataFrame([], DOCS), kinds).count() == 0
    assert pack(spark.createDataFrame([(1, "x", 1, "")], DOCS), kinds.limit(0)).count() == 0


def test_tokens_of_a_public_tokenizer(spark):
    try:
        import public_tokenizers as P
    except ImportError:
        pytest.skip("no tokenizer files")
    df = spark.createDataFrame([(1, "Hello hello world", 1, ""), (2, "", 1, ""), (3, None, 1, "")], DOCS)
    got = {r.doc_id: r.n for r in df.select("doc_id", token_sizes(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).alias("n")).collect()}
    assert got == {1: 3, 2: 0, 3: None}
    packed = pack(df.where("text is not null"), spark.createDataFrame([(1, "a", 2)], KINDS), size=F.length("text").cast("long"))
    assert packed.where("doc_id = 1").agg(F.sum("tokens")).first()[0] == 17
