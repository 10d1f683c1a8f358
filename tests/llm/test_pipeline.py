"""The stages one after another on a small corpus, each against what it should do to its own input."""

import base64
import hashlib
import importlib.util
import re

import numpy as np
import public_tokenizers
import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_copies", "personal_data", "mixture", "encoded"]
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    apart = stages["near_copies"](spark, docs, SF)
    assert apart.columns == docs.columns and apart.select("text").distinct().count() == apart.count()
    private = stages["personal_data"](spark, docs, SF)
    assert private.columns == docs.columns and private.count() == docs.count()
    assert private.where("text rlike '555-'").count() < docs.where("text rlike '555-'").count()
    mixed = stages["mixture"](spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == docs.count()


def test_near_copies_with_repeated_and_null_ids(spark):
    import corpus_pipeline as p
    from inkwell.llm.ngram_join import ngram_jaccard_join

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a + " more"), (5, b), (5, b), (None, c), (None, c), (None, a), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in p.near_copies(spark, docs, SF).collect())
    assert got == [(0, c), (3, a), (5, b), (7, ""), (8, "")]
    out = sorted((r.doc_id, r.n_similar, r.component_id) for r in ngram_jaccard_join(docs.limit(3)).collect())
    assert out == [(3, 1, 3), (5, 0, 5), (5, 1, 3)]


def test_run(spark):
    import corpus_pipeline as p

    out = p.run(spark, SF)
    assert out.where("n_tokens <> size(ids)").count() == 0 and out.count() > 0


def test_no_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


FULL = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, __text string, mix_epoch int, home int"


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, and columns named like the operators' own."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    long = " ".join(f"word{i}" for i in range(150_000)) + " jo.doe@example.org"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " x", None, None, None), (None, None, None, None, None), (None, b + " y z", "en", "s", 1), (3, "", "en", "t", 0), (4, "   ", "en", "t", 3), (5, long, "en", "u", 9), (6, long, "de", "u", 9), (7, "idiot you idiot", "en", "s", 3), (8, "one", "en", "s", 3), (9, "call 212-555-0147 or 4111 1111 1111 1111", "en", "v", 1)]
    return spark.createDataFrame([(*r, 0.5, "t", 7, 3) for r in rows], FULL)


def test_stages_of_awkward_tables(spark):
    import corpus_pipeline as p

    docs = awkward(spark)
    stages = dict(p.STAGES)
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns and {1, 3, 4, 5, 6} <= {r.doc_id for r in kept.collect()}
    apart = stages["near_copies"](spark, docs, SF)
    assert apart.columns == docs.columns
    want = sorted(brute_near_copies([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert sorted(((r.doc_id, r.text) for r in apart.collect()), key=str) == want
    private = stages["personal_data"](spark, docs, SF)
    rows = {(r.doc_id, r.source): r for r in private.collect()}
    assert private.columns == docs.columns and private.count() == docs.count()
    assert "4111 1111" not in rows[9, "v"].text and "212-555-0147" not in rows[9, "v"].text and "jo.doe@" not in rows[5, "u"].text
    assert rows[5, "u"].text == rows[6, "u"].text and rows[None, None].text is None and rows[None, None].n_chars is None
    mixed = stages["mixture"](spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() >= docs.count()
    assert {(r.doc_id, r.text) for r in mixed.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    out = stages["encoded"](spark, docs, SF).collect()
    assert len(out) == docs.count() and all(r.n_tokens == len(r.ids) for r in out)


def brute_near_copies(rows):
    """Links between equal or similar word-pair sets; of each group the row of the least id, then of the least text."""
    rows = list(dict.fromkeys(rows))
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and 100 * len(x & y) >= 60 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    best = {}
    for g, (i, t) in zip(group, rows):
        best.setdefault(g, []).append((i is None, i or 0, i, t))
    return [min(x, key=lambda r: r[:2])[2:] for x in best.values()]


def test_run_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    import tiktoken
    from inkwell.llm import mixing, pii, queries, toxicity
    from inkwell.llm.common import utf8  # noqa: F401

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    machine = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), train_where=~queries.held_out(p.F.col("id")))
    import pyarrow as pa

    scores = machine.scores(*toxicity.text_terms(pa.array([t or "" for _, t, _ in rows])))
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    kept = set(brute_near_copies([r[:2] for r in rows]))
    rows = [(i, None if t is None else pii.pseudonymise(t, queries.pii_key(spark))[0], s) for i, t, s in rows if (i, t) in kept]
    tokens = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    names = sorted(tokens)
    alpha = mixing.bisect_alpha([tokens[s] for s in names], repetition=p.REPETITION)
    w = mixing.weights([tokens[s] for s in names], alpha)
    total = mixing.budget_for([tokens[s] for s in names], w, None)
    used = []
    for s, x in zip(names, w):
        budget = int(np.floor(total * x + 0.5))
        epochs, rest = divmod(budget, tokens[s])
        mine = [r for r in rows if r[2] == s]
        order = sorted(mine, key=lambda r: hashlib.md5(f"{mixing.SEED}|{epochs}|{s}|{r[0]}".encode()).hexdigest())
        before, more = 0, set()
        for r in order:
            if before < rest:
                more.add(r[0])
            before += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        used += [r for r in mine for _ in range(epochs + (r[0] in more))]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, enc.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in used)
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in p.run(spark, d).collect()) == want
