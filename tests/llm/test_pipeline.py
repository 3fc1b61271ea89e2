"""The pipeline against plain versions of its stages, its effects on planted rows, and its SQL queries."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from stratakv.llm import langid, mixing
from stratakv.llm.common import shared_dir, words_of
from stratakv.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from .test_text_ops import lines_brute, near_brute, rows, sha


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    outs = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, outs[-1], sf).write.parquet(path)
        outs.append(spark.read.parquet(path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert outs[-1].columns == columns
    raw, known, lined, single, mixed, encoded = [[r.asDict() for r in o.collect()] for o in outs]
    judged = {r["doc_id"]: r for r in rows(langid.identify(docs))}
    assert {r["doc_id"] for r in known} == {d for d, r in judged.items() if not r["ambiguous"]}
    assert len(known) >= 0.98 * len(raw)
    want = lines_brute([(r["doc_id"], r["text"]) for r in known])
    assert {r["doc_id"]: r["text"] for r in lined} == {d: t for d, (_, gone, t) in want.items() if not gone or words_of(t)}
    assert len(lined) < len(known)
    groups = near_brute([(r["doc_id"], r["text"]) for r in lined])
    assert {r["doc_id"] for r in single} == {c for _, _, c in groups}
    taken = Counter()
    for r in mixed:
        taken[r["doc_id"]] += len(words_of(r["text"]))
    assert taken == {r["doc_id"]: r["taken"] for r in rows(mixing.mix(outs[3])[1]) if r["taken"]}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    ids = Counter((r["doc_id"], sha(" ".join(map(str, library.encode(r["text"], add_special_tokens=False).ids)))) for r in mixed)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in encoded) == ids


def test_run_equals_its_stages_on_reruns(spark, sf):
    one, two = (Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) for _ in range(2))
    assert one == two


def test_run_on_odd_and_empty_tables(spark, odd, empty, tmp_path, monkeypatch):
    """The whole pipeline, and the columns between its stages; their rows are checked one by one elsewhere."""
    columns = []

    def watched(stage):
        def seen(spark, docs, sf_dir):
            columns.append(docs.columns)
            return stage(spark, docs, sf_dir)

        return seen

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert columns[-len(corpus_pipeline.STAGES) :] == [docs.columns] * len(corpus_pipeline.STAGES)
        assert (len(out) == 0) == (name == "empty")
        assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.collect()}
        assert all(r["n_tokens"] > 0 for r in out)


def test_steps_leave_no_tables(spark, sf):
    """A finished query leaves its result alone, a finished pipeline those of its stages."""
    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    got = QUERIES["op4_low_discrepancy_mix"](spark, sf)
    left = set(os.listdir(root)) - before
    assert len(left) == 1
    assert left.pop().startswith("op4-")
    assert got.count() > 0


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_match_their_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    c.execute(f"CREATE TABLE want AS {ORACLE_SQL[name]}")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(r[0] for r in c.execute("DESCRIBE want").fetchall())
    want = c.execute(f"SELECT {', '.join(columns)} FROM want").fetchall()
    assert Counter(tuple(r[k] for k in columns) for r in got.collect()) == Counter(want)
