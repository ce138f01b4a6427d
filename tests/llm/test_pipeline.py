import hashlib
import struct

import pytest
from edge import SF, docs, odd_rows, soup

import corpus_pipeline
from lapse.llm import bpe
from lapse.llm.queries import ORACLES, QUERIES, tokenizer_path

PASSAGE = soup(77, 70)


def rows():
    item = soup(88, 40)
    near = soup(91, 120).split()
    return [
        (1, f"{soup(1, 60)}\n{PASSAGE}\n{soup(2, 60)}"), (2, f"{soup(3, 60)}\n{PASSAGE}\n{soup(4, 60)}"),
        (3, " ".join(near)), (4, " ".join(near[:60] + ["changed"] + near[61:])), (5, f"{soup(5, 50)}\n{item}"), (6, "123 456"), (7, None),
        (8, soup(8, 200)),
    ], [(1, item)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts, items = rows()
    docs(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids, texts = df.columns, [], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder).cache()
        assert df.columns == columns, name
        ids.append(sorted(r["doc_id"] for r in df.collect()))
        texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in df.collect()}
    assert ids == [[1, 2, 3, 4, 5, 8]] * 2 + [[1, 2, 3, 5, 8], [1, 2, 3, 8]]
    assert PASSAGE in texts[1][0] and texts[2][0] == f"{soup(3, 60)}\n{soup(4, 60)}" and texts[2][1] == len(texts[2][0])


def test_run_equals_the_library_on_what_is_left(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = dict((i, x) for i, x, *_ in rows()[0])
    texts[2] = f"{soup(3, 60)}\n{soup(4, 60)}"
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == [1, 2, 3, 8]
    for i, r in got.items():
        ids = t.encode(texts[i], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_every_stage_takes_odd_rows_and_empty_tables(spark, folder):
    for rows_ in (odd_rows(), []):
        for name, stage in corpus_pipeline.STAGES:
            df = docs(spark, rows_, clash=True)
            out = stage(spark, df, folder)
            assert out.count() <= len(rows_)
            assert name == "bpe" or out.columns == df.columns


def test_registered():
    import __spark_entry__ as e
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_encoding_runs_on_short_batches_and_a_small_memo(spark, folder, monkeypatch):
    name, inner, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", bpe.round_trip, []

    def spy(df, path, *args, **kwargs):
        seen.append((int(spark.conf.get(name)), kwargs.get("memo", bpe.MEMO)))
        return inner(df, path, *args, **kwargs)

    monkeypatch.setattr(bpe, "round_trip", spy)
    out = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert seen and seen[0][0] <= 1_000 and seen[0][1] <= 100_000
    assert "MapInArrow" not in out._jdf.queryExecution().toString()  # written while batches are short, not left to the reader
