import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnmill.functions.tokens import pieces
from turnmill.operators import metrics
from turnmill.options import PackOptions
from turnmill.plans import catalog, packing
from turnmill.session import global_rank
from turnmill.sources import samples
from turnmill.streaming import live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(repr([clean(v[i]) for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r.v == r.pos for r in global_rank(df, "v").collect())


def chat_file(tmp_path, n=30):
    path = tmp_path / "chat.jsonl"
    lines = []
    for i in range(n):
        turns = []
        for k in range(1 + i % 5):
            turns += [{"role": "user", "content": f"question {i % 11 if k == 0 else i} {k} " + "x y " * (i % 9)}, {"role": "assistant", "content": f"answer {i} {k}"}]
        lines.append(json.dumps({"messages": turns}))
    path.write_text("\n".join([*lines, "broken {", ""]))
    return str(path)


def test_packing_run_and_resume(spark, tmp_path):
    src, out = chat_file(tmp_path), str(tmp_path / "out")
    options = PackOptions(max_len=64, holdout_head=5, shards=4, verify=6, resume=True)
    code, manifest = packing.run(spark, src, out, options)
    assert code == 0 and manifest["unparseable"] == 1 and manifest["verification"]["ok"]
    assert manifest["samples"] == samples.read(spark, out).count() > 0
    assert samples.read(spark, out).where(F.size("input_ids") > 64).count() == 0
    again, second = packing.run(spark, src, out, options)
    assert again == 0 and second["samples"] == manifest["samples"] and second["tokens"] == manifest["tokens"]
    assert samples.read_manifest(spark, f"{out}.manifest")["result"] == "PACK_OK"
    assert samples.merge(spark, out, f"{out}.one") == manifest["samples"]


def test_run_report(spark):
    rows = spark.createDataFrame([("r", i, 2.0 - i / 10) for i in range(10)], "run string, step int, loss double")
    got = json.loads(metrics.report(rows, rows.where("step % 3 = 0"), spark.createDataFrame([("r", 9)], "run string, n_train int")).first().report)
    assert got["verdict"] == "SFT_DDP_OK" and len(got["losses"]) == 10 and got["eval_hist"][-1]["step"] == 9


def test_stats_only_and_consent(spark, tmp_path):
    code, manifest = packing.run(spark, chat_file(tmp_path), str(tmp_path / "s"), PackOptions(stats_only=True, verify=0))
    assert code == 0 and manifest["raw_lengths"]["n"] > 0 and "samples" not in manifest
    with pytest.raises(ValueError):
        PackOptions(overlength="truncate")


def test_filter_lines(spark, tmp_path):
    kept, lost = packing.filter_lines(spark, chat_file(tmp_path), str(tmp_path / "f"), lambda c: F.array_join(pieces(c), "") == c)
    assert (kept, lost) == (30, 1)
    kept, lost = packing.filter_lines(spark, chat_file(tmp_path), str(tmp_path / "g"), lambda c: ~c.contains("answer 3 "))
    assert (kept, lost) == (29, 2)


def test_streams(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    losses = [1.0, 0.5, 0.8, 0.9, 0.95]
    (logs / "a.json").write_text("\n".join(json.dumps({"run": "r", "step": i, "eval_loss": v, "kind": "eval"}) for i, v in enumerate(losses)))
    out, state = str(tmp_path / "evals"), str(tmp_path / "state")
    for _ in range(2):
        q = live.watch(live.metric_stream(spark, str(logs)), out, state, 0.1, 3)
        assert q.awaitTermination(120)
    assert spark.read.parquet(f"{out}.verdict").first().stop_step == 4
