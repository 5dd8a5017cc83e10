import hashlib
import os
from collections import Counter

import duckdb
import pytest
from helpers_llm import awkward, documents

import corpus_pipeline as P
from panelyard.llm import quality
from panelyard.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    documents(spark, awkward()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 5 != 0, 0) for k in range(40)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "int(quality) quality", "toxic").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    spark.createDataFrame([(1, awkward()[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_every_stage_keeps_the_columns_and_the_rows_it_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if number < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{folder}/stage{number}")
        before, docs = docs, spark.read.parquet(f"{folder}/stage{number}")
        assert docs.count() <= before.count() or number == 3
        if number == 2:
            assert docs.where("doc_id = 3").count() == 0 and before.where("doc_id = 3").count() <= 1
    assert {"shard", "slot"} <= set(docs.columns)
    assert docs.groupBy("text").agg({"shard": "min"}).count() == docs.select("text", "shard").distinct().count()


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    assert sorted(map(str, P.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def grams(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def one_per_class(rows):
    sets = {t or "": grams(t or "") for _, t, _ in rows}
    left, kept = set(sets), []
    while left:
        todo, found = [left.pop()], set()
        while todo:
            t = todo.pop()
            found.add(t)
            near = {u for u in left if sets[t] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])}
            left -= near
            todo += near
        kept.append(min((r for r in rows if (r[1] or "") in found), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())))
    return kept


def overlaps(text, item):
    a, b = (text or "").lower().split(), item.lower().split()
    for shift in range(1 - len(b), len(a)):
        agree = [k for k in range(max(shift, 0), min(shift + len(b), len(a))) if a[k] == b[k - shift]]
        if any(agree[j] - agree[i] >= 11 and j - i + 1 >= 0.75 * (agree[j] - agree[i] + 1) for i in range(len(agree)) for j in range(i + 8, len(agree))):
            return True
    return False


def mixed(rows):
    size = {r: len((r[1] or "").split()) for r in rows}
    total = {s: sum(size[r] for r in rows if r[2] == s) for s in {r[2] for r in rows}}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, words, open_ = {}, 1.5 * sum(total.values()), set(order)
    while full := {s for s in open_ if words / sum(weight[x] for x in open_) * weight[s] >= 2 * total[s]}:
        target |= {s: 2 * total[s] for s in full}
        words, open_ = words - sum(2 * total[s] for s in full), open_ - full
        if not open_:
            break
    target |= {s: words / sum(weight[x] for x in open_) * weight[s] for s in open_}
    out = Counter()
    for s in order:
        before, budget = 0, int(target[s])
        epochs = budget // total[s] if total[s] else 0
        text = lambda r: hashlib.md5((r[1] or "").encode()).hexdigest()
        spot = lambda r: hashlib.md5(f"mix|{'null' if r[0] is None else r[0]}|{text(r)}".encode()).hexdigest()[:15]
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (spot(r), size[r])):
            part = max(0, min(size[r], budget - epochs * total[s] - before))
            before += size[r]
            if size[r] and (times := epochs + (2 * part >= size[r])):
                out[r[:2]] += times
    return out


def test_run_equals_plain_python(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).select("_row.doc_id", "_row.text", "_row.source", "_score").collect()
    rows = [(r.doc_id, r.text, r.source) for r in scored if r._score >= quality.THRESHOLD]
    want = mixed([r for r in one_per_class(rows) if not overlaps(r[1], awkward()[3][1])])
    got = P.run(spark, folder).select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == want and want
    assert len({(r.text, r.shard) for r in got}) == len({r.text for r in got})
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_an_empty_table_passes_through(spark, folder, tmp_path):
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="shared tables not present")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = Q.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        plain = lambda x: None if x is None or x != x or str(x) == "<NA>" else (x if isinstance(x, (str, bool)) else round(float(x), 6))
        return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=str)

    assert rows(got) == rows(want)
