"""Every stage of the pipeline against brute force on a small corpus."""

import random
from collections import defaultdict

import corpus_pipeline as cp

R = random.Random(6)
VOCAB = ["".join(R.choice("aeioutrnsl") for _ in range(R.randint(3, 7))) for _ in range(500)]


def text(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def test_stages(spark, tmp_path):
    docs, labels = [], []
    for i in range(150):
        t = text(120)
        if i % 5 == 0:
            t = " ".join(w for x in t.split() for w in ((x, "zquark") if R.random() < 0.1 else (x,))) + " zquark"
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [d for d in docs if d[0] % 5]
    item = text(30)
    docs.append((200, clean[0][1], "en", "s", 1))  # exact copy
    docs.append((201, text(100) + " " + item + " " + text(100), "en", "s", 1))
    docs.append((202, text(60) + " password=hunter2222 " + text(60), None, None, None))
    docs.append((203, None, None, None, None))
    docs.append((203, None, None, None, None))
    docs.append((None, text(80), None, None, None))
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    d, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        d = stage(spark, d, sf)
        d.write.parquet(f"{sf}/out{k}")
        d = spark.read.parquet(f"{sf}/out{k}")
        seen[name] = d
        if name != "pack":
            assert d.schema == spark.read.parquet(f"{sf}/documents.parquet").schema
    ids = {n: sorted(str(r.doc_id) for r in x.collect()) for n, x in seen.items()}
    everything = sorted(str(i) for i, *_ in docs)
    toxic = {str(i) for i in range(0, 150, 5)}
    assert ids["toxicity"] == [x for x in everything if x not in toxic]
    assert ids["near_duplicates"] == sorted(set(ids["toxicity"]) - {"200"})
    assert ids["decontaminate"] == [x for x in ids["near_duplicates"] if x != "201"]
    assert ids["secrets"] == ids["decontaminate"]
    masked = [r for r in seen["secrets"].collect() if r.doc_id == 202]
    assert "hunter2222" not in masked[0].text and "[SECRET]" in masked[0].text
    plain = {r.doc_id: r.text for r in seen["decontaminate"].collect()}
    assert all(r.text == plain[r.doc_id] for r in seen["secrets"].collect() if r.doc_id != 202)
    pieces = defaultdict(int)
    for r in seen["pack"].collect():
        pieces[r.doc_id] += r.length
    assert sorted(map(str, pieces)) == ids["secrets"]
    assert sorted(map(tuple, cp.run(spark, sf).select("doc_id", "start", "length").collect()), key=str) == sorted(map(tuple, seen["pack"].select("doc_id", "start", "length").collect()), key=str)
