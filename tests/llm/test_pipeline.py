"""The pipeline's stages on a small table with planted cases, and its registration."""

import random

import __spark_entry__
import corpus_pipeline
from sieveguard.llm.common import table
from sieveguard.scratch import scratch_path

WORDS = {"en": [f"the{i}ing" for i in "abcdefghij"] + ["stone", "river", "hollow", "brisk"],
         "de": [f"sch{i}ung" for i in "abcdefghij"] + ["straße", "größe", "über", "keit"]}


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names


def test_stages_keep_clean_rows_and_drop_planted_ones(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for d in range(200):
        lang = rng.choice(["en", "de"])
        text = [rng.choice(WORDS[lang]) + rng.choice(letters) + rng.choice(letters)
                for _ in range(rng.randint(40, 120))]
        rows.append((d, " ".join(text), lang, rng.choice(["s0", "s0", "s1", None]), 0))
    item = " ".join(f"bench{rng.choice(letters)}{rng.choice(letters)}" for _ in range(30))
    leak = item.split()
    leak[7] = "changed"
    rows[10] = (10, rows[10][1] + " " + item, *rows[10][2:])
    rows[11] = (11, rows[11][1] + " " + " ".join(leak), *rows[11][2:])
    copies = [(500, rows[3][1], "en", "s1", 0), (501, rows[4][1] + " end", "en", "s1", 0), rows[5]]
    odd = [(600, None, "en", "s0", 0), (601, "", None, "s0", 0), (602, "12 34 !", "de", None, 0)]
    folder = scratch_path(spark, "tables")
    spark.createDataFrame(rows + copies + odd, "doc_id long, text string, lang string,"
                          " source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    docs = table(spark, folder, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
    assert seen[0] == sorted([r[0] for r in rows + copies])
    assert seen[1] == list(range(200))
    assert seen[2] == [d for d in range(200) if d not in (10, 11)]
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in final} <= set(seen[2])
    shards = {}
    for r in final:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    words = sum(len(r[1].split()) for r in rows if r[0] in seen[2])
    taken = sum(len(r["text"].split()) for r in final)
    assert abs(taken - 1.5 * words) < 0.03 * words
    empty = scratch_path(spark, "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
