import random

import corpus_pipeline
from pyspark.sql import functions as F

from veritally.llm import secret_scan

from .data import sentence
from .test_dedup import brute_classes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(1)
    texts = [sentence(rng, 60) for _ in range(260)]
    for k in range(0, 200, 5):
        texts[k] += " vile scumbag filthy"
    for k in range(1, 40, 2):
        words = texts[k].split()
        words[5] = "changed"
        texts[200 + k] = " ".join(words)
    items = [sentence(rng, 15) for _ in range(4)]
    for k in (2, 102, 203):
        texts[k] += " " + items[k % 4]
    texts[7] += ' token = "abcdef0123456789abcdef01"'
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k < 200 and k % 5 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = [k for k in range(260) if "vile" not in texts[k]]
    assert sorted(kept["toxicity"]) == clean
    classes = brute_classes(clean, [texts[k] for k in clean])
    assert set(kept["near_dedup"]) == set(classes.values())
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {2, 102, 203}
    assert set(kept["secrets"]) == set(kept["decontamination"]) == set(kept["mixing"])
    redacted = kept["secrets"][7]
    assert redacted.text.endswith("[secret]\"") or redacted.text.endswith("[secret]")
    assert redacted.n_chars == len(redacted.text) and all(r.text == texts[k] for k, r in kept["secrets"].items() if k != 7)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {tuple(r) for r in whole.select("doc_id", "slot", "place", "text").collect()} == {(r.doc_id, r.slot, r.place, r.text) for r in kept["mixing"].values()}
    assert secret_scan.scan(whole.drop("found")).filter(F.size("found") > 0).count() == 0
