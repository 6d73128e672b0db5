import random
import re

import numpy as np

import corpus_pipeline
from pseudolake.llm import packing

from .test_decontaminate import brute as contaminated
from .test_pii import RULES, valid
from .test_simhash import brute_components, brute_fp


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(80)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(5, 60)), "en", "s") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s") for i in range(5)] + [(200, None, "en", "s"), (201, "", "en", "s")]
    items = [(1, say(14))]
    rows += [(300, say(5) + " " + items[0][1] + " " + say(5), "en", "s"), (301, say(5) + " a@b.cc and +1 (375) 555-4393 " + say(3), "en", "s")]
    toxic = [(400 + i, say(20) + " nastyish nastyly " + say(10), "en", "s") for i in range(20)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, 0) for i in range(60)] + [(i, 1, 1) for i, *_ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]

    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / f"{name}.out"))
        at = spark.read.parquet(str(tmp_path / f"{name}.out"))
        seen[name] = at.collect()
        assert name == "packing" or at.columns == docs.columns
    text = {r[0]: r[1] for r in rows + toxic}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert not kept & {i for i, *_ in toxic} and len(kept & {r[0] for r in rows}) >= 0.9 * len(rows)  # the model learns from 80 texts here
    near = brute_components([(i, brute_fp(text[i])) for i in sorted(kept)])
    kept = {i for i, c in near.items() if i == c}
    assert {r.doc_id for r in seen["simhash"]} == kept
    kept = {i for i, _, hit, _ in contaminated([(i, text[i]) for i in kept], items) if not hit}
    assert {r.doc_id for r in seen["decontamination"]} == kept and 300 not in kept
    assert {r.doc_id for r in seen["pii"]} == kept
    for r in seen["pii"]:
        assert not any(valid(k, m[0]) for k, p in RULES.items() for m in re.finditer(p, r.text or ""))
        assert r.doc_id == 301 or r.text == text[r.doc_id]
    ids = packing.encode([r.text for r in seen["pii"]])
    assert sum(r.length for r in seen["packing"]) == sum(len(np.frombuffer(x, "<u4")) for x in ids)
    assert {r.doc_id for r in seen["packing"]} == kept
