"""The pipeline on a small folder, stage by stage."""

import random

import corpus_pipeline
from lemnia.llm.decontaminate import find_contained
from lemnia.llm.secrets import scan_text

from .fixtures import documents, frame, words
from .test_dedup import linked
from .test_scans import SECRETS


def test_stages(spark, tmp_path):
    docs = [(i, t) for i, t in documents() if i is not None]
    pad = dict(docs)[0]
    docs += [(i, t + " " + dict(docs)[k]) for k, (i, t) in enumerate(SECRETS)]
    item = " ".join(pad.split()[5:45])
    docs += [(999, dict(docs)[20] + " " + item)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = df.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = df.select("doc_id", "text").collect()
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert sorted(df.columns) == sorted(columns)
        after = df.select("doc_id", "text").collect()
        if name == "quality":
            assert all(len((r["text"] or "").split()) >= 50 for r in after) and len(after) >= 25
        if name == "near_duplicates":
            want = {c for _, _, c in linked([tuple(r) for r in before])}
            assert sorted(r["doc_id"] for r in after) == sorted(want)
        if name == "decontamination":
            assert 999 not in {r["doc_id"] for r in after} and len(after) < len(before)
            assert find_contained(df, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).count() == 0
        if name == "secrets":
            assert len(after) == len(before) and not any(scan_text(r["text"])[0] for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in df.select("n_chars", "text").collect())
    pieces = corpus_pipeline.packing(spark, df, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == df.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()


def test_null_and_shared_ids(spark, tmp_path):
    r = random.Random(12)
    clean = [words(r, 120) for _ in range(30)]
    item = " ".join(clean[0].split()[10:40])
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(30)]
    docs = list(zip(ids, clean, strict=True))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = lambda stage, rows: sorted(x["text"] for x in stage(spark, frame(spark, rows), str(tmp_path)).collect())
    assert texts(corpus_pipeline.quality, docs + [(None, "too short"), (7, "short too")]) == sorted(clean)
    assert texts(corpus_pipeline.decontamination, docs) == sorted(clean[1:])
    copies = [(3, clean[0]), (None, clean[1] + " end"), (7, clean[2]), (7, clean[2])]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, docs + copies), str(tmp_path)).collect()
    want = [(3, clean[0]), *docs[1:]]
    assert sorted(((x["doc_id"], x["text"]) for x in got), key=repr) == sorted(want, key=repr)


def test_run_by_brute_force(spark, tmp_path):
    """All stages together, with null and shared ids, nulls and further columns, against plain versions of each."""
    import re
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from lemnia.llm.quality_rules import judge_quality

    docs = [*documents(9), *SECRETS]
    pad = next(t for i, t in docs if i == 3)
    docs += [(i + 1000, t + " " + pad) for i, t in SECRETS] + [(None, pad + " and more of it " * 3), (5, words(random.Random(1), 80))]
    item = " ".join(next(t for i, t in docs if i == 7).split()[3:40])
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # quality: its verdict is checked elsewhere; a row's text decides
    numbered = spark.createDataFrame([(k, t, "en") for k, (_, t) in enumerate(docs)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in judge_quality(numbered).collect() if r["kept"]}
    rows = [d for k, d in enumerate(docs) if k in kept]
    # near duplicates: of each component the least id, null last
    parts = {}
    for (_, _, comp), (i, t) in zip(sorted(linked([(k, t) for k, (_, t) in enumerate(rows)])), rows, strict=True):
        parts.setdefault(comp, []).append((i is None, i or 0, t))
    firsts = []
    for p in parts.values():
        p.sort(key=lambda x: x[:2])
        firsts.append((None if p[0][0] else p[0][1], {t for n, i, t in p if (n, i) == p[0][:2]}))
    grams = lambda t: {tuple(w[k : k + 5]) for w in [[x.lower() for x in t.split()]] for k in range(len(w) - 4)}
    firsts = [(i, {t for t in texts if len(grams(t) & grams(item)) < 0.75 * len(grams(item))}) for i, texts in firsts]
    firsts = [(i, texts) for i, texts in firsts if texts]
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))

    def redacted(t):
        spans = sorted((s, e) for _, s, e in scan_text(t)[1])
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += t[at:s] + "[REDACTED]"
            at = max(at, e)
        return re.sub(r"(\[REDACTED\])(?=\[REDACTED\])", "", out + t[at:])

    def checks(t):
        ids = tok.encode(redacted(t), add_special_tokens=False).ids + [0]
        return len(ids), tuple(zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[k : k + 1024])) for k in range(0, len(ids), 1024))

    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids_crc32"]))
    found = sorted(((i, n, tuple(c for _, c in sorted(p))) for (i, n), p in got.items()), key=repr)
    options = [(i, {checks(t) for t in texts}) for i, texts in firsts]
    assert len(found) == len(options)
    for i, allowed in options:
        assert any(f[0] == i and (f[1], f[2]) in allowed for f in found), i


def test_run_of_nothing(spark, tmp_path):
    from .fixtures import empty

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
