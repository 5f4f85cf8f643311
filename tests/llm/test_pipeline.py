"""The whole pipeline on a small folder, each stage held against a plain version of its rule."""

import hashlib
import struct
from collections import Counter

import public_tokenizers
import xxhash


def fingerprint(text):
    words = text.encode().lower().split()
    grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 3 else [words] if words else []
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grams(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_pipeline(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    good, bad = ["river", "harbour", "the", "stone", "quiet", "garden"], ["$$$", "##click", "9999", "||", "buy!!", "<<<"]
    line = lambda i, n: " ".join(f"{good[(i * 7 + j * (i % 5 + 1)) % 6]}{(i * 31 + j * j) % 997}" for j in range(n))
    item = " ".join(f"question{j}" for j in range(25))
    texts = {i: line(i, 60) + "\nthis very line is shared\n" + line(i + 500, 40) for i in range(30)}
    texts |= {i: " ".join(bad[(i + j) % 6] for j in range(90)) for i in range(30, 60)}
    texts |= {60: texts[0], 61: texts[1] + " end", 62: line(901, 50) + " " + item + " " + line(902, 50), 63: line(903, 120)}
    rows = [(i, t, "en", "web", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {i: t for i, t in texts.items() if not 30 <= i < 60}
    holders = Counter(x.strip().lower() for t in left.values() for x in set(t.split("\n")))
    seen = set()
    for i in sorted(left):
        kept = []
        for x in left[i].split("\n"):
            if holders[x] < 10 or x not in seen:
                kept.append(x)
            seen.add(x)
        left[i] = "\n".join(kept)
    prints = {i: fingerprint(t) for i, t in left.items()}
    near = lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3
    root = {i: i for i in left}
    for _ in left:
        root = {i: min(root[j] for j in left if near(i, j)) for i in left}
    left = {i: t for i, t in left.items() if root[i] == i}
    want = grams(item)
    left = {i: t for i, t in left.items() if sum((grams(t) & want).values()) < 0.8 * sum(want.values())}
    assert 62 not in left and 63 in left and len(left) >= 30
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {}
    for i, t in left.items():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        expected[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == expected
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


def test_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, __tm_id int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0
