"""The corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing names, empty tables."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash

from tidemark.llm import decontaminate, language_model, line_dedup, passage_quality, quality_rules, sentencepieces, simhash, token_files, toxicity, warc

SCHEMA = "doc_id long, text string, key string, fp long, size int"
LONG = " ".join(f"w{i % 977}" for i in range(6000))
TEXTS = [
    None, "", "  \n\t", "One two three four five six seven", "one TWO three four five six seven", "one two three four five six eight", LONG, LONG + " tail",
    "shared line\nown a\nshared line ", "Shared line\nown b", "a#b $c\nrep rep rep rep rep rep rep rep rep rep rep rep", "déjà vu ▁ \U0001f600 <s> x\x00y",
    "ends here<|endoftext|> and  more\n\n<|endoftext|>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", i, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "k", 3, 1)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_sentencepiece_matches_library(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = ("n_tokens", "ids_sha256", "decoded_sha256")
    for r in sentencepieces.encode_documents(docs, path, outputs=out).collect():
        ids = lib.encode(TEXTS[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(lib.decode(ids).encode()))
    assert sentencepieces.encode_documents(none, path, outputs=out).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 3 else [words] if words else []
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(docs, none):
    prints = [brute_print(t) for t in TEXTS]
    root = list(range(len(TEXTS)))
    for _ in root:
        root = [min(root[j] for j in range(len(TEXTS)) if bin(prints[i] ^ prints[j]).count("1") <= 3) for i in range(len(TEXTS))]
    got = simhash.component_report(docs).collect()
    assert len(got) == len(TEXTS) + 1
    assert all((int(r["fingerprint"], 16), r["component_id"]) == (prints[r["doc_id"]], root[r["doc_id"]]) for r in got)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert simhash.component_report(none).count() == 0


def test_simhash_plan_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base for k in (0, 1, 2, 3, 4)]
    values = sorted({f - (1 << 64) if f >> 63 else f for f in flips})
    plan = simhash.make_plan(np.array(values, dtype=np.int64).view(np.uint64), len(values))
    assert sum(t + 1 for t in plan.thresholds) == 4
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), plan).collect()}
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    token_files.write_token_files(docs, path, str(tmp_path / "out"), end_id=0)
    got = token_files.read_token_files(spark, str(tmp_path / "out")).collect()
    at = 0
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = [*t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(got) == len(TEXTS) + 1


def test_line_dedup(docs, none):
    white = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(white).encode().lower().decode()
    all_texts = [*TEXTS, TEXTS[3]]
    seen = Counter(k for t in all_texts for k in {key(x) for x in (t or "").split("\n")})
    for r in line_dedup.line_report(docs, min_docs=2).collect():
        lines = (TEXTS[r["doc_id"]] or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < 2]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))
    first = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_docs=2, keep="first").collect()}
    assert first[8] == "shared line\nown a" and first[9] == "own b" and first[0] is None
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.line_report(none).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1200
    html = {1: None, 2: "", 3: "small", 4: "small", 5: big, 6: big, 7: big + "é"}
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in html.items()], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), min_bytes=1000)
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert set(got) == set(html)
    for i, h in html.items():
        body = (h or "").encode()
        want = ("revisit", 6) if i == 5 else ("response", None)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(body), hashlib.sha1(body).hexdigest(), *want)


def test_language_model(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in language_model.score_documents(docs).collect():
        words = tokens(TEXTS[r["doc_id"]])
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(words), sum(c[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_mixture_weights_rise_with_evidence():
    import numpy as np

    main = np.array([[90, 10, 0], [1, 0, 0]])
    held = np.array([[45, 5, 0], [0, 1, 1]])
    w = language_model.mixture_weights(main, held, np.array([1, 0]))
    assert w[1] > w[0]


ITEM = "which of the following rivers flows through the old town before it reaches the northern sea and its wide delta"


def test_decontamination(spark):
    near = ITEM.replace("wide", "large")
    rows = [(1, "intro words here " + ITEM.upper() + " and more"), (2, "start " + near + " end"), (3, "rivers flow through many towns before they reach the sea"), (4, None), (5, ""), (6, ITEM), (6, ITEM)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ITEM), (13, "")], "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert {r["doc_id"] for r in got} >= {1, 6} and not {r["doc_id"] for r in got} & {3, 4, 5}
    assert all(r["similarity"] == pytest.approx(1.0) and r["n_words"] == 20 for r in got if r["doc_id"] in (1, 6))
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {3, 4, 5} <= {r["doc_id"] for r in kept.collect()} and not kept.filter("doc_id in (1, 6)").count()
    assert decontaminate.contamination(docs, items.filter("item_id < 0")).count() == 0


def labelled(spark, column, good, bad, n=60):
    docs = spark.createDataFrame([(i, " ".join((good if i % 3 else bad)[(i + j) % 6] for j in range(80)), "x") for i in range(n)] + [(n, None, "x"), (n + 1, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(n)], f"doc_id long, {column} int")
    return docs, labels


GOOD, BAD = ["river", "harbour", "the", "stone", "quiet", "garden"], ["$$$", "##click", "9999", "||", "buy!!", "<<<"]


def test_quality_classifier(spark):
    docs, labels = labelled(spark, "quality", GOOD, BAD)
    model = passage_quality.fit_quality(docs, labels, held_out=None)
    got = passage_quality.score_quality(docs, model).collect()
    assert all(r["quality_ok"] == bool(r["doc_id"] % 3) for r in got if r["doc_id"] < 60) and all(0 <= r["quality_score"] <= 1 for r in got)
    blank = passage_quality.fit_quality(docs, labels.filter("doc_id < 0"), held_out=None)
    assert passage_quality.score_quality(docs, blank).filter("not quality_ok").count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark, "toxic", ["idiot", "stupid", "hate", "filth", "scum", "vile"], GOOD)
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert all(r["toxic"] == bool(r["doc_id"] % 3) for r in got if r["doc_id"] < 60)
    assert all(r["p_mild"] + 2 * r["p_severe"] == pytest.approx(r["expected_severity"], abs=1e-6) for r in got)


def brute_counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, k in Counter(grams).items() if k > 1}
    lines = [x for x in text.split("\n") if x.encode().split()]
    covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.apply_rules(docs, quality_rules.DecisionList()).collect()
    for r in got:
        want = brute_counts(TEXTS[r["doc_id"]])
        assert tuple(r[k] for k in names) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.apply_rules(none, quality_rules.DecisionList()).count() == 0
    d, labels = labelled(spark, "quality", GOOD, BAD, 200)
    rules = quality_rules.fit_quality_rules(d, labels)
    assert rules.rules and "IF " in rules.text()
    stop = quality_rules.fit_quality_rules(d, labels.filter("quality = 1"))
    assert stop.rules == () and stop.default  # labels of one class
    dropped = {r["doc_id"] for r in quality_rules.apply_rules(d, rules, repeat_percent=100).collect() if not r["kept"] and r["n_words"] > 9}
    assert dropped == {i for i in range(200) if i % 3 == 0}


def test_language_model_keeps_every_history(spark, monkeypatch):
    """Scores against brute force in which each word is a history of its own, far past the former 96 contexts."""
    import random

    import numpy as np

    rng = random.Random(3)
    follow = {i: [rng.randrange(900) for _ in range(3)] for i in range(900)}
    rows = []
    for i in range(260):
        walk = [rng.randrange(700)]
        while len(walk) < 60:
            walk.append(rng.choice(follow[walk[-1]]) if rng.random() < 0.8 else rng.randrange(900))
        rows.append((i, " ".join(f"w{x}" for x in walk)))
    tokens = lambda t: [*t.encode().split(), None]
    split = lambda i: zlib.crc32(str(i).encode()) % 10
    one, two = {"main": Counter(), "fold": Counter()}, {"main": Counter(), "fold": Counter()}
    for i, t in rows:
        if split(i):
            part = "fold" if split(i) == 1 else "main"
            words = tokens(t)
            one[part].update(words)
            two[part].update(zip([None, *words], words))
    c, pair = one["main"] + one["fold"], two["main"] + two["fold"]
    n, v = sum(c.values()), len(c)
    cells = [(int(math.log2(c[h])), two["main"][h, w] / max(1, one["main"][h]), (one["main"][w] + 0.1) / (sum(one["main"].values()) + 0.1 * (v + 1)), k) for (h, w), k in two["fold"].items()]
    b, high, low, k = (np.array(x) for x in zip(*cells))
    weight = np.full(64, 0.5)
    for _ in range(40):
        share = weight[b] * high
        weight = np.clip(np.bincount(b, k * share / (share + (1 - weight[b]) * low), 64) / np.maximum(np.bincount(b, k, 64), 1e-12), 1e-4, 1 - 1e-4)
    monkeypatch.setattr(language_model, "RANGE_BYTES", 1 << 10)  # many more ranges than partitions
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = language_model.score_documents(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = tokens(dict(rows)[r["doc_id"]])
        want = 0.0
        for h, w in zip([None, *words], words):
            lam = weight[int(math.log2(c[h]))] if c[h] else 0.0
            want += math.log10(lam * pair[h, w] / max(1, c[h]) + (1 - lam) * (c[w] + 0.1) / (n + 0.1 * (v + 1)))
        assert r["score"] == pytest.approx(want, rel=1e-4)


def test_decontamination_weighs_shared_templates(spark):
    """Items share template wording, texts hold an item's own part and another template: brute force over all anchored windows."""
    template = [f"t{i}" for i in range(31)]
    own = {i: [f"o{i}x{j}" for j in range(28)] for i in range(60)}
    bench = {i: template + own[i] for i in own}
    texts = {i: [f"z{i}y{j}" for j in range(31)] + own[i] for i in own} | {100 + i: template + [f"u{i}y{j}" for j in range(28)] for i in range(20)}
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    df = Counter(g for w in bench.values() for g in set(grams(w)))
    weight = {g: 1 + math.log(len(bench) / k) for g, k in df.items()}
    want = {}
    for d, words in texts.items():
        for i, item in bench.items():
            starts = {max(0, min(p - q, len(words) - len(item))) for p, g in enumerate(grams(words)) for q, h in enumerate(grams(item)) if g == h}
            for s in starts:
                n, has = Counter(grams(item)), Counter(grams(words[s : s + len(item)]))
                sim = sum(weight[g] * min(k, has[g]) for g, k in n.items()) / sum(weight[g] * k for g, k in n.items())
                if sim >= 0.7:
                    want[d, i] = max(sim, want.get((d, i), 0))
    assert len(want) == len(own)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in bench.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contamination(docs, items, threshold=0.7).collect()}
    assert got == pytest.approx(want)


def test_quality_classifier_fits_on_every_passage(spark):
    """The only sign of a bad text lies in passages between 48 evenly spaced ones."""
    passage = lambda vocabulary, i: " ".join(vocabulary[(i + j) % 6] for j in range(64))
    rows = [(i, " ".join(passage(BAD if not i % 2 and p % 2 else GOOD, i + p) for p in range(95))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = passage_quality.score_quality(docs, passage_quality.fit_quality(docs, labels, held_out=None)).collect()
    assert all(r["quality_ok"] == bool(r["doc_id"] % 2) for r in got)


def test_warc_keeps_files_small_and_shares_hot_payloads(spark, none, tmp_path):
    """Null and tied ids, a payload of a third of the rows, several files of a partition, an empty table."""
    big = ["<b>" + str(k) * 1500 for k in range(40)]
    rows = [(i, f"http://h/{i}\r\n", big[0] if i % 3 == 0 else big[i % 40]) for i in range(300)] + [(None, None, big[1]), (7, "x", None), (299, "y", big[299 % 40])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    warc.write_archives(pages, str(tmp_path / "a"), file_records=50)
    assert len(list((tmp_path / "a").glob("part-*"))) >= 6
    got = Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect())
    sha1 = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    last = {}
    for i, _, h in rows:
        last[sha1(h)] = max(last.get(sha1(h), -1), -1 if i is None else i)
    want = Counter(
        (i, sha1(h), "revisit", last[sha1(h)]) if h and i != last[sha1(h)] else (i, sha1(h), "response", None) for i, _, h in rows
    )
    assert got == want
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_warc_rejects_broken_archives():
    import zstandard

    record = warc.page_record(1, "u", b"<p>", hashlib.sha1(b"<p>").hexdigest(), False, None, "2024-01-01T00:00:00Z")
    frame = zstandard.ZstdCompressor().compress(record)
    head = warc.skippable_frame(warc.DICTIONARY_MAGIC, b"")
    whole = head + frame + warc.SEPARATOR.encode()
    assert [warc.page_row(warc.parse_record(f))["page_id"] for f in warc.read_frames(whole)] == [1]
    for broken in (frame, head + frame[:-3], head + b"junk", warc.skippable_frame(warc.DICTIONARY_MAGIC, b"abc")[:-1], head + frame[:8] + b"\xff" * 20):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(broken))
    for bad in (record[:-1], record.replace(b"WARC-Date", b"WARC-Type"), record.replace(b"WARC-Date", b"X-Date"), b"HTTP/1.1 200\r\n\r\n", record.replace(b"<p>", b"<q>")):
        with pytest.raises(warc.WarcError):
            warc.page_row(warc.parse_record(bad))


def test_components_of_a_long_chain(spark):
    from tidemark.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        components(edges, max_rounds=1)


def test_token_files_edges(spark, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(none, path, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(TypeError):
        token_files.write_token_files(none.selectExpr("text doc_id", "key text"), path, str(tmp_path / "bad"))
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(40)] + [(None, "no id")], "doc_id long, text string")
    token_files.write_token_files(docs, path, str(tmp_path / "few"), block_docs=4)
    got = token_files.read_token_files(spark, str(tmp_path / "few"), wanted=[3, 17], with_ids=True).collect()
    whole = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, str(tmp_path / "few")).collect()}
    assert whole[None][0] == 0 and {r["doc_id"] for r in got} == {3, 17}
    assert all((r["start"], r["n_tokens"], r["ids_crc32"]) == whole[r["doc_id"]] and len(r["ids"]) == r["n_tokens"] for r in got)
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "dict_sha256 string, dictionary binary").write.mode("overwrite").parquet(str(tmp_path / "few/dictionary"))
    with pytest.raises(ValueError):
        token_files.read_token_files(spark, str(tmp_path / "few"))


def test_language_model_without_rows_or_training(spark, none):
    assert language_model.score_documents(none).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = language_model.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r["held_out"] and r["train_tokens"] == 0 and r["base_score"] == pytest.approx(0.0) for r in got)


def test_attention_gradient():
    """The gradient against differences of the loss."""
    import numpy as np

    rng = np.random.default_rng(2)
    shapes = {"E": (6, 4), "e": (4,), "V": (4, 3), "U": (4, 3), "a": (3,), "c": (4,), "b": (1,)}
    w = {k: rng.normal(0, 0.5, s) for k, s in shapes.items()}
    x, starts, y = rng.normal(0, 1, (7, 6)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss(v):
        p = passage_quality._forward(v, x, starts)["p"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = passage_quality._gradient(w, x, starts, y)
    for k in w:
        for at in np.ndindex(w[k].shape):
            up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_quality_score_clash(spark):
    docs = spark.createDataFrame([(1, "one two", 5.0)], "doc_id long, text string, quality_score double")
    model = passage_quality.fit_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), held_out=None)
    with pytest.raises(ValueError):
        passage_quality.score_quality(docs, model)
    assert passage_quality.drop_poor(docs, model).collect()[0]["quality_score"] == 5.0


def test_ordinal_likelihood_and_edges(spark, none):
    """Thresholds and weights are a maximum of the cumulative-link likelihood; one class and no rows have a fixed result."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 2)).astype(np.float64)
    z = x @ [2.0, -1.0] + rng.logistic(0, 1, 400)
    grade = (z > 0.5).astype(int) + (z > 2)
    weights, theta = toxicity.fit_ordinal(x, grade, 3, l2=0.0, steps=1500, rate=0.02)

    def loss(w, t):
        up = 1 / (1 + np.exp(-(np.append(t, np.inf)[grade] - x @ w)))
        low = 1 / (1 + np.exp(-(np.append(-np.inf, t)[grade] - x @ w)))
        return -np.log(up - low).mean()

    best = loss(weights, theta)
    assert theta[0] < theta[1] and np.allclose(weights, [2, -1], atol=0.5)
    for i in range(2):
        for d in (-0.05, 0.05):
            step = np.eye(2)[i] * d
            assert loss(weights + step, theta) > best and loss(weights, theta + step) > best
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "bad word"), (1, "bad word"), (2, None)], "doc_id long, text string")
    assert all(r["toxic"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect())
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0


def test_decontamination_short_items_and_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "x alpha beta gamma y"), (3, "alpha"), (4, " ".join(["pad"] * 20_000) + " alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha, beta!"), (2, "one two three four five six")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (4, 1)}
