import base64
import math
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, leakage, mojibake, neighbours, splits, tokenizer, truncation
from tidemark.llm import queries as llm_queries
from tidemark.operators.matching import token_distance

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(df):
    return {tuple(r) for r in df.collect()}


# 1: truncation

def texts(spark, captions):
    return spark.createDataFrame([("segments", f"v#{i}", "arm", t) for i, t in enumerate(captions)], "rec_table string, rec_key string, source string, text string")


def test_truncation_finds_cuts_only(spark):
    rng = random.Random(1)
    who, what, where = ["A farmer", "The cook", "A driver", "The host"], ["films", "holds", "cleans"], ["the ladder", "a long rope", "an umbrella"]
    whole = [f"{rng.choice(who)} {rng.choice(what)} {rng.choice(where)} in the kitchen" + rng.choice([".", ".", "", "…"]) for _ in range(400)]
    cut = ["A farmer films the lad", "The cook holds a long", "A driver cleans an umbrella in the kit…", "The host films the ladder in", "The host films the ladder in the ■"]
    odd = [None, "", "  ", "♪♪♪", "00:12", "Ünseen words alone", "A farmer films the ladder in the kitchen. " * 500]
    df = texts(spark, whole + cut + odd)
    found = rows_of(truncation.truncated(df.unionByName(df)).select("rec_key"))
    assert found == {(f"v#{i}",) for i in range(len(whole), len(whole) + len(cut))}
    share = truncation.source_shares(df, truncation.truncated(df)).first()
    assert (share.records, share.truncated) == (len(whole) + len(cut) + len(odd), len(cut))


def test_truncation_finds_cuts_inside_a_citation(spark):
    rng = random.Random(2)
    whole = [f"{rng.choice(['A farmer', 'The cook'])} {rng.choice(['films', 'holds'])} the ladder in the kitchen. [seg#{i}]" for i in range(400)]
    cut = ["The cook holds the ladder in the kitchen. [", "The cook holds the ladder in the kitchen ["]
    found = rows_of(truncation.truncated(texts(spark, whole + cut)).select("rec_key"))
    assert found == {(f"v#{i}",) for i in range(400, 402)}


def test_truncation_empty(spark):
    assert truncation.truncated(texts(spark, []).limit(0)).count() == 0


# 2: splits

def test_components_and_torn_groups_against_brute_force(spark):
    rng = random.Random(5)
    vids = [(f"v{i}", rng.choice(["c1", "c2", "n/a", "", None, f"own{i}", f"own{i}"]), rng.choice([f"s{i // 2}", "Unknown", None, "-"]), rng.choice([f"h{i % 70}", " pending "]), "x") for i in range(150)]
    vids += vids[:5]
    qs = [(f"q{i}", rng.choice([f"v{rng.randrange(170)}", f" V{rng.randrange(150)}.MP4 ", None, " "]), rng.choice(["train", " Train", "dev", "test", None, ""]), 1) for i in range(120)]
    v = spark.createDataFrame(vids, "video_id string, channel_id string, source_id string, file_sha256 string, component string")
    q = spark.createDataFrame(qs + qs[:9], "query_id string, video_id string, split string, node int")
    parent = {x[0]: x[0] for x in vids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k in (1, 2, 3):
        first = {}
        for x in vids:
            val = (x[k] or "").strip()
            if val and val.lower() not in splits.MISSING and any(c.isalnum() for c in val):
                parent[root(x[0])] = root(first.setdefault(val, x[0]))
    groups = {}
    for qid, vid, s, _ in qs:
        n = (vid or "").strip().lower().removesuffix(".mp4")
        if n:
            groups.setdefault(root(n) if n in parent else "?" + n, []).append((qid, (s or "").strip().lower()))
    want = {(i,) for g in groups.values() if len({s for _, s in g if s}) > 1 for i, _ in g}
    found = splits.grouped(q, v, "query_id", "video_id", ["channel_id", "source_id", "file_sha256"], "split")
    # The assignment keeps groups whole and comes near the shares.
    targets = spark.createDataFrame([("train", 0.6), ("dev", 0.2), ("test", 0.2)], "split string, share double")
    assigned = splits.assign(found, targets, bins=8, bucket_rows=10)
    assert rows_of(assigned.where("torn").select("record")) == want
    assert {r.within for r in splits.shares(assigned, targets, bins=8).collect()} == {True}
    got = dict(rows_of(assigned.select("record", "split")))
    for g in groups.values():
        assert len({got[i] for i, _ in g}) == 1
    biggest = max(len(g) for g in groups.values())
    for s, p in (("train", 0.6), ("dev", 0.2), ("test", 0.2)):
        assert abs(sum(x == s for x in got.values()) - p * len(got)) <= max(biggest, len(got) / 8) + 1


def test_differencing_balances():
    rng = np.random.default_rng(2)
    weights = rng.integers(1, 50, 300)
    tuples = [np.concatenate([[w], np.zeros(7)]).astype(float) for w in weights]
    loads, where = splits.difference(tuples)
    again = np.zeros(8)
    for w, p in zip(weights, where):
        again[p[0]] += w
    assert np.allclose(again, loads) and loads.max() - loads.min() <= 2


def test_splits_empty(spark):
    v = spark.createDataFrame([], "video_id string, channel_id string")
    q = spark.createDataFrame([], "query_id string, video_id string, split string")
    g = splits.grouped(q, v, "query_id", "video_id", ["channel_id"], "split")
    t = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert splits.assign(g, t).count() == 0


# 4: language

@needs_data
def test_language_held_out_accuracy_and_mixed(spark):
    seg = spark.read.parquet(f"{SF}/segments.parquet")
    model = language.fit(seg.where("idx % 2 = 0"))
    held = seg.where("idx % 2 = 1").select("caption", language.label_language(F.col("caption_lang")).alias("lang")).where("lang IS NOT NULL AND caption rlike '\\\\p{L}'").collect()
    single = [(r, model.stretches(r.caption)) for r in held]
    single = [(r, s) for r, s in single if len({x[1] for x in s}) == 1]
    assert sum(s[0][1] == r.lang for r, s in single) / len(single) > 0.93  # about 5 % of the labels are wrong
    got = [x[1] for x in model.stretches("The cook holds a long rope in the kitchen. Un perro marrón limpia la escalera en la cocina. 오래된 교실에서 농부가 삽을 들고 있다.")]
    assert got == ["en", "es", "ko"]
    assert [x[1] for x in model.stretches('창고 벽면에는 "EXIT 3" 글자가 적힌 삽이 놓여 있다.')] == ["ko"]
    for none in (None, "", " ", "♪♪", "12:30"):
        assert model.stretches(none) == []
    assert len(model.stretches("오래된 교실에서 농부가 " * 5000)) == 1


def test_label_spellings(spark):
    df = spark.createDataFrame([(x,) for x in ("ko-KR", " EN ", "Japanese", "zho", "und", "", None, "en_GB", "pt")], "l string")
    assert [r.a for r in df.select(language.label_language(F.col("l")).alias("a")).collect()] == ["ko", "en", "ja", "zh", None, None, None, "en", "pt"]


def test_language_without_labels(spark):
    rows = spark.createDataFrame([("v", 0, "가나다", None), ("v", 1, "words here", "und"), ("v", 2, None, None)], "video_id string, idx int, caption string, caption_lang string")
    labelled = rows.select("video_id", "idx", "caption", language.label_language(F.col("caption_lang")).alias("label"))
    assert language.stretches(labelled, language.fit(rows), ["video_id", "idx", "label"]).count() == 0


# 5: neighbours

def brute_mutual(ids, x, k, least):
    sims = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(sims, -2)
    top = {i: {ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(sims[a, j], 9), ids[j]))[:k] if sims[a, j] >= least} for a, i in enumerate(ids)}
    return {(a, b) for a in top for b in top[a] if a < b and a in top[b]}


def test_neighbours_recall_and_dirt(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 64))
    near = [base[i] / np.linalg.norm(base[i]) + rng.normal(size=64) * s / 8 for i in range(60) for s in (0.1, 0.2, 0.3)]
    x = np.concatenate([base, near])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    dirt = [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 8), (5003, [float("nan")] * 64), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + rows[:50] + dirt, "vec_id bigint, emb array<float>")
    got = {(a, b) for _, a, b in rows_of(neighbours.mutual(neighbours.similar_pairs(df, {"c": "emb"}, shard_rows=300)))}
    want = brute_mutual(list(range(len(x))), x, 5, 0.9)
    assert len(want & got) / len(want) >= 0.95 and len(want & got) / len(got) >= 0.95
    two = {(a, b) for _, a, b in rows_of(neighbours.mutual(neighbours.similar_pairs(df, {"c": "emb"}, shard_rows=60, coarse_most=4, slack=0.1)))}
    assert len(want & two) / len(want) >= 0.95 and len(want & two) / len(two) >= 0.95  # anchors in two levels


def test_search_returns_a_node_once():
    x = np.random.default_rng(4).normal(size=(1200, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, _ = neighbours.Graph(x).search(x[:200], 100)
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in found)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(found.tolist(), best.tolist())]) > 0.95


def test_neighbours_copies_and_empty(spark):
    v = np.random.default_rng(1).normal(size=64).tolist()
    df = spark.createDataFrame([(i, v) for i in range(400)], "vec_id bigint, emb array<float>")
    got = {(a, b) for _, a, b in rows_of(neighbours.mutual(neighbours.similar_pairs(df, {"c": "emb"})))}
    assert got == {(a, b) for a in range(6) for b in range(a + 1, 6)}  # ties go to the smaller id
    assert neighbours.similar_pairs(df.limit(0), {"c": "emb"}).count() == 0
    assert neighbours.similar_pairs(df.limit(1), {"c": "emb"}).count() == 0


def test_every_vector_gets_its_neighbours(spark):
    x = np.random.default_rng(8).normal(size=(1500, 64)) + np.repeat(np.random.default_rng(9).normal(size=(30, 64)), 50, axis=0)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[1400:] = x[7]  # more copies than are forwarded
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    dirt = [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 8), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + rows[:50] + dirt, "vec_id bigint, emb array<float>").coalesce(2)
    sims = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(sims, -2)
    want = {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -sims[i].round(6)))[:5])}
    got = [(i, j, r) for _, i, j, _, r in neighbours.all_nearest(df, {"c": "emb"}).collect()]
    assert len(got) == len(set(got)) == 5 * len(x) and len(want & set(got)) / len(want) > 0.999  # one shard: all compared
    split = [(i, j) for _, i, j, _, _ in neighbours.all_nearest(df, {"c": "emb"}, shard_rows=60).collect()]
    assert len(split) == len(set(split)) and {i for i, _ in split} == set(range(len(x)))
    assert len({(i, j) for i, j, _ in want} & set(split)) / len(want) >= 0.9  # 25 shards
    # Every tenth as a query, copies among them, in the graphs.
    some = [(i, j, r) for _, i, j, _, r in neighbours.all_nearest(df, {"c": "emb"}, every=10, ef=60).collect()]
    asked = {w for w in want if w[0] % 10 == 0}
    assert len(some) == len(asked) and {i for i, _, _ in some} == {i for i, _, _ in asked}
    assert len({(i, j) for i, j, _ in asked} & {(i, j) for i, j, _ in some}) / len(asked) >= 0.95
    assert neighbours.all_nearest(df.limit(0), {"c": "emb"}).count() == 0
    assert neighbours.all_nearest(df.limit(1), {"c": "emb"}).count() == 0


# 6: tokenizer

@pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary")
def test_tokenizer_equals_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", " ", "   \n\t ", "Hello, world's 123", "안녕하세요 세계", "<|endoftext|>", "a" * 3000, "ab" * 1500, "🎬​�", "".join(rng.choice("가나다漢字abcé 1\n") for _ in range(20000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "x"), (0, "", "y")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokenizer.encode(df, "doc_id", "text").collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)} | {99: []}
    assert tokenizer.encode(df.limit(0), "doc_id", "text").count() == 0


# 7: leakage

def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([4, 6, 8, 15, 30])))) for i in range(25)] + [(90, None), (91, ""), (92, "!!! --")]
    docs = []
    for i in range(120):
        words = rng.choices(vocab, k=rng.randrange(0, 60))
        if i % 3 == 0:
            w = items[rng.randrange(25)][1].split()
            a = rng.randrange(0, max(1, len(w) - 7))
            part = [x.upper() + rng.choice(["", ",", "​"]) for x in w[a:a + rng.choice([7, 8, 12])]]
            words = words[:10] + part + words[10:]
        docs.append((i, " \n".join(words)))
    docs += [(500, None), (501, ""), (502, "w1 " * 20000), docs[0]]
    want = set()
    for d, t in docs:
        w = leakage.words(t)
        for i, s in items:
            n = leakage.words(s)
            k = min(8, len(n))
            if k and {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} & {tuple(n[p:p + k]) for p in range(len(n) - k + 1)}:
                want.add((d, i))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(leakage.leaks(d, it).select("doc_id", "item_id")) == want
    assert leakage.leaks(d.limit(0), it).count() == 0 and leakage.leaks(d, it.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["changed", "put in", "left out"])
def test_edited_leaks_reach_target_recall(spark, kind):
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(4000)]
    items = [(i, " ".join(rng.sample(vocab, 8))) for i in range(200)]
    docs = []
    for i, t in items:
        w = t.split()
        p = rng.randrange(8)
        w[p:p + (kind != "put in")] = [] if kind == "left out" else ["other"]
        # Some documents hold nothing but the passage.
        docs.append((i, " ".join((rng.sample(vocab, 5) + w + rng.sample(vocab, 5)) if i % 4 else w)))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_edits=1)
    got = {(r.doc_id, r.item_id, r.edits) for r in got.collect()}
    assert all(a == b and e <= 1 for a, b, e in got) and len(got) >= 0.95 * len(items)


def test_registered_leaks_cover_edited_passages(spark, tmp_path):
    rng = random.Random(6)
    vocab = [f"u{i}" for i in range(60)]  # few words: phrases recur and many windows are alike
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 5, 6, 8, 12])))) for i in range(30)]
    docs = []
    for i in range(150):
        w = rng.choice(items)[1].split()
        p = rng.randrange(len(w))
        if i % 5:
            w[p:p + (i % 5 != 1)] = [] if i % 5 == 2 else ["other"]
        docs.append((i, " ".join(rng.choices(vocab, k=rng.randrange(9)) + w + rng.choices(vocab, k=rng.randrange(9)))))
    docs += [(i + 1000, t) for i, t in docs[:20]] + docs[:3] + [(5000, None), (5001, "!"), (5002, "u1")]
    want = {}
    for d, t in docs:
        w = leakage.words(t)
        for i, s in items:
            n = leakage.words(s)
            k = min(8, len(n))
            for a in range(len(n) - k + 1):
                for width in range(k - k // 5, k + k // 5 + 1):
                    for b in range(len(w) - width + 1):
                        e = token_distance(" ".join(w[b:b + width]), " ".join(n[a:a + k]))
                        if e <= k // 5:
                            want[d, i] = min(e, want.get((d, i), 9))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    exact = {k for k, e in want.items() if e == 0}
    assert len(want) > len(exact) + 50
    assert rows_of(llm_queries.queries()["p7_found"](spark, str(tmp_path))) == exact
    got = {(r.doc_id, r.item_id): r.edits for r in llm_queries.queries()["p7_edited"](spark, str(tmp_path)).collect()}
    assert got.keys() <= want.keys() and exact <= got.keys() and len(got) >= 0.95 * len(want)
    assert all(want[k] <= e <= 1 for k, e in got.items())


# 8: encoding

@needs_data
def test_repair_round_trip_and_margin(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = mojibake.train(docs.where("doc_id % 2 = 0"))
    clean = [r.text for r in docs.where("doc_id % 2 = 1").select("text").collect() if r.text and mojibake.is_clean(r.text)]
    assert mojibake.fit(docs)[1] == mojibake.MARGIN
    # Few true cases hide among the structurally clean texts.
    assert mojibake.validate(clean, model) < 0.02
    pure = [g[0] for g in mojibake.restore(clean, model) if not g[1]]
    hangul = [t.split("\n")[0] for t in pure if "다." in t.split("\n")[0]][:60]
    assert len(hangul) > 20
    for wrong, right in (("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("latin_1", "cp949")):
        broken = []
        for t in hangul:
            try:
                broken.append((t, t.encode(right).decode(wrong)))
            except UnicodeError:
                continue
        fixed = mojibake.restore([b for _, b in broken], model)
        assert sum(g[0] == t for (t, _), g in zip(broken, fixed)) >= 0.9 * len(broken), (wrong, right)
    none = mojibake.restore([None, "", "plain", "lost � here", "x" * 100000 + "é"], model)
    assert [g[1] for g in none] == [[]] * 5 and [g[2] for g in none] == [False, False, False, True, False]


def test_repair_is_fitted_on_every_text(spark, monkeypatch):
    clean = [f"Le garçon n° {i} a déjà mangé à côté de la forêt." for i in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean)] + [(9000, None), (9001, "")], "doc_id bigint, text string")
    for model, margin in (mojibake.fit(df), mojibake.fit(df.repartition(5))):
        assert margin == mojibake.MARGIN
        # Every letter and the end of its text.
        assert model.context.sum() == model.bi.sum() == sum(len(t) + 1 for t in clean)
    odd = df.union(spark.createDataFrame([(i, t.encode().decode(c)) for i, t in enumerate(clean[:40], 5000) for c in ("cp1252", "latin_1")][::2] + [(7000, "lost \ufffd é"), (None, "lost \ufffd")], df.schema))
    model, margin = mojibake.fit(odd)
    want = {(r.doc_id, r.restored, *r.chains, r.lost) for r in mojibake.repaired(odd, model, margin=margin).collect()}
    assert {(r.doc_id, r.restored, *r.chains, r.lost) for r in mojibake.fitted_repairs(odd).collect()} == want
    assert {i for i, *_ in want} == {*range(5000, 5040), 7000, None}
    monkeypatch.setattr(mojibake, "MOST_CHANGED", -1)  # the largest margin
    model, margin = mojibake.fit(odd)
    assert margin == mojibake.MARGINS[-1]
    want = {(r.doc_id, r.restored, *r.chains, r.lost) for r in mojibake.repaired(odd, model, margin=margin).collect()}
    assert {(r.doc_id, r.restored, *r.chains, r.lost) for r in mojibake.fitted_repairs(odd).collect()} == want


def test_repair_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    model = mojibake.train(df)
    assert mojibake.repaired(df, model).count() == 0
