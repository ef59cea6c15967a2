"""Queries against plain versions of what they are to give, on the small tables."""

import base64
import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F


from spanforge.llm import classlm, difference_cover, kmeanstree, language, minhash, mixing, pieces, pipeline, registry, suffix_dedup, topk, toxicity, vectors
from spanforge.llm.common import importable, table


@pytest.fixture(scope="module")
def run(spark):
    importable(spark)
    return lambda name: registry.queries()[name](spark, SMALL).toPandas()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents").toPandas()


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_toxicity_on_what_was_held_out(run, spark):
    got = run("op1_toxicity").set_index("doc_id")
    assert all(got.held_out[i] == (fold(i, 4) == 2) for i in got.index) and got.score.between(0, 1).all()
    rng = random.Random(1)
    fresh = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    rows = [(f"{fresh()} plain words {fresh()} you idiot", 1) for _ in range(60)] + [(f"{fresh()} plain words {fresh()} for you", 0) for _ in range(60)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert "idiot" in lexicon.words and "words" not in lexicon.words
    score = toxicity.Scorer(lexicon, toxicity.grammar()).score
    aimed, plain, denied, said = score("you idiot"), score("idiot"), score("not an idiot"), score("she said idiot")
    assert aimed > plain > said > denied > 0 and score("nice day") == 0 and score("you, i will kill you") > score("kill time")


THREATS_FIRST = ["I will kill you", "we will hurt you", "burn your house", "wir töten dich", "wir vernichten euch und alle", "je vais brûler ta maison", "on va détruire votre vie", "voy a matar a tu hermano", "quemar tu casa"]


def test_threats_with_their_target_behind():
    score = toxicity.Scorer(toxicity.Lexicon({}, {}), toxicity.grammar()).score
    for text in THREATS_FIRST:
        assert score(text) >= toxicity.REJECT, text
    assert score("kill time") == score("kill time. you") == pytest.approx(0.02) and score("you, kill you") == score("kill you") == 0.5
    assert score("not kill you") == 0.25 and score("she said kill you") == pytest.approx(0.3) and 0.02 < score("i will not kill you") < toxicity.REJECT


def test_archives(run, spark):
    got = run("op2_warc").set_index("page_id")
    pages = table(spark, SMALL, "pages").toPandas()
    payloads = {i: (h or "").encode() for i, h in zip(pages.page_id, pages.html)}
    last = {}
    for i, p in payloads.items():
        last[p] = max(i, last.get(p, i))
    for i, p in payloads.items():
        row = got.loc[i]
        assert row.payload_bytes == len(p) and row.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert row.record_type == ("response" if last[p] == i else "revisit")


def test_top_k(run, spark):
    got = sorted(map(tuple, run("op3_topk")[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist()))
    v = table(spark, SMALL, "embeddings").toPandas()
    x, ids = np.floor(1024 * np.array(v.embedding.tolist(), float)).astype(int), v.vec_id.to_numpy()
    want = []
    for k in np.flatnonzero(ids % 100 == 0):
        s = x @ x[k]
        best = [j for j in np.lexsort((ids, -s)) if j != k][:10]
        want += [(int(ids[k]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)]
    assert got == sorted(want)


def test_mix(run, docs):
    got = run("op4_mixing")
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(docs.doc_id, docs.text)}
    source = dict(zip(docs.doc_id, docs.source))
    per = collections.Counter()
    for i, n in sizes.items():
        per[source[i]] += n
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, clamped = sum(per.values()), set()
    while True:
        level = (total - sum(3 * per[s] for s in clamped)) / sum(weight[s] for s in per if s not in clamped)
        more = {s for s in per if s not in clamped and weight[s] * level > 3 * per[s]}
        if not more:
            break
        clamped |= more
    taken = collections.Counter()
    for r in got.itertuples():
        assert r.size == sizes[r.doc_id] and r.source_size == per[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        target = 3 * per[source[r.doc_id]] if source[r.doc_id] in clamped else weight[source[r.doc_id]] * level
        assert math.isclose(r.target, target, rel_tol=1e-9)
        taken[source[r.doc_id]] += r.taken
    for r in got.itertuples():
        assert abs(taken[source[r.doc_id]] - r.target) <= 1
    assert sorted(map(tuple, run("op4_mixing").to_numpy().tolist())) == sorted(map(tuple, got.to_numpy().tolist()))


def test_mixed_documents_are_whole(spark):
    importable(spark)
    rows = [(k % 30, f"word{k % 30}\n" * (k % 7), "abc"[k % 3]) for k in range(90)] + [(99, "x y", "a")] * 7 + [(1, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter(map(tuple, mixing.mixed_documents(docs).collect()))
    own = collections.Counter(rows)
    sizes = lambda t: len(t.split())
    plan = {(r.source): r.target for r in mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    assert set(got) <= set(own) and all(got[r] <= 3 * own[r] for r in got) and all(got[r] == own[r] for r in own if not sizes(r[1]))
    for source, target in plan.items():
        assert abs(sum(n * sizes(r[1]) for r, n in got.items() if r[2] == source) - target) <= 6


def test_neighbours_reach_their_recall(run, spark):
    got = run("op5_neighbours")
    v = table(spark, SMALL, "embeddings").toPandas()
    x, ids = np.array(v.embedding.tolist(), float), v.vec_id.to_numpy()
    at, hits, n = {i: k for k, i in enumerate(ids)}, 0, 0
    for q, part in got.groupby("query_id"):
        s = x @ x[at[q]]
        best = {int(ids[j]) for j in [j for j in np.argsort(-s) if ids[j] != q][:20]}
        hits, n = hits + len(best & set(part.vec_id)), n + 20
        assert part.sort_values("rank")["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, s[[at[i] for i in part.vec_id]])
    assert hits / n >= 0.9


def test_encoding_is_the_library_s(run, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = run("op6_pieces").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        ids = lib.encode(t or "", add_eos=True)
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and got.span_bytes[i] == len((t or "").encode())


def test_spans_are_those_of_the_pieces():
    codec = pieces.Codec(pieces.default_model())
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n\t ▁🎉\0Zthe.​\r") for _ in range(rng.randrange(40))) for _ in range(400)]
    for t, (ids, n, edges) in zip(texts, codec.encode_batch(texts)):
        ids = list(map(int, ids.split(" ")))
        assert ids == codec.library.encode(t, add_eos=True) and codec.decode(ids) == codec.library.decode(ids)
        data = t.encode()
        assert len(edges) == n == len(ids) and edges[-1] == len(data) and (np.diff(edges) >= 0).all()
        for k, i in enumerate(ids[:-1]):
            piece = data[edges[k] : edges[k + 1]].replace("▁".encode(), b" ")
            assert piece == codec.table[i] or (k == 0 and b" " + piece == codec.table[i])


def test_character_map_takes_the_longest_prefix():
    import struct

    # a double array for "a" -> "x" and "ab" -> "yz", laid out by hand: units at offset ^ label
    units = [0] * 512
    units[0] = 1 << 10  # root, children at 0 ^ 1 ^ label
    a = 1 ^ 0x61
    units[a] = (0x61 | 1 << 8) | ((a ^ 256) << 10)
    units[256] = 1 << 31 | 0
    b = 256 ^ 0x62
    units[b] = (0x62 | 1 << 8) | ((b ^ 300) << 10)
    units[300] = 1 << 31 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0"
    own = pieces.CharacterMap(blob)
    assert own.longest(b"ac", 0) == (1, b"x") and own.longest(b"cab", 1) == (2, b"yz") and own.longest(b"q", 0) is None


@pytest.mark.parametrize("trim", [False, True])
def test_a_map_with_entries_end_to_end(spark, tmp_path, trim):
    """The registered model with the library's own NFKC map: ids, decoded texts and spans are the library's."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as file:
        model.ParseFromString(file.read())
    own = sentencepiece_model_pb2.ModelProto()
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = trim
    path = f"{tmp_path}/mapped.model"
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["Ｆｕｌｌ ｗｉｄｔｈ ﬁne ① ㍿ e\u0301 ½", "", "  two  blanks ", "plain"] + ["".join(rng.choice("aé ①ﬁＡ㌔z ½\u0301カ゛.") for _ in range(rng.randrange(30))) for _ in range(80)]
    importable(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.decode_documents(pieces.encode_documents(rows, path), path).collect()}
    assert len(pieces.Codec(path).map.units)
    for k, text in enumerate(texts):
        want = library.encode(text, return_type="proto")
        assert list(got[k].ids) == [*(p.id for p in want.pieces), library.eos_id()] and got[k].decoded == library.decode(list(got[k].ids))
        for p, start, end in zip(want.pieces, got[k].piece_starts, got[k].piece_ends):
            if not library.is_byte(p.id):
                assert (p.begin, p.end) == (start, end), (text, p.piece)


def test_languages_held_out(run, docs):
    got = run("op7_language").set_index("doc_id")
    lang = dict(zip(docs.doc_id, docs.lang))
    held = [i for i in got.index if fold(i, 3) == 1]
    assert all(got.held_out[i] == (fold(i, 3) == 1) for i in got.index) and got.score.between(0, 1).all()
    assert sum(got.lang_pred[i] == lang[i] for i in held) >= 0.95 * len(held)


def repeats(texts):
    where = collections.defaultdict(int)
    for t in texts:
        for k in range(len(t) - 399):
            where[t[k : k + 400]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if where[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        out.append(gone)
    return out


def expected(texts):
    for t, gone in zip(texts, repeats(texts)):
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        yield len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def check_repeats(spark, texts):
    importable(spark)
    info, partly = suffix_dedup.removed_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    spans = {r.doc_id: suffix_dedup._cover(len(r.text.encode()), r.low, r.high) for r in partly.collect()}
    whole = {r.doc_id: r.whole for r in info.collect()}
    for i, (t, (n, removed, runs, _)) in enumerate(zip(texts, expected([t.encode() for t in texts]))):
        own = [(0, n)] if whole[i] and n >= 400 else spans.get(i, [])
        assert (sum(b - a for a, b in own), len(own)) == (removed, runs), i


def test_repeated_strings_of_all_alignments(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage, exact = fresh(200), fresh(400).encode()[:400].decode(errors="ignore")
    texts = [fresh(60) + passage + fresh(50), passage[:500], fresh(10) + passage[37:480] + fresh(10), fresh(3) + exact + fresh(9), fresh(7) + exact + fresh(2), "ab " * 400, fresh(20) + "ab " * 300, fresh(300), passage + passage, exact[:-1], "z" * 399, "z" * 401, "z" * 1200]
    texts += [texts[0][:k] + "X" + texts[0][k:] for k in range(0, len(texts[0]), 97)] + [texts[7], texts[7]]
    check_repeats(spark, texts)


def branching_texts():
    """Passages that go on in several ways, some of which go on alike for a while longer."""
    rng = random.Random(12)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(12):
        passage, ways = fresh(370), [fresh(90) for _ in range(3)]
        texts += [fresh(30) + passage + way + fresh(rng.randrange(60, 160)) for way in ways for _ in range(2)]
    return texts


def test_the_suffix_order_decides(spark, monkeypatch):
    """With right ranks the result is brute force's; with ranks in any other order it is not."""
    texts = branching_texts()
    check_repeats(spark, texts)
    monkeypatch.setattr(suffix_dedup, "suffix_ranks", lambda strings, depth: strings.select("sid", F.transform("ts", lambda t, i: F.xxhash64("sid", i)).alias("ranks")))
    with pytest.raises(AssertionError):
        check_repeats(spark, texts)


@pytest.mark.parametrize("most", [2, 1_000])
def test_large_groups_go_another_way(spark, monkeypatch, most):
    """Above so many distinct contexts the runs of the rank order come from the scan over all tasks."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", most)
    check_repeats(spark, branching_texts()[:18] + ["ab " * 200, "ab " * 180])


def test_large_groups_of_shifted_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 3)
    rng = random.Random(3)
    passage = " ".join(str(rng.random()) for _ in range(40))
    check_repeats(spark, [str(rng.random()) * 4 + passage[k % 5 :] + str(rng.random()) for k in range(12)])


def test_members_of_large_groups_meet_one_row_each(spark, monkeypatch):
    """A context's starts are one row of ranges however many they are, so the members' join makes no more rows than members."""
    kept, store = {}, suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 3)

    def keep(df, name):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(suffix_dedup, "stored", keep)
    rng = random.Random(3)
    passage = " ".join(str(rng.random()) for _ in range(40))
    check_repeats(spark, [str(rng.random()) * 4 + passage[k % 5 :] + str(rng.random()) for k in range(12)])
    rows = kept["context-repeats"].toPandas()
    assert len(rows) and rows["context"].is_unique


def test_ranges_of_a_text_are_one_row(spark, monkeypatch):
    """Ranges stay arrays from a context to its members' texts: no row is made for each range of each member."""
    kept, store = {}, suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 3)

    def keep(df, name):
        if name == "ranges":
            kept["plan"] = df._jdf.queryExecution().executedPlan().toString()
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(suffix_dedup, "stored", keep)
    check_repeats(spark, branching_texts())
    rows = kept["ranges"].toPandas()
    assert len(rows) and rows["tid"].is_unique and rows["low"].map(len).max() > 1 and "Generate" not in kept["plan"]


@pytest.mark.parametrize("group", [1_000, 3])
def test_periodic_stretches_leave_few_anchors(spark, monkeypatch, group):
    """Anchors a period apart with the same bytes around them are a few suffixes however long the stretch is; each of their starts is found."""
    kept, store = {}, suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", group)

    def keep(df, name):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(suffix_dedup, "stored", keep)
    rng = random.Random(6)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = "a line of a licence that stands here again and again\n"
    texts = [fresh(500) + "ab " * 900 + fresh(450), fresh(300) + ("ab " * 140)[:401] + fresh(99), ("b a" * 140)[:400], fresh(420) + line * 60 + fresh(600), (line * 9)[7:410], fresh(90) + line * 8 + fresh(300), "xyxyz" * 700 + "q" + "xyxyz" * 300, "z" * 2_000 + fresh(30) + "z" * 900]
    check_repeats(spark, texts)
    assert sum(len(r.hs) for r in kept["hashed"].collect()) < 1_500


def test_repeats_of_the_query(run, docs):
    got = run("op8_suffix_dedup").set_index("doc_id")
    texts = [(t or "").encode() for t in docs.text]
    for i, want in zip(docs.doc_id, expected(texts)):
        row = got.loc[i]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == want


def test_suffix_ranks(spark):
    importable(spark)
    rng = random.Random(4)
    strings = {k: [rng.choice([1, 1, 2, 3]) for _ in range(rng.randrange(0, 15))] for k in range(20)} | {30: [1] * 19, 31: [1] * 17}
    got = {r.sid: r.ranks for r in difference_cover.suffix_ranks(spark.createDataFrame(list(strings.items()), "sid long, ts array<long>")).collect()}
    every = sorted(tuple(s[k:]) for s in strings.values() for k in range(len(s)))
    assert all(got[k] == [bisect.bisect_left(every, tuple(s[i:])) for i in range(len(s))] for k, s in strings.items() if s)


def test_language_model(run, docs):
    got = run("op9_class_lm").set_index("doc_id")
    split = {i: [*(t or "").encode().lower().split(), None] for i, t in zip(docs.doc_id, docs.text)}
    counts = collections.Counter(w for i, ws in split.items() if fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in split.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        row = got.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, fold(i, 7) == 2)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_scores_are_those_of_the_class_model(spark, docs):
    """The model's classes, read back and counted by plain means, give the query's scores; words sit where their neighbours want them."""
    importable(spark)
    split = {i: [*(t or "").encode().lower().split(), None] for i, t in zip(docs.doc_id, docs.text)}
    train = [ws for i, ws in split.items() if fold(i, 7) != 2]
    rows = table(spark, SMALL, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    counts = classlm.word_counts(rows.filter(~held)).persist()
    model = classlm.train(rows.filter(~held), counts)

    def token(w):
        h, shape, _ = classlm.tokens([w or b""])
        return (h[:1], shape[:1]) if w else (h[-1:], shape[-1:])

    words = {w for ws in split.values() for w in ws}
    own = {w: int(model.classes.of(*token(w))[0][0]) for w in words}
    assert own[None] == classlm.CLASSES - 1 and all(k < classlm.CLASSES - 1 for w, k in own.items() if w)
    n = collections.Counter(w for ws in train for w in ws)
    k, joint = classlm.CLASSES, np.zeros((classlm.CLASSES,) * 2)
    for ws in train:
        for a, b in zip([None, *ws[:-1]], ws):
            joint[own[a], own[b]] += 1
    prior = (joint.sum(axis=0) + 1) / (joint.sum() + k)
    step = np.log10((joint + classlm.PRIOR * prior) / (joint.sum(axis=1, keepdims=True) + classlm.PRIOR))
    size, kinds = np.zeros(k), np.zeros(k)
    for w, c in n.items():
        size[own[w]] += c
        kinds[own[w]] += 1
    got = {r.doc_id: r.score for r in classlm.score(rows.withColumn("held_out", held), model, counts).collect()}
    for i, ws in split.items():
        want = sum(step[own[a], own[b]] + math.log10((n[b] + 1) / (size[own[b]] + kinds[own[b]] + 1)) for a, b in zip([None, *ws[:-1]], ws))
        assert math.isclose(got[i], want, rel_tol=1e-6)
    # after any class the probabilities of all words and one unseen word of each class add up to 1 and no more
    mass = sum(10 ** step[5, own[w]] * (c + 1) / (size[own[w]] + kinds[own[w]] + 1) for w, c in n.items())
    assert 0.9 < mass <= 1 + 1e-9


def test_words_go_where_their_neighbours_are(spark):
    importable(spark)
    rng = random.Random(3)
    left, right = [f"l{k}a" for k in range(30)], [f"r{k}b" for k in range(30)]
    rows = spark.createDataFrame([(" ".join(rng.choice(left) + " " + rng.choice(right) for _ in range(200)) + " " + " ".join(f"{rng.choice(left)} odd{k}x" for k in range(3)),) for _ in range(60)], "text string")
    counts = classlm.word_counts(rows).persist()
    frequent = classlm.most_frequent(counts, 10**6)
    words = np.sort(frequent["h"].to_numpy(np.int64).view(np.uint64))
    hash_of = lambda w: classlm.tokens([w.encode()])[0][0]
    of = np.zeros(len(words), np.int64)
    own = {w: int(np.searchsorted(words, hash_of(w))) for w in [*left, *right, "odd0x"]}
    of[[own[w] for w in right]] = 1
    of[np.searchsorted(words, 0)] = classlm.CLASSES - 1
    of[own["odd0x"]] = 7
    classes = classlm.Classes(words, of, np.zeros(1 << 16, np.int64))
    fixed = np.ones(len(words), bool)
    fixed[own["odd0x"]] = False
    size, _ = classlm.class_sizes(counts, classes)
    chosen = classlm.likeliest(rows, classes, fixed, classlm.smoothed(classlm.class_bigrams(rows, classes)), size)
    assert chosen[own["odd0x"]] == 1 and (np.delete(chosen, own["odd0x"]) == np.delete(of, own["odd0x"])).all()


def test_rare_endings_go_where_their_neighbours_are(spark, monkeypatch):
    """Endings beyond the SHAPES don't share a class: each has that of the words outside the dictionary that end so."""
    importable(spark)
    monkeypatch.setattr(classlm, "SHAPES", 2)
    monkeypatch.setattr(classlm, "DICTIONARY", 61)
    monkeypatch.setattr(classlm, "SHARE", 10**9)
    rng = random.Random(3)
    left, right = [f"l{k}xa" for k in range(30)], [f"r{k}xb" for k in range(30)]
    rows = [" ".join(f"{rng.choice(left)} {rng.choice(right)}" for _ in range(150)) + f" u{n}q1 {rng.choice(right)} {rng.choice(left)} v{n}q2 {rng.choice(left)} {rng.choice(right)}" for n in range(60)]
    rows = spark.createDataFrame([(t,) for t in rows], "text string")
    counts = classlm.word_counts(rows).persist()
    classes = classlm.train(rows, counts).classes
    of = lambda w: int(classes.of(*(x[:1] for x in classlm.tokens([w.encode()])[:2]))[0][0])
    assert of("u1q1") in {of(w) for w in left} and of("v1q2") in {of(w) for w in right} and of("u1q1") != of("v1q2")


def test_language_filters_against_plain_sets(spark):
    importable(spark)
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60))
    rows = [(make(letters), lang) for lang, letters in (("a", "abcde"), ("b", "defgh"), ("c", "xyzab")) for _ in range(20)]
    filters = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    windows = lambda t: [(b"\n" + t.lower().encode() + b"\n" * 5)[k : k + 5] for k in range(len(t.encode()) + 2)]
    n = {lang: collections.Counter(g for t, x in rows if x == lang for g in windows(t)) for lang in "abc"}
    rate = {lang: {g: c / sum(n[lang].values()) for g, c in n[lang].items()} for lang in "abc"}
    want = {lang: {g for g, c in n[lang].items() if c > 1 and rate[lang][g] >= language.LEAST_RATE * max(r.get(g, 0) for r in rate.values())} for lang in "abc"}
    hashed = lambda g: language.mix(np.array([int.from_bytes(g, "little")], np.uint64))
    cells = {g: [int(p[0]) for p in language.probes(hashed(g))] for g in {g for s in n.values() for g in s}}
    bits = {lang: {at for g in want[lang] for at in cells[g]} for lang in "abc"}
    for k, lang in enumerate("abc"):
        assert {int(x) for x in np.flatnonzero(filters.cells[0] >> k & 1)} == bits[lang]
        assert math.isclose(filters.false_rate[k], (len(bits[lang]) / (1 << language.CELL_BITS)) ** language.PROBES)
    texts = [t for t, _ in rows[::7]]
    found, total = language.popcounts([t.lower().encode() for t in texts], filters)
    assert [[sum(all(at in bits[lang] for at in cells[g]) for g in windows(t)) for lang in "abc"] for t in texts] == found.tolist() and [len(windows(t)) for t in texts] == total.tolist()
    best, share = language.decide(np.array([[50.0, 30.0]]), np.array([100]), np.array([0.4, 0.1]))
    # 10 / 0.6 against 20 / 0.9 true n-grams
    assert best[0] == 1 and math.isclose(share[0], (20 / 0.9) / (20 / 0.9 + 10 / 0.6), rel_tol=1e-6)


def test_the_composed_grammar_against_plain_rules():
    scorer = toxicity.Scorer(toxicity.Lexicon({"fool": 0.9, "pest": 0.6}, {}), toxicity.grammar())
    rng, words = random.Random(4), ["fool", "pest", "kill", "burn", "you", "not", "said", "tree", "sky"]
    for _ in range(500):
        clause, calm = [rng.choice(words) for _ in range(rng.randrange(1, 9))], 1.0
        near, heard, aimed = 0, False, False  # words that a negation still reaches, a verb of saying, someone addressed
        for k, w in enumerate(clause):
            if w == "not":
                near = 3
                continue
            factor = (0.5 if near else 1.0) * (0.6 if heard else 1.0)
            if w in ("fool", "pest"):
                calm *= 1 - min(0.99, factor * 0.8 * (1.25 if aimed else 1.0) * {"fool": 0.9, "pest": 0.6}[w])
            if w in ("kill", "burn"):
                calm *= 1 - min(0.99, factor * (0.5 if aimed or "you" in clause[k + 1 :] else 0.02))
            near, heard, aimed = max(0, near - 1), heard or w == "said", aimed or w == "you"
        assert math.isclose(scorer.score(" ".join(clause)), 1 - calm, rel_tol=1e-9, abs_tol=1e-12), clause


def test_rare_words_come_from_the_join(spark, docs, monkeypatch):
    monkeypatch.setattr(classlm, "DICTIONARY", 50)
    importable(spark)
    rows = table(spark, SMALL, "documents").limit(40).withColumn("held_out", F.lit(False)).select("doc_id", "held_out", "text").persist()
    counts = classlm.word_counts(rows).persist()
    small = {r.doc_id: r for r in classlm.score(rows, classlm.train(rows, counts), counts).collect()}
    monkeypatch.setattr(classlm, "DICTIONARY", 10**6)
    for r in classlm.score(rows, classlm.train(rows, counts), counts).collect():
        assert r.n_known == small[r.doc_id].n_known and math.isclose(r.base_score, small[r.doc_id].base_score, rel_tol=1e-9)


def test_exchange_raises_the_likelihood():
    n, rng = classlm.HEAD + classlm.SHAPES + 2, np.random.default_rng(3)
    bigrams = np.zeros((n, n), np.int64)
    bigrams[0:6, 6:12], bigrams[6:12, 0:6] = rng.poisson(30, (6, 6)), rng.poisson(60, (6, 6))

    def likelihood(own):
        one = np.eye(own.max() + 1)[own]
        joint = one.T @ bigrams @ one
        h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return h(joint) - h(joint.sum(axis=0)) - h(joint.sum(axis=1))

    start, own = classlm.exchange(bigrams, 5, rounds=0), classlm.exchange(bigrams, 5)
    assert likelihood(own) > likelihood(start) and not set(own[:6]) & set(own[6:12])


def components(texts, width, percent):
    sets, parent = [], list(range(len(texts)))
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates(run, docs):
    got = run("op10_near_duplicates").set_index("doc_id")
    docs = docs.sort_values("doc_id").reset_index(drop=True)
    roots, sizes = components(docs.text.tolist(), 3, 85)
    for k, i in enumerate(docs.doc_id):
        row = got.loc[i]
        assert (row.n_shingles, row.component_id, row.kept) == (sizes[k], docs.doc_id[roots[k]], roots[k] == k)


def test_chains_of_near_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 6)
    importable(spark)
    rng = random.Random(6)
    words = [str(rng.random()) for _ in range(200)]
    texts = []
    for _ in range(40):  # each a few words from the one before
        texts.append(" ".join(words))
        words[rng.randrange(200)] = str(rng.random())
    texts += [" ".join(str(rng.random()) for _ in range(50)) for _ in range(10)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    roots, _ = components(texts, 3, 85)
    assert [got[k] for k in range(len(texts))] == roots


def test_large_groups_around_a_pivot(spark, monkeypatch):
    """A close group, two that overlap in part, hot sets and shared names."""
    importable(spark)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "HOT_ROWS", 3)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 6_000)
    rng = random.Random(8)
    base = [str(rng.random()) for _ in range(120)]
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(1 + k // 6):
            words[rng.randrange(120)] = str(rng.random())
        texts.append(" ".join(words))
    texts += [texts[0]] * 8 + [" ".join(str(rng.random()) for _ in range(30)) for _ in range(5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots, _ = components(texts, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(rows, 3, 85).collect()}
    assert [got[k] for k in range(len(texts))] == roots


def test_sets_of_one_name_are_told_apart(spark):
    sets = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (2, 7), (None, None)], "cid long, twin long")
    shared = minhash.shared_names(sets)
    got = [r.cid for r in minhash.told_apart(sets, shared).collect()]
    assert len({*got}) == 4 and got.count(2) == 2 and got.count(None) == 1 and 1 not in got


def test_pipeline(spark, docs):
    importable(spark)
    steps, now = {}, table(spark, SMALL, "documents")
    for name, stage in pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, SMALL).toPandas()) if name != "encoding" else stage(spark, now, SMALL)
        steps[name] = now.toPandas()
    clean = steps["toxicity"].sort_values("doc_id").reset_index(drop=True)
    roots, _ = components(clean.text.tolist(), 5, 80)
    assert sorted(steps["near_duplicates"].doc_id) == sorted(clean.doc_id[k] for k in set(roots))
    kept = steps["near_duplicates"]
    want = {i: (np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()).decode(errors="ignore") for i, t, gone in zip(kept.doc_id, kept.text, repeats([t.encode() for t in kept.text]))}
    assert dict(zip(steps["repeated_strings"].doc_id, steps["repeated_strings"].text)) == want
    assert steps["encoding"].round_trip.all() and len(steps["encoding"]) == len(steps["mixing"])


def test_tree_assigns_where_it_visits_first():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = kmeanstree.fit(x)
    own = tree.assign(x)
    assert tree.leaves > 4 and tree.visits(x, 1) == [[k] for k in own] and sorted(tree.visits(x[:1], tree.leaves)[0]) == list(range(tree.leaves))


def plain_search(rows, queries, k):
    """{query id: [(score, id), ...]} over (id, vector) rows; shorter vectors end in zeros."""
    width = max(len(v) for _, v in rows)
    even = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in rows]
    least = {}
    for i, v in even:
        if i in queries and (i not in least or tuple(v) < tuple(least[i])):
            least[i] = v
    return {i: sorted(((-float((v * q).sum()), j) for j, v in even if j != i))[:k] for i, q in least.items()}


def odd_vectors():
    """Ids stored twice with other vectors, copies of one vector under many ids and under one, vectors of other lengths."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-3, 9, 6).astype(float).tolist()) for i in range(300) for _ in range(2)]
    rows += [(i, [9.0] * 6) for i in range(300, 420)] + [(100, [8.0] * 6)] * 15 + [(500 + i, rng.integers(1, 9, i % 5).astype(float).tolist()) for i in range(20)]
    return rows


def test_top_k_with_repeated_ids_copies_and_lengths(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(topk, "ROWS", 50)
    rows = odd_vectors()
    table_ = vectors.even(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = collections.defaultdict(list)
    for r in topk.search(topk.choosable(table_, 10), table_.filter("vec_id % 50 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert dict(got) == plain_search(rows, set(range(0, 600, 50)), 10)


def test_neighbours_with_repeated_ids_copies_and_thin_leaves(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(kmeanstree, "LEAF", 4)
    monkeypatch.setattr(kmeanstree, "CELL", 64)
    monkeypatch.setattr(kmeanstree, "BLOCK", 3)
    rows = [r for r in odd_vectors() if any(r[1])]
    table_ = vectors.even(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    queries = table_.filter("vec_id % 50 = 0")
    index = kmeanstree.build(table_, queries, 20)
    want = plain_search(rows, set(range(0, 600, 50)), 20)
    index.visits = 1  # thin leaves: the walk goes on until 20 others are found
    found = kmeanstree.search(index, queries, 20).toPandas()
    assert (found.groupby("query_id").size() == 20).all() and set(found.query_id) == set(want)
    index.visits = index.tree.leaves
    got = collections.defaultdict(list)
    for r in kmeanstree.search(index, queries, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert dict(got) == want
