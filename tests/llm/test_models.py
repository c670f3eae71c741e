"""Learned operators: held-out quality and edge cases."""

import math
import random
import zlib
from collections import Counter

import pytest

from tidalmark.llm import htmlwrap, langid, lm, toxicity

from llm_words import words

SPANISH = ("ción", "los", "ado", "que", "ja", "osa", "ñe")


def test_langid(spark, none):
    rows = [(i, words(i, 40) if i % 2 else words(i, 40, SPANISH), "en" if i % 2 else "es") for i in range(240)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en"), (1003, words(5, 4000), None), (None, words(5, 9), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("x", "y")
    got = {r["doc_id"]: r for r in langid.predict(df).collect()}
    truth = {d: lang for d, _, lang in rows}
    held = [r for d, r in got.items() if r["held_out"] and d is not None and d < 1000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    assert [got[d]["lang_pred"] for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "en"
    kept = langid.reject(df)
    assert kept.columns == df.columns and not {1000, 1001, 1002} & {r["doc_id"] for r in kept.collect()}
    assert langid.predict(none).count() == 0


def test_toxicity(spark, none):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = words(i, 50).split()
        if toxic:
            for _ in range(4):
                text.insert(r.randrange(50), r.choice(["grumbolt", "snarkish", "vexwort"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, words(9, 5000) + " grumbolt snarkish"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(df, lab).collect()}
    truth = dict(labels)
    held = [x for d, x in got.items() if d is not None and d < 1000 and x["held_out"]]
    assert all(x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held)
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[1002]["predicted"] == 1
    kept = toxicity.reject(df, lab)
    assert kept.columns == df.columns and 1002 not in {x["doc_id"] for x in kept.collect()}
    assert toxicity.score(none, lab).count() == 0
    assert {x["score"] for x in toxicity.score(df, lab.limit(0)).collect()} == {0.0}


def test_toxic_stems_of_texts_that_share_a_word(spark):
    # One word with the smallest crc32 of all stands in every text.
    low = "anly"
    rows = [({low, "grumbolt", f"t{'abcdefgh'[i]}zz"}, 1) for i in range(8)] + [({low, f"c{'abcdefgh'[i]}zz"}, 0) for i in range(8)]
    assert {zlib.crc32(w.encode()) >= zlib.crc32(low.encode()) for words, _ in rows for w in words} == {True}
    assert "grumbolt" in toxicity.candidates(rows)
    assert toxicity.candidates([rows[0]] * 8 + rows[8:]) == []  # copies count once


def test_lm_scores(docs, none):
    got = lm.score(docs.select("doc_id", "text", "score"), steps=20).collect()
    learn = [r for r in docs.collect() if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10]
    counts = Counter(w for r in learn for w in (r["text"] or "").encode().lower().split())
    total, kinds = sum(counts.values()) + len(learn), len(counts) + 1
    term = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    want = []
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        want.append((str(r["doc_id"]), len(w) + 1, 1 + sum(counts[x] > 0 for x in w), round(sum(term(counts[x]) for x in w) + term(len(learn)), 5)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == sorted(want)
    assert all(r["train_tokens"] == total and r["score"] < 0 for r in got)
    assert lm.score(none, steps=5).count() == 0


def test_lm_scores_do_not_depend_on_the_head(docs):
    few, all_ = ({r["doc_id"]: r for r in lm.score(docs.where("doc_id <> 58").select("doc_id", "text"), steps=20, head=h).collect()} for h in (3, 120_000))
    assert few.keys() == all_.keys()
    for d, r in few.items():
        assert r["score"] == pytest.approx(all_[d]["score"], abs=1e-6) and r["base_score"] == pytest.approx(all_[d]["base_score"], abs=1e-6)


def test_lm_share_is_fitted_on_other_documents(spark, monkeypatch):
    rows = [(i, "") for i in range(400)] + [(400 + i, words(i, 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fitted, trained = [], []
    monkeypatch.setattr(lm.Mixture, "fit", lambda self, docs, ids, seen: fitted.extend(x.tobytes() for x in ids))
    monkeypatch.setattr(lm.Attention, "train", lambda self, docs, *_: trained.extend(x.tobytes() for x in docs))
    lm.score(df)
    assert len(trained) > 400 and 40 < len(fitted) < 300 and not set(fitted) & set(trained)
    assert all(len(x) > 2 for x in fitted)


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    """Other places of the same words in one document that no sample holds leave
    all counts as they are, and still change the scores of other documents."""
    rows = [(i, words(i, 60)) for i in range(60)]
    met, learned = [], lm.learned
    monkeypatch.setattr(lm, "learned", lambda learn, text_col, subwords, *a: met.append((learned(learn, text_col, subwords, *a), subwords)))

    def scored(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        learn = df.where(lm.id_hash("doc_id", 10) != 0)
        sample = lm.sampled(learn, "doc_id", "text", learn.count(), 6, 2)
        return sample, {r["doc_id"]: r for r in lm.score(df, steps=10, sample_docs=6, share_docs=2).collect()}

    sample, one = scored(rows)
    k = next(i for i, t in rows if not one[i]["held_out"] and t.encode() not in sample[0] + sample[1])
    again, two = scored([(i, " ".join(reversed(t.split())) if i == k else t) for i, t in rows])
    assert 0 < len(sample[0]) + len(sample[1]) < 20 and again == sample
    assert all(one[i]["base_score"] == pytest.approx(two[i]["base_score"]) for i in one)
    assert all(one[i]["score"] != two[i]["score"] for i in one if i != k)
    ids = lm.Seen(met[0][1], {}, {}).documents([t.encode() for i, t in rows if not one[i]["held_out"]])[1]
    assert met[0][0] == met[1][0] == sum(map(len, ids))


def test_attention_gradients_are_those_of_its_loss():
    import numpy as np

    r = np.random.default_rng(3)
    starts = np.arange(lm.IDS) < 3 * lm.SIZE
    model = lm.Attention(np.log(r.dirichlet(np.ones(lm.IDS), lm.IDS)).astype(np.float32), np.arange(lm.IDS), starts)
    for name in "mc":
        model.p[name] += r.normal(0, 0.3, model.p[name].shape).astype(np.float32)
    model.ready()
    x, y, _ = lm.windows([r.integers(0, lm.IDS, n).astype(np.uint16) for n in (37, 5, 64)])
    x, y = model.renumbered(x), np.where(y >= 0, model.place[y], -1)
    each, start, g = model.gradients(x, y)
    assert np.allclose([each, start], model.log_probs(x, y), atol=1e-5)
    for name, old in model.apart().p.items():
        d, losses = r.normal(0, 1, old.shape).astype(np.float32), []
        for way in (0.01, -0.01):
            model.p[name] = old + np.float32(way) * d
            model.ready()
            losses.append(-model.log_probs(x, y)[0].astype(float).sum() / (y >= 0).sum())
        model.p[name] = old
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(float((g[name] * d).sum()), rel=0.02, abs=2e-4)


def test_attention_is_a_distribution_and_causal():
    import numpy as np

    r = np.random.default_rng(0)
    starts = np.arange(lm.IDS) < 3 * lm.SIZE
    place = np.concatenate([r.permutation(3 * lm.SIZE), 3 * lm.SIZE + r.permutation(lm.IDS - 3 * lm.SIZE)])
    model = lm.Attention(np.log(r.dirichlet(np.ones(lm.IDS), lm.IDS)).astype(np.float32), place, starts)
    model.p["m"] += r.normal(0, 0.3, model.p["m"].shape).astype(np.float32)
    model.p["c"] += r.normal(0, 0.3, model.p["c"].shape).astype(np.float32)
    model.ready()
    start = r.integers(0, lm.IDS, 37).astype(np.uint16)
    one, opens = model.log_ids([start])
    each = [math.exp(model.log_ids([np.append(start[:20], np.uint16(k))])[0][-1]) for k in range(lm.IDS)]
    assert sum(each) == pytest.approx(1, abs=1e-3)
    assert sum(p for p, s in zip(each, starts, strict=True) if s) == pytest.approx(math.exp(opens[20]), abs=1e-4)
    later = start.copy()
    later[30:] = 5
    assert np.allclose(model.log_ids([later])[0][:30], one[:30], atol=1e-5)
    assert np.allclose(model.log_ids([start[:9], start])[0][9:], one, atol=1e-5)


def test_word_chances_add_up_to_one_at_most():
    """Over all known words and the end, after a text and at its start."""
    import numpy as np

    known = sorted({w.encode() for w in words(5, 400).split()} | {b"caf\xc3\xa9,", b"x\xe3\x80\x80y"})
    path = lm.default_vocabulary()
    ids, sizes = lm.encoded(path, known)
    assert sizes.tolist() == [len(lm.tokenizer(path).encode_ordinary(" " + w.decode())) for w in known]
    subwords = lm.Subwords(path, dict(Counter(ids.tolist())))
    flat, sizes = subwords.encode(known)
    ends = np.cumsum(sizes) - 1
    first, last, pairs = np.zeros(lm.IDS), np.zeros(lm.IDS), np.zeros((lm.IDS, lm.IDS))
    np.add.at(first, flat[ends - sizes + 1], 1)
    np.add.at(last, flat[ends], 1)
    for a, b, k in zip(flat, flat[1:], range(len(flat)), strict=False):
        pairs[a, b] += k not in ends
    assert subwords.starts[flat[ends - sizes + 1]].all() and subwords.starts.sum() % lm.SIZE == 0
    total = len(known) + 40
    terms = {w: math.log10(1 / total) for w in known} | {b"": math.log10(40 / total)}
    seen = lm.Seen(subwords, terms, {})
    texts = [b" ".join(known[k : k + 10]) for k in range(0, len(known), 10)]
    _, docs = seen.documents(texts)
    model = lm.Attention(lm.prior_of(first, last, pairs, len(known), 40), lm.classes_of(docs, first, subwords.starts), subwords.starts)
    model.train(docs, 150, 32)
    mixture = lm.Mixture(model, terms)
    for before in ([], known[:3]):
        masses = np.zeros(3)
        for w in [*known, None]:
            one, two = mixture.parts(*seen.documents([b" ".join([*before, *([w] if w else [])])]), seen)
            k = len(before)
            masses += 10 ** np.array([one[k], two[k], mixture.mixed(one, two)[k]])
        assert masses[0] <= 1.001 and masses[1] == pytest.approx(1) and 0.3 < masses[2] <= 1.001


def test_rejections_keep_every_column(spark):
    rows = [(i, words(i, 40), "en", 1, "r", "h") for i in range(60)] + [(i, "1 2 3", "en", 1, "r", "h") for i in (60, 61, 61)] + [(70, None, None, 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, _row string, held_out string")
    left = langid.reject(df)
    assert left.schema == df.schema and sorted(r["doc_id"] for r in left.collect()) == list(range(60))
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    left = toxicity.reject(df, labels)
    assert left.schema == df.schema and left.count() == 64
    assert langid.reject(df.where("doc_id < 0")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{x}}</style><script>var t="</p><article>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">menu</a></li><li><a>more</a></li></ul></nav><div class="ad">buy {i}</div>
<article><h1>Title {i} &amp; more</h1><p><b>First {i}<br><p>Second   line\n of <i>it</i>alics</p><div class="notice">cookies</div>{extra}<p>Last&nbsp;&lt;one&gt;</p>
<div id="comments"><p>reader {i}</p></div></article><aside>side</aside><form><label>name</label></form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i, extra="<p>E</p>" * (i % 3))) for i in range(12)]
    rows += [(20, None, None), (21, "http://b.example/1", ""), (22, "not a url", "<div><p>plain words only</p></div>"), (23, "http://a.example/x", "<article>cut <p>off")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1 << 20, 0):
        got = {r["page_id"]: r for r in htmlwrap.main_text(df, most_bytes=most).collect()}
        for i in range(12):
            lines = [f"Title {i} & more", f"First {i}", "Second line of italics", *["E"] * (i % 3), "Last <one>"]
            assert got[i]["text"] == "\n".join(lines) and got[i]["n_chars"] == len(got[i]["text"])
        assert [got[k]["text"] for k in (20, 21, 22, 23)] == ["", "", "plain words only", "cut\noff"]
    assert htmlwrap.main_text(df.where("page_id < 0")).count() == 0


def test_html_fixed_slots_and_names_around_the_main_part(spark):
    page = '<html><body class="no-sidebar header-fixed"><div class="page modal"><article><p>Text {i}</p><div class="zz"><p>Same everywhere</p></div></article></div></body></html>'
    rows = [(i, f"http://c.example/{i}", page.format(i=i)) for i in range(5)]
    got = htmlwrap.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Text {i}" for i in range(5)}


def test_wrapper_is_union_free():
    a = htmlwrap.shape_of(htmlwrap.stream("<ul><li>a</li><li>b</li></ul><p>x</p>")[0])
    b = htmlwrap.shape_of(htmlwrap.stream("<ul><li>a</li></ul><h2>t</h2><p>x</p>")[0])
    expression = htmlwrap.Wrapper([a, b]).expression()
    assert expression == "<ul> ( <li> # </li> )+ </ul> (<h2>)? (#)? (</h2>)? <p> # </p>"


def test_scores_remember_a_bounded_number_of_words():
    lexicons = toxicity.Lexicons({}, (1, 1))
    model = toxicity.Model(lexicons, [{"one"}, {"two"}], [[0] * 4, [0] * 4], rounds=1)
    for k in range(70_000):
        model.known(f"w{k}")
    assert len(model.cache) <= toxicity.MEMO + 1 < 70_000


def test_sample_of_toxicity_is_kept_as_numbers():
    """The same stems and weights as from sets of words, which are not held all at once."""
    import numpy as np
    import pyarrow as pa

    lists = [sorted({f"word{(i * k) % 37}" for k in range(1, 9)} | ({"grumbolt"} if i % 3 == 0 else set())) for i in range(60)]
    vocabulary, codes = toxicity.coded(pa.chunked_array([pa.array(lists[:25]), pa.array(lists[25:])]))
    assert vocabulary == sorted(vocabulary) and all(c.dtype == np.int32 for c in codes)
    bags, ys = toxicity.Bags(vocabulary, codes), [int(i % 3 == 0) for i in range(60)]
    assert list(bags) == [set(x) for x in lists] and len(bags) == 60
    pairs = toxicity.Bags(vocabulary, codes, ys)
    stems = toxicity.candidates(pairs)
    assert "grumbolt" in stems and stems == toxicity.candidates([(set(x), y) for x, y in zip(lists, ys, strict=True)])
    lexicons = toxicity.Lexicons({"grumbolt": (0, 20)}, (40, 20))
    one, two = (toxicity.Model(lexicons, words, [[0] * 4] * 60) for words in (bags, [set(x) for x in lists]))
    assert np.array_equal(one.w, two.w) and np.array_equal(one.u, two.u)
