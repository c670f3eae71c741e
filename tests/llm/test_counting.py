"""Mixing, decontamination, licences and token counts against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest

from tidalmark.llm import decontam, licenses, mixing, tokencount

WS = re.compile(rb"[^\x20\x09-\x0D]+")
AN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").encode().lower()


def test_mixing_reaches_targets(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        n = len(WS.findall((r["text"] or "").encode()))
        assert r["size"] == n and r["taken"] <= 3 * n
        sizes[r["source"]] += n
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * sizes[s]
    names = sorted(sizes, key=lambda s: (s is None, s))
    free = [(s, 1 + i % 3) for i, s in enumerate(names) if target[s] < 3 * sizes[s] - 1e-9]
    assert len({round(target[s] / w, 6) for s, w in free}) == 1


def test_mixing_reruns_agree(docs):
    one, two = (sorted(map(tuple, mixing.mix(docs.repartition(n), keep=["doc_id"]).collect()), key=str) for n in (2, 5))
    assert one == two


def test_mixing_and_cleaning_keep_clashing_columns(spark):
    rows = [(i, f"word {i} " * 9, "a", 7, 8, 9, "s") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, n_hit int, _size int, _source string")
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "size", "source_size", "target", "taken"]
    assert {(r["n_words"], r["_size"], r["_source"]) for r in got.collect()} == {(7, 9, "s")}
    items = spark.createDataFrame([(1, "word 3 word 3 word 3"), (None, "word 5"), (2, None)], "item_id long, text string")
    for how, left in (("documents", 18), ("spans", 20)):
        out = decontam.clean(df, items, remove=how)
        assert out.columns == df.columns and out.count() == left
        assert {(r["n_words"], r["n_hit"]) for r in out.collect()} == {(7, 8)}


def test_mixing_empty(none):
    assert mixing.mix(none).count() == 0


def brute_hits(texts, items, n=13):
    windows = defaultdict(set)
    for item, text in items:
        w = AN.findall(low(text))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for text in texts:
        w, hit, named = AN.findall(low(text)), set(), set()
        for i in range(len(w)):
            for size in {len(x) for x in windows}:
                if own := windows.get(tuple(w[i : i + size])) if i + size <= len(w) else None:
                    hit |= set(range(i, i + size))
                    named |= own
        out.append((len(w), len(hit), named))
    return out


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_decontamination_is_exact(spark, docs, block):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    long = texts[3] or ""
    items = [(1, " ".join(texts[5].split()[10:40])), (2, "one two"), (10, "one two"), (3, None), (4, ""), (2, "one two"), (None, "rights reserved"), (7, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.judged(decontam.scan(docs, bench, block_bytes=block)).collect()
    want = brute_hits([r["text"] for r in got], items)
    for r, (n, hit, named) in zip(got, want, strict=True):
        names = sorted(str(x) for x in named if x is not None)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_decontamination_removes(spark, docs, none):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns
    assert {57, 58}.isdisjoint({r["doc_id"] for r in left.collect()}) and left.count() == docs.count() - 3
    cut = {r["doc_id"]: r["text"] for r in decontam.clean(docs, bench, remove="spans").collect()}
    assert cut[57] == "" and cut[53] is None and cut[60].startswith("Licensed")
    assert decontam.clean(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(docs, empty).count() == docs.count()


def test_licenses(docs, none):
    got = licenses.scan(docs).collect()
    for r in got:
        w = AN.findall(low(r["text"]))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.encode().split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    found = {r["doc_id"]: r["labels"] for r in got}
    assert found[60] == "cc-by,cc-by-nc,reserved"
    assert licenses.scan(none).count() == 0


def test_token_counts_equal_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokencount.default_vocabulary())
    more = [(200, "a<|endoftext|>b <|endoftext|>"), (201, "naïve Straße 东京 ֐xሴy  \n\n z's we'll"), (202, "é" * 500), (203, "tab\tx\r\ny z\x85 ")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in both.collect())
    for head in (50, 100_000):
        got = tokencount.digest(both, head=head).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert tokencount.digest(none).count() == 0


def test_token_split_equals_the_library_on_every_code_point():
    pre = tokencount.tokenizer(tokencount.default_vocabulary()).pre_tokenizer
    chars = [chr(c) for c in [*range(1, 0x558), *range(0x2000, 0x2070)]]
    text = "".join(f"a{c}1 {c}{c}" for c in chars)
    assert not tokencount.OTHER.search(text)
    assert [s for _, s in pre.pre_tokenize_str(text)] == [m.span() for m in tokencount.SPLIT.finditer(text)]
