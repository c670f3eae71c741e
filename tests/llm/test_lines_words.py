"""Line dedup, spelling variants and collocations against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_words import words
from pyspark.sql import functions as F
from tidalmark.llm import linededup, phrases, variants
from tidalmark.llm.common import bits_at

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, id string, drops long, N_LINES string"


def line_rows():
    same = "  This line stands in MANY documents.\t"
    out = [(i, f"{same}\nown line of document {i}, long enough\n\n{'é' * 19}\n{'É' * 20}", "en", "x", 1, "y") for i in range(30)]
    out += [
        (100, f"{same.lower().strip()}\nshort\n{same}", "en", None, None, None),
        (101, "twice in one document only\ntwice in one document only", "en", None, None, None),
        (102, "of two documents, which is too few", "en", None, None, None),
        (103, "of two documents, which is too few", None, None, None, None),
        (104, "rows of one document count once", "en", None, None, None),
        (104, "rows of one document count once", "en", None, None, None),
        (104, "rows of one document count once\nother", "en", None, None, None),
        (105, "rows of one document count once", "en", None, None, None),
        (106, None, "en", None, None, None),
        (107, "", "en", None, None, None),
        (None, f"{same}\nleft", "en", None, None, None),
        (None, "left too\n" + same, "en", None, None, None),
        (108, "\n".join(f"line {k} of a very long text" for k in range(30000)), "en", None, None, None),
        (109, "line 7 of a very long text\r\n line 7 of a very long text", "en", None, None, None),
        (110, "line 7 of a very long text", "en", None, None, None),
    ]
    return out


def brute_lines(rows, least_docs=3, least_chars=20):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            gone = len(k) >= least_chars and len(holders[k]) >= least_docs
            if not gone or r[0] == max(x for x in holders[k] if x is not None):
                kept.append(line)
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = linededup.dedup(df).select("doc_id", "n_lines", "n_dropped", "kept", "id", "drops")
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == brute_lines(rows)
    assert {(r.doc_id, r.id, r.drops) for r in got.collect()} == {(r[0], r[3], r[4]) for r in rows}


def test_line_dedup_by_both_joins(spark, monkeypatch):
    """A key of over 1,000 documents goes by broadcast, the rest by shuffle."""
    rows = [(i, f"the line of all documents\nthe line of group {i % 300}, no more", "en", None, None, None) for i in range(1200)]
    monkeypatch.setattr(linededup, "HOT", 2)
    df = spark.createDataFrame(rows, COLUMNS)
    got = linededup.dedup(df, keep=["doc_id"]).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_lines(rows)


def test_line_dedup_of_nothing(spark, none):
    assert linededup.dedup(none).count() == 0


def brute_words(rows, least, least_chars, times, slip):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_chars:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out, form = {}, {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
        out[w] = len(others)
    whole = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        whole.append((w, n[w], out[w], form[w], n[form[w]] if form[w] else None, root))
    return sorted(whole)


def word_rows():
    out = [(i, words(i % 11, 80, ("ab", "ba", "a", "é", "É", "B")), "en", None, None, None) for i in range(60)]
    chain = ["abcdefg"] * 200 + ["abcdefh"] * 40 + ["abcdeih"] * 8 + ["aaabbbaaa", "aabbbaaa", "aabbbbaaa"] * 6
    tied = ["abcdefx"] * 5 + ["abcdefgxy"] * 5 + ["abcdefgx"] * 25 + ["abcdefgy"] * 25
    out += [(200 + i, f"{w}, {w.upper()}-{w}1{w}", "en", None, None, None) for i, w in enumerate(chain + tied)]
    out += [(None, "abcdefg " * 9, "en", None, None, None), (7, None, "en", None, None, None), (8, "", "en", None, None, None)]
    out += [(9, "ß÷×ÀÿÀÿ" * 3, "en", None, None, None)] * 6  # all of U+00C0 to U+00FF, signs among them
    return out + [(900 + i, "x" * 30000 + "yz"[i > 5], "en", None, None, None) for i in range(12)]


@pytest.mark.parametrize("slip", [0, 3])
def test_spelling_variants(spark, slip):
    rows = word_rows()
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = variants.group(df, least=5, least_chars=6, times=5, slip=slip)
    assert sorted(tuple(r) for r in got.collect()) == brute_words(rows, 5, 6, 5, slip)


def test_spelling_variants_of_a_small_table(spark):
    """Partial counts that are sent on when the table is full add up."""
    rows = word_rows()[:40]
    got = variants.group(spark.createDataFrame(rows, COLUMNS), least=2, least_chars=3, times=2, slip=5, held=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_words(rows, 2, 3, 2, 5)


def test_spelling_variants_of_nothing(spark, none):
    assert variants.group(none).count() == 0


def test_deletion_hashes_are_those_of_the_words():
    def points(w):
        return np.frombuffer(w.encode("utf-32-le"), "<u4")[None, :]

    for w in ("aabé", "zyxw", "ééé"):
        less = variants.hashes(points(w))[1][0]
        assert list(less) == [variants.hashes(points(w[:i] + w[i + 1 :]))[0][0] for i in range(len(w))]


def brute_phrases(rows, longest, least, percent, top):
    f, total = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (r[1] or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        rows_ = []
        for p, a in found.items():
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if 100 * longer[p] < percent * a or not longer[p]:
                rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_rows():
    out = [(i, words(i % 9, 120, ("a", "b", "é")).replace("ab ", "ab, ").replace("ba ", "ba\t "), "en" if i % 3 else "de", None, None, None) for i in range(40)]
    out += [(i, "New York City. new york city! NEW YORK\x0bstate a a a a", None, None, None, None) for i in range(100, 112)]
    out += [(200, "a a a a a a a a a a a a a", "fr", None, None, None), (201, None, "fr", None, None, None), (202, " \t.,\n", "xx", None, None, None)]
    out += [(203, "no end of words here " * 400, "y y", None, None, None)] * 2
    return out


@pytest.mark.parametrize(("longest", "block", "stretch"), [(3, 1 << 21, 1 << 20), (4, 50, 64), (2, 1, 7)])
def test_collocations(spark, longest, block, stretch):
    """Blocks and stretches of any size count the same."""
    rows = phrase_rows()
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = phrases.mine(df, longest=longest, top=60, block=block, stretch=stretch)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, longest, 10, 50, 60)


def test_collocations_with_a_full_map(spark):
    """A map that lets all phrases through changes no result."""
    rows = phrase_rows()
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(tuple(r) for r in phrases.mine(df, top=60, bits=1024).collect()) == brute_phrases(rows, 3, 10, 50, 60)


def test_phrase_hashes_are_alike_in_tasks_and_in_spark(spark):
    df = spark.createDataFrame([("en", "new"), ("en", "new york"), ("dé", "süß"), ("en", "a a a")], "lang string, phrase string")
    want = {r.phrase: r.h for r in df.select("phrase", phrases.phrase_hash().alias("h")).collect()}
    for lang, text in (("en", "new york"), ("dé", "süß"), ("en", "a a a")):
        block = phrases.Block()
        block.add(lang, text.encode().split(), True)
        found = postings = phrases.Lists.postings(block)
        while found.words.shape[1] < len(text.split()):
            found = found.extended(postings)
        assert int(found.hashed[found.phrase[0]].astype(np.int64)) == want[text]
    bits = np.frombuffer(bits_at(df.limit(1), F.lit(5), 1024).value, np.uint8)
    assert bits.size == 128 and bits[0] == 0b100


def test_collocations_of_nothing(spark, none):
    assert phrases.mine(none).count() == 0


def test_queries(spark, sf_dir):
    from tidalmark.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [tuple(r) for r in docs]
    lines = queries.op11_line_dedup(spark, sf_dir).collect()
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_lines(rows)]
    assert sorted((tuple(r) for r in lines), key=str) == sorted(want, key=str)
    found = queries.op13_collocations(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in found) == brute_phrases(rows, 3, 10, 50, 2000)
