"""Language-model scoring with causal self-attention over subword ids.

*Subwords.*  A word (A-Z lower-cased, then runs of other bytes than
``[\\x20\\x09-\\x0D]``) is encoded with a space before it by a public byte-level
BPE.  The ``IDS - 257`` most frequent of its ids (counted over all training
documents) keep a number of their own, other ids are spelled in bytes, and the
end is one id more.  Only a word's first id begins with a space, so the ids that
begin a word, with the end, are known: the *starts*.

*Corpus statistics.*  Words are counted over all training documents.  From that
table come the base score, and the counts of subword pairs: each distinct word
is encoded once and its pairs weigh as often as the word stands.  They make the
prior of the next subword.

*Model.*  One layer of causal self-attention with learned relative positions,
trained in numpy with Adam; its output shifts the prior's logits.  Training
starts on ``sample_docs`` whole texts on the driver and then goes once over all
training documents: each task goes on from the same weights over its own
documents, and the tasks' weights are averaged by the ids they met (``learned``).  The softmax
is factored into ``CLASSES`` classes of ``IDS / CLASSES`` ids; starts have classes
of their own, so the chance that a word ends is a sum over classes.

*Words.*  The attention's chance of a word is that of its first id among the
starts, of its other ids, and of a start after them: over all words and the end
these add up to 1 at most.  It is mixed with the words' frequencies in training,
whose weight is fitted on all training documents, by the chances that the
attention gave their words before it learned from them (it starts from
``share_docs`` documents, drawn by a hash of the id).  The score is the sum of the mixture's log10 over the words and the end.

*Scoring.*  A document's ids are cut into windows of ``CONTEXT + STRIDE`` ids that
overlap by ``CONTEXT``; each window scores its last ``STRIDE`` ids, so each id is
scored once, with ``CONTEXT`` ids before it at least (or all there are), in
batches with a causal mask.

Counts of the ``head`` most frequent words come from a broadcast table of at
most so many rows.  Each occurrence of any other word is a row with the
attention's log10 P; a join by word gives its count, from which come its base
term and its mixture, so ``head`` changes the work of the join and no result.

Nulls: a null text is empty: its only token is the end.  A null id counts as
empty text for the folds.  Without training documents N and V are 0, every base
term is that of an unknown word, and the prior is flat.  Repeated rows each get
their own row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import Counter
from copy import copy
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_hash, quoted, raw, slices

IDS, CLASSES = 1024, 32
SIZE = IDS // CLASSES
CONTEXT, STRIDE = 12, 16
SPAN = CONTEXT + STRIDE
KEY, HIDDEN = 12, 16
END, SPACE = 256, 32
MEMO = 250_000
HEAPS = 16
GAP, GAPS = 30, 100  # log10 of the second part over the first: bounds, and cells a unit
_tokenizers: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer(path: str):
    """The public byte-level BPE from its ranks, once a process."""
    if path not in _tokenizers:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _tokenizers[path] = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[path]


class Subwords:
    """flat, at, sizes: the model's ids of each of the vocabulary's ids;
    starts: which of the model's ids begin a word (or end a document)."""

    def __init__(self, path: str, used: dict[int, int]):
        """used: how often each of the vocabulary's ids stands in training."""
        self.path = path
        token = tokenizer(path).decode_single_token_bytes
        top = [i for i, _ in sorted(used.items(), key=lambda x: (-x[1], x[0])) if len(token(i)) > 1]
        first = [i for i in top if token(i)[0] == SPACE]
        # Starts fill whole classes: two of them are the space and the end.
        n = sum(token(i)[0] == SPACE for i in top[: IDS - 257])
        n = min(max(SIZE, (n + 2 + SIZE // 2) // SIZE * SIZE), IDS - 256 - SIZE) - 2
        ids = {*first[:n], *[i for i in top if token(i)[0] != SPACE][: IDS - 257 - n]}
        own = {i: END + 1 + k for k, i in enumerate(i for i in top if i in ids)}
        self.starts = np.zeros(IDS, bool)
        self.starts[[SPACE, END, *[k for i, k in own.items() if token(i)[0] == SPACE]]] = True
        spare = iter(np.flatnonzero(~self.starts)[::-1])  # numbers without an id, if there are too few
        while self.starts.sum() % SIZE:
            self.starts[next(spare)] = True
        spelled = [[own[i]] if i in own else list(token(i)) for i in range(tokenizer(path).n_vocab)]
        self.sizes = np.array([len(x) for x in spelled])
        self.flat = np.array(list(chain.from_iterable(spelled)), np.uint16)
        self.at = np.cumsum(self.sizes) - self.sizes

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each word has."""
        got, sizes = encoded(self.path, words)
        mine = self.sizes[got]
        ids = self.flat[gathered(self.at[got], mine)]
        first = np.cumsum(sizes) - sizes
        return ids, np.add.reduceat(mine, first) if len(words) else mine


def gathered(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches of ``sizes`` that begin at ``at``, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)


def encoded(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's ids of words, each with a space before it, and how many
    each word has.

    Words are encoded together: the splitter parts them at their spaces.  Only
    those with other white space inside are encoded by themselves.
    """
    tok = tokenizer(path)
    texts = b" ".join(words).decode()
    if texts.count(" ") == len(texts.split()) - 1:
        ids = np.array(tok.encode_ordinary(" " + texts), np.int64)
        first = np.flatnonzero(opening(path)[ids])
        if len(first) == len(words):
            return ids, np.diff(np.append(first, len(ids)))
    each = [tok.encode_ordinary(" " + w.decode()) for w in words]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter(chain.from_iterable(each), np.int64, sizes.sum()), sizes


@cache
def opening(path: str) -> np.ndarray:
    """Which of the vocabulary's ids begin with a space."""
    token = tokenizer(path).decode_single_token_bytes
    return np.array([token(i)[0] == SPACE for i in range(tokenizer(path).n_vocab)])


def prior_of(first: np.ndarray, last: np.ndarray, pairs: np.ndarray, words: float, docs: float) -> np.ndarray:
    """log P(next | previous) from counts of first and last subwords of words
    and of pairs inside words."""
    ends = docs / max(1.0, words)
    start = first / max(1.0, first.sum())
    counts = pairs.astype(np.float64)
    counts += last[:, None] * start[None] * (1 - min(ends, 0.5))
    counts[:, END] += last * min(ends, 0.5)
    counts[END] = start * max(1.0, docs)
    single = counts.sum(0) + 0.05
    single /= single.sum()
    return np.log((counts + 4 * single) / (counts.sum(1, keepdims=True) + 4)).astype(np.float32)


def classes_of(docs: list[np.ndarray], seen: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class-ordered place of each id: starts first; of either kind, ids
    that stand in the same documents are near each other, then by frequency."""
    table = np.array([np.bincount(d, minlength=IDS) for d in docs], float).reshape(-1, IDS)
    table = np.sqrt(table / np.maximum(1, table.sum(1, keepdims=True)))
    parts = [np.flatnonzero(starts), np.flatnonzero(~starts)]
    for _ in range(2):
        halves = []
        for p in parts:
            if len(table):
                x = table[:, p] - table[:, p].mean(0)
                x /= np.linalg.norm(x, axis=0) + 1e-9
                axis = np.linalg.svd(x, full_matrices=False)[2][0]
            else:
                axis = np.zeros(len(p))
            order = p[np.argsort(axis, kind="stable")]
            halves += [order[: len(p) // 2], order[len(p) // 2 :]]
        parts = halves
    order = np.concatenate([p[np.argsort(-seen[p], kind="stable")] for p in parts])
    place = np.empty(IDS, np.int64)
    place[order] = np.arange(IDS)
    return place


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input ids [w, SPAN] (IDS where there is none), targets [w, STRIDE] (-1
    where there is none), and the document of each window."""
    sizes = np.array([len(d) for d in docs])
    targets = np.concatenate(docs).astype(np.int64)
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    starts = np.cumsum(sizes) - sizes
    inputs[starts] = -1
    counts = -(-sizes // STRIDE)
    owner = np.repeat(np.arange(len(docs)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (starts[owner] + step * STRIDE)[:, None]
    place = at + np.arange(-CONTEXT, STRIDE)
    ok = (place >= starts[owner][:, None]) & (place < (starts + sizes)[owner][:, None])
    place = np.clip(place, 0, len(targets) - 1)
    return np.where(ok, inputs[place], -2), np.where(ok, targets[place], -1)[:, CONTEXT:], owner


def summed(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows (the last axis) of each id."""
    at, rows = at.ravel().astype(np.uint16), rows.reshape(-1, rows.shape[-1])
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=np.uint16(IDS + 1)))
    out = np.zeros((IDS + 1, rows.shape[1]), np.float32)
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Attention:
    """Tables by id (one row more for 'none'): key, query, value, own; bias by
    distance; class and member weights."""

    def __init__(self, prior: np.ndarray, place: np.ndarray, starts: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        self.place = place  # id -> class * SIZE + member
        self.opening = int(starts.sum()) // SIZE  # classes of starts, which come first
        order = np.argsort(place)
        self.end = int(place[END])
        prior = prior[order][:, order]
        members = prior.reshape(IDS, CLASSES, SIZE)
        top = members.max(2, keepdims=True)
        group = np.log(np.exp(members - top).sum(2)) + top[:, :, 0]
        self.prior_class = np.ascontiguousarray(group, np.float32)
        self.prior_flat = np.ascontiguousarray(members - group[:, :, None], np.float32).reshape(IDS * CLASSES, SIZE)
        shape = {"k": (IDS + 1, KEY), "q": (IDS + 1, KEY), "v": (IDS + 1, HIDDEN), "u": (IDS + 1, HIDDEN)}
        self.p = {k: r.normal(0, 0.3, s) for k, s in shape.items()}
        self.p |= {"b": np.zeros(SPAN), "c": np.zeros((HIDDEN, CLASSES)), "m": np.zeros((IDS, HIDDEN))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.ready()
        gap = np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None]
        self.gap, self.hidden = np.maximum(gap, 0), np.where(gap < 0, np.float32(-1e4), np.float32(0))

    def ready(self) -> None:
        """Weights as scoring reads them."""
        self.member_t = np.ascontiguousarray(self.p["m"].reshape(CLASSES, SIZE, HIDDEN).transpose(0, 2, 1))

    def renumbered(self, ids: np.ndarray) -> np.ndarray:
        """Class-ordered ids; -1 is the start, -2 none."""
        table = np.append(self.place, [IDS, self.end])  # places -2 and -1
        return table[ids]

    def forward(self, x: np.ndarray):
        """One more key component hides the row 'none' from every query."""
        p = self.p
        one, none = np.ones((IDS + 1, 1), np.float32), np.zeros((IDS + 1, 1), np.float32)
        none[IDS] = -1e4
        own = x[:, CONTEXT:]
        q, k, v = np.hstack([p["q"], one])[own], np.hstack([p["k"], none])[x], p["v"][x]
        s = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
        s += p["b"][self.gap] + self.hidden
        np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True) + np.float32(1e-30)
        h = np.matmul(s, v)
        h += p["u"][own]
        return own, q, k, v, s, np.tanh(h, out=h)

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P of each target, and of a start in its place (0 where there is none)."""
        own, *_, h = self.forward(x)
        y = y.ravel()
        group = np.where(y >= 0, y // SIZE, CLASSES).astype(np.uint8)
        keep = np.argsort(group, kind="stable")  # by class; those without a target last
        cuts = np.searchsorted(group[keep], np.arange(CLASSES + 1))
        keep = keep[: cuts[CLASSES]]
        own, h, y = own.ravel()[keep], h.reshape(-1, HIDDEN)[keep], y[keep]
        z = h @ self.p["c"]
        z += self.prior_class[own]
        rows = np.arange(len(y))
        picked = z[rows, y // SIZE]
        np.exp(z, out=z)
        total = z.sum(1)
        start = np.log(z[:, : self.opening].sum(1) / total)
        z = np.empty((len(y), SIZE), np.float32)
        for c in range(CLASSES):
            part = slice(cuts[c], cuts[c + 1])
            np.matmul(h[part], self.member_t[c], out=z[part])
        z += self.prior_flat[own * CLASSES + y // SIZE]
        picked += z[rows, y % SIZE]
        total *= np.exp(z, out=z).sum(1)
        full = np.zeros((2, x.shape[0] * STRIDE), np.float32)
        full[0, keep] = picked - np.log(total)
        full[1, keep] = start
        return full[0].reshape(-1, STRIDE), full[1].reshape(-1, STRIDE)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """Both results of ``log_probs``, and the mean loss's gradients."""
        own, q, k, v, s, h3 = self.forward(x)
        y = y.ravel()
        group = np.where(y >= 0, y // SIZE, CLASSES).astype(np.uint8)
        keep = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[keep], np.arange(CLASSES + 1))
        keep = keep[: cuts[CLASSES]]
        h, o, t = h3.reshape(-1, HIDDEN)[keep], own.ravel()[keep], y[keep]
        n, rows = np.float32(max(1, len(t))), np.arange(len(t))
        z = h @ self.p["c"]
        z += self.prior_class[o]
        picked = z[rows, t // SIZE]
        np.exp(z, out=z)
        total = z.sum(1)
        full = np.zeros((2, len(y)), np.float32)
        full[1, keep] = np.log(z[:, : self.opening].sum(1) / total)
        z /= total[:, None]
        w = np.empty((len(t), SIZE), np.float32)
        parts = [slice(cuts[c], cuts[c + 1]) for c in range(CLASSES)]
        for c, part in enumerate(parts):
            np.matmul(h[part], self.member_t[c], out=w[part])
        w += self.prior_flat[o * CLASSES + t // SIZE]
        picked += w[rows, t % SIZE]
        inside = np.exp(w, out=w).sum(1)
        full[0, keep] = picked - np.log(total * inside)
        w /= inside[:, None]
        z[rows, t // SIZE] -= 1
        w[rows, t % SIZE] -= 1
        z /= n
        w /= n
        g = {"c": h.T @ z, "m": np.empty((IDS, HIDDEN), np.float32)}
        dt = z @ self.p["c"].T
        for c, part in enumerate(parts):
            np.matmul(w[part].T, h[part], out=g["m"][c * SIZE : (c + 1) * SIZE])
            dt[part] += w[part] @ self.member_t[c].T
        dt *= 1 - h * h
        dh = np.zeros((len(y), HIDDEN), np.float32)
        dh[keep] = dt
        dh = dh.reshape(h3.shape)
        dv = np.matmul(s.transpose(0, 2, 1), dh)
        ds = np.matmul(dh, np.ascontiguousarray(v.transpose(0, 2, 1)))
        ds -= (ds * s).sum(2, keepdims=True)
        ds *= s
        g["b"] = np.bincount(self.gap.ravel(), ds.sum(0).ravel(), SPAN).astype(np.float32)
        dq, dk = np.matmul(ds, k)[:, :, :KEY], np.matmul(ds.transpose(0, 2, 1), q)[:, :, :KEY]
        g["q"], g["u"] = np.split(summed(own, np.concatenate([dq, dh], 2)), [KEY], axis=1)
        g["k"], g["v"] = np.split(summed(x, np.concatenate([dk, dv], 2)), [KEY], axis=1)
        return full[0].reshape(-1, STRIDE), full[1].reshape(-1, STRIDE), g

    def step(self, g: dict, held: dict, t: int, rate: float) -> None:
        """The ``t``-th step of Adam (from 1), whose means are in ``held``."""
        for name, d in g.items():
            m, v = held.setdefault(name, (np.zeros_like(d), np.zeros_like(d)))
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            v *= np.float32(0.99)
            v += np.float32(0.01) * d * d
            move = np.sqrt(v / np.float32(1 - 0.99**t))
            move += np.float32(1e-7)
            np.divide(m, move, out=move)
            move *= np.float32(rate / (1 - 0.9**t))
            self.p[name] -= move
        self.ready()

    def train(self, docs: list[np.ndarray], steps: int, batch: int, seed: int = 1) -> None:
        if not docs:
            return
        r = np.random.default_rng(seed)
        x, y, _ = windows(docs)
        x, y = self.renumbered(x), np.where(y >= 0, self.place[y], -1)
        held: dict = {}
        for t in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            self.step(self.gradients(x[pick], y[pick])[2], held, t, 0.02 * (1 - t / (steps + 1)))

    def apart(self) -> "Attention":
        """The same model with weights of its own."""
        other = copy(self)
        other.p = {k: v.copy() for k, v in self.p.items()}
        other.ready()
        return other

    def log_ids(self, docs: list[np.ndarray], batch: int = 192) -> tuple[np.ndarray, np.ndarray]:
        """log P of each id of the documents, one after another, and of a start in its place."""
        x, y, _ = windows(docs)
        x, y = self.renumbered(x), np.where(y >= 0, self.place[y], -1)
        parts = [self.log_probs(x[at : at + batch], y[at : at + batch]) for at in range(0, len(x), batch)]
        return np.concatenate([p for p, _ in parts])[y >= 0], np.concatenate([p for _, p in parts])[y >= 0]


class Seen:
    """Numbers of the words met so far; by number the word, its ids, how many
    they are, its log10 frequency in the mixture and its base term (both NaN
    where they must come from the join)."""

    def __init__(self, subwords: Subwords, terms: dict[bytes, float], base: dict[bytes, float]):
        self.subwords, self.known, self.bases = subwords, terms, base
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.flat, self.sizes, self.at = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)
        self.terms, self.base = np.empty(0), np.empty(0)

    def add(self, new: list[bytes]) -> None:
        if not new:
            return
        ids, sizes = self.subwords.encode(new)
        self.number.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.words += new
        self.at = np.append(self.at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.flat, self.sizes = np.append(self.flat, ids), np.append(self.sizes, sizes)
        none = float("nan")
        self.terms = np.append(self.terms, [self.known.get(w, none) for w in new])
        self.base = np.append(self.base, [self.bases.get(w, none) for w in new])

    def documents(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Word numbers and model ids of each text."""
        split = [t.lower().split() for t in texts]
        if len(self.words) > MEMO:
            self.clear()
        self.add(list(set(chain.from_iterable(split)).difference(self.number)))
        docs = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in split]
        end = np.array([END], np.uint16)
        return docs, [np.append(self.flat[gathered(self.at[d], self.sizes[d])], end) for d in docs]


class Mixture:
    """The attention model, and with weight 1 - ``share`` the corpus's word
    frequencies, of the words in ``terms`` (log10 of the frequency)."""

    def __init__(self, model: Attention, terms: dict[bytes, float]):
        self.model, self.terms, self.share = model, terms, 0.7

    def parts(self, docs: list[np.ndarray], ids: list[np.ndarray], seen: Seen) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of every word (a document's end last) in either part; NaN in
        the second where ``seen`` has no term."""
        return self.of_ids(docs, seen, *self.model.log_ids(ids))

    def of_ids(self, docs: list[np.ndarray], seen: Seen, each: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from what ``log_ids`` gives for the documents."""
        lengths = np.concatenate([x for d in docs for x in (seen.sizes[d], [1])])
        other = np.concatenate([x for d in docs for x in (seen.terms[d], [self.terms[b""]])])
        first = np.cumsum(lengths) - lengths
        words, start = np.add.reduceat(each.astype(np.float64), first), start[first]
        words -= start
        words[:-1] += start[1:]  # after a word comes the next one, or the end
        last = np.cumsum([len(d) + 1 for d in docs]) - 1
        words[last[:-1]] -= start[last[:-1] + 1]  # after the end comes nothing
        return words / np.log(10), other

    def fit(self, docs: list[np.ndarray], ids: list[np.ndarray], seen: Seen, rounds: int = 20) -> None:
        """``seen`` has a term for each word that stands in training; others have none."""
        if not docs:
            return
        one, two = (10.0**x for x in self.parts(docs, ids, seen))
        two = np.nan_to_num(two)
        for _ in range(rounds):
            q = self.share * one
            self.share = float(np.clip((q / (q + (1 - self.share) * two + 1e-300)).mean(), 0.05, 0.98))

    def fit_gaps(self, counts: np.ndarray, rounds: int = 50) -> None:
        """The share from the numbers of words by ``gaps`` of their two parts."""
        odds = 10.0 ** ((np.arange(len(counts)) + 0.5) / GAPS - GAP)
        for _ in range(rounds if counts.any() else 0):
            q = self.share / (self.share + (1 - self.share) * odds)
            self.share = float(np.clip((q * counts).sum() / counts.sum(), 0.05, 0.98))

    def mixed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P of words from both parts."""
        one, two = one + np.log10(self.share), two + np.log10(1 - self.share)
        high = np.maximum(one, two)
        return high + np.log10(1 + 10.0 ** (np.minimum(one, two) - high))

    def joined(self, one: Column, count: Column, total: int) -> Column:
        """The same from a joined count, null where there is none."""
        one = one + F.lit(float(np.log10(self.share)))
        two = F.log10(count) + F.lit(float(np.log10(1 - self.share) - np.log10(max(total, 1))))
        high = F.greatest(one, two)
        both = high + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), F.least(one, two) - high))
        return F.when(count.isNull(), one).otherwise(both)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word (binary) and n over all texts; tasks sum before the shuffle."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    counts.update(text.lower().split())
                if len(counts) > 400_000:
                    yield packed(counts)
                    counts.clear()
        yield packed(counts)

    def packed(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select(quoted(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, head: int) -> int:
    """The smallest count that at most ``head`` words reach, of counts rounded
    up to three significant bits (so a few hundred groups at most)."""
    step = F.expr("shiftleft(1L, greatest(0, cast(floor(log2(n)) AS int) - 2))")
    level = F.floor(F.col("n") / step) * step
    groups = counts.groupBy(level.cast("long").alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    least, seen = 1 << 62, 0
    for g in groups:
        seen += g["words"]
        if seen > head:
            break
        least = g["level"]
    return least


def id_counts(counts: DataFrame, path: str) -> dict[int, int]:
    """How often each of the vocabulary's ids stands in all words; tasks sum,
    and there are at most as many as the vocabulary has."""

    def run(batches):
        used = np.zeros(tokenizer(path).n_vocab, np.int64)
        for batch in batches:
            ids, sizes = encoded(path, batch.column(0).to_pylist())
            np.add.at(used, ids, np.repeat(batch.column(1).to_numpy(), sizes))
        met = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(used[met], pa.int64())], ["i", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["i"].to_pylist(), rows["n"].to_pylist(), strict=True))


def pair_counts(counts: DataFrame, subwords: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of first and last subwords of words and of pairs inside words;
    tasks sum, and there are at most IDS * IDS pairs."""
    shared = counts.sparkSession.sparkContext.broadcast(subwords)

    def run(batches):
        pairs, first, last = np.zeros((IDS, IDS), np.int64), np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if not words:
                continue
            ids, sizes = shared.value.encode(words)
            ends = np.cumsum(sizes) - 1
            np.add.at(first, ids[ends - sizes + 1], n)
            np.add.at(last, ids[ends], n)
            inside = np.ones(len(ids), bool)
            inside[ends] = False
            at = np.flatnonzero(inside)
            np.add.at(pairs, (ids[at], ids[at + 1]), np.repeat(n, sizes)[at])
        for p, table in ((-1, first[None]), (-2, last[None]), (0, pairs)):
            a, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a + p if p < 0 else a, pa.int32()), pa.array(b, pa.int32()), pa.array(table[a, b], pa.int64())], ["p", "q", "n"]
            )

    rows = counts.mapInArrow(run, "p int, q int, n long").groupBy("p", "q").agg(F.sum("n").alias("n")).toArrow()
    p, q, n = (rows.column(c).to_numpy() for c in ("p", "q", "n"))
    pairs, first, last = np.zeros((IDS, IDS)), np.zeros(IDS), np.zeros(IDS)
    inside = p >= 0
    pairs[p[inside], q[inside]] = n[inside]
    first[q[p == -1]] = n[p == -1]
    last[q[p == -2]] = n[p == -2]
    return first, last, pairs


def sampled(learn: DataFrame, id_col: str, text_col: str, n: int, sample_docs: int, share_docs: int) -> tuple[list[bytes], list[bytes]]:
    """About ``sample_docs`` whole texts of the ``n`` documents to train on, and
    ``share_docs`` others that are no copies of them (in proportion, where
    there are fewer documents)."""
    both = sample_docs + share_docs
    share = int(min(1.0, both / max(1, n)) * (1 << 30))
    some = (
        learn.where(F.pmod(F.xxhash64(quoted(id_col), F.lit("lm")), F.lit(1 << 30)) < share)
        .select(
            quoted(text_col).cast("binary").alias("t"),
            (F.pmod(F.xxhash64(quoted(id_col), F.lit("share")), F.lit(both)) < share_docs).alias("apart"),
        )
        .limit(2 * both)
        .collect()
    )
    texts = sorted((r["apart"], bytes(r["t"] or b"")) for r in some)
    own = [t for a, t in texts if not a]
    copies = set(own)
    return own, [t for a, t in texts if a and t not in copies]


def learned(learn: DataFrame, text_col: str, subwords: Subwords, mixture: Mixture, rare: float, batch: int, rate: float) -> int:
    """Trains ``mixture`` on every text of ``learn``; returns the number of ids met.

    A task starts with the weights it is given, takes its texts a MB at a time,
    their windows in mixed order, and makes a step of Adam each ``batch`` windows,
    so that each id is a target once.  Before a step its windows are scored;
    these scores say how the attention does on words it has not learned from.
    ``rare`` is the log10 frequency of the words without a term of their own.
    Tasks' weights are summed by as many tasks as there are ``HEAPS``, in
    the order of partitions, so the driver gets that many rows at most.
    """
    spark = learn.sparkSession
    shared = spark.sparkContext.broadcast((subwords, mixture))
    names = list(mixture.model.p)
    cells = 2 * GAP * GAPS

    def run(batches):
        subwords, given = shared.value
        ours = Mixture(given.model.apart(), given.terms)
        model, seen, r = ours.model, Seen(subwords, ours.terms, {}), np.random.default_rng(0)
        held: dict = {}
        met, step, gaps = 0, 0, np.zeros(cells, np.int64)
        for whole in batches:
            for part in slices(whole, 0, 1 << 20):
                docs, ids = seen.documents(raw(part.column(0)))
                x, y, _ = windows(ids)
                x, y = model.renumbered(x), np.where(y >= 0, model.place[y], -1)
                each, start = np.empty((2, *y.shape), np.float32)
                order = r.permutation(len(x))
                for at in range(0, len(x), batch):
                    pick, step = order[at : at + batch], step + 1
                    each[pick], start[pick], g = model.gradients(x[pick], y[pick])
                    model.step(g, held, step, rate * min(1, len(pick) / batch) / (1 + step / 200) ** 0.5)
                one, two = ours.of_ids(docs, seen, each[y >= 0], start[y >= 0])
                gap = (np.nan_to_num(two, nan=rare) - one + GAP) * GAPS
                gaps += np.bincount(np.clip(gap, 0, cells - 1).astype(np.int64), minlength=cells)
                met += sum(map(len, ids))
        if met:
            flat = np.concatenate([model.p[k].ravel() for k in names]).astype(np.float64) * met
            yield row(TaskContext.get().partitionId(), met, flat, gaps)

    def row(part, met, flat, gaps):
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, met, flat.tobytes(), gaps.tobytes()), kinds, strict=True)], ["part", "met", "flat", "gaps"])

    def added(batches):
        whole = None
        for batch in batches:
            for met, flat, gaps in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                new = [met, np.frombuffer(flat), np.frombuffer(gaps, np.int64)]
                whole = new if whole is None else [a + b for a, b in zip(whole, new, strict=True)]
        if whole:
            yield row(TaskContext.get().partitionId(), *whole)

    schema = "part int, met long, flat binary, gaps binary"
    made = learn.select(quoted(text_col)).mapInArrow(run, schema)
    heaps = made.repartition(HEAPS, "part").sortWithinPartitions("part").mapInArrow(added, schema).collect()
    heaps.sort(key=lambda x: x["part"])
    met = sum(h["met"] for h in heaps)
    if met:
        flat = sum(np.frombuffer(h["flat"]) for h in heaps) / met
        at = 0
        for k in names:
            old = mixture.model.p[k]
            mixture.model.p[k] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        mixture.model.ready()
        mixture.fit_gaps(sum(np.frombuffer(h["gaps"], np.int64) for h in heaps))
    shared.unpersist()
    return met


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    folds: int = 10,
    held: int = 0,
    head: int = 120_000,
    sample_docs: int = 1500,
    share_docs: int = 300,
    steps: int = 700,
    batch: int = 96,
    rate: float = 0.02,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    path = path or default_vocabulary()
    spark = docs.sparkSession
    learn = docs.where(id_hash(id_col, folds) != held)
    train_docs = learn.count()
    counts = cut(word_counts(learn, text_col))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    words, distinct = totals["n"] or 0, totals["v"]
    total, kinds = words + train_docs, distinct + (train_docs > 0)
    top = {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") >= least_count(counts, head)).collect()}
    subwords = Subwords(path, id_counts(counts, path))
    first, last, pairs = pair_counts(counts, subwords)
    prior = prior_of(first, last, pairs, words, train_docs)
    texts, apart = sampled(learn, id_col, text_col, train_docs, sample_docs, share_docs)
    terms = {w: float(np.log10(n / total)) for w, n in top.items()} | {b"": float(np.log10(max(train_docs, 0.1) / max(total, 1)))}
    # The sample's words that are not in the head; as many as the sample has at most.
    met = {w for t in texts + apart for w in t.lower().split()} - top.keys()
    asked = spark.createDataFrame(pa.table({"word": pa.array(sorted(met), pa.binary())}))
    rare = counts.join(F.broadcast(asked), "word", "left_semi").collect() if met else []
    seen = Seen(subwords, terms | {bytes(r["word"]): float(np.log10(r["n"] / total)) for r in rare}, {})
    _, ids = seen.documents(texts)
    model = Attention(prior, classes_of(ids, first + pairs.sum(0), subwords.starts), subwords.starts)
    model.train(ids, steps, batch)
    mixture = Mixture(model, terms)
    mixture.fit(*seen.documents(apart or texts), seen)
    far = counts.where(F.col("n") < min(top.values(), default=1 << 62)).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s")).first()
    learned(learn, text_col, subwords, mixture, float(np.log10((far["s"] or 1) / (far["n"] or 1) / max(total, 1))), 2 * batch, rate)
    shared = spark.sparkContext.broadcast((subwords, mixture, top))
    scale = float(np.log10(total + 0.1 * (kinds + 1)))
    end_term = float(np.log10(train_docs + 0.1)) - scale
    src = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        quoted(id_col).alias("id"),
        (id_hash(id_col, folds) == held).alias("held_out"),
        quoted(text_col).alias("text"),
    )
    id_kind = src.schema["id"].dataType
    out = f"rid long, id {id_kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary"

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        subwords, mixture, top = shared.value
        seen = Seen(subwords, mixture.terms, {w: float(np.log10(n + 0.1)) - scale for w, n in top.items()})
        kinds = [pa.int64(), to_arrow_type(id_kind), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        names = ["rid", "id", "held_out", "n_tokens", "n_known", "base", "score", "word"]

        def made(*columns):
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for whole in batches:
            for part in slices(whole, 3, 1 << 20):
                texts = [t or b"" for t in part.column(3).cast(pa.binary()).to_pylist()]
                docs, ids = seen.documents(texts)
                one, two = mixture.parts(docs, ids, seen)
                n = len(docs)
                sizes = np.array([len(d) for d in docs])
                owner = np.repeat(np.arange(n), sizes)
                words = np.concatenate(docs)
                ends = np.cumsum(sizes + 1) - 1
                terms = seen.base[words]
                far = np.isnan(terms)
                near = ~np.insert(far, np.cumsum(sizes), False)  # ends too
                both = mixture.mixed(one[near], two[near])
                scores = np.bincount(np.repeat(np.arange(n), sizes + 1)[near], both, n)
                known = np.bincount(owner[~far], minlength=n) + int(train_docs > 0)
                base = np.bincount(owner[~far], terms[~far], n) + end_term
                rids = part.column(0).to_numpy()
                # The key of a document's own row is no word: it holds a space.
                keys = [b" %d" % r for r in rids.tolist()]
                yield made(rids, part.column(1), part.column(2), sizes + 1, known, base, scores, keys)
                k = int(far.sum())
                if k:
                    none = np.zeros(k)
                    at = np.delete(one, ends)[far]
                    keys = list(map(seen.words.__getitem__, words[far].tolist()))
                    yield made(rids[owner[far]], pa.nulls(k, kinds[1]), pa.nulls(k, kinds[2]), np.ones(k, np.int64), none.astype(np.int64), none, at, keys)

    rows = src.mapInArrow(run, out)
    own = F.col("held_out").isNotNull()
    met = F.col("c").isNotNull()
    joined = rows.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    term = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) - F.lit(scale)
    return (
        joined.groupBy("rid")
        .agg(
            F.max("id").alias(id_col),
            F.max("held_out").alias("held_out"),
            F.max(F.when(own, F.col("n_tokens"))).alias("n_tokens"),
            F.sum(F.when(own, F.col("n_known")).when(met, F.col("n_tokens")).otherwise(0)).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            F.sum(F.when(own, F.col("base")).otherwise(F.col("n_tokens") * term)).alias("base_score"),
            F.sum(F.when(own, F.col("score")).otherwise(mixture.joined(F.col("score"), F.col("c"), total))).alias("score"),
        )
        .drop("rid")
    )
