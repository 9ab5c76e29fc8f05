"""Language ID by a linear-chain conditional random field over the words of a text.

A word's features are the byte n-grams of ^word$ (those with ^ or $ are its affixes) and its entry in a learned
lexicon; transitions between the languages of neighbouring words are learned with them. Training
sequences are windows of labelled texts, half of them spliced from two languages, so that the model sees
switches. Words are labelled by forward-backward over runs of at most SEQUENCE words; a text's
language is that with the most posterior mass over all its words.

The model is fitted in numpy on a sample bounded by parameters; every text is then labelled whole, in the task
that reads it, without a shuffle."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

WORD = re.compile(r"[^\W\d_]+")
NGRAMS, BUCKETS = (2, 3, 4), 1 << 16
SEQUENCE = 64  # words in a chain
AT_ONCE = 100_000  # words scored together
SLICE = 4 << 20  # bytes of text that are Python strings together
UND = "und"


class Model(NamedTuple):
    langs: list[str]
    grams: np.ndarray  # (BUCKETS, L)
    words: np.ndarray  # sorted hashes of the lexicon
    lexicon: np.ndarray  # (len(words) + 1, L), the last for other words
    move: np.ndarray  # (L, L), from and to


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and for each word the end of its own among them."""
    flat = np.frombuffer(b"".join(b"^%b$" % w for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(flat))  # bytes of the word from here on
    code, found, owner = np.zeros(len(flat), np.uint64), [], []
    of = np.repeat(np.arange(len(words)), size)
    for n in range(1, max(NGRAMS) + 1):
        code = code[: len(flat) - n + 1] | (flat[n - 1 :] << np.uint64(8 * (n - 1)))
        if n in NGRAMS:
            ok = np.flatnonzero(left[: len(code)] >= n)
            found.append((((code[ok] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64))
            owner.append(of[ok])
    return np.concatenate(found), np.concatenate(owner)


def scores(model: Model, words: list[bytes]) -> np.ndarray:
    """Emission score of each language for each word."""
    if not words:
        return np.zeros((0, len(model.langs)))
    g, owner = grams(words)
    n = np.bincount(owner, minlength=len(words))
    out = np.stack([np.bincount(owner, model.grams[g, k], len(words)) for k in range(len(model.langs))], axis=1) / np.sqrt(n)[:, None]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return out + model.lexicon[lookup(model.words, h)]


def lookup(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = np.searchsorted(sorted_hashes, h)
    i[i == len(sorted_hashes)] = 0
    return np.where(sorted_hashes[i] == h, i, len(sorted_hashes)) if len(sorted_hashes) else np.zeros(len(h), np.int64)


def posteriors(emit: np.ndarray, mask: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Forward-backward. emit: (B, T, L) scores; mask: (B, T), True for words, which come first. Marginals (B, T, L);
    with pairs also the log partition and the expected transitions (L, L)."""
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    m = np.exp(move)
    b, t, _ = e.shape
    fwd, scale = np.empty_like(e), np.ones((b, t))
    now = e[:, 0]
    for i in range(t):
        if i:
            now = np.where(mask[:, i, None], (fwd[:, i - 1] @ m) * e[:, i], fwd[:, i - 1])
        scale[:, i] = np.where(mask[:, i] | (i == 0), now.sum(axis=1), 1.0)
        fwd[:, i] = now / scale[:, i, None]
    back = np.ones((b, e.shape[2]))
    post, moved = np.empty_like(e), np.zeros_like(m)
    for i in range(t - 1, -1, -1):
        p = fwd[:, i] * back
        post[:, i] = p / p.sum(axis=1, keepdims=True)
        if i:
            inner = e[:, i] * back
            if pairs:
                x = np.einsum("bi,bj->bij", fwd[:, i - 1], inner) * m
                moved += (x / x.sum(axis=(1, 2), keepdims=True) * mask[:, i, None, None]).sum(axis=0)
            back = np.where(mask[:, i, None], inner @ m.T, back)
            back /= back.sum(axis=1, keepdims=True)
    if not pairs:
        return post
    return post, (np.log(scale) * mask + top[:, :, 0] * mask).sum(), moved


def windows(docs: DataFrame, per_lang: int, per_doc: int, words: int, most_langs: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """(lang, words): at most per_doc windows of each of about per_lang texts (never over twice as many) of the most_langs
    commonest languages, chosen by a hash of id and text and spread over the whole text. Only these numbers, not the
    corpus, bound what is gathered here."""
    learn = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    counts = learn.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["count"]))))[F.col(lang_col)]
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rows = learn.where(spot < share).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def cut(batches):
        for b in batches:
            out = []
            for i, lang, text in zip(*(b.column(c).to_pylist() for c in ("id", "lang", "text"))):
                ws = WORD.findall(text.lower())
                for at in sorted({int(x) for x in np.linspace(0, max(0, len(ws) - words), per_doc)}):
                    if ws:
                        out.append((i, lang, ws[at : at + words]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(pa.string()))], ["id", "lang", "words"])

    got: dict[str, list[tuple[str, list[str]]]] = {}
    for r in rows.mapInArrow(cut, "id string, lang string, words array<string>").toLocalIterator():
        if len(mine := got.setdefault(r.lang, [])) < 2 * per_lang * per_doc:  # equal rows are in the sample together
            mine.append((r.id or "", r.words))
    return [(lang, ws) for lang in sorted(got) for _, ws in sorted(got[lang])]


def train(docs: DataFrame, per_lang: int = 600, per_doc: int = 4, words: int = 40, epochs: int = 6, rate: float = 0.5, least: int = 3, most_lexicon: int = 50_000, most_langs: int = 200, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on rows with text and lang that held_out leaves; None where there are none. Bounds: per_lang texts of a language,
    per_doc windows of a text, `words` words of a window, most_lexicon words in the lexicon, the most_langs commonest languages."""
    data = windows(docs, per_lang, per_doc, words, most_langs, id_col, text_col, lang_col)
    if not data:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({x for x, _ in data})
    code = {x: i for i, x in enumerate(langs)}
    vocab: dict[bytes, int] = {}
    seqs = []
    while data:  # words become numbers one sequence after the other, so that they are held once
        lang, ws = data.pop()
        seqs.append((np.fromiter((vocab.setdefault(w.encode(), len(vocab)) for w in ws), np.int32, len(ws)), np.full(len(ws), code[lang], np.int8)))
    seqs.reverse()
    for i in rng.permutation(len(seqs))[: len(seqs) // 2 if len(langs) > 1 else 0].tolist():  # code-switched
        a, b = seqs[i], seqs[int(rng.integers(len(seqs)))]
        k, j = int(rng.integers(len(a[0]) + 1)), int(rng.integers(len(b[0]) + 1))
        seqs.append(tuple(np.concatenate([x[:k], y[j : j + words - k]]) for x, y in zip(a, b)))
    seqs = [s for s in seqs if len(s[0])]
    ids = [s[0] for s in seqs]
    distinct = list(vocab)
    times = np.bincount(np.concatenate(ids), minlength=len(vocab))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    often = np.argsort(-times, kind="stable")[:most_lexicon]
    lex_words = np.sort(h[often[times[often] >= least]])
    lex_of = lookup(lex_words, h)
    parts = []
    for at in range(0, len(distinct), 4096):
        own, owner = grams(distinct[at : at + 4096])
        parts.append((own[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(distinct[at : at + 4096]))))
    g, n_grams = (np.concatenate(x) for x in zip(*parts))
    norm = 1 / np.sqrt(n_grams)
    ends = np.concatenate([[0], np.cumsum(n_grams)])
    del parts, vocab, distinct

    k = len(langs)
    gram, lex, move = np.zeros((BUCKETS, k)), np.zeros((len(lex_words) + 1, k)), np.zeros((k, k))
    sums = [np.full_like(x, 1e-6) for x in (gram, lex, move)]
    t = max(len(s) for s in ids)
    for _ in range(epochs):
        todo = rng.permutation(len(ids))
        for part in np.array_split(todo, max(1, len(todo) // 256)):
            x, y, mask = np.zeros((len(part), t), np.int64), np.zeros((len(part), t), np.int64), np.zeros((len(part), t), bool)
            for r, i in enumerate(part):
                x[r, : len(ids[i])], y[r, : len(ids[i])], mask[r, : len(ids[i])] = *seqs[i], True
            used, inv = np.unique(x[mask], return_inverse=True)
            size = ends[used + 1] - ends[used]
            pos = np.repeat(ends[used] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            gg, oo = g[pos], np.repeat(np.arange(len(used)), size)
            e = np.stack([np.bincount(oo, gram[gg, c], len(used)) for c in range(k)], axis=1) * norm[used, None] + lex[lex_of[used]]
            emit = np.zeros((*x.shape, k))
            emit[mask] = e[inv]
            post, _, moved = posteriors(emit, mask, move, pairs=True)
            wrong = post[mask]
            wrong[np.arange(len(wrong)), y[mask]] -= 1
            by_word = np.stack([np.bincount(inv, wrong[:, c], len(used)) for c in range(k)], axis=1)
            both = mask[:, 1:] & mask[:, :-1]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            down = by_word * norm[used, None]
            grads = (np.stack([np.bincount(gg, down[oo, c], BUCKETS) for c in range(k)], axis=1), np.zeros_like(lex), moved - seen)
            np.add.at(grads[1], lex_of[used], by_word)
            for w, s, d in zip((gram, lex, move), sums, grads):
                d = d / len(part) + 1e-5 * w
                s += d * d
                w -= rate * d / np.sqrt(s)
    return Model(langs, gram.astype(np.float32), lex_words, lex, move)


def label(model: Model, texts: list[str | None]):
    """For each text its words' marginals, (n, L), over the words that hold a letter, and those words."""
    held, n = [], 0
    for t in texts:
        held.append(WORD.findall((t or "").lower()))
        n += len(held[-1])
        if n >= AT_ONCE:
            yield from _label(model, held)
            held, n = [], 0
    if held:
        yield from _label(model, held)


def _label(model: Model, lists: list[list[str]]):
    vocab: dict[str, int] = {}
    for ws in lists:
        for w in ws:
            if w not in vocab:
                vocab[w] = len(vocab)
    letters = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in vocab), bool, len(vocab))
    e = scores(model, [w.encode("utf-8", "surrogatepass") for w in vocab])
    ids = [np.fromiter(map(vocab.__getitem__, ws), np.int64, len(ws)) for ws in lists]
    ids = [x[letters[x]] for x in ids]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    runs = -(-size // SEQUENCE)
    row = np.repeat(np.concatenate([[0], np.cumsum(runs)[:-1]]), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    row, col = row + at // SEQUENCE, at % SEQUENCE
    out = np.empty((len(flat), len(model.langs)))
    total, step = int(runs.sum()), 2000
    first = np.searchsorted(row, np.arange(0, total + step, step))
    for a, s in enumerate(range(0, total, step)):
        own = slice(first[a], first[a + 1])
        t = int(col[own].max()) + 1
        emit, mask = np.zeros((min(step, total - s), t, len(model.langs))), np.zeros((min(step, total - s), t), bool)
        emit[row[own] - s, col[own]] = e[flat[own]]
        mask[row[own] - s, col[own]] = True
        out[own] = posteriors(emit, mask, model.move)[row[own] - s, col[own]]
    ends = np.cumsum(size)
    names = list(vocab)
    for x, end in zip(ids, ends.tolist()):
        yield out[end - len(x) : end], (names, x)


def verdicts(model: Model | None, texts: pa.Array):
    """For each text its language and that language's share of the posterior mass."""
    for part in slices(texts, SLICE):
        for post, _ in label(model, part.to_pylist()) if model else (((), None) for _ in part):
            if len(post):
                mass = post.mean(axis=0)
                best = int(mass.argmax())
                yield model.langs[best], min(1.0, float(mass[best]))
            else:
                yield UND, 0.0


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (its share of the posterior mass) of every row, repeated rows alike. Texts that are null or
    have no letter are `und` with score 0; so are all where there is no model. Only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = list(verdicts(sent.value, b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words and labels (a language for each word) of every row: of the words that hold a letter, in lower case. Null texts
    and those without a letter have none; repeated rows are labelled each; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            words, labels = [], []
            for post, (names, x) in label(m, b.column("text").to_pylist()):
                words.append([names[i] for i in x])
                labels.append([m.langs[i] for i in post.argmax(axis=1)] if len(post) else [])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string()))], ["id", "words", "labels"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, words array<string>, labels array<string>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    found = predict(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows that are `und` or whose language has under `least` of the posterior mass. Only texts go to
    Python, and only verdicts come back. Null texts and those without a letter go; repeated rows are judged alike; where no row
    can be learned from, all go; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        return pa.array([lang != UND and share >= least for lang, share in verdicts(sent.value, texts)], pa.bool_())

    return docs.where(known("text"))
